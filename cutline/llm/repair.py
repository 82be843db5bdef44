"""Conversation structure repair (operator 13): rank-convergence parallel Viterbi.

Rows of a conversation, in order, are turned by edits into a sequence of roles that fits ``(s?(ua)+)?``. What may follow depends on four
states only (start, after system, after user, after assistant), so what is still to be paid is a vector of four costs, and a chunk of rows maps
the vector after it to the one before it. Chunks are worked in parallel from a guessed vector; where the neighbour's vector turns
out to differ by more than a constant, the chunk is worked again, until nothing changes. The edits are then traced forwards
against the stitched vectors, taking the least letter that is still cheapest.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The next role that an inserted or rerolled row has in each state, and the states that a kept row may lead to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: A row's code: initial of its role, and what must or may happen to it.
INITIALS = "sua?"
FORCED, CUT = 4, 8
NO = 1 << 40  # no way from here
END = (0, 4, 2, 0)  # cost of ending in each state, inserts included
GUESS = (0, 0, 0, 0)
#: Rows of a chunk, at most; passes before the rest is composed exactly.
CHUNK, PASSES = 4096, 8
LEGAL = ("su", "ua", "au")
NOT_BLANK = r"[^\x20\x09-\x0D]"


@lru_cache(1 << 16)
def step(code: int, after: tuple) -> tuple[tuple, int, tuple]:
    """(vector before the row less its minimum, that minimum, per state the cheapest edits up to the row and the state they lead to)."""
    initial, forced, cut = INITIALS[code & 3], code & FORCED, TRUNCATED * bool(code & CUT)
    own = []
    for q in range(4):
        ways = [(DELETE + after[q], "D", q)]
        if not forced:
            if initial in KEPT[q]:
                ways.append((cut + after[KEPT[q][initial]], "K", KEPT[q][initial]))
            ways.append((REROLE + cut + after[NEXT[q]], "R", NEXT[q]))
        own.append(min(ways))
    best = list(own)
    for q in (USER, ASSISTANT, START, SYSTEM):  # one insert at most pays between user and assistant
        at, paid, letters = q, 0, ""
        for _ in range(3):
            at, paid, letters = NEXT[at], paid + INSERT, letters + "I"
            best[q] = min(best[q], (own[at][0] + paid, letters + own[at][1], own[at][2]))
    low = min(b[0] for b in best)
    return tuple(min(b[0] - low, NO) for b in best), low, tuple((b[1], b[2]) for b in best)


def backward(codes: bytes, after: tuple) -> tuple:
    """The vector before a chunk, less its minimum."""
    for c in reversed(codes):
        after = step(c, after)[0]
    return after


def trace(codes: bytes, after: tuple, state: int, last: bool) -> tuple[list[str], int]:
    """The least cheapest edits of each row of a chunk, and the state at its end."""
    vectors = [after]
    for c in reversed(codes):
        vectors.append(step(c, vectors[-1])[0])
    out = []
    for i, c in enumerate(codes):
        letters, state = step(c, vectors[len(codes) - 1 - i])[2][state]
        out.append(letters)
    if last and out:
        out[-1] += "I" * (END[state] // INSERT)
    return out, state


def _series(kind: str):
    """A pandas UDF made when it is used: it needs a session."""
    return lambda f: lambda *cols: F.pandas_udf(f, kind)(*cols)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that a hash of conversation and turn deals out (nulls count as one space). Adds nothing to other columns,
    which go."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                       F.when(fault != 0, copies).otherwise(F.array().cast("array<int>")).alias("_c")).select("conv_id", "turn", "role", "text", F.explode("_c").alias("_c")).drop("_c")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, code and place: range-sorted, so that a long conversation lies in several
    partitions. ``idx`` rises with (conversation, turn, role, text), nulls first."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(_key().alias("ck"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    # Copies are combined before the shuffle, so that one row repeated without end weighs nothing.
    rows = rows.groupBy("ck", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("z"), F.col("turn").alias("t"))
    first = rows.groupBy("ck", "said").agg(F.min(when).alias("first"))
    blank = ~F.col("text").rlike(NOT_BLANK)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(blank, "b").when(when > F.col("first"), "d").when(~end.isin(".", "!", "?"), "t").otherwise("")
    place = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    rows = rows.join(first, ["ck", "said"]).withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    code = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    code = code + F.when(F.col("fault").isin("b", "d"), FORCED).when(F.col("fault") == "t", CUT).otherwise(0)
    rows = rows.select("ck", "conv_id", "turn", "role", "text", "n", "fault", "initial", code.cast("int").alias("code"))
    turn = F.col("turn").asc_nulls_first()
    # Only the head of a text decides which partition a row goes to; within it whole texts do.
    rows = rows.repartitionByRange("ck", turn, "role", F.substring("text", 1, 64)).sortWithinPartitions("ck", turn, "role", "text")
    return stored(rows.withColumn("idx", F.monotonically_increasing_id()), "ordered")


def _chunks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ck, idx, codes = pdf["ck"].to_numpy(), pdf["idx"].to_numpy(), pdf["code"].to_numpy().astype(np.uint8)
            cut = np.flatnonzero(np.r_[True, (ck[1:] != ck[:-1]) | (idx[1:] != idx[:-1] + 1)])
            ends = np.r_[cut[1:], len(ck)]
            parts = [(a, min(a + size, e)) for s, e in zip(cut.tolist(), ends.tolist(), strict=True) for a in range(s, e, size)]
            yield pd.DataFrame({"ck": [ck[a] for a, _ in parts], "at": [int(idx[a]) for a, _ in parts], "codes": [codes[a:e].tobytes() for a, e in parts]})

    return run


@_series("array<long>")
def _before(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([backward(c, tuple(int(x) for x in v)) for c, v in zip(codes, after, strict=True)])


def _vector(v: tuple) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in v])


def _composed(ways: DataFrame) -> DataFrame:
    """``after`` of every chunk from the chunks' exact maps: one small row each, streamed from the end of a conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, vector = None, END
        for pdf in batches:
            out = []
            for ck, at, maps in zip(pdf["ck"], pdf["at"], pdf["maps"], strict=True):
                if ck != now:
                    now, vector = ck, END
                out.append((ck, at, list(vector)))
                vector = [min(int(m) + v for m, v in zip(maps[q * 4 : q * 4 + 4], vector, strict=True)) for q in range(4)]
                vector = tuple(v - min(vector) for v in vector)
            yield pd.DataFrame(out, columns=["ck", "at", "after"])

    return ways.repartition("ck").sortWithinPartitions("ck", F.col("at").desc()).mapInPandas(run, "ck string, at long, after array<long>")


@_series("array<long>")
def _maps(codes: pd.Series) -> pd.Series:
    """The map of a chunk: cost from each state before it to each state after it."""
    out = []
    for c in codes:
        columns = []
        for q in range(4):
            vector, paid = tuple(0 if q == p else NO for p in range(4)), 0
            for x in reversed(c):
                vector, low, _ = step(x, vector)
                paid += low
            columns.append([v + paid if v < NO // 2 else NO for v in vector])
        out.append([columns[after][before] for before in range(4) for after in range(4)])
    return pd.Series(out)


def stitched(chunks: DataFrame, passes: int = PASSES) -> tuple[DataFrame, int]:
    """(ck, at, after): the vector after each chunk, right up to a constant; and the number of fix-up passes it took.

    A pass works the chunks again whose neighbour's vector has changed. Most rows forget the vector after them within a few steps.
    Chunks that do not (rows that are all deleted, roles that are never right) are composed exactly after ``passes`` passes.
    """
    w = Window.partitionBy("ck").orderBy("at")
    last = F.lead("at").over(w).isNull()
    guess = chunks.select("ck", "at").withColumn("after", F.when(last, _vector(END)).otherwise(_vector(GUESS)))
    vectors = stored(guess.join(chunks.select("at", "codes"), "at").select("ck", "at", "after", _before("codes", "after").alias("before")), "vectors")
    for done in range(passes):
        look = vectors.withColumn("want", F.coalesce(F.lead("before").over(w), _vector(END)))
        look = stored(look.withColumn("stale", F.col("want") != F.col("after")), "stale")
        stale = look.where("stale").select("ck", "at", F.col("want").alias("after"))
        if stale.isEmpty():
            return vectors.select("ck", "at", "after"), done
        again = stale.join(chunks.select("at", "codes"), "at").select("ck", "at", "after", _before("codes", "after").alias("before"))
        vectors = stored(look.where("not stale").select("ck", "at", "after", "before").unionByName(again), "vectors")
    return stored(_composed(chunks.select("ck", "at", _maps("codes").alias("maps"))), "vectors"), passes


@_series("array<int>")
def _exits(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[trace(c, tuple(int(x) for x in v), q, False)[1] for q in range(4)] for c, v in zip(codes, after, strict=True)])


@_series("array<string>")
def _edits(codes: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([trace(c, tuple(int(x) for x in v), q, z)[0] for c, v, q, z in zip(codes, after, state.tolist(), last.tolist(), strict=True)])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State at the start of each chunk."""
    now, state = None, START
    for pdf in batches:
        out = []
        for ck, at, exits in zip(pdf["ck"], pdf["at"], pdf["exits"], strict=True):
            if ck != now:
                now, state = ck, START
            out.append((ck, at, state))
            state = int(exits[state])
        yield pd.DataFrame(out, columns=["ck", "at", "state"])


def edited(rows: DataFrame, size: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """``ordered`` rows with ``edits``: the letters of the audit up to and with the row's own (its first copy's; further copies are
    deleted), after a conversation's last row also the inserts that end it."""
    rows = ordered(rows)
    chunks = stored(rows.select("ck", "idx", "code").mapInPandas(_chunks(size), "ck string, at long, codes binary"), "chunks")
    after, _ = stitched(chunks, passes)
    known = stored(after.join(chunks.select("at", "codes"), "at").select("ck", "at", "after", _exits("codes", "after").alias("exits")), "exits")
    entries = known.select("ck", "at", "exits").repartition("ck").sortWithinPartitions("ck", "at").mapInPandas(_entries, "ck string, at long, state int")
    last = F.lead("at").over(Window.partitionBy("ck").orderBy("at")).isNull()
    entries = entries.withColumn("last", last).select("at", "state", "last").join(known.select("at", "after"), "at")
    edits = entries.join(chunks.select("at", "codes"), "at").select("at", _edits("codes", "after", "state", "last").alias("e"))
    edits = stored(edits.select("at", F.posexplode("e").alias("k", "edits")).select((F.col("at") + F.col("k")).alias("idx"), "edits"), "edits")
    return rows.join(edits, "idx")


def _walk(edits: str, role: str, text: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The turns that a row's edits leave, and the state after them."""
    out = []
    for e in edits:
        if e == "K":
            out.append((role, text))
            state = KEPT[state][role[0]]
        elif e != "D":
            state = NEXT[state]
            out.append((NAMES[state], text if e == "R" else ""))
    return out, state


class _Tally:
    """What is reported of one conversation, its rows coming in order."""

    def __init__(self, ck: str):
        self.ck, self.state, self.initial, self.turn, self.low = ck, START, None, None, None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.sha, self.any = io.StringIO(), hashlib.sha256(), False

    def add(self, turn, role: str, text: str, n: int, fault: str, initial: str, edits: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial, self.illegal = initial, self.illegal + n - 1
        if fault == "b":
            self.blank += n
        else:
            self.duplicate += n - (fault != "d")
            self.truncated += fault == "t"
        own = edits.rstrip("I")
        tail = edits[len(own) :]
        letters = own + "D" * (n - 1) + tail
        self.audit.write(letters)
        self.cost += DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R") + TRUNCATED * (fault == "t" and own[-1] in "KR")
        turns, self.state = _walk(edits, role, text, self.state)
        for r, t in turns:
            self.sha.update((("\n" if self.any else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return self.ck, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.getvalue(), self.sha.hexdigest()


_REPORT = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = ["ck", "turn", "role", "text", "n", "fault", "initial", "edits"]


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, now = [c.split()[0] for c in _REPORT.split(", ")], None
    for pdf in batches:
        out = []
        turns = [None if t is None else int(t) for t in pdf["turn"]]  # text: no float stands between
        for ck, turn, *rest in zip(pdf["ck"], turns, *(pdf[c].tolist() for c in _COLUMNS[2:]), strict=True):
            if now is None or now.ck != ck:
                if now is not None:
                    out.append(now.row())
                now = _Tally(ck)
            now.add(turn, *rest)
        yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


def repair_report(rows: DataFrame, conversations: DataFrame | None = None, size: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of ``conversations``
    (by default of ``rows``).

    Rows are taken by turn (nulls first), then role and text by bytes. Null roles and texts count as one space; null conversations are
    one; a role whose initial is none of s, u, a (or that is empty) can only be rerolled or deleted. A row's first fault counts: blank,
    duplicate (of an earlier row's role and text; blank rows aside), truncated. A conversation without rows has zeros, an empty audit and the hash
    of nothing; an empty table gives no rows; other columns are ignored.

    Texts are shuffled four times and never gathered: sorting spreads a long conversation over partitions, and the hash and the audit
    of a conversation, sequential by nature, are streamed with one text in memory.
    """
    out = edited(rows, size, passes).withColumn("turn", F.col("turn").cast("long").cast("string")).select("idx", *_COLUMNS).repartition("ck").sortWithinPartitions("ck", "idx").drop("idx").mapInPandas(_report, _REPORT)
    ids = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("ck", _key())
    out = ids.join(out, "ck", "left").drop("ck")
    nothing = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select("conv_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in nothing.items()])


def repaired_turns(rows: DataFrame, size: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """conv_id, position (from 0), role, text: the repaired conversations themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, at = None, START, 0
        for pdf in batches:
            out = []
            for ck, role, text, edits in zip(*(pdf[c] for c in ("ck", "role", "text", "edits")), strict=True):
                if ck != now:
                    now, state, at = ck, START, 0
                turns, state = _walk(edits, role, text, state)
                out += [(ck[1:] or None, at + k, r, t) for k, (r, t) in enumerate(turns)]
                at += len(turns)
            yield pd.DataFrame(out, columns=["conv_id", "position", "role", "text"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    found = edited(rows, size, passes).select("idx", "ck", "role", "text", "edits")
    found = found.repartition("ck").sortWithinPartitions("ck", "idx").drop("idx").mapInPandas(run, "conv_id string, position long, role string, text string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
