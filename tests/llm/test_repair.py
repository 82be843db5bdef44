from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from cutline.llm.repair import _chunks, damaged, ordered, repair_report, repaired_turns, stitched
from cutline.llm.common import stored
from tests.llm.conftest import LONG

SCHEMA = "conv_id long, turn long, role string, text string, ck string, idx long, n string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """One conversation by a forward search over all edit sequences of least cost."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = {r[1] for r in rows if r[1] is not None}
    out = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    out["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    go = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best, seen = {"": (0, "", ())}, set()

    def inserts(best):
        for _ in range(3):
            for q, (c, a, made) in list(best.items()):
                n = "a" if q == "u" else "u"
                new = (c + 2, a + "I", (*made, ({"u": "user", "a": "assistant"}[n], "")))
                if n not in best or new[:2] < best[n][:2]:
                    best[n] = new
        return best

    for _, _, role, text in rows:
        fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if BLANK.findall(text)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        nxt = {}
        for q, (c, a, made) in inserts(best).items():
            ways = [(c + 3, a + "D", made, q)]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] in go[q]:
                    ways.append((c + cut, a + "K", (*made, (role, text)), go[q][role[:1]]))
                ways += [(c + 2 + cut, a + "R", (*made, (name, text)), n) for n, name in (("u", "user"), ("a", "assistant")) if n in go[q]]
            for c2, a2, m2, q2 in ways:
                if q2 not in nxt or (c2, a2) < nxt[q2][:2]:
                    nxt[q2] = (c2, a2, m2)
        best = nxt
    cost, audit, made = min(v for q, v in inserts(best).items() if q in ("", "a"))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}, made


def expected(rows):
    return {c: plain([r for r in hurt(rows) if r[0] == c])[0] for c in {r[0] for r in rows}}


def found(df):
    return {r["conv_id"]: {k: r[k] for k in r.asDict() if k != "conv_id"} for r in df.collect()}


def some(seed=3, convs=120):
    rng, rows = random.Random(seed), []
    for c in [*range(convs), None, -5]:
        for t in range(rng.choice([0, 1, 2, 5, 9, 40])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"])
            text = rng.choice(["a.", "b!", "c?", "never ends", "", " \t\n", None, "é.", f"only {t}.", f"cut {t} \n", "q.  "])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, text))
            if rng.random() < 0.1:
                rows += [rows[-1]] * 2
    return rows


def test_against_plain_search(spark):
    rows = some()
    df = frame(spark, rows)
    assert found(repair_report(damaged(df), df)) == expected(rows)


def test_small_chunks_and_long_conversation(spark):
    rng = random.Random(5)
    rows = some(7, 10) + [(77, t, rng.choice(["user", "assistant"]) if t % 60 < 30 else "tool", f"t{t % 400}.") for t in range(900)]
    rows += [(78, t, "tool", f"x{t}.") for t in range(300)] + [(79, t, "user", " ") for t in range(300)]
    want = expected(rows)
    df = frame(spark, rows)
    assert found(repair_report(damaged(df), df, size=7, passes=2)) == want  # ends in the exact composition
    assert found(repair_report(damaged(df), df, size=16, passes=100)) == want


def test_most_chunks_settle_at_once(spark):
    df = frame(spark, [(1, t, "assistant" if t % 2 else "user", f"t{t}.") for t in range(4000)])
    rows = ordered(damaged(df))
    chunks = stored(rows.select("ck", "idx", "code").mapInPandas(_chunks(50), "ck string, at long, codes binary"), "chunks")
    assert chunks.count() >= 70
    assert stitched(chunks)[1] <= 2


def test_repaired_turns_and_long_texts(spark):
    rows = [*some(11, 20), (500, 0, "user", LONG + "."), (500, 1, "assistant", LONG), (500, 1, "assistant", LONG)]
    df = frame(spark, rows).select("conv_id", "turn", "role", "text")
    got = {}
    for r in repaired_turns(df).orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    fix = lambda r: (r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])
    want = {c: list(plain([fix(r) for r in rows if r[0] == c])[1]) for c in {r[0] for r in rows}}
    assert got == {c: v for c, v in want.items() if v}


def test_empty_and_dropped(spark):
    empty = frame(spark, [(1, 1, "user", "a.")]).limit(0)
    assert repair_report(damaged(empty), empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = frame(spark, [(gone, 0, "user", "a.")])
    row = repair_report(damaged(df), df).first()
    assert (row["conv_id"], row["cost"], row["audit"], row["repaired_sha256"]) == (gone, 0, "", hashlib.sha256().hexdigest())
    null = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert repair_report(damaged(null), null).select(F.max("blank")).first()[0] == expected([(None, None, None, None)])[None]["blank"]
