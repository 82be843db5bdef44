"""Secrets in texts: three fixed patterns, and strings that a battery of randomness tests calls random (operator 7).

Native throughout: only column expressions and grouped counts.

A candidate is a run of 20 or more letters, digits and ``+ / _ -`` with a letter and a digit. From its characters an
encoding is inferred (hex, base 32, base 36, base 64), and over that alphabet three tests ask whether it could be uniform noise:
chi-squared of the character counts, Wald-Wolfowitz runs of lower and upper half, and serial correlation at lag one, put
together by Fisher's method. A candidate that noise explains is still not a discovery: ordinary words of that length might look so.
The chi-squared value is therefore also held against what ordinary text of the same length gives (a larger, length-dependent mean),
and Benjamini-Hochberg bounds the share of false discoveries within each class of length and encoding, over the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import fresh, stored

# Fixed patterns: name, pattern, group whose length counts, least length.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run that is too short holds no shorter run that is long enough, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
MASK = "[secret]"

#: Encodings by the characters a string holds: name, pattern, alphabet, chance that two characters of ordinary text are equal.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 0.1),
    ("hex", "^[0-9A-F]+$", DIGITS + "ABCDEF", 0.1),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 0.06),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, 0.06),
    ("base36", "^[0-9A-Z]+$", DIGITS + UPPER, 0.06),
    ("base64", "^.*$", UPPER + LOWER + DIGITS + "+/", 0.06),
)
LENGTHS = (24, 32, 48, 64, 128)  # borders of the length classes
FALSE_SHARE = 0.01
NOISE = 1e-4  # combined probability under which noise is ruled out
BINS = 160  # quarter decades of the probability


def _spans(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end>> of the matches; ``value`` names the group that must have ``least`` characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(hits, F.length).alias("hit"),
        F.transform(sizes, F.length).alias("size"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    fold = F.aggregate(
        F.filter(parts, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["hit"]).alias("at"),
            F.when(
                p["size"] >= least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + p["gap"] + p["hit"]).alias("end")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.when(text.rlike(pattern), fold["found"]).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the usual five-term approximation (error under 1e-7, relative in the tail)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _encoding(token: Column) -> Column:
    """struct<code, alphabet, equal> of the first encoding that a string's characters fit."""
    chosen = None
    for code, (_, pattern, alphabet, equal) in enumerate(ENCODINGS):
        this = F.struct(F.lit(code).alias("code"), F.lit(alphabet).alias("alphabet"), F.lit(equal).alias("equal"))
        chosen = F.when(token.rlike(pattern), this) if chosen is None else chosen.when(token.rlike(pattern), this)
    return chosen


def _statistics(token: Column, enc: Column) -> Column:
    """struct<n, k, chi, low, turns, lag> over the inferred alphabet."""
    alphabet = enc["alphabet"]
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    side = F.call_function(
        "translate", token, alphabet, F.concat(F.repeat(F.lit("0"), (k / 2).cast("int")), F.repeat(F.lit("1"), (k - F.floor(k / 2)).cast("int")))
    )
    without = lambda s, part: F.length(F.replace(s, F.lit(part), F.lit(""))).cast("double")
    squares = _sum(F.transform(F.split(alphabet, ""), lambda c: F.when(c == "", 0.0).otherwise(F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))))
    values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))

    def lag(x: Column) -> Column:
        def centred(d: Column) -> Column:
            pairs = F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda a, b: a * b)
            return _sum(pairs) / F.greatest(_sum(F.transform(d, lambda v: v * v)), F.lit(1e-9))

        return _let(_sum(x) / F.size(x), lambda mean: _let(F.transform(x, lambda v: v - mean), centred))

    return _let(side, lambda s: F.struct(
        n.alias("n"), k.alias("k"), (k * squares / n - n).alias("chi"), without(s, "1").alias("low"),
        ((2 * n - without(s, "01") - without(s, "10")) / 2).alias("turns"), _let(values, lag).alias("lag"),
    ))


def _tested(token: Column, start: Column) -> Column:
    """struct<start, end, stratum, p_noise, bin> of one candidate. Base 64 is read in either of its alphabets."""

    def judged(enc: Column, m: Column) -> Column:
        n, chi, df = m["n"], m["chi"], m["k"] - 1
        p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        both = 2 * m["low"] * (n - m["low"])
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.abs(m["turns"] - both / n) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
        p_runs = F.when(spread > 0, 2 * _upper_tail(z_runs)).otherwise(F.lit(0.0))
        p_lag = 2 * _upper_tail(F.abs((m["lag"] + 1 / n) * F.sqrt(n)))
        half = -(F.ln(F.greatest(p_chi, F.lit(1e-15))) + F.ln(F.greatest(p_runs, F.lit(1e-15))) + F.ln(F.greatest(p_lag, F.lit(1e-15))))
        excess = n * (m["k"] * enc["equal"] - 1)
        p_words = _upper_tail(-(chi - df - excess) / F.sqrt(2 * (df + 2 * excess)))
        strip = sum(F.when(n >= b, 1).otherwise(0) for b in LENGTHS)
        return F.struct(
            start.alias("start"), (start + F.length(token)).alias("end"), (enc["code"] * 10 + strip).cast("int").alias("stratum"),
            _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2)).alias("p_noise"),
            F.least(F.lit(BINS - 1), F.floor(-4 * F.log10(F.greatest(p_words, F.lit(1e-300)))).cast("int")).alias("bin"),
        )

    plain = F.translate(token, "-_", "+/")
    return _let(_encoding(token), lambda enc: _let(_statistics(plain, enc), lambda m: judged(enc, m)))


def _candidates(text: Column) -> Column:
    """array of tested candidates with a letter and a digit."""
    spans = _spans(text, CANDIDATE, 3)
    kept = F.filter(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"))),
        lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]"),
    )
    return F.transform(kept, lambda s: _tested(s["token"], s["start"]))


def _base(text: Column) -> Column:
    return F.concat(_spans(text, ASSIGN, 0, 2, LEAST_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def cuts(tested: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per class of length and encoding, from counts by quarter decade of the probability (the upper
    edge of a bin stands for its rows, which errs towards fewer discoveries): class -> least bin that is a discovery.
    The driver sees one count per class and bin, 36 * 160 at most, whatever the table's size."""
    counts = tested.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    by: dict[int, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    out = {}
    for stratum, bins in by.items():
        total, above = sum(bins.values()), 0
        for b in range(BINS - 1, -1, -1):
            above += bins.get(b, 0)
            if bins.get(b, 0) and 10 ** (-b / 4) <= FALSE_SHARE * above / total:
                out[stratum] = b
    return out


def _added(tested: Column, base: Column, cut: dict[int, int]) -> Column:
    """Discoveries that touch no span of the fixed patterns."""
    if not cut:
        return F.array().cast("array<struct<start:int,kind:int,end:int>>")
    least = F.create_map(*[F.lit(x) for pair in sorted(cut.items()) for x in pair])
    found = F.filter(
        tested,
        lambda t: (t["bin"] >= F.coalesce(F.element_at(least, t["stratum"]), F.lit(BINS))) & (t["p_noise"] >= NOISE) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    return F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Positions count code points of the whole text; null and empty texts have no spans. Repeated rows and null ids keep
    a row each; other columns are ignored. One scan of the texts writes spans and test values (no text) to the shared folder;
    the cuts come from counts over all of them. No shuffle but that of the counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _base(text).alias("base"), _candidates(text).alias("tested")), "secrets")
    cut = cuts(scanned)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", _added(F.col("tested"), F.col("base"), cut))).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark (spans that touch count as one) and n_chars counted anew;
    rows without spans are as they were. All rows and columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = cuts(docs.select(_candidates(text).alias("tested")))
    base, tested, spans = (fresh(docs, c) for c in ("_base", "_tested", "_spans"))
    held = docs.withColumn(base, _base(text)).withColumn(tested, _candidates(text))
    held = held.withColumn(spans, F.array_sort(F.concat(base, _added(F.col(tested), F.col(base), cut))))
    fold = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    hit = F.size(spans) > 0
    new = F.when(hit, fold).otherwise(F.col("text"))
    out = held.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
