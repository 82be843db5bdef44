"""Team-name normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accent_fold() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition, marks dropped, is one ASCII letter/digit."""
    src, dst = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"
        )
        if len(base) == 1 and base.isascii() and base.isalnum():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    """Letters without their accents; a text of as many bytes as characters has none and is left alone."""
    src, dst = _accent_fold()
    return F.when(F.octet_length(_col(c)) == F.char_length(_col(c)), _col(c)).otherwise(F.translate(_col(c), src, dst))


_BLANKS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())


def trim_all(c: Column | str) -> Column:
    """Trim any Unicode white space, not only the space character."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def canonical_key(c: Column | str) -> Column:
    """Lookup key: lower case, no accents, runs of blank/hyphen/underscore as one space."""
    text = strip_accents(F.lower(trim_all(c)))
    text = F.regexp_replace(text, r"(?U)[\s\-_]+", " ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9 ]", ""))


def slug(c: Column | str) -> Column:
    """Canonical key with underscores; ``unknown`` when nothing is left."""
    return slug_of_key(canonical_key(c))


def slug_of_key(key: Column) -> Column:
    """The slug that belongs to a canonical key."""
    return F.when(key == "", F.lit("unknown")).otherwise(F.replace(key, F.lit(" "), F.lit("_")))


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | (_col(c) == "")
