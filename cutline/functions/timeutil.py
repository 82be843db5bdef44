"""UTC coercion and cut-off checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.names import _col, trim_all

DAY = 86400


def to_utc(c: Column | str) -> Column:
    """ISO 8601 text to timestamp; ``Z``/offset honoured, naive text is UTC, bad text is null."""
    text = trim_all(c)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def require_utc(c: Column | str) -> Column:
    """Like :func:`to_utc` but a value that cannot be read fails the job."""
    parsed = to_utc(c)
    bad = _col(c).isNotNull() & parsed.isNull()
    return F.when(
        bad, F.raise_error(F.concat(F.lit("Invalid ISO 8601 timestamp: "), _col(c))).cast("timestamp")
    ).otherwise(parsed)


def cutoff_before(cutoff: Column | str, kickoff: Column | str) -> Column:
    return _col(cutoff) < _col(kickoff)


def observed_before(observed: Column | str, cutoff: Column | str) -> Column:
    return _col(observed) < _col(cutoff)


def require_before(earlier: Column | str, later: Column | str, label: str) -> Column:
    """Null when ``earlier < later``, otherwise the job fails: a guard column."""
    return F.assert_true(_col(earlier) < _col(later), F.lit(f"{label}: must be strictly before"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days, microsecond exact."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(DAY * 1_000_000.0)


def epoch_days(c: Column | str) -> Column:
    return F.unix_micros(_col(c)) / F.lit(DAY * 1_000_000.0)


def hours_before(c: Column | str, hours: float) -> Column:
    seconds = int(hours * 3600)
    return _col(c) - F.expr(f"INTERVAL '{seconds}' SECOND")
