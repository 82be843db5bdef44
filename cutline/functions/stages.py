"""Stage names of a knockout tournament."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.names import _col, trim_all

# Substrings that decide the stage tests.
MANIFEST_KNOCKOUT_TERMS = (
    "round of 16", "r16", "round-of-16", "quarter", "qf", "semi", "sf", "final",
)
MANIFEST_DENY_TERMS = (
    "group", "league", "round robin", "round-robin", "matchday", "third place", "3rd place",
)
DOWNSTREAM_TERMS = ("round of 16", "quarter", "semi", "final")
FEATURE_KNOCKOUT_TERMS = (
    "round of 16", "r16", "round-of-16", "quarter", "qf", "semi", "sf", "final",
    "3rd place", "third place", "play-off", "playoff", "knockout",
)
FEATURE_DENY_TERMS = ("group", "league", "round robin", "round-robin")
CANONICAL_STAGES = (
    ("round_of_16", ("round of 16", "round-of-16", "r16")),
    ("quarter_final", ("quarter", "qf")),
    ("semi_final", ("semi", "sf")),
    ("final", ("final",)),
    ("third_place", ("3rd place", "third place", "3rd-place", "third-place")),
)


def _any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return text.rlike("|".join(terms))


def _lowered(stage: Column | str) -> Column:
    return F.lower(trim_all(F.coalesce(_col(stage), F.lit(""))))


def stage_canonical(stage: Column | str, third_place_first: bool = False) -> Column:
    """One of the five canonical stages, else a slug.

    With ``third_place_first`` a "third-place final" is labelled ``third_place`` instead of
    ``final``; the default keeps the ladder order.
    """
    text = _lowered(stage)
    ladder = list(CANONICAL_STAGES)
    if third_place_first:
        ladder = ladder[-1:] + ladder[:-1]
    expr = F.when(F.coalesce(_col(stage), F.lit("")) == "", F.lit("unknown"))
    for name, terms in ladder:
        expr = expr.when(_any_of(text, terms), F.lit(name))
    return expr.otherwise(F.translate(text, " -", "__"))


def is_knockout_stage(stage: Column | str) -> Column:
    """Manifest test: deny terms first, then allow terms."""
    text = _lowered(stage)
    return ~_any_of(text, MANIFEST_DENY_TERMS) & _any_of(text, MANIFEST_KNOCKOUT_TERMS)


def has_downstream_bracket(stage: Column | str, third_place_first: bool = False) -> Column:
    """The winner goes on to a later round.

    ``third_place_first`` decides on the canonical stage, so that R16/QF/SF abbreviations count
    and a third-place final does not.
    """
    if third_place_first:
        return stage_canonical(stage, True).isin(
            "round_of_16", "quarter_final", "semi_final", "final"
        )
    return _any_of(_lowered(stage), DOWNSTREAM_TERMS)


def is_knockout_match(stage: Column | str) -> Column:
    """Feature test: its own lists, play-offs and third-place matches included."""
    text = F.lower(F.coalesce(_col(stage), F.lit("")))
    return ~_any_of(text, FEATURE_DENY_TERMS) & _any_of(text, FEATURE_KNOCKOUT_TERMS)


def stage_one_hot(canonical: Column | str) -> dict[str, Column]:
    c = _col(canonical)
    return {
        f"is_{name}": F.coalesce(c == name, F.lit(False)).cast("int")
        for name in ("round_of_16", "quarter_final", "semi_final", "final")
    }


def reference_team(home: Column | str, away: Column | str) -> Column:
    return F.least(_col(home), _col(away))


def reference_side(home: Column | str, away: Column | str) -> Column:
    return F.when(_col(home) <= _col(away), "source_home").otherwise("source_away")


def synth_match_id(tournament: Column | str, kickoff: Column | str, home, away) -> Column:
    name = F.regexp_replace(F.lower(_col(tournament)), r"[^a-z0-9]+", "_")
    name = F.regexp_replace(name, r"^_+|_+$", "")
    return F.concat_ws("_", name, F.date_format(_col(kickoff), "yyyyMMdd"), _col(home), _col(away))
