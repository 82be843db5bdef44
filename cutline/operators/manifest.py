"""Labelled knockout manifest with a reason for every excluded row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.stages import (
    has_downstream_bracket,
    is_knockout_stage,
    stage_canonical,
    synth_match_id,
)
from cutline.operators.labels import advancer
from cutline.operators.skew import pick_row
from cutline.plans.store import materialize

EXPECTED_PER_EDITION = 15
THIRD_PLACE = "third_place_no_downstream_bracket"


def classify_fixtures(
    fixtures: DataFrame,
    results: DataFrame,
    *,
    third_place_first: bool = False,
) -> DataFrame:
    """Every knockout row with ``reason`` (null = accepted).

    ``fixtures``: provider, provider_rank, ordinal, match_id, kickoff_at, competition_id,
    tournament, stage, season_or_year, home_team_id, away_team_id (resolved ids).
    ``results``: provider, match_id, ordinal, home_goals_90, away_goals_90, home_advances.

    A row fails on its own first; the first valid row of (kickoff, home, away) by provider and
    position is accepted, and everything after it with that key is a duplicate. A row that fails
    its own checks does not claim the key. Nothing is grouped behind the join with the winners, so a key with many rows needs no salt:
    adaptive execution splits it.
    """
    stage = F.trim(F.coalesce(F.col("stage"), F.lit("")))
    if third_place_first:
        deny = ~F.lower(stage).rlike("group|league|round robin|round-robin|matchday")
        canonical = stage_canonical(stage, True)
        knockout = deny & canonical.isin("round_of_16", "quarter_final", "semi_final", "final", "third_place")
    else:
        knockout = is_knockout_stage(stage)
    last = pick_row(results, ["provider", "match_id"], [F.col("ordinal")]).drop("ordinal").withColumn(
        "_found", F.lit(True)
    )
    rows = (
        fixtures.withColumn("stage", stage)
        .filter(knockout)
        .withColumn("stage_canonical", stage_canonical("stage", third_place_first))
        .join(last, ["provider", "match_id"], "left")
    )
    hg, ag = F.col("home_goals_90"), F.col("away_goals_90")
    before_dup = F.when(~has_downstream_bracket("stage", third_place_first), THIRD_PLACE).when(
        (F.col("home_team_id") == "unknown") | (F.col("away_team_id") == "unknown"), "unknown_team"
    )
    after_dup = (
        F.when(F.col("_found").isNull(), "missing_result")
        .when(hg.isNull() | ag.isNull(), "missing_scores")
        .when((hg == ag) & F.col("home_advances").isNull(), "no_advancer_on_draw")
    )
    pos = F.struct("provider_rank", "ordinal")
    marked = rows.withColumns({"_early": before_dup, "_late": after_dup, "_pos": pos})
    key = ["kickoff_at", "home_team_id", "away_team_id"]
    winners = marked.filter(F.col("_early").isNull() & F.col("_late").isNull()).groupBy(*key).agg(
        F.min("_pos").alias("_winner")
    )
    duplicate = F.col("_early").isNull() & (F.col("_pos") > F.col("_winner"))
    return (
        marked.join(winners, key, "left")
        .withColumn(
            "reason",
            F.when(duplicate, "duplicate_across_providers").otherwise(F.coalesce("_early", "_late")),
        )
        .drop("_early", "_late", "_pos", "_winner", "_found")
    )


def accepted(classified: DataFrame) -> DataFrame:
    """Manifest rows; ``home_wins_tie`` is the label."""
    return classified.filter(F.col("reason").isNull()).select(
        synth_match_id("tournament", "kickoff_at", "home_team_id", "away_team_id").alias("match_id"),
        "kickoff_at",
        "competition_id",
        F.col("tournament").alias("competition_name"),
        "stage",
        "stage_canonical",
        "season_or_year",
        "home_team_id",
        "away_team_id",
        "home_goals_90",
        "away_goals_90",
        F.coalesce("home_advances", F.lit(False)).alias("home_wins_tie"),
        F.col("provider").alias("source"),
    )


def excluded(classified: DataFrame, third_place: bool = False) -> DataFrame:
    """Quarantine rows, or with ``third_place`` the separate third-place bucket."""
    bucket = F.col("reason") == THIRD_PLACE
    return classified.filter(F.col("reason").isNotNull() & (bucket if third_place else ~bucket)).select(
        F.col("match_id").alias("raw_match_id"),
        "reason",
        "kickoff_at",
        "home_team_id",
        "away_team_id",
        "stage",
        F.col("tournament").alias("tournament_name"),
    )


def tournament_coverage(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("competition_name").agg(F.count(F.lit(1)).alias("found"))


def expected_vs_found(coverage: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Found against expected counts; a tournament without an expectation passes.

    Without ``expected`` every found tournament is expected to have 15 ties.
    """
    if expected is None:
        expected = coverage.select("competition_name", F.lit(EXPECTED_PER_EDITION).alias("expected"))
    found = F.coalesce("found", F.lit(0))
    return coverage.join(expected, "competition_name", "full_outer").select(
        "competition_name",
        "expected",
        found.cast("long").alias("found"),
        (F.col("expected").isNull() | (F.col("found").isNotNull() & (found == F.col("expected")))).alias("passes"),
        (found - F.col("expected")).cast("long").alias("delta"),
    )


def duplicate_keys(manifest: DataFrame) -> DataFrame:
    key = ["kickoff_at", "home_team_id", "away_team_id"]
    return manifest.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


FETCH_FAILED, UNPARSABLE = "provider_fetch_failed", "document_unparsable"


def provider_rows(providers: list[tuple[str, object]]) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """Union the tables of all providers; one that fails is reported, the others go on.

    Each provider is a callable returning a DataFrame. Only reading and analysis errors show here;
    rows that cannot be parsed are quarantined by the readers themselves.
    """
    out, failures = None, []
    for rank, (name, fetch) in enumerate(providers):
        try:
            part = fetch().withColumns({"provider": F.lit(name), "provider_rank": F.lit(rank)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        except Exception as exc:  # a provider may fail in any way
            failures.append((name, FETCH_FAILED, str(exc).split("\n", 1)[0]))
    return out, failures


def stored_providers(providers: list[tuple[str, object]], spark: SparkSession) -> tuple[DataFrame | None, DataFrame]:
    """(rows, failures): every provider is read to its end and its rows are written, so that a failure that only shows while rows are read, such
    as an unreadable file, is reported too. Failures are rows (provider, reason, detail); the other providers stay whole.
    """
    out, failures = None, []
    for rank, (name, fetch) in enumerate(providers):
        try:
            part = materialize(fetch(), "provider").withColumns({"provider": F.lit(name), "provider_rank": F.lit(rank)})
        except Exception as exc:  # a provider may fail in any way
            failures.append((name, FETCH_FAILED, str(exc).split("\n", 1)[0]))
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, spark.createDataFrame(failures, "provider string, reason string, detail string")


def parsed_documents(documents: DataFrame, schema: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of JSON documents, one per row: a document that is null, no JSON or of other types goes to quarantine
    with a reason, and the rest of its provider's documents stay."""
    kinds = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    d = documents.withColumn("_d", F.from_json(raw, f"{schema}, _corrupt string", kinds))
    bad = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()
    others = [c for c in documents.columns if c != raw]
    rows = d.where(~bad).select(*others, "_d.*").drop("_corrupt")
    return rows, d.where(bad).select(*others, F.lit(UNPARSABLE).alias("reason"), F.substring(raw, 1, 200).alias("detail"))


def reconcile_tournament(matches: DataFrame) -> DataFrame:
    """Report variant: advancer by penalties, winner, full time; ``exclusion`` names the reason.

    Tied penalties leave the label open without an exclusion.
    """
    pens_known = F.col("penalties_home").isNotNull() & F.col("penalties_away").isNotNull()
    label = advancer(reconcile=True)
    exclusion = (
        F.when(~is_knockout_stage("stage"), "not_knockout_stage")
        .when(~has_downstream_bracket("stage"), THIRD_PLACE)
        .when(label.isNull() & ~pens_known, "no_advancer_on_draw")
    )
    return (
        matches.filter(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
        .withColumns({"stage_canonical": stage_canonical("stage"), "exclusion": exclusion})
        .withColumn("home_wins_tie", F.when(F.col("exclusion").isNull(), label))
    )
