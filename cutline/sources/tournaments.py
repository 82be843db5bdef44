"""Tournament documents in two JSON layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.names import canonical_key, is_blank, slug, trim_all
from cutline.functions.timeutil import to_utc
from cutline.operators.aliases import resolve_teams
from cutline.operators.labels import advancer

# Fields that may be a number, a text or an object are read as text and looked into afterwards.
_MATCH = (
    "struct<`key`:string,`round`:string,`date`:string,`team1`:string,`team2`:string,"
    "`score1`:string,`score2`:string,`score1et`:string,`score2et`:string,`score1pen`:string,"
    "`score2pen`:string,`winner`:string,`type`:string,`ground`:string,"
    "`score`:struct<`ft`:array<string>,`et`:array<string>,`pen`:array<string>,`p`:array<string>>>"
)
DOCUMENT_SCHEMA = (
    f"`name` string, `rounds` array<struct<`name`:string,`matches`:array<{_MATCH}>>>, "
    f"`matches` array<{_MATCH}>"
)
ID_PREFIX = "OF_"


def parse_documents(docs: DataFrame, doc: str = "value", name: str | None = None) -> DataFrame:
    """One row per match of either layout with its round name.

    ``name`` overrides the document's own tournament name with a column of ``docs``.
    """
    own = F.nullif(trim_all("d.name"), F.lit(""))
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    entry = lambda name, m: F.struct(known(name).alias("round_name"), m.alias("m"))
    empty = F.array().cast(f"array<struct<round_name:string,m:{_MATCH}>>")
    nested = F.flatten(F.transform("d.rounds", lambda r: F.coalesce(
        F.transform(r["matches"], lambda m: entry(r["name"], m)), empty)))
    flat = F.transform("d.matches", lambda m: entry(m["round"], m))
    parsed = docs.select("*", F.from_json(F.col(doc), DOCUMENT_SCHEMA).alias("d"))
    # both layouts in one array, so that a document is parsed once
    both = F.concat(F.coalesce(nested, empty), F.coalesce(flat, empty))
    rows = parsed.select((F.coalesce(F.col(name), own) if name else own).alias("tournament"), F.explode(both).alias("e"))
    return rows.select("tournament", "e.*").filter(F.col("m").isNotNull())


def team_name(c: str) -> Column:
    """Team given as text or as an object with ``name``."""
    raw = F.col(c)
    is_object = F.startswith(F.ltrim(raw), F.lit("{"))
    return trim_all(F.when(is_object, F.get_json_object(raw, "$.name")).otherwise(raw))


def score_int(c: Column) -> Column:
    """Whole number from a number or text; booleans and the rest are null."""
    return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))


def _pair(flat: tuple[str, str], *nested: str) -> tuple[Column, Column]:
    """Both sides from the flat fields, else from the first nested array with two entries."""
    h, a = score_int(F.col(f"m.{flat[0]}")), score_int(F.col(f"m.{flat[1]}"))
    both = h.isNotNull() & a.isNotNull()
    eh, ea = F.when(both, h), F.when(both, a)
    for array in nested:
        arr = F.col(f"m.score.{array}")
        long = F.size(arr) >= 2
        eh = eh.when(long, score_int(F.get(arr, F.lit(0))))
        ea = ea.when(long, score_int(F.get(arr, F.lit(1))))
    return eh, ea


def extract_scores(matches: DataFrame) -> DataFrame:
    """Add full-time, extra-time and penalty goals and the winner field."""
    fh, fa = score_int(F.col("m.score1")), score_int(F.col("m.score2"))
    ft = F.col("m.score.ft")
    nh, na = score_int(F.get(ft, F.lit(0))), score_int(F.get(ft, F.lit(1)))
    use_flat = fh.isNotNull() & fa.isNotNull()
    use_nested = ~use_flat & (F.size(ft) >= 2) & (nh.isNotNull() | na.isNotNull())
    eh, ea = _pair(("score1et", "score2et"), "et")
    ph, pa = _pair(("score1pen", "score2pen"), "pen", "p")
    return matches.withColumns({
        "home_goals": F.when(use_nested, nh).otherwise(fh),
        "away_goals": F.when(use_nested, na).otherwise(fa),
        "home_goals_et": eh,
        "away_goals_et": ea,
        "penalties_home": ph,
        "penalties_away": pa,
        "winner": F.col("m.winner"),
    })


def parse_tournaments(matches: DataFrame, registry: DataFrame, source: str = "tournaments") -> tuple[DataFrame, DataFrame]:
    """(matches with scores and label, quarantine) from :func:`parse_documents` rows.

    Venues are neutral. The id is the document's key, else date and both team keys.
    """
    df = extract_scores(matches).withColumns({
        "_kick": to_utc("m.date"), "home_team": team_name("m.team1"), "away_team": team_name("m.team2"),
    })
    reason = (
        F.when(is_blank("m.date"), "missing_date")
        .when(F.col("_kick").isNull(), "invalid_date")
        .when(is_blank("home_team") | is_blank("away_team"), "missing_team")
        .when(is_blank("tournament"), "missing_tournament_name")
    )
    marked = df.withColumn("reason", reason)
    good = resolve_teams(
        marked.filter(F.col("reason").isNull()), {"home_team": "home_team_id", "away_team": "away_team_id"}, registry, keys=True
    )
    under = lambda key: F.replace(key, F.lit(" "), F.lit("_"))
    composed = F.concat_ws("_", F.date_format("_kick", "yyyyMMdd"), under(F.col("home_team_id_key")), under(F.col("away_team_id_key")))
    ident = F.when(is_blank(trim_all("m.key")), composed).otherwise(under(canonical_key("m.key")))
    winner = F.when(F.col("home_goals") > F.col("away_goals"), F.col("home_team_id")).when(
        F.col("home_goals") < F.col("away_goals"), F.col("away_team_id")
    )
    out = good.withColumn("home_advances", advancer()).select(
        F.concat(F.lit(ID_PREFIX), ident).alias("match_id"),
        F.col("_kick").alias("kickoff_at"),
        "tournament",
        slug("tournament").alias("competition_id"),
        F.col("round_name").alias("stage"),
        F.year("_kick").cast("string").alias("season_or_year"),
        "home_team",
        "away_team",
        "home_team_id",
        "away_team_id",
        "home_goals",
        "away_goals",
        "home_goals_et",
        "away_goals_et",
        "penalties_home",
        "penalties_away",
        "winner",
        winner.alias("winner_team_id"),
        "home_advances",
        F.lit(True).alias("neutral_venue"),
        F.col("m.ground").alias("venue_name"),
        F.lit(source).alias("source"),
    )
    bad = marked.filter(F.col("reason").isNotNull()).select(
        "tournament", F.col("round_name").alias("stage"), F.to_json("m").alias("raw"), "reason"
    )
    return out, bad


def tournament_teams(matches: DataFrame) -> DataFrame:
    """Distinct names of teams given as objects; plain texts do not count."""
    raw = matches.select(F.explode(F.array("m.team1", "m.team2")).alias("t"))
    named = raw.filter(F.startswith(F.ltrim("t"), F.lit("{"))).select(
        trim_all(F.get_json_object("t", "$.name")).alias("team_name")
    )
    return named.filter(~is_blank("team_name")).distinct()


def read_tournament_json(spark: SparkSession, path: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_tournaments(parse_documents(spark.read.text(path, wholetext=True)), registry)
