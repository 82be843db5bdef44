"""Alias registry tables and team resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.names import canonical_key, is_blank, slug, slug_of_key
from cutline.operators.skew import pick_row

# The built-in alias table.
BUILTIN_ALIASES = {
    "usa": "united_states",
    "us": "united_states",
    "u.s.a.": "united_states",
    "united states": "united_states",
    "united states of america": "united_states",
    "uk": "england",
    "great britain": "england",
    "britain": "england",
    "south korea": "south_korea",
    "korea republic": "south_korea",
    "korea, south": "south_korea",
    "korea south": "south_korea",
    "korea dpr": "north_korea",
    "north korea": "north_korea",
    "ivory coast": "ivory_coast",
    "cote d'ivoire": "ivory_coast",
    "côte d’ivoire": "ivory_coast",
    "czech republic": "czech_republic",
    "czechia": "czech_republic",
    "russia": "russia",
    "turkey": "turkiye",
    "türkiye": "turkiye",
    "iran": "iran",
    "uae": "united_arab_emirates",
    "u.a.e.": "united_arab_emirates",
    "trinidad": "trinidad_and_tobago",
    "trinidad & tobago": "trinidad_and_tobago",
    "trinidad and tobago": "trinidad_and_tobago",
    "bosnia": "bosnia_and_herzegovina",
    "bosnia-herzegovina": "bosnia_and_herzegovina",
    "bosnia & herzegovina": "bosnia_and_herzegovina",
    "bosnia and herzegovina": "bosnia_and_herzegovina",
    "cabo verde": "cape_verde",
    "cape verde": "cape_verde",
    "eswatini": "eswatini",
    "swaziland": "eswatini",
    "czech": "czech_republic",
    "holland": "netherlands",
    "the netherlands": "netherlands",
    "korea": "south_korea",
    "republic of ireland": "ireland",
    "northern ireland": "northern_ireland",
    "ireland": "ireland",
    "west germany": "germany",
    "east germany": "germany",
    "czechoslovakia": "czech_republic",
    "yugoslavia": "serbia",
    "serbia and montenegro": "serbia",
    "soviet union": "russia",
    "ussr": "russia",
}
# The aliases of the strict resolver, targets as above.
STRICT_ALIASES = (
    "usa", "us", "u.s.a.", "united states", "united states of america", "uk", "great britain",
    "south korea", "korea republic", "korea, south", "ivory coast", "cote d'ivoire",
    "czech republic", "czechia", "russia", "turkey", "türkiye", "iran", "uae", "u.a.e.",
    "trinidad", "trinidad & tobago",
)
BUILTIN_SOURCE = "builtin_default"
SAMPLE_SIZE = 25


def registry_of(aliases: DataFrame) -> DataFrame:
    """(alias, team_id, source, ordinal) rows keyed by canonical key; the last of a key stands."""
    keyed = aliases.withColumn("alias_key", canonical_key("alias"))
    return pick_row(keyed, ["alias_key"], [F.col("ordinal")]).select(
        "alias_key", "alias", "team_id", "source"
    )


def builtin_registry(spark: SparkSession, strict: bool = False) -> DataFrame:
    """The fixed alias dimension (at most 50 rows)."""
    names = STRICT_ALIASES if strict else tuple(BUILTIN_ALIASES)
    rows = [(a, BUILTIN_ALIASES[a], BUILTIN_SOURCE, i) for i, a in enumerate(names)]
    return registry_of(
        spark.createDataFrame(rows, "alias string, team_id string, source string, ordinal int")
    )


def resolve_teams(
    df: DataFrame, names: dict[str, str], registry: DataFrame, unresolved_flags: bool = False, keys: bool = False
) -> DataFrame:
    """Add a team id per name column: ``names`` maps name column -> output column.

    Blank -> ``unknown``; registry hit -> its id; else the slug. The registry can grow, so its
    size decides between broadcast and shuffle: no hint is forced. A name's canonical key is worked out
    once; with ``keys`` it stays as ``{output}_key``.
    """
    out = df
    for name, target in names.items():
        hit = registry.select(
            F.col("alias_key").alias("_k"), F.col("team_id").alias("_t")
        )
        out = out.withColumn("_k", canonical_key(name)).join(hit, "_k", "left")
        known = F.when(is_blank(name), F.lit("unknown")).otherwise(F.coalesce(F.col("_t"), slug_of_key(F.col("_k"))))
        out = out.withColumn(target, known)
        if keys:
            out = out.withColumn(f"{target}_key", F.col("_k"))
        if unresolved_flags:
            out = out.withColumn(f"{target}_unresolved", ~is_blank(name) & F.col("_t").isNull())
        out = out.drop("_k", "_t")
    return out


def unresolved_names(df: DataFrame, name: str, registry: DataFrame, source: Column | str) -> DataFrame:
    """Queue rows: every occurrence of a non-blank name without a registry entry."""
    hit = registry.select(F.col("alias_key").alias("_k"))
    src = F.lit(source) if isinstance(source, str) else source
    return (
        df.filter(~is_blank(name))
        .withColumn("_k", canonical_key(name))
        .join(hit, "_k", "left_anti")
        .select(F.col(name).alias("raw_name"), src.alias("source"))
    )


def resolve_strict(
    df: DataFrame, name: str, registry: DataFrame, *, out: str = "team_id", quarantine: bool = True
) -> DataFrame:
    """Strict variant: a slug that is a known target counts as resolved.

    Adds ``out`` and ``{out}_queued``. Without ``quarantine`` an empty name fails the job and
    nothing is queued.
    """
    key = canonical_key(name)
    hits = registry.select(F.col("alias_key").alias("_k"), slug("team_id").alias("_t"))
    targets = registry.select(slug("team_id").alias("_s")).distinct().withColumn("_target", F.lit(True))
    j = (
        df.withColumn("_k", key)
        .withColumn("_s", F.replace(F.col("_k"), F.lit(" "), F.lit("_")))
        .join(hits, "_k", "left")
        .join(targets, "_s", "left")
    )
    empty = F.col("_k").isNull() | (F.col("_k") == "")
    if quarantine:
        unknown = F.lit("unknown")
        queued = empty | (F.col("_t").isNull() & F.col("_target").isNull())
    else:
        unknown = F.raise_error(F.concat(F.lit("Empty team name: "), F.coalesce(F.col(name), F.lit("null")))).cast("string")
        queued = F.lit(False)
    return (
        j.withColumn(out, F.when(empty, unknown).otherwise(F.coalesce("_t", "_s")))
        .withColumn(f"{out}_queued", queued)
        .drop("_k", "_s", "_t", "_target")
    )


def seed_aliases(registry: DataFrame, observed: DataFrame, name: str, source: str) -> DataFrame:
    """New registry rows for observed names whose key is absent; first spelling (by text) stands."""
    fresh = (
        observed.filter(~is_blank(name))
        .select(canonical_key(name).alias("alias_key"), F.col(name).alias("alias"))
        .groupBy("alias_key")
        .agg(F.min("alias").alias("alias"))
        .join(registry.select("alias_key"), "alias_key", "left_anti")
    )
    return fresh.withColumn("team_id", slug("alias")).withColumn("source", F.lit(source))


def add_alias(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert explicit (alias, team_id, source, ordinal) rows.

    Returns the new registry and the rows that changed it; an unchanged mapping is left alone.
    """
    new = registry_of(changes)
    old = registry.select("alias_key", F.col("team_id").alias("_old"))
    changed = new.join(old, "alias_key", "left").filter(
        ~F.col("team_id").eqNullSafe(F.col("_old"))
    ).drop("_old")
    merged = registry.join(changed.select("alias_key"), "alias_key", "left_anti").unionByName(changed)
    return merged, changed


def classify_aliases(observed: DataFrame, name: str, registry: DataFrame, builtin: DataFrame) -> DataFrame:
    """Occurrence counts: built-in, curated, unresolved."""
    r = registry.select(F.col("alias_key").alias("_k"), (F.col("source") == BUILTIN_SOURCE).alias("_builtin"))
    b = builtin.select(F.col("alias_key").alias("_k"), F.lit(True).alias("_default"))
    j = (
        observed.filter(~is_blank(name))
        .withColumn("_k", canonical_key(name))
        .join(r, "_k", "left")
        .join(b, "_k", "left")
    )
    hit = F.col("_builtin").isNotNull()
    default = (hit & F.col("_builtin")) | (~hit & F.col("_default").isNotNull())
    return j.agg(
        F.count_if(default).alias("resolved_default"),
        F.count_if(hit & ~F.col("_builtin")).alias("resolved_curated"),
        F.count_if(~hit & F.col("_default").isNull()).alias("unresolved"),
    )


def unresolved_sample(queue: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """The report's sample: the first ``n`` queued names in name order, occurrences kept."""
    return queue.select("raw_name").orderBy("raw_name").limit(n)


def observed_names(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct trimmed raw names per source: {source: (table, name columns)}."""
    from cutline.functions.names import trim_all

    parts = [
        df.select(F.lit(source).alias("source"), F.explode(F.array(*[trim_all(c) for c in cols])).alias("raw_name"))
        for source, (df, cols) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(~is_blank("raw_name")).distinct()


def distinct_teams(matches: DataFrame, home: str = "home_team_id", away: str = "away_team_id") -> DataFrame:
    """Distinct non-null ids of both sides."""
    both = matches.select(F.explode(F.array(home, away)).alias("team_id"))
    return both.filter(F.col("team_id").isNotNull()).distinct()
