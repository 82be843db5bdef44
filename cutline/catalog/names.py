"""Name, alias and text-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.bindings import sql_key, sql_slug
from cutline.catalog.registry import Registry
from cutline.functions import names as N
from cutline.functions import rules as R
from cutline.functions import stages as S
from cutline.operators import aliases as A

REGISTRY = Registry()
query = REGISTRY.query


def alias_sql(names=None) -> str:
    rows = ", ".join(
        "('{}', '{}', {})".format(a.replace("'", "''"), A.BUILTIN_ALIASES[a], i)
        for i, a in enumerate(names or A.BUILTIN_ALIASES)
    )
    return f"""reg AS (
  SELECT k AS alias_key, arg_max(team_id, i) AS team_id, arg_max(alias, i) AS alias FROM (
    SELECT {sql_key('alias')} AS k, * FROM (VALUES {rows}) t(alias, team_id, i)) GROUP BY 1)"""


ALIASES, STRICT = alias_sql(), alias_sql(A.STRICT_ALIASES)
KEY, SLUG = sql_key("raw_name"), sql_slug("raw_name")
RESOLVED = f"CASE WHEN raw_name IS NULL OR raw_name = '' THEN 'unknown' ELSE coalesce(r.team_id, {SLUG}) END"


@query("canonical_key", f"SELECT row_id, {KEY} AS key, {SLUG} AS slug FROM raw_names", ("raw_names",))
def canonical_key(v):
    return v.raw_names.select("row_id", N.canonical_key("raw_name").alias("key"), N.slug("raw_name").alias("slug"))


@query(
    "canonical_key_documents",
    f"SELECT doc_id, md5({sql_key('text')}) AS digest, length({sql_key('text')}) AS n FROM documents",
)
def canonical_key_documents(v):
    """Accent folding over whole texts in four languages."""
    key = N.canonical_key("text")
    return v.table("documents").select("doc_id", F.md5(key).alias("digest"), F.length(key).cast("bigint").alias("n"))


@query(
    "builtin_aliases",
    f"""WITH {ALIASES}, k AS (SELECT {KEY} AS alias_key, count(*) AS n FROM raw_names GROUP BY 1)
    SELECT alias_key, team_id, alias, 'builtin_default' AS source, coalesce(n, 0) AS names FROM reg LEFT JOIN k USING (alias_key)""",
    ("raw_names",),
)
def builtin_aliases(v):
    """The fixed aliases, with the names of the table that each one covers."""
    names = v.raw_names.groupBy(N.canonical_key("raw_name").alias("alias_key")).agg(F.count(F.lit(1)).alias("n"))
    return A.builtin_registry(v.spark).join(names, "alias_key", "left").select(
        "alias_key", "team_id", "alias", "source", F.coalesce("n", F.lit(0)).alias("names")
    )


@query(
    "resolve_team",
    f"""WITH {ALIASES} SELECT row_id, {RESOLVED} AS team_id,
      raw_name IS NOT NULL AND raw_name <> '' AND r.team_id IS NULL AS team_id_unresolved
    FROM raw_names LEFT JOIN reg r ON r.alias_key = {KEY}""",
    ("raw_names",),
)
def resolve_team(v):
    return A.resolve_teams(v.raw_names, {"raw_name": "team_id"}, A.builtin_registry(v.spark), True).select(
        "row_id", "team_id", "team_id_unresolved"
    )


@query(
    "resolve_team_strict",
    f"""WITH {STRICT} SELECT row_id,
      CASE WHEN coalesce({KEY}, '') = '' THEN 'unknown' ELSE coalesce(r.team_id, replace({KEY}, ' ', '_')) END AS team_id,
      coalesce({KEY}, '') = '' OR (r.team_id IS NULL AND replace({KEY}, ' ', '_') NOT IN (SELECT team_id FROM reg)) AS team_id_queued
    FROM raw_names LEFT JOIN reg r ON r.alias_key = {KEY}""",
    ("raw_names",),
)
def resolve_team_strict(v):
    return A.resolve_strict(v.raw_names, "raw_name", A.builtin_registry(v.spark, strict=True)).select(
        "row_id", "team_id", "team_id_queued"
    )


@query(
    "unresolved_queue",
    f"""WITH {ALIASES} SELECT raw_name, 'customers' AS source FROM raw_names
    WHERE raw_name <> '' AND {KEY} NOT IN (SELECT alias_key FROM reg)""",
    ("raw_names",),
)
def unresolved_queue(v):
    return A.unresolved_names(v.raw_names, "raw_name", A.builtin_registry(v.spark), "customers")


@query(
    "unresolved_count",
    f"""WITH {ALIASES} SELECT count(*) AS n, count(DISTINCT raw_name) AS n_names FROM raw_names
    WHERE raw_name <> '' AND {KEY} NOT IN (SELECT alias_key FROM reg)""",
    ("raw_names",),
)
def unresolved_count(v):
    q = A.unresolved_names(v.raw_names, "raw_name", A.builtin_registry(v.spark), "customers")
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw_name").alias("n_names"))


@query(
    "unresolved_sample",
    f"""WITH {ALIASES} SELECT raw_name FROM raw_names WHERE raw_name <> '' AND {KEY} NOT IN (SELECT alias_key FROM reg)
    ORDER BY encode(raw_name) LIMIT 25""",
    ("raw_names",),
)
def unresolved_sample(v):
    return A.unresolved_sample(A.unresolved_names(v.raw_names, "raw_name", A.builtin_registry(v.spark), "customers"))


@query(
    "seed_aliases",
    f"""WITH {ALIASES} SELECT {KEY} AS alias_key, min(raw_name) AS alias, {sql_slug('min(raw_name)')} AS team_id, 'observed' AS source
    FROM raw_names WHERE raw_name <> '' AND {KEY} NOT IN (SELECT alias_key FROM reg) GROUP BY 1""",
    ("raw_names",),
)
def seed_aliases(v):
    return A.seed_aliases(A.builtin_registry(v.spark), v.raw_names, "raw_name", "observed")


ADD = f"""WITH {ALIASES}, ch AS (
  SELECT {KEY} AS alias_key, arg_max(raw_name, row_id) AS alias, arg_max(CASE row_id % 2 WHEN 0 THEN 'turkiye' ELSE 'team_' || CAST(row_id % 7 AS VARCHAR) END, row_id) AS team_id
  FROM raw_names WHERE raw_name <> '' GROUP BY 1),
changed AS (SELECT ch.*, 'manual' AS source FROM ch LEFT JOIN reg USING (alias_key) WHERE reg.team_id IS DISTINCT FROM ch.team_id)"""


def _changes(v):
    team = F.when(F.col("row_id") % 2 == 0, "turkiye").otherwise(F.concat(F.lit("team_"), (F.col("row_id") % 7).cast("string")))
    return v.raw_names.filter(~N.is_blank("raw_name")).select(
        F.col("raw_name").alias("alias"), team.alias("team_id"), F.lit("manual").alias("source"), F.col("row_id").alias("ordinal")
    )


@query("add_alias_changes", f"{ADD} SELECT alias_key, alias, team_id, source FROM changed", ("raw_names",))
def add_alias_changes(v):
    return A.add_alias(A.builtin_registry(v.spark), _changes(v))[1]


@query(
    "add_alias_registry",
    f"""{ADD} SELECT alias_key, alias, team_id, source FROM changed UNION ALL
    SELECT alias_key, alias, team_id, 'builtin_default' FROM reg WHERE alias_key NOT IN (SELECT alias_key FROM changed)""",
    ("raw_names",),
)
def add_alias_registry(v):
    return A.add_alias(A.builtin_registry(v.spark), _changes(v))[0]


@query(
    "classify_aliases",
    f"""WITH {ALIASES}, cur AS (SELECT DISTINCT {KEY} AS k FROM raw_names WHERE raw_name <> '' AND row_id % 20 IN (9, 10, 11) AND {KEY} NOT IN (SELECT alias_key FROM reg))
    SELECT count(*) FILTER (k IN (SELECT alias_key FROM reg)) AS resolved_default,
      count(*) FILTER (k IN (SELECT k FROM cur)) AS resolved_curated,
      count(*) FILTER (k NOT IN (SELECT alias_key FROM reg) AND k NOT IN (SELECT k FROM cur)) AS unresolved
    FROM (SELECT {KEY} AS k FROM raw_names WHERE raw_name <> '')""",
    ("raw_names",),
)
def classify_aliases(v):
    builtin = A.builtin_registry(v.spark)
    some = v.raw_names.filter((F.col("row_id") % 20).isin(9, 10, 11))
    curated = A.seed_aliases(builtin, some, "raw_name", "curated")
    return A.classify_aliases(v.raw_names, "raw_name", builtin.unionByName(curated), builtin)


@query(
    "observed_names",
    """SELECT DISTINCT 'customers' AS source, trim(raw_name) AS raw_name FROM raw_names WHERE trim(raw_name) <> ''
    UNION SELECT 'nations', n_name FROM nation UNION SELECT 'matches', home_team_id FROM duels UNION SELECT 'matches', away_team_id FROM duels""",
    ("raw_names", "duels"),
)
def observed_names(v):
    return A.observed_names({
        "customers": (v.raw_names, ["raw_name"]),
        "nations": (v.table("nation"), ["n_name"]),
        "matches": (v.duels, ["home_team_id", "away_team_id"]),
    })


@query("distinct_teams", "SELECT home_team_id AS team_id FROM duels UNION SELECT away_team_id FROM duels", ("duels",))
def distinct_teams(v):
    return A.distinct_teams(v.duels)


# -- stages ----------------------------------------------------------------------------------

CANON = """CASE WHEN {s} LIKE '%round of 16%' OR {s} LIKE '%round-of-16%' OR {s} LIKE '%r16%' THEN 'round_of_16'
  WHEN {s} LIKE '%quarter%' OR {s} LIKE '%qf%' THEN 'quarter_final' WHEN {s} LIKE '%semi%' OR {s} LIKE '%sf%' THEN 'semi_final'
  WHEN {s} LIKE '%final%' THEN 'final' WHEN {s} LIKE '%third place%' OR {s} LIKE '%3rd place%' OR {s} LIKE '%third-place%' OR {s} LIKE '%3rd-place%' THEN 'third_place'
  ELSE replace(replace({s}, ' ', '_'), '-', '_') END""".format(s="lower(stage)")
KO = """NOT regexp_matches(lower(stage), 'group|league|round robin|round-robin|matchday|third place|3rd place')
  AND regexp_matches(lower(stage), 'round of 16|r16|round-of-16|quarter|qf|semi|sf|final')"""
DOWN = "regexp_matches(lower(stage), 'round of 16|quarter|semi|final')"


@query(
    "stage_tests",
    f"""SELECT match_id, {CANON} AS canonical, {KO} AS knockout, {DOWN} AS downstream,
      NOT regexp_matches(lower(stage), 'group|league|round robin|round-robin') AND
      regexp_matches(lower(stage), 'round of 16|r16|round-of-16|quarter|qf|semi|sf|final|3rd place|third place|play-off|playoff|knockout') AS feature_knockout
    FROM duels""",
    ("duels",),
)
def stage_tests(v):
    return v.duels.select(
        "match_id", S.stage_canonical("stage").alias("canonical"), S.is_knockout_stage("stage").alias("knockout"),
        S.has_downstream_bracket("stage").alias("downstream"), S.is_knockout_match("stage").alias("feature_knockout"),
    )


@query(
    "stage_third_place_first",
    f"""SELECT match_id, CASE WHEN lower(stage) LIKE '%third place%' OR lower(stage) LIKE '%third-place%' THEN 'third_place' ELSE {CANON} END AS canonical,
      NOT (lower(stage) LIKE '%third place%' OR lower(stage) LIKE '%third-place%') AND {CANON} IN ('round_of_16', 'quarter_final', 'semi_final', 'final') AS downstream
    FROM duels""",
    ("duels",),
)
def stage_third_place_first(v):
    return v.duels.select(
        "match_id", S.stage_canonical("stage", True).alias("canonical"),
        S.has_downstream_bracket("stage", True).alias("downstream"),
    )


@query(
    "stage_one_hot",
    f"""SELECT match_id, CAST(c = 'round_of_16' AS INTEGER) AS is_round_of_16, CAST(c = 'quarter_final' AS INTEGER) AS is_quarter_final,
      CAST(c = 'semi_final' AS INTEGER) AS is_semi_final, CAST(c = 'final' AS INTEGER) AS is_final FROM (SELECT match_id, {CANON} AS c FROM duels)""",
    ("duels",),
)
def stage_one_hot(v):
    df = v.duels.withColumn("c", S.stage_canonical("stage"))
    return df.select("match_id", *[c.alias(n) for n, c in S.stage_one_hot("c").items()])


@query(
    "reference_side",
    """SELECT match_id, least(home_team_id, away_team_id) AS reference_team,
      CASE WHEN home_team_id <= away_team_id THEN 'source_home' ELSE 'source_away' END AS reference_side,
      lower(replace(competition_id, '-', '_')) AS name FROM duels""",
    ("duels",),
)
def reference_side(v):
    return v.duels.select(
        "match_id", S.reference_team("home_team_id", "away_team_id").alias("reference_team"),
        S.reference_side("home_team_id", "away_team_id").alias("reference_side"),
        F.lower(F.replace("competition_id", F.lit("-"), F.lit("_"))).alias("name"),
    )


@query(
    "synth_match_id",
    """SELECT match_id, trim(regexp_replace(lower('-- World Cup ' || competition_id || '!'), '[^a-z0-9]+', '_', 'g'), '_') || '_' ||
      strftime(kickoff_at, '%Y%m%d') || '_' || home_team_id || '_' || away_team_id AS synth FROM duels""",
    ("duels",),
)
def synth_match_id(v):
    name = F.concat(F.lit("-- World Cup "), F.col("competition_id"), F.lit("!"))
    return v.duels.select(
        "match_id", S.synth_match_id(name, "kickoff_at", "home_team_id", "away_team_id").alias("synth")
    )


# -- text rules ------------------------------------------------------------------------------

@query(
    "role_bucket",
    """SELECT record_id, CASE WHEN lower(role) LIKE '%goalkeeper%' THEN 'goalkeeper' WHEN lower(role) LIKE '%defender%' THEN 'defender'
      WHEN lower(role) LIKE '%midfielder%' THEN 'midfielder' WHEN lower(role) LIKE '%attacker%' THEN 'attacker' END AS bucket FROM availability""",
    ("availability",),
)
def role_bucket(v):
    return v.availability.select("record_id", R.role_bucket("role").alias("bucket"))


AVAIL_TEXT = """CASE WHEN t LIKE '%out%' AND t LIKE '%confirmed%' THEN 'confirmed_out' WHEN t LIKE '%doubt%' THEN 'doubtful'
  WHEN t LIKE '%lineup%' AND t LIKE '%confirmed%' THEN 'lineup_confirmed' ELSE 'available' END"""
SUFFIX = ("", " Confirmed.", " a DOUBT remains", " lineup confirmed", " ruled OUT")
SUFFIX_SQL = "(CASE {k} % 5 WHEN 0 THEN '' WHEN 1 THEN ' Confirmed.' WHEN 2 THEN ' a DOUBT remains' WHEN 3 THEN ' lineup confirmed' ELSE ' ruled OUT' END)"


@query(
    "classify_availability_text",
    f"""SELECT doc_id, {AVAIL_TEXT} AS status, md5(substr(raw, 1, 200)) AS excerpt_digest FROM (
      SELECT doc_id, text || {SUFFIX_SQL.format(k='doc_id')} AS raw, lower(text || {SUFFIX_SQL.format(k='doc_id')}) AS t FROM documents)""",
)
def classify_availability_text(v):
    """The keyword rules over whole texts."""
    from cutline.catalog.bindings import pick

    d = v.table("documents").withColumn("raw", F.concat("text", pick(SUFFIX, F.col("doc_id") % 5)))
    return d.select(
        "doc_id", R.availability_status_of("raw").alias("status"), F.md5(R.excerpt("raw")).alias("excerpt_digest")
    )


@query(
    "classify_conversation_text",
    f"SELECT conv_id, turn, {AVAIL_TEXT} AS status FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)",
)
def classify_conversation_text(v):
    return v.table("conversations").select("conv_id", "turn", R.availability_status_of("text").alias("status"))


@query(
    "published_before",
    """SELECT event_id, coalesce(obs < TIMESTAMP '2024-01-15', false) AS valid, CASE WHEN obs IS NULL THEN 'Missing observed_at' END AS warning
    FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS obs FROM events)""",
)
def published_before(v):
    e = v.table("events").withColumn("obs", F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp")))
    cut = F.to_timestamp(F.lit("2024-01-15"))
    return e.select("event_id", R.published_before(F.col("obs"), cut).alias("valid"), R.timestamp_warning("obs").alias("warning"))


@query(
    "source_reliability",
    """SELECT page_id, CASE WHEN regexp_matches(u, 'reuters|apnews|bbc|uefa\\.com|fifa\\.com') THEN 0.9::DOUBLE
      WHEN regexp_matches(u, 'twitter|x\\.com|reddit') THEN 0.3 ELSE 0.5 END AS score, u <> '' AS success
    FROM (SELECT page_id, lower(CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://www.BBC.co.uk/' || url WHEN 2 THEN replace(url, 'example', 'fifa')
      WHEN 3 THEN replace(url, 'example.com', 'x.com') WHEN 4 THEN '' ELSE 'https://reddit.com?u=' || url END) AS u FROM pages)""",
)
def source_reliability(v):
    k = F.col("page_id") % 6
    url = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("https://www.BBC.co.uk/"), F.col("url")))
        .when(k == 2, F.replace("url", F.lit("example"), F.lit("fifa")))
        .when(k == 3, F.replace("url", F.lit("example.com"), F.lit("x.com")))
        .when(k == 4, F.lit(""))
        .otherwise(F.concat(F.lit("https://reddit.com?u="), F.col("url")))
    )
    return v.table("pages").withColumn("u", url).select(
        "page_id", R.source_reliability("u").alias("score"), R.source_scored("u").alias("success")
    )
