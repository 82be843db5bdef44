"""Label, manifest and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.operators import aliases as A
from cutline.operators import labels as L
from cutline.operators import manifest as M
from cutline.operators import quality as Q

REGISTRY = Registry()
query = REGISTRY.query

RAW = """raw AS (
  SELECT d.match_id, kickoff_at, home_team_id, away_team_id, stage, competition_id, season_or_year,
    home_goals_90 AS home_goals, away_goals_90 AS away_goals,
    CASE match_id % 7 WHEN 0 THEN home_team_id WHEN 1 THEN away_team_id END AS advancing_team_id FROM duels d)"""


def raw_matches(v):
    k = F.col("match_id") % 7
    return v.duels.select(
        "match_id", "kickoff_at", "home_team_id", "away_team_id", "stage", "competition_id", "season_or_year",
        F.col("home_goals_90").alias("home_goals"), F.col("away_goals_90").alias("away_goals"),
        F.when(k == 0, F.col("home_team_id")).when(k == 1, F.col("away_team_id")).alias("advancing_team_id"),
    )


RESULTS = RAW + """,
res AS (
  SELECT match_id, 'final' AS final_status, home_goals AS home_goals_90, away_goals AS away_goals_90,
    coalesce(advancing_team_id, CASE WHEN home_goals > away_goals THEN home_team_id WHEN home_goals < away_goals THEN away_team_id END) = home_team_id AS home_advances,
    kickoff_at AS result_verified_at FROM raw WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL)"""


@query("match_results", f"WITH {RESULTS} SELECT * FROM res WHERE home_advances IS NOT NULL", ("duels",))
def match_results(v):
    return L.match_results(raw_matches(v))


# shootouts: two rows for some drawn matches, one incomplete; names with accents and case changes
SHOOT = """shoot AS (
  SELECT strftime(kickoff_at, '%Y-%m-%d') AS date, ' ' || upper(home_team_id) AS home_team, replace(away_team_id, '_', '-') AS away_team,
    CASE WHEN match_id % 10 = 4 THEN '' WHEN (match_id + n) % 3 = 0 THEN away_team_id ELSE home_team_id END AS winner, match_id * 10 + n AS ordinal
  FROM duels, (VALUES (0), (1)) t(n) WHERE match_id % 4 <> 1 AND (n = 0 OR match_id % 8 = 0)),
so AS (SELECT date, lower(trim(home_team)) AS h, replace(away_team, '-', '_') AS a, arg_max(winner, ordinal) AS winner FROM shoot WHERE winner <> '' GROUP BY ALL)"""


def shootouts(v):
    k = F.col("match_id")
    return v.duels.filter(k % 4 != 1).select(
        "*", F.explode(F.when(k % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")
    ).select(
        F.date_format("kickoff_at", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit(" "), F.upper("home_team_id")).alias("home_team"),
        F.replace("away_team_id", F.lit("_"), F.lit("-")).alias("away_team"),
        F.when(k % 10 == 4, "").when((k + F.col("n")) % 3 == 0, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("winner"),
        (k * 10 + F.col("n")).alias("ordinal"),
    )



@query(
    "results_with_shootouts",
    f"""WITH {SHOOT} SELECT match_id, home_goals_90, away_goals_90,
      CASE WHEN home_goals_90 <> away_goals_90 THEN home_goals_90 > away_goals_90 ELSE winner = home_team_id END AS home_advances, kickoff_at AS result_verified_at
    FROM duels LEFT JOIN so ON so.date = strftime(kickoff_at, '%Y-%m-%d') AND so.h = home_team_id AND so.a = away_team_id
    WHERE home_goals_90 IS NOT NULL AND away_goals_90 IS NOT NULL AND (home_goals_90 <> away_goals_90 OR winner IS NOT NULL)""",
    ("duels",),
)
def results_with_shootouts(v):
    results = v.duels.select(
        "match_id", "kickoff_at", F.date_format("kickoff_at", "yyyy-MM-dd").alias("raw_date"),
        F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team"), "home_team_id",
        F.col("home_goals_90").alias("home_goals"), F.col("away_goals_90").alias("away_goals"),
    )
    return L.results_with_shootouts(results, shootouts(v), A.builtin_registry(v.spark))


@query(
    "unmatched_shootouts",
    f"""WITH {SHOOT} SELECT s.date, s.home_team, s.away_team, winner, ordinal FROM shoot s WHERE NOT EXISTS (
      SELECT 1 FROM duels WHERE match_id % 3 = 0 AND strftime(kickoff_at, '%Y-%m-%d') = s.date AND ' ' || upper(home_team_id) = s.home_team AND replace(away_team_id, '_', '-') = s.away_team)""",
    ("duels",),
)
def unmatched_shootouts(v):
    some = v.duels.filter(F.col("match_id") % 3 == 0).select(
        F.date_format("kickoff_at", "yyyy-MM-dd").alias("date"), F.concat(F.lit(" "), F.upper("home_team_id")).alias("home_team"),
        F.replace("away_team_id", F.lit("_"), F.lit("-")).alias("away_team"),
    )
    return L.unmatched_shootouts(shootouts(v), some)


# extra time, penalties and explicit winners derived from the order
SCORES = """sc AS (
  SELECT match_id, kickoff_at, home_team_id, away_team_id, stage, competition_id, season_or_year, home_goals_90 AS h, away_goals_90 AS a,
    CASE WHEN match_id % 11 = 3 THEN '1' WHEN match_id % 11 = 5 THEN ' 2 ' WHEN match_id % 11 = 7 THEN 'x' END AS winner,
    CASE WHEN match_id % 4 = 2 THEN home_goals_90 + match_id % 2 END AS eh, CASE WHEN match_id % 4 = 2 THEN away_goals_90 + (match_id // 4) % 3 END AS ea,
    CASE WHEN match_id % 3 = 0 THEN 3 + match_id % 3 END AS ph, CASE WHEN match_id % 3 = 0 THEN 2 + match_id % 4 END AS pa FROM duels)"""
LADDER = """CASE WHEN h IS NULL OR a IS NULL THEN NULL WHEN trim(winner) = '1' THEN true WHEN trim(winner) = '2' THEN false
  WHEN h <> a THEN h > a WHEN ph IS NOT NULL AND pa IS NOT NULL THEN CASE WHEN ph <> pa THEN ph > pa END
  WHEN eh IS NOT NULL AND ea IS NOT NULL AND (eh <> h OR ea <> a) AND eh <> ea THEN eh > ea END"""


def scores(v):
    k = F.col("match_id")
    return v.duels.select(
        "match_id", "kickoff_at", "home_team_id", "away_team_id", "stage", "competition_id", "season_or_year",
        F.col("home_goals_90").alias("home_goals"), F.col("away_goals_90").alias("away_goals"),
        F.when(k % 11 == 3, "1").when(k % 11 == 5, " 2 ").when(k % 11 == 7, "x").alias("winner"),
        F.when(k % 4 == 2, F.col("home_goals_90") + k % 2).alias("home_goals_et"),
        F.when(k % 4 == 2, F.col("away_goals_90") + F.floor(k / 4) % 3).alias("away_goals_et"),
        F.when(k % 3 == 0, 3 + k % 3).alias("penalties_home"),
        F.when(k % 3 == 0, 2 + k % 4).alias("penalties_away"),
    )


@query(
    "derive_advancer",
    f"""WITH {SCORES} SELECT match_id, {LADDER} AS home_advances, CASE WHEN ({LADDER}) IS NOT NULL THEN NULL WHEN h IS NULL OR a IS NULL THEN 'missing_scores'
      WHEN ph IS NOT NULL AND pa IS NOT NULL THEN 'tied_penalties' WHEN eh IS NOT NULL AND ea IS NOT NULL AND (eh <> h OR ea <> a) THEN 'tied_extra_time'
      ELSE 'drawn_without_advancer' END AS reason FROM sc""",
    ("duels",),
)
def derive_advancer(v):
    return scores(v).select("match_id", L.advancer().alias("home_advances"), L.advancer_reason().alias("reason"))


KO = """NOT regexp_matches(lower(stage), 'group|league|round robin|round-robin|matchday|third place|3rd place')
  AND regexp_matches(lower(stage), 'round of 16|r16|round-of-16|quarter|qf|semi|sf|final')"""
DOWN = "regexp_matches(lower(stage), 'round of 16|quarter|semi|final')"
RECON = "CASE WHEN ph IS NOT NULL AND pa IS NOT NULL THEN CASE WHEN ph <> pa THEN ph > pa END WHEN trim(winner) = '1' THEN true WHEN trim(winner) = '2' THEN false WHEN h <> a THEN h > a END"


@query(
    "reconcile_tournament",
    f"""WITH {SCORES}, r AS (SELECT *, {RECON} AS label FROM sc WHERE h IS NOT NULL AND a IS NOT NULL),
    e AS (SELECT *, CASE WHEN NOT ({KO}) THEN 'not_knockout_stage' WHEN NOT {DOWN} THEN 'third_place_no_downstream_bracket'
      WHEN label IS NULL AND NOT (ph IS NOT NULL AND pa IS NOT NULL) THEN 'no_advancer_on_draw' END AS exclusion FROM r)
    SELECT match_id, exclusion, CASE WHEN exclusion IS NULL THEN label END AS home_wins_tie FROM e""",
    ("duels",),
)
def reconcile_tournament(v):
    return M.reconcile_tournament(scores(v)).select("match_id", "exclusion", "home_wins_tie")


CROSS = f"""{SCORES}, {SHOOT.replace("WHERE winner <> ''", "")},
det AS (
  SELECT match_id, CASE WHEN so.date IS NULL THEN 'no_shootout_row' WHEN so.winner = CASE WHEN ph > pa THEN home_team_id ELSE away_team_id END THEN 'agree' ELSE 'disagree' END AS outcome
  FROM sc LEFT JOIN so ON so.date = strftime(kickoff_at, '%Y-%m-%d') AND so.h = home_team_id AND so.a = away_team_id
  WHERE sc.h = sc.a AND ph IS NOT NULL AND pa IS NOT NULL)"""


def _cross(v):
    m = scores(v).withColumns({
        "date": F.date_format("kickoff_at", "yyyy-MM-dd"), "home_team": F.upper("home_team_id"), "away_team": F.upper("away_team_id"),
    })
    s = shootouts(v).withColumn("away_team", F.replace("away_team", F.lit("-"), F.lit("_")))
    return L.penalty_cross_check(m, s)


@query("penalty_cross_check", f"WITH {CROSS} SELECT match_id, outcome FROM det", ("duels",))
def penalty_cross_check(v):
    return _cross(v).select("match_id", "outcome")


@query(
    "penalty_cross_summary",
    f"""WITH {CROSS} SELECT count(*) FILTER (outcome <> 'no_shootout_row') AS n_compared, count(*) FILTER (outcome = 'agree') AS n_agree,
      count(*) FILTER (outcome = 'disagree') AS n_disagree, count(*) FILTER (outcome = 'no_shootout_row') AS n_missing FROM det""",
    ("duels",),
)
def penalty_cross_summary(v):
    return L.cross_check_summary(_cross(v))


# -- manifest --------------------------------------------------------------------------------
# three overlapping providers: all matches, a re-export with gaps, and one with unknown teams

FIX = """fx AS (
  SELECT p AS provider_rank, 'provider_' || p AS provider, match_id * 3 + p AS ordinal, match_id, kickoff_at, competition_id, 'World Cup ' || season_or_year AS tournament,
    stage, season_or_year, CASE WHEN p = 2 AND match_id % 9 = 0 THEN 'unknown' ELSE home_team_id END AS home_team_id, away_team_id
  FROM duels, (VALUES (0), (1), (2)) t(p) WHERE p = 0 OR (p = 1 AND match_id % 2 = 0) OR (p = 2 AND match_id % 3 = 0)),
rs AS (
  SELECT 'provider_' || p AS provider, match_id, home_goals_90, away_goals_90, home_advances FROM duels, (VALUES (0), (1), (2)) t(p)
  WHERE NOT (p = 0 AND match_id % 5 = 1)),
cand AS (
  SELECT fx.*, home_goals_90, away_goals_90, home_advances, rs.match_id IS NOT NULL AS found FROM fx LEFT JOIN rs USING (provider, match_id) WHERE """ + KO + """),
st AS (
  SELECT *, CASE WHEN NOT """ + DOWN + """ THEN 'third_place_no_downstream_bracket' WHEN home_team_id = 'unknown' OR away_team_id = 'unknown' THEN 'unknown_team' END AS early,
    CASE WHEN NOT found THEN 'missing_result' WHEN home_goals_90 IS NULL OR away_goals_90 IS NULL THEN 'missing_scores'
      WHEN home_goals_90 = away_goals_90 AND home_advances IS NULL THEN 'no_advancer_on_draw' END AS late FROM cand),
win AS (
  SELECT kickoff_at, home_team_id, away_team_id, min((provider_rank, ordinal)) AS w FROM st WHERE early IS NULL AND late IS NULL GROUP BY ALL),
cl AS (
  SELECT st.*, CASE WHEN early IS NULL AND (provider_rank, ordinal) > w THEN 'duplicate_across_providers' ELSE coalesce(early, late) END AS reason
  FROM st LEFT JOIN win USING (kickoff_at, home_team_id, away_team_id))"""


def classified(v):
    k = F.col("match_id")
    d = v.duels.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = F.col("p")
    keep = (p == 0) | ((p == 1) & (k % 2 == 0)) | ((p == 2) & (k % 3 == 0))
    name = F.concat(F.lit("provider_"), p.cast("string"))
    fixtures = d.filter(keep).select(
        p.alias("provider_rank"), name.alias("provider"), (k * 3 + p).alias("ordinal"), "match_id", "kickoff_at", "competition_id",
        F.concat(F.lit("World Cup "), F.col("season_or_year")).alias("tournament"), "stage", "season_or_year",
        F.when((p == 2) & (k % 9 == 0), "unknown").otherwise(F.col("home_team_id")).alias("home_team_id"), "away_team_id",
    )
    results = d.filter(~((p == 0) & (k % 5 == 1))).select(
        name.alias("provider"), "match_id", (k * 3 + p).alias("ordinal"), "home_goals_90", "away_goals_90", "home_advances"
    )
    return M.classify_fixtures(fixtures, results)


@query("classify_fixtures", f"WITH {FIX} SELECT provider, match_id, reason FROM cl", ("duels",))
def classify_fixtures(v):
    return classified(v).select("provider", "match_id", "reason")


MAN = FIX + """,
man AS (
  SELECT lower(replace(tournament, ' ', '_')) || '_' || strftime(kickoff_at, '%Y%m%d') || '_' || home_team_id || '_' || away_team_id AS match_id, kickoff_at, tournament AS competition_name,
    home_team_id, away_team_id, home_goals_90, away_goals_90, coalesce(home_advances, false) AS home_wins_tie, provider AS source FROM cl WHERE reason IS NULL)"""


@query("build_manifest", f"WITH {MAN} SELECT * FROM man", ("duels",))
def build_manifest(v):
    return M.accepted(classified(v)).drop("competition_id", "stage", "stage_canonical", "season_or_year")


@query(
    "manifest_quarantine",
    f"WITH {FIX} SELECT match_id AS raw_match_id, reason, kickoff_at, home_team_id, away_team_id, stage, tournament AS tournament_name FROM cl WHERE reason IS NOT NULL AND reason <> 'third_place_no_downstream_bracket'",
    ("duels",),
)
def manifest_quarantine(v):
    return M.excluded(classified(v))


@query(
    "manifest_third_place",
    f"WITH {FIX} SELECT match_id AS raw_match_id, reason, kickoff_at, home_team_id, away_team_id, stage, tournament AS tournament_name FROM cl WHERE reason = 'third_place_no_downstream_bracket'",
    ("duels",),
)
def manifest_third_place(v):
    return M.excluded(classified(v), third_place=True)


@query("tournament_coverage", f"WITH {MAN} SELECT competition_name, count(*) AS found FROM man GROUP BY 1", ("duels",))
def tournament_coverage(v):
    return M.tournament_coverage(M.accepted(classified(v)))


EXPECT = """ex AS (SELECT 'World Cup ' || (1995 + range) AS competition_name, CAST(1000 + range AS INTEGER) AS expected FROM range(10) WHERE range <> 3)"""


@query(
    "expected_vs_found",
    f"""WITH {MAN}, {EXPECT}, cov AS (SELECT competition_name, count(*) AS found FROM man GROUP BY 1)
    SELECT coalesce(c.competition_name, e.competition_name) AS competition_name, expected, coalesce(found, 0) AS found,
      expected IS NULL OR (found IS NOT NULL AND found = expected) AS passes, coalesce(found, 0) - expected AS delta
    FROM cov c FULL JOIN ex e ON e.competition_name = c.competition_name""",
    ("duels",),
)
def expected_vs_found(v):
    expected = v.spark.range(10).filter("id <> 3").select(
        F.concat(F.lit("World Cup "), (1995 + F.col("id")).cast("string")).alias("competition_name"),
        (1000 + F.col("id")).cast("int").alias("expected"),
    )
    return M.expected_vs_found(M.tournament_coverage(M.accepted(classified(v))), expected)


@query(
    "duplicate_keys",
    f"WITH {FIX} SELECT kickoff_at, home_team_id, away_team_id, count(*) AS n FROM fx GROUP BY ALL HAVING count(*) > 1",
    ("duels",),
)
def duplicate_keys(v):
    k = F.col("match_id")
    d = v.duels.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = F.col("p")
    rows = d.filter((p == 0) | ((p == 1) & (k % 2 == 0)) | ((p == 2) & (k % 3 == 0)))
    return M.duplicate_keys(rows.withColumn("home_team_id", F.when((p == 2) & (k % 9 == 0), "unknown").otherwise(F.col("home_team_id"))))


# -- gate ------------------------------------------------------------------------------------

GATE = f"""{MAN}, {SHOOT},
dup AS (SELECT 1 FROM man GROUP BY kickoff_at, home_team_id, away_team_id HAVING count(*) > 1),
unm AS (SELECT 1 FROM shoot s WHERE NOT EXISTS (SELECT 1 FROM duels WHERE strftime(kickoff_at, '%Y-%m-%d') = s.date AND home_team_id = s.home_team AND away_team_id = s.away_team)),
checks AS (
  SELECT 'manifest:no_duplicates' AS "check", (SELECT count(*) FROM dup) AS n_bad, 0 AS lim, ' duplicate keys' AS txt
  UNION ALL SELECT 'manifest:advancement_label_is_bool', (SELECT count(*) FROM man WHERE home_wins_tie IS NULL), 0, ' ambiguous labels'
  UNION ALL SELECT 'aliases:unresolved_under_threshold', (SELECT count(*) FROM duels), 1000000000000, ' unresolved names'
  UNION ALL SELECT 'shootouts:all_matched', (SELECT count(*) FROM unm), 0, ' unmatched shootout rows'
  UNION ALL SELECT 'no_post_cutoff_records:duels', (SELECT count(*) FROM duels WHERE kickoff_at > TIMESTAMP '2001-01-01'), 0, ' future-dated rows')"""


def gate_checks(v):
    man = M.accepted(classified(v))
    m = v.duels.select(
        F.date_format("kickoff_at", "yyyy-MM-dd").alias("date"), F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team")
    )
    queue = A.unresolved_names(v.duels, "home_team_id", A.builtin_registry(v.spark), "duels")
    return Q.data_gate(
        man, queue, shootouts(v), m, {"duels": (v.duels, "kickoff_at")},
        now=F.to_timestamp(F.lit("2001-01-01")), unresolved_threshold=1000000000000,
    )


@query(
    "data_gate",
    f"""WITH {GATE} SELECT "check", n_bad <= lim AS ok, 'error' AS level, n_bad, CASE WHEN n_bad > lim THEN n_bad || txt ELSE '' END AS detail FROM checks""",
    ("duels",),
)
def data_gate(v):
    return gate_checks(v)


@query(
    "gate_verdict",
    f"WITH {GATE} SELECT count(*) FILTER (n_bad > lim) = 0 AS passed, count(*) AS n_checks, count(*) FILTER (n_bad > lim) AS n_failed FROM checks",
    ("duels",),
)
def gate_verdict(v):
    return Q.gate_verdict(gate_checks(v))


@query(
    "content_integrity",
    """SELECT 'doc_' || doc_id AS path, doc_id % 10 NOT IN (0, 1) AS ok, CASE doc_id % 10 WHEN 0 THEN 'file missing' WHEN 1 THEN 'hash differs' ELSE '' END AS detail
    FROM documents""",
)
def content_integrity(v):
    """Recorded SHA-256 of whole contents against the actual ones."""
    d = v.table("documents").withColumn("path", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    files = d.filter(F.col("doc_id") % 10 != 0).select("path", F.col("text").cast("binary").alias("content"))
    recorded = d.select(
        "path", F.when(F.col("doc_id") % 10 == 1, F.lit("0")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("raw_sha256")
    )
    return Q.content_integrity(Q.content_hashes(files), recorded)


@query(
    "provider_isolation",
    """WITH p AS (SELECT match_id, home_goals_90 AS home_goals, away_goals_90 AS away_goals, match_id % 7 = 3 AS torn FROM duels)
    SELECT 'whole' AS provider, 'read' AS reason, count(*) AS n, CAST(sum(home_goals) AS BIGINT) AS home_goals FROM p
    UNION ALL SELECT 'broken', 'provider_fetch_failed', 1, NULL
    UNION ALL SELECT 'torn', 'read', count(*), CAST(sum(home_goals) AS BIGINT) FROM p WHERE NOT torn
    UNION ALL SELECT 'torn', 'document_unparsable', count(*), NULL FROM p WHERE torn""",
    ("duels",),
)
def provider_isolation(v):
    """Three providers of the same matches: one fails while its last rows are read, one has torn documents."""
    from cutline.operators import manifest as X

    json = F.to_json(F.struct("match_id", F.col("home_goals_90").alias("home_goals"), F.col("away_goals_90").alias("away_goals")))
    docs = v.duels.select("match_id", json.alias("raw"))
    fails = F.when(F.col("match_id") % 11 == 5, F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("raw"))
    torn = F.when(F.col("match_id") % 7 == 3, F.expr("substring(raw, 1, length(raw) - 4)")).otherwise(F.col("raw"))
    rows, failures = X.stored_providers(
        [("whole", lambda: docs.select("raw")), ("broken", lambda: docs.select(fails.alias("raw"))), ("torn", lambda: docs.select(torn.alias("raw")))], v.spark
    )
    read, bad = X.parsed_documents(rows, "match_id long, home_goals long, away_goals long")
    none = F.lit(None).cast("long").alias("home_goals")
    count = F.count("*").alias("n")
    return (
        read.groupBy("provider").agg(count, F.sum("home_goals").alias("home_goals")).select("provider", F.lit("read").alias("reason"), "n", "home_goals")
        .unionByName(bad.unionByName(failures, allowMissingColumns=True).groupBy("provider", "reason").agg(count).withColumn("home_goals", none))
    )


@query(
    "file_hashes",
    """SELECT o_orderkey % 8 AS part, sha256(string_agg(o_orderkey || '|' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS actual_sha256 FROM orders GROUP BY 1""",
)
def file_hashes(v):
    """Hashes of written files, read in pieces of 4 KB."""
    import uuid

    from cutline.operators import quality as Q
    from cutline.session import checkpoint_dir

    path = f"{checkpoint_dir(v.spark)}/files-{uuid.uuid4().hex}"
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value")
    rows = v.table("orders").select("o_orderkey", line, (F.col("o_orderkey") % 8).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("value", "part").write.partitionBy("part").text(path)
    names = v.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path")
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part")
    return Q.file_hashes(names, 4096).select(part, "actual_sha256")
