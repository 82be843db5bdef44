from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import aliases as A
from cutline.operators import labels as L
from cutline.operators import manifest as M
from cutline.operators import quality as Q

FIX = (
    "provider string, provider_rank int, ordinal int, match_id string, kickoff_at timestamp, competition_id string, tournament string, "
    "stage string, season_or_year string, home_team_id string, away_team_id string"
)
RES = "provider string, match_id string, ordinal int, home_goals_90 int, away_goals_90 int, home_advances boolean"


def fixture(mid, stage="Final", provider="p0", rank=0, ordinal=0, home="a", away="b", day="2022-12-18"):
    return (provider, rank, ordinal, mid, day, "wc", "World Cup 2022", stage, "2022", home, away)


@pytest.fixture
def reasons(table):
    def run(fixtures, results, **kw):
        c = M.classify_fixtures(table(fixtures, FIX), table(results, RES), **kw)
        return {(r["provider"], r["match_id"]): r["reason"] for r in c.collect()}

    return run


def test_each_reason(reasons):
    got = reasons(
        [
            fixture("ok", home="a"), fixture("group", stage="Group A", home="c"), fixture("third", stage="R16", home="d"),
            fixture("unknown", home="unknown"), fixture("nores", home="e"), fixture("noscore", home="f"), fixture("draw", home="g"),
        ],
        [
            ("p0", "ok", 0, 1, 0, True), ("p0", "noscore", 0, None, 1, True), ("p0", "draw", 0, 1, 1, None),
            ("p0", "unknown", 0, 1, 0, True), ("p0", "third", 0, 1, 0, True),
        ],
    )
    assert got == {
        ("p0", "ok"): None, ("p0", "third"): "third_place_no_downstream_bracket", ("p0", "unknown"): "unknown_team",
        ("p0", "nores"): "missing_result", ("p0", "noscore"): "missing_scores", ("p0", "draw"): "no_advancer_on_draw",
    }


def test_first_accepted_provider_wins_and_a_failed_row_does_not_claim_the_key(reasons):
    got = reasons(
        [fixture("x"), fixture("y", provider="p1", rank=1), fixture("z", provider="p2", rank=2)],
        [("p1", "y", 0, 2, 1, True), ("p2", "z", 0, 2, 1, True)],
    )
    assert got == {("p0", "x"): "missing_result", ("p1", "y"): None, ("p2", "z"): "duplicate_across_providers"}


def test_last_result_of_a_match_stands(reasons):
    got = reasons([fixture("x")], [("p0", "x", 1, None, None, None), ("p0", "x", 0, 1, 0, True)])
    assert got == {("p0", "x"): "missing_scores"}


def test_a_hot_key_of_copies_keeps_one_row(spark):
    copies = spark.range(3000).select(
        F.lit("p0").alias("provider"), F.lit(0).alias("provider_rank"), F.col("id").alias("ordinal"),
        F.col("id").cast("string").alias("match_id"), F.to_timestamp(F.lit("2022-12-18")).alias("kickoff_at"), F.lit("wc").alias("competition_id"),
        F.lit("WC").alias("tournament"), F.lit("Final").alias("stage"), F.lit("2022").alias("season_or_year"),
        F.lit("a").alias("home_team_id"), F.lit("b").alias("away_team_id"),
    )
    results = copies.select("provider", "match_id", "ordinal", F.lit(1).alias("home_goals_90"), F.lit(0).alias("away_goals_90"), F.lit(True).alias("home_advances"))
    c = M.classify_fixtures(copies, results)
    assert {r["reason"]: r["count"] for r in c.groupBy("reason").count().collect()} == {None: 1, "duplicate_across_providers": 2999}
    assert c.filter(F.col("reason").isNull()).first()["ordinal"] == 0


def test_coverage_adds_up_and_absent_expectation_passes(table):
    c = M.classify_fixtures(
        table([fixture("x"), fixture("y", home="c"), fixture("z", home="d", stage="Semi-finals")], FIX),
        table([("p0", m, 0, 1, 0, True) for m in "xyz"], RES),
    )
    man = M.accepted(c)
    cov = M.tournament_coverage(man)
    assert cov.agg(F.sum("found")).first()[0] == man.count() == 3
    default = M.expected_vs_found(cov).first()
    assert (default["expected"], default["passes"], default["delta"]) == (15, False, -12)
    exp = table([("Other", 4)], "competition_name string, expected int")
    got = {r["competition_name"]: (r["found"], r["passes"], r["delta"]) for r in M.expected_vs_found(cov, exp).collect()}
    assert got == {"World Cup 2022": (3, True, None), "Other": (0, False, -4)}
    assert man.filter("home_team_id = 'a'").first()["match_id"] == "world_cup_2022_20221218_a_b"


def test_broken_provider_is_isolated(table):
    good = lambda: table([fixture("x")], FIX).drop("provider", "provider_rank")

    def broken():
        raise RuntimeError("no network")

    df, failures = M.provider_rows([("bad", broken), ("good", good)])
    assert failures == [("bad", "provider_fetch_failed", "no network")]
    assert [(r["provider"], r["provider_rank"]) for r in df.collect()] == [("good", 1)]


SCORES = (
    "id string, home_goals int, away_goals int, home_goals_et int, away_goals_et int, penalties_home int, penalties_away int, winner string"
)


@pytest.mark.parametrize(("row", "label", "reason"), [
    (("winner", 0, 0, None, None, None, None, "2"), False, None),
    (("ft", 1, 2, None, None, None, None, None), False, None),
    (("pens", 3, 3, 3, 3, 4, 2, None), True, None),
    (("et", 1, 1, 2, 1, None, None, None), True, None),
    (("et same", 1, 1, 1, 1, None, None, None), None, "drawn_without_advancer"),
    (("et tied", 1, 1, 2, 2, None, None, None), None, "tied_extra_time"),
    (("pens tied", 1, 1, None, None, 3, 3, None), None, "tied_penalties"),
    (("none", None, 1, None, None, None, None, "1"), None, "missing_scores"),
])
def test_advancer_ladder(table, row, label, reason):
    r = table([row], SCORES).select(L.advancer().alias("a"), L.advancer_reason().alias("r")).first()
    assert (r["a"], r["r"]) == (label, reason)


def test_reconcile_ladder_prefers_penalties(table):
    df = table([("x", 1, 1, None, None, 2, 4, "1")], SCORES)
    assert df.select(L.advancer(), L.advancer(reconcile=True)).first()[0:2] == (True, False)


@pytest.mark.parametrize(("teams", "ft", "pens", "winner"), [
    (("brazil", "belgium"), (1, 2), None, "belgium"), (("netherlands", "argentina"), (0, 0), (2, 4), "argentina"),
    (("croatia", "brazil"), (0, 0), (4, 2), "croatia"), (("argentina", "france"), (2, 2), (4, 2), "argentina"),
])
def test_golden_labels(table, teams, ft, pens, winner):
    p = pens or (None, None)
    df = table([("g", *ft, None, None, *p, None)], SCORES)
    home = df.select(L.advancer()).first()[0]
    assert (teams[0] if home else teams[1]) == winner


def test_shootout_join(table, spark):
    reg = A.builtin_registry(spark)
    res = table(
        [("m1", "2022-01-01", "2022-01-01", "USA", "Côte d’Ivoire", "united_states", 1, 1), ("m2", "2022-01-02", "2022-01-02", "A", "B", "a", 0, 0),
         ("m3", "2022-01-03", "2022-01-03", "A", "B", "a", 2, 0), ("m4", "2022-01-04", "2022-01-04", "A", "B", "a", None, 0)],
        "match_id string, kickoff_at timestamp, raw_date string, home_team string, away_team string, home_team_id string, home_goals int, away_goals int",
    )
    so = table(
        [("2022-01-01", "usa", "cote d'ivoire", "Ivory Coast", 0), ("2022-01-01", "U.S.A.", "Cote d’Ivoire", "us", 1), ("2022-01-02", "A", "B", "", 2)],
        "date string, home_team string, away_team string, winner string, ordinal int",
    )
    got = {r["match_id"]: r["home_advances"] for r in L.results_with_shootouts(res, so, reg).collect()}
    assert got == {"m1": True, "m3": True}


def test_match_results_rules(table):
    df = table(
        [("draw", "2022-01-01", "a", "b", 1, 1, None), ("adv", "2022-01-01", "a", "b", 1, 1, "b"), ("win", "2022-01-01", "a", "b", 2, 1, None),
         ("future", "2022-01-01", "a", "b", None, None, "a")],
        "match_id string, kickoff_at timestamp, home_team_id string, away_team_id string, home_goals int, away_goals int, advancing_team_id string",
    )
    assert {r["match_id"]: r["home_advances"] for r in L.match_results(df).collect()} == {"adv": False, "win": True}


def test_alias_registry(spark, table):
    reg = A.builtin_registry(spark)
    names = table([("USA",), ("Atlantis",), ("Atlantis",), ("",), (None,), ("Türkiye",)], "name string")
    r = A.resolve_teams(names, {"name": "t"}, reg, True).collect()
    assert sorted(str(x["t"]) for x in r) == ["atlantis", "atlantis", "turkiye", "united_states", "unknown", "unknown"]
    queue = A.unresolved_names(names, "name", reg, "s")
    assert queue.count() == 2
    seeded = A.seed_aliases(reg, names, "name", "s")
    assert [(x["alias"], x["team_id"]) for x in seeded.collect()] == [("Atlantis", "atlantis")]
    assert A.seed_aliases(reg.unionByName(seeded), names, "name", "s").count() == 0
    same, changed = A.add_alias(reg, table([("usa", "united_states", "m", 0), ("USA ", "america", "m", 1)], "alias string, team_id string, source string, ordinal int"))
    assert [x["team_id"] for x in changed.collect()] == ["america"] and same.count() == reg.count()


def test_strict_resolver_raises_on_empty_only_without_quarantine(spark, table):
    reg = A.builtin_registry(spark, strict=True)
    df = table([("south_korea",), ("Nowhere",), ("??",)], "name string")
    got = {r["name"]: (r["team_id"], r["team_id_queued"]) for r in A.resolve_strict(df, "name", reg).collect()}
    assert got == {"south_korea": ("south_korea", False), "Nowhere": ("nowhere", True), "??": ("unknown", True)}
    with pytest.raises(Exception, match="Empty team name"):
        A.resolve_strict(df, "name", reg, quarantine=False).collect()


def test_gate_fails_and_raises_when_strict(table):
    man = table([("m", "2022-01-01", "a", "b", True), ("n", "2022-01-01", "a", "b", None)], "match_id string, kickoff_at timestamp, home_team_id string, away_team_id string, home_wins_tie boolean")
    text = table([("2022-01-01", "a", "b")], "date string, home_team string, away_team string")
    checks = Q.data_gate(man, text.limit(0), text, text, {"m": (man, "kickoff_at")})
    failed = {r["check"]: r["detail"] for r in checks.collect() if not r["ok"]}
    assert failed == {"manifest:no_duplicates": "1 duplicate keys", "manifest:advancement_label_is_bool": "1 ambiguous labels"}
    assert Q.gate_verdict(checks).first().asDict() == {"passed": False, "n_checks": 5, "n_failed": 2}
    with pytest.raises(Exception, match="data gate failed"):
        Q.gate_verdict(checks, strict=True).collect()


def test_a_provider_that_fails_while_it_is_read_leaves_the_others_whole(spark):
    from cutline.operators import manifest as X

    docs = spark.createDataFrame([(1, '{"m": 1, "g": 2}'), (2, '{"m": 2, "g"'), (3, None), (4, '{"m": "x"}'), (5, "{}"), (6, '{"m": 6, "g": 0, "more": 1}')], "id int, raw string")
    late = docs.withColumn("raw", F.when(F.col("id") == 6, F.raise_error(F.lit("torn file")).cast("string")).otherwise(F.col("raw")))

    def absent():
        return spark.read.parquet("/no/such/provider")

    rows, failures = X.stored_providers([("a", lambda: docs), ("late", lambda: late), ("absent", absent), ("b", lambda: docs.limit(1))], spark)
    assert sorted((r["provider"], r["reason"]) for r in failures.collect()) == [("absent", "provider_fetch_failed"), ("late", "provider_fetch_failed")]
    good, bad = X.parsed_documents(rows, "m long, g long")
    assert sorted((r["provider"], r["id"], r["m"], r["g"]) for r in good.collect() if r["id"] != 5) == [("a", 1, 1, 2), ("a", 6, 6, 0), ("b", 1, 1, 2)]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(2, "document_unparsable"), (3, "document_unparsable"), (4, "document_unparsable")]


def test_no_provider_at_all(spark):
    from cutline.operators import manifest as X

    rows, failures = X.stored_providers([], spark)
    assert rows is None and failures.count() == 0


def test_files_are_hashed_in_pieces(spark, tmp_path):
    import hashlib

    from cutline.operators.quality import content_integrity, file_hashes

    data = {"empty": b"", "small": b"abc", "large": bytes(range(256)) * 5000, "even": b"x" * 4096}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in [*data, "gone"]], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["actual_sha256"] for r in file_hashes(paths, 1024).collect()}
    assert got == {n: hashlib.sha256(b).hexdigest() for n, b in data.items()} | {"gone": None}
    recorded = paths.withColumn("raw_sha256", F.lit(hashlib.sha256(b"abc").hexdigest()))
    ok = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["detail"]) for r in content_integrity(file_hashes(paths, 1024), recorded).collect()}
    assert ok["small"] == (True, "") and ok["gone"] == (False, "file missing") and ok["large"][1] == "hash differs"
