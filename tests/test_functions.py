from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cutline.functions import names, probability as P, rules, stages, timeutil
from cutline.functions.hashing import stable_hash


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


@pytest.mark.parametrize(("raw", "key"), [
    ("  Côte  d'Ivoire ", "cote divoire"), ("Korea--Republic", "korea republic"), ("São_Tomé", "sao tome"),
    ("İstanbul", "istanbul"), ("!!!", ""), ("U.S.A.", "usa"), ("Łódź", "odz"), ("Ångström FC", "angstrom fc"),
])
def test_canonical_key(spark, raw, key):
    assert one(spark, k=names.canonical_key(F.lit(raw)))["k"] == key


def test_slug_of_nothing_is_unknown(spark):
    assert one(spark, k=names.slug(F.lit("?")))["k"] == "unknown"


@pytest.mark.parametrize(("text", "want"), [
    ("2022-12-18T15:00:00Z", "2022-12-18 15:00:00"), ("2022-12-18T17:00:00+02:00", "2022-12-18 15:00:00"),
    ("2022-12-18", "2022-12-18 00:00:00"), ("2022-12-18 15:00", "2022-12-18 15:00:00"), ("18/12/2022", None), ("", None),
])
def test_to_utc(spark, text, want):
    got = one(spark, t=F.date_format(timeutil.to_utc(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))["t"]
    assert got == want


def test_bad_time_can_fail_the_job(spark):
    with pytest.raises(Exception, match="Invalid ISO 8601"):
        spark.range(1).select(timeutil.require_utc(F.lit("soon")).alias("t")).collect()


def test_cutoff_guard_is_strict(spark):
    a, b = F.to_timestamp(F.lit("2020-01-01")), F.to_timestamp(F.lit("2020-01-02"))
    assert spark.range(1).select(timeutil.require_before(a, b, "m1")).collect()
    with pytest.raises(Exception, match="m1: must be strictly before"):
        spark.range(1).select(timeutil.require_before(a, a, "m1")).collect()


@pytest.mark.parametrize(("stage", "canonical", "knockout", "downstream"), [
    ("Round of 16", "round_of_16", True, True), ("Quarter-finals", "quarter_final", True, True),
    ("SF", "semi_final", True, False), ("Final", "final", True, True), ("Match for third place", "third_place", False, False),
    ("Third-place final", "final", True, True), ("Group A", "group_a", False, False), ("", "unknown", False, False),
    (None, "unknown", False, False), ("Matchday 3", "matchday_3", False, False),
])
def test_stages(spark, stage, canonical, knockout, downstream):
    s = F.lit(stage).cast("string")
    got = one(spark, c=stages.stage_canonical(s), k=stages.is_knockout_stage(s), d=stages.has_downstream_bracket(s))
    assert got == {"c": canonical, "k": knockout, "d": downstream}


def test_third_place_first_option(spark):
    s = F.lit("Third-place final")
    got = one(spark, c=stages.stage_canonical(s, True), d=stages.has_downstream_bracket(s, True))
    assert got == {"c": "third_place", "d": False}


def test_odds_and_ratings(spark):
    got = one(
        spark, imp=P.implied_probability(2.0), bad=P.implied_probability(1.0), h=P.de_vig_home(1.5, 3.0),
        even=P.expected_score(1500, 1500), gap=P.expected_score(1700, 1500), k_lo=P.k_factor(0.1), k_hi=P.k_factor(9),
        mov=P.mov_multiplier(3, 0), none=P.mov_multiplier(F.lit(None).cast("int"), 1),
    )
    assert got["imp"] == 0.5 and got["bad"] is None
    assert got["h"] == pytest.approx(2 / 3)
    assert got["even"] == 0.5 and got["gap"] == pytest.approx(0.7597, abs=1e-4)
    assert (got["k_lo"], got["k_hi"], got["mov"], got["none"]) == (5.0, 40.0, 3.0, 1.0)


def test_advance_rules_are_complementary(spark):
    for p in (0.1, 0.5, 0.83):
        a = one(spark, x=P.advance_probability(F.lit(p)), y=P.advance_probability(F.lit(1 - p)))
        assert a["x"] + a["y"] == pytest.approx(1.0, abs=1e-15) and a["x"] == pytest.approx(p)
    assert one(spark, x=P.advance_probability(F.lit(0.2), "no_draw_assume_extra_time"))["x"] == 0.5


@pytest.mark.parametrize(("p", "band"), [
    (0.62, "clear_lean"), (0.38, "clear_lean"), (0.619, "slight_lean"), (0.55, "slight_lean"), (0.449, "slight_lean"),
    (0.5, "near_coin_flip"), (1.2, None), (-0.1, None), (float("nan"), None),
])
def test_confidence_band(spark, p, band):
    assert one(spark, b=P.confidence_band(F.lit(p)))["b"] == band


def test_decay_clip_logit(spark):
    got = one(
        spark, half=P.decay(180.0, 180.0), flat=P.decay(50.0, 0), future=P.decay(-1.0, 365.0, True), c=P.clip(F.lit(1.5)),
        l=P.logit(F.lit(0.75)),
    )
    assert got["half"] == pytest.approx(0.5) and got["flat"] == 1.0 and got["future"] == 0.0
    assert got["c"] == 1 - 1e-6 and got["l"] == pytest.approx(math.log(3))


def test_wilson(spark):
    low, high = P.wilson_interval(F.lit(3), F.lit(4))
    got = one(spark, a=low, b=high, c=P.wilson_interval(F.lit(0), F.lit(0))[0])
    assert got["a"] == pytest.approx(0.3006, abs=1e-3) and got["b"] == pytest.approx(0.9544, abs=1e-3) and got["c"] is None


def test_text_rules(spark):
    got = one(
        spark, a=rules.availability_status_of(F.lit("Confirmed: he is OUT")), b=rules.availability_status_of(F.lit("a doubt")),
        c=rules.availability_status_of(F.lit("confirmed lineup")), d=rules.availability_status_of(F.lit("fit")),
        r=rules.role_bucket(F.lit("Left Midfielder")), n=rules.role_bucket(F.lit("coach")),
        s=rules.source_reliability(F.lit("https://www.BBC.co.uk")), x=rules.source_reliability(F.lit("https://x.com/a")),
        e=rules.source_scored(F.lit("")),
    )
    assert got == {
        "a": "confirmed_out", "b": "doubtful", "c": "lineup_confirmed", "d": "available", "r": "midfielder", "n": None,
        "s": 0.9, "x": 0.3, "e": False,
    }


def test_hash_ignores_column_order_and_sees_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    r = df.select(stable_hash(["a", "b"]).alias("p"), stable_hash(["b", "a"]).alias("q")).collect()
    assert r[0]["p"] == r[0]["q"] and r[0]["p"] != r[1]["p"] and len(r[0]["p"]) == 64
