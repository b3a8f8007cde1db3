"""Profiles: strict keys and kinds, defaults of what is left out, and what they change."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom import policy, profiles
from leadloom.operators import scoring

BAD = [
    ({"fits": {}}, "profile: unknown keys fits"), ({"fit": {"treshold": 1}}, "profile.fit: unknown keys treshold"), ({"fit": {"threshold": "60"}}, "profile.fit.threshold"), ({"fit": {"threshold": True}}, "profile.fit.threshold"),
    ({"fit": []}, "profile.fit"), ({"fit": {"scale": {"tiers": []}}}, "profile.fit.scale.tiers"), ({"fit": {"scale": {"tiers": [{"below": 5, "points": 1}]}}}, "no upper end"), ({"fit": {"scale": {"tiers": [{"points": 1}, {"points": 2}]}}}, "no upper end"),
    ({"fit": {"scale": {"tiers": [{"below": 5}, {"points": 2}]}}}, "tiers[0]: points missing"), ({"fit": {"size_bands": {"1-10": {"employees": 5, "min": 1}}}}, "size_bands.1-10: max missing"), ({"fit": {"spend": {"usd_per_employee": {"neutral": 1}}}}, "infra-heavy, low-infra missing"),
    ({"fit": {"complexity": {"rules": [{"points": 1, "field": "title"}]}}}, "rules[0].field"), ({"fit": {"sales_ready_min_confidence": "medium"}}, "sales_ready_min_confidence"), ({"reply": {"draft_on": ["maybe"]}}, "draft_on[0]"), ({"fit": {"spend": {"tier_edges": [[1]]}}}, "tier_edges[0]"),
]


@pytest.mark.parametrize(("given", "said"), BAD, ids=[s for _, s in BAD])
def test_bad_profiles(given, said):
    with pytest.raises(profiles.ProfileError) as wrong:
        profiles.fit_of(given)
    assert said in str(wrong.value)


def test_only_what_is_left_out_is_a_default():
    assert profiles.DEFAULT.tiers == policy.TIERS and profiles.fit_of({"name": "x", "identity": {"product_name": "p"}}) == profiles.DEFAULT
    own = profiles.fit_of({"fit": {"cloud": {"state_points": {"LIKELY": 1}}, "workload_intensity": {"categories": {}}, "spend": {"high_industries": []}, "complexity": {"rules": []}}})
    assert own.state_points["LIKELY"] == 1 and own.state_points["CONFIRMED"] == 40 and own.workloads == {} and own.high_spend == () and own.low_spend == policy.LOW_SPEND and own.rules == ()


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"fit": {"threshold": 7}}))
    assert profiles.fit_of(profiles.read(spark, str(tmp_path / "a.json"))).threshold == 7
    pytest.importorskip("yaml")
    assert profiles.fit_of(profiles.parse("name: x\nfit:\n  max_score: 80  # cap\n  scale:\n    tiers:\n      - {below: 9, points: 1}\n      - {points: 2}\n")).tiers == ((9, 1), (None, 2))
    with pytest.raises(profiles.ProfileError):
        profiles.parse("fit:\n  nothing: 1\n")
    assert profiles.parse("") == {}


def test_empty_lists_match_nothing(spark):
    own = profiles.fit_of({"fit": {"complexity": {"rules": [{"points": 5}, {"points": 3, "all": ["a", "b"]}]}, "spend": {"high_industries": [], "low_industries": []}}})
    got = spark.createDataFrame([("a b", "saas"), ("a", "saas")], "t string, i string").select(scoring.complexity_points(F.col("t"), F.col("i"), own).alias("c"), scoring.spend_tier(F.col("i"), F.lit(100), own).alias("s")).collect()
    assert [tuple(r) for r in got] == [(3, "MEDIUM"), (0, "MEDIUM")]
    ready = profiles.fit_of({"fit": {"threshold": 10, "sales_ready_min_confidence": "LOW"}})
    rows = spark.createDataFrame([("clear", 10, "LOW"), ("clear", 9, "HIGH"), ("review", 99, "HIGH")], "status string, score int, confidence string")
    assert [r[0] for r in rows.select(scoring.sales_ready(F.col("status"), F.col("score"), F.col("confidence"), ready)).collect()] == [True, False, False]
