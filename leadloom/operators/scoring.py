"""Fit scoring: scale, cloud usage, complexity, confidence and the spend prior, each compiled from a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import policy
from leadloom.profiles import DEFAULT, Fit


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases], F.lit(False))


def all_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(p) for p in phrases], F.lit(True))


def employees_for_scoring(leads: DataFrame, p: Fit = DEFAULT) -> DataFrame:
    """Adds headcount: the inferred figure, or the band's where it contradicts the band or is missing (0 counts as missing)."""
    by_band = lambda i: F.create_map(*[F.lit(x) for k, v in p.bands.items() for x in (k, v[i])])[F.col("size_band")]
    inferred = F.when(F.col("employees") != 0, F.col("employees"))
    return leads.withColumn("headcount", F.when(inferred.isNotNull() & by_band(1).isNotNull() & ~inferred.between(by_band(1), by_band(2)), by_band(0)).otherwise(F.coalesce(inferred, by_band(0))))


def scale_points(headcount: Column, p: Fit = DEFAULT) -> Column:
    out = F.when(headcount.isNull(), p.unknown_points)
    for below, points in p.tiers:
        out = out.when(headcount < below, points) if below is not None else out.otherwise(points)
    return out


def workload_bonus(signals: DataFrame, evidence: DataFrame, p: Fit = DEFAULT) -> DataFrame:
    """By lead: bonus points (once per category) and the categories whose citation may raise confidence.

    A category counts by its first signal that cites a row of the lead's own evidence; infrastructure code must be strong.
    """
    categories = F.array(*[F.when(any_phrase(F.lower("signal"), words), F.lit(name)) for name, words in p.workloads.items()])
    own = evidence.select(F.col("lead_id").alias("_lead"), F.col("ordinal").alias("cited"), "family", "strength")
    rows = (
        signals.select("lead_id", "position", "cited", F.explode(F.array_compact(categories)).alias("category"))
        .join(own, ["cited"]).where(F.col("lead_id") == F.col("_lead"))
        .where((F.col("category") != "kubernetes/iac at scale") | (F.col("family") != "engineering_footprint") | (F.col("strength") == "STRONG"))
    )
    bearing = F.col("family").isin(*policy.CLOUD_BEARING) & (F.col("family") != policy.EDGE)
    first = rows.groupBy("lead_id", "category").agg(F.min_by(bearing, F.col("position")).alias("bearing"))
    return first.groupBy("lead_id").agg(F.least(F.count(F.lit(1)) * p.workload_points, F.lit(p.workload_cap)).alias("bonus"), F.sum(F.col("bearing").cast("int")).alias("backed"))


def complexity_points(text: Column, industry: Column, p: Fit = DEFAULT) -> Column:
    lowered = {"text": F.lower(F.substring(text, 1, 3000)), "industry": F.lower(industry)}
    holds = lambda r: (any_phrase(lowered[r.field], r.any) if r.any else F.lit(bool(r.all))) & all_phrases(lowered[r.field], r.all)
    parts = [F.when(holds(r), r.points).otherwise(0) for r in p.rules]
    return F.least(reduce(lambda a, b: a + b, parts, F.lit(0)), F.lit(p.complexity_cap))


def spend_tier(industry: Column, headcount: Column, p: Fit = DEFAULT) -> Column:
    lowered = F.lower(F.coalesce(industry, F.lit("")))
    each = F.when(any_phrase(lowered, p.high_spend), p.usd["infra-heavy"]).when(any_phrase(lowered, p.low_spend), p.usd["low-infra"]).otherwise(p.usd["neutral"])
    out = F.when(headcount.isNull(), p.spend_edges[0][1] if p.spend_edges else p.spend_above)
    for edge, tier in p.spend_edges:
        out = out.when(headcount * each < edge, tier)
    return out.otherwise(p.spend_above)


def fit(leads: DataFrame, states: DataFrame, bonus: DataFrame, text: Column, hq_known: Column, p: Fit = DEFAULT) -> DataFrame:
    """Points, score, confidence and spend tier by lead. leads: with headcount; states: usage_state's rows.

    Confidence: where the profile needs cloud signals, fewer than two of them are LOW and headquarters and headcount decide the rest; where
    it does not, two signals are one of three things to know.
    """
    joined = leads.join(states, "lead_id", "left").join(bonus, "lead_id", "left")
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in p.state_points.items() for x in kv])[F.coalesce("state", F.lit("UNKNOWN"))], F.lit(0))
    cloud = F.least(base + F.coalesce("bonus", F.lit(0)), F.lit(p.cloud_cap))
    signals = F.when(base > 0, 1).otherwise(0) + F.coalesce("backed", F.lit(0))
    seen = F.greatest(signals, F.coalesce("medium_families", F.lit(0))) >= 2
    known = F.when(hq_known, 1).otherwise(0) + F.when(F.col("employees").isNotNull(), 1).otherwise(0)
    if p.needs_cloud:
        confidence = F.when(~seen, "LOW").when(known == 2, "HIGH").when(known == 1, "MEDIUM").otherwise("LOW")
    else:
        confidence = F.when(known + seen.cast("int") == 3, "HIGH").when(known + seen.cast("int") == 2, "MEDIUM").otherwise("LOW")
    return joined.select(
        "lead_id", scale_points(F.col("headcount"), p).alias("scale_points"), cloud.cast("int").alias("cloud_points"), complexity_points(text, F.col("industry"), p).alias("complexity_points"),
        confidence.alias("confidence"), spend_tier(F.col("industry"), F.col("headcount"), p).alias("spend_tier"), F.coalesce("state", F.lit("UNKNOWN")).alias("state"),
    ).withColumn("score", F.least(F.col("scale_points") + F.col("cloud_points") + F.col("complexity_points"), F.lit(p.max_score)))


def sales_ready(status: Column, score: Column, confidence: Column, p: Fit = DEFAULT) -> Column:
    enough = ("LOW", "MEDIUM", "HIGH")[("LOW", "MEDIUM", "HIGH").index(p.least_confidence) :]
    return (status == "clear") & (score >= p.threshold) & confidence.isin(*enough)
