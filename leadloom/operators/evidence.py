"""Evidence tables: validation, qualification, deduplication, usage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import policy


def validated(evidence: DataFrame) -> DataFrame:
    """Adds problem: the first rule that a row breaks, or null."""
    checks = [("strength", policy.STRENGTHS), ("family", policy.FAMILIES), ("scope", policy.SCOPES), ("freshness", policy.FRESHNESS)]
    problem = F.coalesce(
        *[F.when(F.col(c).isNull() | ~F.col(c).isin(*allowed), F.lit(f"bad_{c}")) for c, allowed in checks],
        F.when(F.col("provider").isNotNull() & ((F.trim("provider") == "") | (F.trim("provider") != F.col("provider"))), F.lit("bad_provider")),
    )
    return evidence.withColumn("problem", problem)


def qualifying(evidence: DataFrame) -> DataFrame:
    return evidence.where(counts())


def deduplicated(evidence: DataFrame, *keys: str) -> DataFrame:
    """The strongest row of each lead, family and provider (then the current one, then the first to arrive)."""
    group = ["lead_id", "family", "provider", *keys]
    rank = F.struct("strength_rank", (F.col("freshness") == "current").alias("current"), (-F.col("ordinal")).alias("late"))
    picked = F.struct("ordinal", "strength", "strength_rank", "scope", "freshness", "observed_at")
    return evidence.groupBy(*group).agg(F.max_by(picked, rank).alias("best"), F.min("ordinal").alias("first_ordinal")).select(*group, "best.*", "first_ordinal")


def families_present(evidence: DataFrame) -> DataFrame:
    """Rows and the strongest strength by lead and family."""
    return evidence.groupBy("lead_id", "family").agg(F.count(F.lit(1)).alias("n"), F.max("strength_rank").alias("rank")).select("lead_id", "family", "n", F.get(F.array(*map(F.lit, policy.STRENGTHS)), F.col("rank")).alias("max_strength"))


def counts() -> Column:
    """Whether a row may count towards a usage state: cloud-bearing, not a dependency, with a provider or inherent."""
    return (F.col("scope") != "saas_dependency") & F.col("family").isin(*policy.CLOUD_BEARING) & (F.col("provider").isNotNull() | F.col("family").isin(*policy.INHERENT))


def state_columns(counted: Column) -> list[Column]:
    """Aggregates of a group of evidence rows: state, n_families, medium_families.

    Each condition asks whether some row holds, and the row that deduplication keeps is the strongest, current first; so the
    state is the same over all rows, and one aggregation with map-side sums does. Families are bits of a mask.
    """
    edge = F.col("family") == policy.EDGE
    bit = F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*map(F.lit, policy.FAMILIES)), F.col("family")).cast("int"))
    families = lambda cond: F.bit_count(F.coalesce(F.bit_or(F.when(counted & cond, bit)), F.lit(0)))
    some = lambda cond: F.coalesce(F.bool_or(counted & cond), F.lit(False))
    confirmed = some(F.col("family").isin(*policy.HOSTING) & (F.col("strength") == "DIRECT") & (F.col("freshness") == "current"))
    strong, medium = some(~edge & (F.col("strength_rank") >= 2)), families(~edge & (F.col("strength_rank") >= 1))
    state = F.when(confirmed, "CONFIRMED").when((families(~edge) >= 2) & strong, "LIKELY").when(strong | (medium >= 2), "POSSIBLE").when(some(edge), "EDGE_ONLY").otherwise("UNKNOWN")
    return [state.alias("state"), families(F.lit(True)).cast("long").alias("n_families"), medium.cast("long").alias("medium_families")]


def usage_state(evidence: DataFrame) -> DataFrame:
    """State by lead; a lead whose rows all fail to qualify is UNKNOWN."""
    return evidence.groupBy("lead_id").agg(*state_columns(counts()))


def provider_states(evidence: DataFrame) -> DataFrame:
    """State by lead and named provider, with row counts and ids."""
    seen = [F.count(F.lit(1)).alias("observations"), F.array_join(F.array_sort(F.collect_list("ordinal")).cast("array<string>"), ",").alias("evidence_ids"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen")]
    return qualifying(evidence).where(F.col("provider").isNotNull()).groupBy("lead_id", "provider").agg(*state_columns(F.lit(True)), *seen)


def missing_channels(channels: DataFrame) -> DataFrame:
    """Cloud-bearing channels that did not run, sorted and joined, by lead."""
    missing = F.col("channel").isin(*policy.CLOUD_CHANNELS) & ((F.col("status") == "degraded") | ((F.col("status") == "skipped") & (F.col("channel") == "vendor")))
    return channels.groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(missing, F.col("channel")))), ",").alias("missing"))


def unknown_reason(states: DataFrame, missing: DataFrame, resolved: Column) -> DataFrame:
    reason = F.when(F.col("state") != "UNKNOWN", F.lit(None)).when(~resolved, "NO_RESOLVABLE_DOMAIN").when(F.coalesce("missing", F.lit("")) != "", "INSUFFICIENT_EVIDENCE").otherwise("NO_PUBLIC_CLOUD_EVIDENCE")
    return states.join(missing, "lead_id", "left").withColumn("unknown_reason", reason)


def without_degraded(evidence: DataFrame, channel: Column, channels: DataFrame) -> DataFrame:
    """Evidence of all channels, less that of degraded ones."""
    bad = channels.where("status = 'degraded'").select(F.col("lead_id").alias("_lead"), F.col("channel").alias("_channel"))
    return evidence.join(bad, (F.col("lead_id") == F.col("_lead")) & (channel == F.col("_channel")), "left_anti")


def strongest_per_family(evidence: DataFrame) -> DataFrame:
    """Each lead's strongest row by family; weak rows count for edge delivery alone."""
    w = Window.partitionBy("lead_id", "family").orderBy(F.desc("strength_rank"), "ordinal")
    rows = evidence.where((F.col("strength") != "WEAK") | (F.col("family") == policy.EDGE))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("lead_id", "family", "ordinal", "strength")


def numbered(evidence: DataFrame) -> DataFrame:
    """Evidence numbers per lead in order of arrival."""
    n = F.row_number().over(Window.partitionBy("lead_id").orderBy("ordinal"))
    return evidence.select("lead_id", "ordinal", F.format_string("ev-%03d", n).alias("evidence_id"))
