"""Ledgers, call telemetry and labelled evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64


def chained(entries: DataFrame) -> DataFrame:
    """Per run: entries, and the head of the hash chain over its payloads in order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    return entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"), F.aggregate(ordered, F.lit(GENESIS), lambda acc, x: F.sha2(F.concat(acc, F.lit("|"), x["payload"]), 256)).alias("head"))


def sealed(entries: DataFrame) -> DataFrame:
    """run_id, seq, payload, prev_hash and hash of each entry, as a writer that appends them one by one stores them. A run is a unit of
    work of one process, so its entries fit in memory."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    start = F.array().cast("array<struct<seq:bigint,payload:string,prev_hash:string,hash:string>>")

    def append(rows: Column, x: Column) -> Column:
        before = F.coalesce(F.get(rows, F.size(rows) - 1)["hash"], F.lit(GENESIS))
        return F.concat(rows, F.array(F.struct(x["seq"].cast("long").alias("seq"), x["payload"].alias("payload"), before.alias("prev_hash"), F.sha2(F.concat(before, F.lit("|"), x["payload"]), 256).alias("hash"))))

    return entries.groupBy("run_id").agg(F.explode(F.aggregate(ordered, start, append)).alias("e")).select("run_id", "e.*")


def verify_ledger(ledger: DataFrame, heads: DataFrame | None = None, first_seq: int = 0) -> DataFrame:
    """Per run: entries, head, ok, and the first broken seq with its problem.

    Every entry is checked by itself: its hash is computed again from the stored previous hash and its payload (edited), the previous hash
    is that of the entry before (relinked), which must exist (gap) and be the only one of its seq (repeated). Entries meet their
    predecessors by an equi-join on run and seq, so no run comes into one task, however long. heads (run_id, entries, head), kept
    elsewhere, tells a ledger that was cut short (truncated) or written anew from its start (replaced).

    ledger: run_id, seq, payload, prev_hash, hash. A null field of an entry counts as an edit.
    """
    before = ledger.groupBy("run_id", "seq").agg(F.min("hash").alias("before"), F.count(F.lit(1)).alias("copies"))
    prior = before.select("run_id", (F.col("seq") + 1).alias("seq"), "before")
    again = F.sha2(F.concat("prev_hash", F.lit("|"), "payload"), 256)
    first = F.col("seq") == first_seq
    rows = ledger.join(before.select("run_id", "seq", "copies"), ["run_id", "seq"]).join(prior, ["run_id", "seq"], "left")
    problem = (
        F.when(F.col("copies") > 1, "repeated").when(~first & F.col("before").isNull(), "gap").when(F.coalesce(again != F.col("hash"), F.lit(True)), "edited")
        .when(F.coalesce(F.col("prev_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.col("before")), F.lit(True)), "relinked")
    )
    runs = rows.withColumn("problem", problem).groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("hash", "seq").alias("head"), F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "problem"))).alias("b"))
    if heads is None:
        return runs.select("run_id", "entries", "head", F.col("b").isNull().alias("ok"), F.col("b.seq").alias("bad_seq"), "b.problem")
    kept = heads.select("run_id", F.col("entries").alias("_entries"), F.col("head").alias("_head"))
    both = runs.join(kept, "run_id", "full")
    n = F.coalesce("entries", F.lit(0))
    late = F.when(F.col("_head").isNull(), "unknown_run").when(n < F.col("_entries"), "truncated").when((n != F.col("_entries")) | (F.col("head") != F.col("_head")), "replaced")
    return both.select("run_id", n.alias("entries"), "head", (F.col("b").isNull() & late.isNull()).alias("ok"), F.col("b.seq").alias("bad_seq"), F.coalesce("b.problem", late).alias("problem"))


def run_status(entries: DataFrame) -> DataFrame:
    """The last terminal marker of each run, or unknown."""
    marker = F.col("kind").isin("completed", "aborted")
    return entries.groupBy("run_id").agg(F.coalesce(F.max_by(F.when(marker, F.col("kind")), F.when(marker, F.col("seq"))), F.lit("unknown")).alias("status"))


def lineage_problems(rows: DataFrame, run_id: Column, fingerprint: str) -> DataFrame:
    """Runs whose rows do not all carry the expected fingerprint."""
    return rows.groupBy(run_id.alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("kinds"), F.sum((F.coalesce("fingerprint", F.lit("")) != fingerprint).cast("long")).alias("wrong")).where("wrong > 0")


def call_rollup(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_micros").alias("cost_micros"), F.sum("latency_ms").cast("long").alias("latency_ms"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.sum("hops").cast("long").alias("hops"))


def eval_metrics(rows: DataFrame, labels: tuple[str, ...] = ("clear", "review", "blocked")) -> DataFrame:
    """Per label: support, precision, recall and F1 to three places; 0 where undefined. rows: expected, got."""
    each = rows.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "expected", "got")
    is_ = lambda c: (F.col(c) == F.col("label")).cast("long")
    sums = each.groupBy("label").agg(F.sum(is_("expected") * is_("got")).alias("tp"), F.sum(is_("got")).alias("called"), F.sum(is_("expected")).alias("support"))
    over = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 3)
    return sums.select("label", "support", over(F.col("tp"), F.col("called")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected", "got").agg(F.count(F.lit(1)).alias("n"))


def model_comparison(rows: DataFrame, calls: DataFrame, answers: tuple[str, ...] = ("clear", "review", "blocked")) -> DataFrame:
    """Per model: cases, hits, flagged_hits (cleared or not, as expected), false_clears (cleared though not expected), valid_rate (answers
    of the schema, to three places), errors (all others, which count as wrong) and median_latency_ms of its calls."""
    times = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    valid, cleared = F.coalesce(F.col("got").isin(*answers), F.lit(False)), lambda c: F.col(c) == "clear"
    sums = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("cases"), times(F.col("expected") == F.col("got")).alias("hits"), times(valid & (cleared("got") == cleared("expected"))).alias("flagged_hits"),
        times(cleared("got") & ~cleared("expected")).alias("false_clears"), times(~valid).alias("errors"),
    )
    latency = calls.groupBy("model").agg(F.round(F.median("latency_ms")).cast("long").alias("median_latency_ms"))
    return sums.withColumn("valid_rate", F.round((F.col("cases") - F.col("errors")) / F.col("cases"), 3)).join(latency, "model", "left")


def redacted(text: Column) -> Column:
    """Stored payloads: addresses, bearer tokens and keys are masked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<redacted>")
    return F.regexp_replace(out, r"(?i)(password|api_key|token|bearer)([=: ]+)[A-Za-z0-9_-]{8,}", "$1$2<redacted>")


def wrapped(text: Column, limit: int = 6000) -> Column:
    """Evidence text made safe to quote: no control characters or call tags, a bound on its length, and marks around it."""
    bare = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", " "), r"(?i)</?function_call[^>]*>", "")
    return F.concat(F.lit("<<<\n"), F.substring(F.replace(bare, F.lit("<<<"), F.lit("‹‹‹")), 1, limit), F.lit("\n>>>"))
