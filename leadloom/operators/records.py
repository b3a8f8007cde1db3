"""Outcome records: a keyed sink that dry runs never spoil, counts taken while rows are written, marks of labelled cases, and a
caller's own enrichment of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadloom.streaming.claims import Upsert

#: What may become of a message: fixed values. Those of FAILED count as errors.
STATUSES = ("processed", "duplicate", "auto_generated", "needs_review", "rejected", "failed", "dead_letter")
FAILED = ("failed", "dead_letter")


def record_id(message_id: Column) -> Column:
    """The name of a message's record."""
    return F.left(F.sha2(F.coalesce(message_id, F.lit("")), 256), F.lit(24))


class RecordSink:
    """The last record of each message. A record of a dry run gives way to any real one and never replaces it; of two real ones, or two
    dry ones, the later processed_at stays. Only the buckets that a batch touches are written anew, see Upsert.

    Records: record_id, status, dry_run, processed_at and any further columns, the same in every batch.
    """

    def __init__(self, path: str, buckets: int = 16):
        self.table = Upsert(path, "record_id", ["_real", "processed_at"], buckets)

    def write(self, records: DataFrame, run: str, epoch: int = 0) -> None:
        self.table.write(records.withColumn("_real", ~F.coalesce("dry_run", F.lit(False))), epoch, run)

    def read(self, spark) -> DataFrame | None:
        rows = self.table.read(spark)
        return None if rows is None else rows.drop("_real")

    def export(self, spark, path: str) -> None:
        """The records as JSON lines, a folder per status."""
        rows = self.read(spark)
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("status").json(path)


def observed_write(rows: DataFrame, path: str, status: str = "status", statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Writes rows as Parquet and counts them by status in the same pass. Returns one row: attempted, succeeded, failed, other (a status
    that is null or not listed) and a column per status."""
    seen = Observation()
    named = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    failed = F.count_if(F.col(status).isin(*FAILED)).alias("failed_")
    other = F.count_if(F.col(status).isNull() | ~F.col(status).isin(*statuses)).alias("other")
    rows.observe(seen, F.count(F.lit(1)).alias("attempted"), failed, other, *named).write.mode("overwrite").parquet(path)
    got = seen.get
    values = [got["attempted"], got["attempted"] - got["failed_"] - got["other"], got["failed_"], got["other"], *[got[s] for s in statuses]]
    names = ["attempted", "succeeded", "errors", "other", *[f"n_{s}" for s in statuses]]
    return rows.sparkSession.createDataFrame([tuple(values)], ", ".join(f"{n} long" for n in names))


def case_marks(rows: DataFrame) -> DataFrame:
    """rows (expected, got) with mark: OK, SOFT (review and blocked taken for each other) or MISS, an answer that is none too."""
    halting = F.col("expected").isin("review", "blocked") & F.col("got").isin("review", "blocked")
    return rows.withColumn("mark", F.when(F.coalesce(F.col("expected") == F.col("got"), F.lit(False)), "OK").when(F.coalesce(halting, F.lit(False)), "SOFT").otherwise("MISS"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """cases, strict (got what was expected), flagged (clear or not clear, as expected; an answer that is none never counts) to three
    places, and soft misses."""
    marked = case_marks(rows)
    known = F.coalesce(F.col("got").isin("clear", "review", "blocked"), F.lit(False))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 3)
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("mark") == "OK").alias("strict"), share(known & ((F.col("got") == "clear") == (F.col("expected") == "clear"))).alias("flagged"), F.count_if(F.col("mark") == "SOFT").alias("soft_misses")
    )


def enrich(rows: DataFrame, fill: Callable[[pd.DataFrame], pd.DataFrame], result: StructType, batch_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The caller's function on batches of rows; returns (rows with the result's columns, rejected rows with a reason).

    fill gets a frame of at most batch_rows rows and returns one with the result's columns, row for row. A batch is rejected whole when
    fill raises or returns another number of rows; a row when a value cannot be read as the result's type or is null where it may not
    be. Nothing of a rejected row is taken over. fill may run again for the same rows, when a task is repeated or both outputs are
    read; write one of them down first if that costs. Columns of rows that are named like a result are replaced.
    """
    kept = rows.drop(*result.names)
    names = kept.columns
    out = StructType([*kept.schema, *[StructField(f.name, StringType()) for f in result], StructField("_reason", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                part = whole.iloc[at : at + batch_rows].reset_index(drop=True)
                reason = None
                try:
                    got = fill(part.copy())
                    if len(got) != len(part):
                        reason = f"{len(got)} rows for {len(part)}"
                    elif missing := [n for n in result.names if n not in got.columns]:
                        reason = f"no column {missing[0]}"
                except Exception as wrong:  # noqa: BLE001  a bad batch must not lose the others
                    reason = f"{type(wrong).__name__}: {wrong}"[:200]
                for n in result.names:
                    part[n] = None if reason else [None if x is None or x is pd.NA or x != x else str(x) for x in got[n]]
                part["_reason"] = reason
                yield part[[*names, *result.names, "_reason"]]

    raw = kept.mapInPandas(run, out)
    checks, values = [], {}
    for f in result:
        values[f.name] = F.col(f.name).try_cast(f.dataType)
        checks.append(F.when(F.col(f.name).isNotNull() & values[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
        if not f.nullable:
            checks.append(F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is null")))
    judged = raw.withColumn("_reason", F.coalesce("_reason", *checks))
    good = judged.where("_reason is null").select(*names, *[v.alias(n) for n, v in values.items()])
    return good, judged.where("_reason is not null").select(*names, F.col("_reason").alias("reason"))
