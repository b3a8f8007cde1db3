"""Streams of messages: idempotent claims, near-window deduplication, upserts, bounded polls, newest answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Outcomes: claimed, taken_over and dead_letter hold the message; duplicates name who does, by message id or by content; stale is
#: a notice that a claim was not finished in time.
CLAIM = "doc_id long, claimed_at long, content_hash string, status string, outcome string, reason string, duplicate_of long, attempts int"
_COLUMNS = [c.split()[0] for c in CLAIM.split(", ")]
#: A message that ended so stands for no other of the same content.
ENDED = ("failed", "rejected", "dead_letter")


class Message(NamedTuple):
    """A row of CLAIM, or of what comes in: then the fields after status are null."""

    doc_id: int
    claimed_at: int
    content_hash: str | None
    status: str
    outcome: str | None = None
    reason: str | None = None
    duplicate_of: int | None = None
    attempts: int | None = None


def _frame(rows: list[Message]) -> pd.DataFrame:
    # as objects: most groups have one row, and the types come from the schema
    return pd.DataFrame(dict(zip(_COLUMNS, ([*c] for c in zip(*rows, strict=True)), strict=True)), dtype=object) if rows else pd.DataFrame({c: [] for c in _COLUMNS}, dtype=object)


def _in_order(batches: Iterator[pd.DataFrame]) -> list[Message]:
    """The rows of a group by time, missing values as None."""
    out = []
    for batch in batches:
        columns = [batch[c].tolist() for c in Message._fields if c in batch.columns]
        out += [Message(*(None if x != x else x for x in row)) for row in zip(*columns, strict=True)]
    return sorted(out, key=lambda m: (m.claimed_at, m.doc_id)) if len(out) > 1 else out


def claims(messages: DataFrame, key: str, stale_s: int = 900, max_attempts: int = 3, lifetime_ms: int | None = None, notices: bool = False) -> DataFrame:
    """The first message of an id claims it, later ones are duplicates; a failed or stale claim is taken over; one row per message, CLAIM.

    messages: doc_id, claimed_at, status, content_hash and the key (a null key is a message of its own). Who comes first claims, as with
    a store that is asked on arrival; the messages of one batch are taken in the order of claimed_at. A claim that fails max_attempts
    times is dead. The state is one small row per id, whatever the number of messages, dropped lifetime_ms of processing time after the
    last one (null: never). notices: a claim that is still open stale_s after it came yields a stale row.
    """
    wait = 1000 * stale_s if notices else None

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            doc_id, since, status, attempts, told = state.get
            if wait and status == "claimed" and not told:
                state.update((doc_id, since, status, attempts, True))
                if lifetime_ms:
                    state.setTimeoutDuration(lifetime_ms)
                yield _frame([Message(doc_id, since, None, status, "stale", None, None, attempts)])
            elif lifetime_ms:
                state.remove()
            return
        held, out = (state.get[:4] if state.exists else None), []
        for m in _in_order(batches):
            late = held is not None and held[2] == "claimed" and m.claimed_at - held[1] > stale_s
            if held is None or ((late or held[2] == "failed") and held[3] < max_attempts):
                attempts = held[3] + 1 if held else 1
                dead = m.status == "failed" and attempts >= max_attempts
                outcome = "dead_letter" if dead else "taken_over" if held else "claimed"
                held = (m.doc_id, m.claimed_at, "dead_letter" if dead else m.status, attempts)
                out.append(Message(m.doc_id, m.claimed_at, m.content_hash, held[2], outcome, None, None, attempts))
            else:
                out.append(Message(m.doc_id, m.claimed_at, m.content_hash, m.status, "duplicate", "message_id", held[0], held[3]))
        state.update((*held, False))
        waits = [x for x in (wait if held[2] == "claimed" else None, lifetime_ms) if x]
        if waits:
            state.setTimeoutDuration(min(waits))
        yield _frame(out)

    own = messages.select(F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("doc_id").cast("string"))).alias("claim_key"), "doc_id", "claimed_at", F.coalesce("content_hash", F.lit("")).alias("content_hash"), "status")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait or lifetime_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("claim_key").applyInPandasWithState(step, CLAIM, "doc_id long, claimed_at long, status string, attempts int, told boolean", "append", timeout)


def content_twins(decided: DataFrame, lifetime_ms: int | None = None) -> DataFrame:
    """The second step, a stream over what claims wrote: a new claim of a content that an earlier one still stands for is its duplicate.

    The state is one id per content. Rows without a content hash (notices) pass through.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, out = (state.get[0] if state.exists else None), []
        for m in _in_order(batches):
            if m.outcome == "claimed" and first is not None:
                m = m._replace(outcome="duplicate", reason="content", duplicate_of=first)
            elif first is None and m.outcome in ("claimed", "taken_over") and m.status not in ENDED and m.content_hash is not None:
                first = m.doc_id
            out.append(m)
        if first is not None:
            state.update((first,))
            if lifetime_ms:
                state.setTimeoutDuration(lifetime_ms)
        yield _frame(out)

    keyed = decided.withColumn("content", F.coalesce("content_hash", F.concat(F.lit("\0"), F.col("doc_id").cast("string"))))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if lifetime_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("content").applyInPandasWithState(step, CLAIM, "doc_id long", "append", timeout)


def canonical(decided: DataFrame) -> DataFrame:
    """Decided messages with duplicate_of led on to the message that stands for its content, where the one of the same id is itself such a
    duplicate."""
    onward = decided.where("reason = 'content'").select(F.col("doc_id").alias("duplicate_of"), F.col("duplicate_of").alias("_twin"))
    rows = decided.join(onward, "duplicate_of", "left")
    return rows.withColumn("duplicate_of", F.coalesce("_twin", "duplicate_of")).select(*decided.columns)


def near_window(messages: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Drops re-sends of a key within the delay; rows later than it are kept by the idempotent claim, not by this stage."""
    return messages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


BUCKET, MANIFEST = "bucket", "manifest"


class Upsert:
    """A table of the last row by key: buckets by the key's hash, each written anew only when a batch touches it, and a manifest that
    names the current file folder of every bucket.

    A batch first writes its touched buckets under a new version, then the manifest of that version, in one small file, and only then
    removes versions that no manifest of the last two names. A crash before the manifest leaves the old version whole; the same batch
    written again finds its token (query and epoch) in the newest manifest and does nothing. A fresh checkpoint goes on from the
    table that is there. One writer at a time; readers see the newest manifest.
    """

    def __init__(self, path: str, key: str, order: list[str], buckets: int = 16):
        self.path, self.key, self.order, self.buckets = path.rstrip("/"), key, order, buckets

    def _versions(self, spark: SparkSession) -> list[int]:
        try:
            rows = spark.read.schema("version long, bucket int, part string, token string").parquet(f"{self.path}/{MANIFEST}").select("version").distinct().collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["version"] for r in rows)

    def manifest(self, spark: SparkSession) -> list:
        """bucket, part and token of the newest version, one row per bucket."""
        versions = self._versions(spark)
        if not versions:
            return []
        rows = spark.read.schema("version long, bucket int, part string, token string").parquet(f"{self.path}/{MANIFEST}")
        return rows.where(F.col("version") == versions[-1]).collect()

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame | None:
        """The current rows, or None before the first batch."""
        parts = sorted({r["part"] for r in self.manifest(spark) if r["part"]})
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def write(self, batch: DataFrame, epoch: int, run: str = "") -> None:
        spark = batch.sparkSession
        token = f"{run or spark.sparkContext.getLocalProperty('sql.streaming.queryId') or uuid.uuid4().hex}:{epoch}"
        old = self.manifest(spark)
        if any(r["token"] == token for r in old):
            return
        version = max(self._versions(spark), default=0) + 1
        bucketed = batch.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = sorted(r[BUCKET] for r in bucketed.select(BUCKET).distinct().collect())  # self.buckets rows at most
        kept = {r["bucket"]: r["part"] for r in old if r["part"]}
        now = [f"{self.path}/{kept[b]}" for b in touched if b in kept]
        rows = bucketed
        if now:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*now).withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
        names = batch.columns
        last = rows.groupBy(BUCKET, self.key).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("r")).select(BUCKET, "r.*")
        last.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/v{version}")
        kept |= {b: f"v{version}/{BUCKET}={b}" for b in touched}
        table = [(version, b, p, token) for b, p in sorted(kept.items())] or [(version, -1, None, token)]
        spark.createDataFrame(table, "version long, bucket int, part string, token string").coalesce(1).write.mode("append").parquet(f"{self.path}/{MANIFEST}")
        self._clean(spark, {r["part"] for r in old if r["part"]} | set(kept.values()))

    def _clean(self, spark: SparkSession, named: set[str]) -> None:
        """Removes folders of buckets that neither this nor the last manifest names."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for version in fs.listStatus(root):
            if version.getPath().getName().startswith("v"):
                parts = [p.getPath() for p in fs.listStatus(version.getPath()) if p.getPath().getName().startswith(f"{BUCKET}=")]
                dead = [p for p in parts if f"{version.getPath().getName()}/{p.getName()}" not in named]
                for p in dead:
                    fs.delete(p, True)
                if len(dead) == len(parts):
                    fs.delete(version.getPath(), True)


def upsert(path: str, key: str, order: str, run: str = "", buckets: int = 16):
    """A foreachBatch writer that keeps the last row by key, see Upsert. run tells one checkpoint from another; the stream's own id, if
    not given."""
    table = Upsert(path, key, [order], buckets)
    return lambda batch, epoch: table.write(batch, epoch, run)


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that upsert keeps."""
    return Upsert(path, "", []).read(spark)


def poll(spark: SparkSession, path: str, schema: str, per_pass: int = 25) -> DataFrame:
    """A folder of message files, per_pass of them in a batch; the checkpoint acknowledges a file once its batch is written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_pass).parquet(path)


def drain(stream: DataFrame, checkpoint: str, name: str | None = None, writer=None, path: str | None = None, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there and stops."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if writer is not None:
        query = out.foreachBatch(writer).start()
    elif path is not None:
        query = out.format("parquet").option("path", path).start()
    else:
        query = out.format("memory").queryName(name).start()
    query.awaitTermination()
    return query


def live_answers(answers: DataFrame, key: str, time: str) -> DataFrame:
    """The newest answer of each key as a stream of updates; empty answers are never kept. One state row per key; no answer is too
    late, and how old one may be is decided where it is read (decide.screen_freshness)."""
    kept = answers.where(F.coalesce(F.col("n_results"), F.lit(0)) > 0)
    return kept.groupBy(key).agg(F.max_by("answer_id", F.struct(time, "answer_id")).alias("answer_id"), F.max(time).alias(time))
