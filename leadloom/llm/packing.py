"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. A window hands out window_tokens: the queues that still hold tokens earn them in proportion to
their shares, spend whole tokens only, and carry the rest (their deficit) to the next window. When a queue runs dry, the others
fill its place in proportion, so that every window but the last is full. What a queue has earned after so many windows is its
share of a clock that all queues have in common: it runs faster each time a queue runs dry, and is known in closed form at any
window. That is what makes the schedule distributed: a task needs no state of the windows or partitions before its own, only the
queue totals (one row per source) and where its block of documents begins in each queue. Windows are laid end to end and cut
into sequences, so that only the last sequence is padded.

Three steps: tokenize once and write ids, block and running position; sum the tokens of (block, queue), which is small, and
take prefix sums per queue; cut every document where windows and sequences end. The ids are never shuffled unless there are
too many (block, queue) rows for a broadcast join.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are not read, so their names cannot clash. The string of a
special token of the tokenizer file is that token, as its library has it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm._common import documents, materialize

SEQUENCE, END_ID = 2048, 1
#: Entries of window and queue that a task holds at once, and bytes of text, unless one text is longer.
HELD, PART = 1 << 20, 1 << 20
_LOADED: dict[tuple[str, str], WordIds] = {}


class WordIds(dict):
    """Ids of space-led words as bytes, remembered up to a bound.

    The pre-tokenizer never lets a token reach over a single space into the next word, so a text without double spaces is
    encoded word by word.
    """

    def __init__(self, path: str, special: str, bound: int = 300_000):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(special, encoding="utf-8") as spec:
            self.special = {t["content"]: t["id"] for t in json.load(spec)["added_tokens"]}
        self.encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.dtype = np.dtype("<u2" if max([len(ranks), *self.special.values()]) < 1 << 16 else "<u4")
        self.bound = bound

    def direct(self, text: str) -> bytes:
        return np.asarray(self.encoder.encode(text, allowed_special="all", disallowed_special=()), dtype=self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.direct(f" {word}")
        if len(self) < self.bound and len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "  " in text or len(text) < 8 or any(t in text for t in self.special):
            return self.direct(text)
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # a trailing space belongs to white space before it
            return self.direct(text)
        return self.direct(first) + b"".join(map(self.__getitem__, rest))


def word_ids(path: str, special: str) -> WordIds:
    if (path, special) not in _LOADED:
        _LOADED[path, special] = WordIds(path, special)
    return _LOADED[path, special]


def forget() -> None:
    """Free the vocabulary and the words of a worker that has no more texts to encode: it outlives the stage."""
    _LOADED.clear()


def parts_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of about PART bytes of text: what is held as Python objects does not follow the batch."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART)) + 1
        yield batch.slice(at, to - at)
        at = to


def tokenize(docs: DataFrame, path: str, special: str, doc_id: str = "doc_id", text: str = "text", queue: str = "source") -> DataFrame:
    """doc_id, queue, block (the task), start in the block's queue, n_tokens and the ids, END_ID last."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block, spent = word_ids(path, special), TaskContext.get().partitionId(), {}
        end = np.asarray([END_ID], dtype=coder.dtype).tobytes()
        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            starts, counts, ids = [], [], []
            queues = batch.column(2).to_pylist()
            for body, q in zip(batch.column(1).to_pylist(), queues, strict=True):
                ids.append(coder.encode(body or "") + end)
                counts.append(len(ids[-1]) // coder.dtype.itemsize)
                starts.append(spent.get(q, 0))
                spent[q] = starts[-1] + counts[-1]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([block] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.dtype.itemsize] * n, pa.int32())],
                ["doc_id", "queue", "block", "start", "n_tokens", "ids", "width"],
            )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(queue).cast("string").alias("queue"))
    return picked.mapInArrow(run, f"doc_id {kind}, queue string, block int, start long, n_tokens long, ids binary, width int")


def shares_of(totals: list[int], weights: list[float] | None = None, least_share: float = 1 / 1024) -> np.ndarray:
    """The share of each queue: as the weights ask; without weights as the totals are, but least_share at least, so that the few
    tokens of a small source lie together instead of one in every window."""
    share = np.asarray(weights if weights else totals, dtype=float)
    share = share / max(share.sum(), 1e-12)
    return np.maximum(share, 1e-12) if weights else np.maximum(share, least_share)


class Schedule:
    """Where the tokens of each queue lie in the packed stream."""

    def __init__(self, totals: list[int], shares: np.ndarray, window_tokens: int):
        self.totals, self.shares = np.asarray(totals, dtype=np.int64), np.asarray(shares, dtype=float)
        dry = self.totals / self.shares  # the clock at which each queue runs dry
        order = np.argsort(dry, kind="stable")
        active = np.cumsum(self.shares[order][::-1])[::-1]  # shares of the queues that are not dry before
        self.clock = np.concatenate([[0.0], dry[order]])
        self.window = np.concatenate([[0.0], np.cumsum(np.diff(self.clock) * active / window_tokens)])

    def spent(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has spent after so many windows: one row per entry, one column per queue."""
        w = np.asarray(windows, dtype=float)
        clock = np.where(w > self.window[-1], np.inf, np.interp(w, self.window, self.clock))
        earned = np.where(np.isinf(clock)[:, None], self.totals[None, :], np.floor(np.where(np.isinf(clock), 0.0, clock)[:, None] * self.shares[None, :]))
        return np.minimum(earned.astype(np.int64), self.totals[None, :])

    def window_of(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The window in which a queue spends the token at a position, or one beside it where rounding decides."""
        return np.maximum(np.ceil(np.interp((position + 1) / self.shares[queue], self.clock, self.window)).astype(np.int64) - 1, 0)

    def pieces(self, queue: np.ndarray, position: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Row, start in the row, length and packed position of each piece, cut where windows and sequences end."""
        first, last = np.maximum(self.window_of(queue, position) - 1, 0), self.window_of(queue, position + count - 1) + 1
        row = np.repeat(np.arange(len(queue)), last - first + 1)
        window = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
        own = queue[row]
        lo, hi, place = (np.zeros(len(row), dtype=np.int64) for _ in range(3))
        step = max(1, HELD // len(self.totals))
        for a in range(0, len(row), step):
            here = slice(a, a + step)
            before, after = self.spent(window[here]), self.spent(window[here] + 1)
            mine, at = own[here], np.arange(len(before))
            lo[here] = np.maximum(before[at, mine], position[row[here]])
            hi[here] = np.minimum(after[at, mine], position[row[here]] + count[row[here]])
            ahead = np.cumsum(after - before, axis=1)[at, mine] - (after - before)[at, mine]
            place[here] = before.sum(axis=1) + ahead + lo[here] - before[at, mine]
        some = hi > lo
        row, start, size, place = row[some], (lo - position[row])[some], (hi - lo)[some], place[some]
        # cut at the ends of sequences
        parts = (place + size - 1) // length - place // length + 1
        of = np.repeat(np.arange(len(row)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.maximum(place[of], (place[of] // length + k) * length)
        stop = np.minimum(place[of] + size[of], (place[of] // length + k + 1) * length)
        row, start, size = row[of], start[of] + begin - place[of], stop - begin
        # join what was cut at the end of a window but lies on in the same sequence
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + size[:-1]) | (begin[1:] // length != begin[:-1] // length)
        if not len(row):
            return row, start, size, begin
        return row[new], start[new], np.add.reduceat(size, np.flatnonzero(new)), begin[new]


def pack(
    docs: DataFrame, path: str | None = None, special: str | None = None, targets: dict[str | None, float] | None = None, length: int = SEQUENCE,
    window_sequences: int = 32, doc_id: str = "doc_id", text: str = "text", queue: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    targets: token proportions by source; a source without one gets the smallest that is given. None: proportions of the corpus.
    path: ranks of the byte-level vocabulary; special: the tokenizer file that names its added tokens.
    """
    path, special = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), special or public_tokenizers.path("byte_bpe_50k.json")
    tokens = materialize(tokenize(docs, path, special, doc_id, text, queue), "tokens")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    sums = materialize(tokens.groupBy("block", "queue").agg(F.sum("n_tokens").alias("n")), "blocks")
    total = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row a source
    names = sorted(total, key=lambda q: (q is not None, q or ""))
    weights = [targets.get(q, min(targets.values())) for q in names] if targets else None
    plan = Schedule([total[q] for q in names], shares_of([total[q] for q in names], weights), window_sequences * length)

    # from Arrow: rows of Python objects would go through Python workers of their own, which stay
    index = spark.createDataFrame(pa.table({"queue": pa.array(names, pa.string()), "qi": pa.array(range(len(names)), pa.int32())}))
    numbered = sums.alias("s").join(index.alias("i"), F.col("s.queue").eqNullSafe(F.col("i.queue"))).select("s.block", "s.queue", "s.n", "i.qi")
    before = Window.partitionBy("qi").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(numbered.select("block", "queue", "qi", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "offsets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what is held at once
                part = batch.slice(at, 512)
                qi, position, count = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
                row, start, size, place = plan.pieces(qi, position, count, length)
                width = part.column(5).to_pylist()
                wide = [np.frombuffer(x, dtype=f"<u{w}").astype("<u4").tobytes() for x, w in zip(part.column(4).to_pylist(), width, strict=True)]
                ids = [wide[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), pa.array(count[row]), pa.array(place // length), pa.array(place % length)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    placed = tokens.alias("t").join(
        offsets.alias("o"), (F.col("t.block") == F.col("o.block")) & F.col("t.queue").eqNullSafe(F.col("o.queue"))
    )
    return placed.select("t.doc_id", "o.qi", (F.col("o.base") + F.col("t.start")).alias("position"), "t.n_tokens", "t.ids", "t.width").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
