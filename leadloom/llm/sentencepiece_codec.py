"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation maximises the sum of piece scores. The forward pass follows the pieces that start at each position, keeps
only the positions that a piece could still start from or end at (about the longest piece's length) and, as soon as the
backpointer paths of all of them share a boundary, commits the ids up to it. Memory is bounded by that window, not by the text.
A space mark starts a piece and never stands inside one (but for runs of marks), so all paths meet before each word: a memory
of words, bounded in number, stands in front of the search and holds its ids for the stretches it has already been through.

The scores are the model file's. For a file of merge ranks, such as the default, this is the segmentation of the best total
score over the same pieces, not the library's merge order: see the README.

Defined results: a null text gives null ids, an empty one none; characters without a piece become byte pieces; decoding
replaces bytes that are not UTF-8; a text that itself holds the space mark U+2581 decodes to spaces; repeated rows are coded
one by one; an empty table stays empty; extra columns are carried through, save one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from leadloom.llm._common import documents

MARK, LEAST = "▁", float("-inf")
_LOADED: dict[str, Model] = {}


class StreamingViterbi:
    """Takes text in parts and yields ids as soon as they are certain."""

    def __init__(self, model: Model):
        self.pieces, self.begins, self.single = model.pieces, model.begins, model.single
        self.longest, self.unknown, self.without = model.longest, model.unknown, model.without_piece
        self.text, self.done, self.widest = "", 0, 0  # the characters from the last commit on; positions whose pieces are followed
        self.best, self.back, self.ids = [0.0], [0], [-1]  # of each boundary from the last commit on

    def feed(self, chars: str) -> Iterator[int]:
        for i in range(0, len(chars), 2 * self.longest):
            self._extend(chars[i : i + 2 * self.longest])
            self._follow(len(self.text) - self.longest)
            if self.done > self.longest:
                yield from self._commit()

    def finish(self, chars: str = "") -> list[int]:
        """The rest, of a last stretch too if it is short."""
        self._extend(chars)
        self._follow(len(self.text))
        return self._path(len(self.text))

    def _extend(self, chars: str) -> None:
        n = len(chars)
        self.text += chars
        self.best += [LEAST] * n
        self.back += [0] * n
        self.ids += [-1] * n
        if len(self.text) > self.widest:
            self.widest = len(self.text)

    def _follow(self, limit: int) -> None:
        """Follow the pieces that start before limit."""
        text, best, back, ids, get, begins, single, unknown = self.text, self.best, self.back, self.ids, self.pieces.get, self.begins, self.single, self.unknown
        n = len(text)
        for begin in range(self.done, limit):
            so_far = best[begin]
            if so_far == LEAST:
                continue  # no path comes here
            end = begin + 1
            piece = text[begin]
            if piece not in single and so_far + unknown > best[end]:
                best[end], back[end], ids[end] = so_far + unknown, begin, -1
            while piece in begins:
                known = get(piece)
                if known is not None:
                    value = so_far + known[1]
                    if value > best[end]:
                        best[end], back[end], ids[end] = value, begin, known[0]
                end += 1
                if end > n:
                    break
                piece = text[begin:end]
        self.done = max(self.done, limit)

    def _commit(self) -> Iterator[int]:
        """Follows the paths of all live boundaries back until they meet, and gives out what lies before."""
        live = {p for p in range(self.done, min(len(self.text), self.done + self.longest) + 1) if self.best[p] > LEAST}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last])
        meet = live.pop()
        if meet > 0:
            yield from self._path(meet)
            self.text, self.done = self.text[meet:], self.done - meet
            self.best = [x - self.best[meet] for x in self.best[meet:]]
            self.back = [0, *(max(x - meet, 0) for x in self.back[meet + 1 :])]
            self.ids = self.ids[meet:]

    def _path(self, end: int) -> list[int]:
        out, back, ids = [], self.back, self.ids
        while end > 0:
            i = ids[end]
            if i >= 0:
                out.append(i)
            else:
                out += self.without(self.text[back[end]])[::-1]
            end = back[end]
        return out[::-1]


class Model(dict):
    """The pieces of a model file; as a dict, the ids (int32 as bytes) of words seen before, bound of them at most."""

    def __init__(self, path: str, bound: int = 800_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(n) if not kinds[i] and not model.is_byte(i)}
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.unk = model.unk_id()
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10.0
        self.output = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.output[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.output[i] = bytes([b])
        self.outputs = pa.array(self.output, pa.large_binary())
        self.bound = bound

    def without_piece(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def segment(self, text: str) -> list[int]:
        """Any text, in a window of bounded length."""
        search = StreamingViterbi(self)
        if len(text) <= 2 * self.longest:
            return search.finish(text)
        return [*search.feed(text), *search.finish()]

    def __missing__(self, word: str) -> bytes:
        short = len(word) < 64
        ids = np.asarray(self.segment(MARK + word), dtype=np.int32).tobytes()
        if short and len(self) < self.bound:
            self[word] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text:  # runs of marks: no certain boundaries
            return np.asarray(self.segment(MARK + text.replace(" ", MARK)), dtype=np.int32).tobytes()
        return b"".join(map(self.__getitem__, text.split(" ")))

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int] | None) -> str | None:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_lists(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each row's ids: the bytes of all ids are taken at once and cut where rows end."""
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        taken = self.outputs.take(flat)
        starts = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
        data = memoryview(taken.buffers()[2] or b"")
        ends = starts[np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])].tolist()
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [None if null else t[1:] if t[:1] == " " else t for t, null in zip(texts, ids.is_null().to_pylist(), strict=True)]


def model_of(path: str) -> Model:
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model_of(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                coded = [None if t is None else coder.encode_bytes(t) for t in batch.column(at).to_pylist()]
                ends = np.cumsum([0, *(len(x or b"") // 4 for x in coded)]).astype(np.int32)
                flat = np.frombuffer(b"".join(x or b"" for x in coded), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in coded]))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    coded = coded.drop(text)
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model_of(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = coder.decode_lists(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return coded.mapInArrow(run, StructType([*coded.schema, StructField(text, StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, their digest, and whether decoding them gives the text back."""
    coded = decode(encode(documents(spark, sf_dir).select("doc_id", "text")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.hex(F.xxhash64("ids")).alias("ids_digest"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )
