"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (one base64 token and its rank a line) becomes a BPE model of that library: every byte is written as one printable
character, a token of more bytes is every pair of tokens that it can be put together from, in the order of ranks, and a piece
that is a token itself is that token. The pre-tokenizer cuts a text by the pattern and maps the bytes of each match; matches
are encoded by themselves. Offsets are those of the library: code points of the text, where a token that holds a part of a
character covers the whole character.

Decoding takes every token's characters back to bytes by the reversed table. A character may be split over tokens: bytes are
joined before they are read as UTF-8, and token_texts gives a split character to the token that completes it.

Texts are taken in parts of bounded size and long ones are cut where no match of the pattern can go on, so that memory follows
the ids of the longest text. A pattern given instead must have that property too: no match with white space after another character.

Defined results: a null or empty text has no ids and decodes to an empty one; bytes of a text that are not UTF-8 count as
U+FFFD; the string of a special token is ordinary text; ids that the file does not have are an error; null ids decode to null;
repeated rows are coded one by one; an empty table stays empty; extra columns are carried through, save those named like a result.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from leadloom.llm._common import documents

#: Bytes of text that a task holds at once, unless one text is longer, and characters that the library encodes at once.
PART, HELD = 1 << 20, 1 << 17
#: Characters from which on a text is cut before white space that follows another character.
LONG = 1 << 16
_CUT = re.compile(r"(?<=\S)[ \t\n\r]")
_LOADED: dict[tuple[str, str], Coder] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One vocabulary: the library's tokenizer, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        to_char = byte_characters()
        ranks = read_ranks(path)
        written = lambda token: "".join(map(to_char.__getitem__, token))
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(ranks[a], ranks[b], written(a), written(b)) for a, b in cuts if a in ranks and b in ranks]
            merges += [(a, b) for *_, a, b in sorted(known)]
        self.tokenizer = Tokenizer(models.BPE(vocab={written(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        to_byte = {c: b for b, c in enumerate(to_char)}
        self.bytes_of = {i: bytes(map(to_byte.__getitem__, t)) for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str], offsets: bool = False) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """The ids of each text and, if asked for, where they start and stop (one row each)."""
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        spans: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, str]] = []

        def flush() -> None:
            coded = (self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast)([p for _, _, p in held], add_special_tokens=False)
            for (i, begin, _), e in zip(held, coded, strict=True):
                ids[i].append(np.asarray(e.ids, dtype="<u4"))
                if offsets:
                    spans[i].append(np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2) + begin)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for begin, piece in pieces(text):
                held.append((i, begin, piece))
                size += len(piece)
                if size > HELD:
                    flush()
                    size = 0
        flush()
        return [(x[0] if len(x) == 1 else np.concatenate(x), (s[0] if len(s) == 1 else np.concatenate(s)) if offsets else None) for x, s in zip(ids, spans, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def texts(self, ids: list[int]) -> list[str]:
        """The text of each token; a character split over tokens belongs to the one that completes it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes_of[i]) for i in ids]
        if out:
            out[-1] += reader.decode(b"", final=True)
        return out


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """A long text in parts, each with its place. No match goes on from another character into white space, so none is cut."""
    begin = 0
    while len(text) - begin > LONG and (cut := _CUT.search(text, begin + LONG)):
        yield begin, text[begin : cut.start()]
        begin = cut.start()
    yield begin, text[begin:]


def coder_of(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Coder(path, pattern)
    return _LOADED[path, pattern]


def _parts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """From, to and the texts of stretches of a column of about PART bytes."""
    held, at, size = [], 0, 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        raw = value.as_py() or b""
        held.append(raw.decode("utf-8", "replace"))
        size += len(raw)
        if size >= PART or i + 1 == len(column):
            yield at, i + 1, held
            held, at, size = [], i + 1, 0


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids", offsets: str | None = None, packed: bool = False
) -> DataFrame:
    """Adds the ids of each text, as an array or (packed) as little-endian unsigned 32-bit integers.

    offsets: a column for the code points where each token starts and ends, as struct of two arrays.
    """
    path, pattern = _default(path, pattern)
    docs = docs.drop(ids, *([offsets] if offsets else []))
    at = docs.columns.index(text)
    ends = StructType([StructField("starts", ArrayType(IntegerType())), StructField("stops", ArrayType(IntegerType()))])
    schema = StructType([*docs.schema, StructField(ids, BinaryType() if packed else ArrayType(IntegerType())), *([StructField(offsets, ends)] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for batch in batches:
            for a, b, texts in _parts(batch.column(at)):
                coded = coder.encode(texts, bool(offsets))
                found = [x for x, _ in coded]
                new = [pa.array([x.tobytes() for x in found], pa.binary()) if packed else _lists([x.astype(np.int32) for x in found], pa.int32())]
                if offsets:
                    new.append(pa.StructArray.from_arrays([_lists([s[:, i].astype(np.int32) for _, s in coded], pa.int32()) for i in (0, 1)], ["starts", "stops"]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def _ids(value: pa.Scalar) -> list[int] | None:
    """Ids of an array or of packed integers."""
    if not value.is_valid:
        return None
    return np.frombuffer(value.as_buffer(), dtype="<u4").tolist() if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type) else value.as_py()


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids; cast to string, they are its text."""
    path, pattern = _default(path, pattern)
    coded = coded.drop(decoded)
    at = coded.columns.index(ids)
    schema = StructType([*coded.schema, StructField(decoded, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                values = [None if x is None else coder.decode(x) for x in map(_ids, batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=schema.names)

    return coded.mapInArrow(run, schema)


def token_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per token: doc_id, place (from 0), id, start and stop in code points, and the text that the token completes."""
    path, pattern = _default(path, pattern)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"]
    whole = [StructField(n, LongType()) for n in ("place", "id", "start", "stop")]
    schema = StructType([StructField("doc_id", kind.dataType), *whole, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for batch in batches:
            for a, _, texts in _parts(batch.column(1)):
                for r, (ids, ends) in enumerate(coder.encode(texts, True)):
                    row = pa.array(np.full(len(ids), a + r))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), pa.array(np.arange(len(ids))), pa.array(ids.astype(np.int64)), pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(coder.texts(ids.tolist()), pa.string())], names=schema.names
                    )

    return picked.mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), packed=True).drop("text"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
