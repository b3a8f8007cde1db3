"""Byte-level BPE against the library whose ranks the file holds, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leadloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in byte_bpe.documents(spark, sf_dir).select("doc_id", "text").collect()}
    got = byte_bpe.op12_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_random_texts(library):
    """Runs of one character, tokens put end to end, and characters of all planes."""
    coder, rng = byte_bpe.coder_of(PATH, public_tokenizers.PATTERN), random.Random(3)
    tokens = [t.decode("utf-8", "ignore") for t in byte_bpe.read_ranks(PATH)]
    for _ in range(5000):
        kind = rng.random()
        if kind < 0.3:
            text = "".join(rng.choice("aA =-_.\n\t 　") * rng.randint(1, 9) for _ in range(6))
        elif kind < 0.6:
            text = "".join(rng.choice(tokens) for _ in range(6))
        else:
            text = "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) if rng.random() < 0.4 else rng.choice("ab's 1") for _ in range(12))
        [(ids, _)] = coder.encode([text])
        ids = ids.tolist()
        assert ids == library.encode_ordinary(text), text
        assert coder.decode(ids).decode() == text and "".join(coder.texts(ids)) == text


def test_long_texts_are_cut_between_matches(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 7)
    monkeypatch.setattr(byte_bpe, "HELD", 20)
    coder, rng = byte_bpe.coder_of(PATH, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "don't", " ", "  ", "\n", "\t", "!", "7", "\x1c", "\u3000", "\u0085", "é"]) for _ in range(rng.randint(0, 60)))
        [(ids, spans)] = coder.encode([text], True)
        assert ids.tolist() == library.encode_ordinary(text) and coder.decode(ids.tolist()).decode() == text
        assert len(spans) == len(ids) and all(library.decode_single_token_bytes(i) in text[a:b].encode() for i, (a, b) in zip(ids.tolist(), spans.tolist(), strict=True))


def test_split_characters_and_offsets(spark, library):
    text = "a\U0001f9dc‍♀️ 乕龘 naïve"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(byte_bpe.token_texts(docs).collect(), key=lambda r: r["place"])
    ids = library.encode_ordinary(text)
    assert [r["id"] for r in rows] == ids and "".join(r["text"] for r in rows) == text
    split = [r for r in rows if r["text"] == ""]
    assert split and all(r["stop"] > r["start"] for r in split)  # a part of a character covers the character
    for r in rows:
        raw = library.decode_single_token_bytes(r["id"])
        assert raw in text[r["start"] : r["stop"]].encode()
    with_offsets = byte_bpe.encode(docs, offsets="at").first()
    assert with_offsets["ids"] == ids and with_offsets["at"]["starts"] == [r["start"] for r in rows]
    coder = byte_bpe.coder_of(PATH, public_tokenizers.PATTERN)
    assert coder.texts(ids[:2])[-1].endswith("�")  # cut inside a character


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "y"), (4, "w" * 300_000, None), (4, "w" * 300_000, None), (None, " \n\n  a", "z"), (5, "word " * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(docs)).select("doc_id", "text", "ids", F.col("decoded").cast("string").alias("back")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["back"] == (r["text"] or "")
        if r["doc_id"] != 4:
            assert r["ids"] == library.encode_ordinary(r["text"] or "")
    broken = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(x'61ff62' as string)").alias("text"))
    assert byte_bpe.decode(byte_bpe.encode(broken)).first()["decoded"].decode() == "a�b"
    nothing = docs.where("false")
    assert byte_bpe.decode(byte_bpe.encode(nothing, packed=True)).count() == 0 and byte_bpe.token_texts(nothing).count() == 0
    assert byte_bpe.decode(spark.sql("select cast(null as array<int>) as ids")).first()["decoded"] is None
