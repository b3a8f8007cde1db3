"""Decoding of whole lists of ids."""

import time

import numpy as np
import public_tokenizers
import pyarrow as pa

from leadloom.llm import sentencepiece_codec


def test_sentencepiece_decodes_lists_of_ids_at_once():
    """Bad bytes, bare bytes and nulls come out as from a loop over the ids, in less than half of the time of making them Python integers."""
    model = sentencepiece_codec.Model(public_tokenizers.path("piece_bpe_32k.model"))
    byte = model.byte_ids
    rows = [None, [], [byte[0xC3]], [byte[0xC3], byte[0xA9]], model.encode(" two  spaces"), None, model.encode("plain words é 日本"), []]
    ids = pa.array([[1], *rows, [2]], pa.list_(pa.int32())).slice(1, len(rows))
    plain = [None if r is None else b"".join(model.output[i] for i in r).decode("utf-8", "replace") for r in rows]
    assert model.decode_lists(ids) == [t if not t or t[0] != " " else t[1:] for t in plain] == [model.decode(r) for r in rows]
    many = pa.array([np.arange(300, 1300, dtype=np.int32)] * 1000)
    began = time.process_time()
    many.to_pylist()
    loop = time.process_time() - began
    began = time.process_time()
    assert len(set(model.decode_lists(many))) == 1
    assert 2 * (time.process_time() - began) < loop
