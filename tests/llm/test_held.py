"""What a worker holds does not follow the batches it is given."""

import numpy as np
import pyarrow as pa

from leadloom.llm import jaccard_join, packing


def test_text_hashing_keeps_little_between_tasks():
    line = "some words that are hashed in parts of bounded size "
    for texts in ([line * 400] * 400, [line * 200_000]):  # 8 MB in many texts, 10 MB in one
        sets = list(jaccard_join.text_sets(pa.array(texts), 5))
        assert all(np.array_equal(s, sets[0]) for s in sets) and len(sets[0]) == 10
        assert sum(a.nbytes for pair in jaccard_join._POWERS.values() for a in pair) < 20 << 20


def test_packing_takes_a_batch_in_parts_of_bounded_text():
    texts = [None, "x" * 3_000_000, "", *["y" * 10_000] * 500, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for whole in (batch, batch.slice(2), batch.slice(0, 0)):
        parts = list(packing.parts_of(whole, 1))
        assert [i for p in parts for i in p.column(0).to_pylist()] == whole.column(0).to_pylist()
        assert all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < packing.PART for p in parts)


def test_packing_frees_its_vocabulary_and_starts_no_other_workers(spark, monkeypatch):
    tasks, real = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, *a, **b: tasks.append(run) or real(self, run, *a, **b))
    docs = spark.createDataFrame([(1, "some words", "a"), (2, "more of them", None), (3, None, "b")], "doc_id long, text string, source string")
    for frame, n in ((docs, 3), (docs.limit(0), 0)):
        packed = packing.pack(frame)
        assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
        assert len({r.doc_id for r in packed.collect()}) == n
    packing.word_ids(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.public_tokenizers.path("byte_bpe_50k.json"))
    list(tasks[-1](iter([])))
    assert not packing._LOADED
