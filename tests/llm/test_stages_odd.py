"""Each stage of the pipeline on odd rows and on an empty table."""

import corpus_pipeline
import pytest

ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t", "de", "a", 3), (4, "same words in this line of text\nsame words in this line of text", "en", "b", 9), (5, "same words in this line of text", "en", "a", 1), (5, "same words in this line of text", "en", "a", 1), (None, "write to ann@mail.example now", "en", "a", 1), (6, "x" * 50_000, "fr", None, 1), (7, "a\tb\x0bc  d", "es", "c", 2)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for frame, n in ((docs, len(ODD)), (docs.limit(0), 0)):
        rows = stage(spark, frame, "/root/testdata/sf0.001").collect()
        if name == "packing":
            assert len({r.doc_id for r in rows}) == len({r[0] for r in ODD}) if n else not rows
            continue
        assert len(rows) <= n
        kept = {r.doc_id for r in rows}
        # rows without words, without an identifier and of one long word are clean and stay
        assert {1, 2, 3, 6, 7, None} <= kept if n else not kept
        if name == "line_dedup" and n:
            assert {r.text for r in rows if r.doc_id == 4} == {"same words in this line of text"} and 5 not in kept
        if name == "near_duplicates" and n:
            assert 4 in kept
        if name == "personal_data" and n:
            assert {r.text for r in rows if r.doc_id is None} == {"write to [EMAIL] now"}
