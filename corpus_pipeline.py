"""The corpus pipeline: toxicity, line deduplication, near duplicates, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import materialize
from leadloom.llm.jaccard_join import near_duplicates
from leadloom.llm.line_dedup import dedup_lines
from leadloom.llm.packing import pack
from leadloom.llm.pii import find_pii, redact_pii
from leadloom.llm.toxicity import score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score as toxic go; the grammar is learned from the labelled rows of this stage's input."""
    scored = score_documents(docs.select(*COLUMNS), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left goes with them, one that never had words stays."""
    out = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\x0b\f\r", "     ")) == "")
    return _like_documents(out.where(~emptied | emptied.isNull()))


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, 0.8) the document of the smallest doc_id stays."""
    found = near_duplicates(docs)
    drop = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(drop, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _like_documents(redact_pii(find_pii(docs.select(*COLUMNS))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, mixed by source."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_documents),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Learned weights and token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
