"""Quality rules with host-level verdicts.

Document rules are counted in one pass of built-in expressions. Rule failures are then aggregated by host (domain), each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and the host's
verdict is joined back to its documents. Everything stays in DataFrame expressions.

Defined results: a null or empty text has no words, so it fails the length rule; a null host is a host of its own;
repeated rows are judged one by one; an empty table gives an empty result; extra columns are carried through untouched
unless they carry the name of a result column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import documents, let, materialize, shingles, words

SYMBOLS = "#*$%&|<>"


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Words covered by windows that occur twice or more, the first occurrence included."""

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(
            starts,
            F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))),
            lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))).cast("long"),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def starts(pairs: Column) -> Column:
        n = F.greatest(F.size(pairs) - 1, F.lit(0))
        same = F.zip_with(
            F.slice(pairs, F.lit(1), n),
            F.slice(pairs, F.lit(2), n),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        )
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, starts), covered)
        ).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(ws) >= window, let(shingles(ws, window), counted)).otherwise(F.lit(0).cast("long"))


def document_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Per-document counts and the base verdict, without the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(body, chars, ""))
    full_lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    counted = docs.withColumns(
        {
            "n_words": F.size(words(F.col(text))).cast("long"),
            "word_chars": without(" \t\n\x0b\f\r").cast("long"),
            "n_symbols": (F.length(body) - without(SYMBOLS)).cast("long"),
            "n_lines": F.size(full_lines).cast("long"),
            "n_dup_lines": let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(words(F.col(text)), repeated_words),
        }
    ).drop(text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return counted.withColumn("base_failed", base)


def host_verdicts(
    ruled: DataFrame, host: str, max_host_rate: float = 0.5, symbol_pct: int = 10, dup_line_pct: int = 30
) -> DataFrame:
    """One row per host: documents, failures, the shrunk failure rate and the verdict.

    A document fails when any rule fails: the base verdict, symbols above symbol_pct per 100 words, or repeated lines
    above dup_line_pct per 100 lines. Documents are aggregated map-side first, so a host with a third of all rows is
    one partial row per task.
    """
    failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > symbol_pct * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > dup_line_pct * F.col("n_lines"))
    )
    hosts = ruled.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("long")).alias("host_failures")
    )
    # rates to twelve places add up alike in any order
    rate = (F.col("host_failures") / F.col("host_docs")).cast("decimal(16,12)")
    chance = (F.col("rate") * (1 - F.col("rate")) / F.col("host_docs")).cast("decimal(16,12)")
    rates = hosts.select(rate.alias("rate"), "host_docs")
    square = (F.col("rate") * F.col("rate")).cast("decimal(16,12)")
    sums = rates.agg(F.count("rate").alias("n"), F.sum("rate").alias("r"), F.sum(square).alias("r2"), F.sum(chance).alias("c")).first()
    n = max(sums["n"], 1)
    average, noise = float(sums["r"] if sums["n"] else 0.5) / n, float(sums["c"] or 0) / n
    mean = min(max(average, 1e-6), 1 - 1e-6)
    # method of moments: what varies between hosts beyond chance fixes the prior's strength, between 1 and 10^6 documents
    between = max(float(sums["r2"] or 0) / n - average * average - noise, 1e-9)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    shrunk = (F.col("host_failures") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_host_rate)


def apply_quality_rules(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Documents without their text, with rule counts, base_failed, the host's shrunk rate and kept.

    Columns of docs named host_rate, host_ok or kept are replaced; all others stay as they are.
    """
    ruled = materialize(document_rules(docs, text), "quality")
    verdicts = host_verdicts(ruled, host, **limits).select("host", "host_rate", "host_ok")
    clash = [c for c in ("host_rate", "host_ok", "kept") if c in ruled.columns]
    own = ruled.drop(*clash)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00none"))
    left = own.select(F.struct(*own.columns).alias("row"), key(host).alias("joined_host"))
    right = verdicts.select(key("host").alias("joined_host"), "host_rate", "host_ok")
    return left.join(right, "joined_host", "left").select(
        "row.*", "host_rate", "host_ok", (~F.col("row.base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l
           FROM documents),
c AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
b AS (SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(r.n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM c LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*) AS n,
             sum(CASE WHEN base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines THEN 1 ELSE 0 END) AS k
      FROM b GROUP BY source),
p AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_pop(k / n), 0) - coalesce(avg(k / n * (1 - k / n) / n), 0) AS v FROM h),
q AS (SELECT m, least(greatest(m * (1 - m) / greatest(v, 1e-9) - 1, 1.0), 1e6) AS a FROM p),
o AS (SELECT source, (k + m * a) / (n + a) <= 0.5 AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source
"""
