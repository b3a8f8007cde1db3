"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the word classes of a clause: insult, threat, target, negation and reported speech. They are
composed into one machine, whose final state names the kind of clause: a plain or targeted insult, a plain or targeted threat,
abuse that is negated, abuse that is reported. A document's score is a logistic function of its matched clauses, with a weight
for each kind.

The word classes are the fixed words below plus insults learned from labelled rows: words and stems that occur almost only
in toxic documents, in many different contexts (so that copies of one document teach nothing). Words of every length and place
count, and every word and stem that meets the criteria is kept. The weights are fitted to all labelled training rows. Learning
reads max_labelled rows, if there are more; that alone bounds what comes to the driver: the learned terms, each of which needs
min_support of those rows, and the distinct clause counts of those rows. Every clause of a text counts, on a logarithmic scale,
so that each further one says less. Rows whose crc32(doc_id)
mod 5 is 0 are never learned from.

Defined results: a null or empty text has no clauses and gets the score of a text without any; a null doc_id is scored
and counts as not held out; repeated rows are scored one by one; without labels the default weights hold; other columns are
not read by the score.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import documents, let, materialize

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of the grammar in the languages of the corpus.
WORDS = {
    INSULT: "idiot idiots moron morons stupid clown clowns loser losers scum trash pathetic disgusting worthless imbecile dummkopf trottel abschaum crétin ordure imbécil basura escoria".split(),
    THREAT: "kill murder strangle slaughter annihilate umbringen töten tuer matar".split(),
    TARGET: "you your yours he she they them their people du dich euch sie tu toi vous ils tú usted ellos".split(),
    NEGATION: "not never no nicht kein keine nie ne pas jamais nunca".split(),
    REPORT: "said says wrote claimed reported quoted sagte schrieb dit écrit dijo escribió".split(),
}
KINDS = ("insult", "targeted_insult", "threat", "targeted_threat", "negated", "reported")
DEFAULT = (-2.0, 2.5, 3.0, 2.5, 3.5, 1.0, 1.0)
CLAUSE, WORD = re.compile(r"[.!?;\n]+"), re.compile(r"[^\W\d_]+")

#: One transducer each: (state, class) -> state; where no step is given the machine stays.
SEEN = {(0, 1): 1}
TRANSDUCERS = {
    "insult": {(0, INSULT): 1},
    "threat": {(0, THREAT): 1},
    "target": {(0, TARGET): 1},
    # a negation reaches three words ahead: states 3, 2, 1 count down, 4 means that it met abuse
    "negation": {(s, NEGATION): 3 for s in (0, 1, 2, 3)} | {(s, c): 4 for s in (1, 2, 3) for c in (INSULT, THREAT)} | {(s, c): s - 1 for s in (1, 2, 3) for c in (OTHER, TARGET, REPORT)},
    # a verb of saying before the abuse: 1, and 2 once the abuse is met
    "report": {(0, REPORT): 1, (1, INSULT): 2, (1, THREAT): 2},
}


def compose() -> tuple[list[list[int]], list[int]]:
    """The product of the transducers: next state by state and class, and each state's clause kind (0: none)."""
    start = (0,) * len(TRANSDUCERS)
    states, queue, table = {start: 0}, [start], []
    while len(table) < len(queue):
        here = queue[len(table)]
        row = []
        for c in range(6):
            there = tuple(t.get((s, c), s) for s, t in zip(here, TRANSDUCERS.values(), strict=True))
            if there not in states:
                states[there] = len(states)
                queue.append(there)
            row.append(states[there])
        table.append(row)
    kinds = []
    for insult, threat, target, negation, report in queue:
        if not (insult or threat):
            kinds.append(0)
        elif negation == 4:
            kinds.append(5)
        elif report == 2:
            kinds.append(6)
        else:
            kinds.append((3 if threat else 1) + (1 if target else 0))
    return table, kinds


@dataclass(frozen=True)
class Grammar:
    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    weights: tuple[float, ...] = field(default=DEFAULT)


class Matcher:
    """Counts the clauses of each kind in a text."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.classes = {w: c for c, ws in WORDS.items() for w in ws} | dict.fromkeys(grammar.words, INSULT)
        self.stems, self.lengths = set(grammar.stems), sorted({len(s) for s in grammar.stems})
        self.table, self.kinds = compose()
        self.any = ahocorasick.Automaton()
        for w in itertools.chain((w for w, c in self.classes.items() if c in (INSULT, THREAT)), self.stems):
            self.any.add_word(w, 1)
        self.any.make_automaton()

    def class_of(self, word: str) -> int:
        found = self.classes.get(word)
        if found is None:
            return INSULT if any(word[:n] in self.stems for n in self.lengths) else OTHER
        return found

    def counts(self, text: str | None) -> list[int]:
        out = [0] * len(KINDS)
        lowered = (text or "").lower()
        if not lowered or next(self.any.iter(lowered), None) is None:
            return out
        for clause in CLAUSE.split(lowered):
            if clause and next(self.any.iter(clause), None) is not None:
                state = 0
                for word in WORD.findall(clause):
                    state = self.table[state][self.class_of(word)]
                if kind := self.kinds[state]:
                    out[kind - 1] += 1
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, max_labelled: int = 200_000) -> DataFrame:
    """Labels to learn from: all, or about max_labelled picked by the hash of their doc_id. So bounded, they are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (max_labelled << 20) // n)
    return F.broadcast(known)


def learn_words(
    docs: DataFrame, labels: DataFrame, min_support: int = 8, min_precision: float = 0.9, stem_precision: float = 0.97, max_labelled: int = 200_000
) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic training documents; words that such a stem covers are left out."""
    body = docs.select("doc_id", "text").join(training_labels(labels, max_labelled), "doc_id")
    ws = F.split(F.lower("text"), r"[^\p{L}]+")
    before = F.concat(F.array(F.lit("")), ws)  # one longer than ws: its last pair has no word and goes with the empty ones
    pairs = F.array_sort(F.zip_with(ws, before, lambda word, prev: F.struct(F.coalesce(word, F.lit("")).alias("word"), prev.alias("prev"))))
    # each word once per document, whatever its length
    once = let(pairs, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["word"] != x["word"])))
    seen = body.select("toxic", F.explode(once).alias("p")).select("toxic", "p.word", F.pmod(F.hash("p.prev"), F.lit(63)).alias("bit")).where(F.col("word") != "")
    many = lambda k: F.bit_count("contexts") * 2 >= F.least(k, F.lit(40))
    vocabulary = materialize(
        seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("contexts")), "vocabulary"
    )
    terms = lambda df, c: sorted(r[c] for r in df.select(c).collect())
    marked = vocabulary.where((F.col("k") >= min_support) & (F.col("k") >= min_precision * F.col("n")) & many(F.col("k")))
    prefixes = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(6)), lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "word", "n", "k", "contexts").where(F.length("word") > F.length("stem"))
    stems = (
        prefixes.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("forms"), F.bit_or("contexts").alias("contexts"))
        .where((F.col("forms") >= 5) & (F.col("k") >= 3 * min_support) & (F.col("k") >= stem_precision * F.col("n")) & many(F.col("k")))
    )
    chosen: list[str] = []
    for s in sorted(terms(stems, "stem"), key=len):
        if not any(s.startswith(c) for c in chosen):
            chosen.append(s)
    cover = tuple(chosen)
    return [w for w in terms(marked, "word") if not (cover and w.startswith(cover))], chosen


def clause_counts(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Adds clauses: how many of each kind."""

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(grammar)
        for texts in batches:
            yield pd.Series([matcher.counts(x) for x in texts], index=texts.index, dtype=object)

    return docs.withColumn("clauses", count(F.col(text)))


def fit_weights(counted: DataFrame, labels: DataFrame, max_labelled: int = 200_000) -> tuple[float, ...]:
    """Logistic regression by Newton's steps over the distinct clause counts of all training rows."""
    rows = counted.select("doc_id", "clauses").join(training_labels(labels, max_labelled), "doc_id").groupBy("clauses").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).collect()
    if not rows or sum(r["k"] for r in rows) in (0, sum(r["n"] for r in rows)):
        return DEFAULT
    x = np.asarray([[1, *np.log2(np.asarray(r["clauses"]) + 1.0)] for r in rows], dtype=float)
    n, k = (np.asarray([r[c] for r in rows], dtype=float) for c in ("n", "k"))
    w, ridge = np.asarray(DEFAULT), np.diag([1e-6, *[1.0] * len(KINDS)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (k - n * p) - ridge @ (w - np.asarray(DEFAULT))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, learned_from: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """docs with score and predicted. The grammar is learned from learned_from and labels."""
    words, stems = learn_words(learned_from, labels, **limits)
    grammar = Grammar(tuple(words), tuple(stems))
    counted = materialize(clause_counts(learned_from.select("doc_id", "text"), grammar).drop("text"), "clauses")
    weights = fit_weights(counted, labels)
    if docs is learned_from:
        scored = counted
    else:
        scored = clause_counts(docs, grammar)
    total = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        total = total + F.log2(F.col("clauses")[i] + F.lit(1.0)) * F.lit(w)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("clauses")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
