"""Line deduplication by an exact set-similarity join of lines.

A line is the set of its distinct 5-word shingles (a shorter line is one shingle). Lines of the same text are repeats and go first.

A cheap exact filter then leaves the lines that may match another. In one order of all words, a line shows the shingles that
begin with the first few of its words: so many that two lines within the threshold show several common ones, or all
that they have in common. A line that shows fewer shingles that another line shows too matches none. Windows are rows here,
which Spark compiles; only these shingles are hashed, and nothing is counted beforehand.

Of the lines left, those of the same set are collapsed. Tokens are ordered by rarity: counts of all their shingles in a table of
fixed size, then the hash. Two lines within the threshold share a token so early in this order that the rest of either line
still holds the overlap they need; pairs of such tokens are verified on whole sets. A line is removed when an earlier one (by doc_id, then line number) is of the same set or within
the threshold.

Candidates are verified in two rounds: each line against the earliest line it shares most tokens with; then the lines that
found no match, against all earlier lines of their tokens. A large family of near copies thus costs pairs in proportion to
its lines. Everything is DataFrame expressions: no Python runs on the executors.

Defined results: null texts stay null; lines without words are never removed; rows with a null doc_id take no part and stay
whole; rows that repeat a doc_id lose the same line numbers, each as soon as one row's line of that number repeats an earlier
one; an empty table stays empty; extra columns are carried through whatever their names, save n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import KeyFilter, discard, documents, let, materialize

#: Bits of the rarity table, a fixed size whatever the input. Beyond some 10^9 shingles its counters even out: then more pairs
#: are compared, and the result stays the same.
RARITY_BITS = 16
#: How many more shared shingles than one a match must show in the first filter, and percent of the windows besides: each costs
#: the line a shingle, and spares chance matches, of which long lines have more.
SPARE, SPARE_PERCENT = 1, 4
#: White space within lines, besides the space.
RARE_SPACE = "\t\x0b\f\r"


def words_of(line: Column) -> Column:
    """The words of a line."""
    rare = reduce(or_, (F.contains(line, F.lit(c)) for c in RARE_SPACE))  # compared as bytes; a pattern would decode every line
    plain = F.when(rare, F.translate(line, RARE_SPACE, "    ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def line_words(line: Column) -> Column:
    """Hashes of the words of a line."""
    return F.transform(words_of(line), lambda word: F.xxhash64(word))


def word_order(words: Column) -> Column:
    """Numbers for words, in whose order long words, which are rare, mostly come first. Equal numbers of unlike words lose no match."""
    return F.transform(words, lambda word: F.call_function("shiftrightunsigned", F.xxhash64(word), F.least(F.octet_length(word), F.lit(16))))


def line_key(doc_id: Column, line_no: Column) -> Column:
    return F.xxhash64(doc_id, line_no)


def line_shingles(line: Column, k: int) -> Column:
    """Hashes of the k-word windows of a line that has words, repeats included; with fewer words the whole line as one."""

    def windows(h: Column) -> Column:
        each = F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) >= k, each).otherwise(F.array(F.xxhash64(h)))

    return let(line_words(line), windows)


def shingle_rows(lines: DataFrame, k: int) -> DataFrame:
    """What line_shingles gives, as one row (token) each: windows are hashed by compiled code, not inside a lambda."""
    h, at = F.col("words"), F.col("at")
    rows = lines.select(line_words(F.col("line")).alias("words")).select("words", F.explode(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))).alias("at"))
    return rows.select(F.when(F.size(h) >= k, F.xxhash64(*[F.get(h, at + j) for j in range(k)])).otherwise(F.xxhash64(h)).alias("token"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line, of the lines with words."""
    each = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(F.ltrim("line", F.lit(f" {RARE_SPACE}")) != "")


def spare(n: Column) -> Column:
    return SPARE + F.floor(n * SPARE_PERCENT / 100).cast("int")


def shown(lines: DataFrame, k: int, percent: int) -> DataFrame:
    """line (a hash of doc_id and line_no), need (how many of its tokens a match shows at the least) and token, of the shingles that each line shows.

    They are those whose first word is among the line's first in one order of words, so that any two lines cut the same order. So
    many distinct first words begin as many distinct shingles at the least; a line with fewer words shows all it has.
    """
    w, n, at = F.col("w"), F.col("n"), F.col("at")
    rows = lines.select(line_key(F.col("doc_id"), F.col("line_no")).alias("line"), word_order(words_of(F.col("line"))).alias("w")).select("*", F.greatest(F.size(w) - (k - 1), F.lit(1)).alias("n"))
    rows = rows.select("*", F.sort_array(F.array_distinct(F.slice(w, F.lit(1), n))).alias("first"))
    fewest = F.ceil(F.size("first") * percent / 100).cast("int")  # a match has as many windows and shares as many shingles
    need = F.least(1 + spare(fewest), fewest)
    last = F.get("first", n - F.ceil(n * percent / 100).cast("int") + spare(n))
    rows = rows.select("line", "w", need.alias("need"), last.alias("last"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    token = F.when(F.size(w) >= k, F.xxhash64(*[F.get(w, at + j) for j in range(k)])).otherwise(F.xxhash64(w))
    return rows.where(F.col("last").isNull() | (F.get(w, at) <= F.col("last"))).select("line", "need", token.alias("token"))


def promising(lines: DataFrame, k: int, percent: int) -> DataFrame:
    """line, the hashes of the lines that show enough shingles that are shown twice; no other line matches one."""
    places = materialize(shown(lines, k, percent), "shown")
    common = materialize(places.groupBy("token").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("token"), "common")
    hits = KeyFilter(common).passing(places, F.col("token")).join(common, "token").groupBy("line").agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need"))
    left = materialize(hits.where("hits >= need").select("line"), "ends")
    discard(places, common)
    return left


def same_texts(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, s1 and s2 (hashes of the text) of the lines whose text an earlier line has."""
    key = [F.col("s1"), F.col("s2")]
    texts = materialize(lines.select("doc_id", "line_no", F.xxhash64("line").alias("s1"), F.hash("line").alias("s2")), "texts")
    twins = materialize(texts.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*key), "twins")
    maybe = materialize(KeyFilter(twins).passing(texts, *key), "maybe")
    first = maybe.groupBy(*key).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select(*key, "first")
    repeats = materialize(maybe.join(first, ["s1", "s2"]).where(F.struct("doc_id", "line_no") != F.col("first")).select("doc_id", "line_no", "s1", "s2"), "repeats")
    discard(texts, twins, maybe)
    return repeats


def without(lines: DataFrame, repeats: DataFrame) -> DataFrame:
    """The lines but those of same_texts; only lines that may be among them are shuffled."""
    key = ["doc_id", "line_no", "s1", "s2"]
    maybe = KeyFilter(repeats.select("doc_id", "line_no"))
    at = (F.col("doc_id"), F.col("line_no"))
    held = maybe.passing(lines, *at).select("*", F.xxhash64("line").alias("s1"), F.hash("line").alias("s2"))
    gone = repeats.distinct().select(*key, F.lit(True).alias("gone"))  # an anti-join would go below the filter
    return maybe.missing(lines, *at).unionByName(held.join(gone, key, "left").where("gone IS NULL").select(*lines.columns))


def rarity_table(lines: DataFrame, k: int) -> Column:
    """An array of constants: the binary logarithm of how often the shingles of each of 2^RARITY_BITS buckets occur in all lines."""
    bucket = F.shiftrightunsigned("token", 64 - RARITY_BITS)
    counts = shingle_rows(lines, k).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    if counts.num_rows:
        table[counts["bucket"].to_numpy()] = np.log2(counts["n"].to_numpy()).astype(np.int64) + 1
    return F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")


def by_rarity(tokens: Column, table: Column) -> Column:
    """Tokens as numbers whose order is rarity, then hash: seven bits of rarity and 56 of the hash."""
    rarity = lambda h: F.get(table, F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int"))
    ranked = F.transform(tokens, lambda h: F.coalesce(F.shiftleft(rarity(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), h))
    return F.sort_array(F.array_distinct(ranked))  # outside the lambda's argument, which Spark interprets with all that it holds


def possible(percent: int, n: Column, pos: Column, m: Column, qos: Column) -> Column:
    """Length and positional filter: whether lines of n and m tokens reach the threshold if what they share begins here.

    It holds for the first token that two matching lines share, so it may be asked of every token by itself.
    """
    need = percent * (n + m)
    return ((n - pos) * (100 + percent) >= need) & ((m - qos) * (100 + percent) >= need)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough: beyond them, at most one whole rest is shared. Prefixes are a fifth of the sets to move."""
    ends = ends_of(pairs)
    held = KeyFilter(ends).passing(classes.select("doc_id", "line_no", "n", "prefix"), F.col("doc_id"), F.col("line_no"))
    one, two = (held.select(F.col("doc_id").alias(f"{s}d"), F.col("line_no").alias(f"{s}l"), F.col("n").alias(f"{s}n"), F.col("prefix").alias(f"{s}p")) for s in "xy")
    rest = F.greatest(F.col("xn") - F.size("xp"), F.col("yn") - F.size("yp"))
    most = F.size(F.array_intersect("xp", "yp")) + rest
    return pairs.join(one, ["xd", "xl"]).join(two, ["yd", "yl"]).where(most * (100 + percent) >= percent * (F.col("xn") + F.col("yn"))).select("xd", "xl", "yd", "yl")


def line_sets(lines: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """doc_id, line_no and tokens of the lines named in ends, read from the texts again."""
    found = KeyFilter(ends).passing(lines, F.col("doc_id"), F.col("line_no")).join(ends, ["doc_id", "line_no"])  # ends are distinct; a semi-join would go below the filters
    sets = found.dropDuplicates(["doc_id", "line_no"]).select("doc_id", "line_no", F.array_distinct(line_shingles(F.col("line"), k)).alias("tokens"))
    return materialize(sets, "lines")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("xd").alias("doc_id"), F.col("xl").alias("line_no")).union(pairs.select("yd", "yl")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (xd, xl, yd, yl) the lines xd, xl, as doc_id and line_no, that reach the threshold with a partner."""
    one, two = (sets.select(F.col("doc_id").alias(f"{s}d"), F.col("line_no").alias(f"{s}l"), F.col("tokens").alias(f"{s}t")) for s in "xy")
    both = pairs.join(one, ["xd", "xl"]).join(two, ["yd", "yl"])
    same = F.size(F.array_intersect("xt", "yt"))
    return both.where(100 * same >= percent * (F.size("xt") + F.size("yt") - same)).select(F.col("xd").alias("doc_id"), F.col("xl").alias("line_no")).distinct()


def removed_lines(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id and gone, the numbers of its lines that an earlier line stands for; only documents that lose a line."""
    copies = same_texts(lines_of(docs))
    left = promising(without(lines_of(docs), copies), k, percent)
    name = line_key(F.col("doc_id"), F.col("line_no"))
    each = materialize(KeyFilter(left).passing(lines_of(docs), name).join(left.withColumnRenamed("line", "name"), name == F.col("name")).drop("name"), "left")
    discard(left)
    table = rarity_table(each, k)
    n = F.size("ordered")
    lines = materialize(
        each.select("doc_id", "line_no", by_rarity(line_shingles(F.col("line"), k), table).alias("ordered")).select(
            "doc_id", "line_no", n.alias("n"), F.xxhash64("ordered").alias("s1"), F.hash("ordered").alias("s2"), F.slice("ordered", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1).alias("prefix")
        ),
        "lines",
    )
    # the earliest line of each set stands for it, the others are repeats; prefixes are shuffled only where a set may have several lines
    key = [F.col(c) for c in ("n", "s1", "s2")]
    twins = materialize(lines.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*key), "twins")
    same, maybe = F.struct("doc_id", "line_no", "prefix"), KeyFilter(twins)
    groups = maybe.passing(lines, *key).groupBy(*key).agg(F.min(same).alias("first"), F.count(F.lit(1)).alias("k")).select(*key, "k", "first.*")
    alone = maybe.missing(lines, *key).select(*key, F.lit(1).cast("long").alias("k"), "doc_id", "line_no", "prefix")
    classes = materialize(groups.unionByName(alone), "sets")
    discard(twins)
    several = classes.where("k > 1").select("n", "s1", "s2", F.col("doc_id").alias("fd"), F.col("line_no").alias("fl"))
    members = KeyFilter(several.select("n", "s1", "s2")).passing(lines.select("doc_id", "line_no", "n", "s1", "s2"), F.col("n"), F.col("s1"), F.col("s2"))
    other = (F.col("doc_id") != F.col("fd")) | (F.col("line_no") != F.col("fl"))
    repeats = materialize(members.join(several, ["n", "s1", "s2"]).where(other).select("doc_id", "line_no"), "repeats")
    discard(lines)
    # tokens of two sets or more, then their places
    twice = materialize(classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token"), "tokens")
    places = classes.select("doc_id", "line_no", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = materialize(KeyFilter(twice).passing(places, F.col("token")).join(twice, "token"), "shared")  # a semi-join would go below the filter
    discard(twice)
    lead = shared.groupBy("token").agg(F.min(F.struct("doc_id", "line_no", "n", "pos")).alias("lead"))
    led = shared.join(lead, "token").where(
        ((F.col("doc_id") != F.col("lead.doc_id")) | (F.col("line_no") != F.col("lead.line_no"))) & possible(percent, F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"))
    ).select(F.col("doc_id").alias("xd"), F.col("line_no").alias("xl"), F.col("lead.doc_id").alias("yd"), F.col("lead.line_no").alias("yl"))
    votes = led.groupBy("xd", "xl", "yd", "yl").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("xd", "xl").agg(F.max(F.struct("votes", "yd", "yl")).alias("best")).select("xd", "xl", "best.yd", "best.yl")
    met = materialize(best, "met")
    best = materialize(likely(met, classes, percent), "pairs")
    discard(met)
    ends = materialize(ends_of(best), "ends")
    sets = line_sets(each, ends, k)
    matched = materialize(verified(best, sets, percent), "matched")
    discard(best, ends)
    x = shared.join(matched, ["doc_id", "line_no"], "left_anti").alias("x")
    y = shared.alias("y")
    earlier = (F.col("y.doc_id") < F.col("x.doc_id")) | ((F.col("y.doc_id") == F.col("x.doc_id")) & (F.col("y.line_no") < F.col("x.line_no")))
    rest = x.join(
        y, (F.col("x.token") == F.col("y.token")) & earlier & possible(percent, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    ).select(F.col("x.doc_id").alias("xd"), F.col("x.line_no").alias("xl"), F.col("y.doc_id").alias("yd"), F.col("y.line_no").alias("yl")).distinct()
    met = materialize(rest, "met")
    discard(shared)
    rest = materialize(likely(met, classes, percent), "pairs")
    discard(met, classes)
    more = materialize(ends_of(rest).join(sets.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti"), "ends")
    further = line_sets(each, more, k)
    late = verified(rest, sets.union(further), percent)
    lost = materialize(copies.select("doc_id", "line_no").union(repeats).union(matched).union(late).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "lost")
    discard(rest, more, sets, further, matched, repeats, copies, each)
    return lost


def dedup_lines(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines and n_removed."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = removed_lines(own, k, percent)
    losing = KeyFilter(lost.select("doc_id"))  # only documents that may lose a line are shuffled
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*names).alias("row"))
    body, key = F.col("row")[text], F.col("row")[doc_id]
    n_lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    still = losing.missing(rows, key).select("row.*", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    held = losing.passing(rows, key).join(lost, key == F.col("doc_id"), "left").select("row", F.split(body, "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    staying = held.select("row", "lines", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone").alias("staying"))
    new = F.array_join(F.transform("staying", lambda i: F.get("lines", i)), "\n")
    changed = staying.select(
        *[F.when(F.col("lines").isNotNull(), new).alias(c) if c == text else F.col("row")[c].alias(c) for c in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("staying"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return still.unionByName(changed)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
s AS MATERIALIZED (SELECT doc_id, line_no, line, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
c AS MATERIALIZED (SELECT s, min(doc_id * 1000000 + line_no) AS k FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT b.k AS k, a.n AS na, b.n AS nb, count(*) AS same FROM t a JOIN t b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n),
gone AS (SELECT DISTINCT k FROM p WHERE 100 * same >= 80 * (na + nb - same)),
stay AS (SELECT k FROM c WHERE k NOT IN (SELECT k FROM gone)),
f AS (SELECT s.*, len(s) = 0 OR stay.k IS NOT NULL AS ok FROM s LEFT JOIN stay ON stay.k = s.doc_id * 1000000 + s.line_no)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT ok) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (ok), '') AS text FROM f GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
