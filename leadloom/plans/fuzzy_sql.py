"""The name scores as DuckDB's SQL: longest common subsequences by bits of whole numbers, over distinct pairs of names.

They are written apart from functions.fuzzy, so that each stands for the other. A pair relation has the columns a and b.
"""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of at most 120 letters: a bit per letter of a."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = f"CAST(coalesce(list_sum(list_transform(range(0, length({a})), lambda i_: CASE WHEN substring({a}, CAST(i_ AS INT) + 1, 1) = substring({b}, CAST(j_ AS INT), 1) THEN CAST(1 AS HUGEINT) << CAST(i_ AS INT) ELSE 0 END)), 0) AS HUGEINT)"
    masks = f"list_transform(range(1, length({b}) + 1), lambda j_: {mask})"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {masks}), lambda free_, mask_: ((free_ + (free_ & mask_)) | (free_ - (free_ & mask_))) & {full})))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs(a, b)} / (length({a}) + length({b})) END)"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def token_sort(pairs: str) -> str:
    """a, b, score: the ratio of the sorted words."""
    key = lambda c: f"array_to_string(list_sort({words(c)}), ' ')"
    return f"(SELECT a, b, {ratio('x', 'y')} AS score FROM (SELECT DISTINCT a, b, {key('a')} AS x, {key('b')} AS y FROM {pairs}))"


def _windows(pairs: str) -> str:
    """x and y of all windows: the shorter text against each stretch of the longer one that it can lie on."""
    both = f"(SELECT a, b, a AS x, b AS t FROM {pairs} WHERE length(a) <= length(b) UNION ALL SELECT a, b, b, a FROM {pairs} WHERE length(b) <= length(a))"
    return f"(SELECT DISTINCT a, b, x, substring(t, CAST(greatest(i, 0) AS INT) + 1, CAST(least(i + length(x), length(t)) - greatest(i, 0) AS INT)) AS y FROM (SELECT *, unnest(range(1 - length(x), length(t))) AS i FROM {both} WHERE a <> '' AND b <> ''))"


def partial(pairs: str) -> str:
    return f"(SELECT a, b, max({ratio('x', 'y')}) AS score FROM {_windows(pairs)} GROUP BY a, b)"


def name(pairs: str) -> str:
    """a, b, score: the better of the word sets' score and the partial one; 0 where a text is empty."""
    sets = f"(SELECT a, b, list_sort(list_intersect(u, v)) AS c, list_sort(list_filter(u, lambda w: NOT list_contains(v, w))) AS p, list_sort(list_filter(v, lambda w: NOT list_contains(u, w))) AS q FROM (SELECT DISTINCT a, b, list_distinct({words('a')}) AS u, list_distinct({words('b')}) AS v FROM {pairs}) WHERE len(u) > 0 AND len(v) > 0)"
    sides = f"(SELECT a, b, array_to_string(c, ' ') AS c, array_to_string(list_concat(c, p), ' ') AS l, array_to_string(list_concat(c, q), ' ') AS r, len(c) > 0 AND (len(p) = 0 OR len(q) = 0) AS held FROM {sets})"
    jobs = f"SELECT a, b, l AS x, r AS y FROM {sides} UNION SELECT a, b, c, l FROM {sides} WHERE c <> '' UNION SELECT a, b, c, r FROM {sides} WHERE c <> '' UNION SELECT a, b, x, y FROM {_windows(pairs)}"
    scored = f"SELECT a, b, {ratio('x', 'y')} AS score FROM ({jobs}) UNION ALL SELECT a, b, 100.0 FROM {sides} WHERE held UNION ALL SELECT DISTINCT a, b, 0.0 FROM {pairs}"
    return f"(SELECT a, b, max(score) AS score FROM ({scored}) GROUP BY a, b)"
