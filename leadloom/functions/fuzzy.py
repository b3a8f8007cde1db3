"""String similarity from 0 to 100 by longest common subsequence, as Arrow UDFs for distinct pairs.

ratio: 200 LCS / (|a| + |b|). token_sort: of the sorted words. token_set: 100 if one word set holds the other, else the best
of the common words against each side. partial: the best ratio of the shorter string against every window of the longer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Bit-parallel length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    common = " ".join(sorted(one & two))
    if common and (one <= two or two <= one):
        return 100.0
    left, right = (" ".join([*sorted(one & two), *sorted(rest)]) for rest in (one - two, two - one))
    return max(ratio(left, right), *((ratio(common, x) for x in (left, right)) if common else (0.0,)))


def partial(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    best = 0.0
    for s, t in [(a, b), (b, a)] if len(a) == len(b) else [(a, b) if len(a) < len(b) else (b, a)]:
        n = len(s)
        for i in range(1 - n, len(t)):
            best = max(best, ratio(s, t[max(i, 0) : i + n]))
    return best


def _udf(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run


fuzz_ratio, fuzz_token_sort, fuzz_token_set, fuzz_partial = map(_udf, (ratio, token_sort, token_set, partial))
fuzz_name = _udf(lambda a, b: max(token_set(a, b), partial(a, b)))
