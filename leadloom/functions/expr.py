"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once inside an expression, so that it is not evaluated again wherever it is used."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def lookup(pairs: dict, key: Column) -> Column:
    """A fixed table as an expression; null for other keys."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]
