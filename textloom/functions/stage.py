"""Keep costly computed columns computed once.

Catalyst pushes a filter below the projections that define the columns it
tests, inlining their expressions into the filter; a filter on a flag derived
from long-text regexes then evaluates those regexes again (sometimes several
times per row). ``pin`` re-emits columns through a one-element ``inline``
generator: later filters stop above it, the values are computed once per
row, and no shuffle is added (the generator stays in whole-stage code).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(c).alias(c) for c in columns]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it: without it each mention would repeat
    the whole expression, and nested ones would grow geometrically."""
    return F.element_at(F.transform(F.array(value), use), 1)
