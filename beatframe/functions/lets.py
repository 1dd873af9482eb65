"""Binding of a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times; lambdas have no common-subexpression elimination."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns evaluated in a projection of their own.

    Long chains of projections are generated as one method, and the JVM never compiles methods beyond 8,000 bytes; a binding (``let``) ends
    the method. Columns that aren't named pass by and are still left out where no one reads them.
    """
    rest = [c for c in df.columns if c not in names]
    d = df.select(*rest, let(F.struct(*names), lambda r: r).alias("_settled"))
    return d.select(*rest, *[F.col(f"_settled.{n}").alias(n) for n in names])
