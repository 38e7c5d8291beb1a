"""Frames whose own columns lie in one while others are computed beside them, so that none can be overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLER = "caller"


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **needed: Column) -> DataFrame:
    """The columns of df as one struct, caller, and those that are needed by names of their own."""
    return df.select(F.struct(*[named(c).alias(c) for c in df.columns]).alias(CALLER), *[c.alias(k) for k, c in needed.items()])


def unpacked(df: DataFrame, *results: str) -> DataFrame:
    """The caller's columns and then the results; a result takes the place of a caller's column of the same name."""
    taken = {r.lower() for r in results}
    own = [f for f in df.schema[CALLER].dataType.names if f.lower() not in taken]
    return df.select(*[F.col(CALLER).getField(f).alias(f) for f in own], *results)


def pinned(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns that are computed once: Catalyst does not copy them into each of the expressions that use them."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
