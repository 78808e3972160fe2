"""Expensive expressions that must run once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    The optimizer copies a projected expression into every filter and projection that uses
    it. The output of a generator cannot be copied, and an outer one keeps every row.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(value)).alias(name))


def explode_once(df: DataFrame, *keep: str, name: str, values: Column) -> DataFrame:
    """One row per element of a computed array without NULLs.

    An inner explode also filters on the size of the array, which would compute it twice.
    """
    out = df.select(*keep, F.explode_outer(values).alias(name))
    return out.filter(F.col(name).isNotNull())
