"""Numpy work inside tasks: matrices of Arrow batches and distributed matrix sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweir.functions.vectors import sum_vectors


def batch_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, without a copy per row."""
    return np.asarray(column.flatten()).reshape(-1, width)


def matrix_sum_rows(
    df: DataFrame, vec: str, width: int, fn: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """(i, j, g): element-wise sum of fn(batch) over all batches of vectors."""
    rows = summed_rows(df, vec, width, fn)
    return rows.select("i", F.posexplode("row").alias("j", "g"))


def summed_rows(df: DataFrame, vec: str, width: int, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, row): the rows of the summed matrix.

    Every task adds its batches into one matrix and emits it once; whole rows are then added in one shuffle, combined before it.
    """

    def partial(batches):
        total = None
        for batch in batches:
            x = batch_matrix(batch.column(0), width)
            if len(x):
                part = fn(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(total)), pa.int32()),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                ["i", "row"],
            )

    parts = df.select(vec).mapInArrow(partial, "i int, row array<double>")
    return sum_vectors(parts, ["i"], "row")


def matrix_sum(
    df: DataFrame, vec: str, width: int, fn: Callable[[np.ndarray], np.ndarray], shape
) -> np.ndarray:
    """The summed matrix on the driver; its shape depends on the model only."""
    out = np.zeros(shape)
    for row in summed_rows(df, vec, width, fn).collect():
        out[row["i"]] = row["row"]
    return out


def map_vectors(
    df: DataFrame, vec: str, width: int, fn: Callable[[np.ndarray], list], columns: str
) -> DataFrame:
    """Replace the vector column by the columns fn(matrix) returns (DDL ``columns``)."""
    rest = [f.name for f in df.schema.fields if f.name != vec]
    schema = df.select(*rest).schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(columns)
    for field in added.fields:
        schema = schema.add(field)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            x = batch_matrix(batch.column(batch.num_columns - 1), width)
            arrays = [
                pa.array(list(a)) if isinstance(a, np.ndarray) and a.ndim == 2 else pa.array(a)
                for a in fn(x)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + arrays, names)

    return df.select(*rest, vec).mapInArrow(run, schema)
