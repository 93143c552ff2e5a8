"""Integer vectors of an embeddings table, as rows and as numpy matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Integer components are clipped at this size (|x| over 262,144): a long holds the products of about 1,000 such components.
MAX_COMPONENT = 1 << 26


def finite(vec: str) -> Column:
    """Whether the array has no null and no component that isn't finite; a null array hasn't."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vec: str, scale: int = SCALE) -> Column:
    """array<int> of floor(scale * x), x as double."""
    bound = float(MAX_COMPONENT)
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(-bound)), F.lit(bound))).cast("int"))


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, *others: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id long, the other columns, q array<int>) of the rows whose vector is finite."""
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), *others, F.col(vec_col).alias("v"))
    return named.where(finite("v")).withColumn("q", quantised("v", scale)).drop("v")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """int64 matrix of a column of integer arrays without nulls; shorter rows are filled up with zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lengths) * width and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b. Doubles hold them, sums included, up to 2 ** 53; beyond that, integers multiply."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
