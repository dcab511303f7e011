"""What the vector searches share: usable rows, copies, and rows packed into matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Salts of the first of two steps that number copies.
SALTS = 64


def log_length(vector: Column) -> Column:
    """Logarithm to the base 2 of a vector's length, kept within the range of doubles."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.log2(F.greatest(F.least(square, F.lit(1e300)), F.lit(1e-300))) / 2


def one_per_id(rows: DataFrame, *values: str) -> DataFrame:
    """An identifier names one row: of rows that repeat `id` the one with the least values counts. Merged before the shuffle."""
    return rows.groupBy("id").agg(F.min(F.struct(*values)).alias("_least")).select("id", "_least.*")


def first_copies(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of rows equal in `keys` those with the n smallest ids. Any answer of n rows, ties to the smaller id, needs no others,
    and a common vector is as cheap as any. Two steps, so that no task sorts all copies of one vector."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    for by in ([*keys, salt], keys):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")
    return rows


def to_matrix(lists: pa.Array, dtype) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both filled up with zeros to the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def first_of_each(group: np.ndarray, n: int) -> np.ndarray:
    """Which entries of a sorted array are among the first n of their value."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < n
