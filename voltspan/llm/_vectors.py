"""Vectors as integers, so that distances, sums and means are exact and don't depend on the order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers of doubles are exact up to this.
_EXACT = 1 << 53


def finite(vector: str) -> Column:
    """True for a vector that is not null and holds no null and no non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~odd


def bound(dims: int) -> int:
    """The largest power of two for components whose squared distance in so many dimensions fits into a long."""
    return 1 << ((62 - max(0, dims - 1).bit_length()) // 2 - 1)


def whole(vector: str, scale: int, most: int) -> Column:
    """floor(scale * x) of each component; what lies beyond most, either way, counts as most."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most).cast("long")), F.lit(-most).cast("long")))


def matrix(column: pa.ListArray | pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """Rows of a column of lists that are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32)), pa.array(rows.reshape(-1), kind))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each entry."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < _EXACT:
        # Every partial sum is an integer that a double holds exactly.
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)
