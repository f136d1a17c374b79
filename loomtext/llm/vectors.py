"""What the operators on embeddings share: which vectors take part, and their Arrow columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only; an empty one is and does."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def flat(column: pa.Array) -> np.ndarray:
    """All entries of a list column, row after row; the column has no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False)


def scaled(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * value) of doubles as longs; a value too large for one is refused."""
    out = np.floor(values.astype(np.float64) * factor)
    if out.size and not np.abs(out).max() < 2.0**62:
        raise ValueError("an entry is too large for a long")
    return out.astype(np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least integer type that holds them."""
    most = int(np.abs(values).max()) if values.size else 0
    return values.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")
