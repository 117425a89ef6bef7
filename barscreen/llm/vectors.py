"""Vectors of an embedding table as clean arrays, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    """A column of equally long vectors as rows of a matrix."""
    return np.array(column.tolist(), dtype=kind) if len(column) else np.empty((0, 0), kind)


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays, none of them null, as rows of a matrix, without a Python object for each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
