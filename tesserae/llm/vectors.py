"""What both vector operators share: which vectors take part, and matrices of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import written


def sound(column: str):
    """True where a vector is not null, has a component that is not zero, and none that is null or not finite."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def numbered(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """A written table of row number ``uid``, ``vec_id``, ``v`` (doubles; null where the vector takes no part)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(sound("v"), F.col("v")))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def stacked(column: pd.Series) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))
