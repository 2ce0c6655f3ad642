"""What the two vector searches share: valid rows and the fold of equal vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """``(vec_id, v)``: v as doubles; null ids, null or empty vectors and null or non-finite components go."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(finite & (F.size("v") > 0))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def folded(rows: DataFrame, column: str, ids: int) -> DataFrame:
    """``(column, ids)``: each different vector with its smallest ids, ``ids`` of them at most.

    A search for the best k takes the smallest ids among equal vectors, and k + 1 of them are enough
    when a query leaves itself out; so nothing is lost, and a vector that a third of all rows share
    is one entry. Rows that repeat an id and vector are one row before the limit counts them, so they
    take one place. The rank limit runs before its shuffle, so the hot vector is not gathered.
    """
    order = Window.partitionBy(column).orderBy("vec_id")
    return (
        rows.select(column, "vec_id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= ids)
        .groupBy(column).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )


def best(found: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each query, with their rank from 1."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind) if len(column) else np.zeros((0, 0), kind)
