"""One-row-per-key selection, capped groups, exact positions and membership joins.

All of these stay balanced when one key holds a large share of the rows: selection is
a two-phase aggregate, caps are applied per salt before they are applied per key, and
positions are a prefix scan over range partitions instead of one long window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.operators.lineage import cut_lineage

SALTS = 64


def _cols(values: Sequence[Column | str]) -> list[Column]:
    return [F.col(v) if isinstance(v, str) else v for v in values]


def first_per_key(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[Column | str],
    *,
    keyless_id: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """Keep, per key, the row with the smallest ``order`` values.

    ``keyless_id`` names a unique column; with it, rows that have a NULL key are all kept.
    ``position`` names an order column that is set to its smallest value in the group, so
    the survivor takes the place of the first row seen.
    """
    key_cols = _cols(keys)
    groups = [k.alias(f"_k{i}") for i, k in enumerate(key_cols)]
    if keyless_id is not None:
        any_null = key_cols[0].isNull()
        for k in key_cols[1:]:
            any_null = any_null | k.isNull()
        groups.append(F.when(any_null, F.col(keyless_id)).alias("_alone"))
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    aggs = [F.min_by(packed, F.struct(*_cols(order))).alias("_row")]
    if position is not None:
        aggs.append(F.min(position).alias("_first"))
    best = df.groupBy(*groups).agg(*aggs)
    if position is None:
        return best.select("_row.*")
    out = [F.col("_first").alias(c) if c == position else F.col(f"_row.`{c}`") for c in df.columns]
    return best.select(*out)


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int | Column,
    *,
    seq: str,
) -> DataFrame:
    """First ``limit`` rows of each key in the given order.

    A constant limit is planned by Spark as a group limit on the map side.  A limit that
    differs by key is first applied to slices of each key (``SALTS``, or as many as there are
    shuffle partitions if those are more), which leaves a slice times the limit for the final ranking.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    if isinstance(limit, int):
        return df.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= limit).drop("_rn")
    slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        df.withColumn("_limit", limit)
        .withColumn("_salt", F.pmod(F.xxhash64(seq), F.lit(max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
        .withColumn("_rn", F.row_number().over(slices))
        .where(F.col("_rn") <= F.col("_limit"))
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= F.col("_limit"))
        .drop("_rn", "_salt", "_limit")
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on same-named keys where NULL equals NULL; keeps the left key columns."""
    renamed = right
    condition = F.lit(True)
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_j{i}")
        condition = condition & left[k].eqNullSafe(F.col(f"_j{i}"))
    return left.join(renamed, condition, how).drop(*[f"_j{i}" for i in range(len(keys))])


#: Rows of a summary that may be sent to every task.
FEW = 100_000
_ROW_BITS = 33  # of the row number in an id that grows with the partitions


def positions(df: DataFrame, keys: Sequence[str], coarse: Sequence[tuple[str, bool]], seq: str, out: str = "position") -> DataFrame:
    """Exact 1-based position of each row in its key, ordered by ``coarse`` then ``seq``.

    ``coarse`` lists ``(column, descending)``; ``seq`` is a unique integer, dense or not. A prefix scan over
    range partitions: rows are dealt into sampled ranges of (key, order) and sorted there, which splits a key of
    any size; the rows of each key are counted in each partition; and a row's place is its place in the partition plus what
    earlier partitions hold of its key. The summary has one row for each partition and key in it. The sorted rows are stored
    first, as ranges drawn a second time could differ.
    """
    order = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in coarse]
    whole = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col(seq).asc_nulls_first()]
    stored = cut_lineage(
        df.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*keys, "_part", (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    )
    counts = cut_lineage(counts)
    small = counts.count() <= FEW
    return (
        join_on(stored, F.broadcast(counts) if small else counts, [*keys, "_part"], "inner")
        .withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
    )


def _spread_key(key: Column, spread: str) -> Column:
    """Join key in which rows without a key get a value of their own.

    Such rows match nothing on the other side; giving them distinct values keeps them
    from all landing in one partition.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), F.xxhash64(spread).cast("string")))


def without_known(df: DataFrame, known: DataFrame, key: Column, known_key: Column, *, spread: str) -> DataFrame:
    """Rows whose key is not among the known ones; rows without a key always stay."""
    right = known.select(known_key.cast("string").alias("_known")).where(F.col("_known").isNotNull()).distinct()
    left = df.withColumn("_key", _spread_key(key, spread))
    return left.join(right, F.col("_key") == F.col("_known"), "left_anti").drop("_key")
