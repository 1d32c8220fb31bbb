"""Joins with the checks that the pipeline needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of so many rows may be broadcast; a larger one is shuffled.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast, if a count shows that the side is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def with_partition(panel: DataFrame, mapping: DataFrame, unit: str = "unit", column: str = "partition_id", most_missing: float = 0.01, fail: bool = True) -> DataFrame:
    """The partition of each row, -1 where the map has none; an error if more than ``most_missing`` of the rows have none."""
    j = panel.join(mapping.select(F.col(unit).alias("__u"), F.col(column)), F.col(unit) == F.col("__u"), "left").drop("__u")
    if fail:
        r = j.agg(F.avg(F.col(column).isNull().cast("double")).alias("missing")).first()["missing"]
        if r is not None and r > most_missing:
            raise ValueError(f"{r:.1%} of the rows have no partition")
    return j.withColumn(column, F.coalesce(column, F.lit(-1).cast(dict(mapping.dtypes)[column])))


def coverage(panel: DataFrame, mapping: DataFrame, unit: str = "unit", column: str = "partition_id") -> DataFrame:
    j = panel.join(mapping.select(F.col(unit).alias("__u"), F.col(column)), F.col(unit) == F.col("__u"), "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(column).isNull().cast("bigint")).alias("n_unmapped")).withColumn("unmapped_share", F.try_divide(F.col("n_unmapped").cast("double"), F.col("n")))


def densified(df: DataFrame, low: int, high: int, unit: str, column: str, missing: str) -> DataFrame:
    """A row for every code from low to high, with ``missing`` where the table has none."""
    spine = df.sparkSession.range(low, high + 1).select(F.col("id").alias(unit))
    return spine.join(df.select(unit, column), unit, "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def exactly_one_match(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left rows with status no_match, multiple_matches or success and, for success, the match's columns."""
    m = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in columns])
    j = left.join(m, keys, "left")
    status = F.when(F.col("__n").isNull(), "no_match").when(F.col("__n") > 1, "multiple_matches").otherwise("success")
    return j.select(*left.columns, status.alias("status"), *[F.when(F.col("__n") == 1, F.col(c)).alias(c) for c in columns])


def join_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b, joined) for the union of keys."""
    x, y = a.select(F.col(key), F.lit(True).alias("in_a")).distinct(), b.select(F.col(key), F.lit(True).alias("in_b")).distinct()
    flag = lambda c: F.coalesce(c, F.lit(False))
    return x.join(y, key, "full").select(key, flag("in_a").alias("in_a"), flag("in_b").alias("in_b"), (flag("in_a") & flag("in_b")).alias("joined"))


def swapped(before: DataFrame, after: DataFrame, unit: str, column: str) -> DataFrame:
    """Units whose label differs."""
    return before.select(unit, F.col(column).alias("before")).join(after.select(unit, F.col(column).alias("after")), unit).where("before <> after")


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join whose right side must hold each key once."""
    if right.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats on the right")
    return left.join(right, key, how)


def extend_lag(df: DataFrame, missing: int, source: int, column: str = "lag") -> DataFrame:
    """Rows of ``source`` copied as ``missing``, if that lag has no rows."""
    absent = df.where(F.col(column) == missing).agg(F.count(F.lit(1)).alias("k")).where("k = 0")
    copy = df.where(F.col(column) == source).withColumn(column, F.lit(missing).cast(dict(df.dtypes)[column])).join(F.broadcast(absent), F.lit(True)).drop("k")  # one row or none
    return df.unionByName(copy)


def on_spine(spine: DataFrame, series: DataFrame, key: str) -> DataFrame:
    return spine.select(key).distinct().join(series, key, "left")


def nearest(points: DataFrame, targets: DataFrame, unit: str = "unit", cell: float = 8.0) -> DataFrame:
    """(unit, nearest, d2) by Euclidean distance, ties to the smaller target; see ``spatial.grid_meet``."""
    from tessera.operators.spatial import grid_meet

    t = targets.select(F.col(unit).alias("id"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    d2 = (F.col("lat") - F.col("tlat")) ** 2 + (F.col("lon") - F.col("tlon")) ** 2
    return grid_meet(points, t, unit, d2, cell, ("tlat", "tlat", "tlon", "tlon")).select(unit, F.col("best").alias("nearest"), "d2")


def missing_codes(codes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return codes.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def scope_padded(scope: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """All ids of the scope, with nulls for those that the table lacks."""
    return scope.select(key).distinct().join(df, key, "left")


def first_wins(df: DataFrame, key: str, order: str | Column, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, value)
