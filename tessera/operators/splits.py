"""Rolling-origin splits in time and repeatable splits by group."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_test_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Training rows of the groups that the test part has."""
    return train.join(test.select(group).distinct(), group, "left_semi")


def monthly_split(df: DataFrame, month: date, lag: int, window: int = 36, group: str = "unit", time: str = "month") -> tuple[DataFrame, DataFrame]:
    """Test: that month. Training: the ``window - 1`` months that end before the month ``lag`` earlier, of the test's groups."""
    if lag <= 0 or window <= 0:
        raise ValueError("lag and window must be above 0")
    m = F.lit(month).cast("date")
    end = F.add_months(m, -lag)
    test = df.where((F.col(time) >= m) & (F.col(time) < F.add_months(m, 1)))
    train = df.where((F.col(time) < end) & (F.col(time) >= F.add_months(end, -(window - 1))))
    return in_test_groups(train, test, group), test


def quarterly_split(df: DataFrame, year: int, quarter: int, years: int = 3, group: str = "unit", time: str = "month") -> tuple[DataFrame, DataFrame]:
    start = F.lit(date(year, 3 * quarter - 2, 1)).cast("date")
    test = df.where((F.year(time) == year) & (F.quarter(time) == quarter))
    train = df.where((F.col(time) < start) & (F.col(time) >= F.add_months(start, -12 * years)))
    return in_test_groups(train, test, group), test


def annual_split(df: DataFrame, year: int, years: int = 3, group: str = "unit", time: str = "month") -> tuple[DataFrame, DataFrame]:
    test = df.where(F.year(time) == year)
    train = df.where(F.year(time).between(year - years, year - 1))
    return in_test_groups(train, test, group), test


def correspondence(train: DataFrame, labels: DataFrame, unit: str = "unit") -> DataFrame:
    """The distinct (unit, partition) of the training part."""
    return train.select(unit).join(labels.select(unit, "partition_id"), unit).distinct()


def uniform(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash, the same however rows are partitioned."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def random_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``set`` 0 for training and 1 for validation, the latter for about ``share`` of the rows."""
    return df.withColumn("set", (uniform(key, seed) < share).cast("int"))


def group_validation(df: DataFrame, group: str, key: str, ratio: float = 0.2, least: int = 1, order: Column | None = None) -> DataFrame:
    """``set`` 1 for ``min(max(least, ceil(n * ratio)), n - 1)`` rows of each group; a group of one row only trains."""
    order = uniform(key, 42) if order is None else order
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    k = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return df.withColumn("__n", n).withColumn("__k", k).withColumn("set", (F.col("__k") <= F.least(F.greatest(F.lit(least), F.ceil(F.col("__n") * ratio)), F.col("__n") - 1)).cast("int")).drop("__n", "__k")


def split_coverage(df: DataFrame, group: str) -> DataFrame:
    """(group, total_count, train_count, val_count, uncovered) of a table with ``set``."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("total_count"), F.sum((F.col("set") == 0).cast("bigint")).alias("train_count"), F.sum((F.col("set") == 1).cast("bigint")).alias("val_count"))
    return g.withColumn("uncovered", (F.col("val_count") == 0) & (F.col("total_count") > 1))


def group_folds(df: DataFrame, unit: str, y: str = "y", folds: int = 5, order: Column | None = None) -> DataFrame:
    """(unit, fold): units stay together, folds are dealt within the units' majority classes."""
    majority = df.groupBy(unit).agg((F.sum(y) * 2 > F.count(F.lit(1))).cast("int").alias("majority"))
    order = uniform(unit, 42) if order is None else order
    w = Window.partitionBy("majority").orderBy(order, unit)
    return majority.select(unit, "majority", F.pmod(F.row_number().over(w) - 1, F.lit(folds)).alias("fold"))
