"""Preparing a panel of units by month. All operators keep rows keyed by columns; none relies on row order in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import finite_or_null
from tessera.operators.joins import small


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def resolve_alias(df: DataFrame, aliases: list[str], name: str) -> DataFrame:
    """The first alias column that holds a value, under ``name``; one small aggregation finds it."""
    there = [a for a in aliases if a in df.columns]
    filled = df.agg(*[F.count(a).alias(a) for a in there]).first() if there else {}
    for a in there:
        if filled[a]:
            return df.withColumn(name, F.col(a)).drop(*[x for x in there if x != name])
    raise ValueError(f"none of {aliases} holds a value")


def one_hot(df: DataFrame, column: str, prefix: str, values: list | None = None) -> DataFrame:
    """A 0/1 column for each value that occurs (or each of ``values``)."""
    if values is None:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.select("*", *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{prefix}{v}") for v in values])


def codes_by_first_appearance(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """0, 1, ... for the values of a column in the order in which they first appear."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    # as many rows as distinct values
    coded = first.select(F.col(column).alias("__value"), (F.row_number().over(Window.orderBy("__first", column)) - 1).cast("bigint").alias(name))
    return df.join(small(coded), F.col(column) == F.col("__value"), "left").drop("__value")


def dense_group_id(df: DataFrame, columns: list[str], name: str = "group_id") -> DataFrame:
    """0-based ids of the distinct combinations in ascending order; 0 for all rows without columns."""
    if not columns:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    keys = df.select(*columns).distinct().withColumn(name, (F.row_number().over(Window.orderBy(*columns)) - 1).cast("bigint"))
    renamed = keys.select(*[F.col(c).alias(f"__{c}") for c in columns], name)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(renamed, same).drop(*[f"__{c}" for c in columns])


def lags(df: DataFrame, columns: list[str], steps: list[int], unit: str = "unit", time: str = "month", suffix: str = "_lag_") -> DataFrame:
    """Values ``k`` observed rows earlier in the unit (a gap in the months is not a step)."""
    w = Window.partitionBy(unit).orderBy(time)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}{suffix}{k}") for c in columns for k in steps])


def calendar_lag(df: DataFrame, columns: list[str], step: int, unit: str = "unit", time: str = "month") -> DataFrame:
    """Values exactly ``step`` months earlier, null if that month is missing."""
    past = df.select(F.col(unit).alias("__u"), F.add_months(time, step).alias("__t"), *[F.col(c).alias(f"{c}_cal_{step}") for c in columns])
    return df.join(past, (F.col(unit) == F.col("__u")) & (F.col(time) == F.col("__t")), "left").drop("__u", "__t")


def rolling_sums(df: DataFrame, columns: list[str], windows: list[int], unit: str = "unit", time: str = "month") -> DataFrame:
    """Sums of the ``w`` rows before the current one, null unless all ``w`` have a value."""
    by = Window.partitionBy(unit).orderBy(time)
    frame = lambda w: by.rowsBetween(-w, -1)
    return df.select("*", *[F.when(F.count(c).over(frame(w)) == w, F.sum(c).over(frame(w))).alias(f"{c}_m{w}") for c in columns for w in windows])


def time_variant_features(df: DataFrame, columns: list[str], keys: list[str], most: int = 2) -> DataFrame:
    """(feature, most_values, time_variant): a feature varies in time if some group holds over ``most`` distinct values."""
    per = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in columns])
    top = per.agg(*[F.max(c).alias(c) for c in columns])
    long = top.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("most_values")) for c in columns])).alias("f")).select("f.*")
    return long.withColumn("time_variant", F.col("most_values") > most)


class OutOfRangeImputer:
    """Fills missing values with one beyond the column's range, so that a tree can split them off.

    ``max_plus``: maximum times ``k`` (``k`` if the maximum is 0). ``min_minus`` and ``extreme_low``: minimum minus range
    times ``k``; ``extreme_high``: maximum plus range times ``k``; with a range of 0 its place is taken by the value's
    size, or by 1. A column without values is filled with 0. NaN and infinities count as missing.
    """

    STRATEGIES = ("max_plus", "min_minus", "extreme_low", "extreme_high")

    def __init__(self, columns: list[str], strategy: str = "max_plus", k: float = 100.0):
        if strategy not in self.STRATEGIES:
            raise ValueError(strategy)
        self.columns, self.strategy, self.k, self.fill = columns, strategy, k, {}

    def fit(self, df: DataFrame) -> OutOfRangeImputer:
        clean = {c: finite_or_null(F.col(c).cast("double")) for c in self.columns}
        found = df.agg(*[f(clean[c]).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        self.fill = {c: self._value(found[f"lo{i}"], found[f"hi{i}"]) for i, c in enumerate(self.columns)}
        return self

    def _value(self, lo: float | None, hi: float | None) -> float:
        if lo is None or hi is None:
            return 0.0
        k, span = self.k, hi - lo
        if self.strategy == "max_plus":
            return hi * k if hi != 0 else k
        if self.strategy == "extreme_high":
            return hi + span * k if span else hi + abs(hi) * k if hi else k
        return lo - span * k if span else lo - abs(lo) * k if lo else -k

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(v)) for c, v in self.fill.items()})


def mean_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.fillna({c: means[c] for c in columns if means[c] is not None}, subset=columns)


def date_cutoff(df: DataFrame, year: int, month: int | None = None, quarter: int | None = None) -> DataFrame:
    """Rows from (year, month), else (year, quarter), else year, on."""
    late = F.col("year") > year
    if month is not None and "month_no" in df.columns:
        return df.where(late | ((F.col("year") == year) & (F.col("month_no") >= month)))
    if quarter is not None and "quarter" in df.columns:
        return df.where(late | ((F.col("year") == year) & (F.col("quarter") >= quarter)))
    return df.where(F.col("year") >= year)


def truth_filter(df: DataFrame, kind: str) -> DataFrame:
    """``all``, ``crisis`` (true class 1) or ``noncrisis`` rows."""
    if kind == "all":
        return df
    return df.where(F.col("y") == {"crisis": 1, "noncrisis": 0}[kind])


def reorigin(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coordinates counted from their smallest values."""
    low = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) - F.lit(low[c]) for c in columns})


def class_weights(df: DataFrame, label: str = "y", least: int = 5, most: float = 100.0) -> DataFrame:
    """(label, n, weight): inverse frequency, at most ``most``; 1 for classes of fewer than ``least`` rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    kinds = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return counts.select(label, "n", F.when(F.col("n") < least, F.lit(1.0)).otherwise(F.least(total / (kinds * F.col("n")), F.lit(most))).alias("weight"))


def keep_one(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row of each key: the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def max_normalised(df: DataFrame, column: str, name: str) -> DataFrame:
    """Divided by the largest value; as it is, if that is not above 0."""
    top = df.agg(F.max(column).alias("m")).first()["m"]
    return df.withColumn(name, F.col(column) / F.lit(float(top)) if top is not None and top > 0 else F.col(column))
