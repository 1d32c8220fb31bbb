"""Confusion counts, precision, recall, F1 and their roll-ups. What to do where a denominator is 0 is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(y: str = "y", p: str = "p") -> list[Column]:
    """Aggregates tp, fp, fn, tn and n of a binary truth and prediction."""
    y, p = F.col(y), F.col(p)
    hit = lambda a, b: F.sum(((y == a) & (p == b)).cast("bigint"))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), F.count(F.lit(1)).alias("n")]


def _ratio(a: Column, b: Column, policy: str) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if policy == "null" else F.coalesce(r, F.lit(0.0))


def prf(df: DataFrame, policy: str = "null") -> DataFrame:
    """precision, recall, f1, accuracy of rows with tp, fp, fn, tn. ``policy`` ``null`` or ``zero`` for 0 / 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return df.select("*", _ratio(tp, tp + fp, policy).alias("precision"), _ratio(tp, tp + fn, policy).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn, policy).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn, policy).alias("accuracy"))


def error_shares(df: DataFrame) -> DataFrame:
    """Share of wrong rows, and of wrong rows among true class 1 (0 without any)."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return df.select("*", _ratio(fp + fn, tp + fp + fn + tn, "zero").alias("pct_err_all"), _ratio(fn, tp + fn, "zero").alias("pct_err_class1"))


def models_long(df: DataFrame, models: dict[str, str], keys: list[str]) -> DataFrame:
    """A row for each model: keys, y, model, p."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in models.items()]))
    return df.select(*keys, "y", each.alias("m")).select(*keys, "y", "m.model", "m.p")


def class_prf(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(class, tp, n_true, n_pred, precision, recall, f1): undefined precision or recall takes the mean of the defined ones for F1 only."""
    pairs = df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    parts = pairs.select(F.explode(F.array(F.struct(F.col(y).alias("class"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("q")), F.struct(F.col(p).alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("q")))).alias("e")).select("e.*")
    c = parts.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("q").alias("n_pred"))
    c = c.select("*", F.try_divide(F.col("tp").cast("double"), F.col("n_pred")).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("n_true")).alias("recall"))
    whole = Window.partitionBy(F.lit(1))  # as many rows as classes
    pp, rr = F.coalesce("precision", F.avg("precision").over(whole)), F.coalesce("recall", F.avg("recall").over(whole))
    return c.select("*", F.try_divide(2 * pp * rr, pp + rr).alias("f1"))


def overall_accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    n = df.agg(F.sum((F.col(y) == F.col(p)).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))


def degenerate_group_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Metrics by group; where truth and prediction hold one class each, all are 1 if it is the same and 0 if not."""
    g = df.groupBy(*keys).agg(*confusion(y, p), F.min(y).alias("ly"), F.max(y).alias("hy"), F.min(p).alias("lp"), F.max(p).alias("hp"))
    g = prf(g, "zero")
    single = (F.col("ly") == F.col("hy")) & (F.col("lp") == F.col("hp"))
    same = (F.col("ly") == F.col("lp")).cast("double")
    return g.select(*keys, "n", *[F.when(single, same).otherwise(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def improvement(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """before, after and after - before for the union of groups; a missing group has 0."""
    b = before.select(key, *[F.col(c).alias(f"{c}_before") for c in columns])
    a = after.select(key, *[F.col(c).alias(f"{c}_after") for c in columns])
    j = b.join(a, key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(key, *[x for c in columns for x in (zero(f"{c}_before").alias(f"{c}_before"), zero(f"{c}_after").alias(f"{c}_after"), (zero(f"{c}_after") - zero(f"{c}_before")).alias(f"{c}_improvement"))])


def improvement_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("max"), F.round(F.min(c), 6).alias("min"), F.sum((c > 0).cast("bigint")).alias("n_improved"))


def group_metrics_before_after(df: DataFrame, branch: str, round_no: int, keys: list[str]) -> DataFrame:
    """A tracking row for each group of a split: metrics of the base and the split prediction."""
    b = degenerate_group_metrics(df, keys, "y", "pooled")
    a = degenerate_group_metrics(df, keys, "y", "part")
    return improvement(b, a, keys[0], ["f1", "accuracy"]).select(F.lit(round_no).alias("partition_round"), F.lit(branch).alias("branch_id"), "*")


def summary_by_model(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one row) of monthly metrics, and their number."""
    aggs = [f for c in columns for f in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias(f"{c}_std"))]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_months"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).cast("double"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    share = lambda x: F.round(100 * F.avg(x.cast("double")), 6)
    return df.where(c.isNotNull()).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.round(F.min(c), 6).alias("min"), F.round(F.max(c), 6).alias("max"), share(c > 0).alias("pct_positive"), share(c < 0).alias("pct_negative"))


def training_errors(df: DataFrame, unit: str, p: str, low: int = 10) -> DataFrame:
    """Errors of each unit in training with flags for few rows, no positives and no rows."""
    pos = F.sum("y")
    g = df.groupBy(unit).agg(F.count("y").alias("n_train"), pos.alias("n_pos_train"), F.sum((F.col("y") != F.col(p)).cast("bigint")).alias("e"), F.sum(((F.col("y") == 1) & (F.col(p) == 0)).cast("bigint")).alias("e1"))
    return g.select(unit, "n_train", "n_pos_train", F.try_divide(F.col("e").cast("double"), F.col("n_train")).alias("pct_err_all"), F.try_divide(F.col("e1").cast("double"), F.col("n_pos_train")).alias("pct_err_cls1"), (F.col("n_train") < low).alias("low_sample_flag"), (F.col("n_pos_train") == 0).alias("no_pos_samples_flag"), (F.col("n_train") == 0).alias("no_train_flag"))


def error_summary(df: DataFrame, column: str = "pct_err_all", quantile: float = 0.9) -> DataFrame:
    """Mean, deviation, extremes, the quantile, and how many units reach it."""
    c = F.col(column)
    s = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, F.lit(quantile)).alias("q"), F.sum(c.isNull().cast("bigint")).alias("n_null")).first()
    hot = df.agg(F.sum((c >= F.lit(s["q"])).cast("bigint")).alias("n_hotspots"))
    return hot.select(*[F.round(F.lit(s[k]), 6).alias(k) for k in ("mean", "std", "min", "max", "q")], F.lit(s["n_null"]).alias("n_null"), "n_hotspots")


def class_shares(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts of labels and their shares within the keys."""
    g = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, label, "n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*keys))).alias("share"))


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))
    return best


def label_jaccard(expected: DataFrame, actual: DataFrame, label: str = "label", unit: str = "unit") -> DataFrame:
    """(label, both, either, jaccard) of the unit sets of each label; a label without units on both sides has 1."""
    e = expected.select(F.col(label), F.col(unit), F.lit(1).alias("e")).distinct()
    a = actual.select(F.col(label), F.col(unit), F.lit(1).alias("a")).distinct()
    j = e.join(a, [label, unit], "full").groupBy(label).agg(F.sum((F.col("e").isNotNull() & F.col("a").isNotNull()).cast("bigint")).alias("both"), F.count(F.lit(1)).alias("either"))
    return j.withColumn("jaccard", F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("either")), F.lit(1.0)))


def cumulative_threshold(df: DataFrame, column: str, ratio: float) -> DataFrame:
    """The smallest count at which counts up to it, ascending, reach ``ratio`` of all."""
    by_value = df.groupBy(column).agg(F.sum(column).alias("s"))  # as many rows as distinct counts
    run = by_value.select(column, F.sum("s").over(Window.orderBy(column)).alias("upto"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("total"))
    return run.where(F.col("upto") >= ratio * F.col("total")).agg(F.min(column).alias("threshold"))


def mean_abs_ranking(df: DataFrame, name: str, value: str, ends: int = 10) -> DataFrame:
    """Mean absolute value of each name with its rank; ``ends`` first and last."""
    g = df.groupBy(name).agg(F.avg(F.abs(value)).alias("mean_abs"))
    r = g.select(name, F.round("mean_abs", 6).alias("mean_abs"), F.row_number().over(Window.orderBy(F.desc(F.round("mean_abs", 9)), name)).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("k"))
    return r.where((F.col("rank") <= ends) | (F.col("rank") > F.col("k") - ends)).drop("k")
