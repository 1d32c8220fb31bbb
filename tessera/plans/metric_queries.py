"""Metric roll-ups over a prediction log, and the joins of the report layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.plans import fixtures as V
from tessera.plans.fixtures import PANEL, PLANS, PREDICTIONS, UNITS, sql

QUERIES: dict[str, tuple] = {}
MODELS = {"pooled": "pooled", "partitioned": "part"}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = (f, text)
        return f

    return add


def conf(p: str = "p") -> str:
    pairs = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return ", ".join(f"sum(CASE WHEN y = {a} AND {p} = {b} THEN 1 ELSE 0 END)::BIGINT AS {k}" for k, (a, b) in pairs.items()) + ", count(*) AS n"


def rates(policy: str = "null", accuracy: bool = True) -> str:
    r = lambda a, b: f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)"
    if policy == "zero":
        inner = r
        r = lambda a, b: f"coalesce({inner(a, b)}, 0)"
    return f"{r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1" + (f", {r('tp + tn', 'tp + fp + fn + tn')} AS accuracy" if accuracy else "")


ERRORS = "coalesce((fp + fn)::DOUBLE / nullif((tp + fp + fn + tn)::DOUBLE, 0), 0) AS pct_err_all, coalesce(fn::DOUBLE / nullif((tp + fn)::DOUBLE, 0), 0) AS pct_err_class1"
LONG = PREDICTIONS + ", v_long AS (SELECT row_id, unit, month, y, 'pooled' AS model, pooled AS p FROM v_pred UNION ALL SELECT row_id, unit, month, y, 'partitioned', part FROM v_pred)"
MONTHLY = LONG + f", v_monthly AS (SELECT *, {rates('zero', False)}, {ERRORS} FROM (SELECT month, model, {conf()} FROM v_long GROUP BY month, model))"


def monthly(spark, d):
    long = M.models_long(V.predictions(spark, d), MODELS, ["month"])
    return M.error_shares(M.prf(long.groupBy("month", "model").agg(*M.confusion()), "zero")).drop("accuracy")


@query("metrics_monthly_confusion", sql(MONTHLY, select="SELECT strftime(month, '%Y-%m') AS test_month, * EXCLUDE (month) FROM v_monthly"))
def _(spark, d):
    return monthly(spark, d).withColumn("test_month", F.date_format("month", "yyyy-MM")).drop("month")


@query("prf_null_policy", sql(LONG, select=f"SELECT *, {rates()} FROM (SELECT unit, month, model, {conf()} FROM v_long GROUP BY ALL)"))
def _(spark, d):
    return M.prf(M.models_long(V.predictions(spark, d), MODELS, ["unit", "month"]).groupBy("unit", "month", "model").agg(*M.confusion()))


@query("prf_class_mean", sql(PREDICTIONS, select="""SELECT class, tp, n_true, n_pred, precision, recall, 2 * coalesce(precision, avg(precision) OVER ()) * coalesce(recall, avg(recall) OVER ()) / nullif(coalesce(precision, avg(precision) OVER ()) + coalesce(recall, avg(recall) OVER ()), 0) AS f1
FROM (SELECT class, sum(tp)::BIGINT AS tp, sum(t)::BIGINT AS n_true, sum(q)::BIGINT AS n_pred, sum(tp)::DOUBLE / nullif(sum(q), 0) AS precision, sum(tp)::DOUBLE / nullif(sum(t), 0) AS recall FROM (SELECT y AS class, (y = pooled)::INT AS tp, 1 AS t, 0 AS q FROM v_pred UNION ALL SELECT pooled, 0, 0, 1 FROM v_pred) GROUP BY class)"""))
def _(spark, d):
    return M.class_prf(V.predictions(spark, d), "y", "pooled")


@query("overall_accuracy", sql(PREDICTIONS, select="SELECT sum((y = part)::INT)::BIGINT AS correct, count(*) AS total, sum((y = part)::INT)::DOUBLE / count(*) AS accuracy FROM v_pred"))
def _(spark, d):
    return M.overall_accuracy(V.predictions(spark, d), "y", "part")


@query("class_one_metrics", sql(PREDICTIONS, select=f"SELECT precision, recall, f1, (recall + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS balanced_accuracy, tp + fn AS support_1, tn + fp AS support_0 FROM (SELECT *, {rates('zero')} FROM (SELECT {conf('part')} FROM v_pred))"))
def _(spark, d):
    m = M.prf(V.predictions(spark, d).agg(*M.confusion("y", "part")), "zero")
    specificity = F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    return m.select("precision", "recall", "f1", ((F.col("recall") + specificity) / 2).alias("balanced_accuracy"), (F.col("tp") + F.col("fn")).alias("support_1"), (F.col("tn") + F.col("fp")).alias("support_0"))


@query("polygon_metrics_diff", sql(LONG, select=f"SELECT a.unit, a.n, a.f1 AS f1_pooled, b.f1 AS f1_partitioned, b.f1 - a.f1 AS f1_diff, a.pct_err_all AS pct_err_all_pooled, b.pct_err_all AS pct_err_all_partitioned, a.pct_err_class1 AS pct_err_class1_pooled, b.pct_err_class1 AS pct_err_class1_partitioned FROM (SELECT *, {rates('zero', False)}, {ERRORS} FROM (SELECT unit, {conf('pooled')} FROM v_pred GROUP BY unit)) a JOIN (SELECT *, {rates('zero', False)}, {ERRORS} FROM (SELECT unit, {conf('part')} FROM v_pred GROUP BY unit)) b ON a.unit = b.unit"))
def _(spark, d):
    long = M.models_long(V.predictions(spark, d), MODELS, ["unit"]).groupBy("unit", "model").agg(*M.confusion())
    m = M.error_shares(M.prf(long, "zero"))
    pick = lambda c, model: F.max(F.when(F.col("model") == model, F.col(c)))
    g = m.groupBy("unit").agg(F.max("n").alias("n"), *[pick(c, model).alias(f"{c}_{model}") for c in ("f1", "pct_err_all", "pct_err_class1") for model in MODELS])
    return g.withColumn("f1_diff", F.col("f1_partitioned") - F.col("f1_pooled"))


GROUPS = f"SELECT {{key}}, n, CASE WHEN single THEN same ELSE precision END AS precision, CASE WHEN single THEN same ELSE recall END AS recall, CASE WHEN single THEN same ELSE f1 END AS f1, CASE WHEN single THEN same ELSE accuracy END AS accuracy FROM (SELECT *, {rates('zero')} FROM (SELECT {{key}}, {{conf}}, min(y) = max(y) AND min({{p}}) = max({{p}}) AS single, (min(y) = min({{p}}))::INT::DOUBLE AS same FROM v_pred GROUP BY {{key}}))"


@query("group_metrics_degenerate", sql(PREDICTIONS, select=GROUPS.format(key="unit, month", conf=conf("part"), p="part")))
def _(spark, d):
    return M.degenerate_group_metrics(V.predictions(spark, d), ["unit", "month"], "y", "part")


_BEFORE_AFTER = PREDICTIONS + ", b AS (" + GROUPS.format(key="unit", conf=conf("pooled"), p="pooled") + "), a AS (" + GROUPS.format(key="unit", conf=conf("part"), p="part") + ")"


@query("before_after_improvement", sql(_BEFORE_AFTER, select="SELECT unit, coalesce(b.f1, 0) AS f1_before, coalesce(a.f1, 0) AS f1_after, coalesce(a.f1, 0) - coalesce(b.f1, 0) AS f1_improvement FROM b FULL JOIN (SELECT unit + 3 AS unit, f1 FROM a) a USING (unit)"))
def _(spark, d):
    p = V.predictions(spark, d)
    b = M.degenerate_group_metrics(p, ["unit"], "y", "pooled")
    a = M.degenerate_group_metrics(p, ["unit"], "y", "part").withColumn("unit", F.col("unit") + 3)  # another numbering: some units have one side only
    return M.improvement(b, a, "unit", ["f1"])


@query("partition_tracking", sql(_BEFORE_AFTER, select="SELECT 1 AS partition_round, '01' AS branch_id, unit, b.f1 AS f1_before, a.f1 AS f1_after, a.f1 - b.f1 AS f1_improvement, b.accuracy AS accuracy_before, a.accuracy AS accuracy_after, a.accuracy - b.accuracy AS accuracy_improvement FROM b JOIN a USING (unit)"))
def _(spark, d):
    return M.group_metrics_before_after(V.predictions(spark, d), "01", 1, ["unit"])


@query("improvement_summary", sql(_BEFORE_AFTER, select="SELECT count(*) AS total, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, sum((x > 0)::INT)::BIGINT AS n_improved FROM (SELECT a.f1 - b.f1 AS x FROM b JOIN a USING (unit))"))
def _(spark, d):
    t = M.group_metrics_before_after(V.predictions(spark, d), "", 0, ["unit"])
    return M.improvement_summary(t, "f1_improvement")


@query("error_rate_by_season", sql(PREDICTIONS, select="SELECT season, unit, count(*) AS n, least(greatest(sum(e)::DOUBLE / count(*), 0), 1) AS error_rate FROM (SELECT unit, (y <> part)::INT AS e, CASE WHEN month(month) IN (12, 1, 2, 3) THEN 'DJFM' WHEN month(month) IN (4, 5, 6, 7) THEN 'AMJJ' ELSE 'ASON' END AS season FROM v_pred) GROUP BY season, unit"))
def _(spark, d):
    p = V.predictions(spark, d).withColumn("season", S.season_of(F.month("month")))
    e = F.sum((F.col("y") != F.col("part")).cast("bigint")).cast("double") / F.count(F.lit(1))
    return p.groupBy("season", "unit").agg(F.count(F.lit(1)).alias("n"), F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0)).alias("error_rate"))


_REGIONS = {f"NATION_{i}": f"zone {i % 3}" for i in range(20)}
_PLACED = ", v_placed AS (SELECT p.*, admin0, region FROM v_pred p LEFT JOIN v_unit u ON p.unit = u.unit WHERE admin0 IS NOT NULL)"


@query("region_country_metrics", sql(PREDICTIONS + ", " + UNITS + _PLACED, select=f"SELECT *, {rates()} FROM (SELECT 'admin0' AS level, admin0 AS place, {conf('part')} FROM v_placed GROUP BY admin0 UNION ALL SELECT 'region', region, {conf('part')} FROM v_placed GROUP BY region)"))
def _(spark, d):
    u = V.units(spark, d).select("unit", "admin0", "region")
    p = V.predictions(spark, d).join(J.small(u), "unit", "left").where("admin0 is not null")
    g = p.groupingSets([["admin0"], ["region"]], "admin0", "region").agg(*M.confusion("y", "part"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "admin0").otherwise("region")
    return M.prf(g.select(level.alias("level"), F.coalesce("admin0", "region").alias("place"), "tp", "fp", "fn", "tn", "n"))


@query("region_map_with_other", "SELECT n_nationkey, CASE WHEN n_nationkey % 25 < 20 THEN 'zone ' || (n_nationkey % 3) ELSE 'Other' END AS zone FROM nation")
def _(spark, d):
    n = V.read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"))
    return n.select("n_nationkey", S.region_of(F.col("name"), _REGIONS).alias("zone"))


@query("season_table", sql(PREDICTIONS, select=f"SELECT season_year, season, n, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy FROM (SELECT *, {rates()} FROM (SELECT season_year, season, {conf('part')} FROM (SELECT y, part, CASE WHEN month(month) IN (12, 1, 2, 3) THEN 'DJFM' WHEN month(month) IN (4, 5, 6, 7) THEN 'AMJJ' ELSE 'ASON' END AS season, (year(month) + (month(month) = 12)::INT)::INTEGER AS season_year FROM v_pred) GROUP BY season_year, season))"))
def _(spark, d):
    p = V.predictions(spark, d).withColumn("season", S.season_of(F.month("month"))).withColumn("season_year", S.season_year(F.year("month"), F.month("month")))
    m = M.prf(p.groupBy("season_year", "season").agg(*M.confusion("y", "part")))
    return m.select("season_year", "season", "n", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("metrics_quarterly_rollup", sql(MONTHLY, select="SELECT year(month)::INTEGER AS year, quarter(month)::INTEGER AS quarter, model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(n)::BIGINT AS num_samples FROM v_monthly GROUP BY ALL"))
def _(spark, d):
    m = monthly(spark, d)
    return m.groupBy(F.year("month").alias("year"), F.quarter("month").alias("quarter"), "model").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.sum("n").alias("num_samples"))


@query("model_summary_std", sql(MONTHLY, select="SELECT model, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std" for c in ("precision", "recall", "f1")) + ", count(*) AS n_months FROM v_monthly GROUP BY model"))
def _(spark, d):
    return M.summary_by_model(monthly(spark, d), ["model"], ["precision", "recall", "f1"])


@query("baseline_summary_from_year", sql(MONTHLY, select="SELECT round(avg(f1), 6) AS f1_mean, count(*) AS n_months FROM v_monthly WHERE model = 'pooled' AND year(month) >= 1998"))
def _(spark, d):
    return monthly(spark, d).where((F.col("model") == "pooled") & (F.year("month") >= 1998)).agg(F.round(F.avg("f1"), 6).alias("f1_mean"), F.count(F.lit(1)).alias("n_months"))


@query("mean_by_lag", sql(LONG, select="SELECT lag, model, round(avg(e), 6) AS error FROM (SELECT (unit % 3)::BIGINT AS lag, model, (y <> p)::INT AS e FROM v_long) GROUP BY ALL"))
def _(spark, d):
    long = M.models_long(V.predictions(spark, d), MODELS, ["unit"])
    return long.groupBy((F.col("unit") % 3).alias("lag"), "model").agg(F.round(F.avg((F.col("y") != F.col("p")).cast("int")), 6).alias("error"))


_DIFF = _BEFORE_AFTER + ", " + UNITS + ", v_diff AS (SELECT u.unit, admin0, region, a.n, a.f1 - b.f1 AS f1_diff FROM a JOIN b USING (unit) JOIN v_unit u USING (unit))"


def _diff(spark, d):
    t = M.group_metrics_before_after(V.predictions(spark, d), "", 0, ["unit"])
    n = V.predictions(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return t.select("unit", F.col("f1_improvement").alias("f1_diff")).join(n, "unit").join(J.small(V.units(spark, d).select("unit", "admin0", "region")), "unit")


@query("weighted_country_mean", sql(_DIFF, select="SELECT region, round(sum(f1_diff * n) / nullif(sum(n), 0), 6) AS f1_diff, sum(n)::BIGINT AS total_n, count(*) AS n_units, min_by(admin0, unit) AS first_name FROM v_diff GROUP BY region"))
def _(spark, d):
    return _diff(spark, d).groupBy("region").agg(F.round(M.weighted_mean("f1_diff", "n"), 6).alias("f1_diff"), F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("n_units"), F.min_by("admin0", "unit").alias("first_name"))


@query("diff_distribution", sql(_DIFF, select="SELECT round(avg(f1_diff), 6) AS mean, round(median(f1_diff), 6) AS median, round(min(f1_diff), 6) AS min, round(max(f1_diff), 6) AS max, round(100 * avg((f1_diff > 0)::INT), 6) AS pct_positive, round(100 * avg((f1_diff < 0)::INT), 6) AS pct_negative FROM v_diff"))
def _(spark, d):
    return M.distribution(_diff(spark, d), "f1_diff")


@query("symmetric_range", sql(_DIFF, select="SELECT round(greatest(abs(min(f1_diff)), abs(max(f1_diff))), 6) AS bound FROM v_diff"))
def _(spark, d):
    return _diff(spark, d).agg(F.round(S.symmetric_bound(F.min("f1_diff"), F.max("f1_diff")), 6).alias("bound"))


@query("relative_change", sql(_BEFORE_AFTER, select="SELECT unit, round((a.f1 - b.f1) / nullif(b.f1, 0), 6) AS change FROM a JOIN b USING (unit)"))
def _(spark, d):
    t = M.group_metrics_before_after(V.predictions(spark, d), "", 0, ["unit"])
    return t.select("unit", F.round(S.relative_change(F.col("f1_after"), F.col("f1_before")), 6).alias("change"))


_TRAIN = PREDICTIONS + ", v_err AS (SELECT unit, count(y) AS n_train, sum(y)::BIGINT AS n_pos_train, sum((y <> part)::INT)::DOUBLE / nullif(count(y), 0) AS pct_err_all, sum((y = 1 AND part = 0)::INT)::DOUBLE / nullif(sum(y), 0) AS pct_err_cls1 FROM (SELECT unit, part, CASE WHEN unit % 6 = 5 AND y = 1 THEN NULL ELSE y END AS y FROM v_pred) GROUP BY unit)"


def _training(spark, d):
    unknown = F.expr("case when unit % 6 = 5 and y = 1 then null else y end")  # units whose positives are unlabelled
    return M.training_errors(V.predictions(spark, d).withColumn("y", unknown), "unit", "part")


@query("train_error_flags", sql(_TRAIN, select="SELECT *, n_train < 10 AS low_sample_flag, n_pos_train = 0 AS no_pos_samples_flag, n_train = 0 AS no_train_flag FROM v_err"))
def _(spark, d):
    return _training(spark, d)


@query("error_summary", sql(_TRAIN, select="SELECT round(avg(pct_err_all), 6) AS mean, round(stddev_samp(pct_err_all), 6) AS std, round(min(pct_err_all), 6) AS min, round(max(pct_err_all), 6) AS max, round(quantile_cont(pct_err_all, 0.9), 6) AS q, sum((pct_err_all IS NULL)::INT)::BIGINT AS n_null, sum((pct_err_all >= (SELECT quantile_cont(pct_err_all, 0.9) FROM v_err))::INT)::BIGINT AS n_hotspots FROM v_err"))
def _(spark, d):
    return M.error_summary(_training(spark, d))


@query("out_of_fold_errors", sql(PREDICTIONS, select="SELECT unit, count(*) AS n_oof, sum((y <> pooled)::INT)::DOUBLE / count(*) AS pct_err_all FROM v_pred GROUP BY unit"))
def _(spark, d):
    p = V.predictions(spark, d)
    return p.groupBy("unit").agg(F.count(F.lit(1)).alias("n_oof"), (F.sum((F.col("y") != F.col("pooled")).cast("bigint")).cast("double") / F.count(F.lit(1))).alias("pct_err_all"))


@query("mode_partition", sql(PLANS, select="SELECT unit, partition_id, n FROM (SELECT unit, partition_id, count(*) AS n, row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, partition_id) AS k FROM v_plan GROUP BY 1, 2) WHERE k = 1"))
def _(spark, d):
    return M.modal_value(V.plans(spark, d), "unit", "partition_id")


@query("label_freq_share", sql(PLANS, select="SELECT plan, partition_id, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY plan) AS share FROM v_plan GROUP BY plan, partition_id"))
def _(spark, d):
    return M.class_shares(V.plans(spark, d), ["plan"], "partition_id")


@query("period_share", sql(PREDICTIONS, select="SELECT month, sum(y)::BIGINT AS n_pos, coalesce(sum(y)::DOUBLE / nullif(count(*), 0), 0) AS share FROM v_pred GROUP BY month"))
def _(spark, d):
    return V.predictions(spark, d).groupBy("month").agg(F.sum("y").cast("bigint").alias("n_pos"), F.coalesce(F.try_divide(F.sum("y").cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("share"))


@query("jaccard_labels", sql(PLANS, select="SELECT partition_id AS label, sum((e AND a)::INT)::BIGINT AS both, count(*) AS either, sum((e AND a)::INT)::DOUBLE / count(*) AS jaccard FROM (SELECT partition_id, unit, bool_or(plan = '1996-01') AS e, bool_or(plan = '1996-02') AS a FROM v_plan WHERE plan IN ('1996-01', '1996-02') GROUP BY 1, 2) GROUP BY 1"))
def _(spark, d):
    p = V.plans(spark, d).select("plan", F.col("partition_id").alias("label"), "unit")
    return M.label_jaccard(p.where("plan = '1996-01'"), p.where("plan = '1996-02'"))


@query("duplicate_assignments", sql(PLANS, select="SELECT unit, count(DISTINCT partition_id) AS labels FROM v_plan WHERE year = 1997 GROUP BY unit HAVING count(DISTINCT partition_id) > 1"))
def _(spark, d):
    return V.plans(spark, d).where("year = 1997").groupBy("unit").agg(F.count_distinct("partition_id").alias("labels")).where("labels > 1")


@query("first_wins", sql(PLANS, select="SELECT unit, arg_min(partition_id, plan) AS partition_id FROM v_plan GROUP BY unit"))
def _(spark, d):
    return J.first_wins(V.plans(spark, d), "unit", "plan", "partition_id")


@query("cumulative_threshold", sql(PANEL, select="SELECT min(n) AS threshold FROM (SELECT n, sum(sum(n)) OVER (ORDER BY n) AS upto, sum(sum(n)) OVER () AS total FROM v_panel GROUP BY n) WHERE upto >= 0.3 * total"))
def _(spark, d):
    return M.cumulative_threshold(V.panel(spark, d), "n", 0.3)


_IMPORTANCE = "v_imp AS (SELECT l_partkey % 40 AS feature, l_discount - 0.05 AS value FROM lineitem)"


@query("importance_ranking", sql(_IMPORTANCE, select="SELECT feature, round(m, 6) AS mean_abs, rank FROM (SELECT feature, m, row_number() OVER (ORDER BY round(m, 9) DESC, feature)::INTEGER AS rank FROM (SELECT feature, avg(abs(value)) AS m FROM v_imp GROUP BY feature)) WHERE rank <= 10 OR rank > 30"))
def _(spark, d):
    li = V.read(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("feature"), (F.col("l_discount") - 0.05).alias("value"))
    return M.mean_abs_ranking(li, "feature", "value")


@query("final_error_by_unit", sql(LONG, select="SELECT unit, model, CASE WHEN n > 0 THEN 1 - (f1_1 + f1_0) / 2 END AS pct_err_all, CASE WHEN n > 0 THEN 1 - f1_1 END AS pct_err_pos FROM (SELECT unit, model, n, coalesce((2 * tp)::DOUBLE / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0) AS f1_1, coalesce((2 * tn)::DOUBLE / nullif((2 * tn + fp + fn)::DOUBLE, 0), 0) AS f1_0 FROM (SELECT unit, model, " + conf() + " FROM v_long GROUP BY unit, model))"))
def _(spark, d):
    m = M.prf(M.models_long(V.predictions(spark, d), MODELS, ["unit"]).groupBy("unit", "model").agg(*M.confusion()), "zero")
    f0 = F.coalesce(F.try_divide((2 * F.col("tn")).cast("double"), (2 * F.col("tn") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return m.select("unit", "model", F.when(F.col("n") > 0, 1 - (F.col("f1") + f0) / 2).alias("pct_err_all"), F.when(F.col("n") > 0, 1 - F.col("f1")).alias("pct_err_pos"))


@query("projection_by_quarter", sql(PANEL, select=f"SELECT *, {rates('zero')} FROM (SELECT year, quarter, {conf('p')} FROM (SELECT year(month)::INTEGER AS year, quarter(month)::INTEGER AS quarter, y, lag(y, 4) OVER (PARTITION BY unit ORDER BY month) AS p FROM v_panel) WHERE p IS NOT NULL GROUP BY year, quarter)"))
def _(spark, d):
    from tessera.operators.panel import lags

    p = lags(V.panel(spark, d).select("unit", "month", "y"), ["y"], [4]).where("y_lag_4 is not null")
    return M.prf(p.groupBy(F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(*M.confusion("y", "y_lag_4")), "zero")


# joins


_MAP = UNITS + ", v_map AS (SELECT unit, region AS partition_id FROM v_unit WHERE unit <> 24)"


@query("left_map_coverage", sql(PREDICTIONS + ", " + _MAP, select="SELECT count(*) AS n, sum((partition_id IS NULL)::INT)::BIGINT AS n_unmapped, sum((partition_id IS NULL)::INT)::DOUBLE / count(*) AS unmapped_share FROM v_pred p LEFT JOIN v_map m ON p.unit = m.unit"))
def _(spark, d):
    m = V.units(spark, d).where("unit <> 24").select("unit", F.col("region").alias("partition_id"))
    return J.coverage(V.predictions(spark, d), J.small(m))


@query("left_map_filled", sql(PREDICTIONS + ", " + _MAP, select="SELECT row_id, coalesce(partition_id, '-1') AS partition_id FROM v_pred p LEFT JOIN v_map m ON p.unit = m.unit"))
def _(spark, d):
    m = V.units(spark, d).where("unit <> 24").select("unit", F.col("region").alias("partition_id"))
    return J.with_partition(V.predictions(spark, d), J.small(m), fail=False).select("row_id", "partition_id")


@query("densify_range", sql(PLANS, select="SELECT r.unit, coalesce(partition_id, 's-1') AS partition_id FROM (SELECT unnest(range(0, 30))::BIGINT AS unit) r LEFT JOIN (SELECT * FROM v_plan WHERE plan = '1996-03') p ON r.unit = p.unit"))
def _(spark, d):
    return J.densified(V.plans(spark, d).where("plan = '1996-03'"), 0, 29, "unit", "partition_id", "s-1")


@query("exactly_one_match", "SELECT o_orderkey, CASE WHEN k IS NULL THEN 'no_match' WHEN k > 1 THEN 'multiple_matches' ELSE 'success' END AS status, CASE WHEN k = 1 THEN part END AS l_partkey FROM (SELECT o_orderkey FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS k, min(l_partkey) AS part FROM lineitem WHERE l_linenumber >= 6 GROUP BY 1) l ON o_orderkey = l_orderkey")
def _(spark, d):
    li = V.read(spark, d, "lineitem").where("l_linenumber >= 6").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return J.exactly_one_match(V.read(spark, d, "orders").select("o_orderkey"), li, ["o_orderkey"], ["l_partkey"])


@query("join_audit", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, a.k IS NOT NULL AND b.k IS NOT NULL AS joined FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey + 20 AS k FROM customer) b ON a.k = b.k")
def _(spark, d):
    a = V.read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = V.read(spark, d, "customer").select((F.col("c_custkey") + 20).alias("k"))  # keys of another numbering: some are in one table only
    return J.join_audit(a, b, "k")


@query("swap_detect", sql(PLANS, select="SELECT a.unit, a.partition_id AS before, b.partition_id AS after FROM v_plan a JOIN v_plan b ON a.unit = b.unit WHERE a.plan = '1996-01' AND b.plan = '1996-02' AND a.partition_id <> b.partition_id"))
def _(spark, d):
    p = V.plans(spark, d)
    return J.swapped(p.where("plan = '1996-01'"), p.where("plan = '1996-02'"), "unit", "partition_id")


@query("map_table", sql(_DIFF, select="SELECT u.unit, u.admin0, f1_diff IS NOT NULL AS measured FROM v_unit u LEFT JOIN (SELECT unit + 3 AS unit, f1_diff FROM v_diff) x ON u.unit = x.unit"))
def _(spark, d):
    x = _diff(spark, d).select((F.col("unit") + 3).alias("unit"), "f1_diff")  # another numbering: some units have no metrics
    return J.checked_join(V.units(spark, d).select("unit", "admin0"), x, "unit", "left").select("unit", "admin0", F.col("f1_diff").isNotNull().alias("measured"))


@query("month_spine", sql(MONTHLY, select="SELECT s.test_month, m.f1 FROM (SELECT strftime(unnest(generate_series(DATE '1994-11-01', DATE '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS test_month) s LEFT JOIN (SELECT strftime(month, '%Y-%m') AS test_month, f1 FROM v_monthly WHERE model = 'pooled') m USING (test_month)"))
def _(spark, d):
    months = spark.range(1).select(F.explode(F.sequence(F.lit("1994-11-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("test_month"))
    m = monthly(spark, d).where("model = 'pooled'").select(F.date_format("month", "yyyy-MM").alias("test_month"), "f1")
    return J.on_spine(months, m, "test_month")


@query("extend_lag", sql(LONG, select="SELECT lag, model, n FROM (SELECT (unit % 3)::BIGINT AS lag, model, count(*) AS n FROM v_long GROUP BY ALL) UNION ALL SELECT 3, model, count(*) FROM v_long WHERE unit % 3 = 2 GROUP BY ALL"))
def _(spark, d):
    g = M.models_long(V.predictions(spark, d), MODELS, ["unit"]).groupBy((F.col("unit") % 3).alias("lag"), "model").agg(F.count(F.lit(1)).alias("n"))
    return J.extend_lag(g, 3, 2)


@query("missing_codes", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 20 FROM customer)")
def _(spark, d):
    return J.missing_codes(V.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), V.read(spark, d, "customer").select((F.col("c_custkey") + 20).alias("k")), "k")


@query("scope_padding", sql(PLANS, select="SELECT u.n_nationkey::BIGINT AS unit, partition_id FROM nation u LEFT JOIN (SELECT * FROM v_plan WHERE plan = '1998-01' AND unit < 11) p ON u.n_nationkey = p.unit"))
def _(spark, d):
    scope = V.read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("unit"))
    return J.scope_padded(scope, V.plans(spark, d).where("plan = '1998-01' and unit < 11").select("unit", "partition_id"), "unit")


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'left only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'union', count(DISTINCT o_custkey) FROM orders")
def _(spark, d):
    o = V.read(spark, d, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 2 = 1").select("o_custkey")
    n = lambda df, kind: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.distinct().join(b.distinct(), "o_custkey", "left_anti"), "left only")).unionByName(n(a.union(b).distinct(), "union"))


@query("multimap_inverted", sql(PLANS, select="SELECT partition_id, string_agg(DISTINCT unit::VARCHAR, ',' ORDER BY unit::VARCHAR) AS units FROM v_plan WHERE plan = '1995-06' GROUP BY partition_id"))
def _(spark, d):
    return V.plans(spark, d).where("plan = '1995-06'").groupBy("partition_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("unit").cast("string"))), ",").alias("units"))


@query("scope_counts", sql(PLANS, select="SELECT year, count(DISTINCT plan) AS plans, round(avg(f1), 6) AS f1_mean FROM v_plan GROUP BY year"))
def _(spark, d):
    return V.plans(spark, d).groupBy("year").agg(F.count_distinct("plan").alias("plans"), F.round(F.avg("f1"), 6).alias("f1_mean"))


@query("plan_index", sql(PLANS, select="SELECT plan, year, month_no, f1, f1_base FROM v_plan GROUP BY ALL"))
def _(spark, d):
    first = F.struct("f1", "f1_base")
    return V.plans(spark, d).groupBy("plan").agg(F.min("year").alias("year"), F.min("month_no").alias("month_no"), F.min_by(first, "unit").alias("s")).select("plan", "year", "month_no", "s.f1", "s.f1_base")


@query("label_codes_per_plan", sql(PLANS, select="SELECT plan, unit, CAST(dense_rank() OVER (PARTITION BY plan ORDER BY first_unit) - 1 AS BIGINT) AS code FROM (SELECT *, min(unit) OVER (PARTITION BY plan, partition_id) AS first_unit FROM v_plan)"))
def _(spark, d):
    p = V.plans(spark, d).withColumn("first_unit", F.min("unit").over(Window.partitionBy("plan", "partition_id")))
    return p.select("plan", "unit", (F.dense_rank().over(Window.partitionBy("plan").orderBy("first_unit")) - 1).cast("bigint").alias("code"))
