"""Panel preparation: scans, scalar functions, encodings, imputation, lags and dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalar as S
from tessera.operators import panel as P
from tessera.plans import fixtures as V
from tessera.plans.fixtures import PANEL, PREDICTIONS, SUPPLY, UNITS, sql

QUERIES: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = (f, text)
        return f

    return add


@query("not_null_filter", "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return V.read(spark, d, "documents").drop("text", "n_chars", "no_such_column").where("lang is not null and source is not null").select("doc_id", "lang")


@query("boolean_recode", sql(PREDICTIONS, select="SELECT row_id, CASE WHEN flag = 'True' THEN '1' WHEN flag = 'False' THEN '0' ELSE flag END AS flag FROM (SELECT row_id, CASE unit % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'other' END AS flag FROM v_pred)"))
def _(spark, d):
    p = V.predictions(spark, d)
    text = F.when(F.col("unit") % 3 == 0, "True").when(F.col("unit") % 3 == 1, "False").otherwise("other")
    return p.select("row_id", S.recode_boolean(text).alias("flag"))


@query("threshold_indicator", "SELECT o_orderkey AS row_id, CAST(coalesce(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 END >= 3, false) AS INTEGER) AS flag FROM orders")
def _(spark, d):
    c = F.when(F.col("o_custkey") % 7 == 0, None).otherwise(F.col("o_custkey") % 5)
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), S.threshold_flag(c, 3).alias("flag"))


@query("date_parts", sql(PANEL, select="""SELECT unit, month, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_no, CAST((month(month) - 1) // 3 + 1 AS INTEGER) AS quarter,
  CASE WHEN month(month) IN (12, 1, 2, 3) THEN 'DJFM' WHEN month(month) IN (4, 5, 6, 7) THEN 'AMJJ' ELSE 'ASON' END AS season, CAST(year(month) + (month(month) = 12)::INT AS INTEGER) AS season_year,
  CAST(year(month) AS VARCHAR) || '-Q' || CAST((month(month) - 1) // 3 + 1 AS VARCHAR) AS year_quarter FROM v_panel"""))
def _(spark, d):
    y, m = F.year("month"), F.month("month")
    q = S.quarter_of_month(m)
    return V.panel(spark, d).select("unit", "month", y.alias("year"), m.alias("month_no"), q.alias("quarter"), S.season_of(m).alias("season"), S.season_year(y, m).alias("season_year"), S.year_quarter(y, q).alias("year_quarter"))


@query("one_hot_years", sql(PANEL, select="SELECT unit, month, " + ", ".join(f"CAST(year(month) = {y} AS INTEGER) AS year_{y}" for y in range(1995, 2002)) + " FROM v_panel"))
def _(spark, d):
    p = V.panel(spark, d).select("unit", "month", F.year("month").alias("y4"))
    return P.one_hot(p, "y4", "year_", list(range(1995, 2002))).drop("y4")


@query("first_appearance_codes", "SELECT s_suppkey AS unit, n_name AS iso, CAST(dense_rank() OVER (ORDER BY first_seen, n_name) - 1 AS BIGINT) AS code FROM (SELECT s_suppkey, n_name, min(s_suppkey) OVER (PARTITION BY n_name) AS first_seen FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def _(spark, d):
    s = V.read(spark, d, "supplier").join(V.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("unit"), F.col("n_name").alias("iso"))
    return P.codes_by_first_appearance(s, "iso", "unit", "code")


@query("dense_group_ids", "SELECT p_partkey, p_brand, p_size, CAST(dense_rank() OVER (ORDER BY p_brand, p_size) - 1 AS BIGINT) AS group_id FROM part")
def _(spark, d):
    return P.dense_group_id(V.read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])


_HOLES = ", v_hole AS (SELECT unit, month, CASE WHEN (unit + month(month)) % 4 = 0 THEN NULL ELSE q END AS q, CASE WHEN (unit + month(month)) % 5 = 0 THEN NULL ELSE -r END AS r FROM v_supply)"


def _holes(spark, d):
    s = V.supply(spark, d)
    at = F.col("unit") + F.month("month")
    return s.select("unit", "month", F.when(at % 4 == 0, F.lit(float("nan"))).otherwise(F.col("q")).alias("q"), F.when(at % 5 == 0, None).otherwise(-F.col("r")).alias("r"))


def _impute_sql(hi: str) -> str:
    return sql(SUPPLY + _HOLES, select=f"SELECT unit, month, coalesce(q, {hi.format(c='q')}) AS q, coalesce(r, {hi.format(c='r')}) AS r FROM v_hole, (SELECT min(q) AS lo_q, max(q) AS hi_q, min(r) AS lo_r, max(r) AS hi_r FROM v_hole)")


for _strategy, _text in (("max_plus", "hi_{c} * 100.0"), ("min_minus", "lo_{c} - (hi_{c} - lo_{c}) * 100.0"), ("extreme_low", "lo_{c} - (hi_{c} - lo_{c}) * 100.0"), ("extreme_high", "hi_{c} + (hi_{c} - lo_{c}) * 100.0")):

    @query(f"impute_{_strategy}", _impute_sql(_text))
    def _(spark, d, strategy=_strategy):
        h = _holes(spark, d)
        return P.OutOfRangeImputer(["q", "r"], strategy).fit(h).transform(h)


@query("impute_mean", sql(SUPPLY + _HOLES, select="SELECT unit, month, round(coalesce(q, avg(q) OVER ()), 6) AS q FROM v_hole"))
def _(spark, d):
    h = _holes(spark, d).select("unit", "month", S.finite_or_null(F.col("q")).alias("q"))
    return P.mean_imputed(h, ["q"]).withColumn("q", F.round("q", 6))


@query("infinite_to_zero", sql(SUPPLY + _HOLES, select="SELECT unit, month, coalesce(q, 0) AS q FROM v_hole"))
def _(spark, d):
    return _holes(spark, d).select("unit", "month", S.finite_or_zero(F.when(F.isnan("q"), F.lit(float("inf"))).otherwise(F.col("q"))).alias("q"))


@query("complete_rows", sql(SUPPLY + _HOLES, select="SELECT unit, month, q, r FROM v_hole WHERE q IS NOT NULL AND r IS NOT NULL"))
def _(spark, d):
    return _holes(spark, d).withColumn("q", S.finite_or_null(F.col("q"))).dropna("any", subset=["q", "r"])


@query("safe_numbers", "SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'x1' WHEN 1 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE) AS num, CAST(coalesce(floor(TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'x1' WHEN 1 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE)), 0) AS BIGINT) AS whole FROM events")
def _(spark, d):
    t = F.when(F.col("event_id") % 4 == 0, "x1").when(F.col("event_id") % 4 == 1, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return V.read(spark, d, "events").select("event_id", S.to_double(t).alias("num"), S.to_int(t).alias("whole"))


@query("admin_codes", r"SELECT c_custkey, regexp_replace(trim(raw), '\.0$', '') AS code, CASE WHEN trim(raw) IN ('', 'nan', 'NaN', 'None', '<NA>', '-1', 's-1') THEN NULL ELSE trim(raw) END AS known, CASE WHEN starts_with(raw, 's') THEN raw ELSE 's' || raw END AS prefixed, CASE WHEN regexp_full_match(raw, '[01]+|root') THEN raw ELSE 'root' END AS branch FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' 12.0' WHEN 1 THEN 'nan' WHEN 2 THEN 's-1' WHEN 3 THEN '0110' WHEN 4 THEN 'root' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer)")
def _(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, " 12.0").when(k % 6 == 1, "nan").when(k % 6 == 2, "s-1").when(k % 6 == 3, "0110").when(k % 6 == 4, "root").otherwise(k.cast("string"))
    c = V.read(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    r = F.col("raw")
    return c.select("c_custkey", S.plain_code(r).alias("code"), S.known_code(r).alias("known"), S.with_prefix(r).alias("prefixed"), S.branch_or_root(r).alias("branch"))


@query("branch_codec", "SELECT CAST(n_nationkey AS BIGINT) AS idx, lpad(bin(n_nationkey), 5, '0') AS branch, CAST(n_nationkey AS BIGINT) AS back FROM nation")
def _(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"))
    return n.select("idx", S.branch_of_index(F.col("idx"), 5).alias("branch")).select("*", S.index_of_branch(F.col("branch")).alias("back"))


@query("plan_names", sql(PANEL, select="SELECT DISTINCT 'gf_' || CAST(year(month) AS VARCHAR) || '_' || lpad(CAST(month(month) AS VARCHAR), 2, '0') || '_fs' || CAST(unit % 4 AS VARCHAR) AS plan FROM v_panel"))
def _(spark, d):
    return V.panel(spark, d).select(S.plan_name(F.lit("gf"), F.year("month"), F.month("month"), F.col("unit") % 4).alias("plan")).distinct()


@query("scope_lags", sql(PANEL, select="SELECT unit, month, CAST(CASE unit % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 12 END AS INTEGER) AS lag_months FROM v_panel"))
def _(spark, d):
    from tessera.functions.settings import LAGS

    lags = F.array(*[F.lit(x) for x in (1, *LAGS)])
    return V.panel(spark, d).select("unit", "month", F.element_at(lags, (F.col("unit") % 4 + 1).cast("int")).alias("lag_months"))


@query("date_cutoff", sql(PANEL, select="SELECT unit, month, y FROM v_panel WHERE year(month) > 1997 OR (year(month) = 1997 AND month(month) >= 5)"))
def _(spark, d):
    p = V.panel(spark, d).withColumn("year", F.year("month")).withColumn("month_no", F.month("month"))
    return P.date_cutoff(p, 1997, month=5).select("unit", "month", "y")


@query("quarter_cutoff", sql(PANEL, select="SELECT unit, month, y FROM v_panel WHERE year(month) > 1999 OR (year(month) = 1999 AND quarter(month) >= 3)"))
def _(spark, d):
    p = V.panel(spark, d).withColumn("year", F.year("month")).withColumn("quarter", F.quarter("month"))
    return P.date_cutoff(p, 1999, quarter=3).select("unit", "month", "y")


@query("truth_filter", sql(PREDICTIONS, select="SELECT 'crisis' AS kind, row_id FROM v_pred WHERE y = 1 UNION ALL SELECT 'noncrisis', row_id FROM v_pred WHERE y = 0"))
def _(spark, d):
    p = V.predictions(spark, d)
    return P.truth_filter(p, "crisis").select(F.lit("crisis").alias("kind"), "row_id").unionByName(P.truth_filter(p, "noncrisis").select(F.lit("noncrisis").alias("kind"), "row_id"))


@query("grid_cells", sql(UNITS, select="SELECT unit, cell, CAST(floor(cell / ncol) AS BIGINT) AS row_no, CAST(cell % ncol AS BIGINT) AS col_no FROM (SELECT unit, ncol, CAST(floor((lat - y0) / 6.0) * ncol + floor((lon - x0) / 6.0) AS BIGINT) AS cell FROM (SELECT *, min(lat) OVER () AS y0, min(lon) OVER () AS x0, floor((max(lon) OVER () - min(lon) OVER ()) / 6.0) + 1 AS ncol FROM v_unit))"))
def _(spark, d):
    u = V.units(spark, d)
    e = u.agg(F.min("lat").alias("y0"), F.min("lon").alias("x0"), F.max("lon").alias("x1")).first()
    n = int((e["x1"] - e["x0"]) // 6.0) + 1
    cell = S.grid_cell(F.col("lat"), F.col("lon"), F.lit(e["y0"]), F.lit(e["x0"]), 6.0, F.lit(n)).cast("bigint")
    return u.select("unit", cell.alias("cell")).select("unit", "cell", F.floor(F.col("cell") / n).alias("row_no"), (F.col("cell") % n).alias("col_no"))


@query("reorigin", sql(UNITS, select="SELECT unit, lat - min(lat) OVER () AS lat, lon - min(lon) OVER () AS lon FROM (SELECT unit, lat + 10 AS lat, lon - 3 AS lon FROM v_unit)"))
def _(spark, d):
    u = V.units(spark, d).select("unit", (F.col("lat") + 10).alias("lat"), (F.col("lon") - 3).alias("lon"))
    return P.reorigin(u, ["lat", "lon"])


@query("label_remap", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS INTEGER) AS label FROM orders")
def _(spark, d):
    codes = spark.createDataFrame([("F", 2), ("O", 1), ("P", 0)], "o_orderstatus string, label int")
    return V.read(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(F.broadcast(codes), "o_orderstatus").select("o_orderkey", "label")


@query("time_variant_features", sql(PANEL, select="SELECT feature, max(k) AS most_values, max(k) > 2 AS time_variant FROM (SELECT unit, year(month) AS yr, 'n' AS feature, count(DISTINCT n) AS k FROM v_panel GROUP BY 1, 2 UNION ALL SELECT unit, year(month), 'y', count(DISTINCT y) FROM v_panel GROUP BY 1, 2) GROUP BY feature"))
def _(spark, d):
    p = V.panel(spark, d).withColumn("yr", F.year("month"))
    return P.time_variant_features(p, ["n", "y"], ["unit", "yr"])


@query("class_weights", sql(PREDICTIONS, select="SELECT y, count(*) AS n, CASE WHEN count(*) < 5 THEN CAST(1 AS DOUBLE) ELSE least(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 100.0) END AS weight FROM v_pred GROUP BY y"))
def _(spark, d):
    return P.class_weights(V.predictions(spark, d))


@query("positive_weight", sql(PREDICTIONS, select="SELECT coalesce(CAST(sum(1 - y) AS DOUBLE) / nullif(sum(y), 0), 1.0) AS scale_pos_weight FROM v_pred"))
def _(spark, d):
    return V.predictions(spark, d).agg(F.coalesce(F.try_divide(F.sum(1 - F.col("y")).cast("double"), F.sum("y")), F.lit(1.0)).alias("scale_pos_weight"))


@query("lags_target", sql(PANEL, select="SELECT unit, month, y, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY unit ORDER BY month) AS y_lag_{k}" for k in (4, 8, 12)) + " FROM v_panel"))
def _(spark, d):
    return P.lags(V.panel(spark, d).select("unit", "month", "y"), ["y"], [4, 8, 12])


@query("lags_1_12", sql(SUPPLY, select="SELECT unit, month, " + ", ".join(f"lag(q, {k}) OVER (PARTITION BY unit ORDER BY month) AS q_l{k}" for k in range(1, 13)) + " FROM v_supply"))
def _(spark, d):
    return P.lags(V.supply(spark, d).select("unit", "month", "q"), ["q"], list(range(1, 13)), suffix="_l").drop("q")


@query("calendar_lag", sql(PANEL, select="SELECT a.unit, a.month, a.y, b.y AS y_cal_4 FROM v_panel a LEFT JOIN v_panel b ON a.unit = b.unit AND a.month = CAST(b.month + INTERVAL 4 MONTH AS DATE)"))
def _(spark, d):
    return P.calendar_lag(V.panel(spark, d).select("unit", "month", "y"), ["y"], 4)


@query("rolling_full_window", sql(SUPPLY, select="SELECT unit, month, " + ", ".join(f"CASE WHEN count(q) OVER w{w} = {w} THEN sum(q) OVER w{w} END AS q_m{w}" for w in (4, 12)) + " FROM v_supply WINDOW " + ", ".join(f"w{w} AS (PARTITION BY unit ORDER BY month ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (4, 12))))
def _(spark, d):
    return P.rolling_sums(V.supply(spark, d).select("unit", "month", "q"), ["q"], [4, 12]).drop("q")


@query("lag_triple_by_quarter", sql(PANEL + ", q AS (SELECT unit, CAST(year(month) AS INTEGER) AS year, CAST(quarter(month) AS INTEGER) AS quarter, max(y) AS y FROM v_panel GROUP BY 1, 2, 3)", select="SELECT unit, year, quarter, lag(y, 3) OVER w AS l3, lag(y, 2) OVER w AS l2, lag(y, 1) OVER w AS l1 FROM q WINDOW w AS (PARTITION BY unit ORDER BY year, quarter)"))
def _(spark, d):
    q = V.panel(spark, d).groupBy("unit", F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(F.max("y").alias("y"))
    q = q.withColumn("at", F.struct("year", "quarter"))
    return P.lags(q, ["y"], [3, 2, 1], time="at", suffix="_l").select("unit", "year", "quarter", F.col("y_l3").alias("l3"), F.col("y_l2").alias("l2"), F.col("y_l1").alias("l1"))


@query("resolve_alias", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS unit FROM customer")
def _(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("code_a"), F.col("c_nationkey").cast("string").alias("code_b"))
    return P.resolve_alias(c, ["code_a", "code_b", "code_c"], "unit")


@query("keep_first_and_last", "SELECT l_orderkey, CAST(min(l_partkey) AS BIGINT) AS first_part, CAST(max(l_partkey) AS BIGINT) AS last_part FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    li = V.read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    first = P.keep_one(li, "l_orderkey", F.col("l_partkey").asc()).withColumnRenamed("l_partkey", "first_part")
    last = P.keep_one(li, "l_orderkey", F.col("l_partkey").desc()).withColumnRenamed("l_partkey", "last_part")
    return first.join(last, "l_orderkey")


@query("max_normalised", sql(SUPPLY, select="SELECT unit, month, q / max(q) OVER () AS share FROM v_supply"))
def _(spark, d):
    return P.max_normalised(V.supply(spark, d), "q", "share").select("unit", "month", "share")


@query("feature_selection", "SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def _(spark, d):
    from tessera.functions.settings import aligned_columns, columns_to_drop

    s = V.read(spark, d, "supplier")
    s = s.drop(*columns_to_drop(s.columns, ["s_nationkey"], ["s_x*"], ["s_name"]))
    return s.select(*aligned_columns(s.columns, ["s_suppkey", "s_acctbal", "s_name"]))


@query("csv_round_trip", "SELECT n_nationkey AS unit, n_name AS admin0, lpad(CAST(n_nationkey % 4 AS VARCHAR), 2, '0') AS partition_id FROM nation")
def _(spark, d):
    from tessera.sources.tables import read_csv, scratch, write_csv

    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("admin0"), F.lpad((F.col("n_nationkey") % 4).cast("string"), 2, "0").alias("partition_id"))
    path = write_csv(n, scratch(spark, "mapping"))
    return read_csv(spark, path, T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("admin0", T.StringType()), T.StructField("partition_id", T.StringType())]))


@query("glob_scan_with_names", sql(PANEL, select="SELECT CAST(year(month) AS INTEGER) AS year, CAST(0 AS INTEGER) AS scope, count(*) AS n FROM v_panel WHERE year(month) < 1998 GROUP BY 1"))
def _(spark, d):
    from tessera.sources.tables import read_result_files, scratch, write_csv

    p = V.panel(spark, d)
    base = scratch(spark, "results")
    for y in (1995, 1996, 1997):
        write_csv(p.where(F.year("month") == y).select("unit", "y"), f"{base}/results_fs0_{y}_{y}.csv")
    r = read_result_files(spark, f"{base}/results_fs*", "unit bigint, y int")
    return r.groupBy(F.col("start_year").alias("year"), "scope").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_keep_last", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS status FROM orders")
def _(spark, d):
    from tessera.sources.tables import upsert

    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return upsert(o.withColumn("status", F.lit("old")), o.where("id % 3 = 0").withColumn("status", F.lit("new")), "id")


@query("sha_of_id_set", "SELECT CAST(c_nationkey AS BIGINT) AS unit, sha256(string_agg(k, '' ORDER BY k)) AS sha FROM (SELECT DISTINCT c_nationkey, CAST(c_custkey AS VARCHAR) AS k FROM customer) GROUP BY c_nationkey")
def _(spark, d):
    from tessera.sources.tables import set_hash

    return V.read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("unit")).agg(set_hash(F.col("c_custkey")).alias("sha"))


@query("json_report", sql(PANEL, select="SELECT CAST(year(month) AS INTEGER) AS year, '{\"n\":' || count(*) || ',\"crises\":' || CAST(sum(y) AS BIGINT) || '}' AS report FROM v_panel GROUP BY 1"))
def _(spark, d):
    g = V.panel(spark, d).groupBy(F.year("month").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("crises"))
    return g.select("year", F.to_json(F.struct("n", "crises")).alias("report"))
