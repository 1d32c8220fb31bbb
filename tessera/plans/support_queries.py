"""Files, node state, tests, months and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import settings as Z
from tessera.operators import consensus as C
from tessera.operators import spatial as G
from tessera.operators import splits as X
from tessera.operators import tree as T
from tessera.plans import fixtures as V
from tessera.plans.fixtures import PANEL, PREDICTIONS, UNITS, sql
from tessera.sources import tables as R

QUERIES: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = (f, text)
        return f

    return add


@query("csv_subset", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def _(spark, d):
    path = R.write_csv(V.read(spark, d, "customer"), R.scratch(spark, "customer"))
    return R.read_csv(spark, path, "c_nationkey bigint, c_custkey string")


@query("fallback_path", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return spark.read.parquet(R.first_existing(spark, [f"{d}/region_missing.parquet", f"{d}/region.parquet", f"{d}/nation.parquet"])).select("r_regionkey", "r_name")


@query("table_round_trip", sql(PANEL, select="SELECT unit, month, n, v, y, CAST(year(month) AS INTEGER) AS year FROM v_panel"))
def _(spark, d):
    path = R.save_table(V.panel(spark, d).withColumn("year", F.year("month")), R.scratch(spark, "panel"), by=["year"])
    return spark.read.parquet(path)


@query("yearly_from_monthly", sql(PANEL, select="SELECT unit, y, CASE WHEN month > DATE '1996-01-01' THEN n END AS n FROM v_panel WHERE month BETWEEN DATE '1996-01-01' AND DATE '1996-03-01'"))
def _(spark, d):
    p, base = V.panel(spark, d), R.scratch(spark, "months")
    paths = [f"{base}/1996-{m:02d}.csv" for m in (1, 2, 3)]
    for m, path in enumerate(paths):
        rows = p.where(F.col("month") == F.lit(f"1996-{m + 1:02d}-01").cast("date"))
        R.write_csv(rows.select("unit", "y") if m == 0 else rows.select("unit", "n", "y"), path)  # the first month lacks n
    return R.read_all(spark, paths, {paths[0]: "unit bigint, y int"}, "unit bigint, n bigint, y int")


@query("log_appended", "SELECT * FROM (VALUES ('lags 4, 8, 12', 2), ('exported', 1)) AS t(message, n)")
def _(spark, d):
    path = R.scratch(spark, "log")
    for message in ("lags " + ", ".join(map(str, Z.checked_lags((4, 8, 12)))), "exported", "lags 4, 8, 12"):
        R.append_log(spark, path, message)
    return spark.read.parquet(path).where("at is not null").groupBy("message").agg(F.count(F.lit(1)).cast("int").alias("n"))


_SIDES = UNITS + ", v_round AS (SELECT '' AS branch_id, unit, CAST(lat >= 8 AS INTEGER) AS side FROM v_unit UNION ALL SELECT '1', unit, CAST(lon >= 8 AS INTEGER) FROM v_unit WHERE lat >= 8)"


@query("branch_file_sets", sql(_SIDES, select="SELECT branch_id, count(*) AS scope, count(*) FILTER (side = 0) AS side0, count(*) FILTER (side = 1) AS side1, sha256(string_agg(CAST(unit AS VARCHAR), '' ORDER BY CAST(unit AS VARCHAR))) AS sha FROM v_round GROUP BY branch_id"))
def _(spark, d):
    u, base = V.units(spark, d), R.scratch(spark, "rounds")
    R.write_csv(u.select("unit", (F.col("lat") >= 8).cast("int").alias("side")), f"{base}/branch_root.csv")
    R.write_csv(u.where("lat >= 8").select("unit", (F.col("lon") >= 8).cast("int").alias("side")), f"{base}/branch_1.csv")
    return R.branch_sets(R.branch_files(spark, f"{base}/branch_*.csv"))


_SHARE = "CAST(CAST('0x' || substr(md5('7:' || row_id), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0"


@query("random_split", sql(PREDICTIONS, select=f"SELECT row_id, CAST({_SHARE} < 0.2 AS INTEGER) AS set FROM v_pred"))
def _(spark, d):
    return X.random_split(V.predictions(spark, d).select("row_id"), "row_id", 0.2, seed=7)


_NODE = sql(PREDICTIONS, select="SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM v_pred q WHERE q.unit = p.unit AND q.row_id = p.row_id AND q.y = 1) THEN '1' ELSE '' END AS branch_id, unit AS group_id FROM v_pred p")


@query("node_relabelled", _NODE)
def _(spark, d):
    p = V.predictions(spark, d)
    state = T.initial_state(p.select(F.col("row_id").alias("id"), "unit", "y"), "id", "unit")
    return T.relabelled(state, p.where("y = 1").select("row_id"), "row_id", "1").select("row_id", "branch_id", "group_id")


@query("children_recombined", sql(PREDICTIONS, select="SELECT branch_id, count(*) AS n, sum(y)::BIGINT AS n_pos, count(*) >= 500 AS valid FROM (SELECT CAST(unit % 2 AS VARCHAR) AS branch_id, y FROM v_pred) GROUP BY branch_id"))
def _(spark, d):
    p = T.initial_state(V.predictions(spark, d), "row_id", "unit")
    sides = V.units(spark, d).where("unit % 2 = 1").select("unit", F.lit(1).alias("side"))  # groups without a side go to 0
    state = T.split_rows(p, sides, "unit")
    both = T.recombined(T.node_rows(state, "0"), T.node_rows(state, "1"))
    valid = F.when(F.col("branch_id") == "0", F.lit(T.valid_node(T.node_rows(state, "0"), 500))).otherwise(F.lit(T.valid_node(T.node_rows(state, "1"), 500)))
    return both.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("n_pos")).withColumn("valid", valid)


@query("eigengap_of_cliques", sql(UNITS, select="SELECT k AS clusters, CAST(1.25 AS DOUBLE) AS gap FROM (SELECT count(DISTINCT region) AS k FROM v_unit)"))
def _(spark, d):
    """Nations of a region are linked with each other: as many eigenvalues of 0 as regions, then 1.25 = 5 / 4."""
    u = V.units(spark, d)
    e = u.alias("a").join(u.alias("b"), "region").where("a.unit <> b.unit").select(F.col("a.unit").alias("src"), F.col("b.unit").alias("dst"), F.lit(1.0).alias("weight"))
    k, values = C.eigengap(e)
    return spark.createDataFrame([(k, round(values[k] - values[k - 1], 6) + 0.0)], "clusters bigint, gap double")


@query("sig_test_paired", sql(PREDICTIONS, select="SELECT level, n, coalesce(m >= 0.0005 AND m / (s / sqrt(n)) > cut AND m / s >= 0.5, FALSE) AS accept FROM (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT (part = y)::INT::DOUBLE + 1 - (pooled = y)::INT::DOUBLE AS x FROM v_pred)), (VALUES (0.05::DOUBLE, 1.645), (0.001::DOUBLE, 3.09)) AS c(level, cut)"))
def _(spark, d):
    hit = lambda c: (F.col(c) == F.col("y")).cast("double")
    p = V.predictions(spark, d).select((hit("part") + 1).alias("split"), hit("pooled").alias("base"))
    n = p.count()
    return spark.createDataFrame([(level, n, G.paired_test(p, "split", "base", level)) for level in (0.05, 0.001)], "level double, n bigint, accept boolean")


@query("critical_values", "SELECT df, level::DOUBLE AS level, t::DOUBLE AS t FROM (VALUES (1, 0.05, 6.314), (3, 0.05, 2.353), (10, 0.01, 2.764), (20, 0.005, 2.845), (30, 0.1, 1.31), (60, 0.0005, 3.46), (120, 0.05, 1.658), (1000, 0.001, 3.098)) AS v(df, level, t)")
def _(spark, d):
    cases = [(1, 0.05), (3, 0.05), (10, 0.01), (20, 0.005), (30, 0.1), (60, 0.0005), (120, 0.05), (1000, 0.001)]
    return spark.createDataFrame([(n, a, G.critical_t(n, a)) for n, a in cases], "df int, level double, t double")


@query("month_list", "SELECT m::DATE AS month, CASE WHEN month(m) IN (2, 6, 10) THEN 'm' || month(m) ELSE 'general' END AS map FROM (SELECT unnest(generate_series(DATE '2021-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS m)")
def _(spark, d):
    special = {m: f"m{m}" for m in (2, 6, 10)}
    return spark.createDataFrame([(m, Z.mapping_for_month(m.month, special, "general")) for m in Z.months_between("2021-01", "2024-12-31")], "month date, map string")


_PLACED = "v_point AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 400) / 10.0::DOUBLE - 9.95 AS lat, (s_suppkey * 53 % 380) / 10.0::DOUBLE - 8.95 AS lon FROM supplier)"


@query("points_in_polygons", sql(UNITS, _PLACED, select="SELECT id, unit, d2 = 0 AS inside FROM (SELECT p.id, u.unit, d2, row_number() OVER (PARTITION BY p.id ORDER BY d2, u.unit) AS k FROM v_point p, LATERAL (SELECT unit, greatest(lat - p.lat, p.lat - lat - 4, 0) ** 2 + greatest(lon - p.lon, p.lon - lon - 4, 0) ** 2 AS d2 FROM v_unit) u) WHERE k = 1"))
def _(spark, d):
    u = V.units(spark, d)
    x, y = F.col("lat"), F.col("lon")
    side = lambda a, b, c, e: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"))
    s = u.select("unit", F.explode(F.array(side(x, y, x + 4, y), side(x + 4, y, x + 4, y + 4), side(x + 4, y + 4, x, y + 4), side(x, y + 4, x, y))).alias("s")).select("unit", "s.*")
    k = F.col("s_suppkey")
    points = V.read(spark, d, "supplier").select(k.alias("id"), ((k * 37 % 400) / 10.0 - 9.95).alias("lat"), ((k * 53 % 380) / 10.0 - 8.95).alias("lon"))
    return G.in_polygons(points.withColumnRenamed("id", "point"), s, "point").withColumnRenamed("point", "id")


@query("nearest_unit_of_point", sql(UNITS, _PLACED, select="SELECT id, unit AS nearest FROM (SELECT p.id, u.unit, row_number() OVER (PARTITION BY p.id ORDER BY round((u.lat - p.lat) ** 2 + (u.lon - p.lon) ** 2, 6), u.unit) AS k FROM v_point p, v_unit u) WHERE k = 1"))
def _(spark, d):
    from tessera.operators.joins import nearest

    k = F.col("s_suppkey")
    points = V.read(spark, d, "supplier").select(k.alias("unit"), ((k * 37 % 400) / 10.0 - 9.95).alias("lat"), ((k * 53 % 380) / 10.0 - 8.95).alias("lon"))
    return nearest(points, V.units(spark, d).select("unit", "lat", "lon")).select(F.col("unit").alias("id"), "nearest")
