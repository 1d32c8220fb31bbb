"""Domain views over the star-schema tables, in Spark and as SQL text for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 4.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark, d) -> DataFrame:
    """25 units on a 5 x 5 lattice with country and region."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    k = F.col("n_nationkey").cast("bigint")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(k.alias("unit"), ((k % 5) * F.lit(STEP)).alias("lat"), (F.floor(k / 5) * F.lit(STEP)).alias("lon"), F.col("n_name").alias("admin0"), F.col("r_name").alias("region"))  # region: five rows


UNITS = "v_unit AS (SELECT CAST(n_nationkey AS BIGINT) AS unit, (n_nationkey % 5) * CAST(4 AS DOUBLE) AS lat, floor(n_nationkey / 5.0) * CAST(4 AS DOUBLE) AS lon, n_name AS admin0, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"


def edges(spark, d) -> DataFrame:
    """Directed rook neighbours of the lattice, by cell."""
    from tessera.operators.spatial import grid_neighbours

    u = units(spark, d).select("unit", (F.col("lat") / STEP).cast("int").alias("row"), (F.col("lon") / STEP).cast("int").alias("col"))
    return grid_neighbours(u, "unit", eight=False)


EDGES = UNITS + ", v_edge AS (SELECT a.unit AS src, b.unit AS dst FROM v_unit a, v_unit b WHERE abs(a.lat - b.lat) + abs(a.lon - b.lon) = 4)"


def order_rows(spark, d) -> DataFrame:
    """Orders with unit, month and price in cents."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").cast("bigint").alias("unit"), F.trunc("o_orderdate", "MM").alias("month"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


_ORDER_ROWS = "v_order AS (SELECT o_orderkey AS row_id, CAST(c_nationkey AS BIGINT) AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey)"


def panel(spark, d) -> DataFrame:
    """(unit, month): n orders, v value, y crisis flag."""
    g = order_rows(spark, d).groupBy("unit", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum((F.col("status") == "F").cast("int")).alias("nf"))
    return g.select("unit", "month", "n", (F.col("cents") / 100.0).alias("v"), (F.col("nf") * 100 > F.col("n") * 34).cast("int").alias("y"))


PANEL = _ORDER_ROWS + ", v_panel AS (SELECT unit, month, count(*) AS n, CAST(sum(cents) AS DOUBLE) / 100.0 AS v, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) * 100 > count(*) * 34 AS INTEGER) AS y FROM v_order GROUP BY unit, month)"


def supply(spark, d) -> DataFrame:
    """(unit, month) of suppliers: quantity q and revenue r, whole numbers as doubles."""
    li = read(spark, d, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("unit"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    return g.select("unit", "month", F.col("q").cast("double").alias("q"), (F.col("cents") / 100.0).alias("r"))


SUPPLY = "v_supply AS (SELECT l_suppkey AS unit, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS r FROM lineitem GROUP BY 1, 2)"


def predictions(spark, d) -> DataFrame:
    """(row_id, unit, month, y, pooled, part): truth and two models' classes."""
    o = order_rows(spark, d)
    return o.select("row_id", "unit", "month", (F.col("status") == "F").cast("int").alias("y"), (F.col("cents") > 25_000_000).cast("int").alias("pooled"), F.col("priority").isin("1-URGENT", "2-HIGH").cast("int").alias("part"))


PREDICTIONS = _ORDER_ROWS + ", v_pred AS (SELECT row_id, unit, month, CAST(status = 'F' AS INTEGER) AS y, CAST(cents > 25000000 AS INTEGER) AS pooled, CAST(priority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS part FROM v_order)"


def plans(spark, d) -> DataFrame:
    """(plan, year, month_no, unit, partition_id, f1, f1_base): one partition of the units for each month."""
    p, o = predictions(spark, d), order_rows(spark, d)
    f = lambda c: F.try_divide(2.0 * F.sum(F.col("y") * F.col(c)), (F.sum("y") + F.sum(c)).cast("double"))
    scores = p.groupBy("month").agg(F.coalesce(f("part"), F.lit(0.0)).alias("f1"), F.coalesce(f("pooled"), F.lit(0.0)).alias("f1_base"))
    parts = o.groupBy("unit", "month").agg((F.sum("cents") > F.count(F.lit(1)) * 17_000_000).alias("high"))
    j = parts.join(scores, "month")
    return j.select(F.date_format("month", "yyyy-MM").alias("plan"), F.year("month").alias("year"), F.month("month").alias("month_no"), "unit", F.when(F.col("high"), "1").otherwise("0").alias("partition_id"), "f1", "f1_base")


PLANS = PREDICTIONS + """, v_score AS (SELECT month, coalesce(2.0 * CAST(sum(y * part) AS DOUBLE) / nullif(CAST(sum(y) + sum(part) AS DOUBLE), 0), 0) AS f1, coalesce(2.0 * CAST(sum(y * pooled) AS DOUBLE) / nullif(CAST(sum(y) + sum(pooled) AS DOUBLE), 0), 0) AS f1_base FROM v_pred GROUP BY month),
v_plan AS (SELECT strftime(o.month, '%Y-%m') AS plan, CAST(year(o.month) AS INTEGER) AS year, CAST(month(o.month) AS INTEGER) AS month_no, unit, CASE WHEN sum(cents) > count(*) * 17000000 THEN '1' ELSE '0' END AS partition_id, any_value(f1) AS f1, any_value(f1_base) AS f1_base FROM v_order o JOIN v_score s ON o.month = s.month GROUP BY o.month, unit)"""


def sql(*views: str, select: str) -> str:
    """WITH the views, each once, then the statement."""
    seen, out = set(), []
    for v in views:
        for part in _split(v):
            name = part.split(" AS ", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(part)
    return "WITH " + ",\n".join(out) + "\n" + select


def _split(views: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(views):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(views[last:i].strip())
            last = i + 1
    out.append(views[last:].strip())
    return out
