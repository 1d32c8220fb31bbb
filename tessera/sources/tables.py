"""Reading and writing the pipeline's files: pinned schemas, names in paths, upserts, hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; one of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The columns of a schema (a StructType or DDL text) by their names in the header, whatever other columns there are.

    All is read as text, so codes keep their zeros; what can't be cast is null. The scan parses only the wanted columns.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that there is, in whatever file system it names."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(candidates)


def append_log(spark: SparkSession, path: str, message: str) -> str:
    """One more row (at, message) in a log."""
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(message).alias("message")).write.mode("append").parquet(path)
    return path


def branch_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(branch_id, unit, side) of all files of a pattern with ``branch_B.csv`` in their paths; the root's B is ``root``."""
    rows = spark.read.schema("unit bigint, side int").option("header", True).csv(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"branch_(root|[01]+)\.csv", 1)
    return rows.select(F.when(name == "root", "").otherwise(name).alias("branch_id"), "unit", "side")


def branch_sets(rounds: DataFrame) -> DataFrame:
    """(branch_id, scope, side0, side1, sha): sizes of a branch's scope and children, and the hash of its scope."""
    n = lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("unit")))
    return rounds.groupBy("branch_id").agg(F.count_distinct("unit").alias("scope"), n(0).alias("side0"), n(1).alias("side1"), set_hash(F.col("unit")).alias("sha"))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_result_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern, with scope, start_year and end_year from ``fsS_YYYY_YYYY`` in their paths."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern).select("*", F.col("_metadata.file_path").alias("__path"))
    part = lambda i: F.regexp_extract("__path", r"fs(\d+)_(\d{4})_(\d{4})", i).cast("int")
    return rows.select("*", part(1).alias("scope"), part(2).alias("start_year"), part(3).alias("end_year")).drop("__path")


def read_all(spark: SparkSession, paths: list[str], schemas: dict[str, str], schema: str) -> DataFrame:
    """Monthly files, in the order of their names, as one yearly table; columns that some lack are null there.

    ``schema`` holds for every file that ``schemas`` gives none of its own for. Columns are found by their names.
    """
    out = None
    for p in sorted(paths):
        df = read_csv(spark, p, schemas.get(p, schema))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new rows; of equal keys the newest row stays."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (key, "__age")]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*fields), "__age").alias("__r"))
    return latest.select(key, *[F.col(f"__r.{c}").alias(c) for c in fields])


def set_hash(c: Column) -> Column:
    """SHA-256 of a set of ids: sorted as text and joined."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(c.cast("string"))), ""), 256)


def save_table(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Parquet in place of pickles and array files."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return path


def save_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
