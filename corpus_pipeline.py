"""A cleaning pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with whatever columns more there are:

1. language ID: a document goes if its text is null or has no letter, so that no language can be told.
2. n-gram Jaccard join: 5-word shingles at 0.8; of linked documents the one with the smallest doc_id stays.
3. benchmark decontamination: a document goes if it contains an item of ``benchmark`` to half or more of its words.
4. mixing: each document appears as often as its source's target has it, twice at most, perhaps not at all.
5. token files: the rows are those read back from the files. A document that the mix takes twice has two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tessera.llm.common import shared_path, split_by_bits, table, written
from tessera.llm.decontaminate import without_contaminated
from tessera.llm.language_id import held_out, keep_identified, learn_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.token_files import token_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn_languages(docs.where(~F.coalesce(held_out(3, 1), F.lit(False))).select("text", "lang"))
    return keep_identified(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one doc_id stay or go together; a null doc_id stays. Only rows that may be copies are shuffled."""
    found = ngram_jaccard_join(docs.select("doc_id", "text"), k=5, percent=80)
    copies = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__copy_id")).distinct(), "copies")
    may, others = split_by_bits(docs, "doc_id", copies)
    return others.unionByName(may.join(copies, may["doc_id"] == copies["__copy_id"], "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by two hashes of doc_id, source and text, and by a number among equal rows.

    Equal rows stand for each other: those with the most copies are the first of them. As one source's rows have ``low``
    copies or one more, a row for each distinct one says it all, and texts are shuffled once. Null doc_ids, sources and
    texts are values like others; columns with names of this function's own come out as they came in.
    """
    names, key = docs.columns, ["__mix_a", "__mix_b"]
    clash = {c: f"__held_{i}" for i, c in enumerate(names) if c.startswith("__mix_")}
    docs = docs.withColumnsRenamed(clash)
    row = [F.col(c).isNull() for c in ("doc_id", "source", "text")] + ["doc_id", "source", "text"]
    keyed = docs.withColumns({"__mix_a": F.xxhash64(*row), "__mix_b": F.xxhash64(F.lit(1), *row)})
    other = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "source", "text")]
    mixed = mix_sources(keyed.select("doc_id", "text", "source", *key), carry=tuple(key))
    mixed = mixed.groupBy(*key, "copies").count().groupBy(*key).agg(F.min("copies").alias("__mix_low"), F.max(F.struct("copies", F.col("count").alias("n"))).alias("__mix_top"))
    more = F.when(F.col("__mix_top.copies") > F.col("__mix_low"), F.col("__mix_top.n")).otherwise(0)
    mixed = mixed.select(*key, "__mix_low", more.alias("__mix_more")).where("__mix_low > 0 or __mix_more > 0")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*(other or key)))
    taken = keyed.withColumn("__mix_nth", nth).join(mixed, key)
    copies = (F.col("__mix_low") + (F.col("__mix_nth") <= F.col("__mix_more")).cast("long")).cast("int")
    taken = taken.withColumn("__mix_copies", copies).where("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return taken.select(*[F.col(clash.get(c, c)).alias(c) for c in names])


#: The last stage shares an executor with what the others left, so a worker keeps fewer pieces than in op2: time for memory.
PIECES, SLICE = 100_000, 1 << 17


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_table(docs, pieces=PIECES, slice_bytes=SLICE)


STAGES = [
    ("language ID", identify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokenize),
]

#: Expectation-maximisation, tiling, dependent rounding and a tokenizer can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
