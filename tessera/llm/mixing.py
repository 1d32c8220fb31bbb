"""Mixing sources to target sizes with pivotal dependent rounding; DataFrame functions only.

Every document gets a fractional number of copies, its source's target over its source's size. The fractions are made
whole by pairs: of two documents, words move from one to the other until the chance of one is 0 or 1; which way is drawn
so that every document's expected copies stay as they were, and the words that the two are expected to give stay exactly
as they were. Documents go through this in blocks of bounded size; the one unfinished document of each block goes up a
reduction tree of such blocks, and the last one of a source takes the nearer whole number. So a source's words differ
from its target by half a document at most. Blocks go from long to short documents, so what is left is mostly short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, table, written

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, n_docs, source_size, rank, target)`` by source of ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights in turn. Targets share ``share`` times all sizes by weight;
    none exceeds ``most`` times its source's size, and what is over is shared again by weight.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranged = written(by_source.repartitionByRange(partitions(spark), order).withColumn("pid", F.spark_partition_id()), "sources")
    before = ranged.groupBy("pid").count().select("pid", (F.sum("count").over(Window.orderBy("pid")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranged.join(before, "pid").withColumn("rank", rank.cast("long")).withColumn("weight", weight).drop("pid", "before"), "ranked")
    limit = F.col("source_size") * F.lit(float(most))
    start = ranked.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    budget, level = share * float(start["all"] or 0), 0.0
    if start["n"]:
        level = budget / start["w"]
        while True:
            over = F.col("weight") * F.lit(level) > limit
            r = ranked.agg(F.sum(F.when(over, limit)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
            if not r["w"]:
                break
            new = (budget - (r["capped"] or 0.0)) / r["w"]
            if new <= level:
                break
            level = new
    return ranked.select("source", "n_docs", "source_size", "rank", F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def _settle(rows: Column, seed: int, row: str) -> Column:
    """Pair the rows (of type ``row``) of one block in turn; ``done`` has those that became whole, ``left`` the one that did not."""

    def step(state, d):
        c = state["left"]
        up = F.least((1 - c["p"]) * c["size"], d["p"] * d["size"])
        down = F.least(c["p"] * c["size"], (1 - d["p"]) * d["size"])
        draw = F.pmod(F.xxhash64(F.lit(seed), c["h"], c["id"], d["h"], d["id"], c["size"], d["size"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        rise = draw * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        near = lambda x: F.when(x < 1e-9, 0.0).when(x > 1 - 1e-9, 1.0).otherwise(x)
        cp, dp = near(c["p"] + moved / c["size"]), near(d["p"] - moved / d["size"])
        c2, d2 = c.withField("p", cp), d.withField("p", dp)
        whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
        both = F.struct(c2.alias("c"), d2.alias("d"))
        # one struct of the pair first, so that it is computed once
        after = F.transform(F.array(both), lambda b: F.struct(
            F.when(~whole(b["c"]), b["c"]).when(~whole(b["d"]), b["d"]).alias("left"),
            F.filter(F.array(b["c"], b["d"]), whole).alias("new"),
        ))[0]
        moved_on = F.struct(after["left"].alias("left"), F.concat(state["done"], after["new"]).alias("done"))
        return F.when(c.isNull(), F.struct(d.alias("left"), state["done"].alias("done"))).otherwise(moved_on)

    start = F.struct(F.lit(None).cast(row).alias("left"), F.array().cast(f"array<{row}>").alias("done"))
    return F.aggregate(rows, start, step)


def pivotal_copies(docs: DataFrame, seed: int = 7, fan_in: int = 64, carry: tuple = ()) -> DataFrame:
    """``(id, size, rank, copies)`` for rows (id, size > 0, rank, n_docs, copies: fractional number), whole copies.

    Blocks hold about ``fan_in`` rows; rows of one rank are paired with each other only. Columns ``carry`` come along.
    """
    p = F.col("copies") - F.floor("copies")
    p = F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)
    # rows of one id and size are numbered, equal ones after they are counted, so that they too are spread over the blocks
    same = Window.partitionBy("rank", "id", "size")
    docs = docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("__rows"))
    upto = F.sum("__rows").over(same.orderBy(*(carry or ("id",))).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    docs = docs.withColumn("__upto", upto).withColumn("__row", F.explode(F.sequence(F.col("__upto") - F.col("__rows") + 1, F.col("__upto"))))
    rows = docs.select("rank", F.greatest(F.ceil(F.col("n_docs") / fan_in), F.lit(1)).cast("long").alias("blocks"), F.struct((-F.col("size")).alias("k"), F.xxhash64(F.lit(seed), "id", "size", "__row").alias("h"), "id", "size", F.floor("copies").cast("long").alias("base"), p.alias("p"), *carry).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    whole = rows.where("row.p in (0.0, 1.0)").select("rank", "row")
    todo, done = rows.where("row.p not in (0.0, 1.0)"), [whole]
    while True:
        block = F.pmod(F.shiftright(F.col("row.h"), 3), F.col("blocks"))
        settled = todo.withColumn("block", block).groupBy("rank", "blocks", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        settled = written(settled.select("rank", "blocks", _settle(F.col("rows"), seed, kind).alias("s")), "settled")
        done.append(settled.select("rank", F.explode("s.done").alias("row")))
        left = settled.where("s.left is not null").select("rank", "blocks", F.col("s.left").alias("row"))
        done.append(left.where("blocks = 1").select("rank", F.col("row").withField("p", F.when(F.col("row.p") >= 0.5, 1.0).otherwise(0.0)).alias("row")))
        todo = left.where("blocks > 1").select("rank", F.ceil(F.col("blocks") / fan_in).cast("long").alias("blocks"), "row")
        if todo.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("row.id").alias("id"), F.col("row.size").alias("size"), "rank", (F.col("row.base") + F.col("row.p").cast("long")).alias("copies"), *[F.col(f"row.{c}") for c in carry])


def mix_sources(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, small_sources: int = 10_000, carry: tuple = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for every row of ``docs`` (doc_id, text, source).

    A text's size is its number of words; null, empty and blank texts have size 0 and are not taken (0 copies). A null
    source is a source, after all others. Rows of one doc_id are mixed as rows of their own. Reruns agree. An empty
    table gives an empty result; extra columns are ignored but for those in ``carry``, which come along.
    """
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *carry), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    if targets.count() <= small_sources:
        targets = F.broadcast(targets)
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("copies", copies)
    mixed = pivotal_copies(rows.where("size > 0").select(F.col("doc_id").alias("id"), "size", "rank", "n_docs", "copies", *carry), seed, carry=carry)
    by_rank = targets.select("rank", "source_size", "target")
    out = mixed.join(by_rank, "rank").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *carry)
    return out.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), *carry))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 at 150 % of their words."""
    return mix_sources(table(spark, sf_dir, "documents"))
