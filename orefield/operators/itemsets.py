"""Frequent itemsets: exact level-wise counting with the a-priori test, and FP-growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable, written


def baskets(pairs: DataFrame, key: str, item: str, min_size: int = 0) -> DataFrame:
    """basket, items (sorted, distinct) with more than min_size items."""
    return pairs.groupBy(F.col(key).alias("basket")).agg(F.sort_array(F.collect_set(item)).alias("items")).filter(F.size("items") > min_size)


def frequent(sets: DataFrame, support: int, size: int) -> DataFrame:
    """items, freq of all itemsets of up to `size` items in at least `support` baskets.

    Level k extends each basket's frequent (k-1)-sets by a later item of the basket that is frequent itself,
    so a basket gives only sets that can be frequent; counting combines before the shuffle.
    """
    items = sets.select("basket", F.explode("items").alias("item"))
    ones = durable(items.groupBy("item").agg(F.count("*").alias("freq")).filter(F.col("freq") >= support))
    items = items.join(ones.select("item"), "item", "left_semi")
    level, have = ones.select(F.array("item").alias("items"), "freq"), items.select("basket", F.array("item").alias("items"))
    out = level
    for _ in range(2, size + 1):
        bigger = have.join(items, "basket").filter(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
        level = durable(bigger.groupBy("items").agg(F.count("*").alias("freq")).filter(F.col("freq") >= support))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        have = bigger.join(level.select("items"), "items", "left_semi")
    return out.withColumn("size", F.size("items"))


def candidates(sets: DataFrame, support: int, size: int, chunks: int) -> DataFrame:
    """items: itemsets that are frequent in some chunk of the baskets, at its share of the support; every frequent itemset is one.

    Baskets are dealt into chunks by a hash, and all chunks are counted at once, level by level.
    """
    dealt = durable(sets.select("basket", "items", F.pmod(F.xxhash64("basket"), F.lit(chunks)).alias("chunk")))
    total = F.sum("n").over(W.partitionBy())  # a row for each chunk
    needed = durable(dealt.groupBy("chunk").agg(F.count("*").alias("n")).select("chunk", (support * F.col("n") / total).alias("needed")))
    local = lambda rows: durable(rows.groupBy("chunk", "items").agg(F.count("*").alias("freq")).join(needed, "chunk").filter("freq >= needed").select("chunk", "items"))
    items = dealt.select("chunk", "basket", F.explode("items").alias("item"))
    level = local(items.select("chunk", F.array("item").alias("items")))
    items = items.join(level.select("chunk", F.col("items")[0].alias("item")), ["chunk", "item"], "left_semi")
    out, have = level, items.select("chunk", "basket", F.array("item").alias("items"))
    for _ in range(2, size + 1):
        bigger = have.join(items, ["chunk", "basket"]).filter(F.col("item") > F.element_at("items", -1)).select("chunk", "basket", F.concat("items", F.array("item")).alias("items"))
        level = local(bigger)
        if level.isEmpty():
            break
        out, have = out.unionByName(level), bigger.join(level, ["chunk", "items"], "left_semi")
    return out.select("items").distinct().withColumn("size", F.size("items"))


def fpgrowth(sets: DataFrame, support: int, size: int | None = None) -> DataFrame:
    """The same by FP-growth. The threshold is a fraction; half a basket less than support/N rounds to the support exactly."""
    from pyspark.ml.fpm import FPGrowth

    sets = written(sets)  # fit reads them three times
    n = sets.count()
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / max(n, 1))).fit(sets)
    found = model.freqItemsets.select(F.sort_array("items").alias("items"), "freq").withColumn("size", F.size("items"))
    return found if size is None else found.filter(F.col("size") <= size)
