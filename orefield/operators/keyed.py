"""Tables by key: positions of sorted keys, keyed upserts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable


def positions(df: DataFrame, key: str) -> DataFrame:
    """key, position: the place of each distinct value in their order, from 0, without bringing them together.

    Values are sorted by ranges and numbered within them; of each range only its size reaches the driver. Null comes first.
    """
    rows = durable(df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    starts = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    before = F.array(*(F.lit(x).cast("bigint") for x in starts))
    return rows.select(key, (F.get(before, part.cast("int")) + place).alias("position"))


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """base with the rows of updates in place of those of equal key and after them those of new keys; of several updates of a key the last by `order`.

    Both have the columns of base; updates have `order` besides.
    """
    last = updates.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").select(*base.columns)
    return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(last)
