"""Canonical inputs: the driver's tables and the views on them that stand for reviews, ratings, baskets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id, seller_id, stars, review_ts: a row for each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        F.col("l_suppkey").alias("seller_id"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("stars"),
        F.col("l_shipdate").alias("review_ts"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating for each user and business: the highest."""
    return reviews(spark, sf_dir).groupBy("user_id", "business_id").agg(F.max("stars").alias("stars"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, categories: a comma-separated list with stray blanks, or null."""
    c = F.when(F.col("p_size") % 10 != 0, F.concat("p_brand", F.lit(", "), "p_type", F.lit(","), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), c.alias("categories"))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seller_id, city, state."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))


def baskets_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket_id, item: the distinct brands of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item")).distinct()


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("business_id"), (F.col("doc_id") % 50).alias("user_id"), "text")


DIMENSIONS = 64


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x (all components as double), chunk."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), (F.col("vec_id") % 4).alias("chunk"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (timestamp, as watermarks need it), user_id, event_type, tags."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.array("event_type", F.concat(F.lit("k"), k)).alias("tags"))


#: The same views in SQL, for the oracles.
CTES = {
    "reviews": "select o.o_custkey as user_id, l.l_partkey as business_id, l.l_suppkey as seller_id, cast(1 + (cast(l.l_quantity as int) % 5) as double) as stars, l.l_shipdate as review_ts from lineitem l join orders o on l.l_orderkey = o.o_orderkey",
    "ratings": "select user_id, business_id, max(stars) as stars from reviews group by user_id, business_id",
    "businesses": "select p_partkey as business_id, case when p_size % 10 = 0 then null else concat(p_brand, ', ', p_type, ',', p_name) end as categories from part",
    "sellers": "select s_suppkey as seller_id, n_name as city, r_name as state from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "baskets_long": "select distinct l_orderkey as basket_id, p_brand as item from lineitem join part on l_partkey = p_partkey",
    "text_reviews": "select doc_id, source as business_id, doc_id % 50 as user_id, text from documents",
    "points": "select vec_id, list_transform(embedding, lambda v: cast(v as double)) as x, vec_id % 4 as chunk from embeddings",
}
_NEEDS = {"ratings": ["reviews"]}


def ctes(*names: str) -> str:
    """The named views as the head of a WITH clause."""
    every = dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])
    return ",\n".join(f"{n} as ({CTES[n]})" for n in every)
