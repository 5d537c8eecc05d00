"""Counts, top lists and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, is_stopword, raw_tokens, stripped
from ..session import durable


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def rows_with_date(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose date, as text, contains a part."""
    return df.filter(F.date_format(column, "yyyy-MM-dd").contains(part)).agg(F.count("*").alias("n"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct values; null is one of them. An empty table has 0."""
    return df.agg((F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias("n"))


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values: by falling count, then value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def top_words(texts: DataFrame, n: int, stopword_mode: str = "substring", stopwords: list[str] = STOPWORDS) -> DataFrame:
    words = texts.select(F.explode(raw_tokens(F.col("text"))).alias("word")).filter("word != ''")
    return top_keys(words.filter(~is_stopword(F.col("word"), stopword_mode, stopwords)), "word", n)


def average_stars(reviews: DataFrame, businesses: DataFrame, n: int) -> DataFrame:
    """Categories of the highest mean stars; reviews are pre-aggregated by business, so the join meets sums only."""
    by_business = reviews.groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("c"))
    category = businesses.filter("categories is not null").select("business_id", F.explode(F.split("categories", ",")).alias("category")).withColumn("category", stripped(F.col("category")))
    mean = (F.sum("s") / F.sum("c")).alias("avg_stars")
    return category.join(by_business, "business_id").groupBy("category").agg(mean).withColumn("avg_stars", F.round("avg_stars", 6)).orderBy(F.desc("avg_stars"), "category").limit(n)


def busy_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Values with more than n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > n)


def partition_counts(df: DataFrame) -> DataFrame:
    """partition, n_items: the rows that lie in each of df's partitions, as they are; empty ones count 0."""
    df = durable(df)
    placed = df.select(F.spark_partition_id().alias("partition")).groupBy("partition").agg(F.count("*").alias("c"))
    every = df.sparkSession.range(df.rdd.getNumPartitions()).select(F.col("id").cast("int").alias("partition"))
    return every.join(placed, "partition", "left").select("partition", F.coalesce("c", F.lit(0)).alias("n_items"))


def partition_stats(df: DataFrame, key: str, n: int) -> DataFrame:
    """partition, n_items for df dealt by key into n partitions: `partition_counts` has a row for each of them, so it also tells their number."""
    return partition_counts(df.select(key).repartition(n, key))


def n_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def explore(reviews: DataFrame, part: str, m: int, n: int, stopword_mode: str = "substring", stopwords: list[str] = STOPWORDS) -> dict:
    """The five answers of one exploration in one object: rows, rows in a year, users, top users, top words."""
    kept = durable(reviews.select("user_id", "date", "text"))
    one = lambda df: df.first()["n"]
    return {
        "A": one(row_count(kept)),
        "B": one(kept.filter(F.col("date").contains(part)).agg(F.count("*").alias("n"))),
        "C": one(distinct_keys(kept, "user_id")),
        "D": [[r["user_id"], r["n"]] for r in top_keys(kept, "user_id", m).collect()],
        "E": [r["word"] for r in top_words(kept, n, stopword_mode, stopwords).collect()],
    }


def busy_report(reviews: DataFrame, n: int, partitions: int | None = None) -> dict:
    """Businesses with more than n reviews, the number of partitions that reviews lie in and the rows of each; with `partitions`, dealt by business into so many."""
    rows = reviews.select("business_id")
    counts = partition_stats(rows, "business_id", partitions) if partitions else partition_counts(rows)
    sizes = [r["n_items"] for r in counts.orderBy("partition").collect()]
    return {"n_partitions": len(sizes), "n_items": sizes, "result": [[r["business_id"], r["n"]] for r in busy_keys(rows, "business_id", n).orderBy("business_id").collect()]}
