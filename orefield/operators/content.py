"""Content-based recommendation: TF-IDF profiles of businesses, profiles of users, containment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, is_stopword, letter_tokens
from ..session import durable
from .keyed import positions


def word_counts(texts: DataFrame, rare: float = 0.0001, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """business_id, word, n without stop words and without words under `rare` of all tokens. One count serves both levels."""
    words = texts.select("business_id", F.explode(letter_tokens(F.col("text"))).alias("word")).filter(~is_stopword(F.col("word"), words=stopwords))
    counts = durable(words.groupBy("business_id", "word").agg(F.count("*").alias("n")))  # else the texts are split again for each use
    total = counts.agg(F.sum("n").alias("t"))
    common = counts.groupBy("word").agg(F.sum("n").alias("c")).join(F.broadcast(total), F.col("c") >= rare * F.col("t")).select("word")  # total: one row
    return counts.join(common, "word")


def tfidf(texts: DataFrame, rare: float = 0.0001, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """business_id, word, w: count over the business's largest count, times log2(businesses / businesses with the word)."""
    counts = durable(word_counts(texts, rare, stopwords))
    most = counts.groupBy("business_id").agg(F.max("n").alias("most"))
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    n = texts.agg(F.count_distinct("business_id").alias("docs"))
    w = F.col("n").cast("double") / F.col("most") * F.log2(F.col("docs").cast("double") / F.col("df"))
    return counts.join(most, "business_id").join(df, "word").join(F.broadcast(n), F.lit(True)).select("business_id", "word", F.round(w, 9).alias("w"))  # n: one row


def top_words(scored: DataFrame, n: int = 200) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("business_id").orderBy(F.desc("w"), "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def vocabulary(scored: DataFrame, n: int = 200) -> DataFrame:
    """word, position: the words among the top n of any business, numbered in their order from 0."""
    return positions(top_words(scored, n), "word")


def business_profiles(texts: DataFrame, n: int = 200) -> DataFrame:
    """business_id, words: its words among the top n words of any business."""
    scored = durable(tfidf(texts))
    vocabulary = top_words(scored, n).select("word").distinct()
    return scored.join(vocabulary, "word").groupBy("business_id").agg(F.sort_array(F.collect_set("word")).alias("words"))


def user_profiles(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """user_id, words: the union of the profiles of the businesses that the user has reviewed."""
    seen = texts.select("user_id", "business_id").distinct()
    words = seen.join(profiles, "business_id").select("user_id", F.explode("words").alias("word")).distinct()
    return words.groupBy("user_id").agg(F.sort_array(F.collect_list("word")).alias("words"))


def content_scores(requests: DataFrame, users: DataFrame, businesses: DataFrame, at_least: float = 0.01, measure: str = "containment") -> DataFrame:
    """user_id, business_id, sim over at_least: common words over the user's words (containment), or over both sizes' geometric mean (cosine)."""
    u, b = users.select("user_id", F.col("words").alias("u")), businesses.select("business_id", F.col("words").alias("b"))
    met = requests.join(u, "user_id").join(b, "business_id")
    common, low = F.size(F.array_intersect("u", "b")).cast("double"), F.size("u").cast("double")
    if measure == "cosine":
        low = F.sqrt(low * F.size("b"))
    return met.select("user_id", "business_id", F.round(common / low, 6).alias("sim")).filter(F.col("sim") > at_least)
