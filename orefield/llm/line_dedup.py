"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, durable, packed, whole


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed(line: Column, place: Column, min_points: int) -> Column:
    """128 bits of the key (at 10^12 lines two of 64 bits would meet) and the line's place; a is null for keys under min_points."""
    key = line_key(line)
    return F.struct(F.when(F.length(key) >= min_points, F.xxhash64(key)).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"), place.alias("place"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """The rows of docs with `kept_text` and the counts `n_lines` (before dropping) and `n_dropped`.

    A line goes, in every document, if its key has at least `min_points` code points and is found in at
    least `min_docs` documents; each row of docs is a document, and a line repeated within a row counts
    once. Null and empty texts are one empty line, which stays (its key has no code point). Repeated rows
    each return their own result. Further columns are returned as they are, except those named kept_text,
    n_lines, n_dropped, which are replaced.

    The hashes of all lines are written once, sorted within each document, so that repeats stand side by side
    and very long documents cost no more for each line than short ones. Counting takes one row per document and
    distinct line and combines before the shuffle; the dropped hashes, written by themselves, then find their lines by an equi-join
    whose hot keys (a line in a third of all documents) are only rows of a few numbers and can be split;
    the texts themselves are shuffled once, by row key, with the places to drop.
    """
    # Rows that agree in doc_id and text share their fate, so this pair is the key of a row.
    text = whole()
    row = [F.col("doc_id").alias("k_id"), F.xxhash64(text).alias("k_text"), F.octet_length(text).alias("k_size")]
    key = ["k_id", "k_text", "k_size"]
    hashes = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: _hashed(x, i, min_points)), lambda x: x["a"].isNotNull())
    lines = durable(docs.select(*row, F.sort_array(hashes).alias("hashes")))
    before = lambda i, c: F.get(F.col("hashes"), i - 1)[c]
    once = lines.select(F.inline(F.filter("hashes", lambda x, i: (i == 0) | (before(i, "a") != x["a"]) | (before(i, "b") != x["b"]))))
    # Written, so that the join with it can split a line that very many documents share.
    common = durable(once.groupBy("a", "b").count().filter(F.col("count") >= min_docs).select("a", "b"))
    places = (
        lines.select(*key, F.inline("hashes"))
        .join(common, ["a", "b"])
        .groupBy(*key)
        .agg(F.collect_set("place").alias("places"))
        .select(F.col("k_id").alias("p_id"), F.col("k_text").alias("p_text"), F.col("k_size").alias("p_size"), "places")
    )
    full = docs.select(packed(docs, "kept_text", "n_lines", "n_dropped").alias("doc"), *row)
    met = full.join(places, full.k_id.eqNullSafe(places.p_id) & (full.k_text == places.p_text) & (full.k_size == places.p_size), "left")
    # A projection of its own: a text is split once, not once for each line that is read from it.
    split = met.select("doc", "places", F.split(whole("doc.text"), "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), whole("doc.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return split.select("doc.*", kept.alias("kept_text"), F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"))
