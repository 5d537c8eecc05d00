"""Files: JSON lines, CSV with and without header, chunk folders, streams; and the reports that queries write."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = T.StructType([T.StructField(n, t) for n, t in (("user_id", T.StringType()), ("business_id", T.StringType()), ("stars", T.DoubleType()), ("date", T.StringType()), ("text", T.StringType()))])
BUSINESS = T.StructType([T.StructField(n, T.StringType()) for n in ("business_id", "categories", "state", "city")])
REQUEST = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "business_id")])


def read_json(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; strict raises on a malformed line, else such lines give nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header user_id,business_id."""
    return spark.read.schema(REQUEST).option("header", True).csv(path)


def read_points(spark: SparkSession, path: str, d: int) -> DataFrame:
    """Headerless CSV of an id and d numbers: point_id, x, chunk (the file's name, so that chunks have an order), place (the line's in its chunk, from 0)."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(d + 1)])
    rows = spark.read.schema(schema).csv(path).select("*", F.col("_metadata.file_name").alias("chunk"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(W.partitionBy("chunk").orderBy("block", "at")) - 1
    return rows.select(F.col("c0").cast("long").alias("point_id"), F.array(*(f"c{i}" for i in range(1, d + 1))).alias("x"), "chunk", place.alias("place"))


def chunks(points: DataFrame) -> Iterator[DataFrame]:
    """The chunks of `read_points` one after the other, by their files' names."""
    for r in points.select("chunk").distinct().orderBy("chunk").collect():
        yield points.filter(F.col("chunk") == r["chunk"])


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """Stop words, one on a line; as a list, which queries hold as a constant."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def write_model(folder: str, **tables: DataFrame) -> None:
    """Write a trained model's tables (profiles, similarities, ..) side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_model(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """The named tables of a written model."""
    return [spark.read.parquet(f"{folder}/{n}") for n in names]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_json(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream, a chunk of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_socket(spark: SparkSession, host: str, port: int, schema: T.StructType) -> DataFrame:
    """JSON lines from a TCP socket, as a stream of rows."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs (a, b, ..) as CSV with a header, in the order of both."""
    write_csv(pairs.orderBy("a", "b"), path)


def write_text(lines: DataFrame, path: str) -> None:
    """A one-column DataFrame of lines."""
    lines.write.mode("overwrite").text(path)


def write_object(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object, as text."""
    write_text(spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string"), path)


def itemset_sections(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """line: the candidates and then the frequent itemsets, a line for each size and an empty one after it."""
    parts = []
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        head = sets.sparkSession.createDataFrame([(k, 0, title)], "section int, at int, line string")
        body = itemset_report(sets).select(F.lit(k).alias("section"), F.col("size").alias("at"), F.concat("line", F.lit("\n")).alias("line"))
        parts.append(head.unionByName(body))
    return parts[0].unionByName(parts[1]).orderBy("section", "at").select("line")


def write_clusters(points: DataFrame, metrics: DataFrame, folder: str) -> None:
    """point_id and cluster as JSON lines in the order of ids, and the rounds' metrics as CSV with a header."""
    write_json(points.orderBy("point_id"), f"{folder}/points")
    write_csv(metrics.orderBy("round"), f"{folder}/metrics")


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """size, line: the itemsets (items array, size) of each size on a line, in lexicographic order."""
    one = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    return itemsets.select("size", F.struct("items", one.alias("s")).alias("x")).groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ",").alias("line"))


def community_report(communities: DataFrame) -> DataFrame:
    """size, line: each community (members array) on a line, members quoted, by size and then members."""
    members = F.transform(F.sort_array("members"), lambda m: F.concat(F.lit("'"), m.cast("string"), F.lit("'")))
    return communities.select(F.size("members").alias("size"), F.array_join(members, ", ").alias("line")).orderBy("size", "line")


def betweenness_report(edges: DataFrame) -> DataFrame:
    """line: ('u', 'v'), w for edges (u, v, w), heaviest first."""
    return edges.orderBy(F.desc("w"), "u", "v").select(F.format_string("('%s', '%s'), %s", F.col("u").cast("string"), F.col("v").cast("string"), F.col("w").cast("string")).alias("line"))


def flag_line(flags: DataFrame) -> DataFrame:
    """flags: 0 and 1 of (seq, flag) joined by blanks in order of seq."""
    return flags.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "flag"))), lambda x: x["flag"].cast("string")), " ").alias("flags"))
