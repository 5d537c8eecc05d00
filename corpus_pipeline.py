"""A training corpus from raw documents: toxicity, line dedup, near dedup, mixing to target weights, packing.

Each stage takes all documents that the stage before it has left, as Parquet, and its decisions take effect:
toxic documents go, lines that many documents share go, one document of each group of near duplicates stays,
the rest is written in the order of the mix, and packed in that order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.common import durable, freed, shared_folder, table
from orefield.llm.line_dedup import line_dedup
from orefield.llm.mixing import mix
from orefield.llm.near_dedup import near_classes
from orefield.llm.packing import pack, tokenised_pieces
from orefield.llm.queries import word_tokenizer
from orefield.llm.toxicity import toxicity

#: Documents at this score or over go: higher than where the operator predicts, as a clean document lost is lost for good.
REJECT = 0.5


def numbered(docs: DataFrame, *used: str) -> DataFrame:
    """docs with its columns but those used renamed to numbers, so that none meets a column that an operator adds."""
    return docs.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(docs.columns)))


def row_places(docs: DataFrame) -> DataFrame:
    """docs with `at`, the file and place of each row: its key, the same whenever it is read. Rows from elsewhere are written first."""
    try:
        return docs.withColumn("at", F.struct("_metadata.file_name", "_metadata.row_index"))
    except AnalysisException:  # not read from files
        return durable(docs.withColumn("at", F.struct(F.lit("").alias("file_name"), F.monotonically_increasing_id().alias("row_index"))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under REJECT. Null and empty texts stay.

    Equal texts share their fate; an empty table stays empty. Columns of any name are returned as they are.
    """
    plain = numbered(docs, "doc_id", "text")
    return toxicity(plain, table(spark, sf_dir, "labels"), threshold=REJECT).filter("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more share; n_chars follows the text. A document may become empty.

    Repeated rows are documents of their own and count as often as they stand there. Null texts stay null; an empty
    table stays empty. Columns of any other name are returned as they are.
    """
    plain = numbered(docs, "doc_id", "text", "n_chars")
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    out = {"text": text, "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else text}
    return line_dedup(plain).select(*(out[c].alias(c) if c in out else c for c in plain.columns)).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that of the smallest doc_id; of rows that share it, or have none, the first.

    Rows without words have no duplicates and stay. Rows that share a doc_id are judged each by its own text. An empty
    table stays empty. Columns of any name are returned as they are.
    """
    plain = row_places(numbered(docs, "doc_id", "text"))
    found = near_classes(plain.select("doc_id", "text", "at"), key=F.col("at"))
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = found.filter("class_id is not null").groupBy("class_id").agg(F.min(place).alias("x")).select("x.key")
    kept = durable(first.unionByName(found.filter("class_id is null").select("key")))
    freed(spark)
    return plain.join(kept, F.col("at") == F.col("key"), "left_semi").drop("at").toDF(*docs.columns)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: sources weighed by the square root of their sizes.

    A null source is a source; repeated rows and ties stand in any order. An empty table stays empty. Columns of any
    name are returned as they are.
    """
    plain = numbered(docs, "doc_id", "source")
    return mix(plain).repartitionByRange("mix_place").sortWithinPartitions("mix_place").select(*plain.columns).toDF(*docs.columns)


def packed_in_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096 over all documents, packed by stretches of PART documents in the order in which they were written.

    Null texts count as empty; repeated rows are packed each; an empty table gives no rows. Of docs only doc_id and text matter.
    """
    rows = row_places(docs.select("doc_id", "text"))
    # A number for each file, not for each row, reaches the driver.
    files = rows.groupBy("at.file_name").count().orderBy("file_name").collect()
    before = [0, *accumulate(r["count"] for r in files)]
    starts = spark.createDataFrame([(r["file_name"], x) for r, x in zip(files, before, strict=False)], "file_name string, before bigint")
    pieces = tokenised_pieces(rows, word_tokenizer(), carry=("at",)).join(starts, F.col("at.file_name") == F.col("file_name"))
    placed = durable(pieces.withColumn("place", F.col("before") + F.col("at.row_index")).drop("at", "file_name", "before"))  # else tokenised once more for their number
    return pack(placed, window="place").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", in_mixed_order),
    ("packing", packed_in_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: A classifier, near-duplicate search, tokens and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
