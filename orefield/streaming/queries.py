"""Streams: sliding distinct counts, a mergeable sample, first sightings, chunk-at-a-time clustering."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import BFR
from ..operators.sketches import bottom_k, fm_aggregates, fm_estimate
from ..session import shared_folder

WINDOW, SLIDE, LATE = "3 days", "1 day", "1 day"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: event_id, ts, user_id, event_type, tags."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path)
    k = F.get_json_object("props", "$.k")
    # A file source reads folders; a table that is one file is found in the folder above it.
    source = spark.readStream.schema(rows.schema)
    alone = all(f.endswith("/events.parquet") for f in rows.inputFiles())
    stream = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else source.parquet(path)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.array("event_type", F.concat(F.lit("k"), k)).alias("tags"))


def sliding_distinct(events: DataFrame, late: str = LATE, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """start, r0..r8 for each window of event time: the state is nine small numbers a window, whatever the traffic."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window, slide).alias("w")).agg(*fm_aggregates(F.col("user_id"))).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.round(fm_estimate(), 6).alias("n_estimate"))


def exact_sliding(events: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """start, n: exact distinct users of each window (batch only: streams can't count distinct values exactly)."""
    return events.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count_distinct("user_id").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def with_empty_windows(windows: DataFrame, slide: str = SLIDE, fill: dict | None = None) -> DataFrame:
    """The windows (start, ..) and, between the first and the last, a row for each that had no events, its other columns as in `fill` (n_estimate 0)."""
    ends = windows.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    every = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {slide}"))).alias("start"))
    return every.join(windows, "start", "left").fillna(fill if fill is not None else {"n_estimate": 0.0})


def stamped(windows: DataFrame, window: str = WINDOW) -> DataFrame:
    """windows with `time`: when each window ends, as text."""
    return windows.withColumn("time", F.date_format(F.col("start") + F.expr(f"interval {window}"), "yyyy-MM-dd HH:mm:ss"))


def drained(stream: DataFrame, mode: str, keep: Callable[[DataFrame, int, str], None], folder: str | None = None, every: str | None = None) -> str:
    """Run a stream over what is available, or for ever with a batch `every` so often ('5 seconds'); keep(batch, number, folder) stores each micro-batch.

    Gives the folder, which holds query progress and results. A query that is started again with the same `folder` goes on
    where it stopped; a batch that is replayed writes the same sub-folder again.
    """
    folder = folder or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    when = {"processingTime": every} if every else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(**when).foreachBatch(lambda df, n: keep(df, n, folder)).start()
    query.awaitTermination()
    return folder


def _store(df: DataFrame, n: int, folder: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all stored batches, with `batch`; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/out")
    except AnalysisException:
        return None


def _last(rows: DataFrame, before: int | None = None) -> DataFrame | None:
    """The rows of the last batch (before a given one); None if there is none."""
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    n = rows.agg(F.max("batch")).first()[0]
    return None if n is None else rows.filter(F.col("batch") == n).drop("batch")


def append_csv(df: DataFrame, n: int, folder: str) -> None:
    """Store a micro-batch as CSV with a header, in a folder of its own below `csv`, so that one that is replayed replaces itself."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv/batch={n}")


def stream_fm(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The windows' distinct counts after the stream has been read: equal to the batch query's.

    Each batch stores the windows that it has changed; state leaves with the watermark. The last row of a window counts.
    """
    folder = drained(sliding_distinct(event_stream(spark, sf_dir)), "update", _store, folder)
    return _stored(spark, folder).groupBy("start").agg(F.max_by("n_estimate", "batch").alias("n_estimate"))


def stream_reservoir(spark: SparkSession, sf_dir: str, k: int = 100, folder: str | None = None) -> DataFrame:
    """A uniform sample of k events, kept up batch by batch: the smallest hashes of the sample so far and the batch."""

    def keep(df: DataFrame, n: int, folder: str) -> None:
        rows, have = df.select("event_id", "tags"), _stored(df.sparkSession, folder)
        before = _last(have, n) if have is not None else None
        _store(bottom_k(rows if before is None else rows.unionByName(before), "event_id", k), n, folder)

    return _last(_stored(spark, drained(event_stream(spark, sf_dir), "append", keep, folder))).select("event_id")


def stream_seen(spark: SparkSession, sf_dir: str, folder: str | None = None, within: str | None = None) -> DataFrame:
    """user_id of each user's first sighting: the state store drops later ones.

    First sightings of all time need a state that grows with the users, on the executors' disks; with `within` ('1 day')
    a user counts again after so much event time, and the state leaves with the watermark.
    """
    events = event_stream(spark, sf_dir)
    first = events.select("user_id").dropDuplicates(["user_id"]) if within is None else events.select("user_id", "ts").withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id"]).select("user_id")
    return _stored(spark, drained(first, "append", _store, folder)).select("user_id")


def cluster_stream(points: DataFrame, model: BFR) -> BFR:
    """Update a BFR model with each micro-batch (a chunk) of a stream of (point_id, x); a batch that is replayed counts once."""
    seen: set[int] = set()

    def keep(df: DataFrame, n: int, folder: str) -> None:
        if n not in seen:
            model.update(df)
            seen.add(n)

    drained(points, "append", keep)
    return model
