import socket
import threading
import time
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.operators.clustering import BFR
from orefield.plans import catalogue
from orefield.sources import files
from orefield.streaming import queries as streams

from .oracle import SF, rows


def test_streams_equal_their_batch_twins(spark):
    q = catalogue.QUERIES
    assert rows(q["stream_fm"](spark, SF)) == rows(q["fm_sliding_window"](spark, SF))
    assert rows(q["stream_reservoir"](spark, SF)) == rows(q["reservoir_sample"](spark, SF))
    assert rows(q["stream_seen"](spark, SF)) == rows(spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct())


def test_sample_and_clusters_follow_a_stream_of_several_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 40, i * 40 + 40).select(F.col("id").alias("point_id"), F.array((F.col("id") % 2 * 100).cast("double"), (F.col("id") % 5).cast("double")).alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("point_id bigint, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = streams.cluster_stream(source, BFR(2, 2))
    assert len(model.metrics) == 3 and model.result().count() == 120


def test_a_named_stream_goes_on_where_it_stopped(spark, tmp_path):
    sf, folder = tmp_path / "sf", str(tmp_path / "state")
    events = spark.read.parquet(f"{SF}/events.parquet").repartition(3, "event_id").cache()
    (sf / "events.parquet").mkdir(parents=True)
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(sf / "events.parquet"))
        sample = streams.stream_reservoir(spark, str(sf), 50, folder)
        seen = events.filter(F.col("event_id") % 3 <= i)
        assert rows(sample) == rows(streams.bottom_k(seen, "event_id", 50).select("event_id"))
    assert rows(streams.stream_seen(spark, str(sf), within="60 days")) == rows(events.select("user_id").distinct())


def test_empty_windows_get_rows_and_batches_go_to_csv(spark, tmp_path):
    w = spark.createDataFrame([(datetime(2024, 1, 1), 4.0), (datetime(2024, 1, 4), 2.0)], "start timestamp_ntz, n_estimate double")
    assert [r.n_estimate for r in streams.with_empty_windows(w).orderBy("start").collect()] == [4.0, 0.0, 0.0, 2.0]
    assert streams.with_empty_windows(w.filter("false")).isEmpty()
    folder = streams.drained(streams.event_stream(spark, SF).select("event_id"), "append", streams.append_csv, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(f"{folder}/csv").select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_lines_come_from_a_socket(spark):
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve() -> None:
        link, _ = server.accept()
        link.sendall(b'{"city": "Ulm"}\n{"city": ""}\n')
        time.sleep(20)
        link.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = files.stream_socket(spark, "127.0.0.1", port, T.StructType([T.StructField("city", T.StringType())]))
    query = stream.writeStream.format("memory").queryName("cities").trigger(processingTime="1 seconds").start()
    for _ in range(60):
        if (found := sorted(r.city for r in spark.table("cities").collect())) == ["", "Ulm"]:
            break
        time.sleep(0.5)
    query.stop()
    server.close()
    assert found == ["", "Ulm"]
