"""Streams run over the whole input until it is used up; the result is what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.parse import accumulate_offsets
from parlance.plans.text_queries import TRANSCRIPT, chunks_of
from parlance.plans.views import with_views
from parlance.sources.shared import work_path
from parlance.streaming import jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _left_behind(stream: DataFrame, mode: str) -> DataFrame:
    """Every batch's output with its number; in complete mode only the last counts, and it replaces the others."""
    spark = stream.sparkSession
    out = work_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/part={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", work_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = work_path(spark, "chunks"), work_path(spark, "segments")
    accumulate_offsets(chunks_of(spark, sf_dir), 60.0).select("recording_id", "chunk", "text", "length", "offset").write.json(source)
    jobs.stream_segments(spark, source, sink, work_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(f"{sink}/segments").drop("batch")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("recording_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("speaker_id"), (F.col("event_id") % 2 == 0).alias("reviewed"))
    return _left_behind(jobs.stream_progress(rows), "complete").drop("batch")


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("at"))
    done = _left_behind(jobs.stream_activity(e), "complete")
    return done.select("recording_id", F.unix_timestamp("from").alias("from_s"), F.unix_timestamp("to").alias("to_s"), "n")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("recording_id"), (F.col("event_id") % 20).alias("target"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("batch_id"), F.col("event_type").alias("kind"), F.col("value").cast("string").alias("after"))
    updates = _left_behind(jobs.stream_edits(rows, "3650 days"), "update")
    last = updates.groupBy("recording_id", "target").agg(F.max(F.struct("batch", "at", "batch_id", "kind")).alias("x"))
    return last.select("recording_id", "target", "x.batch_id", "x.kind")


def _retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk fails at first and is sent again, with half of those that did not fail."""
    source, sink, state = work_path(spark, "chunks"), work_path(spark, "segments"), work_path(spark, "stream-state")
    chunks = accumulate_offsets(chunks_of(spark, sf_dir), 60.0).select("recording_id", "chunk", "text", "length", "offset")
    bad = (F.col("recording_id") + F.col("chunk")) % 3 == 0
    chunks.withColumn("failed", bad).withColumn("text", F.when(~bad, F.col("text"))).write.json(source)
    jobs.stream_segments(spark, source, sink, state).awaitTermination()
    chunks.filter(bad | (F.col("chunk") % 2 == 0)).write.mode("append").json(source)
    jobs.stream_segments(spark, source, sink, state).awaitTermination()
    return spark.read.parquet(f"{sink}/segments").drop("batch")


def _edited(spark: SparkSession, sf_dir: str) -> str:
    """Two thirds of the edits arrive, then the rest of them: what is behind by over a week or older than what is there goes aside."""
    source, sink, state = work_path(spark, "edits"), work_path(spark, "edited"), work_path(spark, "stream-state")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("recording_id"), (F.col("event_id") % 20).alias("target"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("batch_id"), F.col("event_type").alias("kind"), F.col("value").cast("string").alias("after"))
    for part in ("batch_id % 3 > 0", "batch_id % 3 = 0"):
        rows.filter(part).write.mode("append").parquet(source)
        jobs.apply_edits(spark.readStream.schema(rows.schema).parquet(source), sink, state, "7 days").awaitTermination()
    return sink


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_edited(spark, sf_dir)}/late").select("recording_id", "target", "batch_id", "reason")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_latest(spark, _edited(spark, sf_dir)).select("recording_id", "target", "batch_id", "kind")


QUERIES = {"x1_retried_chunks": _retried, "x3_late": _late, "x3_latest": _latest, "x1_stream_segments": _segments, "x2_stream_progress": _progress, "x3_stream_edits": _edits, "x4_stream_activity": _activity}

_EDITS = """e AS (SELECT user_id AS recording_id, event_id % 20 AS target, ts, event_id AS batch_id, event_type AS kind, event_id % 3 = 0 AS second FROM events)
  , judged AS (SELECT *, second AND ts < (SELECT max(ts) FROM e WHERE NOT second) - INTERVAL 7 DAYS AS behind FROM e)
  , placed AS (SELECT *, row_number() OVER (PARTITION BY recording_id, target, second, behind ORDER BY ts DESC, batch_id DESC) AS k,
      max(CASE WHEN NOT second THEN {'at': ts, 'id': batch_id} END) OVER (PARTITION BY recording_id, target) AS first_best FROM judged)
  , late AS (SELECT *, CASE WHEN behind THEN 'behind' WHEN k > 1 OR (second AND {'at': ts, 'id': batch_id} < first_best) THEN 'older' END AS reason FROM placed)"""

ORACLES = {
    "x1_retried_chunks": with_views(f"WITH {TRANSCRIPT} SELECT * FROM transcript"),
    "x3_late": f"WITH {_EDITS} SELECT recording_id, target, batch_id, reason FROM late WHERE reason IS NOT NULL",
    "x3_latest": f"WITH {_EDITS} SELECT recording_id, target, arg_max(batch_id, {{'at': ts, 'id': batch_id}}) AS batch_id, arg_max(kind, {{'at': ts, 'id': batch_id}}) AS kind FROM late WHERE reason IS NULL GROUP BY 1, 2",
    "x1_stream_segments": with_views(f"WITH {TRANSCRIPT} SELECT * FROM transcript"),
    "x2_stream_progress": with_views("SELECT recording_id, count(*) AS total, count(speaker_id) AS assigned, count(*) FILTER (speaker_id IS NOT NULL AND reviewed) AS reviewed FROM segments_ev GROUP BY 1"),
    "x3_stream_edits": "SELECT user_id AS recording_id, event_id % 20 AS target, arg_max(event_id, (ts, event_id)) AS batch_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1, 2",
    "x4_stream_activity": "SELECT user_id AS recording_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS from_s, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 3600 AS to_s, count(*) AS n FROM events GROUP BY 1, 2, 3",
}
