"""The library's jobs as streams: arriving chunks, progress, edits, and activity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.operators.parse import parse_transcripts
from parlance.operators.quality import pending_chunks
from parlance.sources import store
from parlance.sources.shared import kept

CHUNK = "recording_id long, chunk int, text string, length double, offset double"
#: What may come with a chunk: the key of what it was made with, and whether making it failed.
MADE = "key string, failed boolean"
CHUNK_KEY, TARGET = ["recording_id", "chunk", "key"], ["recording_id", "target"]


def stream_segments(spark: SparkSession, source: str, sink: str, checkpoint: str, merge_same_speaker: bool = True) -> StreamingQuery:
    """Chunks that arrive as JSON files become segments, each chunk once for a key. Offsets come with the chunk, as order is not guaranteed.

    Which chunks are done is a stored table, of which a batch reads the buckets of its own chunks, so the stream has no state that grows. A chunk that failed
    (``failed``, or without text) is recorded as such and is not done: it is taken when it is sent again. A batch writes its own folder, replaced if
    the batch is run again after a crash."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"key": F.coalesce("key", F.lit("")), "failed": F.coalesce("failed", F.lit(False)) | (F.trim(F.coalesce("text", F.lit(""))) == "")})
        best = F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy("failed", F.desc("text")))  # of one sent twice in a batch one that did not fail
        rows = kept(rows.withColumn("_place", best).filter("_place = 1").drop("_place"), "chunks")
        before = store.matching(rows, f"{sink}/done")
        todo = rows if before is None else pending_chunks(rows, before.filter(F.col("batch") != batch_id))
        todo = kept(todo, "pending")
        good = todo.filter("not failed").drop("key", "failed")
        parse_transcripts(good, merge_same_speaker).write.mode("overwrite").parquet(f"{sink}/segments/batch={batch_id}")
        store.upsert(todo.select(*CHUNK_KEY, "failed", F.lit(batch_id).cast("long").alias("batch")), f"{sink}/done", CHUNK_KEY)

    chunks = spark.readStream.schema(f"{CHUNK}, {MADE}").json(source)
    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(stream: DataFrame) -> DataFrame:
    """Running totals by recording of rows that carry speaker_id and reviewed; for output mode update or complete."""
    assigned = F.col("speaker_id").isNotNull()
    return stream.groupBy("recording_id").agg(F.count("*").alias("total"), F.count_if(assigned).alias("assigned"), F.count_if(assigned & F.coalesce("reviewed", F.lit(False))).alias("reviewed"))


def stream_activity(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Edits by recording and time window; a window is final once the watermark has passed it."""
    counts = stream.withWatermark("at", delay).groupBy("recording_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("recording_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def stream_edits(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """edits (recording_id, target, at, batch_id, kind, after) to the latest of each target, of equal times that of the larger batch, in update
    mode; repeats of a batch's edit within the delay are dropped. One edit a target is kept as state."""
    once = stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["recording_id", "target", "batch_id"])
    last = once.groupBy("recording_id", "target").agg(F.max(F.struct("at", "batch_id", "kind", "after")).alias("last"))
    return last.select("recording_id", "target", "last.*")


def apply_edits(stream: DataFrame, sink: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """edits (recording_id, target, at, batch_id, kind, after) applied to a stored table of the latest edit of each target; those that are not applied are not lost.

    sink/latest is the table (``read_latest``), of which a batch reads and writes the buckets of its own targets; sink/late has, by batch, every edit that
    came too late and why: ``behind`` the latest time of all earlier batches by more than the delay, or ``older`` than its target's latest. The stream keeps no state but the latest
    time, and a batch that is run again after a crash comes to the same result: an edit that is the latest already is neither applied nor late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = kept(batch.dropDuplicates([*TARGET, "batch_id"]), "edits")
        times = f"{sink}/times"
        seen = spark.read.schema("batch long, at timestamp").parquet(times).filter(F.col("batch") < batch_id).agg(F.max("at").alias("at")).first().at if batch_id else None
        behind = F.lit(False) if seen is None else F.col("at") < F.lit(seen) - F.expr(f"INTERVAL {delay}")
        before = store.matching(rows, f"{sink}/latest")
        now = F.lit(None).cast("struct<at:timestamp,batch_id:bigint>")
        rows = rows.withColumn("behind", behind)
        if before is not None:
            rows = rows.join(before.select(*TARGET, F.struct("at", F.col("batch_id").cast("long").alias("batch_id")).alias("now")), TARGET, "left")
        else:
            rows = rows.withColumn("now", now)
        mine = F.struct("at", F.col("batch_id").cast("long").alias("batch_id"))
        place = F.row_number().over(Window.partitionBy(*TARGET).orderBy("behind", F.desc("at"), F.desc("batch_id")))
        rows = rows.withColumns({"known": F.coalesce(mine == F.col("now"), F.lit(False)), "older": F.coalesce(mine < F.col("now"), F.lit(False)), "place": place})
        late = F.col("behind") | F.col("older") | (F.col("place") > 1)
        rows = kept(rows, "judged-edits")
        columns = [*TARGET, "at", "batch_id", "kind", "after"]
        rows.filter(late & ~F.col("known")).select(*columns, F.when(F.col("behind"), "behind").otherwise("older").alias("reason")).write.mode("overwrite").parquet(f"{sink}/late/batch={batch_id}")
        store.upsert(rows.filter(~late & ~F.col("known")).select(*columns), f"{sink}/latest", TARGET)
        rows.agg(F.max("at").alias("at")).select(F.lit(batch_id).cast("long").alias("batch"), "at").coalesce(1).write.mode("overwrite").parquet(f"{times}/part={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, sink: str) -> DataFrame:
    return store.read(spark, f"{sink}/latest")
