"""Project files: JSON documents of a recording each, read into tables and written back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.schemas import SCHEMA_VERSION
from parlance.sources import store
from parlance.sources.shared import kept

RID = "recording_id"
_SEGMENT = "index long, start double, end double, text string, cluster string, chunk int, speaker_id string, reviewed boolean, note string, text_edited boolean, time_edited boolean, time_reviewed boolean, orig_start double, orig_end double"
_SPEAKER = "id string, name string, note string, order int"
_PROJECT = (
    f"{RID} long, audio_path string, duration double, chunk_seconds int, model string, verbatim boolean, audio_fingerprint string, time_offset double, source_sha256 string, engine map<string,string>, doc_revision int, "
    f"edit_log array<map<string,string>>, speakers array<struct<{_SPEAKER.replace(' ', ':').replace(',:', ',')}>>, segments array<struct<{_SEGMENT.replace(' ', ':').replace(',:', ',')}>>, _corrupt_record string"
)


class Projects(NamedTuple):
    recordings: DataFrame
    speakers: DataFrame
    segments: DataFrame
    rejects: DataFrame  # (file, reason, text)


def _schema() -> T.StructType:
    return T.StructType.fromDDL(_PROJECT)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, p): every record of every file. p is the parsed project, text the line it was (null where a file is one document)."""
    state = store.latest(spark, path) if store.exists(spark, path) else None
    paths = path if state is None else store.folders_of(path, state)
    if state is not None and not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("text", T.StringType()), T.StructField("p", _schema()), T.StructField("alone", T.BooleanType())]))
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(paths, recursiveFileLookup=True).select(file, F.trim("value").alias("text")).filter("text <> ''")
    # one record a line, unless most lines are but parts of a document
    whole = F.col("text").startswith("{") & F.col("text").endswith("}") & (F.length("text") > 2)
    kinds = kept(lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(whole).alias("whole")), "project-files")
    listed = kinds.filter("2 * whole >= n").select("file", (F.col("n") == 1).alias("alone"))
    parsed = F.from_json("text", _schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    by_line = lines.join(listed, "file").select("file", "text", parsed.alias("p"), "alone")
    docs = spark.read.schema(_schema()).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(paths)
    by_file = docs.select(file, F.lit(None).cast("string").alias("text"), F.struct(*_schema().names).alias("p")).join(listed, "file", "left_anti").withColumn("alone", F.lit(True))
    return by_line.unionByName(by_file)


def load_projects(spark: SparkSession, path: str) -> Projects:
    """Files hold one JSON document each or one record a line; a folder that ``write_projects`` has written is read as its last version.

    Keys missing from older files get their defaults. A recording's id is the one its record carries, else a hash of the file's path and, where the file
    has several records, of the record itself: the same in all tables and in every run. Broken records do not take others with them; they are in rejects."""
    found = kept(_records(spark, path), "project-records")
    reason = F.when(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull(), "broken JSON").when(F.col("p.segments").isNull() & F.col("p.audio_path").isNull(), "no project")
    rejects = found.select("file", reason.alias("reason"), F.coalesce("text", F.col("p._corrupt_record")).alias("text")).filter("reason is not null")
    docs = found.filter(reason.isNull()).select("p.*", F.when(F.col("alone"), F.xxhash64("file")).otherwise(F.xxhash64("file", "text")).alias("_hash"))
    docs = docs.withColumn(RID, F.coalesce(RID, "_hash"))
    or_else = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    recordings = docs.select(
        RID, or_else("audio_path", ""), or_else("duration", 0.0), or_else("chunk_seconds", 600), or_else("model", ""), or_else("verbatim", False), or_else("audio_fingerprint", ""), or_else("time_offset", 0.0),
        or_else("source_sha256", ""), F.coalesce("engine", F.create_map().cast("map<string,string>")).alias("engine"), or_else("doc_revision", 0), F.coalesce("edit_log", F.array().cast("array<map<string,string>>")).alias("edit_log"),
    )
    people = docs.select(RID, F.explode("speakers").alias("s"))
    speakers = people.select(RID, F.col("s.id").alias("speaker_id"), F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.note", F.lit("")).alias("note"), F.coalesce("s.order", F.lit(0)).alias("ord"))
    rows = docs.select(RID, F.posexplode("segments").alias("k", "s"))
    s = lambda c: F.col(f"s.{c}")
    edited, start, end = F.coalesce(s("time_edited"), F.lit(False)), F.coalesce(s("start"), F.lit(0.0)), F.coalesce(s("end"), F.lit(0.0))
    segments = rows.select(
        RID, F.coalesce(s("index"), F.col("k").cast("long")).alias("idx"), start.alias("seg_start"), end.alias("seg_end"), F.coalesce(s("text"), F.lit("")).alias("text"), F.coalesce(s("cluster"), F.lit("")).alias("cluster"),
        F.coalesce(s("chunk"), F.lit(0)).alias("chunk"), F.when(s("speaker_id") != "", s("speaker_id")).alias("speaker_id"), F.coalesce(s("reviewed"), F.lit(False)).alias("reviewed"), F.coalesce(s("note"), F.lit("")).alias("note"),
        F.coalesce(s("text_edited"), F.lit(False)).alias("text_edited"), edited.alias("time_edited"), F.coalesce(s("time_reviewed"), edited).alias("time_reviewed"),
        F.coalesce(s("orig_start"), start).alias("orig_start"), F.coalesce(s("orig_end"), end).alias("orig_end"),
    )
    return Projects(recordings, speakers, segments, rejects)


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, speakers, segments) of ``load_projects``."""
    return load_projects(spark, path)[:3]


def project_records(recordings: DataFrame, speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per recording in the shape of a project file of the present schema version."""

    def folded(df: DataFrame, order: str, names: dict[str, str], out: str) -> DataFrame:
        item = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(n) for c, n in names.items()])
        return df.groupBy(RID).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[n].alias(n) for n in names.values()])).alias(out))

    people = folded(speakers, "ord", {"speaker_id": "id", "name": "name", "note": "note", "ord": "order"}, "speakers")
    names = {"idx": "index", "seg_start": "start", "seg_end": "end"} | {c: c for c in ("text", "cluster", "chunk", "speaker_id", "reviewed", "note", "text_edited", "time_edited", "time_reviewed", "orig_start", "orig_end")}
    rows = folded(segments, "idx", names, "segments")
    return recordings.withColumn("schema", F.lit(SCHEMA_VERSION)).join(people, RID, "left").join(rows, RID, "left")


def write_projects(recordings: DataFrame, speakers: DataFrame, segments: DataFrame, path: str) -> None:
    """Recordings take the place of what the folder holds of them, as JSON with one record a line; others stay, and all become visible at once."""
    store.upsert(project_records(recordings, speakers, segments), path, [RID], form="json")
