"""Caches beside a recording: chunk transcripts, measured words, proposals, rosters, and digests of files."""

from __future__ import annotations

import hashlib
import os
import uuid
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.rosters import parse_rosters
from parlance.sources import store

RID = "recording_id"

#: Version of the alignment that wrote a cache; others are not read.
ALIGN_VER = 1
_NAME = r"^(.*?)_?(\d+)\.(.*)\.txt$"


def read_chunk_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, chunk, key, text, …): files named stem_NNN.key.txt, whole texts, with what the key's parts say."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    part = lambda k: F.regexp_extract("file", _NAME, k)
    rows = rows.filter(F.col("file").rlike(_NAME)).select("file", part(1).alias("stem"), part(2).cast("int").alias("chunk"), part(3).alias("key"), "text")
    parts = F.split("key", r"\.")
    one = lambda pattern: F.get(F.filter(parts, lambda p: p.rlike(pattern)), F.lit(0))
    return rows.withColumns({"fingerprint": one("^[0-9a-f]{16}$"), "chunk_seconds": F.substring(one(r"^c\d+$"), 2, 9).cast("int"), "mode": one("^(diar|ts|cluster)$"), "verbatim": F.array_contains(parts, "vb"), "roster": one("^[0-9a-f]{8}$")})


def write_words(words: DataFrame, path: str, model: str = "", align_ver: int = ALIGN_VER) -> None:
    """words (recording_id, text, start, end) take the place of what is stored of the same recordings in the same alignment version."""
    store.upsert(words.withColumns({"model": F.lit(model), "align_ver": F.lit(align_ver)}), path, [RID, "align_ver"])


def read_words(spark: SparkSession, path: str, align_ver: int = ALIGN_VER, recording_id: int | None = None) -> DataFrame:
    """Words of one alignment version, of all recordings or of one."""
    key = {} if recording_id is None else {RID: recording_id}
    return store.read(spark, path, align_ver=align_ver, **key).drop("align_ver")


def read_words_json(spark: SparkSession, path: str, align_ver: int = ALIGN_VER) -> DataFrame:
    """(file, text, start, end) from JSON documents {align_ver, words: [{text, start, end}]}; broken or outdated ones are left out."""
    schema = "align_ver int, model string, words array<struct<text:string,start:double,end:double>>, _corrupt_record string"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return docs.filter((F.col("align_ver") == align_ver) & F.col("_corrupt_record").isNull()).select("file", F.explode("words").alias("w")).select("file", "w.text", "w.start", "w.end")


def write_proposals(proposals: DataFrame, path: str) -> None:
    """Proposals take the place of what is stored under the same fingerprint, but for stored decisions: those (status accepted or rejected) stay
    unless the same proposal (id) is given anew. Proposals of recordings without a fingerprint are not kept."""

    def decided(before: DataFrame, new: DataFrame) -> DataFrame:
        if "status" not in before.columns:
            return before.limit(0)
        return before.filter(F.col("status").isin("accepted", "rejected")).join(new.select("fingerprint", "id").distinct(), ["fingerprint", "id"], "left_anti")

    rows = proposals.filter(F.coalesce("fingerprint", F.lit("")) != "").withColumn("align_ver", F.lit(ALIGN_VER))
    store.upsert(rows, path, ["fingerprint", "align_ver"], decided)


def read_proposals(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    key = {"fingerprint": fingerprint} if fingerprint else {}
    return store.read(spark, path, align_ver=ALIGN_VER, **key).drop("align_ver")


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """Speakers from text files, one file for each recording; the id is a hash of the file's path."""
    rows = spark.read.text(path, wholetext=True)
    return parse_rosters(rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("recording_id"), F.col("value").alias("text")))


def write_lines(lines: DataFrame, path: str, key: str, order: str) -> None:
    """lines (key, order, value): the values of each key in order as the lines of a file, key=1.txt in a folder for each task, or key=1/….txt where only Spark can write.

    Hadoop's writer starts two or three processes for each file on a local or mounted disk, to set modes, one after another; there the tasks write by themselves."""
    spark = lines.sparkSession
    # a stated number of partitions, as by its bytes Spark would have one task write all files
    rows = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, order).select(key, F.coalesce("value", F.lit("")).alias("value"))
    fs, p = store._fs(spark, path)
    if fs.getScheme() != "file":
        rows.write.partitionBy(key).text(path)
        return
    top = p.toUri().getPath()
    os.makedirs(top, exist_ok=True)

    def write(batches):
        folder, n, name, out = f"{top}/{TaskContext.get().partitionId():05d}", 0, None, None
        hidden = f"{folder}/.{uuid.uuid4().hex}"  # a task that is tried again replaces what it finished before
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or k != name:
                    if out:
                        out.close()
                        os.replace(hidden, f"{folder}/{key}={_file_name(name)}.txt")
                    name, out, n = k, open(hidden, "wb"), n + 1
                out.write(value + b"\n")
        if out:
            out.close()
            os.replace(hidden, f"{folder}/{key}={_file_name(name)}.txt")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select(F.col(key).cast("string"), F.col("value").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _file_name(key: str | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if key is None else quote(key, safe="")


#: Files up to this size are read by Spark's binary source, which holds a file in one row; larger ones are read piece by piece in the task.
BINARY_BYTES, PIECE = 1 << 28, 1 << 22
#: What a task reads; Spark itself counts a file as 4 MB at least, so that small ones would be a task for some 30 of them.
TASK_FILES, TASK_BYTES = 1 << 10, 1 << 27


def _tasks(files: DataFrame) -> int:
    """How many tasks read files of the binary source: TASK_FILES or TASK_BYTES each, more where that leaves cores idle."""
    size = int(files._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(len(files._jdf.inputFiles()) // TASK_FILES, size // TASK_BYTES, 4 * files.sparkSession.sparkContext.defaultParallelism)


def hash_files(spark: SparkSession, path: str, binary_bytes: int = BINARY_BYTES, recursive: bool = False) -> DataFrame:
    """(path, size, fingerprint, sha256): BLAKE2b-64 of the size's digits and the bytes, and SHA-256; both empty if a file cannot be read.

    Files over ``binary_bytes`` and files that vanish or are closed to reading are opened by their path where the task runs, so large files have to be on
    a file system that the executors mount; on a store that only Spark reads they count as unreadable. recursive: files of all folders below the path."""
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    listed = reader().load(path)
    tasks = _tasks(listed)
    files = listed.select("path", F.col("length").alias("size")).coalesce(tasks)
    readable = reader().option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    whole = readable.filter(F.col("length") <= binary_bytes).select("path", "length", "content").coalesce(tasks)
    names = ["path", "size", "fingerprint", "sha256"]
    schema = "path string, size long, fingerprint string, sha256 string"

    def from_rows(batches):
        for batch in batches:
            found = [_digests(size, [content.as_buffer()]) for size, content in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.string()) for k in range(2))], names=names)

    def from_paths(batches):
        for batch in batches:
            rows = [(p, n, f, s) if s is not None else (p, n, *_digests(n, _pieces(p))) for p, n, f, s in zip(*(batch.column(k).to_pylist() for k in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=names)

    done = whole.mapInArrow(from_rows, schema).drop("size")
    # sizes of files say nothing of how many there are
    return files.join(done.hint("shuffle_merge"), "path", "left").select(*names).mapInArrow(from_paths, schema)


def _pieces(url: str):
    with open(unquote(urlsplit(url).path), "rb") as f:
        while piece := f.read(PIECE):
            yield piece


def _digests(size: int, pieces) -> tuple[str, str]:
    blake, sha = hashlib.blake2b(str(size).encode(), digest_size=8), hashlib.sha256()
    try:
        for piece in pieces:
            blake.update(piece)
            sha.update(piece)
    except OSError:
        return "", ""
    return blake.hexdigest(), sha.hexdigest()
