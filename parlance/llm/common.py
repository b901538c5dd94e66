"""What the operators of this subpackage share: table access, the shared folder and kept tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions that name no shared folder (tests, local runs).
_OWN: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex}"


class _Scratch(threading.local):
    """Tables kept by each ``scratch`` that is open in this thread, the innermost last."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_SCRATCH = _Scratch()


@contextmanager
def scratch():
    """Tables kept inside are deleted at the end, but for those that are given to the function it yields."""
    made: list[DataFrame] = []
    last: list[DataFrame] = []

    def stays(df: DataFrame) -> DataFrame:
        last.append(df)
        return df

    _SCRATCH.open.append(made)
    try:
        yield stays
    finally:
        _SCRATCH.open.pop()
        for df in made:
            if not any(df is x for x in last):
                discard(df)
        if _SCRATCH.open:
            _SCRATCH.open[-1].extend(last)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Jobs inside hand rows to Python in Arrow batches of about ``size``, so that neither side holds many texts at once.

    The setting is the session's: jobs of other threads in it get smaller batches too, with the same results."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.options(**({"compression": "zstd"} | options))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_path = path
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(back)
    return back


def discard(df: DataFrame) -> None:
    """Delete a kept table that nothing reads any more."""
    path = getattr(df, "_kept_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of one bitmap of Spark's bitmap_construct_agg.
BITMAP_BITS = 32768
#: A key filter has 16 bits a key, from 2**20 up to 2**27 bits (16 MiB to broadcast); beyond, more keys pass it in vain.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def filter_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys).bit_length()))


def key_filter(slots: DataFrame) -> DataFrame:
    """A bitmap of the values of ``_slot``: (_bucket, _bits), 4 KiB for each bucket of BITMAP_BITS slots."""
    cut = slots.select(F.floor(F.col("_slot") / BITMAP_BITS).alias("_bucket"), F.pmod("_slot", F.lit(BITMAP_BITS)).alias("_bit"))
    return cut.groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))


def slot_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def may_hold(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """rows with ``_maybe``: whether the filter holds the key's slot. No key that is in the filter is missed."""
    bit = F.pmod(F.col("_slot"), F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    slotted = rows.withColumn("_slot", slot_of(key, bits)).withColumn("_bucket", F.floor(F.col("_slot") / BITMAP_BITS))
    return slotted.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_maybe", held).drop("_bucket", "_bits", "_slot")


def row_key(*columns: Column) -> Column:
    """One digest for the values of some columns, nulls told apart from texts."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def prune(docs: DataFrame, key: Column, lost: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in ``lost``; of those whose key is in ``repeated`` one row for each key. Both: (_key).

    Rows are told apart by their values, so a lost executor or another cut of the input changes nothing. A filter over the keys lets
    nearly all other rows stay where they are: whole texts are shuffled only for rows that pass it."""
    lost = keep(lost.select("_key").distinct(), "lost")
    asked = lost
    if repeated is not None:
        repeated = keep(repeated.select("_key").distinct(), "repeated")
        asked = lost.unionByName(repeated)
    n = asked.count()
    if not n:
        return docs
    bits = filter_bits(n)
    bitmap = keep(key_filter(asked.select(slot_of(F.col("_key"), bits).alias("_slot"))), "key-filter")
    # rows travel as one value, so no column of docs can clash
    marked = may_hold(docs.select(F.struct("*").alias("_row"), key.alias("_key")), F.col("_key"), bitmap, bits)
    left = marked.filter("_maybe").join(lost, "_key", "left_anti")
    if repeated is not None and not repeated.isEmpty():
        left = left.join(repeated, "_key", "left_anti").unionByName(left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return marked.filter("not _maybe").unionByName(left).select("_row.*")


def take(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose key is in ``wanted`` (_key, which is unique, and others), joined with it; few others are shuffled."""
    bits = filter_bits(wanted.count())
    bitmap = keep(key_filter(wanted.select(slot_of(F.col("_key"), bits).alias("_slot"))), "key-filter")
    return may_hold(docs.withColumn("_key", key), F.col("_key"), bitmap, bits).filter("_maybe").drop("_maybe").join(wanted, "_key")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unsigned_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def slices(batches, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose texts (a string column) have about ``size`` bytes; a longer text is a run of its own.

    What a task derives from its rows is then bounded by bytes of text, not by Spark's number of rows in a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column) -> Iterator[bytes]:
    """Each value of an Arrow string column as UTF-8; null counts as empty."""
    for value in column.cast("binary").to_pylist() if str(column.type) != "binary" else column.to_pylist():
        yield value or b""
