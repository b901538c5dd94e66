"""Checks on transcripts and on the jobs that make them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import LINE_BREAK, trim

LOOP, UNIT, MIN_LINES, DISTINCT_SHARE = 15, 12, 40, 0.2
# What messages of failed requests contain, by kind, in the order in which they are tried.
FATAL = {
    "depleted": ("credits are depleted", "prepayment", "billing"),
    "quota": ("exceeded your current quota", "quota_exceeded"),
    "auth": ("api key not valid", "api_key_invalid", "invalid api key", "unauthenticated", "permission_denied", "permission denied"),
}
RATE_LIMITED = ("429", "resource_exhausted", "rate limit")


def has_loop(text: str) -> bool:
    """Whether a line of at least 2 * LOOP characters has a unit of up to 12 characters LOOP times in a row.

    A unit of k characters is repeated LOOP times where (LOOP - 1) * k places in a row equal those k places on."""
    if len(text) < 2 * LOOP:
        return False
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[-1], np.flatnonzero(c == 10), [len(c)]])
    for k in range(1, UNIT + 1):
        differ = np.flatnonzero((c[k:] != c[:-k]) | (c[k:] == 10) | (c[:-k] == 10))
        edges = np.concatenate([[-1], differ, [max(0, len(c) - k)]])
        runs = np.flatnonzero(np.diff(edges) > (LOOP - 1) * k)
        if k > 1 and len(runs):
            return True
        for at in edges[runs] + 1:  # one character over and over: the line may be too short
            line = np.searchsorted(ends, at)
            if ends[line] - ends[line - 1] - 1 >= 2 * LOOP:
                return True
    return False


def _loops(texts: pd.Series) -> pd.Series:
    return texts.map(has_loop)


def flag_degenerate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, degenerate, reason): empty, a short unit repeated within a line, few different lines, or one line many times in a row.

    Texts are split and counted by Spark's functions; loops are found by comparing a text with itself, shifted, over whole arrays, which a
    pattern with a back reference would try from every place."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAK), trim), lambda x: x != "")
    rows = docs.select(F.col(id_col), lines.alias("lines")).withColumn("distinct", F.array_distinct("lines"))
    loops = F.pandas_udf(_loops, "boolean")(F.array_join("distinct", "\n"))
    few = (F.size("lines") >= MIN_LINES) & (F.size("distinct") / F.size("lines") < DISTINCT_SHARE)
    # a run of n equal lines has a stretch of n - 1 places that equal their predecessor
    same = F.array_join(F.zip_with("lines", F.slice("lines", F.lit(2), F.size("lines")), lambda a, b: F.when(a == b, "=").otherwise(".")), "")
    run = F.contains(same, F.lit("=" * (LOOP - 1)))
    reason = F.when(F.size("lines") == 0, "empty").when(loops, "loop").when(few, "few_lines").when(run, "line_run")
    return rows.select(id_col, reason.isNotNull().alias("degenerate"), reason.alias("reason"))


def classify_errors(log: DataFrame, msg_col: str = "message") -> DataFrame:
    """error_class: depleted, quota or auth (fatal, in this order), else retryable; rate_limited: worth a long wait."""
    text = F.lower(F.coalesce(F.col(msg_col), F.lit("")))
    any_of = lambda keys: F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(text, k))
    kinds = [F.when(any_of(keys), name) for name, keys in FATAL.items()]
    return log.withColumns({"error_class": F.coalesce(*kinds, F.lit("retryable")), "rate_limited": any_of(RATE_LIMITED)})


def retry_schedule(failures: DataFrame) -> DataFrame:
    """wait_s: 20 seconds more for each attempt where the rate is limited, else 5 doubled each time."""
    return failures.withColumn("wait_s", F.when(F.col("rate_limited"), 20.0 * (F.col("attempt") + 1)).otherwise(5.0 * F.pow(F.lit(2.0), F.col("attempt"))))


def chunk_status(chunks: DataFrame) -> DataFrame:
    """Per recording n, failed, segments and status: failed if all chunks failed, empty without any segment, else partial or ok."""
    out = chunks.groupBy("recording_id").agg(F.count("*").alias("n"), F.count_if(F.col("failed")).alias("failed"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"))
    return out.withColumn("status", F.when(F.col("failed") == F.col("n"), "failed").when(F.col("segments") == 0, "empty").when(F.col("failed") > 0, "partial").otherwise("ok"))


def chunk_key(fingerprint: str = "fingerprint", chunk_seconds: str = "chunk_seconds", verbatim: str = "verbatim", mode: str = "mode", roster: str = "roster") -> Column:
    """What a cached chunk was made with: source, chunk length, mode, wording, and the roster's digest; absent parts are left out."""
    names = trim(F.coalesce(F.col(roster), F.lit("")))
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(".", some(F.col(fingerprint)), F.concat(F.lit("c"), F.col(chunk_seconds).cast("string")), some(F.col(mode)), F.when(F.col(verbatim), "vb"), F.when(names != "", F.substring(F.md5(names.cast("binary")), 1, 8)))


def pending_chunks(chunks: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Chunks that are not done under the same key; all of them if forced. Failed ones are never done."""
    if force:
        return chunks
    good = done.filter(~F.coalesce("failed", F.lit(False))).select("recording_id", "chunk", "key").distinct()
    return chunks.join(good, ["recording_id", "chunk", "key"], "left_anti")


def verify_sources(recordings: DataFrame, hashes: DataFrame) -> DataFrame:
    """result: match, mismatch, missing (no such file or unreadable), or first_record (nothing recorded yet)."""
    now = hashes.select(F.col("path").alias("audio_path"), F.col("sha256").alias("now_sha"))
    found, recorded = F.coalesce("now_sha", F.lit("")), F.coalesce("source_sha256", F.lit(""))
    result = F.when(found == "", "missing").when(recorded == "", "first_record").when(found == recorded, "match").otherwise("mismatch")
    return recordings.join(now, "audio_path", "left").select("recording_id", result.alias("result"))


def same_recording(old: DataFrame, new: DataFrame, tol: float = 1.0) -> DataFrame:
    """same: fingerprints agree where both have one, else durations within tol, else true."""
    both = old.select("recording_id", F.col("audio_fingerprint").alias("fa"), F.col("duration").alias("da")).join(new.select("recording_id", F.col("audio_fingerprint").alias("fb"), F.col("duration").alias("db")), "recording_id")
    has = lambda a, b, none: (F.coalesce(a, none) != none) & (F.coalesce(b, none) != none)
    same = F.when(has(F.col("fa"), F.col("fb"), F.lit("")), F.col("fa") == F.col("fb")).when(has(F.col("da"), F.col("db"), F.lit(0.0)), F.abs(F.col("da") - F.col("db")) <= tol).otherwise(True)
    return both.select("recording_id", same.alias("same"))


def envelope(samples: DataFrame, buckets: int) -> DataFrame:
    """(key, bucket, lo, hi): smallest and largest sample of each of ``buckets`` parts of a key's samples; empty parts are zero."""
    if buckets <= 0:
        return samples.sparkSession.createDataFrame([], f"key {dict(samples.dtypes)['key']}, bucket long, lo double, hi double")
    w = Window.partitionBy("key")
    rows = samples.withColumns({"r": F.row_number().over(w.orderBy("ord")) - 1, "n": F.count("*").over(w)})
    part = rows.withColumn("bucket", (((F.col("r") + 1) * buckets + F.col("n") - 1) / F.col("n")).cast("long") - 1)
    found = part.groupBy("key", "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    every = samples.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    return every.join(found, ["key", "bucket"], "left").fillna(0.0, ["lo", "hi"])
