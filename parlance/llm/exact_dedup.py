"""Exact dedup with a log-structured merge index, in DataFrame operations only.

Each task's documents are a memtable, which is flushed as one *run*: its (digest, id) entries sorted by digest, written as
Parquet. Runs have one filter between them: the slots of all digests are counted (a shuffle of pre-aggregated numbers, not of entries), which gives a
bitmap of the slots that are used more than once. Before runs are merged each entry is looked up in it: an entry alone in its slot has no equal in any run, is
final and is not shuffled. *Compaction* merges the rest into one level that holds, per digest, the smallest and largest entry and the
number of entries. Entries whose digest occurs more than once are *hits*; a filter over the hits' digests picks the
rows whose texts take part in the byte verification, which groups by the whole text. A digest that turns out to cover several
texts is resolved by the texts themselves.

Bounds: both filters have 16 bits an entry, at most 2**27 (16 MiB); an index of more than some ten million rows merges more entries than it
had to, with the same result.

Defined cases: a null text counts as empty; a null id loses against any id and never stays unless all
ids of its group are null; rows that repeat id and text are one group, of which one row is kept; texts of any length are read whole; further
columns are ignored, names that clash included; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import filter_bits, keep, key_filter, may_hold, prune, row_key, scratch, slot_of, table


def _entries(docs: DataFrame, id_col: str, text_col: str, key_hex: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), sha.alias("sha"), F.substring(sha, 1, key_hex).alias("key"))


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_hex: int = 64) -> DataFrame:
    """Level 0: (key, id, sha, ord). Each task's memtable becomes one sorted run.

    ``ord`` numbers the entries once and is fixed by the write, so rows that repeat an id can be told apart."""
    entries = _entries(docs, id_col, text_col, key_hex).select("key", "id", "sha", F.monotonically_increasing_id().alias("ord"))
    return keep(entries.sortWithinPartitions("key"), "lsm-run")


def looked_up(level0: DataFrame) -> DataFrame:
    """Level 0 with ``_maybe``: whether another entry of any run may have the same key."""
    bits = filter_bits(level0.count())
    used = level0.groupBy(slot_of(F.col("key"), bits).alias("_slot")).agg(F.count("*").alias("n")).filter("n > 1")
    return may_hold(level0, F.col("key"), keep(key_filter(used), "lsm-filter"), bits)


def _ends(best: str = "n") -> list[Column]:
    """Smallest and largest entry of a group; a null id loses at either end."""
    return [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ord")).alias("lo"), F.max(F.struct("id", "ord")).alias("hi"), F.count("*").alias(best)]


def compact(level: DataFrame) -> DataFrame:
    """Merge runs: one entry per key with its smallest and largest (id, ord) and the number of entries."""
    return level.groupBy("key").agg(*_ends())


def maybe_hits(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (with a key) with ``_maybe``: whether the filter of the index's hits lets them pass; no hit is missed."""
    hits = keep(index.filter("n > 1").select("key"), "lsm-hits")
    bits = filter_bits(hits.count())
    return may_hold(rows, F.col("key"), key_filter(hits.select(slot_of(F.col("key"), bits).alias("_slot"))), bits)


def verify(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Byte verification of hits: the keys that cover more than one text (none, unless digests collide).

    Copies collapse before the shuffle, as the whole text is a grouping key."""
    hits = maybe_hits(entries, index).filter("_maybe")
    return hits.groupBy("key", "text").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest", key_hex: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``stays``: which id of equal texts is kept, "smallest" or "largest". ``key_hex``: hex digits of the SHA-256
    that form the index key (64: all); fewer digits only cost verification, never correctness."""
    if stays not in ("smallest", "largest"):
        raise ValueError("stays is 'smallest' or 'largest'")
    side = "hi" if stays == "largest" else "lo"

    def decided(entries: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        return entries.join(groups.select(*on, F.col(side).alias("best"), "n"), on).select(
            F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.ord") == F.col("ord")).alias("kept"), F.col("sha").alias("text_sha256")
        )

    level0 = looked_up(flush_runs(docs, id_col, text_col, key_hex))
    several = level0.filter("_maybe")
    alone = level0.filter("not _maybe").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    index = keep(compact(several), "lsm-level1")
    entries = _entries(docs, id_col, text_col, key_hex)
    mixed = keep(verify(entries, index), "lsm-mixed")
    if mixed.isEmpty():
        return alone.unionByName(decided(several, index, ["key"]))
    clean = decided(several.join(mixed, "key", "left_anti"), index, ["key"])
    rest = keep(entries.join(mixed, "key", "left_semi").withColumn("ord", F.monotonically_increasing_id()), "lsm-rest")
    return alone.unionByName(clean).unionByName(decided(rest, rest.groupBy("key", "text").agg(*_ends()), ["key", "text"]))


def keep_one(docs: DataFrame, stays: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat both id and text, one stays."""
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    best = F.col(id_col).eqNullSafe(F.col("keep_id"))
    with scratch() as last:
        copies = exact_dedup(docs, id_col, text_col, stays).filter("group_size > 1")
        copies = last(keep(copies.select(row_key(F.col(id_col), F.col("text_sha256")).alias("_key"), best.alias("best"), "kept"), "lsm-decisions"))
    return prune(docs, row_key(F.col(id_col), sha), copies.filter("not best"), copies.filter("best and not kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), stays="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op7_exact_dedup": query}
ORACLES = {"op7_exact_dedup": SQL}
