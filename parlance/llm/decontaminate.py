"""Benchmark decontamination by winnowing.

Texts are cut into words (ASCII letters and digits, lower-cased, and everything beyond ASCII). Of every window of
ten words the smallest hash of its 5-grams is a fingerprint. A window that a document shares with an item
selects the same 5-gram in both, so every shared span of ten words or more shares a fingerprint. Documents first
meet two filters (one bit for each slot of the items' fingerprints and of their
windows; 16 bits a window, at most 2**27 for each filter); a document's fingerprint that passes is extended to its whole ten-word windows, and those that pass are
joined with the items' windows word for word. Items of fewer than ten words are one window of their own length,
looked up through the second filter.

Defined cases: null text has no words; an item without words has no window; items that share an id count
once, a null item id counts as an empty string; rows of documents are independent, repeated ids included; texts of any length are read whole; empty tables
give no hits or no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import BITMAP_BITS, filter_bits, keep, key_filter, prune, row_key, scratch, slices, table, text_bytes

SPAN, GRAM = 10, 5
#: The items' windows are broadcast up to this many rows (about 100 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 100_000
#: Byte by byte: a-z, 0-9 and bytes beyond ASCII stay, A-Z become a-z, all else separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


class _WordHashes(dict):
    """Word to 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return _mix(out)


def winnow(h: np.ndarray) -> np.ndarray:
    """The fingerprint of each ten-word window: the smallest of its 5-gram hashes."""
    grams = gram_hashes(h, GRAM)
    width = SPAN - GRAM + 1
    if len(grams) < width:
        return np.empty(0, np.uint64)
    out = grams[: len(grams) - width + 1]
    for j in range(1, width):
        out = np.minimum(out, grams[j : j + len(out)])
    return out


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(bits - 1)).astype(np.int64)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, win, print, hash): every window of every item; print, its fingerprint, is null for short items."""

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            item, length, win, prints, wins = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(text)
                if not words:
                    continue
                n = min(SPAN, len(words))
                h = np.array(list(map(known.__getitem__, words)), np.uint64)
                count = len(words) - n + 1
                item += [name] * count
                length += [n] * count
                win += [b" ".join(words[i : i + n]) for i in range(count)]
                prints += winnow(h).view(np.int64).tolist() if n == SPAN else [None] * count
                wins += gram_hashes(h, n).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(length, pa.int32()), pa.array(win, pa.binary()), pa.array(prints, pa.int64()), pa.array(wins, pa.int64())], names=["item", "len", "win", "print", "hash"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).mapInArrow(run, "item string, len int, win binary, print long, hash long")


def _bits(windows: DataFrame, col: str, bits: int) -> np.ndarray:
    """The filter of a column's hashes as bits / 8 bytes."""
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for bucket, held in key_filter(windows.filter(F.col(col).isNotNull()).select(F.col(col).bitwiseAND(F.lit(bits - 1)).alias("_slot"))).collect():  # rows of 4 KiB
        out[bucket] = np.frombuffer(held, np.uint8)
    return out.ravel()


def _holds(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = _slots(h, 8 * len(held))
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def candidates(docs: DataFrame, prints, wins, short: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, found): found holds (start, len, win) of the document's windows that pass both filters."""
    kind = dict(docs.dtypes)[id_col]
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("win", pa.binary())]))

    def run(batches):
        print_bits, win_bits, known = prints.value, wins.value, _WordHashes()
        for batch in slices(batches, 1):
            count, found = [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                h = np.array(list(map(known.__getitem__, words)), np.uint64)
                marks = winnow(h)
                starts = np.nonzero(_holds(print_bits, marks))[0]
                hits = []
                if len(starts):
                    starts = starts[_holds(win_bits, gram_hashes(h, SPAN)[starts])]
                    hits += [{"start": s, "len": SPAN, "win": b" ".join(words[s : s + SPAN])} for s in starts.tolist()]
                for n in short:
                    hits += [{"start": s, "len": n, "win": b" ".join(words[s : s + n])} for s in np.nonzero(_holds(win_bits, gram_hashes(h, n)))[0].tolist()]
                count.append(len(words))
                found.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(found, found_type)], names=["id", "n_words", "found"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_words long, found array<struct<start int, len int, win binary>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    context = docs.sparkSession.sparkContext
    windows = keep(item_windows(items, item_col, item_text), "item-windows")
    short = sorted(r.len for r in windows.filter(F.col("len") < SPAN).select("len").distinct().collect())  # at most nine
    bits = filter_bits(windows.count())
    prints, wins = context.broadcast(_bits(windows, "print", bits)), context.broadcast(_bits(windows, "hash", bits))
    found = candidates(docs, prints, wins, short, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = keep(found, "decontamination")
    # windows with the same items are one set, and documents with the same sets one case: items are spelt out once for each case
    name = lambda parts: F.sha2(F.array_join(parts, ",").cast("binary"), 256)
    owners = windows.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.sha2(F.to_json("items").cast("binary"), 256))
    owners = keep(owners, "item-sets")
    spans = owners.select("win", "set")
    if windows.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    hits = found.select("row", F.explode("found").alias("f")).select("row", "f.start", (F.col("f.start") + F.col("f.len")).alias("end"), "f.win").join(spans, "win")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        hits.withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"), F.array_sort(F.collect_set("set")).alias("sets"))
        .withColumn("case", name(F.col("sets")))
    )
    covered = keep(covered, "decontaminated-spans")
    cases = covered.select("case", "sets").distinct().select("case", F.explode("sets").alias("set")).join(owners.select("set", "items").distinct(), "set")
    cases = cases.select("case", F.explode("items").alias("item")).distinct().groupBy("case").agg(F.count("*").alias("n_items"), name(F.array_sort(F.collect_list("item"))).alias("digest"))  # rows carry the digest, not the ids
    covered = covered.join(cases, "case").select("row", "n_hit", "n_items", "digest")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        found.select("row", "id", "n_words")
        .join(covered, "row", "left")
        .select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("digest", F.sha2(F.lit(b""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    )


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs whose text is not contaminated, whatever their id."""
    sha = row_key(F.col(text_col))
    with scratch() as last:
        found = contamination(docs.select(sha.alias("_key"), F.col(text_col).cast("string").alias("text")), items, id_col="_key")
        bad = last(keep(found.filter("contaminated").select("_key"), "contaminated"))
    return prune(docs, sha, bad)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": query}
ORACLES: dict[str, str] = {}
