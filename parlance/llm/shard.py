"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards; a node weighs as much as the shards below it. A row descends from
the root: at each level every child draws an exponential variate, -ln(u) / weight with u a hash of the row's
key and the child, and the smallest draw wins. A child whose weight grows wins only rows that it did not
have, one whose weight shrinks only loses rows, so movement is confined to the subtrees whose weights change. A shard
that is added as a region of its own changes no other weight and so takes rows only into itself.

Slots are gapless within a shard without sorting a shard in one task: a shard is cut into buckets by hash,
bucket sizes give each bucket its first slot, and rows are numbered within their bucket.

Defined cases: null text has no bytes and crc 0; rows without an id share one key, so one shard; rows that repeat get a slot each;
texts of any length count whole, as only their bytes and crc are read; an empty table gives an empty result; further columns are ignored, names that clash included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import keep, table


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def cluster(shards: int, base: int = 40, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The tree for a number of shards: the first ``base`` fill regions in order, each later one is a region of its own."""
    per_region = racks * per_rack
    inner = [Shard(s, f"region{s // per_region}", f"rack{s // per_rack}") for s in range(min(base, shards))]
    return inner + [Shard(s, f"region-of-{s}", f"rack-of-{s}") for s in range(base, shards)]


def _pick(key: Column, children: dict[str, float]) -> Column:
    """Name of the child with the smallest weighted draw."""
    names = [c for c, w in children.items() if w > 0]
    if len(names) == 1:
        return F.lit(names[0])
    draws = []
    for name in names:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / children[name]).alias("draw"), F.lit(name).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _weights(tree: list[Shard], of, within=None) -> dict[str, float]:
    out: dict[str, float] = {}
    for s in tree:
        if within is None or within(s):
            out[of(s)] = out.get(of(s), 0.0) + s.weight
    return out


def place(df: DataFrame, key: Column, tree: list[Shard], out: str) -> DataFrame:
    """df with the shard number of each row in column ``out``."""
    regions = _weights(tree, lambda s: s.region)
    step = df.withColumn("_region", _pick(key, regions))
    rack = None
    for region, weight in regions.items():
        if weight > 0:
            pick = _pick(key, _weights(tree, lambda s: s.rack, lambda s: s.region == region))
            rack = F.when(F.col("_region") == region, pick) if rack is None else rack.when(F.col("_region") == region, pick)
    step = step.withColumn("_rack", rack)
    shard = None
    for name, weight in _weights(tree, lambda s: s.rack).items():
        if weight > 0:
            pick = _pick(key, _weights(tree, lambda s: f"shard{s.number}", lambda s: s.rack == name))
            shard = F.when(F.col("_rack") == name, pick) if shard is None else shard.when(F.col("_rack") == name, pick)
    return step.withColumn(out, F.substring(shard, 6, 12).cast("int")).drop("_region", "_rack")


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = place(place(rows, key, cluster(shards), "shard"), key, cluster(shards + 1), "grown_shard")
    rows = keep(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)).cast("int")), "placed")
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    if shards * buckets <= 200_000:  # rows of this table at most
        first = F.broadcast(first)
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("n", F.row_number().over(inside))
        .join(first, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op2_hash_tree_shards": query}
ORACLES: dict[str, str] = {}
