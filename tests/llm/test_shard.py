import math
import zlib
from collections import Counter, defaultdict

import xxhash

from parlance.llm import shard as op
from tests.llm.cases import ROWS, documents


def chain(*values):
    """Spark's hash of several columns: each one's hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed


def brute(key, tree):
    def pick(children):
        names = [c for c, w in children.items() if w > 0]
        return min(names, key=lambda c: -math.log(((chain(key, c) >> 11) + 0.5) / 2**53) / children[c])

    def weights(of, within=lambda s: True):
        out = defaultdict(float)
        for s in tree:
            if within(s):
                out[of(s)] += s.weight
        return out

    region = pick(weights(lambda s: s.region))
    rack = pick(weights(lambda s: s.rack, lambda s: s.region == region))
    return int(pick(weights(lambda s: f"shard{s.number}", lambda s: s.rack == rack))[5:])


def test_matches_brute_force(spark):
    rows = ROWS + [(1000 + k, f"t{k}", "en", "s", 1) for k in range(400)]
    out = op.assign(documents(spark, rows), buckets=4).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute(key, op.cluster(40)) and r.grown_shard == brute(key, op.cluster(41)) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert op.assign(documents(spark, [])).collect() == []


def test_balance_and_growth(spark):
    n = 40_000
    df = spark.range(n).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) as text")
    out = op.assign(df)
    sizes = {r.shard: r["count"] for r in out.groupBy("shard").count().collect()}
    assert set(sizes) == set(range(40)) and max(abs(v - n / 40) for v in sizes.values()) < 6 * math.sqrt(n / 40)
    moved = out.filter("shard <> grown_shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {40}
    assert abs(moved.count() - n / 41) < 6 * math.sqrt(n / 41)


def test_weights_confine_movement(spark):
    """A heavier shard draws rows from elsewhere into its region, within the region into its rack, and within the rack to itself."""
    from pyspark.sql import functions as F

    old = op.cluster(40)
    new = [op.Shard(s.number, s.region, s.rack, 3.0) if s.number == 9 else s for s in old]
    df = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    both = op.place(op.place(df, F.col("k"), old, "a"), F.col("k"), new, "b").filter("a <> b").collect()
    region, rack = ({s.number: x for s, x in zip(old, xs)} for xs in ([s.region for s in old], [s.rack for s in old]))
    assert both and all(region[r.b] == region[9] for r in both)
    inside = [r for r in both if region[r.a] == region[9]]
    assert inside and all(rack[r.b] == rack[9] for r in inside if rack[r.a] != rack[r.b]) and all(r.b == 9 for r in inside if rack[r.a] == rack[9])
