"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint: 64 bits, bit b set if it is set in over half of the shingle hashes (XXH64, seed 42, repeats
count). Fingerprints within two differing bits are linked; a document's component is everything
reachable over links.

Search: equal fingerprints form a class, so copies cost one row. A fingerprint is cut into three segments of
22, 21 and 21 bits, each a word of the perfect (23, 12) Golay code with spare bits zero. Two words within
distance two have a common neighbour within distance one, so decoding a word's ball of radius one gives
one to six codeword indices of which close words share at least one. By the pigeonhole principle two errors
leave one of three segments intact; its value, joined with each codeword index of the next segment, is a key.
Classes that share a key are compared; a key of more than ``pair_limit`` classes is not paired but
verified exactly through common neighbours (two fingerprints differ in at most two bits if and only
if their balls of radius one meet), which is linear in the key's size and loses no link.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; null ids take
part but a component is named by its smallest id that is not null; rows that repeat are one class; texts of any length are read whole; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import discard, keep, prune, row_key, scratch, slices, small_batches, table, take, text_bytes, unsigned_hex

SEED = 42
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GOLAY = 0b101011100011
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of lower-cased (A-Z) words between ASCII white space; unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    last = ends[width - 1 :].tolist()
    first = starts[: len(last)].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _errors() -> np.ndarray:
    """The error pattern of weight at most three for each of 2048 syndromes."""
    one = 1 << np.arange(23)
    a, b, c = np.meshgrid(one, one, one, indexing="ij")
    patterns = np.unique(np.concatenate([[0], one, (a | b)[..., 0].ravel(), (a | b | c).ravel()]))
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords that its ball of radius one decodes to (24 columns, with repeats)."""
    errors = _errors()
    ball = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    return (ball ^ errors[_syndromes(ball)]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: for each segment its value with each codeword index of the next one."""
    values = fps.astype(np.uint64)
    parts = [((values >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        index = np.sort(codeword_indices(parts[(k + 1) % 3]), axis=1)
        new = np.concatenate([np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(k) << 40) | (parts[k][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp) for every Golay key of each distinct fingerprint."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, key = golay_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps.view(np.int64)[row])], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def links(classes: DataFrame, pair_limit: int = 48) -> DataFrame:
    """(a, b): a forest-like set of links that joins all fingerprints within two differing bits.

    Nodes are fingerprints, and for crowded keys also common neighbours, which stand for themselves."""
    keys = keyed(classes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keep(keys.join(sizes, "key"), "golay-keys")
    few = shared.filter(F.col("n") <= pair_limit)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = shared.filter(F.col("n") > pair_limit).select(F.col("fp").alias("a")).distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    stars = crowded.select("a", F.explode(F.transform(masks, lambda m: F.col("a").bitwiseXOR(m))).alias("mid"))
    met = stars.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return near.unionByName(stars.join(met, "mid").filter("a <> b").select("b", "a").toDF("a", "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable. Alternating large and small stars."""
    pairs = keep(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v"), "edges")
    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = keep(small, "stars")
        now = tuple(after.agg(F.count("*"), F.sum(F.hash("u", "v")), F.bit_xor(F.xxhash64("u", "v"))).first())
        discard(pairs)
        pairs = after
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pair_limit: int = 48) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = keep(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(classes, pair_limit))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = keep(named.join(smallest, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(by_class, "fp").select(F.col("id").alias(id_col), unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


# Documents that share most of their shingles: links by similarity instead of bits.

#: Golay segments of a long fingerprint; the words of its LONG_BITS bits.
LONG_SEGMENTS, LONG_WORDS = 16, 6
LONG_BITS = 23 * LONG_SEGMENTS
#: Candidates may differ in so many of the first 64 bits. Texts at 0.8 differ in 9.7 (sd 2.9) of them.
NEAR_64 = 24
#: Texts and shingles of a block of a crowd; shingles of a slice of it.
CROWD_BLOCK, CROWD_SHINGLES, SLICE_SHINGLES = 256, 1 << 19, 1 << 20
#: Crowds with more members than this outside their main component are joined through leaders: how many in the first round, and how many rounds.
CROWD_EXACT, LEADERS, ROUNDS = 1024, 32, 4
#: An element that so many pairs of two blocks have in common is counted by a product of matrices, which have so many columns.
DENSE_PAIRS, DENSE_COLUMNS = 1 << 14, 1 << 12


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased (A-Z) words; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    n = min(shingle, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last)], np.uint64))


def _scramble(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash of hashes."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def long_counts(shingles: np.ndarray) -> np.ndarray:
    """For each of 384 bits the shingles that set it minus those that don't."""
    out = np.zeros(64 * LONG_WORDS, np.int64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        words = np.stack([_scramble(part, k) for k in range(LONG_WORDS)], axis=1).astype("<u8")
        out += 2 * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16).astype(np.int64) - len(part)
    return out


class SoftGolay:
    """Decodes segments by how clear their bits are: the nearest codewords in the sense of the counts behind the bits."""

    def __init__(self, best: int = 8):
        code = np.arange(4096) << 11
        code ^= _syndromes(code)
        self.signs = (2 * (code[:, None] >> np.arange(23) & 1) - 1).astype(np.float32).T.copy()
        self.best = best

    def indices(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, correlations) of the best codewords of each row of counts, best first; ties go to the lower index."""
        fit = counts.astype(np.float32) @ self.signs
        rows = np.arange(len(fit))
        index, value = np.zeros((len(fit), self.best), np.int64), np.zeros((len(fit), self.best), np.float32)
        for k in range(self.best):
            index[:, k] = at = fit.argmax(1)
            value[:, k] = fit[rows, at]
            fit[rows, at] = -np.inf
        return index, value

    def keys(self, counts: np.ndarray, segments: int, probes: int) -> np.ndarray:
        """(texts, keys): each run of ``segments`` neighbouring segments gives its ``probes`` best joint codewords."""
        texts = len(counts)
        index, value = (x.reshape(texts, LONG_SEGMENTS, self.best) for x in self.indices(counts[:, :LONG_BITS].reshape(-1, 23)))
        ranks = np.array([r for r in np.ndindex(*[self.best] * segments) if np.prod([x + 1 for x in r]) <= probes])  # no other can be among the best
        out = []
        for first in range(LONG_SEGMENTS):
            run = [(first + k) % LONG_SEGMENTS for k in range(segments)]
            total = sum(value[:, g, ranks[:, k]] for k, g in enumerate(run))
            chosen = ranks[np.argsort(-total, axis=1, kind="stable")[:, :probes]]
            key = np.full((texts, probes), first, np.int64)
            for k, g in enumerate(run):
                key = key << 12 | np.take_along_axis(index[:, g], chosen[:, :, k], axis=1)
            out.append(key)
        return np.concatenate(out, axis=1)


def sketches(rows: DataFrame, shingle: int, segments: int, probes: int) -> DataFrame:
    """(doc_key, id, same, words, keys) of (doc_key, text, id): the digest of the shingle set, the long fingerprint and the Golay keys."""
    names = ["doc_key", "id", "same", "words", "keys"]

    def run(batches):
        golay = SoftGolay(max(2, probes))
        for batch in slices(batches, 1, 1 << 20):
            sets = [shingle_set(t, shingle) for t in text_bytes(batch.column(1))]
            for at in range(0, len(sets), 64):
                part = sets[at : at + 64]
                counts = np.stack([long_counts(x) for x in part])
                words = np.packbits(counts > 0, axis=1, bitorder="little").view("<i8")
                same = [xxhash.xxh3_128_digest(x.tobytes()) for x in part]
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (words, golay.keys(counts, segments, probes))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(same, pa.binary()), *lists], names=names)

    return rows.mapInArrow(run, f"doc_key string, id {dict(rows.dtypes)['id']}, same binary, words array<long>, keys array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches):
        for batch in slices(batches, 1):
            sets = [shingle_set(t, shingle).view(np.int64) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right.

    Elements of many pairs go through products of 0/1 matrices, others pair by pair, so that work is bounded by the number of elements and of pairs of sets."""
    out = np.zeros((len(left), len(right)))
    if not len(left) or not len(right):
        return out
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    at = np.split(at, [len(row[0])])
    count = [np.bincount(x, minlength=len(values)) for x in at]
    pairs = count[0] * count[1]
    dense = pairs > DENSE_PAIRS
    place = np.cumsum(dense) - 1
    picked = [(r[dense[x]], place[x[dense[x]]]) for r, x in zip(row, at)]
    for low in range(0, int(dense.sum()), DENSE_COLUMNS):
        tables = []
        for (r, c), sets in zip(picked, (left, right)):
            here = (c >= low) & (c < low + DENSE_COLUMNS)
            tables.append(np.zeros((len(sets), DENSE_COLUMNS), np.float32))
            tables[-1][r[here], c[here] - low] = 1
        out += tables[0] @ tables[1].T
    a, b = (np.flatnonzero((pairs[x] > 0) & ~dense[x]) for x in at)
    b = b[np.argsort(at[1][b], kind="stable")]
    holders = np.where(dense, 0, np.where(pairs > 0, count[1], 0))
    first = np.cumsum(holders) - holders
    for part in np.split(a, np.searchsorted(np.cumsum(holders[at[0][a]]), np.arange(1 << 22, int(holders[at[0][a]].sum()) + 1, 1 << 22))):
        n = holders[at[0][part]]
        met = b[np.repeat(first[at[0][part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        out += np.bincount(np.repeat(row[0][part], n) * len(right) + row[1][met], minlength=out.size).reshape(out.shape)
    return out


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Places (left, right) of links that join what all links do; what has one root (left, right) is joined already."""
    roots, n = np.concatenate([left, right]), len(left)
    unseen, out = np.ones(len(roots), bool), []
    for start in range(n):
        stack = [start] if unseen[start] else []
        unseen[start] = False
        while stack:
            x = stack.pop()
            kin = np.flatnonzero(unseen & (roots == roots[x]))
            unseen[kin] = False
            met = np.flatnonzero(linked[x] & unseen[n:]) + n if x < n else np.flatnonzero(linked[:, x - n] & unseen[:n])
            unseen[met] = False
            out += [(x, y - n) if x < n else (y, x - n) for y in met.tolist()]
            stack += kin.tolist() + met.tolist()
    return out


def _compared(sent: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """(a, b) of (*by, side, node, root, shingles): in each group links that join what is similar across its sides, or within side 0 where it is alone."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        side, node, root = (rows.column(c).to_numpy() for c in ("side", "node", "root"))
        sets = [x.values.to_numpy() for x in rows.column("shingles")]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        size = np.array([len(s) for s in sets], np.int64)
        common = _common([sets[k] for k in left], [sets[k] for k in right])
        linked = (common > 0) & (common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-9)
        found = _forest(linked, root[left], root[right])
        return pa.table({"a": pa.array(node[left[[x for x, _ in found]]] if found else [], pa.int64()), "b": pa.array(node[right[[y for _, y in found]]] if found else [], pa.int64())})

    return sent.select(*by, "side", "node", "root", "shingles").groupBy(*by).applyInArrow(run, "a long, b long")


def _blocks(which: Column) -> Column:
    """How many blocks a group's members (those for which ``which`` holds) fill."""
    return F.greatest(F.ceil(F.count_if(which) / CROWD_BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.size("shingles"))), F.lit(0)) / CROWD_SHINGLES)).cast("int")


def _with_main(members: DataFrame) -> DataFrame:
    """members with main: whether one belongs to the largest component of its crowd, if that has at least CROWD_BLOCK members."""
    parts = members.groupBy("crowd", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD_BLOCK)
    main = parts.groupBy("crowd").agg(F.max_by("root", F.struct("n", "root")).alias("main_root"))
    return members.join(main, "crowd", "left").withColumn("main", F.coalesce(F.col("root") == F.col("main_root"), F.lit(False))).drop("main_root")


def block_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of (crowd, node, root, main, shingles): links that join every two members of a crowd whose sets are similar and whose roots differ.

    A crowd is cut into blocks; every pair of blocks is compared by a task, which returns no more links than it has members. Of two such members one is
    outside the main component, so blocks of that one do not meet each other."""
    number = members.groupBy("crowd").agg(_blocks(~F.col("main")).alias("others"), _blocks(F.col("main")).alias("mains")).filter("others > 0")
    draw = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    placed = members.join(number, "crowd").withColumn("own", F.when(F.col("main"), F.col("others") + draw(F.col("mains"))).otherwise(draw(F.col("others"))))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1)))
    sent = sent.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    return _compared(sent, ["crowd", "low", "high"], similarity)


def star_links(members: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join leaders (crowd, node) and all members of their crowd that are similar to them. Leaders travel to each block of members."""
    placed = members.join(members.groupBy("crowd").agg(_blocks(F.lit(True)).alias("blocks")), "crowd")
    led = placed.join(leaders, ["crowd", "node"], "left_semi").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    return _compared(led.unionByName(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("side", F.lit(1))), ["crowd", "own"], similarity)


def linkable(members: DataFrame, similarity: float) -> DataFrame:
    """The members (crowd, node, root, shingles) that may be similar to one of another root: so many of their shingles occur in other components of the crowd.

    Two similar sets have the share ``similarity`` of either in common, so no link is lost. A crowd's shingles are dealt by their range into slices of bounded size."""
    number = members.groupBy("crowd").agg(F.ceil(F.sum(F.size("shingles")) / SLICE_SHINGLES).cast("int").alias("slices"))
    columns = "crowd long, slice int, node long, root long, part array<long>"

    def deal(batches):
        for batch in batches:
            for crowd, node, root, slices, held in zip(*(batch.column(c) for c in range(5))):
                values = np.sort(held.values.to_numpy().view(np.uint64))
                n = slices.as_py()
                bounds = np.searchsorted(values, np.array([(k << 64) // n for k in range(1, n)], np.uint64)) if n > 1 else []
                parts = [(k, x.view(np.int64)) for k, x in enumerate(np.split(values, bounds)) if len(x)]
                same = lambda x: [x.as_py()] * len(parts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same(crowd), pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array(same(node), pa.int64()), pa.array(same(root), pa.int64()), pa.array([x for _, x in parts], pa.list_(pa.int64()))],
                    names=["crowd", "slice", "node", "root", "part"],
                )

    def shared(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        parts = rows.column("part").combine_chunks() if isinstance(rows.column("part"), pa.ChunkedArray) else rows.column("part")
        length = parts.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(length)), length)
        values, root = parts.flatten().to_numpy(), rows.column("root").to_numpy()[row]
        order = np.argsort(values, kind="stable")
        values, root, row = values[order], root[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        held = np.repeat(several, np.diff(np.append(first, len(values))))
        return pa.table({"node": rows.column("node"), "common": pa.array(np.bincount(row[held], minlength=len(length)), pa.int64())})

    dealt = members.join(number, "crowd").select("crowd", "node", "root", "slices", "shingles").mapInArrow(deal, columns)
    common = dealt.groupBy("crowd", "slice").applyInArrow(shared, "node long, common long").groupBy("node").agg(F.sum("common").alias("common"))
    enough = (F.col("common") > 0) & (F.col("common") >= F.lit(similarity) * F.size("shingles") - 1e-9)
    return members.join(common, "node").filter(enough).select(*members.columns)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are similar."""
    by = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    met = pairs.join(by("a"), "a").join(by("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return met.filter((F.col("common") > 0) & (F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9)).select("a", "b")


def crowd_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of (crowd, node, shingles): links that join every two members of a crowd whose sets are similar.

    In rounds: members that can have no link out of their component are done (``linkable``: at first those that are alike with others but below the threshold, later
    whole components). Of a crowd that still has more than CROWD_EXACT members outside its main component some LEADERS of them, drawn by hash, are compared
    with all others, which joins near copies of one text in work that follows their number; each round has four times as many leaders. All other
    crowds, and after ROUNDS of them every crowd, are compared in blocks, what is outside the main component against all."""
    out, leads = [], LEADERS
    rest = keep(members.select("crowd", "node", F.col("node").alias("root"), "shingles"), "crowd-members")
    for step in range(ROUNDS + 1):
        rest = keep(_with_main(keep(linkable(rest, similarity), "linkable")), "crowds-left")
        sizes = rest.groupBy("crowd").agg(F.count_if(~F.col("main")).alias("n"))
        # leaders that are many against their crowd save nothing
        large = keep(sizes.filter(F.col("n") > (max(CROWD_EXACT, 4 * leads) if step < ROUNDS else 1 << 62)), "large-crowds")
        out.append(keep(block_links(rest.join(large, "crowd", "left_anti"), similarity), "block-links"))
        rest = keep(rest.join(large, "crowd"), "in-large-crowds")
        if rest.isEmpty():
            break
        # a share of leads / n by hash; the member with the smallest hash leads in any case
        drawn, others = F.xxhash64("node", F.lit(step)), rest.filter(~F.col("main"))
        lowest = others.groupBy("crowd").agg(F.min_by("node", drawn).alias("node"))
        leaders = others.filter(F.pmod(drawn, F.lit(1 << 30)) < F.lit(leads * (1 << 30)) / F.col("n")).select("crowd", "node").unionByName(lowest).distinct()
        rest = rest.drop("n", "main")
        out.append(keep(star_links(rest, keep(leaders, "leaders"), similarity), "star-links"))
        joined = out[-1].unionByName(rest.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = keep(components(joined).withColumnRenamed("root", "new"), "crowd-roots")
        rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        leads *= 4
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, segments: int = 3, probes: int = 8, pair_limit: int = 16) -> DataFrame:
    """(id, doc_key, group) of every row of docs: the row_key of its id and text, and a number that similar rows share.

    Groups are what links of texts with ``similarity`` (common part of all shingles of either) or more join. A text's fingerprint of 368 bits is cut
    into 16 Golay segments; each is decoded to its nearest codewords, judged by how many shingles stand behind each bit, and runs of
    ``segments`` segments give ``probes`` keys each. Texts that share a key and are close in their bits are verified shingle by shingle.
    Two texts at a similarity of 0.8 share one of 16 x 8 keys with probability 0.95, at 0.85 with 0.99, at 0.9 with 0.999; unrelated
    texts with 1.5e-8. (Two segments and four probes: 0.99, 0.999, and 1.5e-5, which is too often for over some 10**6 texts.)
    Keys of more than ``pair_limit`` texts are not paired: texts that such keys join form crowds, all of which is compared (``crowd_links``)."""
    with small_batches(docs.sparkSession), scratch() as last:
        return last(keep(_similar_groups(docs, id_col, text_col, similarity, shingle, segments, probes, pair_limit), "similar-groups"))


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, segments: int, probes: int, pair_limit: int) -> DataFrame:
    key = row_key(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(key.alias("doc_key"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    drawn = keep(sketches(rows, shingle, segments, probes).withColumn("row", F.monotonically_increasing_id()), "sketches")
    place = F.col("row").cast("string")
    # equal sets are one class, which its smallest row stands for
    several = drawn.groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("n")).filter("n > 1")
    several = keep(several.select(F.hex("same").alias("_key"), "node"), "sketch-classes")
    copies = keep(take(drawn.select("row", "same"), F.hex("same"), several).filter("row <> node").select("row", "node"), "sketch-copies")
    nodes = prune(drawn, place, copies.select(place.alias("_key")))

    keyed = nodes.select(F.explode("keys").alias("key"), F.col("row").alias("node"), F.element_at("words", 1).alias("w"))
    sizes = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "_key"), "soft-key-sizes")
    shared = keep(take(keyed, F.col("key"), sizes).drop("_key"), "soft-keys")
    crowded = shared.filter(F.col("n") > pair_limit).select("key", "node")
    crowds = components(crowded.join(crowded.groupBy("key").agg(F.min("node").alias("least")), "key").filter("node <> least").select("node", "least").distinct(), "node", "least")
    crowds = keep(crowds.select("node", F.col("root").alias("crowd")), "crowds")
    few = shared.filter(F.col("n") <= pair_limit).join(crowds, "node", "left")
    side = lambda x: few.select("key", F.col("node").alias(x), F.col("w").alias(f"w{x}"), F.col("crowd").alias(f"c{x}"))
    apart = F.coalesce(F.col("ca") != F.col("cb"), F.lit(True))  # members of one crowd meet there
    close = F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= NEAR_64
    pairs = keep(side("a").join(side("b"), "key").filter((F.col("a") < F.col("b")) & apart & close).select("a", "b").distinct(), "soft-pairs")

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node")).distinct()
    asked = take(nodes.select("row", "doc_key"), place, keep(asked.withColumn("_key", F.col("node").cast("string")), "sketch-wanted"))
    asked = keep(asked.select("node", F.col("doc_key").alias("_key")), "sketch-asked")
    texts = take(rows, F.col("doc_key"), asked.select("_key", "node")).dropDuplicates(["node"])
    sets = keep(_sets(texts.select("node", "text"), shingle), "sketch-sets")
    near = verified(pairs, sets, similarity)
    inside = crowd_links(crowds.join(sets, "node"), similarity)
    joined = near.unionByName(inside).unionByName(copies.select(F.col("row").alias("a"), F.col("node").alias("b")))
    roots = components(joined).filter("node <> root").select(F.col("node").alias("row"), "root")
    return drawn.select("id", "doc_key", "row").join(keep(roots, "sketch-roots"), "row", "left").select("id", "doc_key", F.coalesce("root", "row").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Of each group of similar texts the row with the smallest id; a null id stays only where its group has no other. Of rows that repeat id and text one stays."""
    found = similar_groups(docs, id_col, text_col, similarity, shingle)
    best = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_key")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    members = keep(found.join(best, "group").select(F.col("doc_key").alias("_key"), (F.col("doc_key") == F.col("best.doc_key")).alias("stays")), "sketch-members")
    repeated = members.filter("stays").groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1")
    return prune(docs, row_key(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), members.filter("not stays"), repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_golay": query}
ORACLES: dict[str, str] = {}
