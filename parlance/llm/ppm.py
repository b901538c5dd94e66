"""Language-model scoring by prediction by partial matching over bytes.

Model: for every context of up to ``order`` bytes (a document starts in a context of boundary symbols and ends with one) the
counts of the symbols that followed it in the training texts. A symbol is predicted in its longest known
context; if it was not seen there, an escape (method D: half a count from each symbol seen) leads to the context one byte shorter, in which the symbols of the longer one are excluded,
down to a uniform choice of what is left. The score of a text is the sum of log10 probabilities of its symbols,
lower-cased A-Z. Nothing is pruned. A symbol's probability depends only on its gram, the symbol with its longest context, and the model does not
change while scoring, so every gram is priced once: c - 1/2 of its context's count if it was seen in training, else by the
escapes, which need only the tables of the contexts that unseen grams have.

Bounds: the most frequent grams (at most 2**``gram_bits``, 24 MB) and words (at most 2**``head_bits``) are sent to the tasks; all others
are counted by row and looked up by a shuffled join. A task works on slices of 2 MB of text (or one longer text) and on pieces of half a
million symbols; a text of any length is scored whole.

Defined cases: null text is empty (one end token, one boundary symbol); null ids have remainder crc32('') and are
training rows or not like others; rows that repeat are trained and scored each; with no training rows every symbol
and word is unknown; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import crc_remainder, keep, slices, table, text_bytes

EDGE, BITS = 256, 9  # the boundary symbol; bits of a symbol in a key
CHUNK = 1 << 19
HEAD_BITS, GRAM_BITS = 17, 21
#: What each symbol seen in a context gives up for the escape.
DISCOUNT = 0.5
#: Distinct keys a task holds before it hands them on.
FLUSH = 1_500_000


def pieces(texts: list[bytes], order: int, chunk: int = CHUNK):
    """(symbols, scored, row): runs of at most about ``chunk`` symbols; each piece of a text brings ``order`` symbols of context."""
    parts, rows, size = [], [], 0

    def block():
        symbols = np.concatenate(parts)
        scored = np.ones(len(symbols), bool)
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        for k in range(order):
            scored[starts + k] = False
        return symbols, scored, np.repeat(np.array(rows), lengths)

    for row, text in enumerate(texts):
        body = np.frombuffer(text, np.uint8)
        for at in range(0, len(body) + 1, chunk):
            end = min(at + chunk, len(body))
            front = body[max(0, at - order) : at].astype(np.int64)
            part = np.concatenate([np.full(order - len(front), EDGE), front, body[at:end], *[[EDGE]] * (end == len(body) and at + chunk > len(body))]).astype(np.int64)
            parts.append(part)
            rows.append(row)
            size += len(part)
            if size >= chunk:
                yield block()
                parts, rows, size = [], [], 0
    if parts:
        yield block()


def keys_of(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each position the symbol and the ``order`` symbols before it in one integer, the latest lowest."""
    key = symbols.copy()
    for j in range(1, order + 1):
        key[j:] |= symbols[:-j] << (BITS * j)
    return key


def gather(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """(word, gram, n): counts of words (gram null) and of top-order keys (word null), summed over all rows."""
    names = ["word", "gram", "n"]

    def run(batches):
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            keys = np.concatenate([k for k, _ in grams])
            counts = np.concatenate([c for _, c in grams])
            distinct, inverse = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(inverse, weights=counts).astype(np.int64)

        def out_words():
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=names)
            words.clear()

        def out_grams():
            keys, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(counts)], names=names)
            grams.clear()

        for batch in slices(batches, 0):
            texts = [t.lower() for t in text_bytes(batch.column(0))]
            for t in texts:
                words.update(t.split())
                if len(words) > FLUSH // 4:
                    yield from out_words()
            for symbols, scored, _ in pieces(texts, order):
                key, count = np.unique(keys_of(symbols, order)[scored], return_counts=True)
                grams.append((key, count))
                held += len(key)
                if held > FLUSH:
                    grams[:] = [merged()]
                    held = len(grams[0][0])
                    if held > FLUSH // 2:
                        yield from out_grams()
                        held = 0
        if words:
            yield from out_words()
        if grams:
            yield from out_grams()

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, gram long, n long")
    return rows.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _low(key: str, symbols: int) -> Column:
    """The last ``symbols`` symbols of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))


def seen_prices(grams: DataFrame) -> DataFrame:
    """(gram, n, price): log10 probability of each gram of the training texts."""
    whole = F.sum("n").over(Window.partitionBy(F.shiftright("gram", BITS)))
    return grams.select("gram", "n", (F.log10(F.col("n") - DISCOUNT) - F.log10(whole)).alias("price"))


def unseen_prices(unseen: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(gram, price) of grams that are not in the training texts, by escapes to shorter contexts.

    Of a context of d symbols, w{d} is its count, k{d} the number of its symbols, and v{d} what these have in the context one symbol
    shorter, where they are excluded: w{d-1} - v{d} is what a symbol has to be drawn from there. n{d} is the count of the gram's own symbol."""
    bounded = lambda df, symbols: F.broadcast(df) if symbols <= 2 else df  # noqa: E731  # 257 ** 2 rows at most
    levels = {order: grams.select(F.col("gram").alias("key"), "n")}
    for d in range(order - 1, -1, -1):
        levels[d] = keep(levels[d + 1].groupBy(_low("key", d + 1).alias("key")).agg(F.sum("n").alias("n")), "ppm-level")
    root = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("w0"), F.count("*").alias("k0")).first()
    wide = unseen.select("gram", F.lit(root.w0).alias("w0"), F.lit(root.k0).alias("k0"))
    for d in range(order + 1):
        own = levels[d].select(F.col("key").alias(f"key{d}"), F.col("n").alias(f"n{d}"))
        wide = wide.withColumn(f"key{d}", _low("gram", d + 1)).join(bounded(own, d + 1), f"key{d}", "left")
        if d:
            asked = unseen.select(F.shiftright(_low("gram", d + 1), BITS).alias("context")).distinct()
            theirs = levels[d].withColumn("context", F.shiftright("key", BITS)).join(bounded(asked, d), "context", "left_semi")
            shorter = levels[d - 1].select(F.col("key").alias("_low"), F.col("n").alias("v"))
            sums = theirs.withColumn("_low", _low("key", d)).join(bounded(shorter, d), "_low").groupBy("context").agg(F.sum("n").alias(f"w{d}"), F.count("*").alias(f"k{d}"), F.sum("v").alias(f"v{d}"))
            wide = wide.withColumn("context", F.shiftright(f"key{d}", BITS)).join(bounded(sums, d), "context", "left").drop("context")
        wide = keep(wide.drop(f"key{d}"), "ppm-unseen")

    price = F.lit(-math.log10(max(1, EDGE + 1 - root.k0)))
    log = lambda x: F.log10(F.greatest(x, F.lit(1e-300)))
    for d in range(order + 1):  # the price at this level, if all longer contexts lack the symbol
        n, w, k = (F.col(f"{x}{d}") for x in "nwk")
        first = F.when(n.isNotNull(), log(n - DISCOUNT) - log(w)).when(w > 0, log(DISCOUNT * k) - log(w) + price).otherwise(price)
        if d < order:
            left = w - F.col(f"v{d + 1}")
            after = F.when(n.isNotNull(), log(n - DISCOUNT) - log(left)).when(left > 0, log(DISCOUNT * (k - F.col(f"k{d + 1}"))) - log(left) + price).otherwise(price)
            first = F.when(F.col(f"w{d + 1}") > 0, after).otherwise(first)
        wide = wide.withColumn(f"price{d}", first)
        price = F.col(f"price{d}")
    return wide.select("gram", price.alias("price"))


def _most_frequent(counts: DataFrame, count_col: str, bits: int) -> int:
    """The smallest power of two such that at most 2**bits rows have a count of at least that."""
    sizes = {r.p: r.n for r in counts.groupBy(F.floor(F.log2(count_col)).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    power, rows = 63, 0
    while power and rows + sizes.get(power - 1, 0) <= 1 << bits:
        power -= 1
        rows += sizes.get(power, 0)
    return 1 << power


class Common:
    """The broadcast part of the tables, as a task uses it: prices of common grams and logarithms of common words."""

    def __init__(self, keys: np.ndarray, prices: np.ndarray, words: list[bytes], counts: list[int]):
        self.keys, self.prices = keys, prices  # by key
        self.logs = {w: math.log10(c + 1) for w, c in zip(words, counts)}

    def grams(self, texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sum over each text's symbols whose gram is common; and (row, gram, tf) of the others, ordered by row."""
        total, rest = np.zeros(len(texts)), [[], [], []]
        for symbols, scored, row in pieces(texts, order):
            keys, row = keys_of(symbols, order)[scored], row[scored]
            by = np.argsort(keys)
            keys, row = keys[by], row[by]
            at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            total += np.bincount(row[hit], weights=self.prices[at[hit]], minlength=len(texts))
            keys, row = keys[~hit], row[~hit]
            by = np.argsort(row, kind="stable")
            keys, row = keys[by], row[by]
            first = np.nonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))[0]
            for kind, part in zip(rest, (row[first], keys[first], np.diff(first, append=len(keys)))):
                kind.append(part)
        return total, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in rest]

    def words(self, text: bytes) -> tuple[int, int, float, list[bytes], list[int]]:
        """Tokens without the end, known ones, the sum of their logarithms, and the other words with their numbers."""
        split = text.split()
        known, part, rest, tfs = 0, 0.0, [], []
        for w, k in Counter(split).items():
            if (x := self.logs.get(w)) is not None:
                known += k
                part += k * x
            else:
                rest.append(w), tfs.append(k)
        return len(split), known, part, rest, tfs


def _lists(rows: np.ndarray, values: list, kind: pa.DataType, size: int) -> pa.Array:
    """Flat values, ordered by row, as one list for each of ``size`` rows."""
    fields = list(kind.value_type)
    flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))]), pa.int32()), flat, type=kind)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = 5, gram_bits: int = GRAM_BITS, head_bits: int = HEAD_BITS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), (crc_remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = keep(gather(rows.filter("not held_out").select("text"), "text", order), "ppm-counts")
    grams = keep(seen_prices(counts.filter("gram is not null").select("gram", "n")), "ppm-prices")
    texts = int(grams.agg(F.coalesce(F.sum(F.when(F.col("gram") % (1 << BITS) == EDGE, F.col("n"))), F.lit(0))).first()[0])
    common = _most_frequent(grams, "n", gram_bits)
    gram_rows = grams.filter(F.col("n") >= common).select("gram", "price").orderBy("gram").toArrow()  # at most 2**gram_bits grams
    words = counts.filter("word is not null").select("word", F.col("n").alias("c"))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]) + texts, int(sums[1]) + (texts > 0)  # every training text has one end token
    share = _most_frequent(words, "c", head_bits)
    head_rows = words.filter(F.col("c") >= share).toArrow()  # at most 2**head_bits words
    shared = context.broadcast((gram_rows.column(0).to_numpy(), gram_rows.column(1).to_numpy().astype(np.float32), head_rows.column(0).to_pylist(), head_rows.column(1).to_pylist()))
    below = math.log10(n + v + 1)
    end_known, end_part = int(texts > 0), math.log10(texts + 1)
    rest_type = pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int32())]))
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def run(batches):
        model = Common(*shared.value)
        for batch in slices(batches, 2):
            low = [t.lower() for t in text_bytes(batch.column(2))]
            tokens, known, base, at, tail, tfs = [], [], [], [], [], []
            for k, t in enumerate(low):
                size, seen, part, more, many = model.words(t)
                tokens.append(size + 1), known.append(seen + end_known), base.append(part + end_part)
                at += [k] * len(more)
                tail += more
                tfs += many
            total, (row, keys, times) = model.grams(low, order)
            rest = _lists(row, [keys, times.astype(np.int32)], rest_type, len(low))
            tails = _lists(np.array(at, np.int64), [tail, tfs], tail_type, len(low))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total), rest, tails], names=["id", "held_out", "n_tokens", "known", "base", "score", "rest", "tail"])

    kind = dict(docs.dtypes)[id_col]
    layout = f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<gram long, tf int>>, tail array<struct<word binary, tf int>>"
    scored = keep(rows.mapInArrow(run, layout).withColumn("row", F.monotonically_increasing_id()), "ppm-scores")
    tails = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    rare = words.filter(F.col("c") < share)
    found = tails.join(rare, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("part"))
    lacking = scored.select("row", "held_out", F.explode("rest").alias("r")).select("row", "held_out", "r.gram", "r.tf")
    uncommon = grams.filter(F.col("n") < common).select("gram", "price")
    # grams of training rows are all known
    unseen = keep(lacking.filter("held_out").select("gram").distinct().join(uncommon, "gram", "left_anti"), "ppm-unseen-grams")
    every = uncommon.unionByName(unseen_prices(unseen, grams.select("gram", "n"), order))
    added = lacking.join(every, "gram").groupBy("row").agg(F.sum(F.col("tf") * F.col("price")).alias("added"))
    return scored.drop("tail", "rest").join(found, "row", "left").join(added, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ppm_score": query}
ORACLES: dict[str, str] = {}
