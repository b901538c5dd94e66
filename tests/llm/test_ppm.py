import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import ppm as op
from parlance.llm.common import slices, text_bytes
from tests.llm.cases import ROWS, documents


def remainder(i, m=7):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


class Slow:
    """The model written with dictionaries, symbol by symbol."""

    def __init__(self, texts, order, least=1):
        self.order = order
        full = defaultdict(Counter)
        for t in texts:
            s = [256] * order + list(t) + [256]
            for i in range(order, len(s)):
                for d in range(order + 1):
                    full[tuple(s[i - d : i])][s[i]] += 1
        self.whole = {c: sum(v.values()) for c, v in full.items()}
        kept = {c: {s: n for s, n in v.items() if n >= least} for c, v in full.items()}
        self.counts = {c: v for c, v in kept.items() if v}

    def symbol(self, context, s):
        excluded, p, d = {}, 0.0, self.order
        while d >= 0:
            c = context[len(context) - d :]
            seen = self.counts.get(c)
            if seen is not None:
                left = {x: n for x, n in seen.items() if x not in excluded}
                pruned = max(0, self.whole[c] - sum(seen.values()))
                escape = len(left) / 2 + pruned
                total = sum(left.values()) - len(left) / 2 + escape
                if s in left:
                    return p + math.log10((left[s] - 0.5) / total)
                if total:
                    p += math.log10(escape / total)
                excluded = seen
            d -= 1
        return p - math.log10(max(1, 257 - len(self.counts.get((), {}))))

    def score(self, text):
        s = [256] * self.order + list(text) + [256]
        return sum(self.symbol(tuple(s[i - self.order : i]), s[i]) for i in range(self.order, len(s)))


def key_of(context, symbol):
    key = 0
    for x in (*context, symbol):
        key = key << op.BITS | x
    return key


def test_probabilities_sum_to_one(spark):
    """Prices of all 257 symbols in contexts that are known whole, in part or not at all."""
    texts = [b"abracadabra", b"banana", b"abc"]
    grams = Counter()
    for symbols, scored, _ in op.pieces(texts, 3):
        grams.update(op.keys_of(symbols, 3)[scored].tolist())
    trained = spark.createDataFrame(list(grams.items()), "gram long, n long")
    contexts = [b"abr", b"ana", b"zzz", b"raz"]
    every = [key_of(c, s) for c in contexts for s in range(257)]
    unseen = spark.createDataFrame([(k,) for k in every if k not in grams], "gram long")
    priced = op.seen_prices(trained).select("gram", "price").unionByName(op.unseen_prices(unseen, trained, 3)).filter(op.F.col("gram").isin(every)).collect()
    price = {r.gram: r.price for r in priced}
    for c in contexts:
        assert sum(10 ** price[key_of(c, s)] for s in range(257)) == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("chunk", [op.CHUNK, 7])
def test_pieces_cover_every_symbol_once(chunk):
    texts = [b"", b"abc", b"x" * 14, b"long text " * 9]
    seen = Counter()
    for symbols, scored, row in op.pieces(texts, 3, chunk):
        seen.update(zip(row[scored].tolist(), op.keys_of(symbols, 3)[scored].tolist()))
    want = Counter()
    for row, t in enumerate(texts):
        s = [256] * 3 + list(t) + [256]
        want.update((row, key_of(s[i - 3 : i], s[i])) for i in range(3, len(s)))
    assert seen == want


def test_memory_follows_bytes_not_rows():
    """A task's peak is the same for batches of 2,000 and of 20,000 rows whose grams and words are all rare."""
    rng = random.Random(1)
    peaks = []
    for size in (2_000, 20_000):
        texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(120)).encode() for _ in range(size)]
        batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], names=["text"])
        model = op.Common(np.zeros(0, np.int64), np.zeros(0, np.float32), [], [])
        tracemalloc.start()
        for part in slices([batch], 0):
            low = list(text_bytes(part.column(0)))
            model.grams(low, 5)
            [model.words(t) for t in low]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] < 200 << 20


@pytest.mark.parametrize("head_bits", [17, 2])
def test_rows(spark, head_bits):
    rows = ROWS + [(300 + k, f"some words {k % 5} of text number {k} é", "en", "s", 1) for k in range(60)]
    out = op.score(documents(spark, rows), order=3, head_bits=head_bits).collect()
    low = lambda t: (t or "").encode().lower()
    train = [low(t) for i, t, *_ in rows if remainder(i) != 2]
    counts = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    slow = Slow(train, 3)
    want = {}
    for i, t, *_ in rows:
        tokens = [*low(t).split(), None]
        want[i, len(tokens), t] = (remainder(i) == 2, sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    assert len(out) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault((i, len(low(t).split()) + 1), t)
    for r in out:
        t = texts[r.doc_id, r.n_tokens]
        held, known, base = want[r.doc_id, r.n_tokens, t]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(t or "") < 1000:
            assert r.score == pytest.approx(slow.score(low(t)), rel=1e-4)
    assert op.score(documents(spark, [])).collect() == []


def test_beats_the_base_on_held_out_text(spark):
    rows = op.query(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("gram_bits", [21, 4, 0])
def test_rare_contexts_are_not_dropped(spark, gram_bits):
    """Nearly all grams are looked up by the join; scores equal the dictionaries of the whole model."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(40))), "en", "s", 1) for k in range(150)]
    rows += [(200 + k, f"é {k} zq" * (k % 3), "en", "s", 1) for k in range(40)] + [(None, "only", "en", "s", 1)]
    out = op.score(documents(spark, rows), order=3, gram_bits=gram_bits).collect()
    slow = Slow([t.encode() for i, t, *_ in rows if remainder(i) != 2], 3)
    want = {i: slow.score(t.encode()) for i, t, *_ in rows}
    assert len(out) == len(rows) and sum(r.held_out for r in out) > 15
    assert [r.score for r in out] == pytest.approx([want[r.doc_id] for r in out], abs=1e-6)


def test_no_training_rows(spark):
    held = [(k, "ab", "en", "s", 1) for k in range(60) if remainder(k) == 2]
    assert [r.score for r in op.score(documents(spark, held)).collect()] == pytest.approx([-3 * math.log10(257)] * len(held))
