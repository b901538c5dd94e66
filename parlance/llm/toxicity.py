"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input: a token is a run of letters and digits (bytes beyond ASCII included), A-Z lower-cased. The word enters by its hash, its characters by the hashes of all runs of
five and of its beginnings of three to eight. A hash stands for the log odds of either label among the sample's documents that hold it (of the
characters the greatest counts) and for a short trained vector (of the characters the mean). While the network learns, a document's own label is
left out of the odds of what it holds, so words seen once look there as they do in new texts.

Network: two gated recurrent layers read a window of WINDOW tokens from either end, attention weighs their joint states, and a logistic unit judges
the sum. Every window is scored, each overlapping the next by half; a document has the logit of its worst window. In training a document
teaches through the window that is worst so far, harmless documents through another one too; a fifth of the sample is kept
aside to turn logits into probabilities at the labels' own proportions.

Bounds: the network is fitted on at most ``sample`` documents of each label (those with the smallest hash of their id; of these the ones of at most
``longest`` bytes), so it takes 2 x (2**18 + 2**14 x 3) floats (2.5 MB) and the driver some 100 MB whatever the corpus' size. Every document is scored whole.

Defined cases: null counts as empty text; a text without tokens gets the share of label 1 among the labels that may be learned; so does every text if the
sample lacks one of the labels, and without labelled documents every score is 0.5; documents with several labels count once for each, of
documents that share an id the smallest text is fitted; a run of more than TOKEN bytes is several tokens; rows that repeat are scored alike; texts of any length are
read whole, in parts; an empty table gives an empty result; further columns are ignored, names that clash included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import crc_remainder, slices, table, text_bytes

#: Tokens of a window; windows start at every half of it.
WINDOW = 32
HALF = WINDOW // 2
#: Rows of the odds and of the vectors of words and of runs, columns of a vector, states of a direction, units of the attention.
BITS, ROWS, VECTORS, DIMS, STATES, UNITS = 18, 1 << 18, 1 << 14, 3, 8, 8
INPUTS = 2 * (DIMS + 1)
#: Bytes of a run inside a token, and of the beginnings of one.
RUN, BEGINNINGS = 5, (3, 4, 5, 6, 7, 8)
TOKEN = 256
#: Documents that a feature counts as seen in, at the proportions of the labels, before any is read.
SMOOTH = 4.0
#: Blocks of HALF tokens whose inputs are held at once, and windows that are scored at once.
HELD, AT_ONCE = 4096, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD1B54A32D192ED03)
_IN_TOKEN = np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def tokens(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the tokens of lower-cased bytes."""
    inside = np.concatenate([[False], _IN_TOKEN[low], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    parts = -(-(ends - starts) // TOKEN)
    if len(parts) and parts.max() > 1:
        first = np.cumsum(parts) - parts
        starts = np.repeat(starts, parts) + TOKEN * (np.arange(parts.sum()) - np.repeat(first, parts))
        ends = np.minimum(starts + TOKEN, np.repeat(ends, parts))
    return starts, ends


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words, of the runs that start at each of their bytes, and of their beginnings (a row for each token), and the tokens' bytes."""
    at = int(starts[0]) if len(starts) else 0
    part = low[at : int(ends[-1]) if len(ends) else 0].astype(np.uint64) + np.uint64(1)
    powers, back = _powers(len(part), _BASE), _powers(len(part), _BACK)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[:-1], dtype=np.uint64)])
    starts, ends = starts - at, ends - at

    def rows(a, b, salt=0):
        h = (sums[b] - sums[a]) * back[a] + np.uint64(salt)
        return ((h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)

    lengths = ends - starts
    skipped = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    place = np.arange(len(skipped)) + skipped
    runs = rows(place, np.minimum(place + RUN, np.repeat(ends, lengths)))
    beginnings = np.stack([rows(starts, np.minimum(starts + k, ends), 1) for k in BEGINNINGS], axis=1)
    return rows(starts, ends), runs, beginnings, lengths


def _first(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _odds(words: np.ndarray, runs: np.ndarray, word, run, beginnings, lengths) -> np.ndarray:
    """(tokens, 2): log odds of the word and the greatest of its runs and beginnings."""
    if not len(word):
        return np.zeros((0, 2), words.dtype)
    return np.stack([words[word], np.maximum(np.maximum.reduceat(runs[run], _first(lengths)), runs[beginnings].max(1))], axis=1)


def _mean_runs(table: np.ndarray, run, beginnings, lengths) -> np.ndarray:
    """The mean vector of each token's runs and beginnings."""
    if not len(lengths):
        return np.zeros((0, table.shape[1]), table.dtype)
    total = np.add.reduceat(table[run % VECTORS], _first(lengths), axis=0)
    for k in range(len(BEGINNINGS)):
        total += table[beginnings[:, k] % VECTORS]
    return total / (lengths[:, None] + len(BEGINNINGS)).astype(table.dtype)


def new_network(seed: int = 11, dtype=np.float32) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-1])).astype(dtype)
    out = {"in": draw(6 * STATES, INPUTS), "bias": np.zeros(6 * STATES, dtype), "forth": draw(3 * STATES, STATES), "back": draw(3 * STATES, STATES)}
    out |= {"attend": draw(UNITS, 2 * STATES), "weigh": draw(UNITS), "judge": draw(2 * STATES), "level": np.zeros(1, dtype)}
    out |= {name: (r.standard_normal((VECTORS, DIMS)) * 0.1).astype(dtype) for name in ("words", "runs")}
    out["bias"][:STATES] = out["bias"][3 * STATES : 4 * STATES] = -1  # states change slowly at first
    return out


def _scan(gates, mask: np.ndarray, u: np.ndarray, order, trace: list | None = None) -> np.ndarray:
    """States (time, state, window) of one direction; padding leaves a state as it is."""
    n = STATES
    h = np.zeros((n, mask.shape[1]), u.dtype)
    out = np.empty((len(mask), *h.shape), u.dtype)
    for t in order:
        g, a = gates(t), u @ h
        zr = 0.5 * np.tanh(0.5 * (g[: 2 * n] + a[: 2 * n])) + u.dtype.type(0.5)
        c = np.tanh(g[2 * n :] + zr[n:] * a[2 * n :])
        if trace is not None:
            trace.append((t, h, zr, c, a[2 * n :]))
        h = h + zr[:n] * mask[t] * (c - h)
        out[t] = h
    return out


def forward(net: dict, gates, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows. gates(t): (6 x STATES, windows) at a time; mask: (time, windows)."""
    n, steps = 3 * STATES, range(len(mask))
    traces = ([], []) if trace is not None else (None, None)
    forth = _scan(lambda t: gates(t)[:n], mask, net["forth"], steps, traces[0])
    back = _scan(lambda t: gates(t)[n:], mask, net["back"], steps[::-1], traces[1])
    states = np.concatenate([forth, back], axis=1)
    units = np.tanh(net["attend"] @ states)
    score = net["weigh"] @ units
    weight = np.exp(score - score.max(0)) * mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tn,tsn->sn", weight, states)
    if trace is not None:
        trace |= {"scans": traces, "states": states, "units": units, "weight": weight, "pooled": pooled}
    return net["judge"] @ pooled + net["level"]


def backward(net: dict, mask: np.ndarray, trace: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters behind the gates, and of the gates (time, 6 x STATES, windows); slope: of the logits."""
    states, units, weight, n = trace["states"], trace["units"], trace["weight"], STATES
    grad = {"judge": trace["pooled"] @ slope, "level": slope.sum(keepdims=True)}
    pooled = net["judge"][:, None] * slope
    by_weight = np.einsum("sn,tsn->tn", pooled, states)
    d_states = weight[:, None, :] * pooled
    score = weight * (by_weight - (weight * by_weight).sum(0))
    grad["weigh"] = np.einsum("tn,tun->u", score, units)
    d_units = net["weigh"][None, :, None] * score[:, None, :] * (1 - units**2)
    grad["attend"] = np.einsum("tun,tsn->us", d_units, states)
    d_states = d_states + net["attend"].T @ d_units
    gates = np.empty((len(mask), 6 * n, mask.shape[1]), states.dtype)
    for k, (name, scan) in enumerate(zip(("forth", "back"), trace["scans"])):
        u, dh, du = net[name], np.zeros_like(states[0, :n]), 0
        for t, h, zr, c, a in reversed(scan):
            dh = dh + d_states[t, k * n : k * n + n]
            z = zr[:n] * mask[t]
            dc = dh * z * (1 - c**2)
            d_gate = np.concatenate([dh * (c - h) * mask[t], dc * a]) * zr * (1 - zr)
            gates[t, 3 * k * n : 3 * (k + 1) * n] = np.concatenate([d_gate, dc])
            da = np.concatenate([d_gate, dc * zr[n:]])
            du = du + da @ h.T
            dh = dh * (1 - z) + u.T @ da
        grad[name] = du
    return grad, gates


class _Adam:
    def __init__(self, params: dict, rates: dict):
        self.params, self.rates, self.k = params, rates, 0
        self.m, self.v = ({p: np.zeros_like(x) for p, x in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.k += 1
        for p, g in grads.items():
            m, v = self.m[p], self.v[p]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.params[p] -= self.rates.get(p, self.rates[""]) * (m / (1 - 0.9**self.k)) / (np.sqrt(v / (1 - 0.99**self.k)) + 1e-7)


class Texts:
    """Tokens of some texts laid out in blocks of HALF tokens: at least two a text, the rest of the last one is padding."""

    def __init__(self, texts: list[bytes]):
        self.low = np.frombuffer(b" ".join(texts).lower(), np.uint8)
        self.starts, self.ends = tokens(self.low)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        first = np.searchsorted(self.starts, edges)
        self.count = np.diff(first)
        self.blocks = np.maximum(2, -(-self.count // HALF))
        self.block = np.cumsum(self.blocks) - self.blocks
        #: place of each token, as the block's number times HALF and its place there
        self.place = np.arange(len(self.starts)) - np.repeat(first[:-1], self.count) + np.repeat(self.block, self.count) * HALF
        #: what the tokens' odds are in training
        self.odds: np.ndarray | None = None

    def inputs(self, net: dict, a: int, b: int) -> np.ndarray:
        """What the network sees of the tokens from a to b."""
        word, *chars = features(self.low, self.starts[a:b], self.ends[a:b])
        odds = _odds(net["word odds"], net["run odds"], word, *chars) if self.odds is None else self.odds[a:b]
        return np.concatenate([odds, net["words"][word % VECTORS], _mean_runs(net["runs"], *chars)], axis=1)

    def gates(self, net: dict, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the gates (HALF, 6 x STATES, blocks) and mask (HALF, blocks) of the blocks from low to high."""
        a, b = np.searchsorted(self.place, (low * HALF, high * HALF))
        x = self.inputs(net, a, b)
        at, k = np.divmod(self.place[a:b] - low * HALF, HALF)
        out = np.zeros((HALF, 6 * STATES, high - low), x.dtype)
        mask = np.zeros((HALF, high - low), x.dtype)
        out[k, :, at] = x @ net["in"].T + net["bias"]
        mask[k, at] = 1
        return out, mask

    def logits(self, net: dict) -> np.ndarray:
        """The logit of each window: of each block with the next one, the last of a text excepted."""
        total = int(self.blocks.sum())
        found = np.full(total, -np.inf)
        for low in range(0, total - 1, HELD):
            high = min(total, low + HELD + 1)
            gates, mask = self.gates(net, low, high)
            for at in range(0, high - low - 1, AT_ONCE):
                n = min(AT_ONCE, high - low - 1 - at)
                both = np.concatenate([mask[:, at : at + n], mask[:, at + 1 : at + n + 1]])
                found[low + at : low + at + n] = forward(net, lambda t: gates[t % HALF][:, at + t // HALF : at + t // HALF + n], both)
        found[self.block + self.blocks - 1] = -np.inf
        return found

    def worst(self, net: dict) -> tuple[np.ndarray, np.ndarray]:
        """The greatest logit of each text and the block in which its window starts."""
        found = self.logits(net)
        best = np.maximum.reduceat(found, self.block) if len(self.block) else found
        return best, np.array([b + int(found[b : b + k].argmax()) for b, k in zip(self.block, self.blocks)], np.int64)


def log_odds(held: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of each row, as they are and without one document of label 0 or 1 that holds it. held: distinct document x ROWS + row."""
    size = np.bincount(labels, minlength=2) / len(labels)
    seen = [np.bincount(held[labels[held // ROWS] == k] % ROWS, minlength=ROWS) + SMOOTH * size[k] for k in (0, 1)]
    log = lambda less: np.log(np.maximum(seen[1] - (less == 1), SMOOTH * size[1]) / size[1]) - np.log(np.maximum(seen[0] - (less == 0), SMOOTH * size[0]) / size[0])
    return tuple(log(less).astype(np.float32) for less in (None, 0, 1))


def train(texts: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """Network, vectors and odds fitted to texts of two labels."""
    laid, rng, net = Texts(texts), np.random.default_rng(seed), new_network(seed)
    word, run, beginnings, lengths = features(laid.low, laid.starts, laid.ends)
    edge, doc = _first(lengths), np.repeat(np.arange(len(labels)), laid.count)
    chars = np.concatenate([np.repeat(doc, lengths) * ROWS + run, (doc[:, None] * ROWS + beginnings).ravel()])
    by_word, by_run = log_odds(np.unique(doc * ROWS + word), labels), log_odds(np.unique(chars), labels)
    net |= {"word odds": by_word[0], "run odds": by_run[0]}
    less = [_odds(by_word[1 + k], by_run[1 + k], word, run, beginnings, lengths) for k in (0, 1)]
    laid.odds = np.where(labels[doc][:, None] == 1, less[1], less[0])
    fitted = {k: x for k, x in net.items() if not k.endswith(" odds")}
    optimiser = _Adam(fitted, {"": rate, "words": rate / 2, "runs": rate / 2})
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    # before anything is trained the worst window is the one with the highest odds
    mass = np.zeros(int(laid.blocks.sum()))
    np.add.at(mass, laid.place // HALF, np.maximum(0, laid.odds).sum(1) ** 2)
    first = np.append(mass[1:], 0) + mass
    first[laid.block + laid.blocks - 1] = -1
    at = np.array([b + int(first[b : b + k].argmax()) for b, k in zip(laid.block, laid.blocks)], np.int64)
    clean, done = np.flatnonzero(labels == 0), 0
    while done < steps:
        at = laid.worst(net)[1] if done else at
        chosen = np.concatenate([at, laid.block[clean] + rng.integers(0, laid.blocks[clean] - 1)])
        target = np.concatenate([labels, np.zeros(len(clean))])
        worth = np.concatenate([weight, weight[clean] / 2])
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            _learn(net, optimiser, laid, (word, run, beginnings, lengths, edge), chosen[pick], target[pick], worth[pick])
            done += 1
    return net


def _learn(net, optimiser, laid, rows, blocks, target, worth) -> None:
    """One step down the gradient for the windows that start at some blocks."""
    first, end = np.searchsorted(laid.place, (blocks * HALF, blocks * HALF + WINDOW))
    window = np.repeat(np.arange(len(blocks)), end - first)
    token = np.arange(len(window)) - _first(end - first)[window] + first[window]
    if not len(token):
        return
    step = laid.place[token] - blocks[window] * HALF
    word, run, beginnings, lengths, edge = rows
    word, beginnings, lengths = word[token], beginnings[token], lengths[token]
    run = run[np.arange(lengths.sum()) + np.repeat(edge[token] - _first(lengths), lengths)]
    x = np.concatenate([laid.odds[token], net["words"][word % VECTORS], _mean_runs(net["runs"], run, beginnings, lengths)], axis=1)
    gates = np.zeros((WINDOW, 6 * STATES, len(blocks)), x.dtype)
    mask = np.zeros((WINDOW, len(blocks)), x.dtype)
    gates[step, :, window] = x @ net["in"].T + net["bias"]
    mask[step, window] = 1
    trace: dict = {}
    logit = forward(net, gates.__getitem__, mask, trace)
    slope = ((1 / (1 + np.exp(-logit)) - target) * worth / len(blocks)).astype(x.dtype)
    grad, d_gates = backward(net, mask, trace, slope)
    d = d_gates[step, :, window]
    grad |= {"in": d.T @ x, "bias": d.sum(0)}
    dx = (d @ net["in"])[:, 2:]
    each = dx[:, DIMS:] / (lengths[:, None] + len(BEGINNINGS))
    add = lambda rows, values: np.stack([np.bincount(rows % VECTORS, values[:, k], VECTORS) for k in range(DIMS)], axis=1).astype(np.float32)
    grad["words"] = add(word, dx[:, :DIMS])
    grad["runs"] = add(np.concatenate([run, beginnings.ravel()]), np.concatenate([np.repeat(each, lengths, axis=0), np.repeat(each, len(BEGINNINGS), axis=0)]))
    optimiser.step(grad)


def calibrate(logits: np.ndarray, labels: np.ndarray, share: float, steps: int = 50) -> tuple[float, float]:
    """(slope, level) of the logistic curve from logits to probabilities at a share of label 1; targets are drawn in as if either label had been seen once more."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    worth = np.where(labels == 1, share / max(1, n1), (1 - share) / max(1, n0)) * len(labels)
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ at))
        curve = (x * (worth * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, x.T @ (worth * (p - target)) + 1e-3 * (at - [1, 0])), -1, 1)
    return float(max(at[0], 1e-3)), float(at[1])


def fit(texts: list[bytes], labels: np.ndarray, share: float, **options) -> dict:
    """A model of texts with labels 0 and 1; ``share`` is that of label 1 among all labels."""
    if not len(labels) or not 0 < labels.mean() < 1:
        return {"share": share}
    # a fifth of either label is kept aside
    aside = np.zeros(len(labels), bool)
    for k in (0, 1):
        aside[np.flatnonzero(labels == k)[4::5]] = True
    pick = lambda keep: [t for t, k in zip(texts, keep) if k]
    net = train(pick(~aside), labels[~aside], **options)
    judged = aside if len(set(labels[aside])) == 2 else ~aside
    slope, level = calibrate(Texts(pick(judged)).worst(net)[0], labels[judged], share)
    return {"share": share, "net": net, "slope": slope, "level": level}


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probabilities of label 1, to six decimals."""
    if "net" not in model or not texts:
        return np.full(len(texts), round(model["share"], 6))
    laid = Texts(texts)
    x = np.clip(model["slope"] * laid.worst(model["net"])[0] + model["level"], -50, 50)
    return np.round(np.where(laid.count > 0, 1 / (1 + np.exp(-x)), model["share"]), 6)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int, sample: int, longest: int) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of the sample, and the share of label 1 among all labels outside the held-out fold."""
    able = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_remainder(F.col(id_col), modulus) != held)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    share = able.agg(F.avg("label")).first()[0]
    one = [able.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    chosen = rows.join(F.broadcast(one[0].unionByName(one[1])), F.col("doc") == F.col("id"))  # at most 2 x ``sample`` ids
    got = chosen.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id", "label").select("label", "text").toArrow()
    return list(text_bytes(got.column("text").combine_chunks())) if got.num_rows else [], got.column("label").to_numpy().astype(np.int64), 0.5 if share is None else float(share)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, held: int = 1, threshold: float = 0.7,
    sample: int = 1500, longest: int = 16_384, steps: int = 400,
) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample_of(docs, labels, id_col, text_col, label_col, modulus, held, sample, longest), steps=steps))

    def run(batches):
        for batch in slices(batches, 2, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(model.value, list(text_bytes(batch.column(2)))), pa.float64())], names=["id", "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (crc_remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_gated_toxicity": query}
ORACLES: dict[str, str] = {}
