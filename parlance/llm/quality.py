"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its words and word pairs and, fewer, 4-grams of character classes and six measures of its shape (repeated words, lines and
pairs, runs, word and text length), all hashed into a fixed number of columns. A bounded sample of labelled documents spans the
latent space (randomised truncated SVD of their tf-idf rows) and is broadcast as unit vectors. Each
document is projected and compared with every labelled vector in blocks, exactly; the ``neighbours`` closest vote with
their similarity raised to ``sharpness`` as weight. Of labelled vectors that are equally close those of the sample's earlier documents vote.

Bounds: at most ``sample`` labelled documents are fitted (those with the smallest hash of their id), so the model takes
sample x dims + columns x dims floats (2048 x 64 + 16384 x 64: 4.7 MB) whatever the corpus' size.

Defined cases: null counts as empty text; a text without any feature gets the share of label 1 in the sample; without
labelled documents every score is 0.5; documents with several labels count once for each, of documents that share an id the smallest text is
fitted; rows that repeat are scored alike; texts of any length are read whole; an empty table gives an empty result; further columns are ignored, names that clash included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import crc_remainder, slices, table, text_bytes

#: First columns of words, word pairs, character classes and shape measures, and the end.
WORDS, PAIRS, CLASSES, SHAPE, COLUMNS = 0, 8192, 12288, 16288, 16384
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, white space, and punctuation marks each for itself."""
    out = np.zeros(256, np.int64)
    marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    out[list(marks)] = np.arange(8, 8 + len(marks))
    out[ord("a") : ord("z") + 1] = out[128:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[32, 9]] = 4
    out[[10, 11, 12, 13]] = 5
    return out


_CLASS = _classes()


class _Hashes(dict):
    """Word to 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _damped(counts: np.ndarray) -> np.ndarray:
    """Counts per thousand on a logarithmic scale."""
    total = counts.sum()
    return np.log1p(counts * (1000 / total)) if total else counts


def features(text: bytes, shape: bool = True) -> np.ndarray:
    """Damped counts of a text's terms, of length COLUMNS; without ``shape`` those of the six measures are left out."""
    out = np.zeros(COLUMNS)
    words, lines = text.lower().split(), [x for x in text.split(b"\n") if x.strip()]
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out[WORDS:PAIRS] = _damped(np.bincount((h % np.uint64(PAIRS - WORDS)).astype(np.int64), minlength=PAIRS - WORDS))
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX >> np.uint64(20)
    out[PAIRS:CLASSES] = _damped(np.bincount((pairs % np.uint64(CLASSES - PAIRS)).astype(np.int64), minlength=CLASSES - PAIRS)) / 2
    grams = np.zeros(SHAPE - CLASSES)
    for at in range(0, max(0, len(text) - 3), CHUNK):
        c = _CLASS[np.frombuffer(text[at : at + CHUNK + 3], np.uint8)]
        key = ((c[:-3] * 41 + c[1:-2]) * 41 + c[2:-1]) * 41 + c[3:]
        grams += np.bincount((key * 2654435761 % (1 << 32)) % len(grams), minlength=len(grams))
    out[CLASSES:SHAPE] = _damped(grams)
    if words and shape:
        several = len(words) / len(np.unique(h))
        again = len(lines) / max(1, len(set(lines)))
        double = len(pairs) / len(np.unique(pairs)) if len(pairs) else 1.0
        runs = (h[:-1] == h[1:]).sum() / len(words)
        long = sum(map(len, words)) / len(words)
        for k, x in enumerate((np.log(several), np.log(again), 3 * np.log(double), 4 * runs, np.log(long), np.log1p(len(words)) / 4)):
            out[SHAPE + 16 * k + int(min(15, max(0, 4 * x)))] = 2.0
    return out


def fit(rows: np.ndarray, labels: np.ndarray, dims: int = 64, seed: int = 7) -> dict:
    """Inverse document frequencies, projection, unit vectors and labels of the sample; ``rows`` are weighted in place."""
    if not len(rows):
        return {"prior": 0.5}
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 0.1).astype(np.float32)
    rows *= idf
    rows /= np.maximum(1e-12, np.linalg.norm(rows, axis=1, keepdims=True))
    k = min(dims, min(rows.shape))
    random = np.random.default_rng(seed).standard_normal((rows.shape[1], k + 8), np.float32)
    basis = np.linalg.qr(rows @ random)[0]
    for _ in range(3):
        basis = np.linalg.qr(rows @ (rows.T @ basis))[0]
    _, _, vt = np.linalg.svd(basis.T @ rows, full_matrices=False)
    vectors = rows @ vt[:k].T
    vectors /= np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    return {"prior": float(labels.mean()), "project": np.ascontiguousarray(idf[:, None] * vt[:k].T, np.float32), "vectors": vectors.astype(np.float32), "labels": labels.astype(np.float64)}


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Marks the k largest values of each row, at a tie for the last places those of the earlier columns."""
    edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, tied = cosine > edge, cosine == edge
    return above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True))


def vote(model: dict, texts: list[bytes], neighbours: int, sharpness: float, shape: bool = True) -> np.ndarray:
    """Scores of a block of texts."""
    if "project" not in model:
        return np.full(len(texts), model["prior"])
    points = np.zeros((len(texts), model["project"].shape[1]), np.float32)
    for i, text in enumerate(texts):
        f = features(text, shape)
        at = np.nonzero(f)[0]
        points[i] = f[at].astype(np.float32) @ model["project"][at]
    norm = np.linalg.norm(points, axis=1)
    cosine = (points / np.maximum(1e-12, norm)[:, None]) @ model["vectors"].T
    near = nearest(cosine, min(neighbours, cosine.shape[1]))
    weight = near * np.maximum(1e-6, cosine.astype(np.float64)) ** sharpness
    score = weight @ model["labels"] / weight.sum(1)
    return np.clip(np.where(norm > 0, score, model["prior"]), 0.0, 1.0)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int, sample: int, shape: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of at most ``sample`` labelled documents outside the held-out fold, chosen by hash of their id."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_remainder(F.col(id_col), modulus) != held))
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = rows.join(F.broadcast(chosen), F.col("doc") == F.col("id")).groupBy("id", "label").agg(F.min("text").alias("text"))  # at most ``sample`` rows

    def run(batches):
        for batch in slices(batches, 2):
            rows = [features(t, shape) for t in text_bytes(batch.column(2))]
            cells = [np.nonzero(f)[0] for f in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32())), pa.array([r[c].astype(np.float32) for r, c in zip(rows, cells)], pa.list_(pa.float32()))], names=["id", "label", "cols", "vals"])

    kinds = dict(docs.dtypes)
    got = texts.mapInArrow(run, f"id {kinds[id_col]}, label int, cols array<int>, vals array<float>").orderBy(F.xxhash64("id"), "id", "label").toArrow()
    rows = np.zeros((got.num_rows, COLUMNS), np.float32)
    for i, (cols, vals) in enumerate(zip(got.column("cols"), got.column("vals"))):
        rows[i, cols.values.to_numpy()] = vals.values.to_numpy()
    return rows, got.column("label").to_numpy().astype(np.float64)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1,
    sample: int = 2048, dims: int = 64, neighbours: int = 25, sharpness: float = 8.0, block: int = 256, shape: bool = True,
) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample_of(docs, labels, id_col, text_col, label_col, modulus, held, sample, shape), dims=dims))

    def run(batches):
        for batch in slices(batches, 2):
            texts, out = list(text_bytes(batch.column(2))), []
            for at in range(0, len(texts), block):
                out.append(vote(model.value, texts[at : at + block], neighbours, sharpness, shape))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["id", "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (crc_remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_lsa_neighbours": query}
ORACLES: dict[str, str] = {}
