import zlib

import numpy as np
import pytest

from parlance.llm import quality as op
from tests.llm.cases import ROWS, documents


def auc(rows):
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = op.query(spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert auc(rows) > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert auc(op.score(docs, labels, shape=False).join(labels, "doc_id").filter("held_out").collect()) > 0.9  # terms alone


def slow_nearest(sims, k):
    return set(sorted(range(len(sims)), key=lambda j: (-sims[j], j))[:k])


def test_ties_go_to_earlier_documents():
    rng = np.random.default_rng(1)
    cosine = rng.integers(0, 4, (50, 12)) / 4
    for k in (1, 3, 12):
        marks = op.nearest(cosine, k)
        assert [set(np.nonzero(m)[0].tolist()) for m in marks] == [slow_nearest(c.tolist(), k) for c in cosine]


def test_scores_equal_brute_force(spark):
    """From the tables to the scores: sample by hash of the id, latent space by a full decomposition, votes by a plain loop."""
    texts = {k: f"word{k % 7} other{k % 5} " * (k % 9 + 1) + "## !! " * (k % 4) for k in range(90)}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 90, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op.score(docs, labels, sample=20, dims=8, neighbours=5, sharpness=2.0).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    order = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    chosen = sorted((k for k in order if not held(k)), key=lambda k: order[k])[:20]
    rows = np.array([op.features(texts[k].encode()) for k in chosen])
    idf = np.log(21 / (1 + (rows > 0).sum(0))) + 0.1
    unit = rows * idf / np.linalg.norm(rows * idf, axis=1, keepdims=True)
    space = np.linalg.svd(unit, full_matrices=False)[2][:8]
    vectors = unit @ space.T
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    sure = 0
    for k, t in texts.items():
        point = (op.features(t.encode()) * idf) @ space.T
        sims = vectors @ point / np.linalg.norm(point)
        by = sorted(sims, reverse=True)
        if by[4] - by[5] > 1e-4:  # the latent vectors of the two decompositions differ by rounding
            near = slow_nearest(sims.tolist(), 5)
            weight = {j: max(1e-6, sims[j]) ** 2 for j in near}
            want = sum(w * (chosen[j] % 4 > 0) for j, w in weight.items()) / sum(weight.values())
            assert got[k].score == pytest.approx(want, abs=2e-3) and got[k].held_out == held(k)
            sure += 1
    assert sure > 40 and len(got) == 90


def test_blocks_do_not_matter():
    texts = [(f"word{k} " * (k % 9 + 1) + "## !! " * (k % 4)).encode() for k in range(80)]
    model = op.fit(np.array([op.features(t) for t in texts], np.float32), np.array([float(k % 4 == 0) for k in range(80)]), dims=12)
    whole = np.concatenate([op.vote(model, texts[i : i + 16], 7, 4.0) for i in range(0, 80, 16)])
    assert np.allclose(whole, op.vote(model, texts, 7, 4.0), atol=1e-3)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (6, 1, "x"), (8, 0, "x"), (9, None, "x"), (None, 1, "x"), (12, 1, "x"), (12, 0, "x")], "doc_id long, quality int, text string")
    out = op.score(documents(spark), labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in op.score(documents(spark), labels.limit(0)).collect()} == {0.5}
    assert op.score(documents(spark, []), labels).collect() == []
    many = documents(spark, [(1, f"text number {k}", "en", "s", 1) for k in range(50)])
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert len(op.sample_of(many, one, "doc_id", "text", "quality", 3, 1, 1)[0]) == (zlib.crc32(b"1") % 3 != 1)
