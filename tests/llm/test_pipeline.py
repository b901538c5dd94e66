import hashlib

import corpus_pipeline
from tests.llm.cases import ROWS, documents
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import similar_components


def test_stages_against_brute_force(spark, tmp_path, sf_dir):
    """Given documents with odd rows added: every stage's rows follow from its input by plain Python."""
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    odd = [(None if r[0] is None else 10_000 + r[0], *r[1:5]) for r in ROWS]
    folder = str(tmp_path)
    documents(spark, odd + given).drop("id", "fp", "n", "key").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        before, after = docs.collect(), out.collect()
        seen.append(name)
        if name == "language_id":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {10_003, 10_004, 10_005} <= gone and not any(d < 10_000 for d in gone)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r.text] = max(best.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in after) == sorted((i, t) for t, i in best.items())
        if name == "simhash_near_dedup":
            root, first = similar_components([r.text for r in before]), {}
            for r, c in zip(before, root):
                rank = (r.doc_id is None, r.doc_id or 0)
                first[c] = min(first.get(c, (rank, r)), (rank, r), key=lambda x: x[0])
            assert sorted(map(str, after)) == sorted(str(r) for _, r in first.values()) and len(after) < len(before)
        if name == "decontamination":
            bad = [x[5] for x in contaminated([(r.doc_id, r.text) for r in before], items)]
            assert sorted(map(str, after)) == sorted(str(r) for r, x in zip(before, bad) if not x) and any(bad)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        else:
            assert sorted((r.decoded_sha256) for r in after) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before)
            assert all(len(r.ids) == r.n_tokens for r in after)
        docs = out
    assert len(seen) == 5
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id or -1, r.ids_sha256) for r in again.collect()) == sorted((r.doc_id or -1, r.ids_sha256) for r in after)


def test_run_on_an_empty_table(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
