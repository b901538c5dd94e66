import hashlib
from collections import Counter

import pytest

from parlance.llm import exact_dedup as op
from tests.llm.cases import ROWS, documents


def brute(rows, stays):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        best = (max if stays == "largest" else min)(some) if some else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("stays", ["smallest", "largest"])
@pytest.mark.parametrize("key_hex", [64, 1])
def test_matches_brute_force(spark, stays, key_hex):
    """One hex digit makes different texts share keys, so the byte verification decides."""
    rows = ROWS + [(100 + k, f"text {k % 30}", "en", "s", 1) for k in range(90)]
    out = op.exact_dedup(documents(spark, rows), stays=stays, key_hex=key_hex).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows, stays)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r[1] or "" for r in rows})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_empty_table(spark):
    assert op.exact_dedup(documents(spark, [])).collect() == []


def test_keep_one_keeps_columns_and_one_row(spark):
    docs = documents(spark)
    out = op.keep_one(docs)
    assert out.columns == docs.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({r[1] or "": 1 for r in ROWS})


def test_keep_one_odd_tables(spark):
    assert op.keep_one(documents(spark, [])).collect() == []
    same = documents(spark, [(1, "a", "en", "s", 1)] * 3 + [(None, "b", "en", "s", 1)] * 2 + [(2, "a", "en", "s", 1)])
    assert sorted(((r.doc_id or 0), r.text) for r in op.keep_one(same, stays="largest").collect()) == [(0, "b"), (2, "a")]
    clash = spark.createDataFrame([(1, "a", 5, 7, "x"), (2, "a", 6, 8, "y")], "doc_id long, text string, bucket long, ord long, sha string")
    assert [tuple(r) for r in op.keep_one(clash).collect()] == [(1, "a", 5, 7, "x")]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_full_filters_change_nothing(spark, monkeypatch, bits):
    """With far too few bits for 20,000 keys every row passes the filters, and results are the same."""
    import parlance.llm.common as common

    monkeypatch.setattr(common, "LEAST_BITS", bits)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    docs = spark.range(0, 20_000, 1, 4).selectExpr("id AS doc_id", "concat('t', id % 15000) AS text")
    out = op.exact_dedup(docs)
    assert out.filter("kept").count() == 15_000 and out.filter("group_size = 2").count() == 10_000
    assert op.keep_one(docs).count() == 15_000


def test_no_python_in_plan(spark, sf_dir):
    plan = op.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
