import hashlib
import re
from collections import Counter

import pytest

from parlance.llm import decontaminate as op
from tests.llm.cases import ROWS, WORDS, documents


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if owner := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= owner
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, " ".join(WORDS)), (2, " ".join(WORDS[3:14])), (3, "zeta eta"), (4, None), (5, "..."), (None, "Twice"), (7, "日本"), (8, " ".join(["same"] * 30)), (9, " ".join(["same"] * 11)), (3, "ZETA, eta!"), (10, "a b c d e f g")]
EXTRA = [
    (201, "x " * 7 + " ".join(WORDS[3:14]) + " y", "en", "s", 1), (202, " ".join(WORDS[:9]), "en", "s", 1), (203, "same " * 25, "en", "s", 1), (204, " ".join(WORDS[2:12] + ["stop"] + WORDS[4:14]), "en", "s", 1),
    (205, "a-b-c-d-e-f-g", "en", "s", 1), (206, "Zéta zeta-ETA 日本", "en", "s", 1),
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(op, "BROADCAST_ROWS", limit)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = op.contamination(documents(spark, ROWS + EXTRA), items).collect()
    assert Counter(map(tuple, out)) == brute([r[:2] for r in ROWS + EXTRA], ITEMS)


def test_on_given_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = Counter(map(tuple, op.query(spark, sf_dir).collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.contamination(documents(spark, []), none).collect() == []
    assert not any(r.contaminated for r in op.contamination(documents(spark), none).collect())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = op.keep_clean(documents(spark, ROWS + EXTRA), items)
    assert {201, 203, 205} & {r.doc_id for r in kept.collect()} == set() and kept.columns == documents(spark).columns
