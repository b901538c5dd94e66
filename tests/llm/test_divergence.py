import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import divergence as op
from tests.llm.cases import ROWS, documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def naive(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    rows = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), x or "", s or "") for t, x, s in rows]
    out = Counter()
    for lang in {x for _, x, _ in rows}:
        mine = [(TERM.findall(t), s) for t, x, s in rows if x == lang]
        seen = Counter(w for ws, _ in mine for w in set(ws))
        kept = [w for w in seen if seen[w] >= least]
        share = {}
        for g in {s for _, s in mine} | {None}:
            count = Counter(w for ws, s in mine if g in (None, s) for w in ws)
            n = sum(count[w] for w in kept)
            share[g] = {w: (1 + 10**9 * (count[w] + 1) // (n + len(kept)), count[w]) for w in kept}
        for s in share:
            if s is None:
                continue
            f = lambda p, q: (p - q) ** 2 // q
            pair = [(-sum(f(share[s][w][0], share[o][w][0]) for w in kept), o.encode(), o) for o in share if o not in (None, s)]
            term = [(-f(share[s][w][0], share[None][w][0]), w.encode(), w) for w in kept if share[s][w][1] and share[s][w][0] > share[None][w][0]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out.update((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found))
    return out


def rows_of(df):
    return Counter(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


SOME = [(f"{'the ' * (k % 4)}Word{chr(97 + k % 7)} é{chr(97 + k % 3)} tail-{chr(97 + k % 11)}x9y", "en" if k % 5 else None, f"s{k % 6}" if k % 13 else None) for k in range(90)]
SOME += [(None, "zz", "only"), ("", "zz", "other"), ("one two", "yy", "a"), ("three", "yy", "b"), ("Same Text", "xx", "a")] + [("Same Text", "xx", "b")] * 3 + [("ß ſ İ K", "ww", s) for s in "aab"]


@pytest.mark.parametrize("tile, block", [(32, 1 << 18), (2, 5)])
def test_rows(spark, monkeypatch, tile, block):
    monkeypatch.setattr(op, "TILE", tile)
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(SOME)], "doc_id long, text string, lang string, source string, term string, n int")
    assert rows_of(op.divergence(df, block_rows=block)) == naive(SOME)
    assert rows_of(op.divergence(df, least_docs=1, top=2)) == naive(SOME, 1, 2)


def test_odd_rows(spark):
    docs = documents(spark)
    assert rows_of(op.divergence(docs)) == naive([(t, x, s) for _, t, x, s, _ in ROWS])
    assert op.divergence(documents(spark, [])).collect() == []


def test_a_task_hands_on_often(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 5)
    assert b"".join(p.replace(b" ", b"") for p in op._pieces(b"one two three-four")) == b"onetwothreefour" and [w for p in op._pieces(b"one two three-four") for w in p.split()] == [b"one", b"two", b"three", b"four"]
    tally, got = op._Tally(), Counter()
    for t, x, s in SOME * 2:
        tally.add([x or ""], [s or ""], [(t or "").encode()])
        if tally.cells > 20:
            got += Counter({(r["lang"], r["source"], r["term"]): r["n"] for b in tally.flush() for r in b.to_pylist() if r["term"]})
    got += Counter({(r["lang"], r["source"], r["term"]): r["n"] for b in tally.flush() for r in b.to_pylist() if r["term"]})
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert got == Counter((x or "", s or "", w) for t, x, s in SOME * 2 for w in TERM.findall(lower(t)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40), st.integers(0, 10**9))
def test_runs_equal_terms(cells, more):
    a, b = (np.array([c[k] for c in cells]) for k in (0, 1))
    assert [len(list(g)) for _, g in groupby(a.tolist())] == np.diff(op.runs_of(a)[0], append=len(a)).tolist()
    share = lambda c: [1 + 10**9 * (int(x) + 1) // (int(c.sum()) + len(c) + more) for x in c]
    p, q = share(a), share(b)
    columns = [(op.runs_of(c)[0], op.shares(op.runs_of(c)[1], int(c.sum()) + len(c) + more)) for c in (a, b)]
    assert op.diverge(*columns, len(a)) == (sum((x - y) ** 2 // y for x, y in zip(p, q)), sum((x - y) ** 2 // x for x, y in zip(p, q)))


def test_shares_are_exact():
    whole = 9_000_000_000_000_001
    for c in (0, 1, 12345, 10**12 + 7, whole - 2):
        assert op.shares(np.array([c]), whole)[0] == 1 + 10**9 * (c + 1) // whole


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sql(spark, scale):
    d = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = rows_of(op.query(spark, d))
    assert got == Counter(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({op.SQL})").fetchall()) and len(got) > 1000
