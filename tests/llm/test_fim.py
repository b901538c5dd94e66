import hashlib
from collections import Counter

import duckdb
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import fim as op
from tests.llm.cases import ROWS, documents


def naive(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= 90 or "<P>" in text or "<S>" in text or "<M>" in text:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return doc_id, n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


HARD = ["<P>", "a<S>b", "x<M>", "<P", "<", "P>", "<P><", "<<<P", "S>M>", "\r\n", "é日本𝄞́", "a\x00b", " x", "<p>not one</p>"]


def test_rows(spark):
    rows = ROWS + [(100 + 40 * k + j, t * (j % 3 + 1), "en", "s", 1) for k, t in enumerate(HARD) for j in range(40)]
    got = Counter(map(tuple, op.transform(documents(spark, rows)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()))
    assert got == Counter(naive(i, t) for i, t, *_ in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    again = op.transform(documents(spark, rows)).select(op.restored(op.F.col("output"), op.F.col("form")).alias("text")).collect()
    assert Counter(r.text for r in again) == Counter(t or "" for _, t, *_ in rows)
    assert op.transform(documents(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("ab<PSM>é\n𝄞", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_pieces_do_not_matter(text, h1, h2, piece):
    low, high = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    assert op.Units().cuts(text, h1, h2) == op.Units(piece=piece).cuts(text, h1, h2) == (len(text), low, high)


def test_long_text_is_matched_whole():
    text = "é<" * 1_300_000
    n, low, high = op.Units().cuts(text, 2_599_999, 1_234_567)
    assert (n, low, high) == (2_600_000, 1_234_567, 2_599_999)


def test_other_units():
    words = op.Units(r"\s*\S+\s*")
    assert words.cuts("one two  three", 1, 2) == (3, 4, 9)
    assert words.cuts("   ", 1, 2) == (0, 0, 0)  # no word covers it
    assert regex.fullmatch("(a)*", "aaa").ends(1) == [1, 2, 3]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sql(spark, scale):
    d = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = op.query(spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({op.SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
