import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import simhash as op
from tests.llm.cases import ROWS, documents


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in fs}


def test_golay_table_is_perfect():
    errors = op._errors()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
def test_close_fingerprints_share_a_key(a, x, y):
    b = a ^ (1 << x) ^ (1 << y) if x != y else a ^ (1 << x)
    row, key = op.golay_keys(np.array([a, b], np.uint64))
    assert set(key[row == 0]) & set(key[row == 1])


def check(spark, rows, **kw):
    out = op.near_duplicates(documents(spark, rows), **kw).collect()
    fps = {r[1]: slow_fingerprint(r[1]) for r in rows}
    assert len(out) == len(rows)
    root = brute_components(set(fps.values()))
    best = {}
    for r in rows:
        if r[0] is not None:
            c = root[fps[r[1]]]
            best[c] = min(best.get(c, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, f"{fps[r[1]]:016x}", best.get(root[fps[r[1]]], -1)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in out) == want


def test_matches_brute_force(spark):
    check(spark, ROWS)


def test_crowded_keys_lose_no_link(spark):
    """A chain of edits makes many fingerprints within a few bits; a low limit sends their keys the exact way."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[: 200 + k % 5] + [f"x{k}"] + words[205:]), "en", "s", 1) for k in range(60)]
    check(spark, rows, pair_limit=3)
    check(spark, rows, pair_limit=48)


def five_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(texts, similarity=0.8):
    sets = [five_words(t) for t in texts]
    out = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
            out.add((i, j))
    return out


def similar_components(texts, similarity=0.8):
    root = list(range(len(texts)))
    for i, j in sorted(similar_pairs(texts, similarity)):
        x, y = root[i], root[j]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def edited(rng, words, share):
    return [rng.choice(["red", "green", "blue"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_soft_decoding_equals_brute_force():
    rng = np.random.default_rng(2)
    counts = rng.integers(-9, 10, (3, 64 * op.LONG_WORDS)).astype(float) + rng.random((3, 64 * op.LONG_WORDS)) / 8
    golay = op.SoftGolay(5)
    got = golay.keys(counts, 2, 5)
    codewords = [int(c) for c in np.unique(np.arange(1 << 23)[op._syndromes(np.arange(1 << 23)) == 0])]
    signs = np.array([[1 if c >> b & 1 else -1 for b in range(23)] for c in codewords])
    assert len(codewords) == 4096 and min(c.bit_count() for c in codewords[1:]) == 7
    for text in range(3):
        fit = [signs @ counts[text, 23 * g : 23 * g + 23] for g in range(op.LONG_SEGMENTS)]
        for first in range(op.LONG_SEGMENTS):
            a, b = fit[first], fit[(first + 1) % op.LONG_SEGMENTS]
            best = sorted(((a[i] + b[j], i, j) for i in np.argsort(-a)[:9] for j in np.argsort(-b)[:9]), reverse=True)[:5]
            want = {first << 24 | codewords[i] >> 11 << 12 | codewords[j] >> 11 for _, i, j in best}
            assert set(got[text, 5 * first : 5 * first + 5].tolist()) == want


@pytest.mark.parametrize("pair_limit, block", [(48, 512), (2, 4)])
def test_similar_groups_find_brute_force_links(spark, monkeypatch, pair_limit, block):
    """Links of short and long texts around the threshold; with a low limit all of them go through crowds cut into blocks."""
    monkeypatch.setattr(op, "CROWD_BLOCK", block)
    rng = random.Random(6)
    texts = [t for _, t, *_ in ROWS]
    for k in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 9, 15, 40, 200]))]
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0.01, 0.02, 0.04, 0.08)]
    out = {r.id: r.group for r in op.similar_groups(documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), pair_limit=pair_limit).collect()}
    root = similar_components(texts)
    pairs = similar_pairs(texts)
    assert len(pairs) > 100 and len(out) == len(texts)
    assert all(root[i] == root[j] for i, j in itertools.combinations(range(len(texts)), 2) if out[i] == out[j])  # nothing is joined in vain
    assert sum(out[i] == out[j] for i, j in pairs) >= 0.97 * len(pairs)  # measured: see README


def crowd_of(spark, texts, crowd=lambda k: 0):
    rows = [(crowd(k), k, np.packbits(op.long_counts(s) > 0, bitorder="little").view("<i8").tolist(), s.view(np.int64).tolist()) for k, t in enumerate(texts) for s in [op.shingle_set(t.encode(), 5)]]
    return spark.createDataFrame(rows, "crowd long, node long, words array<long>, shingles array<long>")


def joined_by(links, n):
    root = list(range(n))
    for r in links:
        x, y = root[r.a], root[r.b]
        root = [min(x, y) if z in (x, y) else z for z in root]
    return root


def test_one_large_group_gives_few_links(spark, monkeypatch):
    """300 near copies of one text: blocks return a forest, not all pairs, and it joins what brute force joins."""
    monkeypatch.setattr(op, "CROWD_BLOCK", 64)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(rng, base, 0.02)) for _ in range(300)]
    links = op.crowd_links(crowd_of(spark, texts), 0.8).collect()
    assert joined_by(links, 300) == similar_components(texts) and len(links) <= 15 * 128 and len(similar_pairs(texts)) > 5000


@pytest.mark.parametrize("leaders, rounds", [(2, 4), (8, 1)])
def test_leaders_lose_no_link(spark, monkeypatch, leaders, rounds):
    """Chains, families that only their edges join, families apart, and single texts: leaders and bridges join what brute force joins."""
    for name, value in {"CROWD_BLOCK": 16, "CROWD_EXACT": 12, "LEADERS": leaders, "ROUNDS": rounds}.items():
        monkeypatch.setattr(op, name, value)
    rng = random.Random(4)
    texts, base = [], [f"w{k}" for k in range(200)]
    for k in range(60):  # a chain: neighbours are similar, its ends are not
        base = base[:3 * k] + [f"x{k}-{j}" for j in range(3)] + base[3 * k + 3 :]
        texts.append(" ".join(base))
    for family in range(4):
        base = [f"v{rng.randrange(900)}" for _ in range(150)]
        texts += [" ".join(edited(rng, base, share)) for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05) for _ in range(5)]
    texts += [" ".join(f"u{rng.randrange(900)}" for _ in range(80)) for _ in range(20)]
    crowd = lambda k: int(k >= 120)
    want = similar_components(texts)
    got = joined_by(op.crowd_links(crowd_of(spark, texts, crowd), 0.8).collect(), len(texts))
    inside = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if crowd(i) == crowd(j)]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in inside) and len(set(want)) > 20


def join_rows(spark, job):
    """Rows that all joins of a job have made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    job()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for k in range(before, store.executionsCount()):
        at = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            made = [m for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
            if "Join" in node.name() and made and values.contains(made[0].accumulatorId()):
                total += int(values.apply(made[0].accumulatorId()).replace(",", ""))
    return total


def test_joins_of_a_crowd_follow_its_members(spark, monkeypatch):
    """Near copies around the threshold, half of which a leader does not reach: joins make no row for each leader and member near it."""
    for name, value in {"CROWD_BLOCK": 64, "CROWD_EXACT": 64, "LEADERS": 16}.items():
        monkeypatch.setattr(op, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.04]))) for _ in range(500)]
    found, crowd = [], crowd_of(spark, texts)
    rows = join_rows(spark, lambda: found.extend(op.crowd_links(crowd, 0.8).collect()))
    assert joined_by(found, 500) == similar_components(texts)
    assert 0 < rows <= 30 * 500


@pytest.mark.parametrize("dense, columns", [(0, 7), (20, 64), (1 << 30, 64)])
def test_common_elements_equal_brute_force(monkeypatch, dense, columns):
    monkeypatch.setattr(op, "DENSE_PAIRS", dense)
    monkeypatch.setattr(op, "DENSE_COLUMNS", columns)
    rng = np.random.default_rng(5)
    left, right = ([np.unique((rng.integers(0, 200, rng.integers(0, 40)) ** 2) - 9000) for _ in range(n)] for n in (23, 31))
    assert op._common(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert op._common(left, []).shape == (23, 0)


def test_linkable_keeps_what_has_links(spark, monkeypatch):
    """With slices of few shingles: every end of a link between components stays, texts of their own go."""
    monkeypatch.setattr(op, "SLICE_SHINGLES", 500)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(edited(rng, base, share)) for share in (0.01, 0.03, 0.2) for _ in range(20)] + [f"alone {k} in all of its five words" for k in range(5)]
    members = crowd_of(spark, texts).selectExpr("crowd", "node", "node root", "shingles")
    got = {r.node for r in op.linkable(members, 0.8).collect()}
    sets = [five_words(t) for t in texts]
    held = [sum(any(s in other for j, other in enumerate(sets) if j != i) for s in x) for i, x in enumerate(sets)]
    assert got == {i for i, x in enumerate(sets) if held[i] >= 0.8 * len(x) - 1e-9}
    assert got >= {k for pair in similar_pairs(texts) for k in pair} and len(got) < 60
    assert op.linkable(members.selectExpr("crowd", "node", "7L root", "shingles"), 0.8).count() == 0


def test_long_texts_are_read_in_runs():
    many = op.shingle_set(" ".join(f"w{k}" for k in range(3 * op.BLOCK)).encode(), 5)
    whole = sum(2 * (((op._scramble(many, 0) >> np.uint64(b)) & np.uint64(1)).astype(int)) - 1 for b in [7])
    assert op.long_counts(many)[7] == whole.sum()


def test_empty_and_stage(spark):
    assert op.near_duplicates(documents(spark, [])).collect() == []
    docs = documents(spark)
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in got]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8, 9, 12, 13] and ids.count(8) == 1  # null, empty and blank texts are alike
    assert [t for i, t in got if i is None] == ["only here"]
    assert op.keep_one(documents(spark, [])).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (2, "A  b", 6, "y"), (3, "c", 7, "z")], "doc_id long, text string, row long, _key string")
    assert sorted(map(tuple, op.keep_one(clash).collect())) == [(1, "a b", 5, "x"), (3, "c", 7, "z")]
