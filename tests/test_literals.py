"""Stated expectations: labels, times, edges, previews, and whole chunks of text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import columns as c
from parlance.operators import edits, parse, quality, snapshots
from parlance.schemas import SEGMENT


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("label, want", [("発言者B", "B"), ("話者 c", "C"), ("Speaker D", "D"), ("A(男性)", "A"), ("発言者不明", "?"), ("発言者複数・重複", "*"), (None, "?"), ("", "?"), ("佐藤理事長", "佐藤理"), ("＊", "*")])
def test_labels(spark, label, want):
    assert one(spark, c.normalize_label(F.lit(label).cast("string"))) == want


@pytest.mark.parametrize("seconds, hms, tenths", [(59.6, "00:01:00", "00:00:59.6"), (3725.0, "01:02:05", "01:02:05.0"), (2631.5, "00:43:52", "00:43:51.5"), (59.96, "00:01:00", "00:01:00.0"), (360000.0, "100:00:00", "100:00:00.0")])
def test_formats(spark, seconds, hms, tenths):
    assert one(spark, c.format_hms(F.lit(seconds))) == hms and one(spark, c.format_tenths(F.lit(seconds))) == tenths


def test_negative_time(spark):
    assert one(spark, c.format_tenths(F.lit(-3.0))) == "00:00:00.0"


@pytest.mark.parametrize("text, want", [("75:00", 4500.0), ("90", 90.0), ("1:02:03.4", 3723.4), ("０１：３０", 90.0), (" 5 . 5 ", 5.5), ("", None), ("1:60", None), ("1:2:3:4", None), ("a:b", None), ("1:", None), (":1", None), ("-5", None), ("1.5:20", None), ("1:75:00", None), (None, None)])
def test_parse(spark, text, want):
    assert one(spark, c.parse_time(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("args, moved, want", [((120.0, 110.0, 1200.0), "start", (109.9, 110.0)), ((1300.0, 1400.0, 1200.0), "end", (1199.9, 1200.0)), ((0.0, 0.0, 1200.0), "start", (0.0, 0.1)), ((5.0, 5.0, 0.0), "end", (5.0, 5.1))])
def test_clamp(spark, args, moved, want):
    s, e = c.clamp_span(*map(F.lit, args), moved)
    assert (one(spark, s), one(spark, e)) == want


@pytest.mark.parametrize("text, want", [("\u00a0\u2003a b\x1f\u3000", "a b"), ("\x85\u2028x", "x"), ("\u200bx", "\u200bx"), ("", "")])
def test_unicode_white_space_is_stripped(spark, text, want):
    assert one(spark, c.trim(F.lit(text))) == want == text.strip()


def test_times_that_cannot_be_read_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "1:02"), (2, "1:75:00"), (3, None), (4, "0:5.25"), (5, "x")], "k long, at string")
    ok, rejects = c.parse_times(rows, "at")
    assert sorted(map(tuple, ok.collect())) == [(1, 62.0), (4, 5.2)] and sorted((r.k, r.at) for r in rejects.collect()) == [(2, "1:75:00"), (3, None), (5, "x")] and rejects.columns == ["k", "at"]
    assert [r.at for r in c.format_times(ok.orderBy("k"), "at", "ms").collect()] == ["01:02", "00:05"]
    with pytest.raises(ValueError):
        c.format_times(ok, "at", "other")


def slow_loop(text):
    return any(len(x) >= 30 and re.search(r"(.{1,12}?)\1{14,}", x) for x in text.split("\n"))


def test_loops_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = ["", "a" * 15, "a" * 29, "a" * 30, "b" * 15 + "cdefghijklmnopq", "b" * 14 + "cdefghijklmnopqr", "ab" * 15, "ab" * 14, "ab" * 14 + "\n" + "ab" * 14, "x\n" * 40, "日本語" * 15]
    for _ in range(300):
        unit = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 15)))
        texts.append("\n".join("".join(rng.choice("abc") for _ in range(rng.randrange(9))) + unit * rng.randrange(12, 18) + rng.choice(["", "c"]) for _ in range(rng.randrange(1, 3))))
    found = [quality.has_loop(t) for t in texts]
    assert found == [bool(slow_loop(t)) for t in texts] and 50 < sum(found) < 260


def segment(spark, **kw):
    row = {"recording_id": 1, "idx": 0, "seg_start": 100.0, "seg_end": 101.1, "text": "うん。", "cluster": "0:A", "chunk": 0, "speaker_id": None, "reviewed": False, "note": "", "text_edited": False, "time_edited": False, "time_reviewed": False, "orig_start": 100.0, "orig_end": 101.1} | kw
    return spark.createDataFrame([tuple(row[f] for f in SEGMENT.fieldNames())], SEGMENT)


def test_moved_edges_and_spans(spark):
    rec = spark.createDataFrame([(1, 0.0, 1200.0)], "recording_id long, time_offset double, duration double")

    def edit(start, end, op, value, slide):
        e = spark.createDataFrame([(1, 0, op, value, slide)], "recording_id long, idx long, op string, value double, slide boolean")
        r = edits.apply_time_edits(segment(spark, seg_start=start, seg_end=end), e, rec).first()
        return r.seg_start, r.seg_end

    assert edit(1195.0, 1196.1, "shift", 9.0, False) == (1198.9, 1200.0)
    assert edit(100.0, 101.1, "end", 90.0, True) == (88.9, 90.0)
    assert edit(100.0, 101.1, "start", 110.0, True) == (110.0, 111.1)


@pytest.mark.parametrize("length, want", [(26.0, 8.0), (0.4, 1.5), (3.0, 3.0)])
def test_preview_length(spark, length, want):
    rec = spark.createDataFrame([(1, 0.0)], "recording_id long, time_offset double")
    r = edits.review_windows(segment(spark, seg_start=100.0, seg_end=100.0 + length), rec).first()
    assert r.play_to - r.play_from == pytest.approx(want)


CHUNK = """[00:00] 【発言者A】 それでは始めます。
[00:10] 【発言者B】 資料の三ページを
ご覧ください。
[00:20] 【発言者A】 はい
[00:25] 【発言者A】 続けます
[00:40] 【?】 聞き取れない"""


def parsed(spark, text, length=60.0, merge=True):
    chunks = spark.createDataFrame([(1, 0, text, length)], "recording_id long, chunk int, text string, length double")
    return [(r.seg_start, r.seg_end, r.cluster, r.text) for r in parse.parse_transcripts(chunks, merge).orderBy("idx").collect()]


def test_whole_chunk(spark):
    assert parsed(spark, CHUNK) == [(0.0, 10.0, "0:A", "それでは始めます。"), (10.0, 20.0, "0:B", "資料の三ページを ご覧ください。"), (20.0, 40.0, "0:A", "はい、続けます"), (40.0, 60.0, "0:?", "聞き取れない")]
    assert len(parsed(spark, CHUNK, merge=False)) == 5
    assert parsed(spark, "\n \n") == []


def test_crowded_times_never_overlap(spark):
    lines = "\n".join(f"[00:0{k}] 【{'AB'[k % 2]}】 {'とても長い発言が続いています' * 2}" for k in range(9))
    out = parsed(spark, lines + "\n[00:40] 【A】 終わり")
    assert all(a[1] <= b[0] + 1e-9 for a, b in zip(out, out[1:])) and out[-1][1] == 60.0 and all(e > s for s, e, *_ in out)


def test_merge_cap_restarts(spark):
    """Rows of one voice join until the run would pass 180 seconds, then a new run begins."""
    text = "\n".join(f"[{k // 3:02d}:{k % 3 * 20:02d}] 【A】 x{k}" for k in range(16))
    out = parsed(spark, text, 330.0)
    assert [s for s, *_ in out] == [0.0, 180.0]


def test_degenerate(spark):
    texts = {"": "empty", "お、" * 20: "loop", "\n".join(["a", "b"] * 30): "few_lines", "\n".join([*map(str, range(90)), *["same line"] * 15]): "line_run", "fine\ntext": None}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.reason for r in quality.flag_degenerate(df).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_carry_over_replaces_and_absorbs(spark):
    """A joined, hand-timed row swallows the new rows that start inside it; a split one comes back as two."""
    row = lambda i, s, e, **kw: segment(spark, idx=i, seg_start=s, seg_end=e, orig_start=kw.pop("o", s), orig_end=kw.pop("oe", e), **kw)
    old = row(0, 0.5, 20.0, o=0.0, oe=20.0, time_edited=True, speaker_id="sp01").union(row(1, 30.0, 34.0, o=30.0, oe=40.0, time_edited=True)).union(row(2, 34.0, 40.0, o=30.0, oe=40.0, time_edited=True, speaker_id="sp02")).union(row(3, 50.0, 60.0, speaker_id="sp03", reviewed=True))
    new = row(0, 0.0, 10.0).union(row(1, 10.0, 20.0)).union(row(2, 30.0, 40.0)).union(row(3, 51.0, 60.0, text="new")).union(row(4, 70.0, 80.0))
    out, audit = snapshots.carry_over(old, new)
    got = [(r.idx, r.seg_start, r.speaker_id, r.reviewed) for r in out.orderBy("idx").collect()]
    assert got == [(0, 0.5, "sp01", False), (1, 30.0, None, False), (2, 34.0, "sp02", False), (3, 51.0, "sp03", True), (4, 70.0, None, False)]
    assert audit.first().asDict() == {"recording_id": 1, "carried": 3, "texts": 0, "replaced": 3, "absorbed": 1}


def test_places_are_absorbed_rows_only_on_request(spark):
    old = segment(spark, idx=0, seg_start=0.5, seg_end=20.0, orig_start=0.0, orig_end=20.0, time_edited=True)
    new = segment(spark, idx=0, seg_start=0.0, seg_end=10.0, orig_start=0.0, orig_end=10.0).union(segment(spark, idx=1, seg_start=10.0, seg_end=20.0, orig_start=10.0, orig_end=20.0))
    plain, told = (snapshots.carry_over(old, new, places=p)[1].first().asDict() for p in (False, True))
    assert told == plain | {"absorbed_at": "00:00:10"} and "absorbed_at" not in plain
