"""Files and texts that people read: minutes, evidence, ids."""

from pyspark.sql import functions as F

from parlance.operators import minutes, proposals, ranking
from parlance.plans.views import view


def test_minutes_files(spark, sf_dir, tmp_path):
    segments, speakers = view(spark, sf_dir, "segments_v"), view(spark, sf_dir, "speakers_v")
    minutes.write_minutes(segments, speakers, str(tmp_path / "out"))
    want = {}
    for r in minutes.minutes_lines(segments, speakers).orderBy("recording_id", "first_idx").collect():
        want.setdefault(r.recording_id, []).append(r.line)
    for rid, lines in want.items():
        files = list((tmp_path / "out" / f"recording_id={rid}").glob("part-*"))
        assert len(files) == 1 and files[0].read_text(encoding="utf-8") == "\n".join(lines) + "\n"


def test_evidence_and_ids(spark):
    row = spark.range(1).select(
        proposals.evidence(F.lit(11), F.lit(17), F.lit(0.647), F.lit(6.8), F.lit(7.0), F.lit(False), F.lit(6), F.lit(1.5)).alias("a"),
        proposals.evidence(F.lit(9), F.lit(9), F.lit(1.0), F.lit(-2.0), F.lit(7.0), F.lit(True), F.lit(0), F.lit(0.0)).alias("b"),
        proposals.proposal_id(F.lit("time"), F.lit(1.0), F.lit(2.001), F.lit(3.0)).alias("i"),
        proposals.proposal_id(F.lit("time"), F.lit(1.0), F.lit(2.004), F.lit(3.0)).alias("j"),
        proposals.proposal_id(F.lit("time"), F.lit(1.0), F.lit(2.02), F.lit(3.0)).alias("k"),
    ).first()
    assert row.a == "一致 11/17 文字(被覆 65%)・ずれ 開始 +6.8 秒 / 終了 +7.0 秒・頭の欠け 6 字を 1.5 秒手前に補正"
    assert row.b == "一致 9/9 文字(被覆 100%)・ずれ 開始 -2.0 秒・終わりは測れず(いまの長さを保つ)"
    assert row.i == row.j != row.k and len(row.i) == 12


def test_special_candidates_come_last(spark, sf_dir):
    ranked = ranking.rank_candidates(view(spark, sf_dir, "segments_v"), view(spark, sf_dir, "speakers_v"), include_special=True)
    rows = ranked.filter("recording_id = 2 and idx = 0").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and [r.speaker_id for r in rows[-3:]] == ["__unknown__", "__multi__", "__noise__"]
    assert all(isinstance(r.reasons, list) for r in rows)
