import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.sources import caches, projects

OLD = {"audio_path": "a.wav", "duration": 60.5, "speakers": [{"id": "sp01", "name": "X"}], "segments": [{"index": 0, "start": 1.0, "end": 2.0, "text": "t", "cluster": "0:A", "chunk": 0, "speaker_id": "", "time_edited": True}, {"index": 1, "start": 3.0, "end": 4.0, "text": "u", "cluster": "0:B", "speaker_id": "sp01", "reviewed": True, "orig_start": 2.5}]}


def test_projects_defaults_broken_files_and_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.json").write_text(json.dumps(OLD, indent=1), encoding="utf-8")
    (src / "bad.json").write_text('{"audio_path": "b.wav", "segments": [', encoding="utf-8")
    recordings, speakers, segments = projects.read_projects(spark, str(src))
    assert [(r.audio_path, r.chunk_seconds, r.doc_revision, r.engine) for r in recordings.collect()] == [("a.wav", 600, 0, {})]
    a, b = sorted(segments.collect(), key=lambda r: r.idx)
    assert a.speaker_id is None and a.time_reviewed is True and (a.orig_start, a.orig_end) == (1.0, 2.0)  # an older file's edited time counts as heard
    assert b.speaker_id == "sp01" and b.reviewed and b.time_reviewed is False and (b.orig_start, b.orig_end) == (2.5, 4.0) and b.chunk == 0
    assert recordings.first().verbatim is False
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in projects.load_projects(spark, str(src)).rejects.collect()] == [("bad.json", "broken JSON")]
    out = str(tmp_path / "out")
    projects.write_projects(recordings, speakers, segments, out)
    lines = [json.loads(x) for p in (tmp_path / "out").rglob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 1 and lines[0]["schema"] == 5 and [s["index"] for s in lines[0]["segments"]] == [0, 1] and lines[0]["speakers"][0]["name"] == "X"
    plain = lambda df: sorted(map(str, df.collect()))
    assert [plain(x) for x in projects.read_projects(spark, out)] == [plain(x) for x in (recordings, speakers, segments)]


def test_many_recordings_in_one_file(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda k, **more: json.dumps({"audio_path": f"{k}.wav", "segments": [{"index": 0, "text": f"t{k}"}], "speakers": [{"id": "sp01", "name": f"n{k}"}]} | more)
    (src / "many.jsonl").write_text("\n".join([line(0), line(1, recording_id=7), line(2)[:40], "", line(3), '{"other": 1}', "{}", "no json"]), encoding="utf-8")
    (src / "pretty.json").write_text(json.dumps({"audio_path": "p.wav", "verbatim": True, "speakers": [], "segments": [{"index": 4}]}, indent=2), encoding="utf-8")
    (src / "compact.json").write_text(line(9), encoding="utf-8")
    (src / "empty.json").write_text("")
    found = projects.load_projects(spark, str(src))
    recordings = {r.audio_path: r for r in found.recordings.collect()}
    assert sorted(recordings) == ["0.wav", "1.wav", "3.wav", "9.wav", "p.wav"] and recordings["1.wav"].recording_id == 7 and len({r.recording_id for r in recordings.values()}) == 5
    assert recordings["p.wav"].verbatim is True and {r.verbatim for k, r in recordings.items() if k != "p.wav"} == {False}
    texts = {r.recording_id: (r.text, r.seg_start, r.orig_end) for r in found.segments.collect()}
    assert texts[7] == ("t1", 0.0, 0.0) and texts[recordings["p.wav"].recording_id] == ("", 0.0, 0.0) and len(texts) == 5
    assert sorted((r.reason, r.text) for r in found.rejects.collect()) == [("broken JSON", "no json"), ("broken JSON", line(2)[:40]), ("no project", '{"other": 1}'), ("no project", "{}")]
    # some of them are written again: the others stay
    out = str(tmp_path / "out")
    projects.write_projects(*found[:3], out)
    again = [x.filter("recording_id = 7") for x in projects.read_projects(spark, out)]
    projects.write_projects(again[0].withColumn("doc_revision", F.lit(3)), again[1], again[2], out)
    assert {r.recording_id: r.doc_revision for r in projects.read_projects(spark, out)[0].collect()} == {r.recording_id: 3 if r.recording_id == 7 else 0 for r in recordings.values()}
    assert sorted(r.text for r in projects.read_projects(spark, out)[2].collect()) == ["", "t0", "t1", "t3", "t9"] and projects.load_projects(spark, out).rejects.count() == 0


def test_chunk_files(spark, tmp_path):
    (tmp_path / "chunk_0003.cluster.00112233aabbccdd.c600.vb.txt").write_text("[00:01] 【A】 x\ny", encoding="utf-8")
    (tmp_path / "chunk_0004.c900.diar.txt").write_text("z", encoding="utf-8")
    rows = {r.chunk: r for r in caches.read_chunk_transcripts(spark, str(tmp_path)).collect()}
    assert rows[3].text == "[00:01] 【A】 x\ny" and (rows[3].fingerprint, rows[3].chunk_seconds, rows[3].mode, rows[3].verbatim) == ("00112233aabbccdd", 600, "cluster", True)
    assert (rows[4].fingerprint, rows[4].mode, rows[4].verbatim, rows[4].chunk_seconds) == (None, "diar", False, 900)


def test_words_and_proposals(spark, tmp_path):
    words = spark.createDataFrame([(1, "あ", 0.0, 0.5)], "recording_id long, text string, start double, end double")
    caches.write_words(words, str(tmp_path / "w"))
    caches.write_words(words, str(tmp_path / "v"), align_ver=7)
    assert caches.read_words(spark, str(tmp_path / "w")).count() == 1 and caches.read_words(spark, str(tmp_path / "v")).count() == 0
    (tmp_path / "j").mkdir()
    for name, text in {"ok": json.dumps({"align_ver": 1, "words": [{"text": "x", "start": 0, "end": 1}]}), "old": json.dumps({"align_ver": 0, "words": [{"text": "x", "start": 0, "end": 1}]}), "bad": "{"}.items():
        (tmp_path / "j" / f"{name}.json").write_text(text)
    assert [r.file for r in caches.read_words_json(spark, str(tmp_path / "j")).collect()] == ["ok.json"]
    rows = spark.createDataFrame([(1, 10, "f"), (2, 20, ""), (3, 30, None)], "recording_id long, id long, fingerprint string")
    caches.write_proposals(rows, str(tmp_path / "p"))
    assert [r.id for r in caches.read_proposals(spark, str(tmp_path / "p"), "f").collect()] == [10]


def hashes(data):
    return len(data), hashlib.blake2b(str(len(data)).encode() + data, digest_size=8).hexdigest(), hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("mounted", [True, False])
def test_lines_of_each_key_are_a_file(spark, tmp_path, mounted):
    """Written by the tasks on a disk, by Spark on a store that only Spark reads; with the same bytes, in a few folders on a disk."""
    rng = random.Random(7)
    want = {key: [rng.choice(["あ", "a\nb", "", None, "x" * 200]) for _ in range(rng.randrange(1, 40))] for key in [-3, 0, *range(5, 300)]}
    rows = [(key, k, value) for key, values in want.items() for k, value in enumerate(values)]
    rng.shuffle(rows)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lines.link./in", f"file://{tmp_path}")
    path = str(tmp_path / "files") if mounted else "viewfs://lines/in/files"
    caches.write_lines(spark.createDataFrame(rows, "key long, at int, value string"), path, "key", "at")
    got = {int(re.search("key=(-?[0-9]+)", r.path)[1]): (r["size"], r.fingerprint, r.sha256) for r in caches.hash_files(spark, path, recursive=True).collect()}
    assert got == {key: hashes("".join(f"{v or ''}\n" for v in values).encode()) for key, values in want.items()}
    if mounted:
        assert len(list((tmp_path / "files").iterdir())) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and not list((tmp_path / "files").rglob(".*"))


def test_no_lines_are_no_files(spark, tmp_path):
    caches.write_lines(spark.createDataFrame([], "key long, at int, value string"), str(tmp_path / "none"), "key", "at")
    assert caches.hash_files(spark, str(tmp_path / "none"), recursive=True).count() == 0


def test_small_files_share_tasks(spark, tmp_path):
    """Spark counts a small file as several MB, so that its own split would be a task for each few of them."""
    for k in range(300):
        (tmp_path / f"{k}.bin").write_bytes(b"%d" % k)
    usual, group = spark.conf.get("spark.sql.files.openCostInBytes"), f"hash-{tmp_path.name}"
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # as if there were many times as many
        spark.sparkContext.setJobGroup(group, "")
        got = sorted((r["size"], r.fingerprint, r.sha256) for r in caches.hash_files(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", usual)
        spark.sparkContext._jsc.clearJobGroup()
    assert got == sorted(hashes(b"%d" % k) for k in range(300))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    scans = [s.numTasks for s in map(tracker.getStageInfo, stages) if s]
    assert scans and max(scans) <= 4 * spark.sparkContext.defaultParallelism


def test_hashes_and_rosters(spark, tmp_path):
    data = bytes(range(256)) * 50
    (tmp_path / "f.bin").write_bytes(data)
    r = caches.hash_files(spark, str(tmp_path / "f.bin")).collect()[0]
    assert r.sha256 == hashlib.sha256(data).hexdigest() and r.fingerprint == hashlib.blake2b(str(len(data)).encode() + data, digest_size=8).hexdigest() and r["size"] == len(data)
    (tmp_path / "big file.bin").write_bytes(data * 9)
    want = {len(d): (hashlib.blake2b(str(len(d)).encode() + d, digest_size=8).hexdigest(), hashlib.sha256(d).hexdigest()) for d in (data, data * 9)}
    for limit in (caches.BINARY_BYTES, len(data), 1):  # read by Spark, in part, or in pieces by the tasks
        assert {r["size"]: (r.fingerprint, r.sha256) for r in caches.hash_files(spark, str(tmp_path / "*.bin"), limit).collect()} == want
    assert caches._digests(3, caches._pieces("file:/nowhere/at/all")) == ("", "")
    (tmp_path / "r.txt").write_text("* 森下（書記）：記録\n西\n\n\n・東（顧問）\n- 北川: 進行", encoding="utf-8")
    got = [(r.speaker_id, r.name, r.note, r.ord) for r in caches.read_rosters(spark, str(tmp_path / "r.txt")).orderBy("ord").collect()]
    assert got == [("sp01", "森下", "書記 / 記録", 0), ("sp02", "西", "", 1), ("sp05", "東", "顧問", 2), ("sp06", "北川", "進行", 3)]
