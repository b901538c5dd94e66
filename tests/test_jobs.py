"""Jobs that chain operators: inspection with a history, refused undo."""

from pyspark.sql import functions as F

from parlance.operators import edits, jobs
from parlance.plans import align_queries, change_queries
from parlance.plans.views import view
from parlance.sources.caches import read_proposals


def rows_of(spark, d):
    spans = align_queries.drifted(spark, d)
    rows = view(spark, d, "segments_v").drop("text", "seg_start", "seg_end", "orig_start", "time_edited", "time_reviewed").join(spans.select("recording_id", "idx", "text", F.col("now_start").alias("seg_start"), F.col("now_end").alias("seg_end")), ["recording_id", "idx"])
    return rows.withColumns({"time_edited": F.lit(True), "time_reviewed": F.lit(False), "orig_start": F.col("seg_start")})


def test_decided_proposals_do_not_come_back(spark, sf_dir, tmp_path):
    recordings, words = view(spark, sf_dir, "recordings_v"), align_queries.words_of(spark, sf_dir)
    first, summary = jobs.inspect_times(rows_of(spark, sf_dir), recordings, words, path=str(tmp_path / "a"))
    first = first.cache()
    found = {(r.recording_id, r.id) for r in first.collect()}
    tallies = summary.collect()
    assert found and sum(r.proposals for r in tallies) == len(found) and all(r.checked == r.proposals + r.conflicted + r.unmatched + r.reviewed + r.close_enough + r.weak - r.conflicted for r in tallies)
    prints = {r.recording_id: r.audio_fingerprint for r in recordings.collect()}
    stored = read_proposals(spark, str(tmp_path / "a"))
    assert {(r.recording_id, r.id) for r in stored.collect()} == {k for k in found if prints[k[0]]}  # without a fingerprint nothing is stored
    decided = first.filter("idx % 2 = 0").withColumn("status", F.when(F.col("idx") % 4 == 0, "accepted").otherwise("rejected"))
    again, _ = jobs.inspect_times(rows_of(spark, sf_dir), recordings, words, history=decided, path=str(tmp_path / "a"))
    gone = {(r.recording_id, r.id) for r in decided.collect()}
    assert gone and {(r.recording_id, r.id) for r in again.collect()} == found - gone
    assert {(r.recording_id, r.id): r.status == "pending" for r in read_proposals(spark, str(tmp_path / "a")).collect()} == {k: k not in gone for k in found if prints[k[0]]}


def test_batches_of_times_are_refused_after_a_split(spark, sf_dir):
    log = change_queries._full_log(spark, sf_dir)
    events = spark.createDataFrame([(2, 5, "split", 2), (4, 2, "split", 0)], "recording_id long, at int, kind string, idx int")
    ids = spark.createDataFrame([(1,), (4,)], "batch_id long")
    assert sorted(map(tuple, edits.refused_batches(log, ids, events).collect())) == [(2, 4)]  # times were set after recording 4 was split


def test_rerun_of_another_recording_begins_anew(spark):
    segment = "recording_id long, idx long, seg_start double, seg_end double, text string, cluster string, chunk int, speaker_id string, reviewed boolean, note string, text_edited boolean, time_edited boolean, time_reviewed boolean, orig_start double, orig_end double"
    row = lambda r, speaker: (r, 0, 1.0, 5.0, "t", "0:A", 0, speaker, speaker is not None, "", False, False, False, 1.0, 5.0)
    recording = "recording_id long, audio_fingerprint string, duration double, doc_revision int"
    people = "recording_id long, speaker_id string, name string, note string, ord int"
    old = {"recordings": spark.createDataFrame([(1, "a", 9.0, 4), (2, "b", 9.0, 5), (4, "d", 9.0, 6)], recording), "speakers": spark.createDataFrame([(r, "sp07", "Ann", "", 0) for r in (1, 2, 4)], people),
           "segments": spark.createDataFrame([row(r, "sp07") for r in (1, 2, 4)], segment), "edits": spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "recording_id long, what string")}
    new = {"recordings": spark.createDataFrame([(1, "a", 99.0, 0), (2, "other", 9.0, 0), (3, "c", 9.0, 0)], recording), "speakers": spark.createDataFrame([(r, "sp01", n, "", k) for r in (1, 2, 3) for k, n in enumerate(["Bob", "Ann"])], people), "segments": spark.createDataFrame([row(r, None) for r in (1, 2, 3)], segment)}
    out = jobs.rerun(old, new)
    assert {r.recording_id: r.speaker_id for r in out["segments"].collect()} == {1: "sp07", 2: None, 3: None, 4: "sp07"}
    assert {r.recording_id: r.doc_revision for r in out["recordings"].collect()} == {1: 4, 2: 0, 3: 0, 4: 6}
    assert sorted(r.what for r in out["edits"].collect()) == ["x", "z"]
    assert {(r.recording_id, r.name): r.speaker_id for r in out["speakers"].collect() if r.recording_id == 2} == {(2, "Bob"): "sp01", (2, "Ann"): "sp07"}
