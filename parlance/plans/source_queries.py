"""Queries that write tables as files of the library's formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.rosters import rosters_to_text
from parlance.plans.views import view, with_views
from parlance.sources import caches, projects
from parlance.sources.shared import work_path

RID = "recording_id"


def _tables(s, d):
    recordings = view(s, d, "recordings_v").select(RID, "audio_path", "duration", "audio_fingerprint", "time_offset", "source_sha256", "doc_revision")
    return recordings, view(s, d, "speakers_v"), view(s, d, "segments_v")


def _loaded(s, d):
    """Project records of all recordings, many to a file; of every seventh only the first 30 letters are left."""
    records = projects.project_records(*_tables(s, d))
    text = F.to_json(F.struct("*"))
    path = work_path(s, "projects")
    records.select(F.when(F.col(RID) % 7 == 3, F.left(text, F.lit(30))).otherwise(text).alias("value")).coalesce(4).write.text(path)
    return projects.load_projects(s, path)


def _projects(s, d):
    found = _loaded(s, d)
    return found.segments.join(found.recordings, RID).select(RID, "idx", "seg_start", "orig_end", "speaker_id", "time_reviewed", F.md5(F.col("text").cast("binary")).alias("text"), "audio_path", "verbatim", "chunk_seconds", "doc_revision")


def _rejects(s, d):
    return _loaded(s, d).rejects.groupBy("reason").agg(F.count("*").alias("n"))


def _swapped(s, d):
    """All recordings are stored; then the even ones again, read from the same folder, with a further revision and without their last segment."""
    path = work_path(s, "projects")
    projects.write_projects(*_tables(s, d), path)
    recordings, speakers, segments = (x.filter(F.col(RID) % 2 == 0) for x in projects.read_projects(s, path))
    last = segments.groupBy(RID).agg(F.max("idx").alias("last"))
    segments = segments.join(last, RID).filter("idx < last").drop("last")
    projects.write_projects(recordings.withColumn("doc_revision", F.col("doc_revision") + 1), speakers, segments, path)
    recordings, speakers, segments = projects.read_projects(s, path)
    count = lambda df, name: df.groupBy(RID).agg(F.count("*").alias(name))
    out = recordings.join(count(speakers, "speakers"), RID, "left").join(count(segments, "segments"), RID, "left")
    return out.select(RID, "doc_revision", F.coalesce("speakers", F.lit(0)).alias("speakers"), F.coalesce("segments", F.lit(0)).alias("segments"))


def _word_versions(s, d):
    """Words of two alignment versions; of the first, every third recording is measured again."""
    e = view(s, d, "events")
    words = e.select(F.col("user_id").alias(RID), F.col("event_type").alias("text"), (F.col("event_id") * 0.5).alias("start"), (F.col("event_id") * 0.5 + 0.25).alias("end"))
    path = work_path(s, "words")
    caches.write_words(words, path)
    caches.write_words(words.filter("recording_id % 2 = 0"), path, model="next", align_ver=2)
    caches.write_words(words.filter("recording_id % 3 = 0 and start > 100"), path, model="again")
    return caches.read_words(s, path).withColumn("version", F.lit(1)).unionByName(caches.read_words(s, path, align_ver=2).withColumn("version", F.lit(2)))


def _decisions(s, d):
    """Proposals are stored, a third of them is decided in place, and every recording but each fourth is inspected again, which proposes all of its even ones anew."""
    prints = view(s, d, "recordings_v").select(RID, F.col("audio_fingerprint").alias("fingerprint"))
    rows = view(s, d, "proposals_v").join(prints, RID).withColumn("status", F.lit("pending"))
    path = work_path(s, "proposals")
    caches.write_proposals(rows, path)
    decided = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "accepted").otherwise("rejected")).otherwise(F.col("status"))
    caches.write_proposals(caches.read_proposals(s, path).withColumn("status", decided), path)
    before = caches.read_proposals(s, path).filter("status <> 'pending'").select(RID, "id")
    fresh = rows.filter("id % 2 = 0 and recording_id % 4 <> 1").join(before, [RID, "id"], "left_anti")
    caches.write_proposals(fresh, path)
    return caches.read_proposals(s, path).select(RID, "id", "status")


def _hashes(s, d):
    """A file of lines for each conversation."""
    path = work_path(s, "files")
    caches.write_lines(view(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("value")), path, "conv_id", "turn")
    found = caches.hash_files(s, path, recursive=True)
    return found.select(F.regexp_extract("path", "conv_id=(-?[0-9]+)", 1).try_cast("long").alias("conv_id"), "size", "sha256", (F.length("fingerprint") == 16).alias("has_fingerprint"))


def _rosters(s, d):
    """A roster of each recording as a text file."""
    path = work_path(s, "rosters")
    rosters_to_text(view(s, d, "speakers_v")).select(F.col("text").alias("value"), RID).write.partitionBy(RID).text(path)
    return caches.read_rosters(s, f"{path}/*/*").groupBy("speaker_id", "name", "note", "ord").agg(F.count("*").alias("n"))


QUERIES = {
    "s1_projects": _projects,
    "s1_project_rejects": _rejects,
    "s2_projects_swapped": _swapped,
    "s4_word_versions": _word_versions,
    "s5_decisions_stay": _decisions,
    "s6_hash_files": _hashes,
    "s8_rosters": _rosters,
}

ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "s1_projects": """SELECT recording_id, idx, seg_start, orig_end, speaker_id, time_reviewed, md5(coalesce(text, '')) AS text, audio_path, false AS verbatim, 600 AS chunk_seconds, doc_revision
          FROM segments_v JOIN recordings_v USING (recording_id) WHERE recording_id % 7 <> 3""",
        "s1_project_rejects": "SELECT 'broken JSON' AS reason, count(*) AS n FROM recordings_v WHERE recording_id % 7 = 3 HAVING count(*) > 0",
        "s2_projects_swapped": """SELECT recording_id, CAST(doc_revision + CASE WHEN recording_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS doc_revision,
          (SELECT count(*) FROM speakers_v s WHERE s.recording_id = r.recording_id) AS speakers, (SELECT count(*) FROM segments_v g WHERE g.recording_id = r.recording_id) - CASE WHEN recording_id % 2 = 0 THEN 1 ELSE 0 END AS segments FROM recordings_v r""",
        "s4_word_versions": """WITH w AS (SELECT user_id AS recording_id, event_type AS text, event_id * 0.5 AS start, event_id * 0.5 + 0.25 AS "end" FROM events)
          , again AS (SELECT * FROM w WHERE recording_id % 3 = 0 AND start > 100)
          SELECT *, '' AS model, 1 AS version FROM w WHERE recording_id NOT IN (SELECT recording_id FROM again) UNION ALL SELECT *, 'again' AS model, 1 AS version FROM again UNION ALL SELECT *, 'next' AS model, 2 AS version FROM w WHERE recording_id % 2 = 0""",
        "s5_decisions_stay": """SELECT recording_id, id, CASE WHEN id % 3 <> 0 THEN 'pending' WHEN id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM proposals_v JOIN recordings_v USING (recording_id)
          WHERE audio_fingerprint <> '' AND (id % 3 = 0 OR id % 2 = 0 OR recording_id NOT IN (SELECT recording_id FROM proposals_v WHERE id % 2 = 0 AND id % 3 <> 0 AND recording_id % 4 <> 1))""",
        "s6_hash_files": "SELECT conv_id, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10)) AS sha256, true AS has_fingerprint FROM conversations GROUP BY conv_id",
        "s8_rosters": "SELECT concat('sp0', ord + 1) AS speaker_id, name, note, ord, count(*) AS n FROM speakers_v GROUP BY ALL",
    }.items()
}
