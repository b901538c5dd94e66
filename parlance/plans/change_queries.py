"""Queries over rosters, proposals, snapshots and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns
from parlance.operators import edits, jobs, proposals, rosters, snapshots
from parlance.plans.segment_queries import on
from parlance.plans.views import view, with_views
from parlance.sources import caches
from parlance.sources.shared import work_path

RID = "recording_id"
WANTED = """SELECT recording_id, CASE WHEN speaker_id = 'sp02' THEN concat('New ', recording_id) ELSE name END AS name, CASE WHEN speaker_id = 'sp03' THEN 'guest' ELSE '' END AS note, 9 - ord AS ord
            FROM {speakers_v} AS speakers_v WHERE recording_id % 4 <> 0 AND NOT (speaker_id = 'sp05' AND recording_id % 3 = 0)"""


def _wanted(s, d):
    return s.sql(WANTED, speakers_v=view(s, d, "speakers_v"))


def _rosters(s, d):
    nations = view(s, d, "nation")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")
    n = F.col("n_nationkey")
    line = F.when(n % 4 == 0, F.concat(F.lit("- "), "n_name")).when(n % 4 == 1, F.concat("n_name", F.lit("（chair）: talks a lot"))).when(n % 4 == 2, F.lit("  ")).otherwise(F.concat(F.lit("・"), "n_name", F.lit("：note")))
    return rosters.parse_rosters(nations.withColumn("line", line).groupBy(F.col("n_regionkey").cast("long").alias(RID)).agg(text.alias("text")))


PARSED = """
WITH l AS (SELECT n_regionkey AS recording_id, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation)
SELECT CAST(recording_id AS BIGINT) AS recording_id, concat('sp', lpad(CAST(pos AS VARCHAR), 2, '0')) AS speaker_id, n_name AS name, CASE k % 4 WHEN 1 THEN 'chair / talks a lot' WHEN 3 THEN 'note' ELSE '' END AS note,
       CAST(row_number() OVER (PARTITION BY recording_id ORDER BY pos) - 1 AS INT) AS ord FROM l WHERE k % 4 <> 2"""
MATCHED = f"""
wt AS ({WANTED.replace("{speakers_v} AS speakers_v", "speakers_v")})
, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, name ORDER BY ord) AS nth FROM speakers_v)
, w AS (SELECT *, row_number() OVER (PARTITION BY recording_id, name ORDER BY ord) AS nth FROM wt)
, b AS (SELECT coalesce(o.recording_id, w.recording_id) AS recording_id, coalesce(o.name, w.name) AS name, o.speaker_id, o.note AS old_note, o.ord AS old_ord, w.note AS new_note, w.ord AS new_ord FROM o FULL JOIN w ON o.recording_id = w.recording_id AND o.name = w.name AND o.nth = w.nth)
, free AS (SELECT recording_id, id, row_number() OVER (PARTITION BY recording_id ORDER BY id) AS k FROM (SELECT DISTINCT recording_id FROM wt), (SELECT concat('sp', lpad(CAST(i AS VARCHAR), 2, '0')) AS id FROM range(1, 40) AS t(i)) WHERE (recording_id, id) NOT IN (SELECT (recording_id, speaker_id) FROM speakers_v))
, g AS (SELECT b.*, free.id AS given FROM (SELECT *, CASE WHEN speaker_id IS NULL THEN row_number() OVER (PARTITION BY recording_id, speaker_id IS NULL ORDER BY new_ord) END AS k FROM b) b LEFT JOIN free ON free.recording_id = b.recording_id AND free.k = b.k)
"""


def _roster(s, d):
    return rosters.plan_roster_change(view(s, d, "speakers_v"), _wanted(s, d), view(s, d, "segments_v"))


def _plan(s, d):
    plan = _roster(s, d)[1]
    return plan.select(RID, F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"), "affected")


def _lost(s, d):
    return view(s, d, "speakers_v").filter("ord = 1").select(RID, "speaker_id")


def _new_people(s, d):
    return view(s, d, "recordings_v").select(RID, F.explode(F.array(F.lit("x"), F.lit("y"))).alias("name")).withColumns({"note": F.lit(""), "ord": F.when(F.col("name") == "x", 0).otherwise(1)})


def _states(segments):
    return segments.select(RID, "idx", "speaker_id", "reviewed")


def _times(segments):
    return segments.select(RID, "idx", F.round("seg_start", 3).alias("seg_start"), F.round("seg_end", 3).alias("seg_end"), "time_edited", "time_reviewed")


AUDIO = """s AS (SELECT v.*, time_offset, duration, CASE WHEN time_edited THEN seg_start ELSE greatest(0, seg_start + time_offset) END AS now_start, CASE WHEN time_edited THEN seg_end ELSE greatest(0, seg_end + time_offset) END AS now_end FROM segments_v v LEFT JOIN recordings_v r USING (recording_id))"""
TARGETS = AUDIO + """
, c AS (SELECT p.*, s.idx, s.seg_start, count(*) OVER (PARTITION BY p.recording_id, p.id) AS same, abs(s.now_start - p.target_now) AS gap FROM proposals_v p JOIN s ON s.recording_id = p.recording_id AND abs(s.orig_start - p.target_orig_start) < 1e-6)
, tg AS (SELECT recording_id, id, CASE WHEN same = 1 OR target_now IS NULL OR gap <= 5 THEN idx END AS idx, p_start, p_end FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, id ORDER BY CASE WHEN same = 1 OR target_now IS NULL THEN 0 ELSE gap END, seg_start, idx) AS k FROM c) WHERE k = 1)
"""
PLANNED = TARGETS + """
, tk AS (SELECT tg.* FROM tg JOIN s ON s.recording_id = tg.recording_id AND s.idx = tg.idx WHERE NOT s.time_reviewed)
, ds AS (SELECT s.recording_id, s.idx, tk.id, p_start, p_end, duration, lag(coalesce(p_end, now_end)) OVER w AS le, lead(coalesce(p_start, now_start)) OVER w AS rs FROM s LEFT JOIN tk ON tk.recording_id = s.recording_id AND tk.idx = s.idx WINDOW w AS (PARTITION BY s.recording_id ORDER BY s.idx))
, cl AS (SELECT *, greatest(p_start, coalesce(le, p_start)) AS a, least(p_end, coalesce(rs, p_end)) AS b FROM ds WHERE id IS NOT NULL)
, ct AS (SELECT recording_id, id, idx, least(round(a, 1), duration) AS a, least(round(b, 1), duration) AS b, duration FROM cl WHERE b - a >= 0.1)
, pl AS (SELECT recording_id, id, idx, CASE WHEN b - a >= 0.1 THEN a WHEN a + 0.1 > duration THEN round(duration - 0.1, 1) ELSE a END AS new_start, CASE WHEN b - a >= 0.1 THEN b WHEN a + 0.1 > duration THEN duration ELSE round(a + 0.1, 1) END AS new_end FROM ct)
"""


def _planned(s, d):
    return snapshots.plan_proposals(view(s, d, "proposals_v"), view(s, d, "segments_v"), view(s, d, "recordings_v"))


def _points(s, d):
    return view(s, d, "segments_v").select(RID, (F.col("seg_start") + F.col("idx") * 7 % 23).alias("t")).distinct()


def _history(s, d):
    return view(s, d, "proposals_v").filter("id % 3 <> 0").withColumn("status", F.expr("CASE id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END"))


def _fresh(s, d):
    return view(s, d, "proposals_v").withColumn("status", F.lit("pending"))


def _words(s, d):
    e = view(s, d, "events")
    return e.select(F.col("user_id").alias(RID), (F.col("event_id") * 0.5).alias("c_start"), (F.col("event_id") * 0.5 + 0.5).alias("c_end"))


def _ranges(s, d):
    spans = view(s, d, "segments_ev").select(RID, "idx", (F.col("seg_start") * 2).alias("t0"), (F.col("seg_start") * 2 + 40).alias("t1"))
    return snapshots.window_words(spans, _words(s, d)).select(RID, "idx", "lo", "hi")


def _carry(s, d):
    """Old rows, of which some are split, against new ones that are shifted (within the tolerance and beyond), doubled, and inside edited spans."""
    return snapshots.carry_over(view(s, d, "old_v"), view(s, d, "new_v"), places=True)


def _carried(s, d):
    rows = _carry(s, d)[0]
    return rows.select(RID, "idx", F.round("seg_start", 3).alias("seg_start"), "speaker_id", "reviewed", "note", "text_edited", "time_edited", F.md5(F.col("text").cast("binary")).alias("text"))


CARRY = """
fam AS (SELECT *, round(orig_start, 3) AS family, count(*) OVER (PARTITION BY recording_id, round(orig_start, 3)) AS members, bool_or(time_edited) OVER (PARTITION BY recording_id, round(orig_start, 3)) AS edited FROM old_v WHERE speaker_id IS NOT NULL OR text_edited OR time_edited)
, mt AS (SELECT n.recording_id, f.family, min(n.idx) AS pos FROM new_v n JOIN (SELECT DISTINCT recording_id, family FROM fam) f ON n.recording_id = f.recording_id AND abs(n.seg_start - f.family) < 2 + 1e-9 GROUP BY 1, 2)
, fm AS (SELECT fam.*, pos FROM fam JOIN mt USING (recording_id, family))
, ins AS (SELECT DISTINCT n.recording_id, n.idx, n.seg_start FROM new_v n JOIN fm ON fm.recording_id = n.recording_id AND fm.time_edited AND fm.orig_start < n.seg_start AND n.seg_start < fm.orig_end WHERE (n.recording_id, n.idx) NOT IN (SELECT (recording_id, pos) FROM mt))
, rows3 AS (
  SELECT recording_id, idx AS pos, idx, seg_start, speaker_id, reviewed, note, text_edited, time_edited, text, 'new' AS how FROM new_v WHERE (recording_id, idx) NOT IN (SELECT (recording_id, pos) FROM mt) AND (recording_id, idx) NOT IN (SELECT (recording_id, idx) FROM ins)
  UNION ALL SELECT n.recording_id, n.idx, n.idx, n.seg_start, fm.speaker_id, fm.speaker_id IS NOT NULL AND fm.reviewed, fm.note, fm.text_edited, false, CASE WHEN fm.text_edited THEN fm.text ELSE n.text END, 'carried' FROM new_v n JOIN fm ON fm.recording_id = n.recording_id AND fm.pos = n.idx WHERE members = 1 AND NOT edited
  UNION ALL SELECT recording_id, pos, idx, seg_start, speaker_id, reviewed, note, text_edited, time_edited, text, 'replaced' FROM fm WHERE members > 1 OR edited)
"""
_AT = "CAST(round_even(seg_start, 0) AS BIGINT)"
ABSORBED = f"""SELECT recording_id, count(*) AS absorbed, string_agg(concat(lpad(CAST({_AT} // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST({_AT} % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({_AT} % 60 AS VARCHAR), 2, '0')), ' ' ORDER BY seg_start, idx) FILTER (k <= 5) AS absorbed_at
FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_start, idx) AS k FROM ins) GROUP BY 1"""
SAME = """same AS (SELECT o.recording_id, o.doc_revision FROM recordings_v o JOIN rerecorded_v n USING (recording_id) WHERE recording_id % 10 <> 9 AND CASE WHEN o.audio_fingerprint <> '' AND n.audio_fingerprint <> '' THEN o.audio_fingerprint = n.audio_fingerprint ELSE abs(o.duration - n.duration) <= 1 END)"""


def _stored(s, d, name):
    """What was stored: every tenth recording is new to the run."""
    return view(s, d, name).filter("recording_id % 10 <> 9")


def _rerun(s, d):
    """What a second run leaves of every recording: revision, segments, those with a speaker, people and edits."""
    arriving = lambda df: df.filter("recording_id % 10 <> 8")
    old = {"recordings": _stored(s, d, "recordings_v"), "speakers": _stored(s, d, "speakers_v"), "segments": _stored(s, d, "old_v"), "edits": _log(s, d).filter("recording_id % 10 <> 9")}
    roster = arriving(_wanted(s, d)).withColumn("speaker_id", F.concat(F.lit("sp"), F.lpad((F.col("ord") + 1).cast("string"), 2, "0")))
    out = jobs.rerun(old, {"recordings": view(s, d, "rerecorded_v"), "speakers": roster, "segments": arriving(view(s, d, "new_v"))})
    count = lambda df, name: df.groupBy(RID).agg(F.count("*").alias(name))
    rows = out["segments"].groupBy(RID).agg(F.count("*").alias("segments"), F.count("speaker_id").alias("assigned"))
    both = out["recordings"].select(RID, "doc_revision").join(rows, RID, "left").join(count(out["speakers"], "people"), RID, "left").join(count(out["edits"], "edits"), RID, "left")
    return both.fillna(0)


def _decisions(s, d):
    return view(s, d, "segments_v").filter("(recording_id * 7 + idx) % 5 = 0").select(RID, "idx", F.when(F.col("idx") % 4 == 3, None).otherwise("sp05").alias("speaker_id"), F.col("idx").alias("seq"))


def _splits(s, d):
    return view(s, d, "segments_v").filter("idx % 3 = 1").select(RID, "idx", (F.col("seg_start") + F.col("idx") % 4 * 6).alias("boundary"), (F.col("idx") * 5).cast("int").alias("cut"))


def _merges(s, d):
    return view(s, d, "segments_v").filter("idx % 4 <> 3").select(RID, "idx")


def _time_edits(s, d):
    v = view(s, d, "segments_v")
    return v.filter("idx % 2 = 0").select(RID, "idx", F.expr("CASE (recording_id + idx) % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'shift' END").alias("op"), F.expr("CASE (recording_id + idx) % 3 WHEN 2 THEN (recording_id % 9) * 5.0 - 20.0 ELSE seg_start + (recording_id % 5) * 8.0 - 8.0 END").cast("double").alias("value"), (F.col("recording_id") % 2 == 0).alias("slide"))


def _log(s, d):
    v = view(s, d, "segments_v").filter("speaker_id is not null")
    one = v.select(RID, "idx", F.lit("speaker_id").alias("field"), F.lit(None).cast("string").alias("before"), F.lit("sp01").alias("after"), F.lit(1).alias("at"), (F.col("idx") % 3).alias("batch_id"))
    two = v.select(RID, "idx", F.lit("speaker_id").alias("field"), F.lit("sp01").alias("before"), F.col("speaker_id").alias("after"), F.lit(2).alias("at"), (F.col("idx") % 5 + 10).alias("batch_id"))
    return one.unionByName(two)


def _undone(s, d):
    ids = s.range(12).filter("id in (1, 10, 11)").select(F.col("id").alias("batch_id"))
    return edits.undo_batches(view(s, d, "segments_v"), _log(s, d), ids).select(RID, "idx", "speaker_id")


def _full_log(s, d):
    """Batches 0 to 2 set speakers, 3 texts and 4 times; then rows are split and joined; batch 5 sets speakers again."""
    v = view(s, d, "segments_v")
    edit = lambda df, field, before, after, at, batch: df.select(RID, "idx", F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"), F.lit(at).alias("at"), batch.cast("long").alias("batch_id"))
    parts = [
        edit(v, "speaker_id", F.lit("first"), F.lit("second"), 1, F.col("idx") % 3), edit(v, "reviewed", F.lit(True), F.lit(False), 1, F.col("idx") % 3), edit(v.filter("idx % 2 = 0"), "text", F.concat(F.lit("was "), F.col("idx").cast("string")), F.lit("now"), 2, F.lit(3)),
        *[edit(v.filter("idx % 4 < 2"), f, b, F.col(f), 3, F.lit(4)) for f, b in (("seg_start", F.col("idx") * 2.0), ("seg_end", F.col("idx") * 2.0 + 1), ("time_edited", F.lit(True)), ("time_reviewed", F.lit(True)))],
        edit(v.filter("idx % 5 = 0"), "speaker_id", F.lit("second"), F.lit("third"), 9, F.lit(5)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _undone_all(s, d):
    """Recordings of even number had row 2 split; of those every third had row 4 joined with the next."""
    r = view(s, d, "recordings_v").filter("recording_id % 2 = 0")
    events = r.select(RID, F.lit(5).alias("at"), F.lit("split").alias("kind"), F.lit(2).alias("idx")).unionByName(r.filter("recording_id % 3 = 0").select(RID, F.lit(6).alias("at"), F.lit("merge").alias("kind"), F.lit(4).alias("idx")))
    ids = s.range(6).filter("id in (1, 3, 4, 5)").select(F.col("id").alias("batch_id"))
    rows = edits.undo_batches(view(s, d, "segments_v"), _full_log(s, d), ids, events)
    return rows.select(RID, "idx", "speaker_id", "reviewed", F.round("seg_start", 3).alias("seg_start"), F.round("seg_end", 3).alias("seg_end"), "time_edited", "time_reviewed", F.md5(F.col("text").cast("binary")).alias("text"))


def _stored_words(s, d):
    """Words written to the shared folder and read back."""
    e = view(s, d, "events")
    words = e.select(F.col("user_id").alias(RID), F.col("event_type").alias("text"), (F.col("event_id") * 0.5).alias("start"), (F.col("event_id") * 0.5 + 0.25).alias("end"))
    path = work_path(s, "words")
    caches.write_words(words, path, model="small")
    return caches.read_words(s, path)


def _stored_proposals(s, d):
    """Proposals written by fingerprint and read back; recordings without one keep none."""
    prints = view(s, d, "recordings_v").select(RID, F.col("audio_fingerprint").alias("fingerprint"))
    path = work_path(s, "proposals")
    caches.write_proposals(view(s, d, "proposals_v").join(prints, RID), path)
    return caches.read_proposals(s, path).select(RID, "id", "p_start", F.col("fingerprint").cast("string").alias("fingerprint"))


def _formats(s, d):
    t = (F.col("event_id") * 7.25 + 0.5).alias("t")
    rows = view(s, d, "events").select("event_id", t)
    c = F.col("t")
    return rows.select("event_id", columns.format_hms(c).alias("hms"), columns.format_ms(c).alias("ms"), columns.format_tenths(c).alias("tenths"), columns.parse_time(columns.format_tenths(c)).alias("back"), columns.parse_time(F.concat(F.lit("bad"), columns.format_hms(c))).alias("bad"))


def _measured(s, d):
    """A table as the alignment gives it, from the segments' own numbers."""
    v = view(s, d, "segments_v")
    k = F.col("recording_id") * 3 + F.col("idx") * 5
    m = v.filter("(recording_id + idx) % 9 <> 0").select(
        RID, "idx", (F.col("seg_start") + k % 8 * 0.5).alias("m_start"), (F.col("seg_start") + 4 + k % 37).cast("double").alias("m_end"), (F.lit(0.5) + k % 9 * 0.0625).alias("coverage"), (k % 40 + 4).cast("long").alias("matched"), (k % 40 + 9).cast("long").alias("total"), (k % 7 * 2).cast("long").alias("head_gap"), (k % 5).cast("long").alias("tail_gap")
    )
    return v, m, view(s, d, "recordings_v")


def _proposed(s, d):
    out = proposals.propose_times(*_measured(s, d))
    return out.select(RID, "idx", "reason", F.round("p_start", 2).alias("p_start"), F.round("p_end", 2).alias("p_end"), proposals.confidence_band(F.col("confidence")).alias("band"))


def _inspected(s, d):
    return proposals.inspect_summary(proposals.propose_times(*_measured(s, d)))


REASONS = AUDIO + """
, m AS (SELECT recording_id, idx, k, seg_start + k % 8 * 0.5 AS m_start, seg_start + 4 + k % 37 AS m_end, 0.5 + k % 9 * 0.0625 AS coverage, k % 40 + 4 AS matched, k % 7 * 2 AS head_gap, k % 5 AS tail_gap FROM (SELECT *, recording_id * 3 + idx * 5 AS k FROM segments_v WHERE (recording_id + idx) % 9 <> 0))
, j AS (SELECT s.*, m.* EXCLUDE (recording_id, idx), matched / greatest(0.1, m_end - m_start) AS rate FROM s LEFT JOIN m ON m.recording_id = s.recording_id AND m.idx = s.idx)
, h AS (SELECT *, greatest(0, m_start - head_gap / rate) AS st FROM j)
, why AS (SELECT *, CASE WHEN k IS NULL THEN 'unmatched' WHEN time_reviewed THEN 'reviewed' WHEN matched < 8 THEN 'short_match' WHEN coverage < 0.6 THEN 'low_coverage' WHEN rate < 1.5 THEN 'scattered' WHEN m_end - m_start > (now_end - now_start) * 1.5 + 1 THEN 'stretched'
                       WHEN head_gap / rate > 6 THEN 'head_lost' WHEN abs(st - now_start) < 0.75 THEN 'close_enough' ELSE 'proposal' END AS reason, greatest(0, st - 0.3) AS ps FROM h)
, pr AS (SELECT *, CASE WHEN tail_gap >= 3 THEN ps + now_end - now_start ELSE m_end + tail_gap / rate + 0.2 END AS pe FROM why)
"""

QUERIES = {
    "j2_parse_rosters": _rosters,
    "j2_rosters_to_text": on(rosters.rosters_to_text, "speakers_v"),
    "j3_merge_rosters": lambda s, d: rosters.merge_rosters(view(s, d, "speakers_v"), _wanted(s, d)),
    "j4_roster_plan": _plan,
    "j4_roster_applied": lambda s, d: _states(rosters.apply_roster_change(_roster(s, d)[1], view(s, d, "segments_v"))),
    "j5_remove_speakers": lambda s, d: rosters.remove_speakers(view(s, d, "speakers_v"), view(s, d, "segments_v"), _lost(s, d))[0],
    "j5_remove_from_segments": lambda s, d: _states(rosters.remove_speakers(view(s, d, "speakers_v"), view(s, d, "segments_v"), _lost(s, d))[1]),
    "j5b_add_speakers": lambda s, d: rosters.add_speakers(view(s, d, "speakers_v"), _new_people(s, d)),
    "j6_carry_over": _carried,
    "s4_words": _stored_words,
    "s5_proposals": _stored_proposals,
    "j6_audit": lambda s, d: _carry(s, d)[1],
    "j6_rerun": _rerun,
    "j7_target_segments": lambda s, d: snapshots.target_segments(view(s, d, "proposals_v"), view(s, d, "segments_v"), view(s, d, "recordings_v")).select(RID, "id", "idx"),
    "j8_segment_at": lambda s, d: snapshots.segment_at(_points(s, d), view(s, d, "segments_v")),
    "j9_drop_conflicts": lambda s, d: snapshots.drop_conflicts(view(s, d, "proposals_v"))[0].select(RID, "id"),
    "j9_dropped": lambda s, d: snapshots.drop_conflicts(view(s, d, "proposals_v"))[1].select(RID, "id"),
    "j10_plan_proposals": lambda s, d: _planned(s, d)[0],
    "j10_failed": lambda s, d: _planned(s, d)[1].select(RID, "id"),
    "j11_merge_history": lambda s, d: snapshots.merge_history(_fresh(s, d), _history(s, d)).select(RID, "id"),
    "j12_to_save": lambda s, d: snapshots.to_save(_fresh(s, d), _history(s, d)).select(RID, "id", "status"),
    "j13_window_words": _ranges,
    "i1_audio_spans": lambda s, d: snapshots.audio_spans(view(s, d, "segments_v"), view(s, d, "recordings_v")).select(RID, "idx", "now_start", "now_end"),
    "i2_propose_times": _proposed,
    "a12_inspect_summary": _inspected,
    "i5_apply_proposals": lambda s, d: _times(proposals.apply_proposals(view(s, d, "segments_v"), _planned(s, d)[0])[0]),
    "e1_assign_speakers": lambda s, d: _states(edits.assign_speakers(view(s, d, "segments_v"), _decisions(s, d))),
    "e2_unassign_clusters": lambda s, d: _states(edits.unassign_clusters(view(s, d, "segments_v"), view(s, d, "segments_v").filter("idx = 1").select(RID, "cluster"))),
    "e3_split_segments": lambda s, d: edits.split_segments(view(s, d, "segments_v"), _splits(s, d))[0].select(RID, "idx", "seg_start", "seg_end", "cluster", "speaker_id", "time_edited", F.md5(F.col("text").cast("binary")).alias("text")),
    "e4_merge_segments": lambda s, d: edits.merge_segments(view(s, d, "segments_v"), _merges(s, d))[0].select(RID, "idx", "seg_start", "seg_end", "cluster", "speaker_id", "note", "time_reviewed", F.md5(F.col("text").cast("binary")).alias("text")),
    "e5_apply_time_edits": lambda s, d: _times(edits.apply_time_edits(view(s, d, "segments_v"), _time_edits(s, d), view(s, d, "recordings_v"))),
    "e6_confirm_times": lambda s, d: _times(edits.confirm_times(view(s, d, "segments_v"), view(s, d, "segments_v").filter("idx % 2 = 0"), view(s, d, "recordings_v"))),
    "e6_revert_times": lambda s, d: _times(edits.revert_times(view(s, d, "segments_v").withColumn("seg_start", F.col("seg_start") + 3), view(s, d, "segments_v").filter("idx % 2 = 0"))),
    "e7_apply_text_edits": lambda s, d: edits.apply_text_edits(view(s, d, "segments_v"), view(s, d, "segments_v").filter("idx % 2 = 0").select(RID, "idx", F.when(F.col("idx") % 4 == 0, F.concat(F.lit(" "), "text")).otherwise("　new ").alias("new_text"))).select(RID, "idx", F.md5(F.col("text").cast("binary")).alias("text"), "text_edited"),
    "e8_set_offsets": lambda s, d: edits.set_offsets(view(s, d, "recordings_v"), view(s, d, "recordings_v").filter("recording_id % 3 > 0").select(RID, (F.col("recording_id") * 0.25 - 9).alias("new_offset"))).select(RID, "time_offset"),
    "e9_undo_batches": _undone,
    "e9_undo_after_splits": _undone_all,
    "e10_review_windows": lambda s, d: edits.review_windows(view(s, d, "segments_v"), view(s, d, "recordings_v"), back=1.0).select(RID, "idx", *[F.round(c, 6).alias(c) for c in ("play_from", "play_to", "tail_from", "tail_to")]),
    "e11_times": _formats,
}

_CONFLICT = """c AS (SELECT a.recording_id, a.id AS i, b.id AS j FROM proposals_v a JOIN proposals_v b ON a.recording_id = b.recording_id AND a.id <> b.id AND (a.p_start < b.p_start OR (a.p_start = b.p_start AND a.id < b.id)) AND b.p_start < a.p_end
  WHERE least(a.p_end, b.p_end) - b.p_start > 0.5 * greatest(0.1, least(a.p_end - a.p_start, b.p_end - b.p_start))), bad AS (SELECT recording_id, i AS id FROM c UNION SELECT recording_id, j FROM c)"""
_TIMES = "round({0}, 3) AS seg_start, round({1}, 3) AS seg_end"
_STATUS = "CASE id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END"
_HMS = "concat(lpad(CAST({0} // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({0} % 60 AS VARCHAR), 2, '0'))"
_CLAMP_END = "CASE WHEN b0 - a0 >= 0.1 THEN {x} WHEN a0 + 0.1 > duration THEN {y} ELSE {z} END"
_ORACLES = {
    "j2_parse_rosters": PARSED,
    "j2_rosters_to_text": "SELECT recording_id, string_agg(CASE WHEN note <> '' THEN concat(name, '(', note, ')') ELSE name END, chr(10) ORDER BY ord) AS text FROM speakers_v GROUP BY 1",
    "j3_merge_rosters": f"WITH {MATCHED} SELECT recording_id, coalesce(speaker_id, given) AS speaker_id, name, CASE WHEN coalesce(new_note, '') <> '' THEN new_note ELSE coalesce(old_note, '') END AS note, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY new_ord IS NULL, new_ord, old_ord) - 1 AS INT) AS ord FROM g",
    "j4_roster_plan": f"WITH {MATCHED}, af AS (SELECT recording_id, count(*) AS affected FROM segments_v WHERE (recording_id, speaker_id) IN (SELECT (recording_id, speaker_id) FROM g WHERE new_ord IS NULL) GROUP BY 1) SELECT recording_id, coalesce(string_agg(CASE WHEN given IS NOT NULL THEN name END, '|' ORDER BY new_ord), '') AS added, coalesce(string_agg(CASE WHEN new_ord IS NULL THEN name END, '|' ORDER BY old_ord), '') AS removed, coalesce(any_value(affected), 0) AS affected FROM g LEFT JOIN af USING (recording_id) GROUP BY 1",
    "j4_roster_applied": f"WITH {MATCHED} SELECT s.recording_id, s.idx, CASE WHEN g.name IS NULL THEN s.speaker_id END AS speaker_id, s.reviewed AND g.name IS NULL AS reviewed FROM segments_v s LEFT JOIN g ON g.new_ord IS NULL AND g.recording_id = s.recording_id AND g.speaker_id = s.speaker_id",
    "j5_remove_speakers": "SELECT recording_id, speaker_id, name, note, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY ord) - 1 AS INT) AS ord FROM speakers_v WHERE ord <> 1",
    "j5_remove_from_segments": "SELECT recording_id, idx, CASE WHEN speaker_id IS DISTINCT FROM 'sp02' THEN speaker_id END AS speaker_id, reviewed AND speaker_id IS DISTINCT FROM 'sp02' AS reviewed FROM segments_v",
    "j5b_add_speakers": "SELECT * FROM speakers_v UNION ALL SELECT recording_id, concat('sp', lpad(CAST(CASE WHEN n = 4 THEN i + 6 ELSE n + 1 + i END AS VARCHAR), 2, '0')), CASE i WHEN 0 THEN 'x' ELSE 'y' END, '', CAST(n + i AS INT) FROM (SELECT recording_id, count(*) AS n FROM speakers_v GROUP BY 1), range(2) AS t(i)",
    "j6_carry_over": f"WITH {CARRY} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY pos, seg_start, idx) - 1 AS idx, round(seg_start, 3) AS seg_start, speaker_id, reviewed, note, text_edited, time_edited, md5(text) AS text FROM rows3",
    "s4_words": "SELECT user_id AS recording_id, event_type AS text, event_id * 0.5 AS start, event_id * 0.5 + 0.25 AS \"end\", 'small' AS model FROM events",
    "s5_proposals": "SELECT p.recording_id, id, p_start, audio_fingerprint AS fingerprint FROM proposals_v p JOIN recordings_v USING (recording_id) WHERE audio_fingerprint <> ''",
    "j6_audit": f"""WITH {CARRY}, ab AS ({ABSORBED}), c AS (SELECT recording_id, count(*) FILTER (how <> 'new' AND speaker_id IS NOT NULL) AS carried, count(*) FILTER (how <> 'new' AND text_edited) AS texts, count(*) FILTER (how = 'replaced') AS replaced FROM rows3 GROUP BY 1)
      SELECT recording_id, coalesce(carried, 0) AS carried, coalesce(texts, 0) AS texts, coalesce(replaced, 0) AS replaced, coalesce(absorbed, 0) AS absorbed, coalesce(absorbed_at, '') AS absorbed_at FROM c FULL JOIN ab USING (recording_id)""",
    "j6_rerun": f"""WITH {CARRY}, {SAME}, wt AS ({WANTED.replace("{speakers_v} AS speakers_v", "speakers_v")})
      , r AS (SELECT recording_id FROM rerecorded_v UNION SELECT recording_id FROM recordings_v WHERE recording_id % 10 = 8)
      , sg AS (SELECT recording_id, speaker_id FROM rows3 WHERE recording_id IN (SELECT recording_id FROM same) UNION ALL SELECT recording_id, speaker_id FROM old_v WHERE recording_id % 10 = 8 UNION ALL SELECT recording_id, speaker_id FROM new_v WHERE recording_id % 10 <> 8 AND recording_id NOT IN (SELECT recording_id FROM same))
      , pp AS (SELECT recording_id, name FROM speakers_v WHERE recording_id % 10 <> 9 UNION SELECT recording_id, name FROM wt WHERE recording_id % 10 <> 8)
      , ed AS (SELECT recording_id, 2 * count(speaker_id) AS n FROM segments_v WHERE recording_id % 10 = 8 OR recording_id IN (SELECT recording_id FROM same) GROUP BY 1)
      SELECT r.recording_id, CAST(CASE WHEN r.recording_id % 10 = 8 THEN (SELECT doc_revision FROM recordings_v x WHERE x.recording_id = r.recording_id) ELSE coalesce((SELECT doc_revision FROM same WHERE same.recording_id = r.recording_id), 0) END AS INT) AS doc_revision,
             (SELECT count(*) FROM sg WHERE sg.recording_id = r.recording_id) AS segments, (SELECT count(speaker_id) FROM sg WHERE sg.recording_id = r.recording_id) AS assigned, (SELECT count(*) FROM pp WHERE pp.recording_id = r.recording_id) AS people, coalesce((SELECT n FROM ed WHERE ed.recording_id = r.recording_id), 0) AS edits FROM r""",
    "j7_target_segments": f"WITH {TARGETS} SELECT p.recording_id, p.id, tg.idx FROM proposals_v p LEFT JOIN tg USING (recording_id, id)",
    "j8_segment_at": "WITH p AS (SELECT DISTINCT recording_id, seg_start + idx * 7 % 23 AS t FROM segments_v) SELECT recording_id, t, idx FROM (SELECT p.recording_id, t, s.idx, row_number() OVER (PARTITION BY p.recording_id, t ORDER BY abs(s.seg_start - t), s.idx) AS k FROM p JOIN segments_v s USING (recording_id)) WHERE k = 1",
    "j9_drop_conflicts": f"WITH {_CONFLICT} SELECT recording_id, id FROM proposals_v WHERE (recording_id, id) NOT IN (SELECT (recording_id, id) FROM bad)",
    "j9_dropped": f"WITH {_CONFLICT} SELECT recording_id, id FROM bad",
    "j10_plan_proposals": f"WITH {PLANNED} SELECT * FROM pl",
    "j10_failed": f"WITH {PLANNED} SELECT recording_id, id FROM proposals_v WHERE (recording_id, id) NOT IN (SELECT (recording_id, id) FROM pl)",
    "j11_merge_history": f"SELECT recording_id, id FROM proposals_v WHERE NOT (id % 3 <> 0 AND {_STATUS} <> 'pending')",
    "j12_to_save": f"SELECT recording_id, id, CASE WHEN id % 3 <> 0 THEN {_STATUS} ELSE 'pending' END AS status FROM proposals_v",
    "j13_window_words": "SELECT s.recording_id, s.idx, count(*) FILTER (event_id * 0.5 + 0.5 < s.seg_start * 2) AS lo, greatest(count(*) FILTER (event_id * 0.5 + 0.5 < s.seg_start * 2), count(*) FILTER (event_id * 0.5 <= s.seg_start * 2 + 40)) AS hi FROM segments_ev s JOIN events e ON e.user_id = s.recording_id GROUP BY 1, 2",
    "i1_audio_spans": f"WITH {AUDIO} SELECT recording_id, idx, now_start, now_end FROM s",
    "i2_propose_times": f"WITH {REASONS} SELECT recording_id, idx, reason, CASE WHEN reason = 'proposal' THEN round(ps, 2) END AS p_start, CASE WHEN reason = 'proposal' THEN round(pe, 2) END AS p_end, CASE WHEN reason = 'proposal' THEN CASE WHEN coverage >= 0.9 THEN 'high' WHEN coverage >= 0.75 THEN 'mid' ELSE 'low' END END AS band FROM pr",
    "a12_inspect_summary": f"WITH {REASONS} SELECT recording_id, count(*) AS checked, count(*) FILTER (reason = 'proposal') AS proposals, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("unmatched", "reviewed", "short_match", "low_coverage", "scattered", "stretched", "head_lost", "close_enough")) + ", count(*) FILTER (reason IN ('low_coverage', 'short_match', 'scattered', 'stretched', 'head_lost')) AS weak FROM pr GROUP BY 1",
    "i5_apply_proposals": f"WITH {PLANNED} SELECT v.recording_id, v.idx, {_TIMES.format('coalesce(new_start, seg_start)', 'coalesce(new_end, seg_end)')}, new_start IS NOT NULL OR time_edited AS time_edited, CASE WHEN new_start IS NOT NULL THEN false ELSE time_reviewed END AS time_reviewed FROM segments_v v LEFT JOIN pl ON pl.recording_id = v.recording_id AND pl.idx = v.idx",
    "e1_assign_speakers": """WITH d AS (SELECT recording_id, idx, cluster, CASE WHEN idx % 4 = 3 THEN NULL ELSE 'sp05' END AS sp FROM segments_v WHERE (recording_id * 7 + idx) % 5 = 0), f AS (SELECT DISTINCT recording_id, cluster FROM d WHERE sp IS NOT NULL AND cluster NOT LIKE '%?' AND cluster NOT LIKE '%*')
      SELECT v.recording_id, v.idx, CASE WHEN d.idx IS NOT NULL THEN d.sp WHEN v.speaker_id IS NULL AND f.cluster IS NOT NULL THEN 'sp05' ELSE v.speaker_id END AS speaker_id, CASE WHEN d.idx IS NOT NULL THEN d.sp IS NOT NULL WHEN v.speaker_id IS NULL AND f.cluster IS NOT NULL THEN false ELSE v.reviewed END AS reviewed
      FROM segments_v v LEFT JOIN d ON d.recording_id = v.recording_id AND d.idx = v.idx LEFT JOIN f ON f.recording_id = v.recording_id AND f.cluster = v.cluster""",
    "e2_unassign_clusters": "WITH c AS (SELECT recording_id, cluster FROM segments_v WHERE idx = 1) SELECT v.recording_id, v.idx, CASE WHEN c.cluster IS NULL THEN speaker_id END AS speaker_id, CASE WHEN c.cluster IS NOT NULL AND speaker_id IS NOT NULL THEN false ELSE reviewed END AS reviewed FROM segments_v v LEFT JOIN c ON c.recording_id = v.recording_id AND c.cluster = v.cluster",
    "e3_split_segments": """WITH x AS (SELECT *, idx % 3 = 1 AS cut_here, least(greatest(seg_start + idx % 4 * 6, seg_start + 0.1), seg_end - 0.1) AS mid, least(idx * 5, length(text)) AS cut FROM segments_v)
      , y AS (SELECT recording_id, idx AS i, 0 AS part, seg_start, CASE WHEN cut_here THEN mid ELSE seg_end END AS seg_end, cluster, speaker_id, time_edited OR cut_here AS time_edited, CASE WHEN cut_here THEN substr(text, 1, cut) ELSE text END AS text FROM x
             UNION ALL SELECT recording_id, idx, 1, mid, seg_end, concat(chunk, ':?'), NULL, true, substr(text, cut + 1) FROM x WHERE cut_here)
      SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY i, part) - 1 AS idx, seg_start, seg_end, cluster, speaker_id, time_edited, md5(text) AS text FROM y""",
    "e4_merge_segments": """WITH x AS (SELECT *, idx % 4 IN (0, 2) AND lead(idx) OVER w IS NOT NULL AS takes, lead(seg_end) OVER w AS e, lead(text) OVER w AS t, lead(speaker_id) OVER w AS s, lead(note) OVER w AS n, lead(time_reviewed) OVER w AS r FROM segments_v WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
      , y AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY recording_id ORDER BY idx), false) AS gone FROM x)
      SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY idx) - 1 AS idx, seg_start, CASE WHEN takes THEN greatest(seg_end, e) ELSE seg_end END AS seg_end, cluster, CASE WHEN NOT takes OR speaker_id = s THEN speaker_id END AS speaker_id,
             CASE WHEN takes THEN concat_ws(' / ', nullif(note, ''), nullif(n, '')) ELSE note END AS note, CASE WHEN takes THEN time_reviewed AND r ELSE time_reviewed END AS time_reviewed, md5(CASE WHEN takes THEN concat(text, t) ELSE text END) AS text FROM y WHERE NOT gone""",
    "e5_apply_time_edits": f"""WITH {AUDIO}, d AS (SELECT *, CASE (recording_id + idx) % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'shift' END AS op, CASE (recording_id + idx) % 3 WHEN 2 THEN (recording_id % 9) * 5.0 - 20.0 ELSE seg_start + (recording_id % 5) * 8.0 - 8.0 END AS v, recording_id % 2 = 0 AS slide, greatest(0.1, now_end - now_start) AS span FROM s)
      , q AS (SELECT *, CASE op WHEN 'start' THEN v WHEN 'end' THEN CASE WHEN slide AND v < now_start + 0.1 THEN v - span ELSE now_start END END AS a1, CASE op WHEN 'end' THEN v WHEN 'start' THEN CASE WHEN slide AND v > now_end - 0.1 THEN v + span ELSE now_end END END AS b1 FROM d)
      , z AS (SELECT *, least(greatest(0, round(a1, 1)), duration) AS a0, least(greatest(0, round(b1, 1)), duration) AS b0, greatest(0, round(now_start + v, 1)) AS sh FROM q)
      , o AS (SELECT *, CASE op WHEN 'start' THEN CASE WHEN b0 - a0 >= 0.1 THEN a0 ELSE greatest(0, round(b0 - 0.1, 1)) END WHEN 'end' THEN {_CLAMP_END.format(x='a0', y='greatest(0, round(duration - 0.1, 1))', z='a0')} ELSE CASE WHEN sh + span > duration THEN greatest(0, round(duration - span, 1)) ELSE sh END END AS ns,
                        CASE op WHEN 'start' THEN CASE WHEN b0 - a0 >= 0.1 THEN b0 WHEN round(b0 - 0.1, 1) < 0 THEN 0.1 ELSE b0 END WHEN 'end' THEN {_CLAMP_END.format(x='b0', y='duration', z='round(a0 + 0.1, 1)')} ELSE CASE WHEN sh + span > duration THEN duration ELSE round(sh + span, 1) END END AS ne FROM z)
      SELECT recording_id, idx, {_TIMES.format('CASE WHEN idx % 2 = 0 THEN ns ELSE seg_start END', 'CASE WHEN idx % 2 = 0 THEN ne ELSE seg_end END')}, time_edited OR idx % 2 = 0 AS time_edited, CASE WHEN idx % 2 = 0 THEN true ELSE time_reviewed END AS time_reviewed FROM o""",
    "e6_confirm_times": f"WITH {AUDIO} SELECT recording_id, idx, {_TIMES.format('CASE WHEN idx % 2 = 0 THEN now_start ELSE seg_start END', 'CASE WHEN idx % 2 = 0 THEN now_end ELSE seg_end END')}, time_edited OR idx % 2 = 0 AS time_edited, CASE WHEN idx % 2 = 0 THEN true ELSE time_reviewed END AS time_reviewed FROM s",
    "e6_revert_times": f"SELECT recording_id, idx, {_TIMES.format('CASE WHEN idx % 2 = 0 AND time_edited THEN orig_start ELSE seg_start + 3 END', 'CASE WHEN idx % 2 = 0 AND time_edited THEN orig_end ELSE seg_end END')}, time_edited AND idx % 2 = 1 AS time_edited, CASE WHEN idx % 2 = 0 AND time_edited THEN false ELSE time_reviewed END AS time_reviewed FROM segments_v",
    "e7_apply_text_edits": "WITH x AS (SELECT *, CASE WHEN idx % 2 = 1 THEN text WHEN idx % 4 = 0 THEN regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g') ELSE 'new' END AS t FROM segments_v) SELECT recording_id, idx, md5(t) AS text, text_edited OR t <> text AS text_edited FROM x",
    "e8_set_offsets": "SELECT recording_id, CASE WHEN recording_id % 3 > 0 THEN greatest(-10.0, least(10.0, round(recording_id * 0.25 - 9, 2))) ELSE time_offset END AS time_offset FROM recordings_v",
    "e9_undo_batches": "SELECT recording_id, idx, CASE WHEN speaker_id IS NULL THEN NULL WHEN idx % 5 IN (0, 1) THEN CASE WHEN idx % 3 = 1 THEN NULL ELSE 'sp01' END ELSE speaker_id END AS speaker_id FROM segments_v",
    "e9_undo_after_splits": """WITH g AS (SELECT recording_id, idx, recording_id % 2 = 0 AS sp, recording_id % 6 = 0 AS mg FROM segments_v)
      , a AS (SELECT *, CASE WHEN sp AND idx > 2 THEN idx + 1 ELSE idx END AS i1 FROM g), m AS (SELECT *, CASE WHEN NOT mg THEN i1 WHEN i1 = 5 THEN NULL WHEN i1 > 4 THEN i1 - 1 ELSE i1 END AS i2 FROM a)
      , one AS (SELECT recording_id, i2 AS idx, idx AS was FROM m WHERE i2 IS NOT NULL), late AS (SELECT recording_id, idx FROM g WHERE idx % 5 = 0)
      , sp AS (SELECT coalesce(o.recording_id, l.recording_id) AS recording_id, coalesce(o.idx, l.idx) AS idx, o.was % 3 = 1 AS early, o.was IS NOT NULL AS has, l.idx IS NOT NULL AS again FROM one o FULL JOIN late l ON o.recording_id = l.recording_id AND o.idx = l.idx)
      SELECT v.recording_id, v.idx, CASE WHEN sp.early THEN 'first' WHEN sp.again AND sp.has THEN 'second' WHEN sp.again THEN 'second' ELSE v.speaker_id END AS speaker_id, CASE WHEN o.was % 3 = 1 THEN true ELSE v.reviewed END AS reviewed,
             round(CASE WHEN v.recording_id % 2 = 1 AND v.idx % 4 < 2 THEN v.idx * 2 ELSE v.seg_start END, 3) AS seg_start, round(CASE WHEN v.recording_id % 2 = 1 AND v.idx % 4 < 2 THEN v.idx * 2 + 1 ELSE v.seg_end END, 3) AS seg_end,
             (v.recording_id % 2 = 1 AND v.idx % 4 < 2) OR v.time_edited AS time_edited, (v.recording_id % 2 = 1 AND v.idx % 4 < 2) OR v.time_reviewed AS time_reviewed, md5(CASE WHEN o.was % 2 = 0 THEN concat('was ', o.was) ELSE v.text END) AS text
      FROM segments_v v LEFT JOIN sp ON sp.recording_id = v.recording_id AND sp.idx = v.idx LEFT JOIN one o ON o.recording_id = v.recording_id AND o.idx = v.idx""",
    "e10_review_windows": f"""WITH {AUDIO}, n AS (SELECT *, greatest(8.0, least(60.0, least(120.0, greatest(1.0, length(regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g')) / 4.5)) + 5)) AS need, CASE WHEN time_edited THEN 0 ELSE time_offset END AS shift FROM s)
      SELECT recording_id, idx, round(greatest(0, seg_start + shift - 1), 6) AS play_from, round(CASE WHEN time_edited THEN seg_end ELSE seg_start + least(greatest(seg_end - seg_start, 1.5), need) END + shift, 6) AS play_to, round(greatest(0, now_end - least(3.0, greatest(0.1, now_end - now_start))), 6) AS tail_from, round(now_end, 6) AS tail_to FROM n""",
    "e11_times": f"""WITH x AS (SELECT event_id, CAST(event_id * 7.25 + 0.5 AS DOUBLE) AS t, CAST(round_even(event_id * 7.25 + 0.5, 0) AS BIGINT) AS r, CAST(round_even((event_id * 7.25 + 0.5) * 10, 0) AS BIGINT) AS z FROM events)
      SELECT event_id, {_HMS.format('r')} AS hms, CASE WHEN r >= 3600 THEN {_HMS.format('r')} ELSE concat(lpad(CAST(r // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(r % 60 AS VARCHAR), 2, '0')) END AS ms, concat({_HMS.format('(z // 10)')}, '.', z % 10) AS tenths, CAST(z / 10.0 AS DOUBLE) AS back, CAST(NULL AS DOUBLE) AS bad FROM x""",
}
ORACLES = {name: with_views(sql) for name, sql in _ORACLES.items()}
