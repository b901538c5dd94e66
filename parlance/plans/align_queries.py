"""Queries over text and measured words."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import alignment, jobs, proposals
from parlance.plans.views import view, with_views

RID = "recording_id"


def words_of(s, d):
    """One word for each letter of a turn: an eighth of a second each, or less where the turn would last over 7.5 seconds."""
    turns = view(s, d, "conversations").select("conv_id", "turn", alignment.normalized(F.col("text")).alias("norm"))
    chars = turns.select(F.col("conv_id").alias(RID), "turn", F.greatest(F.char_length("norm"), F.lit(60)).alias("n"), F.posexplode(F.split("norm", "")).alias("k", "text")).filter("text <> ''")
    at = lambda k: F.col("turn") * 20 + k * F.lit(7.5) / F.col("n")
    return chars.select(RID, "text", at(F.col("k")).cast("double").alias("start"), at(F.col("k") + 1).cast("double").alias("end"))


def drifted(s, d):
    """Segments of the same letters, all but the first of a recording 7 seconds late."""
    turns = view(s, d, "conversations").select("conv_id", "turn", alignment.normalized(F.col("text")).alias("norm"))
    start = F.col("turn") * 20 + F.when(F.col("turn") > 0, 7).otherwise(0)
    return turns.select(F.col("conv_id").alias(RID), F.col("turn").alias("idx"), F.col("norm").alias("text"), start.cast("double").alias("now_start"), (start + 8).cast("double").alias("now_end"))


def _runs(s, d):
    """All runs, by segment: how many, their letters, the longest, and a sum over their places."""
    spans = drifted(s, d).withColumnRenamed("text", "norm")
    runs = alignment.anchor_runs(spans, alignment.build_track(words_of(s, d)))
    place = (F.col("a") * 31 + (F.col("b") - F.col("a")) * 17) * F.col("len")
    return runs.groupBy(RID, "idx").agg(F.count("*").alias("runs"), F.sum("len").alias("letters"), F.max("len").alias("longest"), F.sum(place).alias("places"))


def _measured(s, d):
    return alignment.measure_segments(drifted(s, d), words_of(s, d)).select(RID, "idx", F.round("coverage", 6).alias("coverage"), "matched", "total", F.round("m_start", 3).alias("m_start"))


def _each_measured(s, d):
    """Segments without two of their letters where they are long enough, each measured within 30 seconds."""
    spans = drifted(s, d).withColumn("text", F.regexp_replace("text", "(?s)^(.{59}).(.{99}).", "$1$2"))
    return alignment.measure_windows(spans, words_of(s, d)).select(RID, "idx", F.round("coverage", 6).alias("coverage"), "matched", "total", "head_gap", "tail_gap", F.round("m_start", 3).alias("m_start"), F.round("m_end", 3).alias("m_end"))


def _ids(s, d):
    """Ids of the proposals for all segments as they are."""
    rows = view(s, d, "proposals_v")
    return rows.select(RID, "id", proposals.proposal_id(F.lit("time"), F.col("target_orig_start"), F.col("p_start"), F.col("p_end")).alias("proposal_id"))


def _inspection(s, d):
    """Proposals for segments that lie late in the audio."""
    spans = drifted(s, d)
    rows = view(s, d, "segments_v").drop("text", "seg_start", "seg_end", "orig_start", "time_edited", "time_reviewed").join(spans.select(RID, "idx", "text", F.col("now_start").alias("seg_start"), F.col("now_end").alias("seg_end")), [RID, "idx"])
    rows = rows.withColumns({"time_edited": F.lit(True), "time_reviewed": F.lit(False), "orig_start": F.col("seg_start")})
    every, _ = jobs.inspect_times(rows, view(s, d, "recordings_v"), words_of(s, d))
    return every.select(RID, "idx", "id", F.round("p_start", 3).alias("start"))


_NORM = r"regexp_replace(text, '[\p{Z}\p{C}\p{P}\p{S}]', '', 'g')"
_CHARS = f"""n AS (SELECT conv_id AS recording_id, turn, {_NORM} AS h FROM conversations)
  , ch AS (SELECT recording_id, turn, unnest(range(length(h))) AS k, unnest(string_split(h, '')) AS c, greatest(length(h), 60) AS n FROM n WHERE h <> '')
  , track AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY turn, k) - 1 AS pos, c AS ch, CAST(turn * 20 + k * 7.5 / n AS DOUBLE) AS c_start, CAST(turn * 20 + (k + 1) * 7.5 / n AS DOUBLE) AS c_end FROM ch)"""

#: Maximal runs of what is {heard} of each turn in the track, as anchor_runs finds them.
_RUNS = """
          , g AS (SELECT * FROM (SELECT recording_id, pos AS b, concat(ch, lead(ch) OVER w, lead(ch, 2) OVER w) AS gram, c_end, lead(c_start, 2) OVER w AS last_start FROM track WINDOW w AS (PARTITION BY recording_id ORDER BY pos)) WHERE length(gram) = 3)
          , s AS (SELECT * FROM (SELECT recording_id, turn AS idx, {heard} AS h, turn * 20 + CASE WHEN turn > 0 THEN 7 ELSE 0 END AS now_start FROM n) WHERE length(h) >= 3)
          , q AS (SELECT recording_id, idx, now_start - 30 AS t0, now_start + 8 + 30 AS t1, unnest(range(length(h) - 2)) AS a, unnest(list_transform(range(1, length(h) - 1), lambda k: substr(h, k, 3))) AS gram FROM s)
          , hit AS (SELECT q.recording_id, idx, a, b, b - a AS d FROM q JOIN g USING (recording_id, gram) WHERE c_end >= t0 AND last_start <= t1)
          , isl AS (SELECT *, a - row_number() OVER (PARTITION BY recording_id, idx, d ORDER BY a) AS run FROM hit)
          , runs AS (SELECT recording_id, idx, d, min(a) AS a, count(*) + 2 AS len FROM isl GROUP BY recording_id, idx, d, run)"""

QUERIES = {
    "n1_normalize_corpus": lambda s, d: alignment.normalize_corpus(view(s, d, "conversations")).select("conv_id", "turn", F.md5(F.col("norm").cast("binary")).alias("norm"), F.size("origin").alias("n")),
    "n2_build_track": lambda s, d: alignment.build_track(words_of(s, d)).select(RID, "pos", "ch", F.round("c_start", 6).alias("c_start"), F.round("c_end", 6).alias("c_end")),
    "n3_anchor_runs": _runs,
    "n4_measure": _each_measured,
    "n5_measure_segments": _measured,
    "i3_proposal_id": _ids,
    "n6_contamination_rate": lambda s, d: alignment.contamination_rate(view(s, d, "documents"), view(s, d, "benchmark")).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage")),
    "i6_inspection": _inspection,
}

ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "n1_normalize_corpus": f"SELECT conv_id, turn, md5({_NORM}) AS norm, CAST(length({_NORM}) AS INT) AS n FROM conversations",
        "n2_build_track": f"WITH {_CHARS} SELECT recording_id, pos, ch, round(c_start, 6) AS c_start, round(c_end, 6) AS c_end FROM track",
        "n3_anchor_runs": f"""WITH {_CHARS} {_RUNS.format(heard="h")}
          SELECT recording_id, idx, count(*) AS runs, CAST(sum(len) AS BIGINT) AS letters, max(len) AS longest, CAST(sum((a * 31 + d * 17) * len) AS BIGINT) AS places FROM runs GROUP BY recording_id, idx""",
        "i3_proposal_id": "SELECT recording_id, id, substr(sha256(concat('time|', format('{:.3f}', CAST(target_orig_start AS DOUBLE)), '|', format('{:.2f}', p_start), '|', format('{:.2f}', p_end))), 1, 12) AS proposal_id FROM proposals_v",
        "n6_contamination_rate": f"""WITH d AS (SELECT doc_id, {_NORM} AS n FROM documents), i AS (SELECT item_id, {_NORM} AS n FROM benchmark)
          , ig AS (SELECT item_id, length(n) AS total, unnest(list_transform(range(1, length(n) - 18), lambda k: substr(n, k, 20))) AS g, unnest(range(1, length(n) - 18)) AS p FROM i WHERE length(n) >= 20)
          , dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(n) - 18), lambda k: substr(n, k, 20))) AS g FROM d WHERE length(n) >= 20)
          , h AS (SELECT doc_id, item_id, total, p, lag(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS q FROM ig JOIN dg USING (g))
          SELECT * FROM (SELECT doc_id, item_id, round(CAST(sum(least(20, coalesce(p - q, 20))) AS DOUBLE) / any_value(total), 6) AS coverage FROM h GROUP BY 1, 2) WHERE coverage >= 0.6""",
    }.items()
}

#: The measurement in SQL: the longest run, then what is left and right of it, again and again. Correct, but at some thousand runs a segment too slow for whole tables, so
#: tests hold a small folder against it.
MEASURED_SQL = with_views(
    f"""WITH RECURSIVE {_CHARS} {_RUNS.format(heard="regexp_replace(h, '^(.{59}).(.{99}).', '\\1\\2')")}
    , r AS MATERIALIZED (SELECT recording_id, idx, a, a + d AS b, len FROM runs)
    , frame AS MATERIALIZED (SELECT recording_id, idx, length(h) AS total, (SELECT count(*) FROM track t WHERE t.recording_id = s.recording_id AND c_end < now_start - 30) AS lo, (SELECT count(*) FROM track t WHERE t.recording_id = s.recording_id AND c_start <= now_start + 38) AS hi FROM s)
    , cut AS (
      SELECT f.recording_id, f.idx, max(row(n, -a, -b)) AS best, 0 AS a0, total AS a1, lo AS b0, hi AS b1
      FROM (SELECT f.*, a, b, len AS n FROM frame f JOIN r USING (recording_id, idx)) f GROUP BY f.recording_id, f.idx, total, lo, hi
      UNION ALL
      SELECT recording_id, idx, max(row(n, -a, -b)) AS best, a0, a1, b0, b1 FROM (
        SELECT q.recording_id, q.idx, q.a0, q.a1, q.b0, q.b1, r.a + skip AS a, r.b + skip AS b, least(r.a + r.len, q.a1, r.a + q.b1 - r.b) - r.a - skip AS n
        FROM (SELECT recording_id, idx, CASE side WHEN 0 THEN a0 ELSE best[1] - best[2] END AS a0, CASE side WHEN 0 THEN -best[2] ELSE a1 END AS a1, CASE side WHEN 0 THEN b0 ELSE best[1] - best[3] END AS b0, CASE side WHEN 0 THEN -best[3] ELSE b1 END AS b1
              FROM cut, (VALUES (0), (1)) v(side)
              WHERE CASE side WHEN 0 THEN least(-best[2] - a0, -best[3] - b0) ELSE least(a1 + best[2] - best[1], b1 + best[3] - best[1]) END >= 3) q JOIN r USING (recording_id, idx), LATERAL (SELECT greatest(0, q.a0 - r.a, q.b0 - r.b) AS skip) k) x
      WHERE n >= 3 GROUP BY recording_id, idx, a0, a1, b0, b1)
    , blocks AS (SELECT recording_id, idx, best[1] AS n, -best[2] AS a, -best[3] AS b FROM cut)
    , ends AS (SELECT recording_id, idx, CAST(sum(n) AS BIGINT) AS matched, min(a) AS head, min(b) AS first, arg_max(b + n - 1, a) AS last, max(a + n) AS tail FROM blocks GROUP BY ALL)
    SELECT e.recording_id, e.idx, round(matched / total, 6) AS coverage, matched, CAST(total AS BIGINT) AS total, CAST(head AS BIGINT) AS head_gap, CAST(total - tail AS BIGINT) AS tail_gap, round(x.c_start, 3) AS m_start, round(y.c_end, 3) AS m_end
    FROM ends e JOIN frame USING (recording_id, idx) JOIN track x ON x.recording_id = e.recording_id AND x.pos = first JOIN track y ON y.recording_id = e.recording_id AND y.pos = last"""
)
