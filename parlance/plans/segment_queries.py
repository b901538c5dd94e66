"""Queries over segments: counts, votes, neighbours and ranked candidates."""

from __future__ import annotations

from parlance.operators import ranking, stats
from parlance.plans.views import view, with_views


def on(operator, *views, **options):
    """A query that applies an operator to whole views."""
    return lambda spark, sf_dir: operator(*(view(spark, sf_dir, v) for v in views), **options)


def _rounded(df):
    from pyspark.sql import functions as F

    return df.withColumn("score", F.round("score", 6)).drop("reasons")


SPECIAL = "('__unknown__', '__multi__', '__noise__')"
#: Label and kind of a cluster, and the speaker if a person, for SQL on segments.
BASE = f"""
WITH s AS (SELECT *, substr(cluster, instr(cluster, ':') + 1) AS label, substr(cluster, instr(cluster, ':') + 1) IN ('?', '*') AS pseudo,
                  CASE WHEN speaker_id NOT IN {SPECIAL} THEN speaker_id END AS person FROM %s)
"""

RANK = BASE + """
, n AS (SELECT *, coalesce(lag(person, 1) OVER w, lag(person, 2) OVER w, lag(person, 3) OVER w) AS prv, coalesce(lead(person, 1) OVER w, lead(person, 2) OVER w, lead(person, 3) OVER w) AS nxt,
               coalesce(CASE WHEN lag(chunk) OVER w <> chunk THEN lag(person) OVER w END, CASE WHEN lead(chunk) OVER w <> chunk THEN lead(person) OVER w END) AS bnd, lead(person) OVER w AS follower
        FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
, cv AS (SELECT recording_id, cluster, label, person, count(*) AS c FROM s WHERE person IS NOT NULL AND NOT pseudo GROUP BY ALL)
, ct AS (SELECT recording_id, cluster, sum(c) AS t FROM cv GROUP BY ALL)
, lv AS (SELECT recording_id, label, person, sum(c) AS c FROM cv GROUP BY ALL)
, el AS (SELECT v.recording_id, v.cluster, lv.person, lv.c - coalesce(cv.c, 0) AS c FROM (SELECT DISTINCT recording_id, cluster, label FROM s WHERE NOT pseudo) v
         JOIN lv USING (recording_id, label) LEFT JOIN cv ON cv.recording_id = v.recording_id AND cv.cluster = v.cluster AND cv.person = lv.person WHERE lv.c > coalesce(cv.c, 0))
, et AS (SELECT recording_id, cluster, sum(c) AS t FROM el GROUP BY ALL)
, mv AS (SELECT recording_id, person AS a, follower AS b, count(*) AS c FROM n WHERE person IS NOT NULL AND follower IS NOT NULL GROUP BY ALL)
, ft AS (SELECT recording_id, a, sum(c) AS t FROM mv GROUP BY ALL)
, bt AS (SELECT recording_id, b, sum(c) AS t FROM mv GROUP BY ALL)
, fr AS (SELECT recording_id, person, count(*) AS c FROM s WHERE person IS NOT NULL GROUP BY ALL)
, fs AS (SELECT recording_id, sum(c) AS t FROM fr GROUP BY ALL)
, sp AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS m, row_number() OVER (PARTITION BY recording_id ORDER BY ord) - 1 AS place FROM %s)
, j AS (SELECT n.recording_id, n.idx, sp.speaker_id, sp.ord, sp.m, sp.place, n.prv, n.bnd,
               coalesce(cv.c, 0) - CASE WHEN NOT n.pseudo AND n.person = sp.speaker_id THEN 1 ELSE 0 END AS c1, coalesce(ct.t, 0) - CASE WHEN NOT n.pseudo AND n.person IS NOT NULL THEN 1 ELSE 0 END AS t1,
               coalesce(el.c, 0) AS c3, coalesce(et.t, 0) AS t3, coalesce(f.c, 0) AS c4, coalesce(ft.t, 0) AS t4, coalesce(b.c, 0) AS c5, coalesce(bt.t, 0) AS t5, coalesce(fr.c, 0) AS c6, coalesce(fs.t, 0) AS t6
        FROM n JOIN sp USING (recording_id)
        LEFT JOIN cv ON cv.recording_id = n.recording_id AND cv.cluster = n.cluster AND cv.person = sp.speaker_id LEFT JOIN ct ON ct.recording_id = n.recording_id AND ct.cluster = n.cluster
        LEFT JOIN el ON el.recording_id = n.recording_id AND el.cluster = n.cluster AND el.person = sp.speaker_id LEFT JOIN et ON et.recording_id = n.recording_id AND et.cluster = n.cluster
        LEFT JOIN mv f ON f.recording_id = n.recording_id AND f.a = n.prv AND f.b = sp.speaker_id LEFT JOIN ft ON ft.recording_id = n.recording_id AND ft.a = n.prv
        LEFT JOIN mv b ON b.recording_id = n.recording_id AND b.b = n.nxt AND b.a = sp.speaker_id LEFT JOIN bt ON bt.recording_id = n.recording_id AND bt.b = n.nxt
        LEFT JOIN fr ON fr.recording_id = n.recording_id AND fr.person = sp.speaker_id LEFT JOIN fs ON fs.recording_id = n.recording_id)
, r AS (SELECT *, CASE WHEN t1 > 0 AND c1 > 0 THEN 100.0 * c1 / t1 ELSE 0 END + CASE WHEN bnd = speaker_id THEN 45.0 ELSE 0 END + CASE WHEN t3 > 0 THEN 20.0 * least(1.0, t3 / 4.0) * c3 / t3 ELSE 0 END
                 + CASE WHEN t4 > 0 THEN 25.0 * least(1.0, t4 / 8.0) * c4 / t4 ELSE 0 END - CASE WHEN prv = speaker_id AND t4 < 6 AND prv IS DISTINCT FROM bnd THEN 8.0 ELSE 0 END
                 + CASE WHEN t5 > 0 THEN 15.0 * least(1.0, t5 / 8.0) * c5 / t5 ELSE 0 END + CASE WHEN t6 > 0 THEN 10.0 * least(1.0, t6 / 10.0) * c6 / t6 ELSE 0 END + 1.0 * (m - place) / m AS sc FROM j)
, ranked AS (SELECT recording_id, idx, speaker_id, CAST(round(sc, 6) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY recording_id, idx ORDER BY round(sc, 9) DESC, ord) AS INT) AS rank FROM r)
"""


def _best_of_open(spark, sf_dir):
    segments = view(spark, sf_dir, "segments_v")
    ranked = ranking.top_candidates(ranking.rank_candidates(segments, view(spark, sf_dir, "speakers_v")), 1)
    return _rounded(ranked.join(segments.filter("speaker_id is null").select("recording_id", "idx"), ["recording_id", "idx"], "left_semi"))


def _window(extra: str, table: str = "segments_v") -> str:
    return (BASE % table) + f" SELECT recording_id, idx, {extra} FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY idx)"


def _pick(operator, *columns, views=("segments_v",), **options):
    return lambda spark, sf_dir: operator(*(view(spark, sf_dir, v) for v in views), **options).select("recording_id", "idx", *columns)


_ASSIGNED, _HEARD = "speaker_id IS NOT NULL", "speaker_id IS NOT NULL AND reviewed"
_TITLE = "concat('C', CAST(split_part(cluster, ':', 1) AS INT) + 1, '-', label)"

QUERIES = {
    "a1_progress": on(stats.progress, "segments_v"),
    "a1_progress_events": on(stats.progress, "segments_ev"),
    "a2_clusters": on(stats.clusters, "segments_v"),
    "a3_cluster_votes": on(stats.cluster_votes, "segments_v"),
    "a4_letter_votes": on(stats.letter_votes, "segments_v"),
    "a5_speaker_frequency": on(stats.speaker_frequency, "segments_v"),
    "a6_transitions": on(stats.transitions, "segments_v"),
    "a6_transitions_events": on(stats.transitions, "segments_ev"),
    "a7_dominant_speaker": on(stats.dominant_speaker, "segments_v"),
    "a8_cluster_summary": on(stats.cluster_summary, "segments_v", "speakers_v"),
    "a9_remaining_work": on(stats.remaining_work, "segments_v"),
    "j1_resolve_speakers": _pick(stats.resolve_speakers, "speaker_id", "speaker_name", views=("segments_v", "speakers_v")),
    "w1_prev_assigned": _pick(stats.prev_assigned, "prev_speaker"),
    "w1_next_assigned": _pick(stats.next_assigned, "next_speaker"),
    "w2_boundary_partner": _pick(stats.boundary_partner, "boundary_speaker"),
    "w3_rank_candidates": lambda spark, d: _rounded(ranking.rank_candidates(view(spark, d, "segments_v"), view(spark, d, "speakers_v"))),
    "w3_rank_candidates_events": lambda spark, d: _rounded(ranking.rank_candidates(view(spark, d, "segments_ev"), view(spark, d, "speakers_ev"))),
    "w4_top_candidates": _best_of_open,
    "w5_next_unassigned": _pick(stats.next_unassigned, "next_index"),
    "w5_previous_unreviewed": _pick(stats.next_unreviewed, "next_index", forward=False),
    "w6_filter_unreviewed": _pick(stats.filter_view, "speaker_id", mode="unreviewed"),
    "e12_row_state": on(stats.row_state, "segments_v"),
}

_ORACLES = {
    "a1_progress": f"SELECT recording_id, count(*) AS total, count(speaker_id) AS assigned, count(*) FILTER ({_HEARD}) AS reviewed, count(*) FILTER ({_ASSIGNED} AND NOT reviewed) AS unreviewed, CAST(round_even(count(speaker_id) * 100.0 / count(*), 0) AS BIGINT) AS pct FROM segments_v GROUP BY 1",
    "a2_clusters": "SELECT recording_id, cluster, min(idx) AS first_idx, count(*) AS n FROM segments_v GROUP BY 1, 2",
    "a3_cluster_votes": (BASE % "segments_v") + "SELECT recording_id, cluster, speaker_id, count(*) AS n, min(idx) AS first_idx FROM s WHERE speaker_id IS NOT NULL AND NOT pseudo GROUP BY 1, 2, 3",
    "a4_letter_votes": (BASE % "segments_v") + "SELECT recording_id, label, speaker_id, count(*) AS n FROM s WHERE person IS NOT NULL AND NOT pseudo GROUP BY 1, 2, 3",
    "a5_speaker_frequency": (BASE % "segments_v") + "SELECT recording_id, speaker_id, count(*) AS n FROM s WHERE person IS NOT NULL GROUP BY 1, 2",
    "a6_transitions": (BASE % "segments_v") + "SELECT recording_id, a, b, count(*) AS n FROM (SELECT recording_id, person AS a, lead(person) OVER (PARTITION BY recording_id ORDER BY idx) AS b FROM s) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3",
    "a7_dominant_speaker": (BASE % "segments_v") + "SELECT recording_id, cluster, person AS speaker_id, n FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, cluster ORDER BY n DESC, f) AS k FROM (SELECT recording_id, cluster, person, count(*) AS n, min(idx) AS f FROM s WHERE person IS NOT NULL AND NOT pseudo GROUP BY 1, 2, 3)) WHERE k = 1",
    "a8_cluster_summary": (BASE % "segments_v") + f""", v AS (SELECT recording_id, cluster, speaker_id, count(*) AS n, min(idx) AS f FROM s WHERE speaker_id IS NOT NULL AND NOT pseudo GROUP BY 1, 2, 3)
      , t AS (SELECT v.recording_id, cluster, string_agg(concat(coalesce(CASE speaker_id WHEN '__noise__' THEN '発言なし・雑音' WHEN '__multi__' THEN '発言者複数・重複' WHEN '__unknown__' THEN '発言者不明' END, name, speaker_id), '×', n), ', ' ORDER BY n DESC, f) AS votes FROM v LEFT JOIN speakers_v USING (recording_id, speaker_id) GROUP BY 1, 2)
      SELECT recording_id, cluster, concat(n, '区間 / ', CASE label WHEN '?' THEN '判別不能のため一括適用は不可' WHEN '*' THEN '複数人が同時のため一括適用は不可' ELSE coalesce(votes, '未確定') END) AS summary FROM (SELECT recording_id, cluster, label, count(*) AS n FROM s GROUP BY 1, 2, 3) LEFT JOIN t USING (recording_id, cluster)""",
    "a9_remaining_work": (BASE % "segments_v") + f", x AS (SELECT recording_id, CASE WHEN speaker_id IS NULL THEN 'unassigned' WHEN NOT reviewed THEN 'unreviewed' END AS state, {_TITLE} AS label, idx FROM s) SELECT recording_id, state, label, count(*) AS n, min(idx) AS first_idx FROM x WHERE state IS NOT NULL GROUP BY GROUPING SETS ((recording_id, state, label), (recording_id, state))",
    "j1_resolve_speakers": "SELECT recording_id, idx, speaker_id, coalesce(CASE speaker_id WHEN '__noise__' THEN '発言なし・雑音' WHEN '__multi__' THEN '発言者複数・重複' WHEN '__unknown__' THEN '発言者不明' END, name) AS speaker_name FROM segments_v LEFT JOIN (SELECT recording_id, speaker_id, name FROM speakers_v) USING (recording_id, speaker_id)",
    "w1_prev_assigned": _window("coalesce(lag(person, 1) OVER w, lag(person, 2) OVER w, lag(person, 3) OVER w) AS prev_speaker"),
    "w1_next_assigned": _window("coalesce(lead(person, 1) OVER w, lead(person, 2) OVER w, lead(person, 3) OVER w) AS next_speaker"),
    "w2_boundary_partner": _window("coalesce(CASE WHEN lag(chunk) OVER w <> chunk THEN lag(person) OVER w END, CASE WHEN lead(chunk) OVER w <> chunk THEN lead(person) OVER w END) AS boundary_speaker"),
    "w3_rank_candidates": (RANK % ("segments_v", "speakers_v")) + "SELECT * FROM ranked",
    "w3_rank_candidates_events": (RANK % ("segments_ev", "speakers_ev")) + "SELECT * FROM ranked",
    "w4_top_candidates": (RANK % ("segments_v", "speakers_v")) + "SELECT ranked.* FROM ranked JOIN s USING (recording_id, idx) WHERE s.speaker_id IS NULL AND rank = 1",
    "w5_next_unassigned": "SELECT recording_id, idx, min(CASE WHEN speaker_id IS NULL THEN idx END) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_index FROM segments_v",
    "w5_previous_unreviewed": f"SELECT recording_id, idx, max(CASE WHEN NOT ({_HEARD}) THEN idx END) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_index FROM segments_v",
    "w6_filter_unreviewed": "SELECT recording_id, idx, speaker_id FROM segments_v WHERE speaker_id IS NULL OR NOT reviewed",
    "e12_row_state": (BASE % "segments_v") + f"""SELECT recording_id, idx, CASE WHEN speaker_id IS NULL THEN '—' WHEN reviewed THEN '✓' ELSE '△' END AS mark, CASE WHEN time_edited AND time_reviewed THEN '✎' WHEN time_edited THEN '✎△' ELSE '' END AS time_mark,
      concat_ws(' ', CASE WHEN speaker_id IS NULL THEN 'unassigned' END, CASE WHEN speaker_id IS NOT NULL AND NOT reviewed THEN 'bulk' END, CASE WHEN speaker_id IN {SPECIAL} THEN 'special' END, CASE WHEN pseudo THEN 'pseudo' END) AS tags, {_TITLE} AS cluster_label,
      CASE WHEN length(t) <= 60 THEN t ELSE concat(substr(t, 1, 59), '…') END AS preview FROM (SELECT *, trim(regexp_replace(text, '[\\s　]+', ' ', 'g')) AS t FROM s) AS s""",
}
_ORACLES["a1_progress_events"] = _ORACLES["a1_progress"].replace("segments_v", "segments_ev")
_ORACLES["a6_transitions_events"] = _ORACLES["a6_transitions"].replace("segments_v", "segments_ev")
ORACLES = {name: with_views(sql) for name, sql in _ORACLES.items()}
