"""Views that give the test tables the shape of transcripts.

Each is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for a table or another view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("conversations", "events", "documents", "benchmark", "nation", "customer")

VIEWS = {
    "segments_v": """
SELECT recording_id, idx, seg_start, seg_start + 15.0 AS seg_end, text, concat(chunk, ':', label) AS cluster, chunk, speaker_id, reviewed, note, text_edited, time_edited,
       time_edited AND idx % 2 = 1 AS time_reviewed, seg_start AS orig_start, seg_start + 15.0 AS orig_end
FROM (SELECT conv_id AS recording_id, turn AS idx, CAST(turn * 20 + conv_id % 5 AS DOUBLE) AS seg_start, text, CAST(floor(turn / 3.0) AS INT) AS chunk,
             CASE WHEN (conv_id + turn) % 11 = 0 THEN '?' WHEN role = 'user' THEN 'A' WHEN role = 'assistant' THEN 'B' ELSE 'C' END AS label,
             CASE WHEN (3 * conv_id + 5 * turn) % 7 IN (0, 3) THEN NULL WHEN (conv_id + turn) % 13 = 0 THEN '__noise__' WHEN role = 'user' THEN 'sp01'
                  WHEN role = 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'sp02' ELSE 'sp03' END ELSE 'sp04' END AS speaker_id,
             (conv_id + turn) % 2 = 0 AS reviewed, CASE WHEN turn % 5 = 0 THEN 'memo' ELSE '' END AS note, turn % 6 = 5 AS text_edited, (conv_id + turn) % 4 = 3 AS time_edited
      FROM {conversations}) AS c""",
    "old_v": """
SELECT recording_id, idx * 2 AS idx, seg_start, seg_end, text, cluster, chunk, speaker_id, reviewed, note, text_edited, time_edited, time_reviewed, orig_start, orig_end FROM {segments_v}
UNION ALL SELECT recording_id, idx * 2 + 1 AS idx, seg_start + 7 AS seg_start, seg_end, concat(text, ' tail') AS text, cluster, chunk, CAST(NULL AS VARCHAR(9)) AS speaker_id, false AS reviewed, '' AS note, text_edited, true AS time_edited, false AS time_reviewed, orig_start, orig_end
FROM {segments_v} WHERE idx % 9 = 4""",
    "new_v": """
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_start, k) - 1 AS idx, seg_start, seg_start + 12 AS seg_end, text, cluster, chunk, CAST(NULL AS VARCHAR(9)) AS speaker_id, false AS reviewed, '' AS note,
       false AS text_edited, false AS time_edited, false AS time_reviewed, seg_start AS orig_start, seg_start + 12 AS orig_end
FROM (SELECT recording_id, 0 AS k, concat('new ', text) AS text, cluster, chunk, CAST(seg_start + CASE (recording_id + idx) % 7 WHEN 1 THEN 1.5 WHEN 2 THEN -1.9 WHEN 3 THEN 2.5 WHEN 4 THEN 0.4 WHEN 6 THEN 0.5 ELSE 0 END AS DOUBLE) AS seg_start FROM {segments_v}
      UNION ALL SELECT recording_id, 1 AS k, 'second' AS text, cluster, chunk, seg_start + 1 AS seg_start FROM {segments_v} WHERE (recording_id + idx) % 7 = 6
      UNION ALL SELECT recording_id, 2 AS k, 'inside' AS text, cluster, chunk, seg_start + 10 AS seg_start FROM {segments_v} WHERE (recording_id + idx) % 3 = 0) AS n""",
    "rerecorded_v": """
SELECT recording_id, audio_path, duration + CASE WHEN recording_id % 8 = 4 THEN 30 ELSE 1 END AS duration, time_offset, source_sha256, engine_mode, engine_model, engine_at, CAST(0 AS INT) AS doc_revision,
       CASE WHEN recording_id % 5 = 2 THEN concat('other', recording_id) ELSE audio_fingerprint END AS audio_fingerprint
FROM {recordings_v} WHERE recording_id % 10 <> 8""",
    "segments_ev": """
SELECT recording_id, idx, CAST(idx * 10 AS DOUBLE) AS seg_start, CAST(idx * 10 + 9 AS DOUBLE) AS seg_end, concat('t', idx) AS text, concat(chunk, ':', label) AS cluster, chunk, speaker_id, reviewed,
       '' AS note, false AS text_edited, false AS time_edited, false AS time_reviewed, CAST(idx * 10 AS DOUBLE) AS orig_start, CAST(idx * 10 + 9 AS DOUBLE) AS orig_end
FROM (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(floor(event_id / 2500.0) AS INT) AS chunk,
             CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS label, CASE WHEN event_type <> 'error' THEN event_type END AS speaker_id, event_id % 2 = 0 AS reviewed
      FROM {events}) AS e""",
    "speakers_v": """
SELECT recording_id, speaker_id, concat('Name ', speaker_id) AS name, CASE WHEN speaker_id = 'sp02' THEN 'chair' ELSE '' END AS note,
       CAST(row_number() OVER (PARTITION BY recording_id ORDER BY speaker_id) - 1 AS INT) AS ord
FROM (""" + " UNION ALL ".join(f"SELECT DISTINCT conv_id AS recording_id, 'sp0{k}' AS speaker_id FROM {{conversations}}" for k in range(1, 6)) + """) AS s
WHERE NOT (speaker_id = 'sp04' AND recording_id % 2 = 1)""",
    "speakers_ev": """
SELECT recording_id, speaker_id, concat('Name ', speaker_id) AS name, '' AS note, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY speaker_id) - 1 AS INT) AS ord
FROM (""" + " UNION ALL ".join(f"SELECT DISTINCT user_id AS recording_id, '{k}' AS speaker_id FROM {{events}}" for k in ("view", "click", "signup", "purchase")) + ") AS s",
    "recordings_v": """
SELECT conv_id AS recording_id, concat('/audio/rec', conv_id, '.wav') AS audio_path, CAST(max(turn) * 20 + 40 AS DOUBLE) AS duration, CASE WHEN conv_id % 3 = 0 THEN 0.0 ELSE CAST(conv_id % 4 AS DOUBLE) END AS time_offset,
       CASE WHEN conv_id % 2 = 0 THEN concat('sha', conv_id) ELSE '' END AS source_sha256, CASE WHEN conv_id % 3 = 1 THEN 'cloud' WHEN conv_id % 3 = 2 THEN 'local' ELSE '' END AS engine_mode,
       CASE WHEN conv_id % 3 > 0 THEN 'model-a' ELSE '' END AS engine_model, '' AS engine_at, CAST(conv_id % 5 AS INT) AS doc_revision, CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('fp', conv_id) END AS audio_fingerprint
FROM {conversations} GROUP BY conv_id""",
    "proposals_v": """
SELECT recording_id, recording_id * 100 + idx AS id, orig_start AS target_orig_start, CASE WHEN idx % 3 = 0 THEN NULL ELSE seg_start END AS target_now, seg_start + (idx % 3) * 9 AS p_start, seg_start + (idx % 3) * 9 + 15 AS p_end
FROM {segments_v}""",
    "edits_v": """
SELECT user_id AS recording_id, event_id, ts AS at, CASE event_type WHEN 'view' THEN 'time' WHEN 'click' THEN 'speaker' WHEN 'signup' THEN 'text' WHEN 'purchase' THEN 'reject' ELSE 'invalid' END AS kind,
       floor(event_id / 10) AS batch_id, value AS after, event_id % 20 AS target
FROM {events}""",
    "lines_v": """
SELECT conv_id AS recording_id, CAST(floor(turn / 3.0) AS INT) AS chunk, turn, conv_id, CAST(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE 60 END AS DOUBLE) AS length,
       concat('[0', CASE WHEN (turn % 3) * 20 + conv_id % 5 >= 60 THEN '1' ELSE '0' END, ':', lpad(CAST(((turn % 3) * 20 + conv_id % 5) % 60 AS VARCHAR(9)), 2, '0'), '] 【発言者',
              CASE WHEN role = 'user' THEN 'A' WHEN role = 'assistant' THEN 'B' ELSE '不明' END, '】 ', text) AS line
FROM {conversations}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {other: view(spark, sf_dir, other) for other in (*TABLES, *VIEWS) if "{" + other + "}" in sql}
    return spark.sql(sql, **used)


def sql_of(name: str) -> str:
    """The view as SQL over the driver's tables alone."""
    sql = VIEWS[name]
    for other in VIEWS:
        if "{" + other + "}" in sql:
            sql = sql.replace("{" + other + "}", f"({sql_of(other)}) AS {other}")
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_views(sql: str) -> str:
    """SQL in which every view that is named is defined in front."""
    defined = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({sql_of(v)})" for v in defined)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
