"""Queries over transcript text: parsing, quality checks, minutes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns
from parlance.operators import minutes, parse, quality
from parlance.plans.segment_queries import on
from parlance.plans.views import view, with_views


def chunks_of(spark, sf_dir):
    """Transcript text of each chunk, put together from its turns."""
    lines = view(spark, sf_dir, "lines_v")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("recording_id", "chunk").agg(F.first("length").alias("length"), parts.alias("text"))


CHUNKS = "chunks_v AS (SELECT recording_id, chunk, any_value(length) AS length, string_agg(line, chr(10) ORDER BY turn) AS text FROM lines_v GROUP BY 1, 2)"
LINES = CHUNKS + """
, l0 AS (SELECT recording_id, chunk, length, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks_v)
, l1 AS (SELECT recording_id, chunk, length, line_no, trim(line) AS line FROM l0 WHERE trim(line) <> '')
, l2 AS (SELECT *, regexp_matches(line, '^\\[[0-9]{1,3}:[0-9]{1,2}\\]') AS is_header FROM l1)
, l3 AS (SELECT *, CASE WHEN is_header THEN CAST(regexp_extract(line, '^\\[([0-9]+):([0-9]+)\\]', 1) AS INT) * 60.0 + CAST(regexp_extract(line, '^\\[([0-9]+):([0-9]+)\\]', 2) AS DOUBLE) END AS rel0,
                CASE WHEN is_header THEN regexp_extract(line, '【([^】]*)】', 1) END AS label, CASE WHEN is_header THEN trim(regexp_replace(line, '^\\[[0-9:]+\\] 【[^】]*】', '')) END AS body FROM l2)
, l4 AS (SELECT *, CASE WHEN is_header THEN max(CASE WHEN NOT is_header THEN NULL WHEN length > 0 THEN least(rel0, length) ELSE rel0 END) OVER (PARTITION BY recording_id, chunk ORDER BY line_no) END AS rel FROM l3)
, l5 AS (SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk ORDER BY line_no) AS grp FROM l4)
, raw0 AS (SELECT recording_id, chunk, any_value(length) AS length, min(line_no) AS line_no, CAST(coalesce(arg_min(rel, line_no), 0) AS DOUBLE) AS rel,
                CASE WHEN bool_or(is_header) THEN CASE WHEN arg_min(label, line_no) LIKE '%不明' THEN '?' ELSE right(arg_min(label, line_no), 1) END ELSE '?' END AS cluster,
                coalesce(string_agg(CASE WHEN is_header THEN nullif(body, '') ELSE line END, ' ' ORDER BY line_no), '') AS text FROM l5 GROUP BY recording_id, chunk, grp)
, raw1 AS (SELECT *, CASE WHEN length > 0 THEN length ELSE max(rel) OVER (PARTITION BY recording_id, chunk) END AS chunk_len, lead(rel) OVER (PARTITION BY recording_id, chunk ORDER BY line_no) AS nxt FROM raw0 WHERE text <> '')
, raw AS (SELECT * EXCLUDE (nxt), CASE WHEN e <= rel THEN rel + 1 ELSE e END AS rel_end FROM (SELECT *, coalesce(nxt, least(chunk_len, rel + 2)) AS e FROM raw1))
, need AS (SELECT *, least(120.0, greatest(1.0, length(trim(text)) / 4.5)) AS need, coalesce(lead(rel) OVER w, chunk_len) AS after FROM raw WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
, tight AS (SELECT *, after - rel < need - 0.01 AS tight FROM need)
, grp AS (SELECT *, coalesce(sum(CASE WHEN tight THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, chunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM tight)
, shr AS (SELECT *, bool_or(tight) OVER p AS hot, min(rel) OVER p AS g0, last_value(after) OVER (PARTITION BY recording_id, chunk, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g1, sum(need) OVER p AS gn,
                coalesce(sum(need) OVER (PARTITION BY recording_id, chunk, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, lead(line_no) OVER (PARTITION BY recording_id, chunk, g ORDER BY line_no) IS NULL AS last
         FROM grp WINDOW p AS (PARTITION BY recording_id, chunk, g))
, fit AS (SELECT *, least(1.0, greatest(0.3, g1 - g0) / gn) AS sc FROM shr)
, red AS (SELECT recording_id, chunk, line_no, text, cluster, chunk_len, CASE WHEN hot THEN round_even((g0 + bf * sc) * 1000, 0) / 1000 ELSE rel END AS rel,
                CASE WHEN NOT hot THEN after WHEN last AND round_even((g0 + bf * sc + need * sc) * 1000, 0) / 1000 < g1 THEN round_even(g1 * 1000, 0) / 1000 ELSE round_even((g0 + bf * sc + need * sc) * 1000, 0) / 1000 END AS rel_end FROM fit)
"""


_FIT = LINES.index(", need AS (")
#: The whole parse job: chunks without a length have 60 seconds, rows of one voice are joined (a chunk is shorter than the cap on joined rows).
TRANSCRIPT = LINES[:_FIT].replace("any_value(length) AS length", "CASE WHEN any_value(length) > 0 THEN any_value(length) ELSE 60.0 END AS length") + """
, mx AS (SELECT *, coalesce(cluster = lag(cluster) OVER w AND cluster NOT IN ('?', '*') AND rel - lag(rel_end) OVER w <= 20, false) AS same FROM raw WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
, my AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, chunk ORDER BY line_no) AS isl FROM mx)
, mz AS (SELECT *, CASE WHEN lead(isl) OVER w = isl AND instr('。、．，!?！？」』）)…・ー~〜-', right(text, 1)) = 0 AND instr('。、．，!?！？」』）)…・ー~〜-', left(lead(text) OVER w, 1)) = 0 THEN '、' ELSE '' END AS mark FROM my WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
, merged AS (SELECT recording_id, chunk, any_value(length) AS length, any_value(chunk_len) AS chunk_len, min(line_no) AS line_no, any_value(cluster) AS cluster, arg_min(rel, line_no) AS rel, arg_max(rel_end, line_no) AS rel_end, string_agg(concat(text, mark), '' ORDER BY line_no) AS text FROM mz GROUP BY recording_id, chunk, isl)
""" + LINES[_FIT:].replace("FROM raw WINDOW", "FROM merged WINDOW") + """
, ofs AS (SELECT recording_id, chunk, coalesce(sum(length) OVER (PARTITION BY recording_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chunks_v)
, fin AS (SELECT recording_id, chunk, line_no, text, concat(chunk, ':', cluster) AS cluster, off + rel AS a, off + CASE WHEN lead(line_no) OVER w IS NULL THEN greatest(rel_end, chunk_len) ELSE rel_end END AS b
          FROM red JOIN ofs USING (recording_id, chunk) WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
, transcript AS (SELECT recording_id, chunk, row_number() OVER (PARTITION BY recording_id, chunk ORDER BY line_no) - 1 AS idx, round_even(a * 100, 0) / 100 AS seg_start, round_even(CASE WHEN b <= a THEN a + 1 ELSE b END * 100, 0) / 100 AS seg_end, text, cluster FROM fin)
"""


def _raw(spark, sf_dir):
    return parse.raw_segments(chunks_of(spark, sf_dir))


def _per_line(df):
    return df.select("recording_id", "chunk", "line_no", "line")


def _placed(df):
    return df.select("recording_id", "chunk", "line_no", "cluster", "rel", "rel_end")


def _no_cap(spark, sf_dir):
    out = parse.merge_same_cluster(_raw(spark, sf_dir), max_seconds=1e9)
    return out.select("recording_id", "chunk", "line_no", "cluster", "rel", "rel_end", F.char_length("text").alias("n_chars"))


def _statuses(spark, sf_dir):
    segments = view(spark, sf_dir, "segments_v").groupBy("recording_id", "chunk").agg(F.count("*").alias("segments"))
    failed = ((F.col("recording_id") + F.col("chunk")) % 5 == 0) | (F.col("recording_id") % 17 == 0)
    return quality.chunk_status(segments.withColumn("failed", failed).withColumn("segments", F.when(F.col("failed"), 0).otherwise(F.col("segments"))))


def _keyed(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    return c.select("recording_id", "chunk", F.concat(F.lit("fp"), F.col("recording_id").cast("string")).alias("fingerprint"), F.lit(60).alias("chunk_seconds"), (F.col("recording_id") % 2 == 0).alias("verbatim"), F.lit("cluster").alias("mode"), F.when(F.col("recording_id") % 3 == 0, "sp01 sp02").otherwise("").alias("roster")).withColumn("key", quality.chunk_key())


def _pending(spark, sf_dir):
    c = _keyed(spark, sf_dir)
    done = c.filter("recording_id % 4 <> 1").select("recording_id", "chunk", "key", (F.col("chunk") == 1).alias("failed"))
    return quality.pending_chunks(c, done).select("recording_id", "chunk", "key")


MESSAGES = "CASE %s %% 7 WHEN 0 THEN 'Your CREDITS are depleted' WHEN 1 THEN '429 You exceeded your current quota' WHEN 2 THEN 'RESOURCE_EXHAUSTED' WHEN 3 THEN 'PERMISSION_DENIED for key' WHEN 4 THEN 'rate limit, billing' WHEN 5 THEN 'connection reset' ELSE NULL END"


def _errors(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    log = e.select("event_id", F.expr(MESSAGES % "event_id").alias("message"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    return quality.retry_schedule(quality.classify_errors(log)).select("event_id", "error_class", "rate_limited", "wait_s")


def _hashes(spark, sf_dir):
    r = view(spark, sf_dir, "recordings_v")
    h = r.filter("recording_id % 5 <> 0").select(F.col("audio_path").alias("path"), F.when(F.col("recording_id") % 7 == 0, "other").otherwise(F.concat(F.lit("sha"), F.col("recording_id").cast("string"))).alias("sha256"))
    return quality.verify_sources(r, h)


def _same(spark, sf_dir):
    r = view(spark, sf_dir, "recordings_v")
    new = r.withColumn("audio_fingerprint", F.when(F.col("recording_id") % 3 == 0, "fp3").otherwise(F.col("audio_fingerprint"))).withColumn("duration", F.col("duration") + F.col("recording_id") % 3)
    return quality.same_recording(r, new)


def _samples(spark, sf_dir):
    return quality.envelope(view(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), "value"), 16)


def _shift(spark, sf_dir):
    return parse.shift_timestamps(chunks_of(spark, sf_dir).withColumn("offset", F.col("chunk") * 600)).select("recording_id", "chunk", F.md5(F.col("text").cast("binary")).alias("digest"))


def _degenerate(spark, sf_dir):
    return quality.flag_degenerate(view(spark, sf_dir, "documents"))


DEGENERATE = """
WITH l AS (SELECT doc_id, k, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents) WHERE trim(line) <> '')
, loops AS (SELECT DISTINCT doc_id FROM (SELECT DISTINCT doc_id, line FROM l WHERE length(line) >= 30), range(1, 13) AS p(p) WHERE list_has_any([true], list_transform(range(1, length(line) - p * 15 + 2), lambda i: substr(line, i, p * 15) = repeat(substr(line, i, p), 15))))
, counts AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM l GROUP BY 1)
, runs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, isl, count(*) AS n FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS isl FROM (SELECT *, line = lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS same FROM l)) GROUP BY 1, 2) WHERE n >= 15)
SELECT doc_id, r IS NOT NULL AS degenerate, r AS reason FROM (
  SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'empty' WHEN loops.doc_id IS NOT NULL THEN 'loop' WHEN n >= 40 AND d / n < 0.2 THEN 'few_lines' WHEN runs.doc_id IS NOT NULL THEN 'line_run' END AS r
  FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN loops USING (doc_id) LEFT JOIN runs USING (doc_id))
""".replace("d / n < 0.2", "c.d / n < 0.2")

HMS = "concat(lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(round_even({0}, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0'))"
NAME = "CASE speaker_id WHEN '__noise__' THEN '発言なし・雑音' WHEN '__multi__' THEN '発言者複数・重複' WHEN '__unknown__' THEN '発言者不明' END"
RUNS = f"""
m0 AS (SELECT recording_id, idx, seg_start, speaker_id, regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g') AS text FROM segments_v WHERE speaker_id IS DISTINCT FROM '__noise__')
, m1 AS (SELECT *, coalesce(speaker_id = lag(speaker_id) OVER w, false) AS same FROM m0 WHERE text <> '' WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
, m2 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM m1)
, mins AS (SELECT recording_id, min(idx) AS first_idx, arg_min(seg_start, idx) AS seg_start, any_value(speaker_id) AS speaker_id, string_agg(text, '' ORDER BY idx) AS text FROM m2 GROUP BY recording_id, run)
, cnt AS (SELECT recording_id, count(*) AS total, count(*) FILTER (speaker_id IS NOT NULL AND reviewed) AS heard, count(*) FILTER (speaker_id IS NOT NULL AND NOT reviewed) AS bulk, count(*) FILTER (speaker_id IS NULL) AS open,
                 count(*) FILTER (time_edited AND time_reviewed) AS t_heard, count(*) FILTER (time_edited AND NOT time_reviewed) AS t_bulk FROM segments_v GROUP BY 1)
, nts AS (SELECT recording_id, concat('※ 話者ラベルはユーザーが音声を聴いて割り当てたものです(全 ', total, ' 区間中、聴いて確定 ', heard, ' 区間', CASE WHEN bulk > 0 THEN concat('、まとめて適用 ', bulk, ' 区間') ELSE '' END, CASE WHEN open > 0 THEN concat('、未確定 ', open, ' 区間') ELSE '' END, ')。') AS note FROM cnt)
, rc AS (SELECT r.*, c.* EXCLUDE (recording_id), concat('rec', r.recording_id, '.wav') AS file FROM recordings_v r LEFT JOIN cnt c USING (recording_id))
, ver AS (SELECT recording_id, 1 AS seq, '元音声' AS item, concat(file, ' (', {HMS.format("duration")}, ')') AS value, 0 AS rev FROM rc
          UNION ALL SELECT recording_id, 2, 'SHA-256', source_sha256, 0 FROM rc WHERE source_sha256 <> ''
          UNION ALL SELECT recording_id, 3, '処理経路', concat(CASE engine_mode WHEN 'cloud' THEN 'クラウド' ELSE 'ローカル' END, ' / ', engine_model), 0 FROM rc WHERE engine_mode <> ''
          UNION ALL SELECT recording_id, 4, '版', CAST(doc_revision AS VARCHAR), 1 FROM rc
          UNION ALL SELECT recording_id, 5, '話者の確認', concat('聴いて確定 ', heard, ' / まとめて適用 ', bulk, ' / 未確定 ', open), 0 FROM rc
          UNION ALL SELECT recording_id, 6, '時刻の修正', concat('聴いて確認 ', t_heard, ' / 適用のみ ', t_bulk), 0 FROM rc
          UNION ALL SELECT recording_id, 7, '注意', '本書の記載は確認の履歴であり、内容の正しさや法的効力を保証するものではありません。', 0 FROM rc)
"""

QUERIES = {
    "t1_explode_lines": lambda s, d: _per_line(parse.explode_lines(chunks_of(s, d))),
    "t2_match_headers": lambda s, d: parse.match_headers(parse.explode_lines(chunks_of(s, d))).select("recording_id", "chunk", "line_no", "is_header", "rel", "label", F.md5(F.col("body").cast("binary")).alias("body")),
    "t3_normalize_labels": lambda s, d: parse.normalize_cluster_labels(view(s, d, "conversations").select("conv_id", "turn", F.expr("concat(CASE conv_id % 6 WHEN 0 THEN '発言者' WHEN 1 THEN '話者 ' WHEN 2 THEN 'Speaker ' WHEN 3 THEN '' WHEN 4 THEN '不明' ELSE '重複' END, role)").alias("label"))),
    "t4_attach_continuations": lambda s, d: parse.attach_continuations(parse.monotone_times(parse.match_headers(parse.explode_lines(chunks_of(s, d))))).select("recording_id", "chunk", "line_no", "cluster", F.md5(F.col("text").cast("binary")).alias("text")),
    "t5_monotone_times": lambda s, d: parse.monotone_times(parse.match_headers(parse.explode_lines(chunks_of(s, d)))).select("recording_id", "chunk", "line_no", "rel"),
    "t6_provisional_ends": lambda s, d: _raw(s, d).select("recording_id", "chunk", "line_no", "rel", "rel_end", "chunk_len"),
    "t7_merge_same_cluster": lambda s, d: _no_cap(s, d),
    "t8_t9_join_and_estimate": lambda s, d: view(s, d, "conversations").select("conv_id", "turn", F.round(columns.estimate_speech(F.col("text")), 6).alias("seconds"), F.md5(columns.join_fragments(F.array(F.lit(" a。 "), F.trim("text"), F.lit("!b"), F.lit("c"))).cast("binary")).alias("joined")),
    "t10_redistribute_times": lambda s, d: _placed(parse.redistribute_times(_raw(s, d))),
    "t11_finalize_segments": lambda s, d: parse.finalize_segments(parse.redistribute_times(_raw(s, d))).select("recording_id", "chunk", "idx", "seg_start", "seg_end", "cluster"),
    "t12_parse_transcripts": lambda s, d: parse.renumber(parse.parse_transcripts(parse.accumulate_offsets(chunks_of(s, d), 60.0))),
    "t13_accumulate_offsets": lambda s, d: parse.accumulate_offsets(chunks_of(s, d), 600.0).select("recording_id", "chunk", "offset", "length"),
    "t14_renumber": lambda s, d: parse.renumber(view(s, d, "segments_ev").withColumn("idx", F.col("idx") * 3)).select("recording_id", "seg_start", "idx"),
    "t15_shift_timestamps": _shift,
    "t16_extract_leads": lambda s, d: parse.extract_leads(view(s, d, "lines_v").withColumn("line", F.split("line", "\n")[0])).select("recording_id", "turn", "ts", "speaker", F.md5(F.col("body").cast("binary")).alias("body")),
    "q1_flag_degenerate": _degenerate,
    "q2_q3_classify_and_retry": _errors,
    "q4_chunk_status": _statuses,
    "q5_pending_chunks": _pending,
    "q6_verify_sources": _hashes,
    "q7_same_recording": _same,
    "a13_envelope": _samples,
    "w7_minutes": on(minutes.minutes, "segments_v"),
    "s7_minutes_lines": on(minutes.minutes_lines, "segments_v", "speakers_v"),
    "a10_verification_summary": on(minutes.verification_summary, "recordings_v", "segments_v"),
    "a11_review_note": on(minutes.review_note, "segments_v"),
    "w8_minutes_document": on(minutes.minutes_document, "recordings_v", "speakers_v", "segments_v"),
}

_ORACLES = {
    "t1_explode_lines": f"WITH {LINES} SELECT recording_id, chunk, line_no, line FROM l1",
    "t2_match_headers": f"WITH {LINES} SELECT recording_id, chunk, line_no, is_header, CAST(rel0 AS DOUBLE) AS rel, label, md5(body) AS body FROM l3",
    "t3_normalize_labels": "SELECT conv_id, turn, concat(CASE conv_id % 6 WHEN 0 THEN '発言者' WHEN 1 THEN '話者 ' WHEN 2 THEN 'Speaker ' WHEN 3 THEN '' WHEN 4 THEN '不明' ELSE '重複' END, role) AS label, CASE conv_id % 6 WHEN 4 THEN '?' WHEN 5 THEN '*' ELSE upper(substr(role, 1, 1)) END AS cluster FROM conversations",
    "t4_attach_continuations": f"WITH {LINES} SELECT recording_id, chunk, line_no, cluster, md5(text) AS text FROM raw0",
    "t5_monotone_times": f"WITH {LINES} SELECT recording_id, chunk, line_no, rel FROM l4",
    "t6_provisional_ends": f"WITH {LINES} SELECT recording_id, chunk, line_no, rel, rel_end, chunk_len FROM raw",
    "t7_merge_same_cluster": f"""WITH {LINES} , x AS (SELECT *, coalesce(cluster = lag(cluster) OVER w AND cluster NOT IN ('?', '*') AND rel - lag(rel_end) OVER w <= 20, false) AS same FROM raw WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
      , y AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, chunk ORDER BY line_no) AS isl FROM x)
      , z AS (SELECT *, CASE WHEN lead(isl) OVER w = isl AND instr('。、．，!?！？」』）)…・ー~〜-', right(text, 1)) = 0 AND instr('。、．，!?！？」』）)…・ー~〜-', left(lead(text) OVER w, 1)) = 0 THEN 1 ELSE 0 END AS comma FROM y WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no))
      SELECT recording_id, chunk, min(line_no) AS line_no, any_value(cluster) AS cluster, arg_min(rel, line_no) AS rel, arg_max(rel_end, line_no) AS rel_end, CAST(sum(length(text) + comma) AS INT) AS n_chars FROM z GROUP BY recording_id, chunk, isl""",
    "t8_t9_join_and_estimate": """SELECT conv_id, turn, round(least(120.0, greatest(1.0, length(regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g')) / 4.5)), 6) AS seconds,
      md5(concat('a。', t, '!b、c')) AS joined FROM (SELECT *, trim(text) AS t FROM conversations)""",
    "t10_redistribute_times": f"WITH {LINES} SELECT recording_id, chunk, line_no, cluster, rel, rel_end FROM red",
    "t11_finalize_segments": f"WITH {LINES} , f AS (SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN lead(line_no) OVER w IS NULL THEN greatest(rel_end, chunk_len) ELSE rel_end END AS e FROM red WINDOW w AS (PARTITION BY recording_id, chunk ORDER BY line_no)) SELECT recording_id, chunk, idx, round_even(rel * 100, 0) / 100 AS seg_start, round_even(CASE WHEN e <= rel THEN rel + 1 ELSE e END * 100, 0) / 100 AS seg_end, concat(chunk, ':', cluster) AS cluster FROM f",
    "t12_parse_transcripts": f"WITH {TRANSCRIPT} SELECT * REPLACE (row_number() OVER (PARTITION BY recording_id ORDER BY chunk, idx) - 1 AS idx) FROM transcript",
    "t13_accumulate_offsets": f"WITH {CHUNKS} SELECT recording_id, chunk, coalesce(sum(len) OVER (PARTITION BY recording_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\", greatest(1.0, len) AS length FROM (SELECT *, CASE WHEN length > 0 THEN length ELSE 600.0 END AS len FROM chunks_v)",
    "t14_renumber": "SELECT recording_id, seg_start, row_number() OVER (PARTITION BY recording_id ORDER BY chunk, idx) - 1 AS idx FROM segments_ev",
    "t15_shift_timestamps": f"""WITH {CHUNKS} SELECT recording_id, chunk, md5(string_agg(CASE WHEN hit THEN concat('[', lpad(CAST(v // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(v % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(v % 60 AS VARCHAR), 2, '0'), ']', substr(part, 8)) ELSE part END, chr(10) ORDER BY k)) AS digest
      FROM (SELECT *, regexp_matches(part, '^\\[[0-9]{{2}}:[0-9]{{2}}\\]') AS hit, try_cast(substr(part, 2, 2) AS BIGINT) * 60 + try_cast(substr(part, 5, 2) AS BIGINT) + chunk * 600 AS v FROM (SELECT recording_id, chunk, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM chunks_v)) GROUP BY 1, 2""",
    "t16_extract_leads": "SELECT recording_id, turn, substr(l, 1, 7) AS ts, regexp_extract(l, '【[^】]+】') AS speaker, md5(regexp_replace(substr(l, instr(l, '】') + 1), '^\\s+', '')) AS body FROM (SELECT *, split_part(line, chr(10), 1) AS l FROM lines_v)",
    "q1_flag_degenerate": DEGENERATE,
    "q2_q3_classify_and_retry": f"""WITH e AS (SELECT event_id, event_id % 4 AS attempt, lower(coalesce({MESSAGES % 'event_id'}, '')) AS m FROM events)
      , c AS (SELECT *, CASE WHEN m LIKE '%credits are depleted%' OR m LIKE '%prepayment%' OR m LIKE '%billing%' THEN 'depleted' WHEN m LIKE '%exceeded your current quota%' OR m LIKE '%quota\\_exceeded%' ESCAPE '\\' THEN 'quota' WHEN m LIKE '%permission\\_denied%' ESCAPE '\\' THEN 'auth' ELSE 'retryable' END AS error_class,
              m LIKE '%429%' OR m LIKE '%resource\\_exhausted%' ESCAPE '\\' OR m LIKE '%rate limit%' AS rate_limited FROM e)
      SELECT event_id, error_class, rate_limited, CASE WHEN rate_limited THEN 20.0 * (attempt + 1) ELSE 5 * pow(2, attempt) END AS wait_s FROM c""",
    "q4_chunk_status": """WITH c AS (SELECT recording_id, chunk, (recording_id + chunk) % 5 = 0 OR recording_id % 17 = 0 AS failed, count(*) AS k FROM segments_v GROUP BY 1, 2), t AS (SELECT recording_id, count(*) AS n, count(*) FILTER (failed) AS failed, CAST(sum(CASE WHEN failed THEN 0 ELSE k END) AS BIGINT) AS segments FROM c GROUP BY 1)
      SELECT *, CASE WHEN failed = n THEN 'failed' WHEN segments = 0 THEN 'empty' WHEN failed > 0 THEN 'partial' ELSE 'ok' END AS status FROM t""",
    "q5_pending_chunks": "SELECT DISTINCT recording_id, chunk, concat_ws('.', concat('fp', recording_id), 'c60', 'cluster', CASE WHEN recording_id % 2 = 0 THEN 'vb' END, CASE WHEN recording_id % 3 = 0 THEN substr(md5('sp01 sp02'), 1, 8) END) AS key FROM lines_v WHERE recording_id % 4 = 1 OR chunk = 1",
    "q6_verify_sources": "SELECT recording_id, CASE WHEN recording_id % 5 = 0 THEN 'missing' WHEN source_sha256 = '' THEN 'first_record' WHEN recording_id % 7 = 0 THEN 'mismatch' ELSE 'match' END AS result FROM recordings_v",
    "q7_same_recording": "SELECT recording_id, CASE WHEN fa <> '' AND fb <> '' THEN fa = fb ELSE recording_id % 3 <= 1 END AS same FROM (SELECT recording_id, audio_fingerprint AS fa, CASE WHEN recording_id % 3 = 0 THEN 'fp3' ELSE audio_fingerprint END AS fb FROM recordings_v)",
    "a13_envelope": """WITH s AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
      , b AS (SELECT key, i AS bucket, min(value) AS lo, max(value) AS hi FROM s, range(16) AS t(i) WHERE r >= n * i // 16 AND r < n * (i + 1) // 16 GROUP BY 1, 2)
      SELECT key, bucket, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM (SELECT DISTINCT user_id AS key, i AS bucket FROM events, range(16) AS t(i)) LEFT JOIN b USING (key, bucket)""",
    "w7_minutes": f"WITH {RUNS} SELECT * FROM mins",
    "s7_minutes_lines": f"WITH {RUNS} SELECT recording_id, first_idx, concat('[', {HMS.format('seg_start')}, '] 【', coalesce({NAME}, name, '発言者不明'), '】 ', text) AS line FROM mins LEFT JOIN (SELECT recording_id, speaker_id, name FROM speakers_v) USING (recording_id, speaker_id)",
    "a10_verification_summary": f"WITH {RUNS} SELECT recording_id, seq, item, CASE WHEN rev = 1 THEN concat('revision ', value, ' (schema 5)') ELSE value END AS value FROM ver",
    "a11_review_note": f"WITH {RUNS} SELECT * FROM nts",
    "w8_minutes_document": f"""WITH {RUNS} SELECT recording_id, 1 AS section, 0 AS seq, concat('rec', recording_id) AS text, 'heading' AS tone FROM recordings_v
      UNION ALL SELECT recording_id, 2, 0, concat('出席者: ', string_agg(CASE WHEN note <> '' THEN concat(name, '(', note, ')') ELSE name END, '、' ORDER BY ord)), 'normal' FROM speakers_v GROUP BY 1
      UNION ALL SELECT recording_id, 3, 0, note, 'grey' FROM nts
      UNION ALL SELECT recording_id, 4, first_idx, concat('[', {HMS.format('seg_start')}, '] 【', coalesce({NAME}, name, '発言者不明'), '】 ', text), CASE WHEN speaker_id IS NULL THEN 'red' WHEN {NAME} IS NOT NULL THEN 'grey' ELSE 'normal' END FROM mins LEFT JOIN (SELECT recording_id, speaker_id, name FROM speakers_v) USING (recording_id, speaker_id)
      UNION ALL SELECT recording_id, 5, seq, concat(item, ': ', CASE WHEN rev = 1 THEN concat('revision ', CAST(value AS INT) + 1, ' (schema 5)') ELSE value END), 'normal' FROM ver""",
}
ORACLES = {name: with_views(sql) for name, sql in _ORACLES.items()}
