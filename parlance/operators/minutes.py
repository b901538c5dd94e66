"""Minutes: runs of one speaker, the document's rows, and what has been checked by whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import format_hms, trim
from parlance.operators.stats import assigned, heard, resolve_speakers
from parlance.schemas import NOISE, SCHEMA_VERSION, SPECIALS, UNKNOWN_LABEL

RID = "recording_id"
# What minutes say, in the order in which it is said.
NOTE_ALL = "※ 話者ラベルはユーザーが音声を聴いて割り当てたものです(全 "
NOTE_HEARD = " 区間中、聴いて確定 "
NOTE_BULK = "、まとめて適用 "
NOTE_OPEN = "、未確定 "
NOTE_UNIT = " 区間"
NOTE_END = ")。"
ATTENDEES = "出席者: "
MODES = {"cloud": "クラウド", "local": "ローカル"}
ITEMS = ("元音声", "SHA-256", "処理経路", "版", "話者の確認", "時刻の修正", "注意")
HEARD, BULK, OPEN = "聴いて確定 ", " / まとめて適用 ", " / 未確定 "
TIMES_HEARD, TIMES_BULK = "聴いて確認 ", " / 適用のみ "
CAUTION = "本書の記載は確認の履歴であり、内容の正しさや法的効力を保証するものではありません。"


def minutes(segments: DataFrame, merge_consecutive: bool = True, drop_noise: bool = True) -> DataFrame:
    """(recording_id, first_idx, seg_start, speaker_id, text): consecutive texts of one speaker as one; open ones stay apart."""
    rows = segments.select(RID, "idx", "seg_start", "speaker_id", trim(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''")
    if drop_noise:
        rows = rows.filter(~F.col("speaker_id").eqNullSafe(F.lit(NOISE)))
    order = Window.partitionBy(RID).orderBy("idx")
    follows = F.coalesce(F.col("speaker_id") == F.lag("speaker_id").over(order), F.lit(False)) if merge_consecutive else F.lit(False)
    runs = rows.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return runs.groupBy(RID, "run").agg(F.min("idx").alias("first_idx"), F.min_by("seg_start", "idx").alias("seg_start"), F.first("speaker_id", ignorenulls=True).alias("speaker_id"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).drop("run")


def minutes_lines(segments: DataFrame, speakers: DataFrame, **options) -> DataFrame:
    """(recording_id, first_idx, line): '[HH:MM:SS] 【name】 text'."""
    named = resolve_speakers(minutes(segments, **options), speakers)
    line = F.concat(F.lit("["), format_hms(F.col("seg_start")), F.lit("] 【"), F.coalesce("speaker_name", F.lit(UNKNOWN_LABEL)), F.lit("】 "), F.col("text"))
    return named.select(RID, "first_idx", line.alias("line"))


def _counts(segments: DataFrame) -> DataFrame:
    edited, sure = F.coalesce("time_edited", F.lit(False)), F.coalesce("time_reviewed", F.lit(False))
    return segments.groupBy(RID).agg(
        F.count("*").alias("total"), F.count_if(heard()).alias("heard"), F.count_if(assigned() & ~heard()).alias("bulk"), F.count_if(~assigned()).alias("open"),
        F.count_if(edited & sure).alias("t_heard"), F.count_if(edited & ~sure).alias("t_bulk"),
    )


def review_note(segments: DataFrame) -> DataFrame:
    """One sentence per recording on what was heard, applied in bulk, and left open."""
    t = {c: F.col(c).cast("string") for c in ("total", "heard", "bulk", "open")}
    note = F.concat(
        F.lit(NOTE_ALL), t["total"], F.lit(NOTE_HEARD), t["heard"], F.lit(NOTE_UNIT),
        F.when(F.col("bulk") > 0, F.concat(F.lit(NOTE_BULK), t["bulk"], F.lit(NOTE_UNIT))).otherwise(""),
        F.when(F.col("open") > 0, F.concat(F.lit(NOTE_OPEN), t["open"], F.lit(NOTE_UNIT))).otherwise(""), F.lit(NOTE_END),
    )
    return _counts(segments).select(RID, note.alias("note"))


def _facts(revision: Column) -> Column:
    """Items and values of the verification summary as an array of (seq, item, value)."""
    t = {c: F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("heard", "bulk", "open", "t_heard", "t_bulk")}
    mode = F.when(F.col("engine_mode") == "cloud", MODES["cloud"]).when(F.col("engine_mode") == "local", MODES["local"]).otherwise(F.col("engine_mode"))
    route = F.array_join(F.filter(F.array(mode, F.col("engine_model"), F.col("engine_at")), lambda x: F.coalesce(x, F.lit("")) != ""), " / ")
    row = lambda seq, value, keep=None: F.when(keep if keep is not None else F.lit(True), F.struct(F.lit(seq).alias("seq"), F.lit(ITEMS[seq - 1]).alias("item"), value.alias("value")))
    return F.array_compact(
        F.array(
            row(1, F.concat(F.regexp_extract("audio_path", r"([^/\\]*)$", 1), F.lit(" ("), format_hms(F.col("duration")), F.lit(")"))),
            row(2, F.col("source_sha256"), F.coalesce("source_sha256", F.lit("")) != ""),
            row(3, route, (F.coalesce("engine_mode", F.lit("")) != "") | (F.coalesce("engine_model", F.lit("")) != "")),
            row(4, F.concat(F.lit("revision "), revision.cast("string"), F.lit(f" (schema {SCHEMA_VERSION})"))),
            row(5, F.concat(F.lit(HEARD), t["heard"], F.lit(BULK), t["bulk"], F.lit(OPEN), t["open"])),
            row(6, F.concat(F.lit(TIMES_HEARD), t["t_heard"], F.lit(TIMES_BULK), t["t_bulk"])),
            row(7, F.lit(CAUTION)),
        )
    )


def verification_summary(recordings: DataFrame, segments: DataFrame, revision: Column | None = None) -> DataFrame:
    """(recording_id, seq, item, value): source, digest, route, version, and counts of checked speakers and times."""
    rows = recordings.join(_counts(segments), RID, "left").select(RID, F.explode(_facts(F.col("doc_revision") if revision is None else revision)).alias("f"))
    return rows.select(RID, "f.seq", "f.item", "f.value")


def minutes_document(
    recordings: DataFrame, speakers: DataFrame, segments: DataFrame, with_timestamps: bool = True, merge_consecutive: bool = True, include_note: bool = True,
    include_attendees: bool = True, drop_noise: bool = True, include_verification: bool = True, revision: Column | None = None,
) -> DataFrame:
    """(recording_id, section, seq, text, tone): the rows of a document; an export without a stated revision is the next one."""
    sec = lambda df, k, seq, text, tone="normal": df.select(RID, F.lit(k).alias("section"), seq.cast("long").alias("seq"), text.alias("text"), (tone if isinstance(tone, Column) else F.lit(tone)).alias("tone"))
    parts = [sec(recordings, 1, F.lit(0), F.regexp_replace(F.regexp_extract("audio_path", r"([^/\\]*)$", 1), r"\.[^.]*$", ""), "heading")]
    if include_attendees:
        shown = F.when(F.coalesce("note", F.lit("")) != "", F.concat("name", F.lit("("), "note", F.lit(")"))).otherwise(F.col("name"))
        names = speakers.groupBy(RID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("t")))), lambda x: x["t"]), "、").alias("names"))
        parts.append(sec(names, 2, F.lit(0), F.concat(F.lit(ATTENDEES), "names")))
    if include_note:
        parts.append(sec(review_note(segments), 3, F.lit(0), F.col("note"), "grey"))
    body = resolve_speakers(minutes(segments, merge_consecutive, drop_noise), speakers)
    tone = F.when(F.col("speaker_id").isNull(), "red").when(F.col("speaker_id").isin(*SPECIALS), "grey").otherwise("normal")
    label = F.concat(F.lit("【"), F.coalesce("speaker_name", F.lit(UNKNOWN_LABEL)), F.lit("】 "), F.col("text"))
    stamp = F.concat(F.lit("["), format_hms(F.col("seg_start")), F.lit("] "), label) if with_timestamps else label
    parts.append(sec(body, 4, F.col("first_idx"), stamp, tone))
    if include_verification:
        facts = verification_summary(recordings, segments, F.col("doc_revision") + 1 if revision is None else revision)
        parts.append(sec(facts, 5, F.col("seq"), F.concat("item", F.lit(": "), "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_minutes(segments: DataFrame, speakers: DataFrame, path: str, **options) -> None:
    """Text files by recording, one line for each run, in order."""
    lines = minutes_lines(segments, speakers, **options)
    lines.repartition(RID).sortWithinPartitions(RID, "first_idx").select(RID, "line").write.partitionBy(RID).text(path)
