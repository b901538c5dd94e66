"""Proposals for better times, from measured ones: one chain of reasons over a left join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.snapshots import audio_spans

RID = "recording_id"
START_PAD, END_PAD = 0.30, 0.20
REASONS = ("unmatched", "reviewed", "short_match", "low_coverage", "scattered", "stretched", "head_lost", "close_enough")
WEAK = ("low_coverage", "short_match", "scattered", "stretched", "head_lost", "conflicted")


# How evidence is worded.
MATCHED = "一致 %d/%d 文字(被覆 %.0f%%)・ずれ 開始 %+.1f 秒"
TAIL_KEPT = "・終わりは測れず(いまの長さを保つ)"
TAIL = " / 終了 %+.1f 秒"
HEAD = "・頭の欠け %d 字を %.1f 秒手前に補正"


def proposal_id(kind: Column, orig_start: Column, start: Column, end: Column) -> Column:
    """The same evidence gives the same id."""
    return F.substring(F.sha2(F.format_string("%s|%.3f|%.2f|%.2f", kind, orig_start, start, end).cast("binary"), 256), 1, 12)


def evidence(matched: Column, total: Column, coverage: Column, d_start: Column, d_end: Column, keep_tail: Column, head_gap: Column, head_seconds: Column) -> Column:
    base = F.format_string(MATCHED, matched, total, coverage * 100, d_start)
    tail = F.when(keep_tail, TAIL_KEPT).otherwise(F.format_string(TAIL, d_end))
    return F.concat(base, tail, F.when(head_seconds >= 0.1, F.format_string(HEAD, head_gap, head_seconds)).otherwise(""))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "mid").when(confidence.isNotNull(), "low")


def propose_times(
    segments: DataFrame, measured: DataFrame, recordings: DataFrame, min_coverage: float = 0.60, min_matched: int = 8, min_density: float = 1.5, time_delta: float = 0.75,
    tail_gap_limit: int = 3, head_comp_max: float = 6.0, stretch_ratio: float = 1.5,
) -> DataFrame:
    """One row per segment: the first reason why it gets no proposal, or the proposal with its raw span (s, e).

    measured: recording_id, idx, m_start, m_end, coverage, matched, total, head_gap, tail_gap."""
    rows = audio_spans(segments, recordings).join(measured, [RID, "idx"], "left")
    length = F.col("now_end") - F.col("now_start")
    rate = F.col("matched") / F.greatest(F.lit(0.1), F.col("m_end") - F.col("m_start"))
    lost = F.col("head_gap") / rate
    start = F.greatest(F.lit(0.0), F.col("m_start") - lost)
    reason = (
        F.when(F.col("m_start").isNull(), "unmatched")
        .when(F.coalesce("time_reviewed", F.lit(False)), "reviewed")
        .when(F.col("matched") < min_matched, "short_match")
        .when(F.col("coverage") < min_coverage, "low_coverage")
        .when(rate < min_density, "scattered")
        .when(F.col("m_end") - F.col("m_start") > length * stretch_ratio + 1.0, "stretched")
        .when(lost > head_comp_max, "head_lost")
        .when(F.abs(start - F.col("now_start")) < time_delta, "close_enough")
        .otherwise("proposal")
    )
    keep_tail = F.col("tail_gap") >= tail_gap_limit
    p_start = F.greatest(F.lit(0.0), start - START_PAD)
    p_end = F.when(keep_tail, p_start + length).otherwise(F.col("m_end") + F.col("tail_gap") / rate + END_PAD)
    only = lambda c: F.when(F.col("reason") == "proposal", c)
    noted = (F.col("reason") == "reviewed") & (F.abs(F.col("m_start") - F.col("now_start")) > time_delta)
    return rows.withColumn("reason", reason).select(
        RID, "idx", "reason", only(proposal_id(F.lit("time"), F.col("orig_start"), p_start, p_end)).alias("id"), only(F.col("orig_start")).alias("target_orig_start"), only(F.round("now_start", 2)).alias("target_now"),
        only(F.round(p_start, 2)).alias("p_start"), only(F.round(p_end, 2)).alias("p_end"), only(start).alias("s"), only(F.when(keep_tail, start + length).otherwise(F.col("m_end"))).alias("e"), only(F.col("coverage")).alias("confidence"),
        only(evidence(F.col("matched"), F.col("total"), F.col("coverage"), start - F.col("now_start"), F.col("m_end") - F.col("now_end"), keep_tail, F.col("head_gap"), lost)).alias("evidence"),
        F.when(noted, F.col("m_start") - F.col("now_start")).alias("note_delta"),
    )


def inspect_summary(reasons: DataFrame) -> DataFrame:
    """Tallies of reasons by recording; weak are those that were measured but not trusted."""
    kinds = REASONS
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in kinds]
    return reasons.groupBy(RID).agg(F.count("*").alias("checked"), F.count_if(F.col("reason") == "proposal").alias("proposals"), *counts, F.count_if(F.col("reason").isin(*WEAK)).alias("weak"))


def apply_proposals(segments: DataFrame, planned: DataFrame, reviewed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, edits): planned times written, edited and heard or not; edits hold what was there before."""
    rows = segments.join(planned.select(RID, "idx", "id", "new_start", "new_end"), [RID, "idx"], "left")
    hit = F.col("new_start").isNotNull()
    new = {"seg_start": F.coalesce("new_start", "seg_start"), "seg_end": F.coalesce("new_end", "seg_end"), "time_edited": hit | F.coalesce("time_edited", F.lit(False)), "time_reviewed": F.when(hit, reviewed).otherwise(F.col("time_reviewed"))}
    fields = ("seg_start", "seg_end", "time_edited", "time_reviewed")
    log = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), new[f].cast("string").alias("after")) for f in fields])).alias("x")
    edits = rows.filter(hit).select(RID, "idx", F.col("id").alias("proposal_id"), log).select(RID, "idx", "proposal_id", "x.field", "x.before", "x.after")
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in segments.columns]), edits
