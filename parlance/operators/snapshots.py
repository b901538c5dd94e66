"""Joins between proposals, points and snapshots of segments.

Nearest and interval matches have no built-in join: here they are equi joins on rounded or binned times with the exact
condition on top, or one sorted pass with running values. Greedy choices are left to a small fold over narrow rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import audio_start, clamp_span, format_hms
from parlance.schemas import MIN_EDIT_SECONDS, SEGMENT_COLUMNS
from parlance.sources.shared import kept

RID = "recording_id"
#: Rounds in which families are matched at once.
ROUNDS = 3
MATCH_SECONDS, TARGET_SECONDS, CONFLICT_SHARE, BIN_SECONDS = 2.0, 5.0, 0.5, 60.0


def audio_spans(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """now_start and now_end: where a segment lies in the audio."""
    offset = F.coalesce("time_offset", F.lit(0.0))
    rows = segments.join(recordings.select(RID, "time_offset"), RID, "left")
    edited = F.coalesce("time_edited", F.lit(False))
    return rows.withColumns({"now_start": audio_start(offset, edited, F.col("seg_start")), "now_end": audio_start(offset, edited, F.col("seg_end"))}).drop("time_offset")


def target_segments(proposals: DataFrame, segments: DataFrame, recordings: DataFrame, tol: float = TARGET_SECONDS) -> DataFrame:
    """proposals with idx: the segment with the same original start; of several the one nearest to where it was, within tol."""
    spans = audio_spans(segments, recordings).select(RID, "idx", "seg_start", "orig_start", "now_start", F.round(F.col("orig_start") * 1e6).cast("long").alias("key"))
    near = F.round(F.col("target_orig_start") * 1e6).cast("long")
    asked = proposals.withColumn("key", F.explode(F.array(near - 1, near, near + 1)))
    found = asked.join(spans, [RID, "key"]).filter(F.abs(F.col("orig_start") - F.col("target_orig_start")) < 1e-6)
    w = Window.partitionBy(RID, "id")
    found = found.withColumns({"same": F.count("*").over(w), "gap": F.abs(F.col("now_start") - F.col("target_now"))})
    plain = (F.col("same") == 1) | F.col("target_now").isNull()
    first = F.row_number().over(w.orderBy(F.when(plain, F.lit(0.0)).otherwise(F.col("gap")), F.when(plain, F.col("seg_start")), "idx"))
    best = found.withColumn("k", first).filter(F.col("k") == 1).select(RID, "id", F.when(plain | (F.col("gap") <= tol), F.col("idx")).alias("idx"))
    return proposals.join(best, [RID, "id"], "left")


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (recording_id, t) with idx: the segment that starts nearest to t, the earlier row of equals."""
    starts = segments.groupBy(RID, F.col("seg_start").alias("t")).agg(F.min("idx").alias("s_idx"))
    at = F.when(F.col("s_idx").isNotNull(), F.struct("t", "s_idx"))
    rows = points.select(RID, "t").distinct().withColumn("s_idx", F.lit(None).cast("long")).unionByName(starts)
    w = Window.partitionBy(RID).orderBy("t")
    rows = rows.withColumns({"before": F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "after": F.first(at, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    early = F.least("before.s_idx", "after.s_idx")
    pick = F.when(back.isNull(), F.col("after.s_idx")).when(ahead.isNull(), F.col("before.s_idx")).when(back == ahead, early).when(back < ahead, F.col("before.s_idx")).otherwise(F.col("after.s_idx"))
    found = rows.filter("s_idx is null").select(RID, "t", pick.alias("idx"))
    return points.join(found, [RID, "t"], "left")


def drop_conflicts(proposals: DataFrame, ratio: float = CONFLICT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): proposals (recording_id, id, p_start, p_end) that overlap by more than a share of the shorter go, both of them."""
    spans = proposals.select(RID, "id", F.col("p_start").alias("s"), F.col("p_end").alias("e"))
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / BIN_SECONDS), F.floor(F.greatest("s", "e") / BIN_SECONDS))))
    a, b = binned.toDF(RID, "a", "s1", "e1", "bin"), binned.toDF(RID, "b", "s2", "e2", "bin")
    later = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("a") < F.col("b")))
    shorter = F.greatest(F.lit(MIN_EDIT_SECONDS), F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")))
    clash = (F.col("s2") < F.col("e1")) & (F.least("e1", "e2") - F.col("s2") > ratio * shorter)
    pairs = a.join(b, [RID, "bin"]).filter(later & (F.col("bin") == F.floor(F.col("s2") / BIN_SECONDS)) & clash)  # each pair in one bin
    bad = pairs.select(RID, F.explode(F.array("a", "b")).alias("id")).distinct()
    return proposals.join(bad, [RID, "id"], "left_anti"), proposals.join(bad, [RID, "id"], "left_semi")


def plan_proposals(proposals: DataFrame, segments: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(planned, failed): planned (recording_id, id, idx, new_start, new_end). All destinations are known before any is
    clipped, so the order of proposals does not matter, but for two that want one segment: the smaller id has it."""
    aimed = target_segments(proposals, segments, recordings)
    free = audio_spans(segments, recordings)
    open_rows = free.filter(~F.coalesce("time_reviewed", F.lit(False))).select(RID, "idx")
    ranked = aimed.join(open_rows, [RID, "idx"]).withColumn("k", F.row_number().over(Window.partitionBy(RID, "idx").orderBy("id")))
    taken = ranked.filter("k = 1").select(RID, "idx", "id", "p_start", "p_end")
    rows = free.select(RID, "idx", "now_start", "now_end").join(taken, [RID, "idx"], "left")
    w = Window.partitionBy(RID).orderBy("idx")
    ends, begins = F.lag(F.coalesce("p_end", "now_end")).over(w), F.lead(F.coalesce("p_start", "now_start")).over(w)
    rows = rows.withColumns({"left": F.greatest("p_start", ends), "right": F.least("p_end", begins)}).filter("id is not null")
    rows = rows.filter(F.col("right") - F.col("left") >= MIN_EDIT_SECONDS).join(recordings.select(RID, "duration"), RID, "left")
    s, e = clamp_span(F.col("left"), F.col("right"), F.coalesce("duration", F.lit(0.0)), "end")
    planned = rows.select(RID, "id", "idx", s.alias("new_start"), e.alias("new_end"))
    return planned, proposals.join(planned.select(RID, "id"), [RID, "id"], "left_anti")


def merge_history(fresh: DataFrame, history: DataFrame) -> DataFrame:
    """Fresh proposals on which nobody has decided yet."""
    return fresh.join(decided_history(history).select(RID, "id").distinct(), [RID, "id"], "left_anti")


def decided_history(history: DataFrame) -> DataFrame:
    return history.filter(F.col("status").isin("accepted", "rejected"))


def to_save(fresh: DataFrame, history: DataFrame) -> DataFrame:
    """What is stored after a check: undecided fresh proposals and everything decided."""
    return merge_history(fresh, history).unionByName(decided_history(history))


def window_words(segments: DataFrame, track: DataFrame) -> DataFrame:
    """segments (recording_id, idx, t0, t1) with lo and hi: the half-open range of characters that touch [t0, t1]."""

    def counted(time: str, query: str, strict: bool, out: str) -> DataFrame:
        marks = track.select(RID, F.col(time).alias("t"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("idx"))
        asks = segments.select(RID, F.col(query).alias("t"), F.lit(0).alias("one"), "idx")
        order = Window.partitionBy(RID).orderBy("t", F.when(F.col("idx").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)).rowsBetween(Window.unboundedPreceding, 0)
        return marks.unionByName(asks).withColumn(out, F.sum("one").over(order)).filter("idx is not null").select(RID, "idx", out)

    lo, hi = counted("c_end", "t0", True, "lo"), counted("c_start", "t1", False, "hi")
    return segments.join(lo, [RID, "idx"]).join(hi, [RID, "idx"]).withColumn("hi", F.greatest("lo", "hi"))


def _greedy(rows: pd.DataFrame, tol: float) -> pd.DataFrame:
    """Each new segment, in order, takes the nearest family that is not taken; candidates come sorted by (pos, gap, family)."""
    used, out = set(), []
    for pos, cand in rows.sort_values(["pos", "gap", "family"]).groupby("pos", sort=True):
        for family in cand["family"]:
            if family not in used:
                used.add(family)
                out.append((pos, family))
                break
    return pd.DataFrame(out, columns=["pos", "family"])


def match_families(old: DataFrame, new: DataFrame, tol: float = MATCH_SECONDS) -> DataFrame:
    """(recording_id, pos, family): which family of old rows (one original start) each new segment continues: in order, the nearest that is still free.

    Who comes first among all that are near a family has it for certain if it is its own nearest; such choices are made by windows, all at once, and what is near
    neither them nor what they took stays open. Only what is still open after ``ROUNDS`` is folded one by one."""
    changed = old.filter("speaker_id is not null or text_edited or time_edited")
    families = changed.groupBy(RID, F.round("orig_start", 3).alias("family")).agg(F.min_by("orig_start", F.struct("seg_start", "idx")).alias("f_start"))
    left = families.withColumn("bin", F.floor(F.col("f_start") / tol))
    right = new.select(RID, F.col("idx").alias("pos"), F.col("seg_start").alias("n_start"), F.explode(F.array(*[F.floor(F.col("seg_start") / tol) + d for d in (-1, 0, 1)])).alias("bin"))
    near = left.join(right, [RID, "bin"]).withColumn("gap", F.abs(F.col("f_start") - F.col("n_start"))).filter(F.col("gap") < tol + 1e-9).select(RID, "pos", "family", "gap")

    near, fixed = kept(near, "near-families"), []
    for _ in range(ROUNDS):
        first = F.min("pos").over(Window.partitionBy(RID, "family"))
        place = F.row_number().over(Window.partitionBy(RID, "pos").orderBy("gap", "family"))
        sure = kept(near.withColumns({"first": first, "place": place}).filter("place = 1 and pos = first").select(RID, "pos", "family"), "sure-families")
        fixed.append(sure)
        near = kept(near.join(sure.select(RID, "pos"), [RID, "pos"], "left_anti").join(sure.select(RID, "family"), [RID, "family"], "left_anti"), "open-families")
        if near.isEmpty():
            break
    else:

        def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = _greedy(rows, tol)
            out.insert(0, RID, key[0])
            return out

        fixed.append(near.groupBy(RID).applyInPandas(fold, f"{RID} long, pos long, family double"))
    out = fixed[0]
    for part in fixed[1:]:
        out = out.unionByName(part)
    return out


def carry_over(old: DataFrame, new: DataFrame, tol: float = MATCH_SECONDS, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, audit): people's decisions moved from a recording's old segments to its new ones.

    A single family without edited times lends speaker, note and edited text to the new row; any other family replaces it.
    New rows that start inside a family with edited times, and continue none, are absorbed. With ``places`` the audit also has absorbed_at,
    where the first five of them were."""
    order = [c for c in SEGMENT_COLUMNS if c in new.columns]
    old, new = kept(old, "old-segments"), kept(new, "new-segments")
    changed = old.filter("speaker_id is not null or text_edited or time_edited").withColumn("family", F.round("orig_start", 3))
    size = Window.partitionBy(RID, "family")
    changed = changed.withColumns({"members": F.count("*").over(size), "edited": F.max(F.coalesce("time_edited", F.lit(False))).over(size)})
    matched = kept(match_families(old, new, tol), "matched")
    fam = kept(matched.join(changed, [RID, "family"]), "continued")
    whole = fam.filter("members > 1 or edited").select(RID, "pos", *[F.col(c) for c in order if c != RID])
    lend = fam.filter("members = 1 and not edited").select(RID, "pos", F.col("speaker_id").alias("o_speaker"), F.col("reviewed").alias("o_reviewed"), F.col("note").alias("o_note"), F.when(F.col("text_edited"), F.col("text")).alias("o_text"))
    ranges = fam.filter("time_edited").select(RID, F.col("orig_start").alias("a"), F.col("orig_end").alias("b"), F.explode(F.sequence(F.floor(F.col("orig_start") / BIN_SECONDS), F.floor(F.greatest("orig_start", "orig_end") / BIN_SECONDS))).alias("bin"))
    alone = new.withColumn("pos", F.col("idx")).join(matched.select(RID, "pos"), [RID, "pos"], "left_anti").withColumn("bin", F.floor(F.col("seg_start") / BIN_SECONDS))
    inside = kept(alone.join(ranges, [RID, "bin"]).filter("a < seg_start and seg_start < b").select(RID, "pos", "seg_start").distinct(), "absorbed")
    free = alone.join(inside.select(RID, "pos"), [RID, "pos"], "left_anti").drop("bin")
    moved = new.withColumn("pos", F.col("idx")).join(lend, [RID, "pos"])
    moved = moved.withColumns(
        {
            "speaker_id": F.coalesce("o_speaker", "speaker_id"), "reviewed": F.when(F.col("o_speaker").isNotNull(), F.col("o_reviewed")).otherwise(F.col("reviewed")), "note": F.col("o_note"),
            "text": F.coalesce("o_text", "text"), "text_edited": F.col("o_text").isNotNull() | F.coalesce("text_edited", F.lit(False)),
        }
    )
    cols = [RID, "pos", *[c for c in order if c != RID]]
    tag = lambda df, how: df.select(*cols, F.lit(how).alias("how"))
    rows = kept(tag(free, "new").unionByName(tag(moved, "carried")).unionByName(tag(whole, "replaced")), "carried")
    place = F.row_number().over(Window.partitionBy(RID).orderBy("pos", "seg_start", "idx")) - 1
    segments = rows.withColumn("idx", place.cast("long"))
    old_side = F.col("how") != "new"
    counts = rows.groupBy(RID).agg(
        F.count_if(old_side & F.col("speaker_id").isNotNull()).alias("carried"), F.count_if(old_side & F.col("text_edited")).alias("texts"), F.count_if(F.col("how") == "replaced").alias("replaced")
    )
    audit = counts.join(inside.groupBy(RID).agg(F.count("*").alias("absorbed")), RID, "full_outer").fillna(0, ["carried", "texts", "replaced", "absorbed"])
    if places:
        at = F.when(F.row_number().over(Window.partitionBy(RID).orderBy("seg_start", "pos")) <= 5, F.struct("seg_start", "pos", format_hms(F.col("seg_start")).alias("t")))
        where = inside.withColumn("at", at).groupBy(RID).agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["t"]), " ").alias("absorbed_at"))
        audit = audit.join(where, RID, "left").fillna("", ["absorbed_at"])
    return segments.select(*order), audit
