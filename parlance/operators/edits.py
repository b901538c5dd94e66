"""Edits as change tables: a batch of decisions is one join, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import audio_start, clamp_span, estimate_speech, is_pseudo, round1, trim
from parlance.operators.snapshots import audio_spans
from parlance.schemas import MIN_EDIT_SECONDS

RID = "recording_id"
KEY = [RID, "idx"]


def _renumbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(RID).orderBy(*order)) - 1).cast("long"))


def assign_speakers(segments: DataFrame, decisions: DataFrame, bulk: bool = True) -> DataFrame:
    """decisions (recording_id, idx, speaker_id, seq): the last one for a row decides it and counts as heard; in bulk the
    first one in a cluster of one voice also fills the cluster's open rows, unheard. A null speaker takes a row's away."""
    last = decisions.groupBy(*KEY).agg(F.max(F.struct("seq", F.lit(True).alias("told"), "speaker_id")).alias("d"))
    rows = segments.join(last, KEY, "left")
    told = F.col("d.told").isNotNull()
    speaker, heard = F.when(told, F.col("d.speaker_id")).otherwise(F.col("speaker_id")), F.when(told, F.col("d.speaker_id").isNotNull()).otherwise(F.col("reviewed"))
    if bulk:
        voices = decisions.filter("speaker_id is not null").select(*KEY, "seq", F.col("speaker_id").alias("s")).join(segments.filter(~is_pseudo(F.col("cluster"))).select(*KEY, "cluster"), KEY)
        first = voices.groupBy(RID, "cluster").agg(F.min(F.struct("seq", "s"))["s"].alias("fill"))
        rows = rows.join(first, [RID, "cluster"], "left")
        fills = ~told & F.col("speaker_id").isNull() & F.col("fill").isNotNull()
        speaker, heard = F.when(fills, F.col("fill")).otherwise(speaker), F.when(fills, False).otherwise(heard)
    return rows.withColumns({"new_speaker": speaker, "reviewed": heard}).withColumn("speaker_id", F.col("new_speaker")).select(*segments.columns)


def unassign_clusters(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of the given clusters lose their speaker."""
    hit = segments.join(clusters.select(RID, "cluster", F.lit(True).alias("hit")).distinct(), [RID, "cluster"], "left")
    clear = F.col("hit").isNotNull() & F.col("speaker_id").isNotNull()
    return hit.withColumns({"reviewed": F.when(clear, False).otherwise(F.col("reviewed")), "speaker_id": F.when(~clear, F.col("speaker_id"))}).select(*segments.columns)


def split_segments(segments: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, rejected): splits (recording_id, idx, boundary, cut). The tail is an unknown voice without a speaker."""
    rows = segments.join(splits.select(*KEY, "boundary", "cut"), KEY, "left")
    asked = F.col("boundary").isNotNull()
    length = F.col("seg_end") - F.col("seg_start")
    fits = F.coalesce(asked & (length >= 2 * MIN_EDIT_SECONDS), F.lit(False))
    at = F.least(F.greatest(round1(F.col("boundary")), F.col("seg_start") + MIN_EDIT_SECONDS), F.col("seg_end") - MIN_EDIT_SECONDS)
    cut = F.greatest(F.lit(0), F.least(F.col("cut"), F.char_length("text"))).cast("int")
    own = {c: F.col(c) for c in segments.columns}
    both = {"reviewed": F.lit(False), "time_edited": F.lit(True)}
    head = own | both | {"seg_end": at, "text": F.substring("text", F.lit(1), cut)}
    tail = own | both | {"seg_start": at, "text": F.substring("text", cut + 1, F.char_length("text")), "cluster": F.concat(F.col("chunk").cast("string"), F.lit(":?")), "speaker_id": F.lit(None).cast("string"), "note": F.lit("")}

    def part(cols: dict, k: int) -> Column:
        return F.struct(F.lit(k).alias("part"), *[cols[c].alias(c) for c in segments.columns])

    out = rows.select(F.explode(F.when(fits, F.array(part(head, 0), part(tail, 1))).otherwise(F.array(part(own, 0)))).alias("s")).select("s.*")
    return _renumbered(out, "idx", "part").select(*segments.columns), rows.filter(asked & ~fits).select(*KEY)


def merge_segments(segments: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, rejected): merges (recording_id, idx) joins a row with the next one. Of a chain of such rows every second
    request is rejected, as its row has just been absorbed; so is one without a next row."""
    w = Window.partitionBy(RID).orderBy("idx")
    rows = segments.join(merges.select(*KEY, F.lit(True).alias("asked")).distinct(), KEY, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.col("asked"), 0).otherwise(1)).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy(RID, "chain", "asked").orderBy("idx")))
    names = ["idx", *[c for c in segments.columns if c not in KEY]]
    rows = rows.withColumn("n", F.lead(F.struct(*names)).over(w))
    rows = rows.withColumn("takes", F.col("asked") & (F.col("nth") % 2 == 1) & F.col("n").isNotNull())
    rows = rows.withColumn("gone", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    n = lambda c: F.col(f"n.{c}")
    notes = F.array_join(F.filter(F.array(F.coalesce("note", F.lit("")), F.coalesce(n("note"), F.lit(""))), lambda x: x != ""), " / ")
    merged = {
        "seg_start": F.least("seg_start", n("seg_start")), "seg_end": F.greatest("seg_end", n("seg_end")), "text": F.concat("text", n("text")), "speaker_id": F.when(F.col("speaker_id") == n("speaker_id"), F.col("speaker_id")),
        "reviewed": F.lit(False), "note": notes, "text_edited": F.col("text_edited") | n("text_edited"), "time_edited": F.lit(True), "time_reviewed": F.col("time_reviewed") & n("time_reviewed"), "orig_end": n("orig_end"),
    }
    out = rows.filter("not gone").select(*[F.when(F.col("takes"), merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c) for c in segments.columns])
    return _renumbered(out, "idx").select(*segments.columns), rows.filter("asked and not takes").select(*KEY)


def _written(rows: DataFrame, columns: list[str], hit: Column, start: Column, end: Column, heard: Column) -> DataFrame:
    new = {"seg_start": F.when(hit, start).otherwise(F.col("seg_start")), "seg_end": F.when(hit, end).otherwise(F.col("seg_end")), "time_edited": hit | F.coalesce("time_edited", F.lit(False)), "time_reviewed": F.when(hit, heard).otherwise(F.col("time_reviewed"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in columns])


def apply_time_edits(segments: DataFrame, edits: DataFrame, recordings: DataFrame) -> DataFrame:
    """edits (recording_id, idx, op, value, slide): op is start or end (move that edge to value) or shift (move the span by value);
    slide lets an edge that is moved past the other take the whole span along."""
    rows = audio_spans(segments, recordings).join(recordings.select(RID, "duration"), RID, "left").join(edits.select(*KEY, "op", "value", F.coalesce("slide", F.lit(False)).alias("slide")), KEY, "left")
    s, e, v, top = F.col("now_start"), F.col("now_end"), F.col("value"), F.coalesce("duration", F.lit(0.0))
    span = F.greatest(F.lit(MIN_EDIT_SECONDS), e - s)
    s_start, e_start = clamp_span(v, F.when(F.col("slide") & (v > e - MIN_EDIT_SECONDS), v + span).otherwise(e), top, "start")
    s_end, e_end = clamp_span(F.when(F.col("slide") & (v < s + MIN_EDIT_SECONDS), v - span).otherwise(s), v, top, "end")
    s_shift = F.greatest(F.lit(0.0), round1(s + v))
    e_shift = round1(s_shift + span)
    over = (top > 0) & (e_shift > top)
    e_top = round1(top)
    op = F.col("op")
    start = F.when(op == "start", s_start).when(op == "end", s_end).otherwise(F.when(over, F.greatest(F.lit(0.0), round1(e_top - span))).otherwise(s_shift))
    end = F.when(op == "start", e_start).when(op == "end", e_end).otherwise(F.when(over, e_top).otherwise(e_shift))
    return _written(rows, segments.columns, F.col("op").isNotNull(), start, end, F.lit(True))


def confirm_times(segments: DataFrame, rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """The rows' present places in the audio become their times, heard by a person."""
    spans = audio_spans(segments, recordings).join(rows.select(*KEY, F.lit(True).alias("hit")).distinct(), KEY, "left")
    return _written(spans, segments.columns, F.coalesce("hit", F.lit(False)), F.col("now_start"), F.col("now_end"), F.lit(True))


def revert_times(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Edited rows get their original times back."""
    hit = F.col("hit").isNotNull() & F.coalesce("time_edited", F.lit(False))
    both = segments.join(rows.select(*KEY, F.lit(True).alias("hit")).distinct(), KEY, "left").withColumn("back", hit)
    new = {"seg_start": F.col("orig_start"), "seg_end": F.col("orig_end"), "time_edited": F.lit(False), "time_reviewed": F.lit(False)}
    return both.select(*[F.when(F.col("back"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in segments.columns])


def apply_text_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (recording_id, idx, new_text): a stripped text that differs replaces the row's."""
    rows = segments.join(edits.select(*KEY, trim(F.col("new_text")).alias("new_text")), KEY, "left")
    hit = F.coalesce(F.col("new_text") != F.col("text"), F.lit(False))
    new = {"text": F.when(hit, F.col("new_text")).otherwise(F.col("text")), "text_edited": hit | F.coalesce("text_edited", F.lit(False))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in segments.columns])


def set_offsets(recordings: DataFrame, edits: DataFrame, limit: float = 10.0) -> DataFrame:
    """edits (recording_id, new_offset): to hundredths, within the limit either way."""
    value = F.when(F.col("new_offset").isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.bround("new_offset", 2))))
    return recordings.join(edits.select(RID, "new_offset"), RID, "left").withColumn("time_offset", F.coalesce(value, "time_offset")).select(*recordings.columns)


#: Fields that a log of edits can restore, with their types.
LOGGED = {"speaker_id": "string", "reviewed": "boolean", "seg_start": "double", "seg_end": "double", "time_edited": "boolean", "time_reviewed": "boolean", "text": "string"}


#: Fields whose batches are undone as a whole or not at all.
TIMES = ("seg_start", "seg_end", "time_edited", "time_reviewed")


def _moved(edits: DataFrame, structure: DataFrame) -> DataFrame:
    """edits with idx as it is after the splits and merges that came later, null where the row is gone, and ``later``: whether any came.

    structure (recording_id, at, kind, idx): a split makes two rows of idx, a merge takes idx + 1 into idx."""
    events = structure.groupBy(RID).agg(F.array_sort(F.collect_list(F.struct("at", "kind", F.col("idx").cast("long").alias("idx")))).alias("_events"))
    rows = edits.join(events, RID, "left").withColumn("_events", F.filter(F.coalesce("_events", F.array()), lambda e: e["at"] > F.col("at")))

    def step(idx: Column, e: Column) -> Column:
        split = F.when(idx > e["idx"], idx + 1).otherwise(idx)
        merge = F.when(idx == e["idx"] + 1, None).when(idx > e["idx"], idx - 1).otherwise(idx)
        return F.when(e["kind"] == "split", split).otherwise(merge)

    moved = F.aggregate("_events", F.col("idx").cast("long"), step)
    return rows.withColumns({"idx": moved, "later": F.size("_events") > 0}).drop("_events")


def refused_batches(edits: DataFrame, batch_ids: DataFrame, structure: DataFrame) -> DataFrame:
    """(recording_id, batch_id) of the given batches of times after which a row was split or merged: they are not undone."""
    asked = edits.filter(F.col("field").isin(*TIMES)).join(batch_ids.select("batch_id").distinct(), "batch_id", "left_semi")
    return _moved(asked, structure).filter("later").select(RID, "batch_id").distinct()


def undo_batches(segments: DataFrame, edits: DataFrame, batch_ids: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """edits (recording_id, idx, field, before, after, at, batch_id), values as text: fields that the given batches touched get
    what the remaining edits left, or what was there before the first edit.

    With a log of splits and merges (recording_id, at, kind, idx) edits follow their rows to the places these have now; what a merge swallowed
    is not restored, and batches of times that came before are left as they are (see refused_batches)."""
    marked = edits.join(batch_ids.select("batch_id", F.lit(True).alias("undone")).distinct(), "batch_id", "left")
    if structure is not None:
        refused = refused_batches(edits, batch_ids, structure).withColumn("refused", F.lit(True))
        marked = _moved(marked, structure).filter("idx is not null").join(refused, [RID, "batch_id"], "left").withColumn("undone", F.when(F.col("refused").isNull() | ~F.col("field").isin(*TIMES), F.col("undone")))
    state = marked.groupBy(*KEY, "field").agg(
        F.max(F.coalesce("undone", F.lit(False))).alias("touched"), F.max(F.when(F.col("undone").isNull(), F.struct("at", "after"))).alias("rest"), F.min(F.struct("at", "before")).alias("first")
    )
    value = F.struct(F.when(F.col("rest").isNotNull(), F.col("rest.after")).otherwise(F.col("first.before")).alias("v"))
    wide = state.filter("touched").groupBy(*KEY).pivot("field", list(LOGGED)).agg(F.first(value))
    back = wide.select(*KEY, *[F.col(f).alias(f"_{f}") for f in LOGGED])
    rows = segments.join(back, KEY, "left")
    return rows.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(LOGGED[c])).otherwise(F.col(c)).alias(c) if c in LOGGED else F.col(c) for c in segments.columns])


def review_windows(segments: DataFrame, recordings: DataFrame, back: float = 0.0, extend: float = 0.0, tail: float = 3.0) -> DataFrame:
    """(recording_id, idx, play_from, play_to, tail_from, tail_to): what to listen to, as long as the text needs and some more."""
    rows = segments.join(recordings.select(RID, "time_offset"), RID, "left")
    edited, offset = F.coalesce("time_edited", F.lit(False)), F.coalesce("time_offset", F.lit(0.0))
    shift = F.when(edited, 0.0).otherwise(offset)
    length = F.col("seg_end") - F.col("seg_start")
    need = F.greatest(F.lit(8.0), F.least(F.lit(60.0), estimate_speech(F.col("text")) + 5.0))
    heard = F.when(length <= 0, need).otherwise(F.least(F.greatest(length, F.lit(1.5)), need))
    end = F.col("seg_end") if extend > 0 else F.when(edited, F.col("seg_end")).otherwise(F.col("seg_start") + heard)
    s, e = (audio_start(offset, edited, F.col(c)) for c in ("seg_start", "seg_end"))
    short = F.least(F.lit(tail), F.greatest(F.lit(MIN_EDIT_SECONDS), e - s))
    return rows.select(*KEY, F.greatest(F.lit(0.0), F.col("seg_start") + shift - back).alias("play_from"), (end + shift + extend).alias("play_to"), F.greatest(F.lit(0.0), e - short).alias("tail_from"), e.alias("tail_to"))
