"""Rosters: reading them from text, and bringing a stored one in line with a new one without renaming anybody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import LINE_BREAK, trim

RID = "recording_id"
# Fixed value: a line of a roster, '- name(note): note' in ASCII or full width.
LINE = r"^\s*(?:[-*・]\s*)?([^(（:：]+?)(?:[(（]([^)）]*)[)）])?\s*(?:[:：]\s*(.*))?$"


def _id(number: Column) -> Column:
    return F.concat(F.lit("sp"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")))


def parse_rosters(rosters: DataFrame) -> DataFrame:
    """rosters (recording_id, text) to speakers; ids come from line numbers, blank lines included."""
    lines = rosters.select(RID, F.posexplode(F.split("text", LINE_BREAK)).alias("at", "raw")).withColumn("line", trim(F.col("raw"))).filter("line <> ''")
    hit = F.col("line").rlike(LINE)
    notes = F.filter(F.transform(F.array(F.regexp_extract("line", LINE, 2), F.regexp_extract("line", LINE, 3)), trim), lambda n: n != "")
    rows = lines.select(RID, "at", F.when(hit, trim(F.regexp_extract("line", LINE, 1))).otherwise(F.col("line")).alias("name"), F.when(hit, F.array_join(notes, " / ")).otherwise("").alias("note")).filter("name <> ''")
    return rows.select(RID, _id(F.col("at") + 1).alias("speaker_id"), "name", "note", (F.row_number().over(Window.partitionBy(RID).orderBy("at")) - 1).alias("ord"))


def rosters_to_text(speakers: DataFrame) -> DataFrame:
    line = F.when(F.coalesce("note", F.lit("")) != "", F.concat("name", F.lit("("), "note", F.lit(")"))).otherwise(F.col("name"))
    return speakers.groupBy(RID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def _free_ids(old: DataFrame, wanted: DataFrame, from_size: bool = False) -> DataFrame:
    """(recording_id, k, speaker_id): the k-th id that is free, counted from 1 or from one past the roster's size."""
    sizes = wanted.groupBy(RID).agg(F.count("*").alias("w")).join(old.groupBy(RID).agg(F.count("*").alias("o")), RID, "left")
    first = F.coalesce("o", F.lit(0)) + 1 if from_size else F.lit(1).cast("long")
    last = first + F.col("w") + F.coalesce("o", F.lit(0))
    ids = sizes.select(RID, F.explode(F.sequence(first, last)).alias("number")).withColumn("speaker_id", _id(F.col("number")))
    free = ids.join(old.select(RID, "speaker_id"), [RID, "speaker_id"], "left_anti")
    return free.select(RID, "speaker_id", F.row_number().over(Window.partitionBy(RID).orderBy("number")).alias("k"))


def _matched(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """Old and wanted people side by side: by name, equal names one to one in order."""
    nth = F.row_number().over(Window.partitionBy(RID, "name").orderBy("ord"))
    a = old.select(RID, "name", "speaker_id", F.col("note").alias("old_note"), F.col("ord").alias("old_ord"), nth.alias("nth"), F.min("ord").over(Window.partitionBy(RID, "name")).alias("name_ord"))
    b = wanted.select(RID, "name", F.col("note").alias("new_note"), F.col("ord").alias("new_ord"), nth.alias("nth"))
    both = a.join(b, [RID, "name", "nth"], "full_outer")
    fresh = both.filter("speaker_id is null").select(RID, "new_ord", F.row_number().over(Window.partitionBy(RID).orderBy("new_ord")).alias("k"))
    given = fresh.join(_free_ids(old, wanted), [RID, "k"]).select(RID, "new_ord", F.col("speaker_id").alias("given"))
    return both.join(given, [RID, "new_ord"], "left")


def merge_rosters(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored roster brought up to a new one: ids stay with names, newcomers take the lowest free id, people who are
    missing go to the end, and a recording without a new roster keeps its own."""
    rows = _matched(old, wanted)
    some = wanted.select(RID).distinct().withColumn("some", F.lit(True))
    rows = rows.join(some, RID, "left")
    kept = F.struct(F.col("new_ord").isNull().alias("gone"), "new_ord", F.when(F.col("some"), F.col("name_ord")).alias("by_name"), "old_ord")
    order = F.row_number().over(Window.partitionBy(RID).orderBy(kept)) - 1
    note = F.when(F.coalesce("new_note", F.lit("")) != "", F.col("new_note")).otherwise(F.coalesce("old_note", F.lit("")))
    return rows.select(RID, F.coalesce("speaker_id", "given").alias("speaker_id"), "name", note.alias("note"), order.alias("ord"))


def plan_roster_change(speakers: DataFrame, wanted: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roster, plan): the roster as asked for, without the missing; plan has added and removed names and the number of
    segments that lose their speaker. Recordings named in neither table do not appear."""
    rows = _matched(speakers, wanted)
    asked = rows.filter("new_ord is not null")
    order = F.row_number().over(Window.partitionBy(RID).orderBy("new_ord")) - 1
    roster = asked.select(RID, F.coalesce("speaker_id", "given").alias("speaker_id"), "name", F.coalesce("new_note", F.lit("")).alias("note"), order.alias("ord"))
    lost = rows.filter("new_ord is null").select(RID, "speaker_id")
    affected = segments.join(lost, [RID, "speaker_id"], "left_semi").groupBy(RID).agg(F.count("*").alias("affected"))
    sides = rows.groupBy(RID).agg(
        F.array_sort(F.collect_list(F.when(F.col("given").isNotNull(), F.struct("new_ord", "name")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("new_ord").isNull(), F.struct("name_ord", "old_ord", "name", "speaker_id")))).alias("r"),
    )
    plan = sides.join(affected, RID, "left").select(
        RID, F.transform("a", lambda x: x["name"]).alias("added"), F.transform("r", lambda x: x["name"]).alias("removed"), F.transform("r", lambda x: x["speaker_id"]).alias("removed_ids"), F.coalesce("affected", F.lit(0)).alias("affected")
    )
    return roster, plan


def apply_roster_change(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of removed people lose their speaker and count as unheard."""
    return _unassign(segments, plan.select(RID, F.explode("removed_ids").alias("speaker_id")))


def _unassign(segments: DataFrame, lost: DataFrame) -> DataFrame:
    gone = lost.select(RID, "speaker_id", F.lit(True).alias("gone")).distinct()
    rows = segments.join(gone, [RID, "speaker_id"], "left")
    return rows.withColumns({"speaker_id": F.when(F.col("gone").isNull(), F.col("speaker_id")), "reviewed": F.when(F.col("gone").isNull(), F.col("reviewed")).otherwise(False)}).select(*segments.columns)


def remove_speakers(speakers: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roster without some ids in gapless order, and segments without them."""
    left = speakers.join(ids.select(RID, "speaker_id"), [RID, "speaker_id"], "left_anti")
    return left.withColumn("ord", F.row_number().over(Window.partitionBy(RID).orderBy("ord")) - 1).select(*speakers.columns), _unassign(segments, ids)


def add_speakers(speakers: DataFrame, new: DataFrame) -> DataFrame:
    """new (recording_id, name, note, ord) appended in order, with the first free ids past the roster's size."""
    rows = new.select(RID, "name", "note", F.row_number().over(Window.partitionBy(RID).orderBy("ord")).alias("k"))
    sizes = speakers.groupBy(RID).agg(F.count("*").alias("o"))
    added = rows.join(_free_ids(speakers, new, from_size=True), [RID, "k"]).join(sizes, RID, "left")
    return speakers.unionByName(added.select(RID, "speaker_id", "name", "note", (F.coalesce("o", F.lit(0)) + F.col("k") - 1).cast("int").alias("ord")))
