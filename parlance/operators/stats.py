"""Counts and votes over segments. Every result is keyed by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parlance.functions.columns import cluster_title, is_pseudo, is_special, label_of, preview, voter
from parlance.schemas import SPECIALS


def order() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("idx")


def assigned() -> Column:
    return F.col("speaker_id").isNotNull()


def heard() -> Column:
    """Assigned, and confirmed by a person."""
    return assigned() & F.coalesce(F.col("reviewed"), F.lit(False))


def progress(segments: DataFrame) -> DataFrame:
    """Totals of assigned, heard, unheard and open segments, and the assigned share in whole percent."""
    out = segments.groupBy("recording_id").agg(F.count("*").alias("total"), F.count_if(assigned()).alias("assigned"), F.count_if(heard()).alias("reviewed"))
    return out.withColumn("unreviewed", F.col("assigned") - F.col("reviewed")).withColumn("pct", F.rint(F.col("assigned") * 100 / F.col("total")).cast("long"))


def clusters(segments: DataFrame) -> DataFrame:
    """Clusters with their size and first place; ordered by it within a recording."""
    return segments.groupBy("recording_id", "cluster").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"))


def cluster_votes(segments: DataFrame) -> DataFrame:
    """Votes by (cluster, speaker); marks that are no people vote too, clusters of mixed voices do not."""
    return segments.filter(assigned() & ~is_pseudo(F.col("cluster"))).groupBy("recording_id", "cluster", "speaker_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def letter_votes(segments: DataFrame) -> DataFrame:
    """Votes by (label, speaker) over all chunks, people only."""
    rows = segments.filter(assigned() & ~is_pseudo(F.col("cluster")) & ~is_special(F.col("speaker_id")))
    return rows.groupBy("recording_id", label_of(F.col("cluster")).alias("label"), "speaker_id").agg(F.count("*").alias("n"))


def speaker_frequency(segments: DataFrame) -> DataFrame:
    return segments.filter(assigned() & ~is_special(F.col("speaker_id"))).groupBy("recording_id", "speaker_id").agg(F.count("*").alias("n"))


def transitions(segments: DataFrame) -> DataFrame:
    """How often speaker b follows speaker a directly; both must be people."""
    pairs = segments.select("recording_id", voter(F.col("speaker_id")).alias("a"), F.lead(voter(F.col("speaker_id"))).over(order()).alias("b"))
    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("recording_id", "a", "b").agg(F.count("*").alias("n"))


def dominant_speaker(segments: DataFrame) -> DataFrame:
    """The person with most votes in each cluster; of equals, who came first."""
    votes = cluster_votes(segments).filter(~is_special(F.col("speaker_id")))
    best = F.max(F.struct("n", (-F.col("first_idx")).alias("early"), "speaker_id")).alias("best")
    return votes.groupBy("recording_id", "cluster").agg(best).select("recording_id", "cluster", F.col("best.speaker_id").alias("speaker_id"), F.col("best.n").alias("n"))


def resolve_speakers(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """segments with speaker_name: marks first, then the recording's roster, else null."""
    marks = F.create_map(*[F.lit(x) for kv in SPECIALS.items() for x in kv])
    roster = speakers.select("recording_id", "speaker_id", "name")
    return segments.join(roster, ["recording_id", "speaker_id"], "left").withColumn("speaker_name", F.coalesce(marks[F.col("speaker_id")], F.col("name"))).select(*segments.columns, "speaker_name")


def cluster_summary(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """'12区間 / name×7, name×2' for each cluster, most votes first."""
    sizes = clusters(segments)
    votes = resolve_speakers(cluster_votes(segments), speakers)
    item = F.struct((-F.col("n")).alias("k"), "first_idx", F.concat(F.coalesce("speaker_name", "speaker_id"), F.lit("×"), F.col("n").cast("string")).alias("t"))
    names = votes.groupBy("recording_id", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ").alias("votes"))
    label = label_of(F.col("cluster"))
    kind = F.when(label == "?", "判別不能のため一括適用は不可").when(label == "*", "複数人が同時のため一括適用は不可").otherwise(F.coalesce("votes", F.lit("未確定")))
    return sizes.join(names, ["recording_id", "cluster"], "left").select("recording_id", "cluster", F.concat(F.col("n").cast("string"), F.lit("区間 / "), kind).alias("summary"))


def remaining_work(segments: DataFrame) -> DataFrame:
    """Open and unheard segments by label, with the total of each state (label null)."""
    state = F.when(~assigned(), "unassigned").when(~heard(), "unreviewed")
    rows = segments.select("recording_id", state.alias("state"), cluster_title(F.col("cluster")).alias("label"), "idx").filter("state is not null")
    return rows.groupingSets([["recording_id", "state", "label"], ["recording_id", "state"]], "recording_id", "state", "label").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def prev_assigned(segments: DataFrame, n: int = 3) -> DataFrame:
    """Nearest person within n rows before."""
    near = order().rowsBetween(-n, -1)
    return segments.withColumn("prev_speaker", F.last(voter(F.col("speaker_id")), ignorenulls=True).over(near))


def next_assigned(segments: DataFrame, n: int = 3) -> DataFrame:
    near = order().rowsBetween(1, n)
    return segments.withColumn("next_speaker", F.first(voter(F.col("speaker_id")), ignorenulls=True).over(near))


def boundary_partner(segments: DataFrame) -> DataFrame:
    """The person on the other side of a chunk border: the one before, else the one after."""

    def across(step) -> Column:
        return F.when(step("chunk").over(order()) != F.col("chunk"), voter(step("speaker_id").over(order())))

    return segments.withColumn("boundary_speaker", F.coalesce(across(F.lag), across(F.lead)))


def next_matching(segments: DataFrame, pred: Column, forward: bool = True) -> DataFrame:
    """Index of the next (or previous) row of the recording for which a predicate holds."""
    hit = F.when(pred, F.col("idx"))
    found = F.min(hit).over(order().rowsBetween(1, Window.unboundedFollowing)) if forward else F.max(hit).over(order().rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("next_index", found)


def next_unassigned(segments: DataFrame, forward: bool = True) -> DataFrame:
    return next_matching(segments, ~assigned(), forward)


def next_unreviewed(segments: DataFrame, forward: bool = True) -> DataFrame:
    return next_matching(segments, ~heard(), forward)


def filter_view(segments: DataFrame, mode: str = "all") -> DataFrame:
    """All rows, the unassigned ones, or those not yet heard by a person."""
    return {"all": segments, "unassigned": segments.filter("speaker_id is null"), "unreviewed": segments.filter("speaker_id is null or reviewed is null or not reviewed")}[mode]


def row_state(segments: DataFrame, width: int = 60) -> DataFrame:
    """What a list shows of a row: marks for speaker and time, tags, cluster title and preview."""
    edited, confirmed = F.coalesce("time_edited", F.lit(False)), F.coalesce("time_reviewed", F.lit(False))
    mark = F.when(heard(), "✓").when(assigned(), "△").otherwise("—")
    time_mark = F.when(edited & confirmed, "✎").when(edited, "✎△").otherwise("")
    tags = F.array_compact(F.array(F.when(~assigned(), "unassigned"), F.when(assigned() & ~heard(), "bulk"), F.when(is_special(F.col("speaker_id")), "special"), F.when(is_pseudo(F.col("cluster")), "pseudo")))
    return segments.select("recording_id", "idx", mark.alias("mark"), time_mark.alias("time_mark"), F.array_join(tags, " ").alias("tags"), cluster_title(F.col("cluster")).alias("cluster_label"), preview(F.col("text"), width).alias("preview"))

