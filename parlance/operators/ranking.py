"""Ranking of likely speakers for each segment.

All evidence is relational: votes of the cluster, of its letter in other chunks, transitions from and to the
neighbours, the person across a chunk border, overall frequency and roster order. Votes are folded into maps from candidate to count, one for each
voice, neighbour and recording, and joined to segments, not to their candidates; only then is each segment opened to the roster, and its candidates are
scored by looking them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import cluster_title, is_pseudo, is_special, label_of, voter
from parlance.operators import stats
from parlance.schemas import SPECIALS

# Weights of the evidence, counts for full confidence.
CLUSTER, BOUNDARY, LETTER, FORWARD, BACKWARD, FREQUENCY, ROSTER = 100.0, 45.0, 20.0, 25.0, 15.0, 10.0, 1.0
REPEAT_PENALTY, THIN = 8.0, 6
FULL_LETTER, FULL_TRANSITION, FULL_FREQUENCY = 4, 8, 10
RID = "recording_id"
# How reasons are worded.
TIMES, ACROSS, AFTER, BEFORE = "回", "境界の続き", "の次: ", "の前: "


def _folded(df: DataFrame, by: list[str], *names: str) -> DataFrame:
    """One row for each key, with a map from candidate to count for every named column (none for nulls) and the total of each."""
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct("candidate", c))))
    return df.groupBy(*by).agg(*(x for c in names for x in (entry(c).alias(c), F.sum(c).alias(f"{c}_total"))))


def _share(weight: float, count: Column, total: Column, full: int | None = None) -> Column:
    """weight x confidence x count / total, zero without votes."""
    confidence = F.least(F.lit(1.0), total / F.lit(float(full))) if full else F.lit(1.0)
    return F.coalesce(F.when((total > 0) & (count > 0), weight * confidence * count / total), F.lit(0.0))


def rank_candidates(segments: DataFrame, speakers: DataFrame, include_special: bool = False) -> DataFrame:
    """(recording_id, idx, speaker_id, score, reasons, rank): every speaker of the roster for every segment, best first."""
    base = stats.boundary_partner(stats.next_assigned(stats.prev_assigned(segments)))
    own = (F.col("speaker_id").isNotNull() & ~is_special(F.col("speaker_id")) & ~is_pseudo(F.col("cluster"))).cast("int")
    base = base.select(RID, "idx", "cluster", F.when(~is_pseudo(F.col("cluster")), F.col("cluster")).alias("voice"), label_of(F.col("cluster")).alias("label"), F.col("speaker_id").alias("current"), F.coalesce(own, F.lit(0)).alias("own"), "prev_speaker", "next_speaker", "boundary_speaker")
    votes = stats.cluster_votes(segments).filter(~is_special(F.col("speaker_id"))).select(RID, F.col("cluster").alias("voice"), F.col("speaker_id").alias("candidate"), F.col("n").alias("cv"))
    letters = stats.letter_votes(segments).select(RID, "label", F.col("speaker_id").alias("candidate"), F.col("n").alias("all_lv"))
    voices = stats.clusters(segments).filter(~is_pseudo(F.col("cluster"))).select(RID, F.col("cluster").alias("voice"), label_of(F.col("cluster")).alias("label"))
    elsewhere = voices.join(letters, [RID, "label"]).join(votes, [RID, "voice", "candidate"], "left").select(RID, "voice", "candidate", (F.col("all_lv") - F.coalesce("cv", F.lit(0))).alias("lv")).filter("lv > 0")
    by_voice = votes.withColumn("lv", F.lit(None).cast("long")).unionByName(elsewhere.withColumn("cv", F.lit(None).cast("long")))
    moves = stats.transitions(segments)
    onward = moves.select(RID, F.col("a").alias("prev_speaker"), F.col("b").alias("candidate"), F.col("n").alias("fw"))
    back = moves.select(RID, F.col("b").alias("next_speaker"), F.col("a").alias("candidate"), F.col("n").alias("bw"))
    often = stats.speaker_frequency(segments).select(RID, F.col("speaker_id").alias("candidate"), F.col("n").alias("fr"))

    seats = F.array_sort(F.collect_list(F.struct("ord", F.col("speaker_id").alias("candidate"))))
    roster = speakers.groupBy(RID).agg(F.count("*").alias("n"), F.transform(seats, lambda x, k: F.struct(x["candidate"].alias("candidate"), x["ord"].alias("ord"), k.alias("place"))).alias("seats"))
    whole = roster.join(_folded(often, [RID], "fr"), RID, "left")
    rows = base.join(_folded(by_voice, [RID, "voice"], "cv", "lv"), [RID, "voice"], "left").join(_folded(onward, [RID, "prev_speaker"], "fw"), [RID, "prev_speaker"], "left").join(_folded(back, [RID, "next_speaker"], "bw"), [RID, "next_speaker"], "left")
    rows = rows.join(whole, RID).withColumn("seat", F.explode("seats")).drop("seats").select("*", "seat.candidate", "seat.ord", "seat.place").drop("seat")
    rows = rows.withColumns({c: F.try_element_at(c, "candidate") for c in ("cv", "lv", "fw", "bw", "fr")})

    me = F.col("candidate").eqNullSafe(F.col("current")).cast("int") * F.col("own")
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("cv", "lv", "fw", "bw", "fr")}
    total = {c: F.coalesce(F.col(f"{c}_total"), F.lit(0)) for c in count}
    own_votes, cluster_total = count["cv"] - me, total["cv"] - F.when(F.col("voice").isNotNull(), F.col("own")).otherwise(0)
    border = F.col("boundary_speaker").eqNullSafe(F.col("candidate"))
    again = F.coalesce(F.col("prev_speaker") == F.col("candidate"), F.lit(False)) & (total["fw"] < THIN) & ~F.col("prev_speaker").eqNullSafe(F.col("boundary_speaker"))
    score = (
        _share(CLUSTER, own_votes, cluster_total)
        + F.when(border, BOUNDARY).otherwise(0.0)
        + _share(LETTER, count["lv"], total["lv"], FULL_LETTER)
        + _share(FORWARD, count["fw"], total["fw"], FULL_TRANSITION)
        - F.when(again, REPEAT_PENALTY).otherwise(0.0)
        + _share(BACKWARD, count["bw"], total["bw"], FULL_TRANSITION)
        + _share(FREQUENCY, count["fr"], total["fr"], FULL_FREQUENCY)
        + ROSTER * (F.col("n") - F.col("place")) / F.col("n")
    )

    def times(c: Column) -> Column:
        return F.concat(c.cast("string"), F.lit(TIMES))

    reasons = F.array_compact(
        F.array(
            F.when(own_votes > 0, F.concat(cluster_title(F.col("cluster")), F.lit(": "), times(own_votes))),
            F.when(border, F.lit(ACROSS)),
            F.when(count["lv"] > 0, F.concat(F.lit("【"), F.col("label"), F.lit("】: "), times(count["lv"]))),
            F.when(count["fw"] > 0, F.concat(F.col("prev_speaker"), F.lit(AFTER), times(count["fw"]))),
            F.when(count["bw"] > 0, F.concat(F.col("next_speaker"), F.lit(BEFORE), times(count["bw"]))),
        )
    )
    scored = rows.select(RID, "idx", F.col("candidate").alias("speaker_id"), score.alias("score"), reasons.alias("reasons"), "ord")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(RID, "idx").orderBy(F.desc(F.round("score", 9)), "ord"))).drop("ord")
    if not include_special:
        return ranked
    marks = F.explode(F.array(*[F.struct(F.lit(s).alias("speaker_id"), F.lit(k).alias("k")) for k, s in enumerate(SPECIALS, 1)])).alias("m")
    sizes = speakers.groupBy(RID).agg(F.count("*").alias("n"))
    extra = segments.join(sizes, RID).select(RID, "idx", "n", marks)
    return ranked.unionByName(extra.select(RID, "idx", "m.speaker_id", F.lit(-1.0).alias("score"), F.array().cast("array<string>").alias("reasons"), (F.col("n") + F.col("m.k")).cast("int").alias("rank")))


def top_candidates(ranked: DataFrame, k: int = 9) -> DataFrame:
    """The first k candidates of each segment."""
    return ranked.filter(F.col("rank") <= k)
