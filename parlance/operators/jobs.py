"""Jobs that chain the operators: processing recordings again, and checking their times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.alignment import measure_segments
from parlance.operators.proposals import inspect_summary, propose_times
from parlance.operators.quality import same_recording
from parlance.operators.rosters import merge_rosters
from parlance.operators.snapshots import audio_spans, carry_over, decided_history, drop_conflicts, merge_history
from parlance.sources.caches import write_proposals
from parlance.sources.shared import kept

RID = "recording_id"


def rerun(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored tables brought together with those of a new run, recording by recording.

    old: recordings, speakers, segments, edits; new: recordings, speakers (the roster asked for), segments. Returns these four
    and audit. Where the audio is the same, people's decisions are carried over and revision and edits go on; where it is another one under
    the same name, only the roster is brought up to date: segments are the new run's, revision and edits begin anew. Recordings that
    only one side has keep what that side has; a recording of the old side alone was not processed again and stays as it is."""
    again = new["recordings"].select(RID).distinct()
    known = old["recordings"].select(RID).distinct()
    same = kept(same_recording(old["recordings"], new["recordings"]).filter("same").select(RID), "rerun-same")
    untouched = lambda name: old[name].join(again, RID, "left_anti")
    segments, audit = carry_over(old["segments"].join(same, RID, "left_semi"), new["segments"].join(same, RID, "left_semi"), places=True)
    fresh = new["segments"].join(same, RID, "left_anti")
    people = merge_rosters(old["speakers"].join(again, RID, "left_semi"), new["speakers"].join(known, RID, "left_semi"))
    first = new["speakers"].join(known, RID, "left_anti")
    columns = old["speakers"].columns
    revision = old["recordings"].join(same, RID, "left_semi").select(RID, F.col("doc_revision").alias("_revision"))
    recordings = new["recordings"].join(revision, RID, "left").withColumn("doc_revision", F.coalesce("_revision", F.lit(0)).cast("int")).drop("_revision")
    return {
        "recordings": recordings.unionByName(untouched("recordings"), allowMissingColumns=True),
        "speakers": people.select(*columns).unionByName(first.select(*columns)).unionByName(untouched("speakers")),
        "segments": segments.unionByName(fresh.select(*segments.columns)).unionByName(untouched("segments").select(*segments.columns)),
        "edits": old["edits"].join(same, RID, "left_semi").unionByName(untouched("edits")),
        "audit": audit,
    }


def inspect_times(segments: DataFrame, recordings: DataFrame, words: DataFrame, history: DataFrame | None = None, path: str | None = None, **options: float) -> tuple[DataFrame, DataFrame]:
    """(proposals, summary): measured times to proposals on which nobody has decided yet, without those that compete for one place.

    segments have text. history (recording_id, id, status and what proposals have) are earlier ones; with ``path`` the undecided and
    everything decided are stored there by the recordings' audio_fingerprint. summary tallies the reasons, competitors as conflicted."""
    spans = segments.join(recordings.select(RID, "time_offset"), RID, "left")
    spans = audio_spans(segments, recordings).select(RID, "idx", "text", "now_start", "now_end")
    reasons = kept(propose_times(segments.drop("text"), measure_segments(spans, words, **options), recordings), "reasons")
    good, clashing = drop_conflicts(reasons.filter("reason = 'proposal'").drop("p_start", "p_end").withColumnsRenamed({"s": "p_start", "e": "p_end"}))
    good = reasons.join(good.select(RID, "idx"), [RID, "idx"], "left_semi").withColumn("status", F.lit("pending"))
    fresh = good if history is None else merge_history(good, history)
    if path:
        prints = recordings.select(RID, F.col("audio_fingerprint").alias("fingerprint"))
        stored = fresh if history is None else fresh.unionByName(decided_history(history), allowMissingColumns=True)
        write_proposals(stored.join(prints, RID, "left"), path)
    conflicted = clashing.groupBy(RID).agg(F.count("*").alias("conflicted"))
    summary = inspect_summary(reasons).join(conflicted, RID, "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(0)))
    return fresh, summary.withColumns({"proposals": F.col("proposals") - F.col("conflicted"), "weak": F.col("weak") + F.col("conflicted")})
