"""Columns of the library's tables and the values that transcripts are written with."""

from __future__ import annotations

from pyspark.sql import types as T

# Identifiers and labels of speakers that are not people, and of clusters that are not one voice.
SPECIALS = {"__unknown__": "発言者不明", "__multi__": "発言者複数・重複", "__noise__": "発言なし・雑音"}
NOISE = "__noise__"
UNKNOWN_LABEL = "発言者不明"
PSEUDO_LABELS = ("?", "*")
SCHEMA_VERSION = 5
MIN_EDIT_SECONDS = 0.1

SEGMENT = T.StructType(
    [
        T.StructField("recording_id", T.LongType()),
        T.StructField("idx", T.LongType()),
        T.StructField("seg_start", T.DoubleType()),
        T.StructField("seg_end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("reviewed", T.BooleanType()),
        T.StructField("note", T.StringType()),
        T.StructField("text_edited", T.BooleanType()),
        T.StructField("time_edited", T.BooleanType()),
        T.StructField("time_reviewed", T.BooleanType()),
        T.StructField("orig_start", T.DoubleType()),
        T.StructField("orig_end", T.DoubleType()),
    ]
)
SEGMENT_COLUMNS = SEGMENT.fieldNames()
SPEAKER = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("speaker_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType()), T.StructField("ord", T.IntegerType())])
