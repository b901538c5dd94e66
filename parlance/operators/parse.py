"""Transcript text to segments.

The unit of work is a chunk: every window is partitioned by (recording, chunk), so a long recording is cut into as many
groups as it has chunks. Header rows are found by one pattern, continuation lines are gathered by running sums, times by
running maxima; only the capped merge of one speaker's rows folds over the rows of an island."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.columns import LINE_BREAK, estimate_speech, join_fragments, normalize_label, trim
from parlance.schemas import PSEUDO_LABELS

KEY = ["recording_id", "chunk"]
# The head of a line, [h:mm:ss.f] in any bracket, then a label in 【】 or [], then the text.
HEADER = r"(?U)^\s*[\[［(（]\s*(?:(\d{1,2})\s*[:：]\s*)?(\d{1,3})\s*[:：]\s*(\d{1,2})(?:[.,]\d+)?\s*[\]］)）]\s*(?:[【\[]\s*([^】\]]{1,24}?)\s*[】\]])?\s*(.*)$"
# Times inside a text, and the head of a line of minutes.
RELATIVE = r"\[(\d{1,2}):(\d{2})\]"
LEAD = r"^(\[\d{1,2}:\d{2}(?::\d{2})?\])\s*(【[^】]+】)?\s*(.*)"
MERGE_SECONDS, MERGE_GAP = 180.0, 20.0


def _order(*cols: str):
    return Window.partitionBy(*KEY).orderBy(*(cols or ("line_no",)))


def _to(c: Column, digits: int) -> Column:
    """Rounded with halves to even, on the double's own value as far as a product shows it."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def explode_lines(chunks: DataFrame) -> DataFrame:
    """(…, line_no, line): lines of a chunk's text that are not blank, stripped. Columns other than text are kept."""
    rest = [c for c in chunks.columns if c != "text"]
    return chunks.select(*rest, F.posexplode(F.split("text", LINE_BREAK)).alias("line_no", "line")).withColumn("line", trim(F.col("line"))).filter("line <> ''")


def _number(c: Column) -> Column:
    return F.coalesce(F.translate(c, "０１２３４５６７８９", "0123456789").try_cast("int"), F.lit(0))


def match_headers(lines: DataFrame) -> DataFrame:
    """is_header, rel (seconds), label (null if none) and body of each line."""
    part = lambda k: F.regexp_extract("line", HEADER, k)
    header = F.col("line").rlike(HEADER)
    label = F.when(header & (part(4) != ""), part(4))
    rel = _number(part(1)) * 3600 + _number(part(2)) * 60 + _number(part(3))
    return lines.withColumns({"is_header": header, "rel": F.when(header, rel.cast("double")), "label": label, "body": F.when(header, trim(part(5)))})


def normalize_cluster_labels(df: DataFrame, col: str = "label", out: str = "cluster") -> DataFrame:
    return df.withColumn(out, normalize_label(F.col(col)))


def monotone_times(lines: DataFrame) -> DataFrame:
    """Header times cut at the chunk's length; a time that goes back takes the latest before it."""
    cut = F.when(F.col("is_header"), F.when(F.col("length") > 0, F.least("rel", "length")).otherwise(F.col("rel")))
    return lines.withColumn("rel", F.when(F.col("is_header"), F.max(cut).over(_order().rowsBetween(Window.unboundedPreceding, 0))))


def attach_continuations(lines: DataFrame) -> DataFrame:
    """(recording_id, chunk, line_no, rel, cluster, text): lines without a header go to the row before; a leading one opens an unknown row at zero."""
    kept = lines.filter(~F.col("is_header") | (F.col("body") != "") | F.col("label").isNotNull())
    group = kept.withColumn("row", F.sum(F.when(F.col("is_header"), 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(F.col("is_header"), F.col("body")).otherwise(F.col("line"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), lambda t: t != "")
    cluster = F.when(F.max("is_header"), normalize_label(F.min_by("label", "line_no"))).otherwise("?")
    rest = [F.first(c).alias(c) for c in ("offset", "length") if c in lines.columns]
    return group.groupBy(*KEY, "row").agg(F.min("line_no").alias("line_no"), F.coalesce(F.min_by("rel", "line_no"), F.lit(0.0)).alias("rel"), cluster.alias("cluster"), F.array_join(parts, " ").alias("text"), *rest).drop("row")


def provisional_ends(raw: DataFrame) -> DataFrame:
    """rel_end: the next start; two seconds for the last row at most; at least a second. Rows without text go first."""
    w = _order()
    full = raw.filter("text <> ''")
    chunk_len = F.when(F.col("length") > 0, F.col("length")).otherwise(F.max("rel").over(Window.partitionBy(*KEY)))
    full = full.withColumn("chunk_len", chunk_len)
    end = F.coalesce(F.lead("rel").over(w), F.least(F.col("chunk_len"), F.col("rel") + 2.0))
    return full.withColumn("rel_end", F.when(end <= F.col("rel"), F.col("rel") + 1.0).otherwise(end))


def merge_same_cluster(raw: DataFrame, max_seconds: float = MERGE_SECONDS, max_gap: float = MERGE_GAP) -> DataFrame:
    """Consecutive rows of one voice as one, unless mixed, more than max_gap apart, or longer than max_seconds together."""
    w = _order()
    joins = (F.col("cluster") == F.lag("cluster").over(w)) & ~F.col("cluster").isin(*PSEUDO_LABELS) & (F.col("rel") - F.lag("rel_end").over(w) <= max_gap)
    island = raw.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    row = F.struct("line_no", "rel", "rel_end", "text")
    some = [F.first(c).alias(c) for c in raw.columns if c not in (*KEY, "line_no", "rel", "rel_end", "text", "cluster")]
    rows = island.groupBy(*KEY, "island").agg(F.first("cluster").alias("cluster"), *some, F.array_sort(F.collect_list(row)).alias("rows"))
    # a run starts anew whenever the row would stretch it beyond the cap: each row learns the start of its run
    begin = F.struct(F.lit(None).cast("double").alias("run"), F.array().cast("array<double>").alias("runs"))

    def step(acc: Column, r: Column) -> Column:
        run = F.when(acc["run"].isNotNull() & (r["rel_end"] - acc["run"] <= max_seconds), acc["run"]).otherwise(r["rel"])
        first = F.when(acc["run"].isNotNull() & (r["rel_end"] - acc["run"] <= max_seconds), F.element_at(acc["runs"], -1)).otherwise(r["line_no"].cast("double"))
        return F.struct(run.alias("run"), F.concat(acc["runs"], F.array(first)).alias("runs"))

    starts = F.aggregate("rows", begin, step, lambda acc: acc["runs"])
    single = F.size("rows") == 1
    starts = F.when(single, F.array(F.col("rows")[0]["line_no"].cast("double"))).otherwise(starts)
    flat = rows.withColumn("z", F.explode(F.arrays_zip("rows", starts.alias("runs"))))
    keep = [c for c in raw.columns if c not in (*KEY, "line_no", "rel", "rel_end", "text", "cluster")]
    flat = flat.select(*KEY, "cluster", *keep, F.col("z.runs").alias("run"), "z.rows.line_no", "z.rows.rel", "z.rows.rel_end", "z.rows.text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    out = flat.groupBy(*KEY, "run").agg(F.first("cluster").alias("cluster"), *[F.first(c).alias(c) for c in keep], F.min("line_no").alias("line_no"), F.min_by("rel", "line_no").alias("rel"), F.max_by("rel_end", "line_no").alias("rel_end"), texts.alias("texts"))
    return out.withColumn("text", join_fragments(F.col("texts"))).drop("texts", "run").select(*raw.columns)


def redistribute_times(raw: DataFrame) -> DataFrame:
    """Rows too short for their text share the time up to the next roomy row in proportion to their texts."""
    w = _order()
    need = estimate_speech(F.col("text"))
    rows = raw.withColumn("need", need).withColumn("after", F.coalesce(F.lead("rel").over(w), F.col("chunk_len")))
    rows = rows.withColumn("tight", F.col("after") - F.col("rel") < F.col("need") - 0.01)
    rows = rows.withColumn("grp", F.coalesce(F.sum(F.when(F.col("tight"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = Window.partitionBy(*KEY, "grp")
    ordered = g.orderBy("line_no")
    rows = rows.withColumns(
        {
            "any_tight": F.max("tight").over(g), "g_start": F.min("rel").over(g), "g_end": F.max_by("after", "line_no").over(g), "g_need": F.sum("need").over(g),
            "before": F.coalesce(F.sum("need").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "last": F.lead("line_no").over(ordered).isNull(),
        }
    )
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.col("g_end") - F.col("g_start")) / F.col("g_need"))
    start = F.col("g_start") + F.col("before") * scale
    end = _to(start + F.col("need") * scale, 3)
    end = F.when(F.col("last") & (end < F.col("g_end")), _to(F.col("g_end"), 3)).otherwise(end)
    out = rows.withColumns({"rel": F.when(F.col("any_tight"), _to(start, 3)).otherwise(F.col("rel")), "rel_end": F.when(F.col("any_tight"), end).otherwise(F.col("after"))})
    return out.select(*raw.columns)


def finalize_segments(raw: DataFrame) -> DataFrame:
    """Absolute times to hundredths; the last row reaches the chunk's end."""
    w = _order()
    last = F.lead("line_no").over(w).isNull()
    end = F.when(last, F.greatest("rel_end", "chunk_len")).otherwise(F.col("rel_end"))
    offset = F.coalesce(F.col("offset"), F.lit(0.0))
    start, stop = offset + F.col("rel"), offset + end
    stop = F.when(stop <= start, start + 1.0).otherwise(stop)
    return raw.select(*KEY, (F.row_number().over(w) - 1).cast("long").alias("idx"), _to(start, 2).alias("seg_start"), _to(stop, 2).alias("seg_end"), "text", F.concat(F.col("chunk").cast("string"), F.lit(":"), F.col("cluster")).alias("cluster"))


def raw_segments(chunks: DataFrame) -> DataFrame:
    """Lines to rows with provisional ends: headers, labels, continuations, times."""
    lines = chunks if "offset" in chunks.columns else chunks.withColumn("offset", F.lit(0.0))
    return provisional_ends(attach_continuations(monotone_times(match_headers(explode_lines(lines)))))


def parse_transcripts(chunks: DataFrame, merge_same_speaker: bool = True) -> DataFrame:
    """chunks (recording_id, chunk, text, length[, offset]) to segments numbered within their chunk."""
    raw = raw_segments(chunks)
    return finalize_segments(redistribute_times(merge_same_cluster(raw) if merge_same_speaker else raw))


def accumulate_offsets(chunks: DataFrame, nominal_seconds: float = 600.0, duration: str | None = None) -> DataFrame:
    """offset: the lengths of all chunks before; a missing length is nominal. With a duration, length is what is left of it."""
    w = Window.partitionBy("recording_id").orderBy("chunk")
    length = F.coalesce(F.when(F.col("length") > 0, F.col("length")), F.lit(nominal_seconds))
    out = chunks.withColumn("offset", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rest = F.least(length, F.col(duration) - F.col("offset")) if duration else length
    return out.withColumn("length", F.greatest(F.lit(1.0), rest))


def renumber(segments: DataFrame) -> DataFrame:
    """idx 0, 1, 2, … within the recording."""
    return segments.withColumn("idx", (F.row_number().over(Window.partitionBy("recording_id").orderBy("chunk", "idx")) - 1).cast("long"))


def shift_timestamps(chunks: DataFrame, offset_col: str = "offset") -> DataFrame:
    """Every [M:SS] in the text as [HH:MM:SS], later by the offset."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    pieces = F.split("text", RELATIVE, -1)
    found = F.zip_with(F.regexp_extract_all("text", F.lit(RELATIVE), F.lit(1)), F.regexp_extract_all("text", F.lit(RELATIVE), F.lit(2)), lambda m, s: m.cast("long") * 60 + s.cast("long"))

    def stamp(t: Column) -> Column:
        v = t + F.col(offset_col).cast("long")
        return F.concat(F.lit("["), two(F.floor(v / 3600)), F.lit(":"), two(F.floor(v % 3600 / 60)), F.lit(":"), two(v % 60), F.lit("]"))

    stamps = F.transform(found, stamp)
    return chunks.withColumn("text", F.array_join(F.zip_with(pieces, stamps, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def extract_leads(lines: DataFrame) -> DataFrame:
    """ts, speaker and body of lines of assembled text; speaker and ts are empty where the line has none."""
    hit = F.col("line").rlike(LEAD)
    part = lambda k: F.regexp_extract("line", LEAD, k)
    return lines.withColumns({"ts": part(1), "speaker": part(2), "body": F.when(hit, part(3)).otherwise(F.col("line"))})
