"""Column functions: clusters, spoken length, times, and short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.schemas import MIN_EDIT_SECONDS, PSEUDO_LABELS, SPECIALS

# How a label may name a speaker, several, or none; marks at which fragments join without a comma.
LABEL_PREFIX = r"(?i)^(?:発言者|話者|speaker)\s*[:\-]?\s*"
SEVERAL = "複数|重複|同時"
NOBODY = "不明|不詳|unknown"
JOIN_MARKS = "。、．，!?！？」』）)…・ー~〜-"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = f"[{BLANKS}]"
LINE_BREAK = "\\R|[\x1c-\x1e]"


def trim(c: Column) -> Column:
    """Strip Unicode white space."""
    return F.btrim(c, F.lit(BLANKS))


def label_of(cluster: Column) -> Column:
    """'3:A' gives 'A'; a cluster without a chunk is its own label."""
    tail = F.substring_index(cluster, ":", -1)
    return F.when(cluster.contains(":") & (tail != ""), F.regexp_replace(cluster, "^[^:]*:", "")).otherwise(cluster)


def is_pseudo(cluster: Column) -> Column:
    return label_of(cluster).isin(*PSEUDO_LABELS)


def is_special(speaker: Column) -> Column:
    return speaker.isin(*SPECIALS)


def voter(speaker: Column) -> Column:
    """The speaker if it is a person, else null."""
    return F.when(~is_special(speaker), speaker)


def normalize_label(label: Column) -> Column:
    """A spoken label as one cluster letter, '*' for several voices, '?' for none that is known."""
    s = F.regexp_replace(trim(label), LABEL_PREFIX, "")
    first = F.substring(s, 1, 1)
    return (
        F.when(label.isNull() | (s == ""), "?")
        .when(s.rlike(SEVERAL) | s.isin("*", "＊"), "*")
        .when(s.rlike(NOBODY) | s.isin("?", "？"), "?")
        .when(first.rlike("[A-Za-z]"), F.upper(first))
        .otherwise(F.substring(s, 1, 3))
    )


def estimate_speech(text: Column) -> Column:
    """Seconds that a text takes to say: 4.5 characters a second, from 1 to 120."""
    return F.least(F.lit(120.0), F.greatest(F.lit(1.0), F.char_length(trim(text)) / F.lit(4.5)))


def join_fragments(texts: Column) -> Column:
    """One text from an array of fragments: no blank between them, a comma where neither side has a mark."""

    def add(left: Column, right: Column) -> Column:
        a, b = F.regexp_replace(left, f"{WHITE}+$", ""), F.regexp_replace(right, f"^{WHITE}+", "")
        marked = F.instr(F.lit(JOIN_MARKS), F.right(a, F.lit(1))) + F.instr(F.lit(JOIN_MARKS), F.left(b, F.lit(1)))
        return F.when(a == "", b).when(b == "", a).when(marked > 0, F.concat(a, b)).otherwise(F.concat(a, F.lit("、"), b))

    return F.when(F.size(texts) == 1, texts[0]).otherwise(F.aggregate(texts, F.lit(""), add))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_hms(seconds: Column) -> Column:
    """HH:MM:SS of the nearest second, halves to even."""
    t = F.rint(seconds).cast("long")
    hours = (t - t % 3600) / 3600
    h = hours.cast("long")
    return F.concat_ws(":", F.when(h < 100, _two(h)).otherwise(h.cast("string")), _two(((t % 3600 - t % 60) / 60).cast("long")), _two(t % 60))


def format_ms(seconds: Column) -> Column:
    """MM:SS below an hour, else HH:MM:SS."""
    t = F.rint(seconds).cast("long")
    return F.when(t >= 3600, format_hms(seconds)).otherwise(F.concat_ws(":", _two(((t - t % 60) / 60).cast("long")), _two(t % 60)))


def format_tenths(seconds: Column) -> Column:
    """HH:MM:SS.s; negative times are zero."""
    tenths = F.greatest(F.lit(0).cast("long"), F.rint(seconds * 10).cast("long"))
    whole = ((tenths - tenths % 10) / 10).cast("long")
    return F.concat(format_hms(whole.cast("double")), F.lit("."), (tenths % 10).cast("string"))


def parse_time(text: Column) -> Column:
    """Seconds of 'HH:MM:SS.s', 'MM:SS.s' or 'SS.s' to a tenth; full-width digits are read, anything else is null."""
    s = F.translate(F.regexp_replace(trim(text), "[ 　]", ""), "０１２３４５６７８９：．", "0123456789:.")
    parts = F.split(s, ":")
    n = F.size(parts)
    values = F.transform(parts, lambda p: p.try_cast("double"))
    lower_ok = F.forall(F.slice(values, 2, 2), lambda v: v < 60.0)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc * 60.0 + v)
    return F.when(s.rlike(r"^(?:[0-9]+:){0,2}[0-9]+(?:\.[0-9]*)?$") & (n <= 3) & lower_ok, F.bround(total, 1))


def parse_times(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): rows whose column is a time, with its seconds in its place, and the others as they came."""
    both = df.withColumn("_seconds", parse_time(F.col(col)))
    ok = both.filter("_seconds is not null").withColumn(col, F.col("_seconds")).drop("_seconds")
    return ok, both.filter("_seconds is null").drop("_seconds")


def format_times(df: DataFrame, col: str, style: str = "hms") -> DataFrame:
    """df with the seconds of a column as text: hms, ms or tenths."""
    styles = {"hms": format_hms, "ms": format_ms, "tenths": format_tenths}
    if style not in styles:
        raise ValueError(f"style is one of {', '.join(styles)}")
    return df.withColumn(col, styles[style](F.col(col)))


def round1(c: Column) -> Column:
    return F.bround(c, 1)


def preview(text: Column, width: int = 60) -> Column:
    """White space collapsed, cut to a width with an ellipsis."""
    t = trim(F.regexp_replace(text, f"{WHITE}+", " "))
    return F.when(F.char_length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, width - 1), F.lit("…")))


def cluster_title(cluster: Column) -> Column:
    """'0:A' gives 'C1-A'."""
    chunk = F.substring_index(cluster, ":", 1)
    return F.when(cluster.rlike(r"^\s*[+-]?\d+\s*:"), F.concat(F.lit("C"), (F.trim(chunk).cast("int") + 1).cast("string"), F.lit("-"), F.regexp_replace(cluster, "^[^:]*:", ""))).otherwise(cluster)


def audio_start(offset: Column, edited: Column, start: Column) -> Column:
    """Where a time lies in the audio: edited times are real, others move by the recording's offset and not below zero."""
    return F.when(edited, start).otherwise(F.greatest(F.lit(0.0), start + offset))


def clamp_span(start: Column, end: Column, duration: Column, moved: str) -> tuple[Column, Column]:
    """Start and end on tenths within the recording and at least a tenth apart; the end that did not move stands."""
    top = F.when(duration > 0, round1(duration))
    s, e = (F.greatest(F.lit(0.0), round1(c)) for c in (start, end))
    s, e = (F.when(top.isNotNull(), F.least(c, top)).otherwise(c) for c in (s, e))
    short = e - s < MIN_EDIT_SECONDS
    if moved == "start":
        back = round1(e - MIN_EDIT_SECONDS)
        return F.when(short, F.greatest(F.lit(0.0), back)).otherwise(s), F.when(short & (back < 0), F.lit(MIN_EDIT_SECONDS)).otherwise(e)
    ahead = round1(s + MIN_EDIT_SECONDS)
    over = top.isNotNull() & (ahead > top)
    new_end = F.when(over, top).otherwise(ahead)
    return F.when(short & over, F.greatest(F.lit(0.0), round1(top - MIN_EDIT_SECONDS))).otherwise(s), F.when(short, new_end).otherwise(e)
