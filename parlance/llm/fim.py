"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of ``(unit)*`` over a text keeps every repetition of the group; the ends of these captures give the number of
units n and, looked up at two drawn places, both cuts. A unit is a code point unless another pattern is given.

The draws depend on the id alone: h1 to h4 are the first 8-digit groups of the hex sha256 of ``1:`` and the id. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger, the suffix is the rest. A text that is empty or holds a sentinel stays
plain, as do those with h3 % 100 >= ``rate``; of the others h4 % 100 < ``spm`` are written suffix first.

Bounds: a match takes some 60 bytes for each code point, so texts of more than PIECE code points are matched piece by piece, which changes
nothing where a unit is one code point; with other units a text is matched as one.

Defined cases: null counts as empty text, which is plain with n = 0; a null id is drawn for as an empty one; rows that repeat are transformed alike; a text
that units do not cover is plain with n = 0; texts of any length are read whole; an empty table gives an empty result; further columns are ignored, names that clash included.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import slices, table

CODE_POINT = "(?s:.)"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PIECE = 1 << 20


class Units:
    """Cuts between the units of a text."""

    def __init__(self, unit: str = CODE_POINT, piece: int = PIECE):
        self.match = regex.compile(f"({unit})*").fullmatch
        self.piece = piece if unit == CODE_POINT else None

    def ends(self, text: str, at: int, to: int) -> list[int]:
        found = self.match(text, at, to)
        return found.ends(1) if found else []

    def cuts(self, text: str, h1: int, h2: int) -> tuple[int, int, int]:
        """(n, end of the prefix, end of the middle); ends as places in the text."""
        size = self.piece or len(text) or 1
        if len(text) <= size:
            ends = self.ends(text, 0, len(text))
            n = len(ends)
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0
        n = sum(len(self.ends(text, at, min(len(text), at + size))) for at in range(0, len(text), size))
        out = []
        for k in sorted((h1 % (n + 1), h2 % (n + 1))):
            at = max(0, k - 1) // size * size  # the piece that holds the k-th unit
            out.append(self.ends(text, at, min(len(text), at + size))[k - 1 - at] if k else 0)
        return n, *out


def arrange(text: str, low: int, high: int, form: str) -> str:
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, rate: int = 90, spm: int = 20, piece: int = PIECE) -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        units = Units(unit, piece)
        for batch in slices(batches, 5):
            rows = []
            h = [batch.column(k).to_pylist() for k in range(1, 5)]
            for text, h1, h2, h3, h4 in zip(batch.column(5).to_pylist(), *h):
                text = text or ""
                n, low, high = units.cuts(text, h1, h2)
                if not n or h3 % 100 >= rate or any(s in text for s in SENTINELS):
                    rows.append((n, "plain", None, None, text))
                else:
                    form = "spm" if h4 % 100 < spm else "psm"
                    rows.append((n, form, low, high - low, arrange(text, low, high, form)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=names)

    rows = docs.select(F.col(id_col).alias("id"), *draws, F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. Neither a text nor a sentinel can make a further sentinel where they meet, so the three split it."""
    part = lambda k: F.element_at(F.split(output, "<[PSM]>", -1), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM drawn
), formed AS (
  SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN t = '' OR c >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1, n - hi) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

QUERIES = {"op12_fill_in_middle": query}
ORACLES = {"op12_fill_in_middle": SQL}
