"""How the sources of each language differ, term by term and source by source, over run-length columns.

Counts: texts are cut into terms (letters A-Z, lower-cased, and everything beyond ASCII); a task adds its documents up before anything is shuffled. A language
keeps its V terms that occur in at least ``least_docs`` of its documents. Of a group (a source of a language, or the language), a term with ``count``
occurrences has p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's occurrences of kept terms, and the divergence of p from q is
f = floor((p - q)**2 / q). All of it is integer arithmetic: f of any pair adds up to less than (SCALE + V)**2, which a long holds for V below two thousand million.

Pairs of sources: the vocabulary is put in an order in which equal counts lie together (by the set of sources that hold a term, its total and a
digest of all its counts) and cut into blocks. In a block each source's column of counts is written as runs. For a pair the boundaries of both
columns' runs are intersected; f of a stretch counts as often as the stretch is long. A block's columns are dealt out by tiles of TILE sources, so no task
holds more than two tiles of one block, however many sources a language has.

Terms: f of each term against the whole language, for terms that a source has more of; the first ``top`` of each source.

Defined cases: null text, language and source count as empty; a source without terms is a group all the same; rows that repeat are documents of their
own, ids play no part; equal values rank by the bytes of the item; texts of any length are read whole, in pieces; an empty table gives an empty
result; further columns are ignored, names that clash included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import keep, scratch, slices, table, text_bytes

SCALE = 10**9
#: Rows (term and source) of a block, sources of a tile.
BLOCK_ROWS, TILE = 1 << 18, 32
#: A task hands its sums on when it holds so many terms or cells.
HELD_TERMS, HELD_CELLS = 300_000, 2_000_000
#: Bytes of text that are cut into terms at once.
PIECE = 1 << 22
#: Byte by byte: a-z and bytes beyond ASCII stay, A-Z become a-z, all else separates terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Numbers(dict):
    """Keys numbered in the order in which they come."""

    def __missing__(self, key) -> int:
        value = self[key] = len(self)
        return value


def _pieces(text: bytes):
    """A text's letters in pieces of about PIECE bytes; no term is cut."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


class _Tally:
    """Occurrences and documents of the terms of each group that a task has seen."""

    def __init__(self):
        self.terms, self.groups, self.parts, self.cells = _Numbers(), _Numbers(), [], 0

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        ids, lengths = [], []
        for text in texts:
            mine = [np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, _pieces(text))]
            lengths.append(sum(map(len, mine)))
            ids += mine
        group = np.array([self.groups[g] for g in zip(langs, sources)], np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        cell, n = _summed(doc << 32 | np.concatenate(ids), np.ones(len(doc), np.int64)) if len(doc) else (doc, doc)
        self.parts.append(_summed(group[cell >> 32] << 32 | cell & 0xFFFFFFFF, n, np.ones(len(n), np.int64)))
        self.cells += len(self.parts[-1][0])

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or self.cells > HELD_CELLS

    def flush(self):
        """Batches of (lang, source, term, n, docs), and one row without a term for each group."""
        groups, terms = list(self.groups), np.array(list(self.terms), object)
        key, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.zeros(0, np.int64),) * 3
        for at in range(0, len(key), 1 << 16):
            k = slice(at, at + (1 << 16))
            g, term = (key[k] >> 32).tolist(), terms[key[k] & 0xFFFFFFFF]
            yield _batch([groups[x][0] for x in g], [groups[x][1] for x in g], pa.array(term, pa.binary()).cast(pa.string()), n[k], docs[k])
        yield _batch([g[0] for g in groups], [g[1] for g in groups], pa.nulls(len(groups), pa.string()), np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64))
        self.__init__()


def _batch(lang, source, term, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it, by group; a null term for each group."""

    def run(batches):
        tally = _Tally()
        for batch in slices(batches, 2):
            tally.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), list(text_bytes(batch.column(2))))
            if tally.full():
                yield from tally.flush()
        yield from tally.flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, total, held, digest) of kept terms: one row for each source that has the term, with what the vocabulary is ordered by."""
    term = Window.partitionBy("lang", "term")
    rows = counts.filter("term is not null").withColumn("bit", F.expr("shiftleft(1L, CAST(pmod(xxhash64(source), 62L) AS INT))"))
    held, digest = F.bit_or("bit").over(term).alias("held"), F.bit_xor(F.xxhash64("source", "n")).over(term).alias("digest")
    rows = rows.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), held, digest)
    return rows.filter(F.col("docs") >= least_docs).drop("docs")


def runs_of(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(column)), bool), column[1:] != column[:-1]]))
    return starts, column[starts]


def run_columns(kept: DataFrame, blocks: int) -> DataFrame:
    """(lang, block, source, length, starts, counts): each source's column of each block that holds it, as runs."""
    order = ["lang", "held", "total", "digest", "term"]
    # equal keys meet in one partition, so a term is in one block
    laid = kept.select(*order, "source", "n").repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    names = ["lang", "block", "source", "length", "starts", "counts"]

    def encode(lang, block, length, sources, cells):
        code, pos, n = (np.concatenate(x) for x in zip(*cells))
        by = np.argsort(code, kind="stable")
        code, pos, n = code[by], pos[by], n[by]
        edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist() + [len(code)]
        known = list(sources)
        for a, b in zip(edges, edges[1:]):
            column = np.zeros(length, np.int64)
            column[pos[a:b]] = n[a:b]
            starts, counts = runs_of(column)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int64()), pa.array([known[code[a]]]), pa.array([length], pa.int64()), pa.array([starts], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=names)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        lang, term, length, sources, cells = None, None, 0, _Numbers(), []
        for batch in batches:
            langs, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            n = batch.column(3).to_numpy()
            source, pos, at = batch.column(2).to_pylist(), np.zeros(len(langs), np.int64), 0
            code = np.zeros(len(langs), np.int64)
            for k, (x, t) in enumerate(zip(langs, terms)):
                if x != lang:
                    if k > at:
                        cells.append((code[at:k], pos[at:k], n[at:k]))
                    if cells:
                        yield from encode(lang, block, length, sources, cells)
                    lang, term, length, sources, cells, at = x, None, 0, _Numbers(), [], k
                if t != term:
                    term, length = t, length + 1
                pos[k], code[k] = length - 1, sources[source[k]]
            if len(langs) > at:
                cells.append((code[at:], pos[at:], n[at:]))
        if cells:
            yield from encode(lang, block, length, sources, cells)

    return laid.select("lang", "term", "source", "n").mapInArrow(run, "lang string, block long, source string, length long, starts array<long>, counts array<long>")


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), by long division in steps of a thousand, so that no product leaves a long."""
    rest, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def diverge(a: tuple, b: tuple, length: int) -> tuple[int, int]:
    """Sums of f of a from b and of b from a; a column is (starts, shares) of its runs."""
    if not length:
        return 0, 0
    bounds = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], bounds, side="right") - 1] for x in (a, b))
    size, square = np.diff(bounds, append=length), (p - q) ** 2
    return int((square // q * size).sum()), int((square // p * size).sum())


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of f over its vocabulary. groups: (lang, source, n, v)."""
    # a language without kept terms has one block of length zero
    blocks = columns.select("lang", "block", "length").distinct().unionByName(groups.filter("v = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("length")).distinct())
    place = Window.partitionBy("lang").orderBy("source")
    tiled = groups.withColumn("tile", F.floor((F.row_number().over(place) - 1) / TILE).cast("int")).withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")))
    whole = tiled.join(blocks, "lang").join(columns.drop("length"), ["lang", "block", "source"], "left")
    sent = whole.withColumn("other", F.explode(F.sequence(F.lit(0), "tiles")))
    sent = sent.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", (F.col("n") + F.col("v")).alias("whole"), "length", "starts", "counts")

    def run(rows: pa.Table) -> pa.Table:
        lang, low, high, length = (rows.column(c)[0].as_py() for c in ("lang", "low", "high", "length"))
        tile, source, whole = (rows.column(c).to_pylist() for c in ("tile", "source", "whole"))
        column = []
        for starts, counts, size in zip(rows.column("starts"), rows.column("counts"), whole):
            s, c = (x.values.to_numpy() if x.is_valid else np.zeros(1, np.int64) for x in (starts, counts))
            column.append((s, shares(c, size) if size else c))
        left = [k for k, t in enumerate(tile) if t == low]
        out = []
        for x, a in enumerate(left):
            for b in left[x + 1 :] if low == high else [k for k, t in enumerate(tile) if t == high]:
                there, back = diverge(column[a], column[b], length)
                out += [(source[a], source[b], there), (source[b], source[a], back)]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([r[0] for r in out], pa.string()), "item": pa.array([r[1] for r in out], pa.string()), "value": pa.array([r[2] for r in out], pa.int64())})

    parts = sent.groupBy("lang", "block", "low", "high").applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with scratch() as last:
        counts = keep(term_counts(docs, lang_col, source_col, text_col), "term-counts")
        kept = keep(kept_terms(counts, least_docs), "kept-terms")
        vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
        groups = counts.filter("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(vocabulary, "lang", "left")
        groups = keep(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "all"))), "divergence-groups")
        columns = keep(run_columns(kept, max(1, -(-kept.count() // block_rows))), "run-columns")
        pairs = pair_sums(columns, groups.drop("all")).withColumn("part", F.lit("pair"))

        share = lambda count, whole: F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) div CAST({whole} AS DECIMAL(20, 0))")
        cells = kept.join(groups.withColumnRenamed("n", "own"), ["lang", "source"]).withColumn("p", share("n", "own + v")).withColumn("q", share("total", "all + v"))
        terms = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
        best = ranked(terms).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
        order = ["lang", "source", "part", "item", "value", "rank"]
        return last(keep(ranked(pairs).select(*order).unionByName(best.select(*order)), "divergence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), per_doc AS (SELECT doc, lang, source, term, count(*) AS n FROM words GROUP BY ALL
), counted AS (SELECT lang, source, term, sum(n)::HUGEINT AS n, count(*) AS docs FROM per_doc GROUP BY ALL
), vocabulary AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL HAVING sum(docs) >= 3
), groups AS (SELECT DISTINCT lang, source FROM d
), langs AS (SELECT g.lang, count(v.term)::HUGEINT AS v, coalesce(sum(v.total), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN vocabulary v USING (lang) GROUP BY g.lang
), cells AS (SELECT g.lang, g.source, v.term, v.total, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), sums AS (SELECT lang, source, sum(n)::HUGEINT AS own FROM cells GROUP BY ALL
), shared AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (s.own + l.v) AS p, 1 + (1000000000::HUGEINT * (c.total + 1)) // (l.n + l.v) AS q
  FROM cells c JOIN sums s USING (lang, source) JOIN langs l USING (lang)
), pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::HUGEINT AS value FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shared WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

QUERIES = {"op11_source_divergence": query}
ORACLES = {"op11_source_divergence": SQL}
