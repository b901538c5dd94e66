"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: one record per page; records with equal payloads of at least ``min_revisit`` bytes refer to the one with the
smallest page id. A record's header and payload are one string column and the record separator is the line
separator of Spark's text writer, so any store that Spark writes to will do.

Reading: archives are split at the record magic, wherever it stands, in as many tasks as Spark cuts the files into.
Each task turns its pieces into candidates: the offset of the magic and, from the header after it, the offset of
the successor. Offsets within a block become offsets in the file by a running sum over block lengths. Pointer jumping
(each candidate's pointer doubles its reach in every round) marks what is reachable from each file's
start; magic inside a payload is not, and its bytes go back to the record that contains them.

Defined cases: what a payload holds never stops a job: magic with a header that is cut off, not a header or says a length that is malformed, beyond the
file or of any number of digits is payload; payloads of any length are read whole (a task holds one record, twice its size if it contains the
magic); null html is an empty payload; a null url is left out; line breaks in a url are percent-encoded; a
record without page id is read back without one and is never referred to; pages that repeat an id are
separate records; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import discard, fresh_path, keep, table
from parlance.llm.exact_dedup import maybe_hits

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Digits of a length that is believed: offsets that such lengths add up to fit a long. Longer ones stand in no archive, only in payloads.
LENGTH_DIGITS = 15
#: Pieces of records that contain the magic are fetched by a broadcast of their places up to this number, else by a shuffled join.
BROADCAST_PIECES = 100_000


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write WARC files into the folder ``path``."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"))
    firsts = rows.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = keep(firsts, "warc-firsts")
    # a filter of fixed size keeps pages without an equal out of the join, so their payloads are not shuffled
    marked = maybe_hits(rows.withColumn("key", F.col("digest")), firsts.select(F.col("digest").alias("key"), "n")).drop("key")
    alone = marked.filter("not _maybe").withColumn("first", F.lit(None).cast("long"))
    both = marked.filter("_maybe").join(firsts.select("digest", "first"), "digest", "left").unionByName(alone)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    number = lambda c: F.concat(F.lit("<urn:parlance:page:"), c.cast("string"), F.lit(">"))

    def line(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(number(F.col("id")), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Refers-To", F.when(revisit, number(F.col("first")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    both.select(record.alias("value")).write.option("lineSep", END).text(path)


def _parse(piece: bytes) -> tuple[int, int, dict] | None:
    """Header length, content length and fields of a record whose magic has been cut off; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in piece[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    counts = size.isascii() and size.isdigit() and len(size) <= LENGTH_DIGITS
    return (end + 4, int(size), fields) if counts and b"warc-type" in fields else None


_CANDIDATE = "file string, block long, seq long, rel long, size long, head long, content long, type string, record string, refers string, declared string, sha string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches):
    """(piece, file, block, place in the block, offset in the block): a block's pieces come in order."""
    at, seq, rel = None, 0, 0
    for batch in batches:
        for value, file, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if at != (file, block):
                at, seq, rel = (file, block), 0, 0
            yield value, file, block, seq, rel
            seq, rel = seq + 1, rel + len(value) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece between two magics, with what its header says (content is null if it is none)."""
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _CANDIDATE.split(", ")]

    def run(batches):
        rows = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for value, file, block, seq, rel in _numbered(batches):
            row = [file, block, seq, rel, len(value), None, None, None, None, None, None, None]
            if parsed := _parse(value):
                head, content, fields = parsed
                row[5:11] = head, content, fields[b"warc-type"], fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest")
                if len(value) >= head + content:
                    row[11] = hashlib.sha256(value[head : head + content]).hexdigest()
            rows.append(row)
            if len(rows) >= 5000:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    found = keep(_pieces(spark, path).mapInArrow(run, _CANDIDATE), "warc-candidates")
    total = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("length"))
    start = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.col("start") + F.col("rel") - len(MAGIC)
    successor = F.col("off") + len(MAGIC) + F.col("head") + F.col("content") + len(END)
    return found.join(total.select("file", "block", start.alias("start")), ["file", "block"]).withColumn("off", offset).withColumn("next", successor).drop("start")


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, off) of the nodes (file, off, next) that a chain from offset 0 of their file reaches; by pointer jumping.

    After k rounds a node points 2**k records on and the first 2**k records of each chain are reached. Only pointers that
    still lead to a node are carried on, so a round's table shrinks with what is left of the chains."""
    here = nodes.select("file", F.col("off").alias("jump")).hint("shuffle_hash")  # nothing of a round is broadcast: its tables grow with the archives
    live = keep(nodes.select("file", "off", F.col("next").alias("jump")).join(here, ["file", "jump"], "left_semi"), "chain")
    reached = [keep(nodes.filter("off = 0").select("file", "off"), "reached")]
    while not live.isEmpty():
        so_far = reached[0]
        for part in reached[1:]:
            so_far = so_far.unionByName(part)
        reached.append(keep(live.join(so_far.hint("shuffle_hash"), ["file", "off"], "left_semi").select("file", F.col("jump").alias("off")), "reached"))
        further = live.select("file", F.col("off").alias("jump"), F.col("jump").alias("jump2"))
        after = keep(live.join(further.hint("shuffle_hash"), ["file", "jump"]).select("file", "off", F.col("jump2").alias("jump")), "chain")
        discard(live)
        live = after
    out = reached[0]
    for part in reached[1:]:
        out = out.unionByName(part)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record, type, refers, declared (digest), bytes, digest; both of the payload in the archive."""
    nodes = keep(candidates(spark, path), "warc-nodes")
    chain = reachable(nodes.filter("off >= 0 and content is not null")).withColumn("chained", F.lit(True))
    marked = nodes.join(chain.hint("shuffle_hash"), ["file", "off"], "left")
    owner = F.last(F.when(F.col("chained"), F.col("off")), ignorenulls=True).over(Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    records = keep(marked.withColumn("owner", owner), "warc-records")
    heads = records.filter("chained")
    whole = heads.filter("sha is not null")
    result = ["record", "type", "refers", "declared", F.col("content").alias("bytes"), F.col("sha").alias("digest")]
    cut = heads.filter("sha is null").select("file", "owner")
    if cut.isEmpty():
        return whole.select(*result)
    parts = records.join(cut, ["file", "owner"], "left_semi").select("file", "block", "seq", "owner", "off")
    wanted = F.broadcast(parts) if parts.count() <= BROADCAST_PIECES else parts
    layout = "value binary, file string, block long, seq long"

    def bodies(batches):
        for value, file, block, seq, _ in _numbered(batches):
            yield pa.RecordBatch.from_pydict({"value": [value], "file": [file], "block": [block], "seq": [seq]}, pa.schema([("value", pa.binary()), ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64())]))

    texts = _pieces(spark, path).mapInArrow(bodies, layout).join(wanted, ["file", "block", "seq"])
    joined = texts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", F.hex("value").alias("value")))).alias("parts"))
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC.encode().hex().upper()))
    mended = heads.filter("sha is null").join(joined, ["file", "owner"]).withColumn("sha", F.sha2(raw.substr(F.col("head").cast("int") + 1, F.col("content").cast("int")), 256))
    return whole.select(*result).unionByName(mended.select(*result))


def pages_of(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, verified (declared digest and payload agree)."""
    number = lambda c: F.regexp_extract(c, "^<urn:parlance:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = records.select(number("record").alias("page_id"), "type", number("refers").alias("refers_to"), "bytes", "digest", F.substring("declared", 8, 64).alias("declared"))
    full = rows.filter("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared")).agg(F.first("bytes").alias("full_bytes"))
    revisits = rows.filter("type = 'revisit'").join(full, ["refers_to", "declared"], "left")
    out = lambda df, size, digest, ok: df.select("page_id", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", ok.alias("verified"))
    return out(rows.filter("type <> 'revisit'"), F.col("bytes"), F.col("digest"), F.col("declared") == F.col("digest")).unionByName(out(revisits, F.col("full_bytes"), F.col("declared"), F.col("full_bytes").isNotNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return pages_of(read_archives(spark, path))


SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN first END AS refers_to, TRUE AS verified
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""

QUERIES = {"op3_warc_chain": query}
ORACLES = {"op3_warc_chain": SQL}
