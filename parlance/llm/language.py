"""Language identification by Bayesian evidence fusion.

Evidence: the text (hashed byte trigrams against each language's frequencies), the language that the markup declares, the
address suffix, and a prior of the host. The declared language is that of a page's first html tag outside comments, wherever it starts. Text frequencies are learned from labelled rows; the other three from the
votes of confident texts by grouped aggregation: how often each language is declared as what, how the
suffixes of each language are spread, and how often a host has each language, smoothed towards its domain
and that towards the whole table. A row's own vote is taken out of all of these counts but the whole table's. A background class of evenly spread
trigrams stands for texts in none of the languages.

Every labelled language is learned, however few its rows: the model has 2**15 columns for each (256 KB). At most LABELS languages are held and broadcast at
once (32 MB); with more labels, as in a column full of mistakes, texts are read once for each block of languages, which adds its likelihoods to
the row, so a row then carries a number for each label. Hosts and suffixes are joined, not broadcast; a suffix without votes is a class of its own.

Rejected are texts without a letter, texts for which the background wins, and those whose best posterior is under ``min_posterior``.

Defined cases: texts and pages of any length are read whole; null text is empty and rejected; null host, suffix or declaration is no evidence; a declaration outside the
languages is a class of its own; without labelled rows every row is "und" and rejected; rows that repeat are treated alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import extract
from parlance.llm.common import crc_remainder, keep, prune, row_key, scratch, slices, table, text_bytes

COLUMNS = 1 << 15
CHUNK = 1 << 20
#: Languages whose counts a task holds before it hands them on.
HELD = 256
#: Languages of a block.
LABELS = 128
#: Rows with their likelihoods that a task unpacks at once.
UNPACKED = 512
UNKNOWN = "und"
#: Trigrams overlap: each byte is seen by three of them.
TEMPER = 1 / 3
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
#: A comment of a page, up to the end of the page if it is not closed.
COMMENT = r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))"
_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased text with a space at either end."""
    low = b" " + text.lower() + b" "
    out = np.zeros(COLUMNS)
    for at in range(0, len(low) - 2, CHUNK):
        b = np.frombuffer(low[at : at + CHUNK + 2], np.uint8).astype(np.uint64)
        key = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        out += np.bincount(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64), minlength=COLUMNS)
    return out


class TextModel:
    """Log frequencies by language of a block, and of the background if it is the last one."""

    def __init__(self, languages: list[str], counts: np.ndarray, last: bool = True):
        self.languages = languages
        spread = counts + 0.05
        spread /= spread.sum(1, keepdims=True)
        self.logs = np.log(np.concatenate([spread, np.full((int(last), COLUMNS), 1 / COLUMNS)])).T.copy()

    def likelihoods(self, text: bytes) -> np.ndarray:
        counts = trigram_counts(text)
        at = np.nonzero(counts)[0]
        return TEMPER * (counts[at] @ self.logs[at])


class Languages:
    """What the labelled rows say: languages, how many rows each has, and a table (lang, col, n) of their trigrams."""

    def __init__(self, rows: dict[str, int], sums: DataFrame | None):
        self.languages, self.sums = list(rows), sums
        n = np.array(list(rows.values()), float)
        self.prior = np.log((n + 1) / (n + 1).sum()) if rows else np.zeros(0)
        self.blocks = max(1, -(-len(rows) // LABELS))

    def block(self, k: int) -> TextModel:
        """The model of the k-th LABELS languages; its table has at most LABELS x COLUMNS rows."""
        mine = self.languages[k * LABELS : (k + 1) * LABELS]
        counts = np.zeros((len(mine), COLUMNS))
        if mine:
            sums = self.sums.filter(F.col("lang").between(mine[0], mine[-1])).toArrow()
            place = {lang: j for j, lang in enumerate(mine)}
            counts[[place[x] for x in sums.column(0).to_pylist()], sums.column(1).to_numpy()] = sums.column(2).to_numpy()
        return TextModel(mine, counts, k == self.blocks - 1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Frequencies from all labelled rows, added up per task before they are shuffled."""
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}  # one a language

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for lang, counts in sums.items():
                at = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], names=["lang", "col", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from out()
                    sums[lang] = np.zeros(COLUMNS)
                sums[lang] += trigram_counts(text)
        yield from out()

    if not rows:
        return Languages(rows, None)
    sums = labelled.mapInArrow(run, "lang string, col long, n long").groupBy("lang", "col").agg(F.sum("n").alias("n"))
    return Languages(rows, keep(sums, "language-counts") if len(rows) > LABELS else sums)


def _spread(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max())
    return p / p.sum()


def _text_rows(docs: DataFrame, model: Languages, html: bool) -> DataFrame:
    """(…, lls, vote): log likelihoods by language with the background last, and the vote of a confident text."""
    carried = [c for c in docs.columns if c != "text"]
    kinds, prior = dict(docs.dtypes), model.prior

    def one_block(df: DataFrame, k: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(model.block(k))
        last = k == model.blocks - 1

        def run(batches):
            m = shared.value
            for batch in slices(batches, len(carried), 1 << 20) if model_blocks > 1 else batches:
                lls, votes, texts = [], [], []
                before = batch.column(len(carried) + 1).to_pylist() if k else [None] * batch.num_rows
                for value, known in zip(batch.column(len(carried)).to_pylist(), before):
                    text = extract.extract_text(value) if html and not k else value or ""
                    data = text.encode()
                    ll = m.likelihoods(data) if _LETTER[np.frombuffer(data, np.uint8)].any() else None
                    if ll is not None and known is not None:
                        ll = np.concatenate([known, ll])
                    vote = None
                    if last and ll is not None and len(prior):
                        p = _spread(ll + np.append(prior, np.log(1e-3)))
                        vote = int(p.argmax()) if p.max() >= 0.9 and p.argmax() < len(prior) else None
                    lls.append(ll), votes.append(vote), texts.append(text)
                out = [pa.array(lls, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *([*out, pa.array(votes, pa.int32())] if last else [pa.array(texts, pa.string()), *out])], names=[*carried, *(["lls", "vote"] if last else ["text", "lls"])])

        layout = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "lls array<double>, vote int" if last else "text string, lls array<double>"])
        return df.mapInArrow(run, layout)

    model_blocks, df = model.blocks, docs.select(*carried, "text")
    for k in range(model_blocks - 1):
        df = keep(one_block(df, k), "language-block")
    return one_block(df, model_blocks - 1)


def _votes(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Votes by language of each group, as a map of at most one entry a language."""
    return df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias(out))


def identify(docs: DataFrame, model: Languages, ids: list[str], text: Column, host: Column, declared: Column, html: bool = False, min_posterior: float = 0.4) -> DataFrame:
    """ids, text_language, language, posterior, rejected for every row of docs."""
    languages = model.languages
    host = F.lower(host.cast("string"))
    parts = F.split(host, r"\.")
    rows = docs.select(
        *ids, host.alias("host"), F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).alias("domain"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("suffix"),
        F.lower(F.regexp_extract(declared.cast("string"), "^\\s*([A-Za-z]{2,8})", 1)).alias("declared"), text.cast("string").alias("text"),
    )
    rows = keep(_text_rows(rows, model, html), "language-texts")
    voted = rows.filter("vote is not null")
    hosts = voted.groupBy("host", "domain", "vote").agg(F.count("*").alias("n"))
    hosts = keep(hosts, "language-hosts")
    domains = _votes(hosts.filter("domain is not null").groupBy("domain", "vote").agg(F.sum("n").alias("n")), ["domain"], "domain_votes")
    by_host = _votes(hosts.filter("host is not null").groupBy("host", "vote").agg(F.sum("n").alias("n")), ["host"], "host_votes")
    total = np.zeros(len(languages))
    for r in hosts.groupBy("vote").agg(F.sum("n").alias("n")).collect():
        total[r.vote] = r.n
    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared") != "", F.lit("other"))
    declarations = {(r.d, r.vote): r.n for r in voted.groupBy(known.alias("d"), "vote").agg(F.count("*").alias("n")).filter("d is not null").collect()}
    suffixes = keep(voted.filter("suffix <> ''").groupBy("suffix", "vote").agg(F.count("*").alias("n")), "language-suffixes")
    by_suffix = _votes(suffixes, ["suffix"], "suffix_votes")
    # half a count for each suffix and for those without votes
    spread = np.full(len(languages), (suffixes.select("suffix").distinct().count() + 1) / 2)
    for r in suffixes.groupBy("vote").agg(F.sum("n").alias("n")).collect():
        spread[r.vote] += r.n

    of_declared: dict[str, dict[int, int]] = {}
    declared_sums = np.full(len(languages), 0.5 * (len(languages) + 1))
    for (value, k), n in declarations.items():
        of_declared.setdefault(value, {})[k] = n
        declared_sums[k] += n
    known_languages = set(languages)

    def likelihood(counts: np.ndarray, sums: np.ndarray, own) -> np.ndarray:
        """log P(value | language) with half a count added and without the row's own vote; the background has the mean of all languages."""
        mine = np.zeros(len(languages))
        if own is not None:
            mine[own] = 1
        x = np.log((counts - mine + 0.5) / (sums - mine))
        return np.append(x, x.mean())

    overall = (total + 1) / (total + 1).sum() if len(languages) else total
    names = [*ids, "text_language", "language", "posterior", "rejected"]
    kinds = dict(docs.dtypes)

    def smoothed(votes, own, above: np.ndarray, weight: float) -> np.ndarray:
        counts = np.zeros(len(languages))
        for k, n in votes or ():
            counts[k] = n
        if own is not None and votes:
            counts[own] = max(0, counts[own] - 1)
        return (counts + weight * above) / (counts.sum() + weight)

    def run(batches):
        every = [*languages, UNKNOWN]
        for batch in (whole.slice(k, UNPACKED) for whole in batches for k in range(0, whole.num_rows, UNPACKED)):
            first, best, post, bad = [], [], [], []
            n = len(ids)
            for ll, own, decl, suffix, hv, dv, sv in zip(*(batch.column(n + k).to_pylist() for k in range(7))):
                if ll is None or not languages:
                    first.append(UNKNOWN), best.append(UNKNOWN), post.append(0.0), bad.append(True)
                    continue
                ll = np.array(ll)
                first.append(every[int((ll + np.append(np.log(overall), np.log(1e-3))).argmax())])
                prior = smoothed(hv, own, smoothed(dv, own, overall, DOMAIN_WEIGHT), HOST_WEIGHT)
                log = ll + np.append(np.log(prior), np.log(1e-3))
                if decl:
                    counts = np.zeros(len(languages))
                    for j, m in of_declared.get(decl if decl in known_languages else "other", {}).items():
                        counts[j] = m
                    log = log + likelihood(counts, declared_sums, own)
                if suffix:
                    counts = np.zeros(len(languages))
                    for j, m in sv or ():
                        counts[j] = m
                    log = log + likelihood(counts, spread, own)
                p = _spread(log)
                k = int(p.argmax())
                best.append(every[k]), post.append(float(p[k])), bad.append(k == len(languages) or p[k] < min_posterior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(first, pa.string()), pa.array(best, pa.string()), pa.array(post, pa.float64()), pa.array(bad, pa.bool_())], names=names)

    joined = rows.join(by_host, "host", "left").join(domains, "domain", "left").join(by_suffix, "suffix", "left").select(*ids, "lls", "vote", "declared", "suffix", "host_votes", "domain_votes", "suffix_votes")
    return joined.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), "text_language string, language string, posterior double, rejected boolean"]))


def of_documents(docs: DataFrame, model: Languages, min_posterior: float = 0.4, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents carry no markup or address; their source is the host."""
    return identify(docs, model, list(ids), F.col("text"), F.col("source"), F.lit(None), min_posterior=min_posterior)


def of_pages(pages: DataFrame, model: Languages, min_posterior: float = 0.4) -> DataFrame:
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)
    tag = F.regexp_extract(F.regexp_replace("html", COMMENT, " "), "(?i)<html(?=[\\s/>])[^>]*", 0)  # the first one, wherever it starts
    declared = F.regexp_extract(tag, "(?i)\\slang\\s*=\\s*[\"']?([A-Za-z-]+)", 1)
    return identify(pages, model, ["page_id"], F.col("html"), F.when(host != "", host), declared, html=True, min_posterior=min_posterior)


def keep_identified(docs: DataFrame, min_posterior: float = 0.4) -> DataFrame:
    """Rows of docs whose language is known; their label column teaches, it does not decide. Rows that share text and source are decided alike."""
    key = row_key(F.col("source"), F.col("text"))
    with scratch() as last:
        found = of_documents(docs.select(key.alias("_key"), "source", "text"), train(docs), min_posterior, ids=("_key",))
        lost = last(keep(found.filter("rejected").select("_key"), "language-lost"))
    return prune(docs, key, lost)


def query(spark: SparkSession, sf_dir: str, modulus: int = 5, held: int = 1) -> DataFrame:
    """All documents and all pages; the text model learns from documents whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_remainder(F.col("doc_id"), modulus) != held))
    kind = dict(docs.dtypes)["doc_id"]
    a = of_documents(docs, model).withColumn("held_out", crc_remainder(F.col("doc_id"), modulus) == held)
    b = of_pages(table(spark, sf_dir, "pages"), model).withColumn("held_out", F.lit(True)).withColumn("doc_id", F.lit(None).cast(kind))
    return a.withColumn("page_id", F.lit(None).cast("long")).unionByName(b)


QUERIES = {"op4_language_evidence": query}
ORACLES: dict[str, str] = {}
