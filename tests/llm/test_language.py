import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import language as op
from tests.llm.cases import ROWS, documents


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = op.query(spark, d)
    docs = out.filter("held_out and doc_id is not null").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(docs) > 100 and np.mean([r.language == r.lang for r in docs]) > 0.98 and not any(r.rejected for r in docs)
    pages = out.filter("page_id is not null").join(spark.read.parquet(f"{d}/pages.parquet"), "page_id").select("language", F.regexp_extract("html", '<html lang="(..)"', 1).alias("lang")).collect()
    assert len(pages) == 250 and np.mean([r.language == r.lang for r in pages]) > 0.98


TEACH = [(k, t, lang, f"s{k % 3}", 1) for k in range(30) for t, lang in [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")]]


def brute(rows, model, hosts, decls):
    """The fusion written out for each row, without joins: every level and table counts the other rows' votes."""
    langs, votes, models = model.languages, [], [model.block(k) for k in range(model.blocks)]
    likelihoods = lambda text: np.concatenate([m.likelihoods(text) for m in models])
    every = range(len(langs))
    for text in rows:
        ll = likelihoods(text.encode())
        p = op._spread(ll + np.append(model.prior, np.log(1e-3)))
        votes.append(int(p.argmax()) if p.max() >= 0.9 and p.argmax() < len(langs) else None)
    total = np.array([sum(v == k for v in votes) for k in every], float)
    overall = (total + 1) / (total + 1).sum()
    names = [*langs, "other"]
    parts = [h.split(".") for h in hosts]
    domains = [".".join(p[-2:]) if len(p) > 1 else None for p in parts]
    suffixes = [p[-1] if len(p) > 1 else None for p in parts]
    kinds = {s for s, v in zip(suffixes, votes) if s and v is not None}
    out = []
    for i, text in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and votes[j] is not None]
        count = lambda values, value: np.array([sum(values[j] == value and votes[j] == k for j in others) for k in every], float)
        given = lambda values: np.array([sum(bool(values[j]) and votes[j] == k for j in others) for k in every], float)
        log = likelihoods(text.encode())
        domain = count(domains, domains[i]) if domains[i] else np.zeros(len(langs))
        above = (domain + op.DOMAIN_WEIGHT * overall) / (domain.sum() + op.DOMAIN_WEIGHT)
        host = count(hosts, hosts[i])
        log = log + np.append(np.log((host + op.HOST_WEIGHT * above) / (host.sum() + op.HOST_WEIGHT)), np.log(1e-3))
        for values, spare in ((decls, len(names)), (suffixes, len(kinds) + 1)):
            if values[i]:
                x = np.log((count(values, values[i]) + 0.5) / (given(values) + 0.5 * spare))
                log = log + np.append(x, x.mean())
        out.append(op._spread(log))
    return out


@pytest.mark.parametrize("labels", [op.LABELS, 1])
def test_equals_brute_force(spark, monkeypatch, labels):
    """Also where each language is a block of its own."""
    monkeypatch.setattr(op, "LABELS", labels)
    model = op.train(documents(spark, TEACH))
    assert model.languages == ["en", "fr"] and model.blocks == (2 if labels == 1 else 1)
    texts = ["the dog", "le chien", "la maison de", "of the", "chat", "x", "qq", "the cat and", "le", "a"] * 2
    hosts = ["h1", "h2", "h2", "a.h1.com", "b.h2.fr", "b.h2.fr", "a.h1.com", "c.h1.com", "h3.com", "h3.fr", "c.h1.com", "h3.fr", "b.h2.fr", "x.h3.com", "h2", "d.h2.fr", "h9.zz", "a.h1.com", "h1", "h3.com"]
    decls = ["en", "fr", "fr", "en", "en", "fr", "", "en", "other", "en"] * 2
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(zip(texts, hosts, decls))], "doc_id long, text string, h string, d string")
    got = {r.doc_id: r for r in op.identify(df, model, ["doc_id"], F.col("text"), F.col("h"), F.when(F.col("d") == "other", "zz").otherwise(F.col("d"))).collect()}
    for k, p in enumerate(brute(texts, model, hosts, decls)):
        assert got[k].language == [*model.languages, "und"][int(p.argmax())] and got[k].posterior == pytest.approx(p.max(), abs=1e-9)


def test_a_column_of_mistaken_labels(spark):
    """Some 600 labels, all but two of one row each: five blocks of languages, the true ones are still found."""
    teach = TEACH * 20 + [(10**6 + k, f"zq{k} vw{k} kx{k} " * 3, f"label {k}", "s", 1) for k in range(600)]
    model = op.train(documents(spark, teach))
    assert len(model.languages) == 602 and model.blocks == 5 and all(len(model.block(k).languages) <= op.LABELS for k in range(5))
    out = op.identify(documents(spark, TEACH[:6] + [(9, None, None, "s", 1), (10, "zq7 vw7 kx7", None, "s", 1)]), model, ["doc_id"], F.col("text"), F.col("source"), F.lit(None)).collect()
    assert sorted((r.doc_id, r.language) for r in out) == sorted([(i, lang) for i, _, lang, *_ in TEACH[:6]] + [(9, "und"), (10, "label 7")])


def test_odd_rows(spark):
    docs = documents(spark, ROWS)
    out = op.of_documents(docs, op.train(documents(spark, TEACH))).collect()
    assert len(out) == len(ROWS) and {r.doc_id for r in out if r.rejected and r.posterior == 0} == {3, 4, 5}
    none = op.of_documents(docs, op.train(documents(spark, []))).collect()
    assert len(none) == len(ROWS) and all(r.rejected and r.language == "und" for r in none)
    assert op.keep_identified(documents(spark, [])).collect() == []
    pages = spark.createDataFrame([(None, None, None), (1, "no url", "<p>the cat"), (1, "http://a.b.fr/x", "<html lang=fr><p>le chat"), (2, "http://x", "")], "page_id long, url string, html string")
    assert len(op.of_pages(pages, op.train(documents(spark, TEACH))).collect()) == 4
    assert op.keep_identified(docs).columns == docs.columns


def test_declaration_is_read_wherever_the_tag_starts(spark):
    """Clear pages teach what is declared; of the others only the declaration tells the language, after up to 20000 characters."""
    model = op.train(documents(spark, TEACH))
    fronts = ["", "<!-- <html lang=en> <html lang=fr> " + "licence " * 2500 + "-->", " " * 20_000, "<!-- a -->" + "\n" * 9_000 + "<!-- b -->"]
    clear = [(1000 + k, None, f"<html lang={lang}><p>{text}") for k, (_, text, lang, *_) in enumerate(TEACH)]
    bare = [(10 * k + j, None, f"{front}<html class=a lang='{lang}'><p>the dog le chien<html lang=de>") for k, front in enumerate(fronts) for j, lang in enumerate(["en", "fr"])]
    got = {r.page_id: r for r in op.of_pages(spark.createDataFrame(clear + bare, "page_id long, url string, html string"), model).collect()}
    for k in range(len(fronts)):
        assert [got[10 * k + j].language for j in range(2)] == ["en", "fr"]
        assert [got[10 * k + j].posterior for j in range(2)] == pytest.approx([got[j].posterior for j in range(2)], abs=1e-9)


def test_rare_languages_and_suffixes_are_kept(spark):
    """Two rows of 902 are in a third language; its suffix has 2 of 1502 votes and is told from suffixes without votes."""
    rare = "zwei katzen und zwölf hunde wohnen in diesem großen haus"
    teach = [(k, t, lang, f"s{k % 3}", 1) for k in range(450) for t, lang in [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")]]
    teach += [(9000 + k, rare, "de", "s", 1) for k in range(2)]
    model = op.train(documents(spark, teach))
    assert model.languages == ["de", "en", "fr"]
    texts = [("the cat and the dog of the house", "a.com")] * 1500 + [(rare, "b.de")] * 2 + [("the dog le chien", "c.de"), ("the dog le chien", "c.qq")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(texts)], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in op.identify(df, model, ["doc_id"], F.col("text"), F.col("h"), F.lit(None)).filter("doc_id >= 1500").collect()}
    assert all(got[k].language == "de" and not got[k].rejected for k in (1500, 1501))
    votes = {"com": np.array([0, 1500, 0]), "de": np.array([2, 0, 0]), "qq": np.zeros(3)}
    overall = (np.array([2, 1500, 0]) + 1) / 1505
    for k, suffix in [(1502, "de"), (1503, "qq")]:
        x = np.log((votes[suffix] + 0.5) / (sum(votes.values()) + 1.5))
        domain = (op.DOMAIN_WEIGHT * overall) / op.DOMAIN_WEIGHT
        p = op._spread(model.block(0).likelihoods(b"the dog le chien") + np.append(np.log(domain), np.log(1e-3)) + np.append(x, x.mean()))
        assert got[k].posterior == pytest.approx(p.max(), abs=1e-9)
