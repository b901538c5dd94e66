import html as entities
import random
import re
import time

import pytest

from parlance.llm import extract as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="home sidebar-left">
<header class="site"><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a>About</a></ul></nav></header><div class="cookie-notice">We use cookies to make this site work for you and for all of us here.</div>
<!-- ad --><div id="ad-1">Buy the best of the best from the people who made it for you and for him in the city.</div>
<main><article><header><h1>A short   title</h1></header><p><b>This is the first paragraph of the article &amp; it has a number of the usual words in it, as you see.<br>next line<p>Ok.</p>
<p>Another one with a <a href=x>link</a> that is in the middle of the text and of which there is only one here.&nbsp;End</p><ul><li>one item<li>two items</ul><table><tr><td>cell a<td>cell b</table>
<aside>Related: see the other one</aside><form>Your mail <input> <button>Send</button></form><div class="ad">An advert</div>
<section id="comments"><p>I think that this is the best article that I have ever read in my life, and you should all be as happy as I am.</p></section></article></main>
<footer>&copy; the owners of the site and of the rest of the text that you can see in this page</footer></body></html>"""


def test_parts_of_a_page():
    assert op.extract_text(PAGE).split("\n") == [
        "A short title", "This is the first paragraph of the article & it has a number of the usual words in it, as you see. next line", "Ok.",
        "Another one with a link that is in the middle of the text and of which there is only one here. End", "one item", "two items", "cell a", "cell b",
    ]


def test_without_article():
    page = '<body><div>Home</div><ul><li><a>x</a></li><li><a>y</a></li></ul><div><h2>Title of it</h2><p>' + "this is the text of the page and it is long enough for the rule " * 4 + "</p><p>short one</p></div><div><a>more</a> <a>and more</a></div></body>"
    assert op.extract_text(page).split("\n")[-3:] == ["Title of it", ("this is the text of the page and it is long enough for the rule " * 4).strip(), "short one"]


def test_named_containers():
    """Class and id names stand in for elements; a wrapper's name that only mentions a sidebar is no sidebar."""
    body = "this is the text of the page and it is long enough for the rule " * 3
    page = f'''<body><div id="header"><h1>My site and all of the things that are on it for you and for the others</h1></div><div class="wrapper has-sidebar"><div class="post-content"><h2>Heading</h2><p>{body}</p><p>Tail.</p>
    <div class="share-buttons">Share this with all of your friends</div></div><div class="sidebar"><p>{body}</p></div><div class="comments-area"><p>I liked it and it is what I was in need of, so that is that for me and for you.</p></div></div>
    <div class="newsletter">Get it by mail</div><div class="footer">the end of it</div></body>'''
    assert op.extract_text(page).split("\n") == ["Heading", body.strip(), "Tail."]


def test_only_boilerplate_goes_from_an_article():
    """Link-only parts, formulas, parts for browsers without scripts and sections whose names merely contain a word stay."""
    page = """<article><h1>Title</h1><p><a href=x>Read the original report</a></p><ul><li><a href=y>First source</a><li><a href=z>Second source</a></ul>
    <p>Sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> end</p><noscript><p>plain part</p></noscript><object>fallback</object><section class="side-effects">Nausea</section><section id="legal-history"><p>1901 to 1950</p></section>
    <p>Sign <button>Send</button><label>Name</label>here <span class="share-buttons">tweet <b>it</b></span>now</p><pre>x1 y2 z3 """ + "q9 " * 90 + """</pre><div class="related-posts">See too</div><div id="ad-2">Buy</div></article>"""
    assert op.extract_text(page).split("\n") == ["Title", "Read the original report", "First source", "Second source", "Sum a+b end", "plain part", "fallback", "Nausea", "1901 to 1950", "Sign here now", ("x1 y2 z3 " + "q9 " * 90).strip()]


def test_page_of_teasers_is_judged_without_its_articles():
    body = "this is the text of the page and it is long enough for the rule " * 5
    cards = "".join(f"<article><a href={k}>Teaser {k}</a></article>" for k in range(3))
    page = f"<body><div><h2>Title of it</h2><p>{body}</p><p>short</p></div>{cards}<ul>" + "<li><a>x</a></li>" * 5 + "</ul></body>"
    assert op.extract_text(page).split("\n") == ["Title of it", body.strip(), "short"]


def test_other_languages_are_judged_by_length_and_links():
    body = "日本語の文章はここにありますが単語の間に空白はありません。" * 9
    assert op.extract_text(f"<div><p>{body}</p></div><div><a>次へ</a> <a>前へ</a></div>") == body


def slow_labels(blocks):
    """Both passes written out block by block."""
    words = [re.findall(r"\w+", b.text.lower()) for b in blocks]
    spoken = sum(w in op.STOP_WORDS for ws in words for w in ws) >= 0.045 * sum(map(len, words))

    def alone(b, ws):
        stop = sum(w in op.STOP_WORDS for w in ws) / max(1, len(ws)) if spoken else 0.18
        if b.linked / len(b.text) > 0.4:
            return False
        if len(b.text) >= 200:
            return stop >= 0.09
        return True if len(b.text) >= 70 and stop >= 0.18 else None

    text = [alone(b, ws) for b, ws in zip(blocks, words)]
    prose = [k for k, x in enumerate(text) if x]
    gone = {k for k, b in enumerate(blocks) if b.named and (not prose or any(not blocks[j].named for j in prose))}
    prose = [k for k in prose if k not in gone]
    first = {}
    for k, b in enumerate(blocks):
        if k not in gone:
            first[k] = None if text[k] is False and any(j < k and blocks[j].box == b.box for j in prose) else text[k]
    weight = lambda inside: sum(len(blocks[k].text) for k in prose if blocks[k].article == inside)
    stands = any(blocks[k].article for k in first) and weight(True) >= weight(False)
    region = [k for k in first if blocks[k].article or not stands]
    if stands:
        first = {k: x or None for k, x in first.items()}
    elif not prose:
        first = {k: False if blocks[k].linked / len(blocks[k].text) > 0.4 else True for k in first}
    out = [False] * len(blocks)
    for place, k in enumerate(region):
        out[k] = first[k]
        if out[k] is None:
            near = [(blocks[j].box != blocks[k].box, abs(region.index(j) - place), -j if blocks[k].heading else j, first[j]) for j in region if first[j] is not None]
            out[k] = min(near)[3] if near else True
    for k in reversed(range(len(blocks) - 1)):
        b, after = blocks[k], blocks[k + 1]
        if stands and b.heading and not b.article and k not in gone and out[k + 1] and (after.article or after.heading):
            out[k] = True
    return out


def test_both_passes_equal_brute_force():
    rng = random.Random(4)
    labels = set()
    for _ in range(600):
        blocks = []
        for _ in range(rng.randrange(9)):
            n = rng.choice([2, 12, 20, 60])
            text = " ".join(rng.choice(["the", "of", "stone", "river", "x9"] if rng.random() < 0.7 else ["qq", "zz"]) for _ in range(n))
            blocks.append(op.Block(text, rng.choice([0, 0, 0, len(text) // 4, len(text)]), rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.2, rng.randrange(3)))
        op.classify(blocks)
        assert [b.label for b in blocks] == slow_labels(blocks)
        labels |= {b.label for b in blocks}
    assert labels == {True, False}


BODY = "this is the text of the page and it is long enough for the rule " * 4


def test_an_article_keeps_what_its_author_hid_or_named():
    page = f"""<h1>The title</h1><article><p>{BODY}</p><p>It is <span aria-hidden="true">5 km</span> <span style="display:none">or so</span> away</p><div hidden><p>Later.</p></div><p class="legal">By law.</p><p class="search">We looked for it.</p>
    <div class="legal-notice">All rights</div><h2 class="related">Related work</h2></article><h3>More</h3><ul><li><a>x</a></li></ul>"""
    assert op.extract_text(page).split("\n") == ["The title", BODY.strip(), "It is 5 km or so away", "Later.", "By law.", "We looked for it.", "Related work"]


def test_without_article_the_container_of_the_prose_counts():
    page = f"<body><ul><li><a>Home</a></li></ul><p>{BODY}</p><p>{BODY}</p><ul><li><a>First source</a></li><li><a>Second</a></li></ul><p>Ok.</p><pre>{'x1 y2 ' * 60}</pre><div><a>next</a> <a>page</a></div></body>"
    assert op.extract_text(page).split("\n") == [BODY.strip()] * 2 + ["First source", "Second", "Ok.", ("x1 y2 " * 60).strip()]
    assert op.extract_text("<p>A short one.</p><p><a>link</a></p><p>And another.</p>") == "A short one.\nAnd another."


def test_misleading_marks():
    """A small article beside the prose does not count, nor do names that all prose is under; where other prose is, they do."""
    assert op.extract_text(f"<div><h2>Real title</h2><p>{BODY}</p><p>Tail.</p></div><article><h3>Read next</h3><p><a>one</a></p></article>").split("\n") == ["Real title", BODY.strip(), "Tail."]
    page = f'<div class="sidebar"><p>{BODY}</p><p>Tail.</p></div>'
    assert op.extract_text(page) == BODY.strip() + "\nTail." and op.extract_text(page + f"<div><p>{BODY}second</p></div>") == BODY + "second"
    assert op.extract_text(f"<article><p>{BODY}</p></article><div><p>{BODY[:120]}</p></div>") == BODY.strip()  # prose outside the article


@pytest.mark.parametrize("part, tail", [('<b a="', ""), ('<b a="', ">x"), ("<b a='\"", ">"), ("<b ", ""), ("<i>", "</b>" * 9000), ("<div>", "</i>" * 9000), ("<li>", "<div>" * 9000 + "<li>" * 9000), ("<template>", ""), ("<!", ""), ("</", ""), ("<a>", "</p>" * 9000), ("<p><b>", ""), ("&am", "")])
def test_broken_pages_take_linear_time(part, tail):
    began = time.process_time()
    op.extract_text("<p>start " + part * (1_000_000 // len(part) if not tail or len(tail) < 9 else 9000) + tail)
    assert time.process_time() - began < 6


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>a<"), (4, "u", "<article><p>only"), (4, "u", '<p class="x>broken'), (5, "u", "<article>" + "<div>" * 3000 + "deep"), (6, "u", "<script>never closed <p>x"), (7, "u", "plain &lt;text&gt; here"), (8, "u", "<article><p>" + "word " * 300_000)]
    out = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = op.extract(out).collect()
    assert [r.text for r in got[:2]] == ["", ""] and got[3].text == "only" and got[5].text == "deep" and got[7].text == "plain <text> here"
    assert got[8].text == ("word " * 300_000).strip() and all(r.n_chars == len(r.text) for r in got)
    assert op.extract(out.limit(0)).collect() == []


def test_given_pages_give_whole_articles(spark, sf_dir):
    """On the given pages the article element holds the article and nothing else."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in op.query(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
