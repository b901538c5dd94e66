"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. What elements say is boilerplate (navigation, footers, asides, forms, site headers) is left out while
reading; of a block it is noted whether a wrapper around it has the name of boilerplate, whether it is in an article (or main) element or one that is named so, how
much of it is linked, and which container it lies in.

First pass: each block is good, bad or ambiguous. A boilerplate name is bad, unless all prose of the page is under such names, which then mean nothing. Link density over
LINK_DENSITY is bad; long blocks are good with stop words and bad without; middling ones need more stop words, else they are ambiguous, and so
are short ones. On a page whose words are hardly ever stop words (another language) length and link density decide alone. What is bad by its text alone but follows
good text in the same container (a list of sources, code) becomes ambiguous.
Second pass: an ambiguous block takes the label of the nearest decided block of its container, or of the page if none there is decided, at equal distance the later one for headings and the
earlier one for others; without any good block on the page it is good.

The article is where the good text is: if articles have at least half of it, what lies outside is bad, but for headings right before one, and
inside only a boilerplate name is bad, all else inherits (nothing of an article may go). If they have less (a page of teasers), they do not count.

Defined cases: null html has no text; a page without any block gives an empty string; unclosed and mismatched tags are
tolerated, and a page is read in time linear in its length however broken it is; texts of any length are read whole; rows are independent,
so null or repeated ids and urls pass through; further columns are ignored, names that clash included; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import table

SHORT, LONG, STOP_DENSITY, LINK_DENSITY = 70, 200, 0.18, 0.4

# Frequent function words of five languages.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which who will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que sa se son sur un une vous
    aber als am an auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im in ist mit nicht oder sich sie sind so und von war wie zu zum zur
    al como con de del el ella en es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus un una y
    che di e il non per sono una della dei con gli le""".split()
)
RAW = {"script", "style", "template", "iframe", "title", "noembed", "noframes"}
CONTROLS = {"form", "select", "button", "textarea", "fieldset", "datalist", "dialog", "label", "option"}
BOILER = {"nav", "footer", "aside", "menu", "head"} | CONTROLS
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Containers; what else holds blocks (lists, tables, quotes) is part of the container around it.
BOXES = {"div", "section", "article", "main", "body", "details", "center", "dialog"}
#: Elements of running text: inside an article their names are the author's own.
TEXT = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "caption", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph, and the open element that a start tag ends, as browsers do; lists and tables bound the search.
ENDS_P = BLOCK - {"html", "head", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "caption", "legend", "summary", "figcaption"}
ENDS = {"li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option"}
BOUNDS = {"ul", "ol", "dl", "table", "select"}

#: Kinds of boilerplate as wrappers are named, and words around them that only say what the wrapper is.
_KINDS = set("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail widget widgets footer masthead topbar toolbar comment comments commentlist replies respond disqus share sharing social related recommended recommendations teaser teasers legal login search disclaimer copyright contentinfo complementary".split())
_WRAPPERS = set("area bar block body box button buttons container content group heading holder inner item items left right top bottom main meta primary secondary links link list outer panel posts region row section site slot stories text title unit wrap wrapper zone page global form and the".split())
#: Names that say what a wrapper has or lacks, names of the main content, and names of a site's head.
_ABOUT = re.compile(r"^(?:no|with|without|has|is|layout)[-_]", re.I)
_CONTENT_NAME = re.compile(r"^(?:(?:main|page|site|post|entry|article|story|blog|news|body)?[-_]?(?:content|body|text)|article|post|entry|hentry|story|main|main[-_]?col(?:umn)?)$", re.I)
_HEAD_NAME = re.compile(r"^(?:(?:site|page|main|global|top)[-_]?header|header|site[-_]?title|logo|top|topnav)$", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[^<]+""", re.S)
#: For the rest of a page in which a quote is never closed: a tag ends at the first ">".
_PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TAG = re.compile(r"</?[a-zA-Z]")
_WORD = re.compile(r"\w+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    article: bool
    heading: bool
    named: bool = False  # a wrapper around it has the name of boilerplate
    box: int = 0  # the innermost container
    label: bool | None = None


@dataclass
class _Open:
    """An open block-level element: what holds for the text inside it."""

    tag: str
    boiler: bool
    article: bool
    heading: bool
    linked: bool  # a link around it
    named: bool
    box: int
    ends: dict  # place in the stack of the elements that a start tag may end
    links: int = 0  # links opened directly inside
    mute: str = ""  # an inline element that is boilerplate, and how often it is open
    depth: int = 0


def _kind(name: str) -> bool:
    """Whether a class, id or role names boilerplate: its last part that is more than a wrapper's does (site-footer, ad-box-2, not side-effects)."""
    parts = [p.lower() for p in _PART.findall(name)]
    while len(parts) > 1 and parts[-1] in _WRAPPERS:
        parts.pop()
    return bool(parts) and parts[-1] in _KINDS


def _named(attributes: str, article: bool) -> tuple[bool, bool]:
    """(boilerplate, main content), as an element's class, id, role and visibility say."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, False
    boiler = content = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if not article and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, False
        if name in ("class", "id", "role"):
            for word in value.split():
                if _CONTENT_NAME.match(word):
                    content = True
                elif not _ABOUT.match(word) and (_kind(word) or not article and _HEAD_NAME.match(word)):
                    boiler = True
    return boiler and not content, content


def blocks_of(page: str) -> list[Block]:
    """Blocks with text outside boilerplate elements in page order; white space inside a block is one space."""
    out: list[Block] = []
    stack, boxes = [_Open("", False, False, False, False, False, 0, {})], 1
    opened: Counter = Counter()
    parts: list[str] = []
    linked, breaks, at, low, token, last = 0, 0, 0, None, _TOKEN, page.rfind(">")
    unclosed: set[str] = set()

    def close_block():
        nonlocal linked, breaks
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.article, top.heading, top.named, top.box))
        parts.clear()
        linked = breaks = 0

    def pop(k: int):
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < len(page):
        m, top = token.match(page, at), stack[-1]
        if m is None:
            if not _TAG.match(page, at):
                at += 1
                if not (top.boiler or top.mute):
                    parts.append("<")
            elif at < last:  # a quote is never closed
                token = _PLAIN
            else:  # a tag without an end
                break
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" and not (top.boiler or top.mute) and (parts or not m[0].isspace()):
                text = entities.unescape(m[0]) if "&" in m[0] else m[0]
                parts.append(text)
                breaks = breaks if text.isspace() else 0
                linked += len(text.strip()) if top.links or top.linked else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close_block()
                if opened[tag]:
                    pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag == "a":
                top.links, top.linked = max(0, top.links - 1), top.linked and top.links > 0
            if tag == top.mute:
                top.depth -= 1
                top.mute = top.mute if top.depth else ""
            continue
        if tag in RAW:
            low = low or page.lower()
            end = -1 if tag in unclosed else low.find(f"</{tag}", at)
            if end < 0 and tag not in ("script", "style", "title"):
                unclosed.add(tag)
                continue
            close = page.find(">", len(page) if end < 0 else end)
            at = len(page) if close < 0 else close + 1
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close_block()
            continue
        if tag in BLOCK:
            close_block()
            if tag in ENDS_P and top.tag == "p":
                pop(len(stack) - 1)
            if tag in ENDS and (k := stack[-1].ends.get(ENDS[tag])):
                pop(k)
            top = stack[-1]
        if tag in VOID:
            continue
        named, content = (False, False) if tag in ("html", "body") else _named(m[3], top.article)
        whole = tag in ("article", "main")
        named = named and not whole and not (top.article and tag in TEXT)
        boiler = tag in BOILER or tag == "header" and not top.article or named and tag not in BLOCK
        if tag in BLOCK:
            ends = {} if tag in BOUNDS else top.ends
            if tag in ENDS:
                ends = ends | {ENDS[tag]: len(stack)}
            article = top.article or whole or content and tag in ("div", "section", "td")
            stack.append(_Open(tag, top.boiler or bool(top.mute) or boiler, article, top.heading or tag in HEADINGS, top.linked or top.links > 0, top.named or named, boxes if tag in BOXES else top.box, ends))
            boxes += tag in BOXES
            opened[tag] += 1
        elif tag == "a":
            top.links += 1
        if tag not in BLOCK and (tag == top.mute or boiler and not top.mute):
            top.mute = tag
            top.depth += 1
    close_block()
    return out


def judge(blocks: list[Block]) -> list[bool | None]:
    """First pass: good (True), bad (False) or ambiguous (None), by each block's text, links and wrappers."""
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    spoken = sum(stops) >= STOP_DENSITY / 4 * sum(map(len, words))
    out: list[bool | None] = []
    for b, ws, n in zip(blocks, words, stops):
        density = n / max(1, len(ws)) if spoken else STOP_DENSITY
        if b.linked > LINK_DENSITY * len(b.text):
            out.append(False)
        elif len(b.text) >= LONG:
            out.append(density >= STOP_DENSITY / 2)
        else:
            out.append(True if len(b.text) >= SHORT and density >= STOP_DENSITY else None)
    believed = any(x and not b.named for b, x in zip(blocks, out)) or not any(out)
    prose: set[int] = set()
    for k, b in enumerate(blocks):
        if believed and b.named:
            out[k] = False
        elif out[k]:
            prose.add(b.box)
        elif out[k] is False and b.box in prose:
            out[k] = None
    return out


def inherit(labels: list[bool | None], headings: list[bool], boxes: list[int]) -> list[bool]:
    """Second pass: ambiguous blocks take the label of the nearest decided one, of those in the same container if there are any."""
    decided: dict[int | None, list[int]] = defaultdict(list)
    for k, x in enumerate(labels):
        if x is not None:
            decided[None].append(k)
            decided[boxes[k]].append(k)
    out = []
    for k, x in enumerate(labels):
        if x is None:
            around = decided.get(boxes[k]) or decided[None]
            after = bisect_left(around, k)
            near = around[max(0, after - 1) : after + 1]
            x = labels[min(near, key=lambda d: (abs(d - k), -d if headings[k] else d))] if near else True
        out.append(x)
    return out


def classify(blocks: list[Block]) -> None:
    """Both passes; sets every block's label."""
    labels = judge(blocks)
    good = [sum(len(b.text) for b, x in zip(blocks, labels) if x and b.article is inside) for inside in (False, True)]
    believed = any(x and not b.named for b, x in zip(blocks, labels)) or not any(labels)
    left_out = [believed and b.named for b in blocks]
    asked = [k for k, x in enumerate(left_out) if not x]
    stands = any(blocks[k].article for k in asked) and good[1] >= good[0]
    if stands:
        asked = [k for k in asked if blocks[k].article]
        labels = [x or None for x in labels]
    elif not any(labels):
        labels = [x if blocks[k].linked > LINK_DENSITY * len(blocks[k].text) else True for k, x in enumerate(labels)]
    found = dict(zip(asked, inherit([labels[k] for k in asked], [blocks[k].heading for k in asked], [blocks[k].box for k in asked])))
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        title = stands and b.heading and not b.article and not left_out[k] and k + 1 < len(blocks) and blocks[k + 1].label and (blocks[k + 1].article or blocks[k + 1].heading)
        b.label = found.get(k, bool(title))


def extract_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [extract_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["a", "b", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).cast("string")).mapInArrow(run, f"a {kinds[id_col]}, b {kinds[url_col]}, text string, n_chars long")
    return rows.withColumnsRenamed({"a": id_col, "b": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_blocks": query}
ORACLES: dict[str, str] = {}
