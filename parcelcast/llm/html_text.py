"""Main text of web pages: boosted trees score the nodes of a page, and a pass over its tree decodes them together.

A page is read into its block elements; inline markup only adds text to the block around it. Features of a node are its
tag and attribute words (hashed, with those of its ancestors), how dense its subtree is in text, links, elements and
sentences, its depth and place, and how it compares with its siblings. A node is kept if main text is in it; decoding
takes the likeliest choice for all nodes together in which nothing under a dropped node is kept.

There are no labels for pages, so the trees learn from pages of known make: the blocks of at most ``SAMPLE_PAGES`` pages
(smallest hashes of their ids), main text and other, are put into the layouts that ``layouts`` varies, besides the
sampled pages themselves where they name their article.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelcast.llm import boosting
from parcelcast.llm.common import by_batch, steps

SAMPLE_PAGES = 250
WORD_BUCKETS = 48
STEP = 4 << 20

#: HTML elements that begin a block, that have no content, whose content is no text, and that end an open
#: element of the same group.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())  # without end tag they reach to the end of the page
SILENT = RAW | frozenset("noscript template svg object canvas audio video head".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table select menu".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAGS = ("p", "h", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "list", "li", "table", "figure", "control", "quote", "other")
_KIND = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "menu": "list", "dl": "list", "dt": "li", "dd": "li", "tr": "table",
         "td": "table", "th": "table", "tbody": "table", "thead": "table", "tfoot": "table", "figcaption": "figure", "button": "control", "label": "control", "select": "control",
         "option": "control", "fieldset": "form", "legend": "control", "blockquote": "quote", "pre": "quote"}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset = frozenset()
    children: list[int] = field(default_factory=list)
    own: int = 0
    linked: int = 0
    marks: int = 0
    elements: int = 0
    begin: int = 0
    runs: int = 0


def _silent_end(page: str, at: int, name: str, around: list[str]) -> int:
    """Where the content of a silent element ends that begins at ``at``: after its own end tag, elements of its name
    inside it counted, or, without one, before the end tag of an element ``around`` it; a block outside foreignObject
    ends a drawing, too. Of an element that nothing ends, only the tag is silent; raw text is then the rest of the page."""
    if name in RAW:
        end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        return end.end() if end else len(page)
    begin, inside, foreign, opened = at, 1, 0, Counter()
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == name and not m[3].endswith("/"):
            inside += -1 if m[1] else 1
            if not inside:
                return at
        elif name == "svg" and tag == "foreignobject":
            foreign += -1 if m[1] else 1
        elif name == "svg" and tag in BLOCKS and not m[1] and not foreign:
            return m.start()
        elif tag in RAW and not m[1] and not m[3].endswith("/"):
            at = _silent_end(page, at, tag, [])
        elif tag in around and m[1] and not opened[tag]:
            return m.start() if name != "head" else begin
        elif tag in around:
            opened[tag] += -1 if m[1] else 1
    return begin


def read(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page in order, parents first, and its runs of text with the node each is in."""
    nodes, runs = [Node("root", -1, 0)], []
    stack, pieces, link, linked, seen = [0], [], False, 0, 0

    def flush() -> None:
        nonlocal linked, seen
        text = " ".join("".join(pieces).split())
        if text:
            at = nodes[stack[-1]]
            at.own += len(text)
            at.linked += min(linked, len(text))
            at.marks += sum(map(text.count, ".,;:!?"))
            at.runs += 1
            runs.append((stack[-1], text))
            seen += len(text)
        pieces.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                text = unescape(m[0])
                pieces.append(text)
                if link:
                    linked += len(text.strip())
            continue
        name = name.lower()
        if name in SILENT:
            if not m[1] and not m[3].endswith("/"):
                at = _silent_end(page, at, name, [nodes[k].tag for k in stack[1:]])
            continue
        if name == "a":
            link = not m[1]
        nodes[stack[-1]].elements += not m[1]
        if name == "br":
            pieces.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if m[1]:
            where = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == name), 0)
            if where and name not in ("html", "body"):
                del stack[where:]
                link = False
            continue
        if name in ("html", "body") and any(n.tag == name for n in nodes):
            continue
        if nodes[stack[-1]].tag == "p" or nodes[stack[-1]].tag[0] == "h" and nodes[stack[-1]].tag[1:].isdigit() and name[0] == "h" and name[1:].isdigit():
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in SAME.get(name, ()):
                del stack[k:]
                break
            if tag in SCOPE:
                break
        if name in VOID:
            continue
        words = set()
        for key, *values in _ATTRIBUTE.findall(m[3]):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                words.update(w.lower() for w in _WORD.findall(value))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "none" in value:
                words.add("hidden")
        nodes.append(Node(name, stack[-1], len(stack), frozenset(words), begin=seen))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    own = np.array([[x.own, x.linked, x.marks, x.elements, x.runs, 1, x.tag == "p"] for x in nodes], np.float64)
    sub = own.copy()
    for i in range(n - 1, 0, -1):
        sub[nodes[i].parent] += sub[i]
    tags, bag = np.zeros((n, len(TAGS))), np.zeros((n, WORD_BUCKETS))
    above, places = np.zeros((n, len(TAGS))), np.zeros((n, 6))
    total = max(1.0, sub[0, 0])
    for i, x in enumerate(nodes):
        kind = _KIND.get(x.tag, x.tag)
        tags[i, TAGS.index(kind) if kind in TAGS else len(TAGS) - 1] = 1
        if x.parent >= 0:
            above[i] = np.maximum(above[x.parent], tags[x.parent])
            bag[i] = np.where(bag[x.parent] > 0, 1, 0)
        for w in x.words:
            bag[i, crc32(w.encode()) % WORD_BUCKETS] = 2
        c = x.children
        if c:
            size = sub[c, 0]
            mean, linked = size.mean(), sub[c, 1].sum() / max(1.0, size.sum())
            for k, j in enumerate(c):
                places[j] = (k / len(c), len(c), np.log1p(mean), linked, sub[j, 0] / max(1.0, size.max()), sum(nodes[s].tag == nodes[j].tag for s in c[max(0, k - 3):k + 4]))
    size = np.maximum(1.0, sub[:, 0])
    numbers = np.stack([np.array([x.depth for x in nodes], float), np.log1p(own[:, 0]), np.log1p(sub[:, 0]), sub[:, 1] / size, sub[:, 2] / size, sub[:, 3] / size,
                        size / np.maximum(1.0, sub[:, 4]), sub[:, 5], sub[:, 6], sub[:, 6] / sub[:, 5], sub[:, 0] / total, np.array([x.begin for x in nodes]) / total,
                        own[:, 0] / size, np.full(n, np.log1p(total))], axis=1)
    return np.concatenate([numbers, places, tags, above, bag], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest set of kept nodes in which a kept node's parent is kept."""
    n = len(nodes)
    weight = np.array([1 + np.log1p(x.own) for x in nodes])
    keep, drop = (-weight * np.logaddexp(0, -s * odds) for s in (1.0, -1.0))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


#: Attribute words that pages commonly give to main text and to what surrounds it, by kind; fixed values.
MAIN_WORDS = "content article post entry main story body text page single".split()
AROUND = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topbar links toc pagination", "header": "header masthead site logo branding top banner",
    "footer": "footer bottom copyright legal colophon credits", "aside": "sidebar aside widget related recommended popular trending more tags side rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense", "notice": "cookie cookies notice consent gdpr alert popup modal overlay disclaimer hidden message",
    "comments": "comment comments reply replies discussion respond disqus reader responses thread", "form": "form newsletter subscribe signup search login contact subscription input",
    "share": "share social sharing follow buttons author bio meta"}


def layouts(rng: random.Random, good: list[str], other: list[str], more: list[str]) -> str:
    """A page of ``good`` texts as its article among ``other`` and ``more``; an attribute says which elements are main."""
    say = lambda t: escape(t, quote=False)
    pick = lambda k: [say(rng.choice(other or ["."])) for _ in range(k)]

    def attributes(kind: str | None) -> str:
        words = MAIN_WORDS if kind is None else AROUND[kind].split()
        if rng.random() < 0.25:
            return ""
        name = "-".join(rng.sample(words, 1 if rng.random() < 0.6 else 2))
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(k: int) -> str:
        one = lambda t: f'<a href="#">{" ".join(t.split()[:rng.randint(1, 5)])}</a>'
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{one(t)}</li>" for t in pick(k)) + "</ul>"
        return " ".join(map(one, pick(k)))

    def around(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section", "form": "form"}.get(kind, "div")
        known = attributes(kind)
        if rng.random() < 0.4 and (known or tag != "form"):
            tag = "div" if known else tag
        if kind == "nav":
            inner = links(rng.randint(3, 9))
        elif kind == "comments":
            inner = f"<h3>{rng.choice(['Comments', 'Discussion', '3 replies'])}</h3>" + "".join(
                f"<{t}{attributes(kind)}><p>{say(rng.choice(more or ['.']))}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 5))
        elif kind == "form":
            inner = f"<label>{pick(1)[0][:40]}</label><input type=text><button>{pick(1)[0][:12]}</button>" + (f"<p>{pick(1)[0]}</p>" if rng.random() < 0.4 else "")
        elif kind == "header":
            inner = f"<div>{pick(1)[0][:60]}</div>" + (links(4) if rng.random() < 0.5 else "")
        elif kind == "aside":
            inner = f"<h4>{pick(1)[0][:30]}</h4>" + (links(4) if rng.random() < 0.6 else f"<p>{say(rng.choice(more or ['.']))}</p>")
        elif kind == "footer":
            inner = "&copy; " + pick(1)[0] + (links(3) if rng.random() < 0.4 else "")
        else:
            inner = rng.choice([pick(1)[0], f"<p>{pick(1)[0]}</p>", f"<p>{say(rng.choice(more or ['.']))}</p>"])
        return f"<{tag}{known}>{inner}</{tag}>"

    body = []
    if good and rng.random() < 0.85:
        body.append(f"<h1 data-main>{say(good[0])}</h1>")
        good = good[1:]
    for t in good:
        shape = rng.random()
        tag = "p" if shape < 0.8 else rng.choice(["h2", "blockquote", "div", "li", "td", "pre"])
        text = say(t)
        if rng.random() < 0.15 and " " in text:
            first, rest = text.split(" ", 1)
            text = f'<a href="#">{first}</a> <b>{rest}</b>'
        block = f"<{tag} data-main>{text}</{tag}>" if rng.random() < 0.9 else f"<{tag} data-main>{text}"
        if tag in ("li", "td"):
            block = f"<ul data-main>{block}</ul>" if tag == "li" else f"<table data-main><tr data-main>{block}</tr></table>"
        body.append(block)
        if rng.random() < 0.12:
            body.append(around(rng.choice(["ad", "share", "aside", "form", "notice"])))
    if rng.random() < 0.3:
        body.insert(0, around("share"))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    main = f"<{tag} data-main{attributes(None) if tag != 'article' or rng.random() < 0.5 else ''}>{''.join(body)}" + (around("comments") if rng.random() < 0.2 else "") + f"</{tag}>"
    before = [around(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.55]
    after = [around(k) for k in ("share", "aside", "comments", "form", "ad") if rng.random() < 0.35]
    if rng.random() < 0.4:
        main = f"<div data-main{attributes(None)}>{around('aside') if rng.random() < 0.4 else ''}{main}{''.join(after)}</div>"
        after = []
    return f"<html><body data-main>{''.join(before)}{main}{''.join(after)}{around('footer') if rng.random() < 0.8 else ''}</body></html>"


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page made by ``layouts``; the mark itself isn't seen by the features."""
    marked = re.sub(r"<(\w+) data-main((?:\s[^>]*)?)>", r'<\1 itemprop="zzmain"\2>', page)
    nodes, _ = read(marked)
    y = np.array(["zzmain" in x.words or i == 0 or x.tag in ("html",) for i, x in enumerate(nodes)], float)
    for x in nodes:
        x.words -= {"zzmain"}
    return features(nodes), y


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> boosting.Trees:
    """Fit the node scores on layouts of the texts of a bounded sample of ``pages`` (page_id, html)."""
    rows = pages.where("html is not null").select(F.xxhash64("page_id", F.lit(3)).alias("h"), "page_id", "html").orderBy("h", "page_id").limit(sample_pages).collect()
    rng = random.Random(5)
    goods, others, own = [], [], []
    for r in rows:
        nodes, runs = read(r.html)
        inside = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes):
            inside[i] = x.tag in ("article", "main") or x.parent >= 0 and inside[x.parent] and x.tag not in ("nav", "aside", "form", "footer", "header")
        if inside.any():
            good = [t for i, t in runs if inside[i]]
            y = inside.astype(float)
            for i in range(len(nodes) - 1, 0, -1):
                y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
            own.append((features(nodes), y))
        else:
            good = [t for i, t in runs if len(t) > 80 and nodes[i].linked < 0.3 * nodes[i].own]
        goods.append([t for t in good if len(t) < 4000][:40])
        others += [t for i, t in runs if not inside[i]][:20]
    flat = [t for g in goods for t in g]
    short = lambda g: g[:rng.randint(1, 3)] if rng.random() < 0.4 else g
    made = [_labelled(layouts(rng, short(g), others, flat)) for g in goods if g for _ in range(4)] + 2 * own
    if not made:
        return boosting.fit(np.zeros((0, features([Node("root", -1, 0)]).shape[1])), np.zeros(0))
    return boosting.fit(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))


def extract(pages: DataFrame, model: boosting.Trees) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``: the kept runs of text in page order, one to a line.

    Character references are decoded and white space within a run is one space. A null or empty page has an empty text;
    rows that repeat give equal rows; a null id or url is kept; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html", STEP):
            read_pages = [read(h or "") for h in b.column("html").to_pylist()]
            odds = shared.value.log_odds(np.concatenate([features(n) for n, _ in read_pages]))
            texts, at = [], 0
            for nodes, runs in read_pages:
                kept = decode(nodes, odds[at:at + len(nodes)])
                at += len(nodes)
                texts.append("\n".join(t for i, t in runs if kept[i]))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return by_batch(rows, run, "page_id long, url string, text string, n_chars long")


