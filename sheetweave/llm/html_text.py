"""Main text of web pages: boosted trees over DOM nodes, then hierarchical decoding.

Each element gets features of itself, of its subtree (text, link and tag density), of its
ancestors, of its siblings and of its attribute words. Trees give the log-odds that it
belongs to the article. Decoding keeps a set of elements in which each kept element has
kept ancestors, with the largest sum of log-odds; a dropped element drops its subtree, so no
choice contradicts another. Texts of kept elements are joined block by block.

Training: a bounded sample of the pages, labelled where their own markup is plain (inside
article or main; inside nav, header, footer, aside, form, dialog), and pages laid out by
rule (``layout``) with words of the sampled pages, which show other markup for the same
parts. Pages of the sample and layouts together are a documented, fixed number.

Defined results: null and empty pages, and pages without article text, give an empty
string. Repeated rows give equal results; null ids and urls are passed on. Other columns are
not read. A ``br`` ends a block.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm import boosting
from sheetweave.llm.dom import BLOCK, Tree, blocks, parse
from sheetweave.llm.texts import map_rows

#: Expected pages of the training sample, and pages laid out by rule.
SAMPLE_PAGES, LAYOUTS = 150, 250
#: Attribute words that are features of their own, the most frequent ones of the training pages.
TOKENS = 48

TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "a", "div", "section", "article", "main", "nav", "header", "footer",
        "aside", "form", "button", "label", "table", "td", "figure", "figcaption", "blockquote", "pre", "span",
        "dialog", "b", "small", "time")
TAG_AT = {tag: k for k, tag in enumerate(TAGS)}
INSIDE = ("article", "main", "nav", "header", "footer", "aside", "form", "dialog", "blockquote", "table", "a")
INSIDE_AT = {tag: k for k, tag in enumerate(INSIDE)}
#: Words of the rule-made layouts: names of parts as web pages use them; fixed values.
CONTENT_NAMES = "content article post entry main story body text article-body post-content entry-content page".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb topnav", "header": "header masthead site-header banner top",
    "footer": "footer site-footer copyright bottom legal", "aside": "sidebar aside related widget rail recommended",
    "ad": "ad ads advert advertisement sponsor promo banner-ad", "form": "newsletter subscribe search login signup form",
    "notice": "cookie consent notice alert banner gdpr popup modal", "share": "share social buttons tools",
    "comments": "comments comment discussion replies reply respond disqus comment-list"}


class Features:
    """Numbers for all elements of a page; the words that count are learned."""

    def __init__(self, tokens: list[str]):
        self.at = {t: k for k, t in enumerate(tokens)}
        self.width = 14 + len(TAGS) + len(INSIDE) + 2 * len(tokens)

    def of(self, tree: Tree) -> np.ndarray:
        n = len(tree.tags)
        x = np.zeros((n, self.width), np.float32)
        text, links, below, depth = list(tree.own), [0] * n, [0] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(n - 1, 0, -1):
            u = tree.parents[v]
            if tree.tags[v] == "a":
                links[v] = text[v]
            text[u] += text[v]
            links[u] += links[v]
            below[u] += below[v] + 1
        for v in range(1, n):
            depth[v] = depth[tree.parents[v]] + 1
            children[tree.parents[v]].append(v)
        a, b, c = 14, 14 + len(TAGS), 14 + len(TAGS) + len(INSIDE)
        d = c + len(self.at)
        whole = max(text[0], 1)
        for v in range(1, n):
            u, row = tree.parents[v], x[v]
            if u:
                row[b:c] = x[u, b:c]
                row[d:] = np.maximum(x[u, d:], x[u, c:d])
            tag = tree.tags[v]
            if tag in TAG_AT:
                row[a + TAG_AT[tag]] = 1
            if tag in INSIDE_AT:
                row[b + INSIDE_AT[tag]] = 1
            for token in tree.tokens[v]:
                if token in self.at:
                    row[c + self.at[token]] = 1
            row[:4] = depth[v], math.log1p(text[v]), links[v] / (text[v] + 1), below[v] / (text[v] + 1)
            row[4:8] = text[v] / whole, math.log1p(tree.own[v]), v / n, tag in BLOCK
        for u in range(n):
            own = children[u]
            if own:
                mean = sum(text[v] for v in own) / len(own)
                alike: dict[str, int] = {}
                for v in own:
                    alike[tree.tags[v]] = alike.get(tree.tags[v], 0) + 1
                for k, v in enumerate(own):
                    x[v, 8:14] = (len(own), k / len(own), alike[tree.tags[v]], text[v] / (mean + 1),
                                  math.log1p(text[u]), links[u] / (text[u] + 1))
        return x


@dataclass
class Extractor:
    tokens: list[str]
    trees: boosting.Boosted

    def texts(self, pages: list[str]) -> list[str]:
        """Main texts of some pages; the trees look at all their elements at once."""
        features = Features(self.tokens)
        parsed = [parse(page) for page in pages]
        if not parsed:
            return []
        logits = self.trees.logits(np.concatenate([features.of(tree) for tree in parsed]))
        out, at = [], 0
        for tree in parsed:
            n = len(tree.tags)
            out.append("\n".join(blocks(tree, decode(tree.parents, logits[at:at + n].tolist()))))
            at += n
        return out


def decode(parents: list[int], logits: list[float]) -> list[bool]:
    """The best set of elements that holds the parents of all its elements. The root is neutral."""
    gain = [0.0, *logits[1:]]
    for v in range(len(parents) - 1, 0, -1):
        if gain[v] > 0:
            gain[parents[v]] += gain[v]
    kept = [True] + [False] * (len(parents) - 1)
    for v in range(1, len(parents)):
        kept[v] = gain[v] > 0 and kept[parents[v]]
    return kept


def marked(tree: Tree) -> list[int | None]:
    """Labels from plain markup: 1 in article or main, 0 in parts around it, else none."""
    labels: list[int | None] = [None]
    for v in range(1, len(tree.tags)):
        tag, label = tree.tags[v], labels[tree.parents[v]]
        if tag in ("nav", "header", "footer", "aside", "form", "dialog"):
            label = 0
        elif tag in ("article", "main") and label is None:
            label = 1
        elif {"ad", "ads", "advert"} & set(tree.tokens[v]):
            label = 0
        labels.append(label)
    return labels


def layout(chance: random.Random, words: list[str]) -> str:
    """A page laid out by rule. Elements carry data-y with their label."""

    def say(low: int, high: int) -> str:
        return " ".join(chance.choice(words) for _ in range(chance.randint(low, high))).capitalize() + "."

    def named(kind: str) -> str:
        name = chance.choice(OTHER_NAMES[kind].split())
        return f' {chance.choice(("class", "id"))}="{chance.choice(("", "", "js-", "l-"))}{name}"'

    def part(tag: str, kind: str, inner: str) -> str:
        plain = tag != "div" and chance.random() < 0.4
        return f'<{tag}{"" if plain else named(kind)} data-y="0">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{say(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    div = lambda tag: chance.choice((tag, "div"))
    around = {
        "nav": lambda: part(div("nav"), "nav", links(chance.randint(3, 9))),
        "header": lambda: part(div("header"), "header", f"<h1>{say(1, 4)}</h1>" + (links(4) if chance.random() < .5 else f"<p>{say(3, 9)}</p>")),
        "footer": lambda: part(div("footer"), "footer", f"<p>{say(4, 14)}</p>" + (links(5) if chance.random() < .5 else "")),
        "aside": lambda: part(div("aside"), "aside", f"<h3>{say(1, 3)}</h3>" + (links(5) if chance.random() < .6 else f"<p>{say(8, 40)}</p>")),
        "ad": lambda: part("div", "ad", say(3, 15) if chance.random() < .5 else f'<p>{say(3, 25)}</p><a href="#">{say(1, 3)}</a>'),
        "form": lambda: part(div("form"), "form", f"<label>{say(2, 6)}</label><input><button>{say(1, 2)}</button>"),
        "notice": lambda: part("div", "notice", f"<p>{say(6, 25)}</p><button>{say(1, 2)}</button>"),
        "share": lambda: part("div", "share", links(3)),
        "comments": lambda: part(chance.choice(("section", "div", "ol")), "comments", f"<h3>{say(1, 3)}</h3>" + "".join(
            f'<div class="{chance.choice(("comment", "reply", "comment-body"))}"><b>{say(1, 2)}</b><p>{say(5, 60)}</p></div>'
            for _ in range(chance.randint(1, 6)))),
    }

    def block() -> str:
        kind = chance.random()
        if kind < 0.7:
            text = say(1, 90)
            return f"<p>{text}</p>" if chance.random() < .8 else f'<p>{say(2, 9)} <a href="#">{say(1, 3)}</a> <b>{say(1, 4)}</b> {text}</p>'
        if kind < 0.8:
            return f"<h2>{say(2, 8)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(chance.randint(2, 6))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote><p>{say(6, 40)}</p></blockquote>"
        return f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 9)}</td></tr></table>"

    body = [block() for _ in range(chance.choice((1, 2, 3, 6, 12, 25)))]
    for kind in chance.sample(["ad", "share", "aside", "form"], chance.randint(0, 2)):
        body.insert(chance.randint(0, len(body)), around[kind]())
    title = f"<h1>{say(2, 9)}</h1>" if chance.random() < .8 else ""
    tag = chance.choice(("article", "article", "main", "div", "section"))
    name = "" if tag in ("article", "main") and chance.random() < .6 else (
        f' {chance.choice(("class", "id"))}="{chance.choice(CONTENT_NAMES)}"')
    article = f'<{tag}{name} data-y="1">{title}{"".join(body)}</{tag}>'
    for _ in range(chance.randint(0, 2)):
        article = f'<div class="{chance.choice(("wrap", "container", "row", "layout", "col"))}" data-y="1">{article}</div>'
    before = [around[k]() for k in ("notice", "header", "nav", "ad", "aside") if chance.random() < .45]
    after = [around[k]() for k in ("comments", "aside", "ad", "share", "form", "footer", "notice") if chance.random() < .45]
    return "<html><body>" + "".join(before) + article + "".join(after) + "</body></html>"


def laid_out(page: str) -> tuple[Tree, list[int | None]]:
    """Labels of a layout: data-y of the element or of the nearest element above it."""
    tree = parse(page)
    marks = [int(m) if m in ("0", "1") else None for m in _marks(page)]
    labels: list[int | None] = [None]
    for v in range(1, len(tree.tags)):
        above = labels[tree.parents[v]]
        own = marks[v - 1]
        labels.append(0 if above == 0 else own if own is not None else above)
    return tree, labels


def _marks(page: str) -> list[str]:
    """data-y of each element of a layout, in order; void elements have none in the tree."""
    return [m[1] or "" for m in re.finditer(r"<(?!/|html|body|input)[a-z][^>]*?(?: data-y=\"(\d)\")?>", page)]


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Extractor:
    """Fits on about ``sample_pages`` pages, those whose hashed id falls below a share of all
    hashes, and on layouts."""
    share = min(1.0, sample_pages / max(1, pages.select("page_id").count()))
    drawn = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) <= int(share * (1 << 30))
    rows = pages.where(drawn & F.col("html").isNotNull()).select("page_id", F.col("html").alias("h")).collect()
    chance = random.Random(11)
    trees, labels, words = [], [], []
    for row in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["h"])):
        tree = parse(row["h"])
        trees.append(tree)
        labels.append(marked(tree))
        words += [w for node, t in tree.events if t for w in t.split()[:20]][:60]
    for _ in range(layouts):
        tree, own = laid_out(layout(chance, words or ["word", "text"]))
        trees.append(tree)
        labels.append(own)
    seen: dict[str, int] = {}
    for tree in trees:
        for tokens in tree.tokens:
            for token in set(tokens):
                seen[token] = seen.get(token, 0) + 1
    tokens = sorted(seen, key=lambda t: (-seen[t], t))[:TOKENS]
    features = Features(tokens)
    x = np.concatenate([features.of(tree) for tree in trees])
    y = [label for own in labels for label in own]
    known = np.array([label is not None for label in y])
    return Extractor(tokens, boosting.fit(x[known], np.array([v for v in y if v is not None], float)))


def extract(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """page_id, url, text for each row."""
    known = pages.sparkSession.sparkContext.broadcast(extractor)

    def work(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[2])
            if len(held) == 64 or size > 1 << 20:
                yield from done(held)
                held, size = [], 0
        yield from done(held)

    def done(held):
        for (page_id, url, _), text in zip(held, known.value.texts([h for _, _, h in held])):
            yield page_id, url, text

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                 F.coalesce("html", F.lit("")).alias("h")), work,
                    "page_id long, url string, text string")


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract(pages, train(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
