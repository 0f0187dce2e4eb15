"""Main text of web pages by gradient-boosted trees over the nodes of the DOM and hierarchical decoding.

Each block-level element and each text block has features: subtree density (text, words and linked text under it, per
element), tokens of class, id and role (its own, its ancestors', its siblings'), depth, sibling statistics and place.
The trees give each node a chance of holding main text. Decoding then takes the likeliest labelling of the whole tree
in which nothing is kept below a dropped element, by one pass up (the best log-likelihood of each subtree, kept or
dropped) and one pass down; so no ancestor and descendant contradict each other. Kept text blocks are joined.

No table holds labels of nodes. The trees are fitted on labelled pages that a grammar of page layouts writes with a
fixed seed (semantic and plain markup, menus, adverts, notices, sidebars, forms, comments, footers; on a part of them
no class, id or role says what it names); the grammar and its number of pages are parameters, and the model does not
depend on the pages that it is applied to.

Defined cases: null or empty HTML gives an empty text, as does a page of which no block is kept; HTML without tags is
one text block; unclosed and misnested elements are closed as HTML does; a line break is white space inside its block;
repeated rows give repeated results; other columns do not matter. There is no bound on a page's length.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import gbt
from ledgerloom.llm.common import in_batches, runs
from ledgerloom.llm.dom import AGAINST_SETS, FOR, KIND_OF, KINDS, Page, parse

#: Pages that the grammar writes for the fit; the share of them on which no class, id or role tells anything.
TRAINING_PAGES, BARE = 600, 0.25
_SIGNS = list(AGAINST_SETS)
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@lru_cache(maxsize=4096)
def signs(tokens: str) -> tuple[int, ...]:
    """How many of a node's attribute tokens speak for main text, and for each sort of other text."""
    parts = tokens.split()
    return (sum(t in FOR for t in parts), *(sum(t in words for t in parts) for words in AGAINST_SETS.values()))


def node_features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parents = page.parents
    chars, linked, blocks, elements, upper, marks = ([0] * n for _ in range(6))
    for k in range(n):
        text = page.texts[k]
        if text:
            chars[k], linked[k], blocks[k] = len(text), page.links[k], 1
            marks[k] = text.count(",") + text.count(".")
        elements[k] = 1
    order, siblings = [0] * n, [0] * n
    depth, before = [0] * n, [0] * n
    seen = 0
    own = [signs(t) if t else None for t in page.tokens]
    zero = (0,) * (len(_SIGNS) + 1)
    above: list[tuple[int, ...]] = [zero] * n  # the attribute signs of all ancestors
    kinds = [KIND_OF.get(t, KIND_OF["div"]) for t in page.tags]
    kinds_above = [0] * n  # bits
    for k in range(n):
        p = parents[k]
        before[k] = seen
        seen += chars[k]
        if p >= 0:
            depth[k], order[k] = depth[p] + 1, siblings[p]
            siblings[p] += 1
            above[k] = above[p] if own[p] is None else tuple(min(a + b, 3) for a, b in zip(above[p], own[p], strict=True))
            kinds_above[k] = kinds_above[p] | 1 << kinds[p]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        blocks[p] += blocks[k]
        elements[p] += elements[k]
        marks[p] += marks[k]
    total = max(chars[0], 1)
    rows = []
    for k in range(n):
        p = max(parents[k], 0)
        c = chars[k]
        rows.append((
            kinds[k], kinds[p], kinds_above[k] >> 1 & 1, kinds_above[k] >> 2 & 1, kinds_above[k] >> 3 & 1, kinds_above[k] >> 4 & 1, kinds_above[k] >> 5 & 1, kinds_above[k] >> 6 & 1,
            *(own[k] or zero), *above[k],
            depth[k], order[k], siblings[p], order[k] / max(siblings[p], 1), siblings[k],
            c, c / total, linked[k] / max(c, 1), c / elements[k], c / max(blocks[k], 1), blocks[k], marks[k] / max(c, 1),
            chars[p], chars[p] / total, linked[p] / max(chars[p], 1), chars[p] / max(blocks[p], 1), c / max(chars[p], 1),
            before[k] / total, (before[k] + c) / total,
        ))
    return np.array(rows, np.float64)


def decode(page: Page, chance: np.ndarray) -> list[str]:
    """Text blocks that the likeliest consistent labelling keeps."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(chance).tolist(), np.log(1 - chance).tolist()
    parents = page.parents
    best_keep, all_drop = keep[:], drop[:]
    for k in range(len(parents) - 1, 0, -1):
        best_keep[parents[k]] += max(best_keep[k], all_drop[k])
        all_drop[parents[k]] += all_drop[k]
    kept, out = [False] * len(parents), []
    for k in range(len(parents)):
        kept[k] = k == 0 or (kept[parents[k]] and best_keep[k] > all_drop[k])
        if kept[k] and page.texts[k]:
            out.append(page.texts[k])
    return out


def written_pages(pages: int, seed: int = 7, bare: float = BARE) -> Iterator[tuple[Page, np.ndarray]]:
    """Labelled pages of many layouts: 1 for nodes that are or hold main text."""
    draw = random.Random(seed)
    pick, chance = draw.choice, draw.random

    def words(low: int, high: int) -> str:
        end = pick([".", ".", ".", "", "!"])
        return (" ".join("".join(pick("aeioubcdlmnrst") for _ in range(draw.randint(2, 9))) + ("," if chance() < 0.08 else "") for _ in range(draw.randint(low, high))) + end).capitalize()

    def text(page: Page, parent: int, low: int, high: int, linked: float = 0.0) -> None:
        s = words(low, high)
        page.add("#text", parent, "", s, int(len(s) * linked))

    def listed(page: Page, parent: int, linked: float, low: int = 1, high: int = 3) -> None:
        top = page.add(pick(["ul", "ul", "ol"]), parent, pick(["", "", "links", "menu", "list"]) if linked > 0.5 else "")
        for _ in range(draw.randint(3, 9)):
            text(page, page.add("li", top), low, high, linked)

    def other(page: Page, parent: int, sort: str) -> None:
        named = chance() < 0.75
        token = pick(sorted(AGAINST_SETS[sort])) if named else pick(["", "box", "block", "row", "c"])
        tag = {"navigation": "nav", "side": "aside", "end": "footer", "top": "header", "form": "form"}.get(sort, "div")
        if named and chance() < 0.35:
            tag = "div"
        if tag in ("nav", "aside", "footer", "header", "form") and chance() < 0.6:
            token = ""
        if not named and tag == "div" and sort in ("notice", "advert", "comments"):
            token = pick(sorted(AGAINST_SETS[sort]))
        node = page.add(tag, parent, token)
        if sort == "navigation":
            if chance() < 0.7:
                listed(page, node, 1.0)
            else:
                text(page, node, 4, 15, 0.95)
        elif sort in ("advert", "notice"):
            if chance() < 0.5:
                text(page, node, 3, 30, pick([0.0, 0.0, 0.3, 1.0]))
            else:
                for _ in range(draw.randint(1, 3)):
                    text(page, page.add("p", node), 3, 40, pick([0.0, 0.0, 0.4]))
        elif sort == "side":
            text(page, page.add(pick(["h2", "h3", "h4", "p"]), node), 1, 4)
            if chance() < 0.7:
                listed(page, node, pick([1.0, 1.0, 0.0]), 1, 7)
            else:
                for _ in range(draw.randint(1, 4)):
                    text(page, page.add(pick(["p", "div"]), node), 3, 40, pick([0.0, 0.0, 0.5]))
        elif sort == "end":
            for _ in range(draw.randint(1, 3)):
                text(page, node if chance() < 0.6 else page.add("p", node), 2, 16, pick([0.0, 0.0, 0.6]))
            if chance() < 0.3:
                listed(page, node, 1.0)
        elif sort == "top":
            text(page, page.add(pick(["h1", "h2", "p", "div"]), node), 1, 6, pick([0.0, 1.0]))
            if chance() < 0.5:
                other(page, node, "navigation")
        elif sort == "form":
            for _ in range(draw.randint(1, 4)):
                text(page, node if chance() < 0.5 else page.add(pick(["p", "div"]), node), 1, 12)
        else:
            text(page, page.add(pick(["h2", "h3", "h4"]), node), 1, 3)
            top = page.add(pick(["ol", "ul", "div"]), node, pick(["", "commentlist"]))
            for _ in range(draw.randint(1, 7)):
                one = page.add("li" if page.tags[top] != "div" else pick(["div", "article"]), top, pick(["comment", "comment", ""]))
                if chance() < 0.5:
                    text(page, page.add(pick(["p", "div"]), one), 1, 3)
                for _ in range(draw.randint(1, 2)):
                    text(page, page.add("p", one), 4, 60)

    for _ in range(pages):
        page = Page()
        good: list[int] = []
        top = page.add("#root", -1)
        if chance() < 0.8:
            top = page.add("body", page.add("html", top))
        outer = top
        for sort in ("notice", "top", "navigation", "advert"):
            if chance() < 0.55:
                other(page, top, sort)
        while chance() < 0.4:
            outer = page.add("div", outer, pick(["", "wrapper", "container", "page", "row", "main"]))
        if chance() < 0.3:
            other(page, outer, pick(["side", "navigation", "advert"]))
        if chance() < 0.5:
            main = page.add(pick(["article", "article", "main", "section", "div", "div", "td"]), outer)
        else:
            main = page.add(pick(["div", "div", "section", "article", "main"]), outer, pick(["content", "post", "article", "story", "entry content", "text", "main", "post body", "article body"]))
        if chance() < 0.2:
            main = page.add(pick(["article", "div", "section"]), main, pick(["", "body", "text", "post"]))
        head = main
        if chance() < 0.15:
            head = page.add("header", main)
        if chance() < 0.8:
            h = page.add(pick(["h1", "h1", "h2"]), head)
            text(page, h, 1, 14)
            good.append(len(page.tags) - 1)
        short = chance() < 0.25
        for _ in range(draw.randint(1, 3) if short else draw.randint(2, 14)):
            roll = chance()
            if roll < 0.78:
                text(page, page.add(pick(["p"] * 8 + ["div", "pre", "blockquote"]), main), *pick([(1, 6), (4, 30), (20, 120), (20, 200)]), pick([0.0] * 8 + [0.2, 0.5]))
                good.append(len(page.tags) - 1)
            elif roll < 0.83:
                text(page, main, 5, 60)
                good.append(len(page.tags) - 1)
            elif roll < 0.9:
                begin = len(page.tags)
                listed(page, main, pick([0.0, 0.0, 0.3]), 2, 15)
                good += [k for k in range(begin, len(page.tags)) if page.texts[k]]
            elif roll < 0.94:
                text(page, page.add(pick(["h2", "h3", "figcaption"]), main), 1, 8)
                good.append(len(page.tags) - 1)
            elif roll < 0.96:
                table = page.add("table", main)
                for _ in range(draw.randint(2, 4)):
                    row = page.add("tr", table)
                    for _ in range(3):
                        text(page, page.add("td", row), 1, 4)
                        good.append(len(page.tags) - 1)
            else:
                other(page, main, pick(["advert", "side", "form", "notice", "advert", "navigation"]))
        for sort in ("comments", "form", "side", "advert", "navigation"):
            if chance() < 0.3:
                other(page, pick([outer, top, main]), sort)
        if chance() < 0.8:
            other(page, top, "end")
        if chance() < bare:  # names that tell nothing, as on pages of another language or with generated ones
            page.tokens = ["".join(pick("bcfghkqvwxyz") for _ in range(draw.randint(1, 6))) if chance() < 0.5 else "" for _ in page.tokens]
        label = np.zeros(len(page.tags))
        for k in good:
            while k >= 0:
                label[k], k = 1.0, page.parents[k]
        yield page, label


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> gbt.Trees:
    made = [(node_features(page), label) for page, label in written_pages(pages)]
    return gbt.fit(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]), rounds=60, depth=5)


def main_texts(htmls: list[str | None], model: gbt.Trees) -> list[str]:
    pages = [parse(h) if h else None for h in htmls]
    features = [node_features(p) for p in pages if p]
    chances = gbt.predict(model, np.concatenate(features)) if features else np.zeros(0)
    out, at = [], 0
    for page in pages:
        n = len(page.tags) if page else 0
        out.append("\n".join(decode(page, chances[at : at + n])) if page else "")
        at += n
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text and its number of code points."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(2)):
                texts = main_texts(batch.column(2).slice(a, b - a).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)

    picked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_batches(picked).mapInArrow(work, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT").withColumnsRenamed({"page_id": id_col, "url": url_col})
