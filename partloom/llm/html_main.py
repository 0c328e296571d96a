"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a row of tokens: words, and tags by name. Words score above zero and tags below, by weights learned from
labelled pages (those that mark their article with an <article> element): the log of how much likelier a token of that
kind is inside an article than outside. One pass over the running sums finds the contiguous region of the highest score.
If that region lies in an article or main element, it is taken to that element's ends.

Words inside elements that never hold main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers) score nothing and are left out of the region's text. Such an element shows by its name, or it
is a container whose every class (or, without one, its id or role) names such a thing; one that has further classes is
left out if most of its words are links. Time grows in proportion to a page's length, however it is nested.

Defined results: a null html is empty; a page without words has an empty text; tags cut off at the end of the page are
dropped; pages of any length are read whole; repeated rows each get a row; equal scores go to the earliest, shortest
region; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many labelled pages at most are learned from, chosen by a hash of the whole table's rows.
MOST_LEARNED = 5_000
# Element names of the HTML standard.
RAW = frozenset("script style template noscript iframe svg textarea select head title".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|comment-list|respond|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|alert|popup|promos?|promotion|related|replies|share|sharing|side-?bar|skip|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
# A quote opens only right after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
_CONTAINERS = frozenset("div section ul ol dl span ins table center details p".split())
_ITEMS = frozenset("li dd dt td th tr option".split())
_LISTS = ("ul", "ol", "dl", "table", "select")
Token = tuple[str, str, bool, int]  # kind ("" for text, else the tag's name with / if it ends), text, aside, article's number


def _role(name: str, attributes: str) -> str:
    """ "aside" if the element holds no main text, "unsure" if only some of its classes say so, else empty."""
    if name in ASIDE:
        return "aside"
    if not attributes or name not in _CONTAINERS:
        return ""
    named = {k.lower(): v.strip("\"'").split() for k, v in reversed(_NAMED.findall(attributes))}
    words = named.get("class") or [*named.get("id", ()), *named.get("role", ())]
    said = [bool(_ROLE.search(w)) for w in words]
    return "aside" if said and all(said) else "unsure" if any(said) else ""


class _Open:
    """The open elements, with the places of each name among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool, int, int, int]] = []  # name, role, article, first token, words and words in links before
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of p and of what ends a p

    def push(self, entry: tuple[str, str, bool, int, int, int]) -> None:
        self.at.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] in _CLOSES_P:
            self.blocks.append(len(self.stack))
        self.stack.append(entry)

    def pop(self) -> tuple[str, str, bool, int, int, int]:
        entry = self.stack.pop()
        self.at[entry[0]].pop()
        if entry[0] in _CLOSES_P:
            self.blocks.pop()
        return entry

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else -1


def tokens(page: str | None) -> list[Token]:
    """The page's tags and texts in order. aside: within an element that holds no main text; the last field numbers the
    outermost article or main element around the token, 0 outside of any."""
    page, at = page or "", 0
    out: list[tuple[str, str, int]] = []  # kind, text, article's number
    opened = _Open()
    edges: Counter = Counter()  # at a token's place, elements set aside that begin less those that end before it
    aside = article = number = words = linked = in_link = 0

    def add_text(text: str) -> None:
        nonlocal words, linked
        n = len(text.split())
        words += n
        linked += n * (in_link > 0)
        out.append(("", text, number if article else 0))

    def close_to(depth: int) -> None:
        nonlocal aside, article, in_link
        while len(opened.stack) > depth:
            name, role, was_article, first, words_before, linked_before = opened.pop()
            aside -= role == "aside"
            article -= was_article
            in_link -= name == "a"
            if role == "aside" or (role == "unsure" and 2 * (linked - linked_before) > words - words_before):
                edges[first] += 1
                edges[len(out)] -= 1

    skip_to = -1
    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = opened.last(name)
            out.append(("/" + name, "", number if article else 0))
            if depth >= 0:
                close_to(depth)
            continue
        if name in _CLOSES_P:
            # A paragraph ends where a block begins; what was open in it ends too.
            if opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                close_to(opened.blocks[-1])
        elif name in _ITEMS:
            depth = opened.last(name)
            if depth > max(map(opened.last, _LISTS)):
                close_to(depth)
        is_article = name in ("article", "main") and not aside
        number += is_article and not article
        role = _role(name, m[3])
        first = len(out)
        out.append((name, "", number if article or is_article else 0))
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):  # no markup counts inside
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = skip_to = end.end() if end else len(page)
            out.append(("/" + name, "", 0))
            edges[first] += 1
            edges[len(out)] -= 1
            continue
        opened.push((name, role, is_article, first, words, linked))
        aside += role == "aside"
        article += is_article
        in_link += name == "a"
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        add_text(rest if cut < 0 or not re.match(r"<[/a-zA-Z!?]", rest[cut:]) else rest[:cut])
    close_to(0)
    depth, done = 0, []
    for i, (kind, text, of) in enumerate(out):
        depth += edges.get(i, 0)
        done.append((kind, text, depth > 0, of))
    return done


def count_kinds(pages: Iterable[str | None]) -> Counter:
    """(kind, inside an article) of each word and tag of the pages that mark an article."""
    found: Counter = Counter()
    for page in pages:
        if "<article" not in (page or "").lower():
            continue
        for kind, text, aside, number in tokens(page):
            if kind:
                found[kind, number > 0 and not aside] += 1
            else:
                found["", number > 0 and not aside] += len(text.split())
    return found


def weights_from(found: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Words above zero, every tag below: the log odds of a kind inside an article against outside, kept on its side.
    What was not seen scores like the mean of the tags."""
    inside, outside = (1 + sum(n for (_, i), n in found.items() if i is side) for side in (True, False))
    odds = {k: math.log((found.get((k, True), 0) + 1) / inside) - math.log((found.get((k, False), 0) + 1) / outside) for k in {k for k, _ in found}}
    out = {k: max(-8.0, min(-0.05, v)) for k, v in odds.items() if k}
    return {"other": sum(out.values()) / len(out) if out else -1.0} | out | {"": max(0.05, odds.get("", 1.0))}


def learn(pages: DataFrame, most: int = MOST_LEARNED) -> dict[str, float]:
    """Weights from at most about `most` pages. Only counts of kinds come to the driver: two for each name of a tag."""
    share = min(1.0, most / max(1, pages.count()))
    rows = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found += count_kinds(batch.column(0).to_pylist())
        # Made-up names of tags don't count, so that the table stays small.
        known = {k: n for k, n in found.items() if k[0].lstrip("/") in BLOCK | VOID | RAW | {"", "a", "b", "i", "u", "s", "em", "strong", "span", "small", "sub", "sup", "code", "q", "cite", "label", "time", "mark", "img", "figure", "picture"}}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in known], pa.string()), pa.array([i for _, i in known], pa.bool_()), pa.array(list(known.values()), pa.int64())], names=["kind", "inside", "n"])

    total = rows.select("html").mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in total.collect()})


def region(found: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """First and last+1 of the tokens with the highest sum."""
    score = np.zeros(len(found) + 1)
    other = weights["other"]
    for i, (kind, text, aside, _) in enumerate(found):
        score[i + 1] = weights.get(kind, other) if kind else 0.0 if aside else weights[""] * len(text.split())
    sums = np.cumsum(score)
    gain = sums - np.minimum.accumulate(sums)
    last = int(gain.argmax())
    first = int(sums[: last + 1].argmin())
    return first, last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens(page)
    first, last = region(found, weights)
    if first == last:
        return ""
    # The article that holds most of the region's words, if any does.
    share: Counter = Counter()
    for kind, text, aside, number in found[first:last]:
        if not kind and not aside:
            share[number] += len(text.split())
    number = max(share, key=lambda n: (share[n], -n)) if share else 0
    if number:
        inside = [i for i, t in enumerate(found) if t[3] == number]
        first, last = inside[0], inside[-1] + 1
    else:
        # Without one, the region takes the rest of the blocks that it begins and ends in.
        while first > 0 and found[first - 1][0].lstrip("/") not in BLOCK:
            first -= 1
        while last < len(found) and found[last][0].lstrip("/") not in BLOCK:
            last += 1
    blocks, now = [], []
    for kind, text, aside, at in found[first:last]:
        if kind:
            if kind.lstrip("/") in BLOCK:
                blocks.append("".join(now))
                now = []
            elif kind == "br":
                now.append(" ")
        elif not aside and (not number or at == number):
            now.append(entities.unescape(text))
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_texts(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
