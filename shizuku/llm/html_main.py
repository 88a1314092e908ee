"""Main text of web pages by a maximum-scoring subsequence over words and tags.

A page is read as a sequence of tokens, words and tags. Words score by what they stand in: each element around them has features
(its name, the words of its class, id and role), and each feature a weight, fitted on labelled pages (html_pages.LABELLED) to
the odds that a text in it belongs to the main text. Tags score negative, the more the less their surroundings look
like main text. One linear scan finds the contiguous region with the highest sum. Blocks of the region whose own surroundings score
negative, adverts within a text for instance, are left out; the others are joined by an empty line.

What wraps the page is no part of its frame, whatever its name: an element that holds most of the words and the article or main
element (all, if there are several, and all headings), or nearly all words and all headings, takes nothing off what it holds. Lists of links within a text cost the region
around them a bounded sum, however long they are, so they stay between texts and still end a region at the page's edge.

A name of several parts, as in `related-work`, has the mean weight of its parts, so that the article's own parts aren't taken for
the page's frame because of one word. The page is scanned once from left to right, in time linear in its length whatever its markup.

Defined cases: a null or empty page gives ''; a page without words gives ''; elements that are never closed end with the page, a
tag or comment that is never closed is the end of the page, but one with a quote that is never closed ends at its next `>`;
repeated rows give repeated results; further columns of the input are kept by `extract_column`'s caller.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shizuku.llm.html_pages import LABELLED

# Elements of the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
UNSEEN = {"template", "svg", "object", "canvas", "head", "select", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that end an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Bound of a feature's weight and of a word's score; what one part outside of the main text takes away from a region around it, at most.
CLIP, PART = 4.0, 6.0
#: What the links of one parent take away from a region around them, at most: more than a line of a page's frame brings, less than a paragraph.
LINKS = 15.0
#: What a link takes off a word's score; score of texts in elements that are never seen.
LINK, NEVER, RIDGE = 1.5, -8.0, 0.3

#: Ends of raw elements, whose names are ASCII in either case; no other letter has them as its lower case.
RAW_ENDS = {x: re.compile(f"</{x}", re.I | re.A) for x in RAW}
NAME = re.compile(r"[^\s/>]*")
SPACES = re.compile(r"[\s/]*")
KEY = re.compile(r"[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
VALUE = re.compile(r"[^\s>]*")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Tags and texts of a page, from left to right. Each place is read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """Place of `what` from `at` on, or -1; what isn't found once isn't looked for again."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes of a tag from `at` on and the place after its `>`; -1 if it has none."""
        page, found, start = self.page, {}, at
        while True:
            at = SPACES.match(page, at).end()
            if at >= len(page):
                return found, -1
            if page[at] == ">":
                return found, at + 1
            key = KEY.match(page, at + 1).end()  # a name may start with any sign
            name = page[at:key].lower()
            equals = EQUALS.match(page, key)
            at, value = key, ""
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", start)
                        return found, end + 1 if end >= 0 else -1
                    value, at = page[at + 1 : end], end + 1
                else:
                    end = VALUE.match(page, at).end()
                    value, at = page[at:end], end
            found.setdefault(name, value)

    def parts(self):
        """('text', text, None), ('open', name, attributes) and ('close', name, None)."""
        page, at = self.page, 0
        while at < len(page):
            lt = self.find("<", at)
            if lt < 0:
                yield "text", page[at:], None
                return
            if lt > at:
                yield "text", page[at:lt], None
            sign = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = self.find("-->", lt + 2)
                at = end + 3 if end >= 0 else len(page)
            elif sign and sign in "!?" or sign == "/" and not page[lt + 2 : lt + 3].isalpha():
                end = self.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            elif sign == "/":
                name = NAME.match(page, lt + 2)
                end = self.find(">", name.end())
                at = end + 1 if end >= 0 else len(page)
                if end >= 0:
                    yield "close", name[0].lower(), None
            elif sign.isascii() and sign.isalpha():
                name = NAME.match(page, lt + 1)
                tag = name[0].lower()
                found, at = self.attributes(name.end())
                if at < 0:
                    return
                yield "open", tag, found
                if tag in RAW:
                    end = RAW_ENDS[tag].search(page, at)
                    if not end:
                        return
                    at = end.start()
            else:
                yield "text", "<", None
                at = lt + 1


def features(tag: str, found: dict[str, str], in_main: bool) -> list[tuple[str, ...]]:
    """The features of an element, each of one or more names whose mean weight it has."""
    if tag in ("html", "body"):
        return []
    out: list[tuple[str, ...]] = []
    if tag not in INLINE:
        out.append((f"<main {tag}>" if in_main and tag in ("header", "footer") else f"<{tag}>",))
    for key in ("class", "id"):
        for name in found.get(key, "").split():
            words = tuple(x.lower() for x in WORDS.findall(name))
            if words:
                out.append(words)
    if "role" in found:
        out.append((f"role {found['role'].lower()}",))
    return out


def unseen(tag: str, found: dict[str, str]) -> bool:
    return tag in RAW or tag in UNSEEN or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDES.search(found.get("style", "")))


class Element:
    """An open element: whether it lies in an article or main element, in a link, is seen; where the paragraph is that a new block would end; and what it holds: words, those in links, outermost article or main elements, headings that aren't of the page's frame."""

    __slots__ = ("tag", "parent", "features", "main", "link", "seen", "p", "score", "part", "framed", "words", "linked", "mains", "heads", "listing", "own")

    def __init__(self, tag: str, parent: Element | None, found: dict[str, str], at: int):
        self.tag, self.parent = tag, parent
        self.features = features(tag, found, parent.main) if parent else []
        self.main = parent is not None and (parent.main or tag in ("article", "main"))
        self.link = parent is not None and (parent.link or tag == "a")
        self.seen = parent is None or parent.seen and not unseen(tag, found)
        self.p = at if tag == "p" else parent.p if parent is not None and tag in INLINE else -1
        self.score: float | None = None
        self.part: Element | None = None
        self.framed = parent is not None and (parent.framed or tag in ("header", "nav", "aside", "footer"))
        self.words = self.linked = 0
        self.mains = int(parent is not None and not parent.main and tag in ("article", "main") and self.seen)
        self.heads = int(tag in ("h1", "h2", "h3") and self.seen and not self.framed)
        self.listing: Element | None | bool = False
        self.own: float | None = None

    def wraps(self, page: Element) -> bool:
        """Whether it stands around the page's content rather than beside it."""
        whole = self.heads == page.heads
        around = self.mains == page.mains and (page.mains == 1 or page.mains > 1 and whole) and 2 * self.words >= page.words
        return around or 5 * self.words >= 4 * page.words and whole

    def links(self) -> Element | None:
        """The element whose children of links this one lies in, or among; None if it lies in none."""
        if self.listing is False:
            chain = []
            e = self
            while e.parent is not None and e.listing is False:
                chain.append(e)
                e = e.parent
            found = e.listing if e.listing is not False else None
            for x in reversed(chain):
                if found is None and x.tag not in INLINE and x.words and 2 * x.linked >= x.words:
                    found = x.parent
                x.listing = found
            if self.listing is False:
                self.listing = None
        return self.listing


def tokens(page: str, made: list[Element] | None = None):
    """('tag', name, element around it, block) and ('text', text, element around it, block) from left to right. made: gets all elements, each after its parent."""
    stack, counts, block = [Element("", None, {}, 0)], Counter(), 0
    if made is not None:
        made.append(stack[0])

    def pop(upto: int) -> None:
        for x in stack[upto:]:
            counts[x.tag] -= 1
        del stack[upto:]

    for kind, value, found in Page(page).parts():
        if kind == "text":
            yield "text", value, stack[-1], block
            continue
        if value not in INLINE:
            block += 1
        if kind == "close":
            if counts[value]:
                at = len(stack) - 1
                while stack[at].tag != value and (value not in INLINE or stack[at].tag in INLINE):
                    at -= 1
                if stack[at].tag == value:  # an inline element doesn't end the blocks within it
                    pop(at)
            yield "tag", value, stack[-1], block
            continue
        if value in CLOSES_P and stack[-1].p > 0:
            pop(stack[-1].p)
        while stack[-1].tag in SIBLINGS.get(value, ()):
            pop(len(stack) - 1)
        yield "tag", value, stack[-1], block
        if value == "br":
            yield "text", " ", stack[-1], block  # words on both of its sides stay apart
        if value not in VOID:
            stack.append(Element(value, stack[-1], found, len(stack)))
            counts[value] += 1
            if made is not None:
                made.append(stack[-1])


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Weights of features by logistic regression on the texts of the labelled pages, and log odds of tags to lie within the main part.

    '(inside)' and '(outside)' are of a page's article or main element, '(page)' is for pages without one. Weights fitted together
    don't count twice what features that go together tell.
    """
    rows, labels, tags_in, tags_out = [], [], Counter(), Counter()
    for page, wanted in LABELLED:
        got = list(tokens(page))
        has = any(e.main for _, _, e, _ in got)
        good = [kind == "text" and SPACE.sub(" ", value).strip() in wanted for kind, value, _, _ in got]
        span = [i for i, x in enumerate(good) if x]
        for i, (kind, value, e, _) in enumerate(got):
            if kind == "tag":
                (tags_in if span[0] < i < span[-1] else tags_out)[f"<{value}>"] += 1
            elif value.strip() and e.seen:
                row = Counter({"(inside)" if e.main else "(outside)" if has else "(page)": 1.0})
                while e is not None:
                    for names in e.features:
                        for x in names:
                            row[x] += 1 / len(names)
                    e = e.parent
                rows.append(row)
                labels.append(good[i])
    names = sorted({x for row in rows for x in row})
    at = {x: i for i, x in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array(labels, float)
    for i, row in enumerate(rows):
        for name, value in row.items():
            x[i, at[name]] = value
    fitted = np.zeros(len(names))
    for _ in range(12):  # Newton's steps, with a ridge of RIDGE
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(names))
        fitted -= np.linalg.solve(bend, x.T @ (p - y) + RIDGE * fitted)
    out = dict(zip(names, np.clip(fitted, -CLIP, CLIP).tolist(), strict=True))
    a, b = sum(tags_in.values()), sum(tags_out.values())
    odds = lambda n, k: math.log((n + 0.5) / (a + 1)) - math.log((k + 0.5) / (b + 1))
    return out | {f"tag {x}": min(-0.05, max(-2.0, odds(tags_in[x], tags_out[x]))) for x in {*tags_in, *tags_out}}


def mean_weight(names: tuple[str, ...]) -> float:
    """Mean weight of the parts of a name; where one part clearly stands outside of the main text, others don't count in favour."""
    found = [weights().get(x, 0.0) for x in names]
    return sum(min(x, 0.0) if min(found) < -CLIP / 2 else x for x in found) / len(found)


def own_score(x: Element, page: Element) -> float:
    """What an element by itself adds to the score of its words."""
    if x.own is None:
        x.own = sum(mean_weight(names) for names in x.features)
        if x.own < 0 and x.wraps(page):
            x.own = 0.0
    return x.own


def with_main(made: list[Element]) -> bool:
    """Whether a page has an article or main element that isn't in a part of its frame, as those of comments are."""
    page, framed = made[0], set()
    for x in made[1:] if page.mains else ():
        if id(x.parent) in framed or own_score(x, page) < -CLIP / 2:
            framed.add(id(x))
        elif x.words and x.main:
            return True
    return False


def scored(e: Element, has_main: bool, page: Element) -> float:
    """The score of a word in an element of a page; sets `part`, the outermost element around that by itself isn't of the main text."""
    w, open_ = weights(), []
    while e.score is None and e.parent is not None:
        open_.append(e)
        e = e.parent
    if e.score is None:
        e.score = 0.0
    prior = lambda x: w["(page)"] if not has_main else w["(inside)"] if x.main else w["(outside)"]
    for x in reversed(open_):
        own = own_score(x, page)
        # What is clearly no main text stays so whatever it stands in.
        x.score = max(-2 * CLIP, min(CLIP, (min(e.score, 0.0) if own < -CLIP / 2 - 0.5 else e.score) + own)) if x.seen else NEVER
        x.part = e.part
        if x.part is None and (not x.seen or prior(x) + x.score < 0 and own < -CLIP / 2 + 0.5):
            x.part = x
        e = x
    return prior(e) + e.score if e.seen else NEVER


def regions(page: str) -> tuple[list[tuple[int, str]], float]:
    """The (block, text) parts of the best region, and its score."""
    w, parts, made = weights(), [], []
    got = [(kind, html_lib.unescape(value) if kind == "text" else value, e, block) for kind, value, e, block in tokens(page, made)]
    sizes = [len(value.split()) if kind == "text" else 0 for kind, value, _, _ in got]
    for (_, _, e, _), n in zip(got, sizes, strict=True):
        if n and e.seen:
            e.words += n
            e.linked += n * e.link
    for e in reversed(made[1:]):
        up = e.parent
        up.words, up.linked, up.mains, up.heads = up.words + e.words, up.linked + e.linked, up.mains + e.mains, up.heads + e.heads
    has_main = with_main(made)
    changes, groups, run = [], [], 0
    for (kind, value, e, block), n in zip(got, sizes, strict=True):
        s = scored(e, has_main, made[0])
        if kind == "tag":
            change = 0.0 if e.part is not None else w.get(f"tag <{value}>", -0.5) * math.exp(-max(s, 0.0))
        else:
            change = n * (s - LINK if e.link and s > NEVER else s)
            parts.append((block, value, s >= 0 or not has_main and e.part is None))
        among = e.links() if e.part is None and e.seen else None
        run += among is None and n > 0
        changes.append(change)
        groups.append((id(among), run) if among is not None and change < 0 else None)
    # What the links of one parent, without other words between them, take away together.
    losses = Counter()
    for change, group in zip(changes, groups, strict=True):
        if group:
            losses[group] -= change
    taken: dict[int, float] = {}
    best = score = 0.0
    first, found, seen_parts = 0, (0, 0), 0
    for (kind, _, e, _), change, group in zip(got, changes, groups, strict=True):
        seen_parts += kind == "text"
        if group and losses[group] > LINKS:
            change *= LINKS / losses[group]
        if e.part is not None and change < 0:  # a part that is left out doesn't part the text around it
            left = taken.setdefault(id(e.part), PART)
            change = max(change, -left)
            taken[id(e.part)] += change
        score += change
        if score <= 0:
            score, first = 0.0, seen_parts
        elif score > best:
            best, found = score, (first, seen_parts)
    lo, hi = found
    if lo < hi:  # the blocks at both ends are taken whole
        while lo and parts[lo - 1][0] == parts[lo][0]:
            lo -= 1
        while hi < len(parts) and parts[hi][0] == parts[hi - 1][0]:
            hi += 1
    return [(b, v) for b, v, keep in parts[lo:hi] if keep], best


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks: dict[int, list[str]] = {}
    for block, text in regions(page)[0]:
        blocks.setdefault(block, []).append(text)
    lines = (SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n\n".join(x for x in lines if x)


def extract_column(page: Column) -> Column:
    """The main text of a page column; '' for null."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None).astype(object)

    return extract(page)
