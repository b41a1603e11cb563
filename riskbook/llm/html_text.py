"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded from the root down.

A page becomes a tree of its block elements; a run of text that stands directly in the body is a node of its own. Each node
has features: what kind of element it and its parent are, the tokens of its attributes, what it is by name, its depth, its place
among its siblings, the density of text, links, marks and of words that notices are made of in its subtree.

The trees are trained on a bounded sample of whole pages (`most`, by default 300, of smallest hash of page_id; of each at most
`nodes` evenly spaced nodes). Labels are distant: an element that says by its name or attributes what it is labels its
blocks. A sample may know few ways to write a page, so each sampled page is also written anew in several: its main text and
its other text in other elements, wrapped and with notices, comments and sidebars, named, named misleadingly, or not named at all.

A name is a word of a class or id; one that says what a page lacks or has (no-sidebar, comments-open, category-legal) names
nothing. What holds the page's main element (of those named as main text the one with most text, not itself named otherwise),
or without one most of the page's text, is not something else, whatever it is called. For a page, each node's probability is
taken from the trees alone, and the most probable consistent choice is found by dynamic programming: what stands inside a
rejected node is rejected, and a kept node may hold rejected ones (an advert in an article).

Pages are read in time linear in their length, whatever their markup.

Defined results. Null or empty html, or a page without text: an empty text. Malformed html: unclosed elements end where
their parent ends, a paragraph ends where another block begins, a tag, comment or script without an end goes on to the end
of the page; a quote without an end counts as no quote. A sample without labels of both kinds: every block is kept that
isn't something else by name. Repeated rows: each gets its row. Empty table: no row. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import in_task

#: A tag without angle brackets in its attributes; a try ends at the next bracket, so tries are linear together.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
NAME = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)""")
STOP = re.compile(r""">|=\s*["']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TOKEN = re.compile(r"[a-z]+")

#: Elements that part blocks, by kind.
KINDS = {
    "article": "article", "main": "article", "nav": "nav", "menu": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form", "fieldset": "form", "button": "form", "label": "form", "dialog": "form",
    "p": "p", "blockquote": "p", "pre": "p", "figcaption": "p", "address": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "hgroup": "h",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "div": "div", "section": "div", "figure": "div", "details": "div", "summary": "div", "center": "div", "body": "div", "html": "div",
    "#text": "text", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell", "head": "head", "title": "head", "hr": "div",
}
KIND_NO = {k: n for n, k in enumerate(dict.fromkeys(KINDS.values()), 1)}
#: Elements whose content is no text: up to their end tag, or (the first three) to the end of the page.
RAW = ("script", "style", "textarea", "noscript", "template", "svg", "iframe", "select")
RAW_END = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in RAW}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Tokens of attributes, and kinds, that name main text or something else.
MAIN_TOKENS = {"article", "content", "main", "post", "entry", "story", "maincontent", "articlebody"}
OTHER_TOKENS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "header", "masthead", "footer",
    "foot", "notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "form", "search", "share", "social", "related", "recommended", "comment",
    "comments", "reply", "replies", "respond", "discussion", "widget", "toolbar", "copyright", "legal", "pagination", "pager", "tags", "skip",
}
#: A class that begins or ends so tells what the page has or is about.
MODIFIERS = {"no", "not", "non", "with", "without", "has", "have", "is", "category", "cat", "tag", "topic", "type", "format", "status", "layout", "template", "theme", "single", "postid", "term", "hide", "show", "js", "wp"}
STATES = {"open", "opened", "closed", "close", "enabled", "disabled", "allowed", "on", "off", "visible", "hidden", "active", "inactive", "below", "above", "layout", "wrap", "wrapper", "container", "page", "template"}
#: Words that notices, footers and forms are made of.
NOTICE_WORDS = frozenset(
    word + end
    for word in (
        "\u00a9", "copyright", "rights", "reserved", "rechte", "vorbehalten", "droits", "r\u00e9serv\u00e9s", "derechos", "reservados", "cookie", "cookies", "consent", "privacy", "datenschutz", "datenschutz-erkl\u00e4rung", "confidentialit\u00e9", "privacidad",
        "terms", "impressum", "subscribe", "abonnieren", "newsletter", "sign", "log", "login", "register", "share", "follow", "tweet", "comment", "comments", "reply", "powered", "advertisement", "sponsored", "related", "previous", "accept",
    )
    for end in ("", ".", ",", ":")
)
#: Tokens that inside named main text may be part of it.
INNER_TOKENS = {"header", "tags", "side", "form", "foot", "legal", "alert", "notice"}
OTHER_KINDS = {"nav", "aside", "footer", "form", "head"}
BUCKETS = 8


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, "/" or "", name in lower case, attributes) of each tag; the name is empty for comments and the like, and
    "#skip" for an element whose content is no text."""
    last = {c: source.rfind(c) for c in (">", '"', "'")}
    unended, at, n = set(), 0, len(source)
    while (i := source.find("<", at)) >= 0:
        if m := TAG.match(source, i):
            closing, name, attributes, at = m[1], m[2].lower(), m[3], m.end()
        elif source.startswith("<!--", i):
            end = source.find("-->", i + 2)
            at = n if end < 0 else end + 3
            yield i, at, "", "", ""
            continue
        elif m := NAME.match(source, i + 1):
            closing, name, j = m[1], m[2].lower(), m.end()
            at = n  # a tag without an end
            while j <= last[">"]:
                stop = STOP.search(source, j)
                if stop[0] == ">":
                    at = stop.end()
                    break
                quote = stop[0][-1]
                j = source.find(quote, stop.end()) + 1 if last[quote] >= stop.end() else stop.end()
            attributes = source[m.end() : at - 1]
        elif source[i + 1 : i + 2] in ("!", "?", "/"):
            end = source.find(">", i)
            at = n if end < 0 else end + 1
            yield i, at, "", "", ""
            continue
        else:  # no markup
            at = i + 1
            continue
        if not closing and name in RAW_END and name not in unended:
            end = RAW_END[name].search(source, at)
            if end or name in RAW[:3]:
                at = (source.find(">", end.end() - 1) + 1 or n) if end else n
                yield i, at, "", "#skip", ""
                continue
            unended.add(name)
        yield i, at, closing, name, attributes


UNNAMED = (frozenset(), False, frozenset())


@lru_cache(1 << 14)
def naming(attributes: str) -> tuple[frozenset, bool, frozenset]:
    """The tokens of an element's attributes, whether a word of them names main text, and the tokens that name something else."""
    tokens, main, other = set(), False, set()
    for values in ATTRIBUTE.findall(attributes):
        for word in " ".join(values[1:]).lower().split():
            found = TOKEN.findall(word)
            tokens.update(found)
            if len(found) > 1 and (found[0] in MODIFIERS or found[-1] in STATES):
                continue
            others = OTHER_TOKENS.intersection(found)
            other |= others
            main |= not others and not MAIN_TOKENS.isdisjoint(found)
    return frozenset(tokens), main, frozenset(other)


class Page:
    """The tree of a page's block elements, and its texts in page order as (node, text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.kinds, self.parent, self.tokens, self.main, self.other = ["body"], ["div"], [-1], [frozenset()], [False], [frozenset()]
        self.texts: list[tuple[int, str, int]] = []
        self.starts, self.n_tags = [0], [0]
        stack, parts, linked, in_link, at = [0], [], 0, 0, 0
        opened: dict[str, int] = {}  # how often each name is in the stack

        def flush() -> None:
            nonlocal parts, linked
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node = stack[-1]
                if node == 0:
                    node = len(self.tags)
                    self._node("#text", 0, "")
                self.texts.append((node, text, min(linked, len(text))))
            parts, linked = [], 0

        for begin, end, closing, name, attributes in tags_of(source):
            if begin > at:
                parts.append(source[at:begin])
                linked += (begin - at) * (in_link > 0)
            at = end
            kind = KINDS.get(name)
            if not kind:
                if name == "a":
                    in_link = max(0, in_link + (-1 if closing else 1))
                elif name in ("br", "#skip"):
                    parts.append(" ")
                self.n_tags[stack[-1]] += name != "" and name != "#skip"
                continue
            flush()
            if name in ("html", "body"):
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                    if self.tags[stack[k]] == name:
                        for node in stack[k:]:
                            opened[self.tags[node]] -= 1
                        del stack[k:]
                        break
                    if name == "p" and self.kinds[stack[k]] != "h":
                        break
                in_link = 0
                continue
            in_link = 0
            while len(stack) > 1 and self._ends(self.tags[stack[-1]], name):
                opened[self.tags[stack.pop()]] -= 1
            self._node(name, stack[-1], attributes)
            if name not in VOID and not attributes.endswith("/"):
                stack.append(len(self.tags) - 1)
                opened[name] = opened.get(name, 0) + 1
        parts.append(source[at:])
        flush()

    def _node(self, name: str, parent: int, attributes: str) -> None:
        tokens, main, other = naming(attributes) if attributes else UNNAMED
        self.main.append(main)
        self.other.append(other)
        self.tags.append(name)
        self.kinds.append(KINDS[name])
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.starts.append(len(self.texts))
        self.n_tags.append(1)

    @staticmethod
    def _ends(open_tag: str, new: str) -> bool:
        """Whether an open element ends where another begins."""
        if KINDS[open_tag] in ("p", "h") and open_tag not in ("blockquote", "address"):
            return True
        return open_tag == new and new in ("li", "tr", "td", "th", "dt", "dd") or {open_tag, new} in ({"td", "th"}, {"dt", "dd"}) or open_tag in ("td", "th") and new == "tr"

    def sizes(self) -> np.ndarray:
        """The characters of text in each node's subtree."""
        out = np.zeros(len(self.tags))
        for node, text, _ in self.texts:
            out[node] += len(text)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def above_main(self) -> set[int]:
        """The page's main element and what it stands in: of the nodes named as main text and not otherwise, the one with most
        text, or the innermost in it that has more than half of that; without any, all nodes with most of the page's text."""
        size = self.sizes()
        candidates = [k for k in range(1, len(size)) if (self.kinds[k] == "article" or self.main[k]) and not self.other[k]]
        if not candidates:
            return {k for k in range(1, len(size)) if 2 * size[k] > size[0] and self.kinds[k] not in OTHER_KINDS}
        best = max(candidates, key=lambda k: (size[k], -k))
        inner = {best}
        for k in candidates:  # parents come first
            if k > best and 2 * size[k] > size[best] and self.parent[k] >= 0 and self._within(k, inner):
                inner.add(k)
        out, k = set(), max(inner)
        while k > 0:
            out.add(k)
            k = self.parent[k]
        return out

    def _within(self, k: int, nodes: set[int]) -> bool:
        low = min(nodes)
        while k >= low:
            if k in nodes:
                return True
            k = self.parent[k]
        return False

    def named(self) -> list[int]:
        """What each node is by the names of itself and those around it: 1 main text, 0 something else, -1 unknown."""
        out, above = [], self.above_main()
        for k, (kind, parent, main, others) in enumerate(zip(self.kinds, self.parent, self.main, self.other)):
            around = out[parent] if parent >= 0 else -1
            other = others - INNER_TOKENS if around == 1 else others
            if k in above:
                out.append(1 if kind == "article" or main else max(around, -1))
            elif around == 0 or kind in OTHER_KINDS or other or kind == "header" and around != 1:
                out.append(0)
            else:
                out.append(1 if kind == "article" or main else around)
        return out

    def features(self) -> np.ndarray:
        """A row for each node."""
        n = len(self.tags)
        own, links, marks, words, count, notices = (np.zeros(n) for _ in range(6))
        for node, text, linked in self.texts:
            own[node] += len(text)
            links[node] += linked
            marks[node] += sum(map(text.count, ".,;:!?"))
            words[node] += text.count(" ") + 1
            count[node] += 1
            notices[node] += len(NOTICE_WORDS.intersection(text.lower().split()))
        parent = np.array(self.parent)
        all_own, all_links, all_marks, all_words, all_count, all_notices = (x.copy() for x in (own, links, marks, words, count, notices))
        tags, kids, depth = np.array(self.n_tags, float), np.zeros(n), np.zeros(n)
        for k in range(n - 1, 0, -1):
            for x in (all_own, all_links, all_marks, all_words, all_count, all_notices, tags):
                x[parent[k]] += x[k]
            kids[parent[k]] += 1
        same, place, seen = np.zeros(n), np.zeros(n), {}
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
            place[k] = seen.get(parent[k], 0)
            seen[parent[k]] = place[k] + 1
            same[k] = seen[parent[k], self.kinds[k]] = seen.get((parent[k], self.kinds[k]), 0) + 1
        kind = np.array([KIND_NO[k] for k in self.kinds])
        safe, up = np.maximum(all_own, 1), np.maximum(parent, 0)
        names = np.array(self.named())
        named_main, named_other = np.array(self.main, float), np.fromiter(map(len, self.other), float, n)
        hashed = np.zeros((n, BUCKETS))
        for k, tokens in enumerate(self.tokens):
            for t in tokens:
                hashed[k, sum(t.encode()) % BUCKETS] = 1
        flags = np.stack([kind == k for k in KIND_NO.values()], axis=1)
        rows = [kind[up], named_main, named_other, names, np.full(n, (names == 1).any()), depth, kids, place, place / np.maximum(kids[up], 1), same, np.log1p(own), np.log1p(all_own), all_own / max(1.0, own.sum()), all_links / safe, all_marks / safe, all_own / np.maximum(all_words, 1), all_own / np.maximum(tags, 1), all_own / np.maximum(all_count, 1), np.array(self.starts) / max(1, len(self.texts)), (all_links / safe)[up], np.log1p(all_own / np.maximum(kids, 1))[up], all_notices / np.maximum(all_words, 1), all_own[up] / max(1.0, own.sum())]
        return np.column_stack([flags, hashed, *rows]).astype(np.float64)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The most probable choice of kept nodes in which nothing kept stands inside something rejected."""
        yes, no, parent = np.log(p), np.log1p(-p), self.parent
        kept, rejected = yes.copy(), no.copy()  # best sums of the subtree, by the choice for its root
        kept[0], rejected[0] = 0.0, -np.inf  # the page itself is no choice
        for k in range(len(parent) - 1, 0, -1):
            kept[parent[k]] += max(kept[k], rejected[k])
            rejected[parent[k]] += rejected[k]
        out = np.zeros(len(parent), bool)
        out[0] = True
        for k in range(1, len(parent)):
            out[k] = out[parent[k]] and kept[k] > rejected[k]
        return out


#: What pages say besides their main text.
NOTICES = (
    "We use cookies to improve your experience. By going on you accept our cookie policy.", "Wir verwenden Cookies. Mehr in der Datenschutz-Erkl\u00e4rung.", "Copyright 2024 Example Media. All rights reserved.", "\u00a9 2023 Tous droits r\u00e9serv\u00e9s.",
    "Todos los derechos reservados. Aviso de privacidad.", "Subscribe to our newsletter and never miss a story.", "Share this on your favourite network.", "Please log in or register to leave a reply.", "Powered by a publishing system. Terms of use.",
)
#: Class names of wrappers that hold main text, of main text, and of what is neither; empty where nothing is named.
WRAPPERS = ("wrap no-sidebar", "with-header", "site", "container", "layout-sidebar-right", "page has-sidebar", "outer comments-open", "main-wrap", "row", "header-fixed body-wrap")
MAINS = ("post", "entry-content", "article-body", "content", "post comments-open", "post category-legal", "story", "post tag-promo")
OTHERS = ("sidebar", "cookie-notice", "site-footer", "comments", "related-posts", "share-buttons", "newsletter", "widget", "breadcrumb", "advert")


def varied(main: list[tuple[str, str]], others: list[str], seed: int) -> Iterator[tuple[str, set[str]]]:
    """Pages that hold the same main text, as (tag, text), between other text; with each the texts that are main."""
    rng = np.random.default_rng(seed)
    pick = lambda some: some[int(rng.integers(len(some)))]
    texts = {text for _, text in main}
    for way in range(4):
        named, loose = way < 2, way == 3
        attribute = lambda some, named=named: f' class="{pick(some)}"' if named else ""
        block = lambda tag, text: f"<{tag}>{html.escape(text)}</{tag}>"
        links = "<ul>" + "".join(f"<li><a href=x>{html.escape(w)}</a></li>" for w in " ".join(others).split()[:8]) + "</ul>"
        notes = [pick(NOTICES) for _ in range(3)] + others
        before = [links] + [f"<div{attribute(OTHERS)}><p>{html.escape(pick(notes))}</p></div>" for _ in range(int(rng.integers(0, 3)))]
        after = [f"<div{attribute(OTHERS)}>{block(pick(('p', 'div', 'span')), pick(notes))}</div>" for _ in range(int(rng.integers(1, 4)))] + [block(pick(("div", "p")), pick(NOTICES[2:5]))]
        if named and rng.random() < 0.5:
            after.append('<div class="comments">' + "".join(f"<article class=comment>{block('p', t)}</article>" for t in others) + "</div>")
        inside = [block(tag, text) for tag, text in main] if not loose else [f"{html.escape(text)}<br><br>" if k % 2 else block("p", text) for k, (_, text) in enumerate(main)]
        if named and rng.random() < 0.5:
            inside.insert(int(rng.integers(len(inside) + 1)), f"<div{attribute(OTHERS)}>{block('p', pick(notes))}</div>")
        element = pick(("article", "main", "div", "section")) if named else pick(("div", "section"))
        core = "".join(inside) if loose else f"<{element}{attribute(MAINS)}>{''.join(inside)}</{element}>"
        for _ in range(int(rng.integers(0, 3)) if not loose else 0):
            core = f"<div{attribute(WRAPPERS)}>{core}</div>"
        yield f"<body>{''.join(before)}{core}{''.join(after)}</body>", texts


def training_rows(page: Page, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and distant labels of a page's labelled nodes: of the page as it is, and of the pages that it is written into."""
    names = page.named()
    labels, x = np.array(names), page.features()
    out_x, out_y = [x[labels >= 0]], [labels[labels >= 0]]
    main = [(page.tags[node] if page.kinds[node] in ("p", "h") else "p", text) for node, text, _ in page.texts if names[node] == 1]
    others = [text for node, text, linked in page.texts if names[node] == 0 and page.kinds[node] != "head" and 2 * linked < len(text)]
    others = [text for text in dict.fromkeys(others) if text not in {t for _, t in main}][:6]
    for source, texts in varied(main, others, seed) if main else ():
        made = Page(source)
        kept, held = np.zeros(len(made.tags)), made.sizes()
        for node, text, _ in made.texts:  # a run of loose text may hold several
            if text in texts or any(t in text for t in texts):
                kept[node] += len(text)
        for k in range(len(kept) - 1, 0, -1):
            kept[made.parent[k]] += kept[k]
        use = held > 0
        use[0] = False
        out_x.append(made.features()[use])
        out_y.append((kept[use] > 0).astype(labels.dtype))
    return np.concatenate(out_x), np.concatenate(out_y)


def main_texts(sources: list[str | None], model: dict | None) -> list[str]:
    """The main text of each page: kept blocks in page order, one to a line. Nodes of all pages go through the trees together."""
    pages = [Page(x or "") for x in sources]
    if model is None:
        keeps = [np.array(x.named()) != 0 for x in pages]
    else:
        features = [x.features() for x in pages]
        p = np.clip(boosting.probability(model, np.concatenate([*features, np.zeros((0, features[0].shape[1]))])), 1e-6, 1 - 1e-6) if pages else np.zeros(0)
        keeps = [x.decode(y) for x, y in zip(pages, np.split(p, np.cumsum([len(f) for f in features])[:-1]))] if pages else []
    return ["\n".join(text for node, text, _ in x.texts if keep[node]) for x, keep in zip(pages, keeps)]


def main_text(source: str | None, model: dict | None) -> str:
    """The main text of one page."""
    return main_texts([source], model)[0]


def fit_on(pages: DataFrame, most: int = 300, nodes: int = 1000) -> dict | None:
    """The trees from a bounded sample of pages, and of each page's nodes; None if it has labels of one kind only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                x, y = training_rows(Page(source), zlib.crc32(source.encode()))
                some = np.unique(np.linspace(0, len(y) - 1, min(len(y), 4 * nodes)).astype(int)) if len(y) else []
                x, y = x[some], y[some]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([y.astype(np.float64).tobytes()])], names=["x", "y"])

    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h")).join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("h").alias("h"))
    got = sample.select("h").mapInArrow(rows, "x binary, y binary").toPandas()
    if not len(got):
        return None
    by = sorted(zip(got["x"], got["y"]))  # the order that rows arrive in doesn't matter
    y = np.concatenate([np.frombuffer(b) for _, b in by])
    x = np.concatenate([np.frombuffer(a) for a, _ in by]).reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    return in_task(pages.sparkSession, lambda: boosting.fit(x, y)) if 0 < y.sum() < len(y) else None


def extract(pages: DataFrame, most: int = 300) -> DataFrame:
    """page_id, url, text, n_chars (code points): a row for each row of pages."""
    model = pages.sparkSession.sparkContext.broadcast(fit_on(pages, most))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                out = main_texts(some.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
