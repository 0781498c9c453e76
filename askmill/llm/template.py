"""Main text of web pages by template deduction over equivalence classes.

The pages of a host share a template. Its tokens, here the page's containers with their place in the nesting, the texts of
containers and the texts of blocks, are told from content by their occurrence vectors: in which pages a token occurs, and how often. Tokens of
equal vectors form an equivalence class. A class is valid if it occurs in enough of the host's pages; its containers nest in
those around them. A text is template if its class is valid and holds a container with it: the text of a whole container, or a block that
comes wherever one around it does. A class that holds the text of the slot itself is none: its pages are copies of one article.
Containers that occur once a page and hold nearly all text that is not template are slots; the article is what the best slot
holds without the template's texts. Names of containers choose between slots, and say what of a page is no article in any.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut

#: A class is valid if it occurs in this share of its host's pages, and in so many pages.
SHARE, PAGES = 0.5, 3
#: A slot holds this share of the text that is not template, over its host's pages or in a page read alone.
NEARLY = 0.9
#: A page whose slot holds less than this share of its text is read alone; a container with more is not rejected by its name; blocks with more of a slot's text are copies, not template.
MINOR = 0.5
#: Bytes of hosts' slots and templates that each executor may be sent; more are joined by shuffle.
MOST_SENT = 64 << 20
#: Tokens that a task adds up before it gives them out.
TOKENS = 200_000

# HTML's elements by what they do, and the names by which pages mark what isn't article.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "button",
}
NOT_ARTICLE = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "button", "search", "dir"}
NAMES = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination",
    "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
# What belongs to the container around it: its text alone is never template.
PARTS = {"p", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dt", "dd", "option", "figcaption", "legend", "hgroup"}
CONTENT = {"article", "content", "entry", "main", "post", "story"}
# Words that don't change what the others of a name say, and those before which a name tells of a state, not of the container itself.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "entry", "global", "group", "icon", "icons", "inner", "item", "left", "link", "links", "list", "main", "page", "panel", "post", "primary", "right", "section", "site", "text", "top", "wrap", "wrapper"}
STATES = {"has", "is", "js", "no", "not", "with", "without"}

# Possessive throughout: what has failed isn't tried again in parts, so a page is read in time in proportion to its length.
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|(?<==)"[^"]*+"|(?<==)'[^']*+'|["'])*+)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-zA-Z]+")
_BEGUN = re.compile(r"</?[a-zA-Z]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: What the start of an element of a kind ends: an element of the second set, if it is the innermost one open.
_CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Marks:
    """What a tag's attributes say of it: a token, whether it is hidden, whether a name says that it is no article, or that it is one."""

    token: str
    hidden: bool = False
    says: bool = False
    named: bool = False


def marks(tag: str, attributes: str) -> Marks:
    if not attributes.strip():
        return Marks(tag, False, tag == "form", tag in ("article", "main"))
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(found.get("style", "")))
    names = [[w.lower() for w in _WORD.findall(x)] for k in ("class", "id") for x in found.get(k, "").split()]
    own = [set(x) for x in names if x and x[0] not in STATES and tag not in ("body", "html")]
    named = tag in ("article", "main") or role in ("article", "main") or any(x & CONTENT and x <= CONTENT | NEUTRAL for x in own)
    says = tag == "form" or role in ROLES or not named and any(x & NAMES and x <= NAMES | NEUTRAL for x in own)
    return Marks(tag + "".join(f".{w}" for w in sorted({w for x in names for w in x})), hidden, says, named)


def _mark(*parts: object) -> int:
    """64 bits, as a signed number, of these parts."""
    x = xxhash.xxh64_intdigest("\0".join(map(str, parts)))
    return x - 2**64 if x >= 2**63 else x


@dataclass
class Page:
    """Containers in the order in which they open, 0 being the page, and blocks of text in theirs. A container's blocks are those from ``first`` to ``last``."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    mark: list[int] = field(default_factory=lambda: [0])
    gone: list[bool] = field(default_factory=lambda: [False])
    says: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    end: list[int] = field(default_factory=lambda: [0])
    first: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)

    def settle(self) -> None:
        """Says which blocks are no article: those that tags or attributes hide, and those of containers that their names reject.

        A name doesn't reject a container with most of the page's text, unless a container named as an article stands beside it.
        """
        n = len(self.parent)
        held = np.r_[0, np.cumsum([0 if self.gone[c] else x for c, x in zip(self.inside, self.chars, strict=True)])].astype(np.int64)
        size = held[self.last] - held[self.first]
        under, around, good = [False] * n, [0] * n, [False] * n
        for c in range(1, n):
            p = self.parent[c]
            under[c] = under[p] or self.says[c]
            around[c] = around[p] + good[p]
            good[c] = self.named[c] and not self.gone[c] and not under[c] and size[c] > 0
        below = np.r_[0, np.cumsum(good)]
        for c in range(1, n):
            beside = below[-1] - around[c] - (below[self.end[c]] - below[c])
            rejected = self.says[c] and (size[c] <= MINOR * size[0] or beside > 0)
            self.gone[c] = self.gone[c] or self.gone[self.parent[c]] or bool(rejected)
            self.says[c] = rejected or self.says[self.parent[c]]
            self.named[c] = self.named[c] and not self.gone[c]

    def kept(self) -> np.ndarray:
        return np.array([not self.gone[c] for c in self.inside], bool)

    def home(self) -> list[int]:
        """For each container itself, or for a part of a text the container around it that is none."""
        out = [0]
        for c in range(1, len(self.parent)):
            out.append(out[self.parent[c]] if self.tag[c] in PARTS else c)
        return out


def blocks(page: str) -> Page:
    """A page's containers and text blocks, in one pass over it."""
    out, stack, opened, lost = Page(), [0], {}, []
    parts: list[str] = []
    links = link_depth = at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.text.append(text)
                out.chars.append(len(text) - min(links, len(text)))
                out.inside.append(stack[-1])
            parts.clear()
        links = 0
        lost.clear()

    def leave() -> None:
        c = stack.pop()
        opened[out.tag[c]] -= 1
        out.end[c], out.last[c] = len(out.parent), len(out.text)

    while at < len(page):
        lt = page.find("<", at)
        end = len(page) if lt < 0 else lt
        if end > at and not lost:
            parts.append(page[at:end])
            links += (end - at) * link_depth
        if lt < 0:
            break
        m = _TAG.match(page, lt)
        if not m:
            if _BEGUN.match(page, lt):
                break  # a tag that never ends
            if not lost:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                ended = _ENDS[tag].search(page, at)
                # Where no such tag is closed, none of the later ones is.
                at = page.find(">", ended.end()) + 1 if ended else 0
                at = at or len(page)
            continue
        if tag == "a":
            link_depth = 0 if m[1] else 1
        if tag == "br" and not lost:
            parts.append(" ")
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag not in BLOCK:
            # An inline element that is hidden, or named as no article, is lost up to its end, or the block's.
            if m[1]:
                if lost and tag == lost[-1]:
                    lost.pop()
            elif not m[3].endswith("/"):
                found = marks(tag, m[3])
                if lost and tag == lost[-1] or found.hidden or found.says:
                    lost.append(tag)
            continue
        flush()
        if m[1]:
            if opened.get(tag):
                while out.tag[stack[-1]] != tag:
                    leave()
                leave()
            continue
        if out.tag[stack[-1]] == "p" or out.tag[stack[-1]] in _CLOSES.get(tag, ()):
            leave()
        found, top = marks(tag, m[3]), stack[-1]
        stack.append(len(out.parent))
        out.parent.append(top)
        out.depth.append(out.depth[top] + 1)
        out.tag.append(tag)
        out.mark.append(_mark(out.mark[top], found.token))
        out.gone.append(out.gone[top] or found.hidden or tag in NOT_ARTICLE and tag != "form" or tag == "header" and not (opened.get("article") or opened.get("main")))
        out.says.append(found.says)
        out.named.append(found.named)
        out.first.append(len(out.text))
        out.end.append(0)
        out.last.append(0)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    while len(stack) > 1:
        leave()
    out.end[0], out.last[0] = len(out.parent), len(out.text)
    out.settle()
    return out


_BASE = 0x9E3779B97F4A7C15


def texts(page: Page) -> tuple[dict[int, int], list[int | None]]:
    """For containers, but parts of a text, the mark of all the article's text that they hold; and for each block of the article a mark of where it stands and what it says."""
    kept, home = page.kept().tolist(), page.home()
    # Sums of powers: a run's are told from those up to its ends, so that a deep page takes no longer than a flat one.
    upto, power = [0], [1]
    for text, keep in zip(page.text, kept, strict=True):
        upto.append((upto[-1] * _BASE + xxhash.xxh64_intdigest(text)) % 2**64 if keep else upto[-1])
        power.append(power[-1] * _BASE % 2**64 if keep else power[-1])
    count = np.r_[0, np.cumsum(kept)].tolist() if kept else [0]
    powers = {n: p for n, p in zip(count, power, strict=True)}
    whole = {}
    for c in range(1, len(page.parent)):
        a, b = page.first[c], page.last[c]
        if page.tag[c] not in PARTS and count[b] > count[a] and not page.gone[c]:
            whole[c] = _mark(page.mark[c], "whole", (upto[b] - upto[a] * powers[count[b] - count[a]]) % 2**64)
    own = [_mark(page.mark[home[c]], "block", t) if keep else None for c, t, keep in zip(page.inside, page.text, kept, strict=True)]
    return whole, own


def _host(url: str | None) -> str | None:
    m = re.match(r"\s*[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else None


def tokens(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """host, path, parent, depth, text, whole, pages, vector, count, chars, named: sums over a host's pages for each container path (text 0), each text of a container (whole) and each of a block.

    path, parent and text are marks, so that a token is as short for a deep page. vector: the sum of the hashes of the pages it
    occurs in, times how often, modulo 2^64, so that equal occurrence vectors have equal sums; each task adds up its own pages before anything is
    shuffled. Path 0 stands for the page. chars: the article's text below the path, or of the text; named: whether a page names it as an article.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int, int, int, bool], list] = {}

        def give() -> pa.RecordBatch:
            rows = [(*token, a, v - 2**64 if v >= 2**63 else v, c, x, y) for token, (a, v, c, x, y) in sums.items()]
            sums.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "path", "parent", "depth", "text", "whole", "pages", "vector", "count", "chars", "named"])

        for batch in batches:
            for k in range(batch.num_rows):
                if len(sums) >= TOKENS:
                    yield give()
                host, given = _host(batch.column(1)[k].as_py()), batch.column(2)[k].as_py()
                if host is None or not given:
                    continue
                mark = xxhash.xxh64_intdigest(f"{batch.column(0)[k].as_py()}")
                page = blocks(given)
                held = np.r_[0, np.cumsum(np.where(page.kept(), page.chars, 0))].astype(int).tolist() if page.text else [0]
                whole, own = texts(page)
                found: dict[tuple[int, int, int, int, bool], list] = {}
                home = page.home()

                def add(token: tuple[int, int, int, int, bool], chars: int, named: bool) -> None:
                    x = found.setdefault(token, [0, 0, False])
                    x[0] += 1
                    x[1] += chars
                    x[2] |= named

                for c in range(len(page.parent)):
                    if page.tag[c] in PARTS:
                        continue
                    around = page.mark[home[page.parent[c]]] if c else 0
                    size = held[page.last[c]] - held[page.first[c]]
                    add((page.mark[c], around, page.depth[c], 0, False), size, page.named[c])
                    if c in whole:
                        add((page.mark[c], around, page.depth[c], whole[c], True), size, False)
                for c, m, chars in zip(page.inside, own, page.chars, strict=True):
                    if m is not None:
                        h = home[c]
                        add((page.mark[h], 0, page.depth[h], m, False), chars, False)
                for token, (n, chars, named) in found.items():
                    s = sums.setdefault((host, *token), [0, 0, 0, 0, False])
                    s[0] += 1
                    s[1] = (s[1] + mark * n) % 2**64
                    s[2] += n
                    s[3] += chars
                    s[4] |= named
        yield give()

    kind = "host string, path long, parent long, depth int, text long, whole boolean, pages long, vector long, count long, chars long, named boolean"
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.col(text).alias("t")).mapInArrow(run, kind)
    # Vectors are sums modulo 2^64: exact in decimals, brought back to one value of each residue.
    residue = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(str(2**64)).cast("decimal(38,0)"))
    by = ["host", "path", "parent", "depth", "text", "whole"]
    return rows.groupBy(*by).agg(F.sum("pages").alias("pages"), residue.alias("vector"), F.sum("count").alias("count"), F.sum("chars").alias("chars"), F.max("named").alias("named"))


@dataclass
class Place:
    """A container path: the path around it, how deep it lies, its text that is not template, whether it is named as an article and may be a slot."""

    parent: int
    depth: int
    chars: int
    named: bool
    slot: bool = True


def chain(places: dict[int, Place], path: int) -> list[int]:
    """The path and those around it, up to the page's."""
    out = [path]
    while out[-1]:
        out.append(places[out[-1]].parent)
    return out


def best_slot(places: dict[int, Place]) -> int:
    """The slot: the outermost named path that holds nearly all text, or else the innermost that does, around the largest named one if there is one."""
    whole = NEARLY * places[0].chars
    holds = {p for p, x in places.items() if x.slot and x.chars >= whole} | {0}
    if articles := [p for p in holds if places[p].named]:
        return min(articles, key=lambda p: (places[p].depth, -places[p].chars, p))
    largest = max((p for p, x in places.items() if x.named), key=lambda p: (places[p].chars, p), default=None)
    around = holds if largest is None else holds.intersection(chain(places, largest))
    return max(around, key=lambda p: (places[p].depth, places[p].chars, p))


def walked(places: dict[int, Place]) -> tuple[list[int], dict[int, int]]:
    """The paths, each before what it holds, and for each the place in that order at which what it holds ends."""
    below: dict[int, list[int]] = {}
    for p, x in places.items():
        if p:
            below.setdefault(x.parent, []).append(p)
    order, end, todo = [], {}, [(0, False)]
    while todo:
        p, done = todo.pop()
        if done:
            end[p] = len(order)
        else:
            order.append(p)
            todo.append((p, True))
            todo += [(q, False) for q in below.get(p, ())]
    return order, end


def deduce(tokens: list[dict]) -> tuple[int, set[int]]:
    """A host's slot and the marks of its template's texts, from the tokens that are in enough of its pages.

    Tokens of equal vectors are a class. Of a class without the text of the slot, or of what is around it, the texts of containers are
    template, and so are blocks if a container around them is of the class: they come wherever it does. Blocks that would take most of the
    slot's text are copies as well. What holds for all that is around a path is found in one walk over the paths, however deep they lie.
    """
    paths, said = [t for t in tokens if not t["text"]], [t for t in tokens if t["text"]]
    once = {t["path"]: t["vector"] for t in paths if t["pages"] == t["count"]}
    size = {t["path"]: t["chars"] for t in paths}
    places = {t["path"]: Place(t["parent"], t["depth"], t["chars"], t["named"] and t["path"] in once, t["path"] in once) for t in paths}
    order, end = walked(places)
    at = {p: k for k, p in enumerate(order)}
    of: dict[int, list[dict]] = {}
    for t in said:
        of.setdefault(t["path"], []).append(t)
    # Blocks of the class of a container around them: vectors on the way down are counted as the walk enters and leaves.
    within, on, open_ = set(), Counter(), []
    for k, p in enumerate(order):
        while open_ and end[open_[-1]] <= k:
            on[once.get(open_.pop())] -= 1
        open_.append(p)
        on[once.get(p)] += 1
        within |= {id(t) for t in of.get(p, ()) if not t["whole"] and t["vector"] is not None and on[t["vector"]] > 0}
    slot, template = best_slot(places), set()
    for _ in range(2):
        around = set(chain(places, slot))
        copies = {t["vector"] for t in said if t["whole"] and (t["path"] in around or not places[t["path"]].parent)}
        outer = [t for t in said if t["whole"] and t["path"] not in around and t["vector"] not in copies]
        tops = {t["path"] for t in outer}
        repeated = [t for t in said if id(t) in within and t["vector"] not in copies]
        inner = [t for t in repeated if at[slot] <= at[t["path"]] < end[slot]]
        if sum(t["chars"] for t in inner) > MINOR * size[slot]:
            held = set(map(id, inner))
            repeated = [t for t in repeated if id(t) not in held]
        template = {t["text"] for t in [*outer, *repeated]}
        # What goes from a path: the outermost template containers below it, and the blocks that are in none.
        less, covered = dict.fromkeys(places, 0), dict.fromkeys(places, False)
        for p in order:
            if p:
                covered[p] = covered[places[p].parent] or places[p].parent in tops
        for t in [*outer, *repeated]:
            if not covered[t["path"]] and (t["whole"] or t["path"] not in tops):
                less[t["path"]] += t["chars"]
        for p in reversed(order):
            if p:
                less[places[p].parent] += less[p]
        slot = best_slot({p: Place(x.parent, x.depth, size[p] - less[p], x.named, x.slot) for p, x in places.items()})
    return slot, template


def slots(found: DataFrame) -> DataFrame:
    """host, slot, template: the path of the slot that holds the articles and the marks of texts that are template, for hosts of enough pages.

    What is in less than half of a host's pages goes first, so a host's row holds some hundred tokens, however many its pages.
    """
    whole = found.filter("path = 0 and text = 0").select(F.col("host").alias("h"), F.col("pages").alias("of"))
    rows = found.filter(F.col("pages") >= PAGES).join(whole, F.col("host") == F.col("h")).filter(F.col("pages") >= SHARE * F.col("of"))
    fields = ["path", "parent", "depth", "text", "whole", "pages", "vector", "count", "chars", "named"]
    hosts = rows.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [deduce(sorted(given, key=lambda x: (x["path"], x["text"], x["whole"]))) for given in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.int64()), pa.array([sorted(x) for _, x in out], pa.list_(pa.int64()))], names=["host", "slot", "template"])

    return hosts.mapInArrow(run, "host string, slot long, template array<long>")


def main_text(given: str | None, slot: int | None, template: list[int] | None = None) -> str:
    """The article's blocks joined by spaces: those in the host's slot, without its template; a page without the slot, or with most of its text elsewhere, is read alone."""
    if not given:
        return ""
    page = blocks(given)
    if not page.text:
        return ""
    n, kept, known = len(page.parent), page.kept(), set(template or ())
    if known:
        whole, own = texts(page)
        around = set()
        for c in range(n):
            if page.mark[c] == slot:
                while c >= 0 and c not in around:
                    around.add(c)
                    c = page.parent[c]
        cover = np.zeros(len(page.text) + 1, int)
        for c, m in whole.items():
            if m in known and c not in around:
                cover[page.first[c]] += 1
                cover[page.last[c]] -= 1
        rest = kept & (np.cumsum(cover)[:-1] == 0) & np.array([m not in known for m in own])
        kept = rest if rest.any() else kept  # a page that would have no text left is none of the template
    held = np.r_[0, np.cumsum(np.where(kept, page.chars, 0))]
    places: dict[int, Place] = {}
    home, at = page.home(), {}
    for c in range(n):
        if page.tag[c] not in PARTS:
            x = places.setdefault(page.mark[c], Place(page.mark[home[page.parent[c]]] if c else 0, page.depth[c], 0, False))
            x.chars += int(held[page.last[c]] - held[page.first[c]])
            x.named |= page.named[c]
            at.setdefault(page.mark[c], []).append(c)
    if slot is None or slot not in places or places[slot].chars < MINOR * places[0].chars:
        slot = best_slot(places)
    inside, around = np.zeros(len(page.text) + 1, int), set()
    for c in at[slot]:
        inside[page.first[c]] += 1
        inside[page.last[c]] -= 1
        while not places[slot].named and c >= 0 and c not in around:
            around.add(c)
            c = page.parent[c]
    # Nothing names such a slot, so what stands directly in the containers around it, as a title does, belongs to it.
    beside = np.array([home[c] in around for c in page.inside])
    return " ".join(page.text[k] for k in np.flatnonzero(kept & ((np.cumsum(inside)[:-1] > 0) | beside)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars.

    A null or empty page has an empty text. Pages without a host, and hosts of too few pages for a template, are
    read by the names of their containers alone. Each row is its own page, repeated keys included; other columns are left out. Long
    pages are read whole; an empty table gives an empty table. Pages aren't shuffled while the hosts' slots
    are few enough to send; beyond, both are joined by host.
    """
    found = cut(slots(cut(tokens(pages, key, url, text), "tokens")), "slots")
    few = (found.agg(F.sum(F.octet_length("host") + 8 * F.size("template") + 64)).first()[0] or 0) <= MOST_SENT
    host = F.lower(F.regexp_extract(F.col(url), r"^\s*[a-zA-Z][\w+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(text).alias("t"), host.alias("host"))
    joined = rows.join(F.broadcast(found) if few else found, "host", "left").select("k", "u", "t", "slot", "template")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    return joined.mapInArrow(run, f"k {kind}, u string, text string, n_chars long").select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
