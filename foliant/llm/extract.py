"""Main texts of web pages, by wrappers inferred from the pages of a host.

A page is a tree of block elements and text slots. Neighbouring elements, or runs of them, of one shape are folded into
repeated groups. The pages of a host are then aligned one after another with the host's wrapper, a union-free regular
expression: what agrees stays, a group that repeats on one side is made repeated, a slot collects the texts it had, and
any other mismatch makes what stands on one side only optional. Wrappers of parts of a host are aligned in the same way,
so no task holds more than some wrappers, however many pages the host has. Pages are dealt by host and contents, and
aligned in the order of their digests, so that a host's wrapper does not depend on how the table is partitioned.

The wrapper decides on every page. Its main region is found from the root down: as long as one element holds at least
`MAIN` of the running text of the element around it, and no headline stands beside it. Running text is that of slots
which are neither template nor menu: a text that is in its slot on `COMMON` pages and on `SHARED` of all of the host's
is template, and a slot that is mostly links is a menu. A page is aligned with its host's wrapper, and its main text is
that of its slots in the region, without template texts and menus. What elements are named (aside, footer, class="ad")
takes them out of the running text; so names decide between parts that have equal structure, such as paragraphs and
readers' comments, and only there.

Defined results: null and empty pages have an empty text; a page with a null or odd URL belongs to the host "";
repeated rows are extracted each and count once as evidence of a template; unclosed and stray tags close where their
parents do; a host all of whose text stands in parts named as menus and the like has empty texts; very long pages are
read whole; page_id may be of any type, null or repeated; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._cluster import column, cut, small_batches

#: A text that stands in its slot on so many pages, and on this share of all pages of its host, is template.
COMMON, SHARED = 8, 0.6
#: The share of a slot's characters in links from which on it is a menu.
LINKS = 0.6
#: The share of the running text around it from which on an element holds the main text.
MAIN = 0.6
#: The texts of a slot that are counted, by Misra and Gries's rule: counts lack at most this part of all its texts.
TEXTS = 64
#: Pages of a host that one task aligns, about; and wrappers of its parts.
SPLIT, FAN = 2000, 64
#: Hosts of more pages are broadcast up to this many; beyond, they are joined by shuffle.
MAX_SPLIT_HOSTS = 200_000
#: Wrappers are broadcast up to this many bytes together; beyond, they are joined by shuffle.
MAX_BROADCAST_BYTES = 16_000_000

# Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "input", "wbr", "source", "track", "param", "embed", "area", "map",
}
#: What an opening tag closes, up to one of the stops.
CLOSES = {
    **dict.fromkeys("p address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre section table ul".split(), ({"p"}, set())),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
#: Elements, roles and names that are no main text, and those that hold it.
ASIDE = {"nav", "footer", "aside", "form", "head", "title", "button", "dialog", "menu"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar|comments?|commentlist|respond|replies|disqus|cookies?|consent|"
    r"gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip)(?=$|[\s_-])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:[_-]?(?:body|content|text|main))?(?=$|[\s])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
#: Elements of plain text: neighbours are alike whatever stands in them.
FLOW = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "th", "tr", "blockquote", "figure", "hr"}
HEADLINES = {"h1", "h2"}
#: What can stand in a head.
HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: Elements nested deeper than this stand beside each other.
_DEEPEST = 150
#: Lists of items of up to this many pairs are matched by likeness.
_EXACT = 10_000


def _kind(tag: str, attributes: dict[str, str], inside_main: bool) -> tuple[str, int]:
    """(names, kind): kind is -1 for what is no main text, 1 for what holds it, else 0."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if tag in ASIDE or role in _ROLES or hidden or (tag == "header" and not inside_main):
        return names, -1
    if tag in ("article", "main") or role in ("main", "article"):
        # readers' comments are often articles in the article
        return names, -1 if re.search(r"(?:^|[\s_-])(?:comments?|reply)(?:$|[\s_-])", names, re.I) else 1
    if tag in ("body", "html"):
        return names, 0
    if names and _NAMES.search(names):
        return names, -1
    return names, 1 if names and tag in ("div", "section", "td") and _MAIN.search(names) else 0


_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}

# A wrapper is a list of items [label, optional, repeated, kind, inner items or None, slot or None, whether it is the main region].
# The label of a slot is "#", of a group of several items "()". A slot is [pages, [[text's hash, pages], ...], characters, link characters, blocks of the page, texts].
_LABEL, _OPTIONAL, _REPEATED, _KIND, _INNER, _SLOT, _REGION = range(7)


def parsed(page: str) -> tuple[list[str], list[list]]:
    """A page's text blocks, and its items."""
    found: list[str] = []
    top: list[list] = []
    stack: list[tuple[str, list]] = []
    text: list[str] = []
    links = depth_a = 0
    at, size = 0, len(page)

    def around() -> list[list]:
        return stack[min(len(stack), _DEEPEST) - 1][1][_INNER] if stack else top

    def flush() -> None:
        nonlocal links
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole and not any(tag == "head" for tag, _ in stack):
                slot = [1, [[zlib.crc32(whole.encode(errors="replace")), 1]], len(whole), links, [len(found)], 1]
                around().append(["#", 0, 0, 0, None, slot, 0])
                found.append(whole)
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if depth_a:
            links += len(piece)

    while at < size:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if i > at:
            add(page[at:i])
        token = _TOKEN.match(page, i)
        if token is None:
            add("<")
            at = i + 1
            continue
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        closing, tag = bool(token[1] or token[4]), name.lower()
        if tag in RAW and not closing:
            end = _RAW_END[tag].search(page, at)
            end = page.find(">", end.end()) if end else -1
            at = size if end < 0 else end + 1
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            depth_a = 0 if closing else 1
        elif tag in INLINE:
            continue
        elif closing:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            flush()
            closes, stops = CLOSES.get(tag, (set(), set()))
            lowest = len(stack)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops or not closes or (stack[k][0] not in closes and not stops):
                    break
                if stack[k][0] in closes:
                    lowest = k
            del stack[lowest:]
            if tag not in HEAD and any(t == "head" for t, _ in stack[-3:]):
                del stack[[t for t, _ in stack].index("head") :]
            if tag in VOID:
                continue
            raw = token[3] if token[2] else token[6]
            attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(raw)} if raw and "=" in raw else {}
            if raw and re.search(r"(?:^|\s)hidden(?:\s|/|$)", raw):
                attributes.setdefault("hidden", "")
            names, kind = _kind(tag, attributes, any(x[_KIND] == 1 for _, x in stack))
            item = [_label(tag, names), 0, 0, kind, [], None, 0]
            around().append(item)
            stack.append((tag, item))
    flush()
    return found, top


def _label(tag: str, names: str) -> str:
    """A tag with its names; digits in them are no distinction."""
    return f"{tag}.{re.sub(r'[0-9]+', '0', names)}" if names else tag


def _tag(item: list) -> str:
    return item[_LABEL].split(".", 1)[0]


def _shape(item: list) -> str:
    """What neighbours must share to be folded: their labels, and those in them, but for elements that hold plain text."""
    if item[_INNER] is None or _tag(item) in FLOW:
        return item[_LABEL]
    return f"{item[_LABEL]}({' '.join(_shape(x) for x in item[_INNER])})"


def _texts(a: list[list], b: list[list]) -> list[list]:
    """The texts of two slots with their pages; beyond TEXTS of them, all lose what the next one has."""
    n = dict(map(tuple, a))
    for text, pages in b:
        n[text] = n.get(text, 0) + pages
    if len(n) <= TEXTS:
        return [list(x) for x in n.items()]
    top = sorted(n.items(), key=lambda x: (-x[1], x[0]))
    less = top[TEXTS][1]
    return [[t, p - less] for t, p in top if p > less]


def _merged(a: list, b: list, same_page: bool) -> list:
    """The item that covers both, which agree in their labels."""
    slot = None
    if a[_SLOT] is not None:
        x, y = a[_SLOT], b[_SLOT]
        x[4].extend(y[4])
        if same_page:
            x[1].extend(y[1])
        slot = [max(x[0], y[0]) if same_page else x[0] + y[0], x[1] if same_page else _texts(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4], x[5] + y[5]]
    inner = None if a[_INNER] is None else aligned(a[_INNER], b[_INNER], same_page)
    return [a[_LABEL], max(a[_OPTIONAL], b[_OPTIONAL]), max(a[_REPEATED], b[_REPEATED]), a[_KIND], inner, slot, 0]


def folded(items: list[list]) -> list[list]:
    """A page's items, with neighbours, and runs of them, of one shape put into repeated groups, innermost first."""
    for x in items:
        if x[_INNER]:
            x[_INNER] = folded(x[_INNER])
    length, ids = 0, np.zeros(0, np.int64)
    while 2 * (length + 1) <= len(items):
        length += 1
        if len(ids) != len(items):
            kinds: dict[str, int] = {}
            ids = np.array([kinds.setdefault(_shape(x), len(kinds)) for x in items])
        # where the next length items all agree with those length further on
        sums = np.concatenate([[0], np.cumsum(ids[:-length] == ids[length:])])
        repeats = sums[length:] - sums[:-length] == length
        if not repeats.any():
            continue
        out, i = [], 0
        while i < len(items):
            unit = items[i : i + length] if i < len(repeats) and repeats[i] else items[i : i + 1]
            i += len(unit)
            if i <= len(repeats) + length - 1 and len(unit) == length and repeats[i - length]:
                while i - length < len(repeats) and repeats[i - length]:
                    unit = [_merged(a, b, True) for a, b in zip(unit, items[i : i + length], strict=True)]
                    i += length
                if length > 1:
                    unit = [["()", 0, 1, 0, unit, None, 0]]
                unit[0][_REPEATED] = 1
            out += unit
        items = out
    return items


def _once(items: list[list]) -> None:
    """Count a text that stands in a slot of a page several times once."""
    for x in items:
        if x[_SLOT] is not None:
            x[_SLOT][1] = [[t, 1] for t in dict.fromkeys(t for t, _ in x[_SLOT][1])]
            x[_SLOT][5] = len(x[_SLOT][1])
        else:
            _once(x[_INNER])


def page_items(page: str) -> tuple[list[str], list[list]]:
    """A page's text blocks, and its items, folded."""
    texts, items = parsed(page)
    items = folded(items)
    _once(items)
    return texts, items


def _likeness(a: list, b: list) -> float:
    """0 if items can't be the same part of a template."""
    if a[_LABEL] != b[_LABEL]:
        return 0
    if a[_INNER] is None or _tag(a) in FLOW:
        return 2
    x, y = {i[_LABEL] for i in a[_INNER]}, {i[_LABEL] for i in b[_INNER]}
    if not x or not y:
        return 1
    return 2 * len(x & y) / len(x | y)


def _wrapped(xs: list[list], ys: list[list]) -> list[list]:
    """ys, with single instances of what xs repeat as groups of one."""
    for group in (x for x in xs if x[_LABEL] == "()"):
        labels = [x[_LABEL] for x in group[_INNER]]
        n, out, i = len(labels), [], 0
        while i < len(ys):
            if [y[_LABEL] for y in ys[i : i + n]] == labels:
                out.append(["()", 0, 0, 0, ys[i : i + n], None, 0])
                i += n
            else:
                out.append(ys[i])
                i += 1
        ys = out
    return ys


def matched(xs: list[list], ys: list[list]) -> list[tuple[list | None, list | None]]:
    """Pairs of items that agree, in order, and (item, None) or (None, item) for others: those of the greatest likeness together."""
    ys, xs = _wrapped(xs, ys), _wrapped(ys, xs)
    if len(xs) == len(ys):
        like = [_likeness(x, y) for x, y in zip(xs, ys, strict=True)]
        if all(v > 1 for v in like):
            return list(zip(xs, ys, strict=True))
    out: list[tuple[list | None, list | None]] = []
    if len(xs) * len(ys) > _EXACT:  # long lists are matched by labels, longest common runs first
        for op, i, j, k, m in SequenceMatcher(None, [x[_LABEL] for x in xs], [y[_LABEL] for y in ys], False).get_opcodes():
            if op == "equal":
                out += zip(xs[i:j], ys[k:m], strict=True)
            else:
                out += [(x, None) for x in xs[i:j]] + [(None, y) for y in ys[k:m]]
        return out
    best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    like = [[_likeness(x, y) for y in ys] for x in xs]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            v = like[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + v if v else 0)
    i = j = 0
    while i < len(xs) and j < len(ys):
        v = like[i][j]
        if v and best[i][j] == best[i + 1][j + 1] + v:
            out.append((xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((xs[i], None))
            i += 1
        else:
            out.append((None, ys[j]))
            j += 1
    return out + [(x, None) for x in xs[i:]] + [(None, y) for y in ys[j:]]


def aligned(xs: list[list], ys: list[list], same_page: bool = False) -> list[list]:
    """The wrapper that covers both: mismatches become optional, agreeing repeats repeated. Parts of both become parts of it."""
    out = []
    for x, y in matched(xs, ys):
        if x is not None and y is not None:
            out.append(_merged(x, y, same_page))
        else:
            item = x if x is not None else y
            item[_OPTIONAL] = 1
            out.append(item)
    return out


def expression(w: list[list]) -> str:
    """The wrapper written as a regular expression over tags."""

    def say(x: list) -> str:
        inner = expression(x[_INNER]) if x[_INNER] is not None else ""
        return "#" if x[_SLOT] is not None else f"({inner})" if x[_LABEL] == "()" else f"<{x[_LABEL]}>{inner}</>"

    marks = lambda x: ("+" if x[_REPEATED] else "") + ("?" if x[_OPTIONAL] else "")
    return "".join((f"({say(x)})" if marks(x) and len(say(x)) > 1 and x[_LABEL] != "()" else say(x)) + marks(x) for x in w)


class Template:
    """What a host's wrapper says about its pages."""

    def __init__(self, w: list[list], pages: int):
        self.w = w
        self.least = max(COMMON, SHARED * pages)
        self.weights: dict[int, float] = {}
        self._weigh(w)
        self._mark(w)

    def _common(self, slot: list, text: int) -> bool:
        return any(t == text and n >= self.least for t, n in slot[1])

    def _menu(self, slot: list) -> bool:
        return slot[3] >= LINKS * slot[2]

    def _weigh(self, items: list[list]) -> float:
        """Characters of running text in items."""
        total = 0.0
        for x in items:
            if x[_SLOT] is not None:
                shared = sum(n for t, n in x[_SLOT][1] if n >= self.least)
                own = 0.0 if self._menu(x[_SLOT]) else x[_SLOT][2] * max(0.0, 1 - shared / x[_SLOT][5])
            else:
                own = self._weigh(x[_INNER]) if x[_KIND] >= 0 else 0.0
            self.weights[id(x)] = own
            total += own
        return total

    def _headline(self, items: list[list]) -> bool:
        return any(self.weights.get(id(x), 0) > 0 and (_tag(x) in HEADLINES or (x[_INNER] is not None and self._headline(x[_INNER]))) for x in items)

    def _mark(self, items: list[list]) -> None:
        """Mark the main region: an element, or (where none holds enough) nothing, which stands for all."""
        region, kind = None, 0
        while True:
            total = sum(self.weights[id(x)] for x in items)
            best = max(items, key=lambda x: self.weights[id(x)], default=None)
            if best is None or not total or best[_INNER] is None or best[_REPEATED] or _tag(best) in FLOW or best[_LABEL] == "()":
                break
            if self.weights[id(best)] < MAIN * total or self._headline([x for x in items if x is not best]):
                break
            region, items, kind = best, best[_INNER], max(kind, best[_KIND])
        if region is not None:
            region[_REGION] = 1
        self.whole = region is None
        # where no name says that the region is the article, it begins at its headline
        self.lead: set[int] = set()
        if kind < 1:
            for k, x in enumerate(items):
                if self._headline([x]):
                    self.lead = {id(y) for y in items[:k]}
                    break

    def main(self, texts: list[str], items: list[list]) -> list[int]:
        """The blocks of a page that are main text, in order."""
        keep: list[int] = []
        if any(self.weights[id(x)] > 0 for x in self.w):
            self._walk(self.w, items, self.whole, texts, keep)
        return sorted(keep)

    def _walk(self, xs: list[list], ys: list[list], inside: bool, texts: list[str], keep: list[int]) -> None:
        for x, y in matched(xs, ys):
            if y is None or y[_KIND] < 0 or (x is not None and id(x) in self.lead):
                continue
            if y[_SLOT] is not None:
                if inside and x is None:
                    keep += y[_SLOT][4]
                elif inside and not self._menu(x[_SLOT]):
                    keep += [k for k in y[_SLOT][4] if not self._common(x[_SLOT], zlib.crc32(texts[k].encode(errors="replace")))]
            else:
                self._walk(x[_INNER] if x is not None else [], y[_INNER], inside or (x is not None and bool(x[_REGION])), texts, keep)


def inferred(pages: list[str]) -> Template:
    """The template of some different pages of one host."""
    w: list[list] | None = None
    for page in pages:
        _, items = page_items(page)
        w = items if w is None else aligned(w, items)
    return Template(w or [], len(pages))


def main_text(page: str | None, template: Template) -> str:
    """The main text of a page, given its host's template."""
    texts, items = page_items(page or "")
    return " ".join(texts[k] for k in template.main(texts, items))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _written(name: str, part: int, pages: int, w: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([pages], pa.int64()), pa.array([json.dumps(w)])], ["host", "part", "pages", "wrapper"])


_PART = "host string, part long, pages long, wrapper string"


def _bare(items: list[list]) -> None:
    """Forget which of a page's blocks stand in the slots."""
    for x in items:
        if x[_SLOT] is not None:
            x[_SLOT][4] = []
        else:
            _bare(x[_INNER])


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages sorted by host, part and mark: a wrapper for each part, from its different pages."""
    now, mark, n = None, None, 0
    w: list[list] = []
    for b in batches:
        for name, part, its, page in zip(*(b.column(c).to_pylist() for c in ("host", "part", "mark", "html")), strict=True):
            if now is not None and now != (name, part):
                yield _written(*now, n, w)
            if now != (name, part):
                now, mark, n = (name, part), None, 0
            if its != mark:
                _, items = page_items(page)
                _bare(items)
                w = aligned(w, items) if n else items
                mark, n = its, n + 1
    if now is not None:
        yield _written(*now, n, w)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of wrappers sorted by host and part: one for each FAN parts."""
    now, n = None, 0
    w: list[list] = []
    for b in batches:
        for name, part, pages, one in zip(*(b.column(c).to_pylist() for c in ("host", "part", "pages", "wrapper")), strict=True):
            if now is not None and now != (name, part // FAN):
                yield _written(*now, n, w)
            if now == (name, part // FAN):
                w, n = aligned(w, json.loads(one)), n + pages
            else:
                now, w, n = (name, part // FAN), json.loads(one), pages
    if now is not None:
        yield _written(*now, n, w)


def _split(pages: DataFrame, url: str) -> tuple[DataFrame, int]:
    """(host, parts) of hosts with more than SPLIT pages, broadcast if they are few; and the most parts."""
    many = pages.groupBy(host(column(pages, url)).alias("host")).agg(F.ceil(F.count("*") / SPLIT).alias("parts")).where("parts > 1")
    sums = many.agg(F.count("*").alias("n"), F.max("parts").alias("most")).first()
    return (F.broadcast(many) if sums["n"] <= MAX_SPLIT_HOSTS else many), sums["most"] or 1


def _dealt(rows: DataFrame, many: DataFrame) -> DataFrame:
    """rows (host, mark) with the part of the host that they fall in."""
    return rows.join(many, "host", "left").withColumn("part", F.pmod(F.xxhash64("mark"), F.coalesce("parts", F.lit(1)))).drop("parts")


def wrappers(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """(host, part 0, pages, wrapper): each host's wrapper as JSON, and the different pages it comes from. Pages are shuffled once."""
    many, most = _split(pages, url)
    rows = pages.select(host(column(pages, url)).alias("host"), F.unhex(F.md5(column(pages, page))).alias("mark"), column(pages, page).alias("html")).where(F.length("html") > 0)
    order = ("host", "part", "mark")
    parts = _dealt(rows, many).repartition("host", "part").sortWithinPartitions(*order).select(*order, "html").mapInArrow(_inferred, _PART)
    while most > 1:
        deal = (F.col("host"), F.floor(F.col("part") / FAN))
        parts = parts.repartition(*deal).sortWithinPartitions("host", "part").mapInArrow(_joined, _PART)
        most = -(-most // FAN)
    return parts


def _texts_of(known: Broadcast | None):
    """(page_id, url, text, by_wrapper) of pages; wrappers are those known, or stand before their pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: dict[str, Template] = {}
        for b in batches:
            texts, own = [], []
            wrapper = b.column("wrapper").to_pylist() if known is None else [None] * b.num_rows
            n = b.column("pages").to_pylist() if known is None else wrapper
            for name, page, w, pages in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), wrapper, n, strict=True):
                if w is not None:
                    templates = {name: Template(json.loads(w), pages)}
                    texts.append(None)
                    own.append(False)
                    continue
                if known is not None and name not in templates and name in known.value:
                    if len(templates) >= 1000:
                        templates.clear()
                    templates[name] = Template(json.loads(known.value[name][1]), known.value[name][0])
                texts.append(main_text(page, templates[name]) if page and name in templates else "")
                own.append(bool(page) and name in templates)
            out = pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(own)], ["page_id", "url", "text", "by_wrapper"])
            yield out if known is not None else out.filter(pa.array([w is None for w in wrapper], pa.bool_()))

    return run


def extracted(pages: DataFrame, page: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, by_wrapper) for each row of pages; by_wrapper is false for pages without any content."""
    spark = pages.sparkSession
    small_batches(spark)
    found, _ = cut(wrappers(pages, page, url), "wrappers")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select(column(pages, page_id).alias("page_id"), column(pages, url).alias("url"), column(pages, page).alias("html"), host(column(pages, url)).alias("host"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, by_wrapper boolean"
    if size <= MAX_BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: (r["pages"], r["wrapper"]) for r in found.collect()})
        return rows.mapInArrow(_texts_of(known), schema)
    # each part of a host gets the wrapper before its pages
    many, _ = _split(pages, url)
    rows = _dealt(rows.withColumn("mark", F.md5("html")), many).drop("mark").withColumns({"pages": F.lit(None).cast("long"), "wrapper": F.lit(None).cast("string")})
    heads = found.drop("part").join(many, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = rows.unionByName(heads, allowMissingColumns=True)
    both = both.repartition("host", "part").sortWithinPartitions("host", "part", F.col("wrapper").isNull())
    return both.select("page_id", "url", "html", "host", "pages", "wrapper").mapInArrow(_texts_of(None), schema)


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper")
