"""Main text of web pages through wrappers inferred per host.

A page is a tree of block tags and text slots; inline tags belong to the slot's text. Equal
neighbours fold into one repeated group. The pages of one host are aligned one after another into
its wrapper, a union-free regular expression: what all share stays, what some lack becomes an optional
group, what follows itself a repeated one, and text a slot. Two lists of children are aligned by their longest
common subsequence, in n log n steps however long they are; only what has the same open tags around it can
become one slot.

The wrapper tells of every slot whether its text is the same on different pages of the host and how
much of it is linked. With that and the page's own tags the blocks of the article are chosen.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep, small_batches
from .urlfilter import host_of

# Names of HTML elements, words that mark page furniture, and words that may follow these.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr output picture progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("applet audio button canvas datalist dialog fieldset footer form frame frameset head header iframe input legend map menu menuitem meter nav noframes noscript object optgroup option output progress script select style svg template textarea title video aside".split())
WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising alert banner banners breadcrumb breadcrumbs byline-share comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus disclaimer discussion dock donate footer footnav gdpr header hidden login masthead menu menubar menus modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup promo promos promoted promotion related reactions recommended replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toc toolbar topbar tracking widget widgets".split())
LAYOUT = frozenset("area articles bar block bottom box button buttons center column container content entries form group holder icon icons inner item items label left link links list outer panel posts right row section slot stories text thread top unit wrap wrapper zone".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}


#: Distinct pages from which on the same text in a slot counts as constant, and pages' digests held to tell that.
PAGES = 3
#: How far apart two equal tags may stand in the order of their equals to be aligned.
NEAR = 8
#: Partial wrappers of a host, by hash of the page's form: a host with a third of all pages is spread over these.
PARTS = 32

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?=[^>]*+>)(?:" + _ATTRIBUTES + r">|[^>]*+>).*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _ATTRIBUTES + ")>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NOT_NAME = re.compile(r"[^a-z0-9_-]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def _key(name: str, rest: str) -> str:
    """Tag name with its class, id and role words, digits folded."""
    if not rest or "=" not in rest and "hidden" not in rest:
        return name
    words = []
    for attribute, a, b, c in _ATTRIBUTE.findall(rest):
        value, attribute = (a or b or c).lower(), attribute.lower()
        if attribute == "style":
            value = "hidden" if "display:none" in value.replace(" ", "") else ""
        elif attribute in ("hidden", "aria-hidden"):
            value = "" if value == "false" else "hidden"
        words += [w for w in _NOT_NAME.split(_DIGITS.sub("0", value)) if w]
    return ".".join([name, *dict.fromkeys(words)])


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, lower-case name or empty for what is skipped, whether it closes, attributes) of all markup. A quote that
    is never closed stands for itself from there on, so that every character is looked at a few times only."""
    at, last, tag = 0, html.rfind(">") + 1, _TAG
    while (at := html.find("<", at)) >= 0:
        if at >= last:
            if html.startswith("<!--", at):
                yield at, len(html), "", False, ""
                return
            at += 1
            continue
        if html[at + 1] in "!?sSnNtTiI" and (m := _SKIPPED.match(html, at)):
            yield at, m.end(), "", False, ""
            at = m.end()
            continue
        m = tag.match(html, at)
        if m is None and (m := _PLAIN_TAG.match(html, at)):
            tag = _PLAIN_TAG
        if m is None:
            at += 1
            continue
        yield at, m.end(), m[2].lower(), bool(m[1]), m[3]
        at = m.end()


class _Node:
    __slots__ = ("key", "name", "shape", "plus", "children", "blocks")

    def __init__(self, key: str) -> None:
        self.key, self.name, self.shape, self.plus, self.children, self.blocks = key, key.partition(".")[0], 0, False, [], []


def _merge_blocks(old: _Node, new: _Node) -> None:
    """Blocks of a repetition into the slots of what it repeats; both have one shape."""
    stack = [(old, new)]
    while stack:
        a, b = stack.pop()
        a.blocks += b.blocks
        a.plus |= b.plus
        stack += zip(a.children, b.children, strict=True)


class Page:
    """Blocks of text of a page, its folded token stream, and the blocks of each of its slots."""

    def __init__(self, html: str) -> None:
        self.blocks: list[str] = []
        self.linked: list[int] = []
        self._shapes: dict[tuple, int] = {}
        root = _Node("page")
        stack, parts, links, in_link, at = [root], [], 0, False, 0
        opened: Counter[str] = Counter()

        def flush() -> None:
            nonlocal links
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
            parts.clear()
            if text:
                leaf = _Node("#")
                leaf.blocks = [len(self.blocks)]
                self.blocks.append(text)
                self.linked.append(min(links, len(text)))
                self._add(stack[-1], leaf)
            links = 0

        def pop() -> None:
            node = stack.pop()
            opened[node.name] -= 1
            self._add(stack[-1], node)

        for start, end, name, closes, rest in _tags(html):
            if start > at:
                parts.append(html[at:start])
                links += start - at if in_link else 0
            at = end
            if not name:
                continue
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                elif name == "a":
                    in_link = not closes
                continue
            flush()
            in_link = False
            if closes:
                if opened[name]:
                    while stack[-1].name != name:
                        pop()
                    pop()
                continue
            if name in _CLOSES_P and stack[-1].name == "p":
                pop()
            if name in _SIBLINGS:
                closed, within = _SIBLINGS[name]
                closed = closed.split()
                for i in range(len(stack) - 1 if any(opened[c] for c in closed) else 0, 0, -1):
                    if stack[i].name in within:
                        break
                    if stack[i].name in closed:
                        while len(stack) > i:
                            pop()
                        break
            stack.append(_Node(_key(name, rest)))
            opened[name] += 1
            if name in VOID or rest.endswith("/") and name in ("path", "circle", "rect"):
                pop()
        if at < len(html):
            parts.append(html[at:])
        flush()
        while len(stack) > 1:
            pop()
        self.stream, self.slots = _stream(root)

    def _add(self, to: _Node, child: _Node) -> None:
        """Append, folding a repetition of the last one to three children into them."""
        child.shape = self._shapes.setdefault((child.key, *(c.shape for c in child.children)), len(self._shapes) + 1)
        own = to.children
        own.append(child)
        for n in (1, 2, 3):
            if len(own) >= 2 * n and all(own[-i].shape == own[-i - n].shape for i in range(1, n + 1)):
                for old, new in zip(own[-2 * n : -n], own[-n:], strict=True):
                    _merge_blocks(old, new)
                    old.plus = True
                del own[-n:]
                return


def _stream(root: _Node) -> tuple[str, list[list[int]]]:
    """Tokens of a tree: ``<tag``, ``/`` and ``#`` for text, with ``+`` where repeated; and the blocks of each ``#``."""
    out, slots, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node is None:
            out.append("/")
        elif node.key == "#":
            out.append("#+" if node.plus else "#")
            slots.append(sorted(node.blocks))
        else:
            out.append(f"<{node.key}+" if node.plus else f"<{node.key}")
            stack.append(None)
            stack += reversed(node.children)
    return " ".join(out), slots


# A wrapper is a tree of nodes [tag or "#", repeated, optional, children, what is known of a slot]; the last is
# [digests of up to PAGES pages, least text hash, greatest, characters, linked characters], null in a page's own tree.
_TAG_AT, _PLUS, _OPTIONAL, _CHILDREN, _KNOWN = range(5)


def tree(stream: str, known: list | None = None) -> tuple[list, list[list]]:
    """A stream as a wrapper, and its slots; ``known`` tells of each slot in turn."""
    root: list = ["", False, False, [], None]
    stack, slots = [root], []
    for t in stream.split(" "):
        if t == "/":
            stack.pop()
            continue
        plus = t[-1] == "+"
        node = [t[0] if t[0] == "#" else t[1:-1] if plus else t[1:], plus, False, [], None]
        stack[-1][_CHILDREN].append(node)
        if t[0] == "#":
            slots.append(node)
            node[_KNOWN] = known[len(slots) - 1] if known else None
        else:
            stack.append(node)
    return root[_CHILDREN][0], slots


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of equal items: common ends, and between them the longest increasing run of pairs whose numbers
    among their equals are at most NEAR apart; that is the longest common subsequence where no item occurs more often."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    where: dict[str, list[int]] = {}
    for i in range(head, len(a) - tail):
        where.setdefault(a[i], []).append(i)
    times: dict[str, int] = {}
    ends: list[int] = []  # least end in a of a run of each length, and its last pair
    last: list[int] = []
    found: list[tuple[int, int, int]] = []  # a, b, the pair before
    for j in range(head, len(b) - tail):
        nth = times.get(b[j], 0)
        times[b[j]] = nth + 1
        for i in reversed(where.get(b[j], ())[max(0, nth - NEAR) : nth + NEAR + 1]):
            k = bisect.bisect_left(ends, i)
            found.append((i, j, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(i)
                last.append(len(found) - 1)
            else:
                ends[k], last[k] = i, len(found) - 1
    middle, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = found[at]
        middle.append((i, j))
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _known_of_both(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    return [sorted({*a[0], *b[0]})[:PAGES], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def widen(wrapper: list, other: list) -> None:
    """Widen the wrapper in place so that it also matches another one, or a page's tree. Both have one root tag."""
    stack = [(wrapper, other)]
    while stack:
        w, p = stack.pop()
        w[_PLUS] |= p[_PLUS]
        w[_OPTIONAL] |= p[_OPTIONAL]
        w[_KNOWN] = _known_of_both(w[_KNOWN], p[_KNOWN])
        old, new, out, i, j = w[_CHILDREN], p[_CHILDREN], [], 0, 0
        for x, y in [*_matched([c[0] for c in old], [c[0] for c in new]), (len(old), len(new))]:
            for group in (old[i:x], new[j:y]):
                for c in group:
                    c[_OPTIONAL] = True
                out += group
            if x < len(old):
                out.append(old[x])
                stack.append((old[x], new[y]))
            i, j = x + 1, y + 1
        w[_CHILDREN] = out


def fit(wrapper: list, page: list) -> None:
    """Tell the page's slots what the wrapper knows of them; those that it has not stay unknown."""
    stack = [(wrapper, page)]
    while stack:
        w, p = stack.pop()
        p[_KNOWN] = w[_KNOWN]
        old, new = w[_CHILDREN], p[_CHILDREN]
        stack += [(old[i], new[j]) for i, j in _matched([c[0] for c in old], [c[0] for c in new])]


def flat(wrapper: list) -> list[list]:
    """The wrapper's tokens in order, [tag, repeated, optional, known], ``/`` closes: a form without nesting, for JSON."""
    out, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        if node is None:
            out.append(["/"])
            continue
        out.append([node[_TAG_AT], int(node[_PLUS]), int(node[_OPTIONAL]), node[_KNOWN]])
        if node[_TAG_AT] != "#":
            stack.append(None)
            stack += reversed(node[_CHILDREN])
    return out


def nested(tokens: list[list]) -> list:
    root: list = ["", False, False, [], None]
    stack = [root]
    for t in tokens:
        if t[0] == "/":
            stack.pop()
            continue
        node = [t[0], bool(t[1]), bool(t[2]), [], t[3]]
        stack[-1][_CHILDREN].append(node)
        if t[0] != "#":
            stack.append(node)
    return root[_CHILDREN][0]


def expression(wrapper: list) -> str:
    """The wrapper as text: a group in parentheses, ``+`` after repeated and ``?`` after optional ones, ``#`` for text."""
    out, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        sign = "+" * node[_PLUS] + "?" * node[_OPTIONAL]
        if node[_TAG_AT] == "#":
            out.append(f"#{sign}")
        else:
            out.append(f"({node[_TAG_AT]}")
            stack.append(f"){sign}")
            stack += reversed(node[_CHILDREN])
    return " ".join(out).replace(" )", ")")


def _is_furniture(word: str) -> bool:
    """Whether a class, id or role names page furniture: as a whole, or by the last of its parts that is no word of
    layout (``site-footer``, ``comment-list``, but not ``social-history``)."""
    if word in WORDS:
        return True
    parts = [p for p in re.split("[-_]+", word) if p]
    while len(parts) > 1 and parts[-1] in LAYOUT:
        parts.pop()
    return bool(parts) and parts[-1] in WORDS


class Layout:
    """What a page's own tags and its host's wrapper say of the page's slots."""

    def __init__(self, stream: str, wrapper: list | None) -> None:
        page, slots = tree(stream)
        if wrapper is not None and wrapper[_TAG_AT] == page[_TAG_AT]:
            fit(wrapper, page)
        n = len(slots)
        #: in an element that never holds the article; in an article; in main
        self.out, self.article, self.main = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        #: (first slot, past the last, whether an article or main is in it) of elements with a furniture word, outer ones first
        self.marked: list[tuple[int, int, bool]] = []
        known = [s[_KNOWN] for s in slots]
        self.constant = np.array([k is not None and len(k[0]) >= PAGES and k[1] == k[2] for k in known], bool)
        self.linked = np.array([k[4] / max(1, k[3]) if k is not None else 0.0 for k in known])
        at, stack = 0, [page]
        first: list[tuple[str, bool, int]] = []
        while stack:
            node = stack.pop()
            if node is None:
                name, marked, start = first.pop()
                holds = bool(self.article[start:at].any() or self.main[start:at].any())
                if name in FURNITURE and not (name == "form" and holds):
                    self.out[start:at] = True
                elif name == "article" and not marked:
                    self.article[start:at] = True
                elif name == "main":
                    self.main[start:at] = True
                if marked and start < at:
                    self.marked.append((start, at, holds))
            elif node[_TAG_AT] == "#":
                at += 1
            else:
                name, *words = node[_TAG_AT].split(".")
                own = name not in ("body", "html", "page", "main") and any(map(_is_furniture, words))
                if name == "article" and own:  # an article among comments or teasers; the article itself may have any name
                    own = any(w in WORDS for w in words)
                first.append((name, own, at))
                stack.append(None)
                stack += reversed(node[_CHILDREN])
        self.marked.sort(key=lambda x: (x[0], -x[1]))

    def content(self, chars: np.ndarray) -> np.ndarray:
        """Which slots hold the article; chars: characters of each slot on this page."""
        use = ~self.out & (chars > 0)
        total = chars[use].sum()
        for a, b, holds in self.marked:
            # what holds the only article, or nearly all there is, is named so by chance
            best = use & (self.article | self.main)
            only = holds and best[a:b].any() and not best[:a].any() and not best[b:].any()
            if not only and 4 * chars[a:b][use[a:b]].sum() <= 3 * total:
                use[a:b] = False
        within = use & self.article
        if 2 * chars[within].sum() < chars[use & self.main].sum():
            within = use & self.main
        linked, least = self.linked > 0.5, 0.25
        if within.any():
            use, linked, least = within, self.linked > 0.9, 0.5
        # text that different pages share, and lists of links; but a page's text is not furniture because it has copies
        plain = chars[use & ~linked].sum()
        for drop in (use & (self.constant | linked), use & linked):
            left = chars[use & ~drop].sum()
            if left and left >= least * plain:
                return use & ~drop
        return use


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [Page(html or "") for html in batch.column("html").to_pylist()]
        columns = [pa.array([p.stream if p.blocks else None for p in pages], pa.string()), pa.array([p.slots for p in pages], pa.list_(pa.list_(pa.int32()))), pa.array([p.blocks for p in pages], pa.list_(pa.string())), pa.array([p.linked for p in pages], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), *columns], ["page_id", "url", "host", "stream", "slots", "blocks", "linked"])


_PARSED = "page_id long, url string, host string, stream string, slots array<array<int>>, blocks array<string>, linked array<int>"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host and stream in a partition what is known of its slots."""
    held: dict[tuple[str, str], list[list]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            part = [xxhash.xxh32_intdigest(k[1].encode()) % PARTS for k in held]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array(part, pa.int32()), pa.array([k[1] for k in held]), pa.array([json.dumps(v) for v in held.values()])], ["host", "part", "stream", "known"])
            held.clear()

    for batch in batches:
        for host, stream, slots, blocks, linked in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "slots", "blocks", "linked")), strict=True):
            page = xxhash.xxh64_intdigest("\n".join(blocks).encode("utf-8", "replace"))
            now = [[[page], h := xxhash.xxh64_intdigest("\n".join([blocks[b] for b in s]).encode("utf-8", "replace")), h, sum(len(blocks[b]) for b in s), sum(linked[b] for b in s)] for s in slots]
            old = held.get((host, stream))
            held[host, stream] = now if old is None else [_known_of_both(a, b) for a, b in zip(old, now, strict=True)]
        if len(held) > 2000:
            yield from out()
    yield from out()


def _infer(keys: list[str], of):
    """Rows sorted by ``keys`` -> (keys, wrapper as JSON), widened by ``of`` (row -> wrapper) in their order. One wrapper is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | {"wrapper": json.dumps(flat(wrapper))}], pa.schema([(k, pa.string() if k == "host" else pa.int32()) for k in keys] + [("wrapper", pa.string())]))

        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now == key:
                    widen(wrapper, of(row))
                else:
                    yield from out()
                    key, wrapper = now, of(row)
        yield from out()

    return run


def infer_wrappers(parsed: DataFrame) -> DataFrame:
    """Parsed pages -> (host, wrapper as JSON). Partitions fold their pages to distinct streams first; a host's streams
    are aligned in PARTS parts, in order of the streams, and the parts' wrappers with each other."""
    seen = parsed.where("stream is not null").select("host", "stream", "slots", "blocks", "linked").mapInArrow(_seen, "host string, part int, stream string, known string")
    parts = seen.repartition("host", "part").sortWithinPartitions("host", "part", "stream", "known").mapInArrow(_infer(["host", "part"], lambda r: tree(r["stream"], json.loads(r["known"]))[0]), "host string, part int, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_infer(["host"], lambda r: nested(json.loads(r["wrapper"]))), "host string, wrapper string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str | None, list | None] = {}
    layouts: dict[tuple[str | None, str], Layout] = {}
    for batch in batches:
        texts = []
        for host, wrapper, stream, slots, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "stream", "slots", "blocks")), strict=True):
            if stream is None:
                texts.append("")
                continue
            if (layout := layouts.get((host, stream))) is None:
                if len(layouts) > 5000:
                    layouts.clear()
                    wrappers.clear()
                if host not in wrappers:
                    wrappers[host] = nested(json.loads(wrapper)) if wrapper else None
                layout = layouts[host, stream] = Layout(stream, wrappers[host])
            use = layout.content(np.array([sum(len(blocks[b]) for b in s) for s in slots], np.int64))
            texts.append("\n".join([blocks[b] for b in sorted(b for s, ok in zip(slots, use.tolist(), strict=True) if ok for b in s)]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), one row per row.

    A null or empty html, or one without text, has an empty text; any other page has some unless all its text is
    in elements that never hold the article. Urls without a host share one wrapper. Whole pages are
    read; equal pages, repeated rows among them, count once where texts of a slot are compared. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    parsed = keep(rows.select("page_id", "url", "host", "html").mapInArrow(_parsed, _PARSED), "parsed")
    wrappers = keep(infer_wrappers(parsed), "wrappers")
    return parsed.join(wrappers, "host", "left").select("page_id", "url", "host", "stream", "slots", "blocks", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
