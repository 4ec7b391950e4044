"""Main text of HTML pages by wrapper induction.

The pages of a host are aligned by simple tree matching into one tree, the wrapper.
Where its text is the same on the pages, or one of few texts that come back, it is template;
where it varies from page to page it is content. The content slot is the host's article or main
element, or else the innermost element that holds nearly all of the text outside links. All that is in it stays but
template, its headings in any case. Beside an article or main element only headings stay; beside
another slot also what varies and isn't mostly links. What varies in the content slot as
articles do, as comments, the wrapper
can't tell: elements that by a fixed list of tags, classes, ids and roles are such are left
out in any case. Only on hosts without a content slot, as those with few pages, a page's
article or main element tells where the content is.

Pages of a host with the same main text are copies and count once. So the pages' trees
are dealt out by host and digest of the text. Wrappers are merged like sums, in parts
first, so that neither pages nor the wrappers of a large host meet in one task.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .html_tree import Element, blocks, parse
from .url_filters import host_of
from .util import Tables
from .words import chunks, text_buffer

#: Text is template only if it is the same in so many pages, and in so large a share of the host's pages; pages with the same main text are one.
LEAST_PAGES = 8
LEAST_SHARE = 0.5
#: A slot with several texts is template if they are at most so many, and each is on LEAST_PAGES pages on average.
MOST_TEXTS = 8
#: The content slot has at least so large a share of the characters outside links, on so large a share of the pages.
CONTENT_SHARE = 0.9
#: Parts in which the pages of a host are merged, then the wrappers of those parts, before all of a host meet.
PARTS = (512, 16)
#: Cells of a table in which children are matched at once.
TABLE_CELLS = 4 << 20
#: Bytes of trees that a task passes on at once; digests by which it knows pages again.
TREE_BYTES = 4 << 20
TASK_DIGESTS = 200_000
#: Wrappers of all hosts are broadcast up to so many bytes, else joined by host.
BROADCAST_BYTES = 32 << 20

# fixed values: elements, and whole classes, ids and roles, that mark what isn't the main text; those of WHOLE are judged by their tag alone
OTHER = frozenset("head nav footer aside form script style noscript template iframe object svg button select textarea title noembed noframes dialog menu".split())
MAIN = frozenset("article main".split())
WHOLE = MAIN | {"html", "body"}
_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu modal nav navbar navigation newsletter notice notices popup promo promotion related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_ROLES = frozenset("banner navigation contentinfo complementary search dialog alert".split())
_KIND = re.compile(r"^(class|id|role):")

#: More texts than MOST_TEXTS.
VARIES = ()
#: The digest of no text, and the mark of slots that are left out with all that is in them.
NONE, OUT = 0, -1
#: Elements that don't hold a whole main text, and those that stay beside the one that does.
PARTIAL = frozenset("p ul ol dl li dt dd table tbody thead tr td th blockquote pre figure a b i em strong span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# A node of a wrapper: signature, ascending digests of its own texts (or VARIES), pages, children, page elements (in a wrapper: True if varying text below was cut, or None).
# MASS, LINKS: characters of its own text outside and inside links.
SIGN, TEXT, PAGES, KIDS, MEMBERS, MASS, LINKS = range(7)


def is_other(x: Element) -> bool:
    return x.tag in OTHER or bool(x.names and x.tag not in WHOLE and is_marked(x.names))


def is_marked(names: str) -> bool:
    """Whether a class or id as a whole is one of the words, or a role one of the roles."""
    kind = ""
    for name in names.split():
        found = _KIND.match(name)
        if found:
            kind, name = found[1], name[found.end() :]
        if name in (_ROLES if kind == "role" else _WORDS):
            return True
    return False


def collapsed(members: list[Element], linked: bool = False) -> list:
    """Elements of one signature as a node; their children in turn, neighbours of one signature together."""
    linked = linked or members[0].tag == "a" or members[0].tag in OTHER
    text = " ".join(" ".join(k.split()) for m in members for k in m.kids if isinstance(k, str)).strip()
    groups: list[list[Element]] = []
    for m in members:
        for k in m.kids:
            if isinstance(k, str):
                continue
            if groups and groups[-1][0].tag == k.tag and groups[-1][0].sign == k.sign:
                groups[-1].append(k)
            else:
                groups.append([k])
    return [members[0].sign, ((xxhash.xxh64_intdigest(text) >> 1) or 1 if text else NONE,), 1, [collapsed(g, linked) for g in groups], members, 0 if linked else len(text), len(text) if linked else 0]


def matching(a: list, b: list) -> int:
    """Simple tree matching: the largest number of node pairs that keep parents and order."""
    if a[SIGN] != b[SIGN]:
        return 0
    x, y = a[KIDS], b[KIDS]
    if not x or not y:
        return 1
    begin, end = _ends(x, y)
    first, last = x[:begin], x[len(x) - end :]
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    return 1 + sum(map(size, first)) + sum(map(size, last)) + (int(_last_row(x, y)[-1]) if x and y else 0)


class _Weights:
    """Matchings of children with those of the same sign, each pair of shapes once."""

    def __init__(self, x: list, y: list):
        self.x, self.y, self.known = x, y, {}
        self.places: dict[str, list[int]] = {}
        for j, q in enumerate(y):
            self.places.setdefault(q[SIGN], []).append(j)
        shapes: dict[tuple, int] = {}

        def shape(n: list) -> int:
            return shapes.setdefault((n[SIGN], *map(shape, n[KIDS])), len(shapes))

        self.shape_x, self.shape_y = list(map(shape, x)), list(map(shape, y))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pair(self, i: int, j: int) -> int:
        key = self.shape_x[i], self.shape_y[j]
        if key not in self.known:
            self.known[key] = matching(self.x[i], self.y[j])
        return self.known[key]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in y that child i can go with, and what each brings."""
        own = self.shape_x[i]
        if own not in self.rows:
            at = self.places.get(self.x[i][SIGN], [])
            self.rows[own] = np.array(at, np.int64), np.array([self.pair(i, j) for j in at], np.int32)
        return self.rows[own]


def _rows(weights: _Weights, order: range, low: int, high: int) -> Iterator[np.ndarray]:
    """Best sums with the children in `order`, one after the other, and y from `low` up to each place below `high`; from the end where the order goes down."""
    n, back = high - low, order.step < 0
    best = np.zeros(n + 1, np.int32)
    yield best
    for i in order:
        at, gain = weights.row(i)
        a, b = np.searchsorted(at, [low, high])
        at, gain = at[a:b] - low, gain[a:b]
        if back:
            at = n - 1 - at
        new = best.copy()
        if len(at):
            new[at + 1] = np.maximum(new[at + 1], best[at] + gain)
            new = np.maximum.accumulate(new)
        best = new
        yield best


def _last_row(x: list, y: list) -> np.ndarray:
    for best in _rows(_Weights(x, y), range(len(x)), 0, len(y)):
        pass
    return best


def _pairs(weights: _Weights, top: int, bottom: int, low: int, high: int) -> list[tuple[int, int]]:
    """A best matching of children from top to bottom with those from low to high. Above TABLE_CELLS it is put together from halves, so that memory stays small."""
    if top == bottom or low == high:
        return []
    if bottom - top > 1 and (bottom - top) * (high - low) > TABLE_CELLS:
        middle = (top + bottom) // 2
        for above in _rows(weights, range(top, middle), low, high):
            pass
        for below in _rows(weights, range(bottom - 1, middle - 1, -1), low, high):
            pass
        cut = low + int(np.argmax(above + below[::-1]))
        return _pairs(weights, top, middle, low, cut) + _pairs(weights, middle, bottom, cut, high)
    best = list(_rows(weights, range(top, bottom), low, high))
    out = []
    i, j = bottom - top, high - low
    while i and j:
        p, q = top + i - 1, low + j - 1
        if weights.x[p][SIGN] == weights.y[q][SIGN] and best[i][j] == best[i - 1][j - 1] + weights.pair(p, q):
            i, j = i - 1, j - 1
            out.append((p, q))
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def alike(a: list, b: list) -> bool:
    """Whether two trees have the same shape and signatures."""
    return a[SIGN] == b[SIGN] and len(a[KIDS]) == len(b[KIDS]) and all(map(alike, a[KIDS], b[KIDS]))


def _ends(x: list, y: list) -> tuple[int, int]:
    """How many children at the beginning and at the end are alike: matched with each other they are part of a best matching, so only the rest needs a table."""
    most, i, j = min(len(x), len(y)), 0, 0
    while i < most and alike(x[i], y[i]):
        i += 1
    while j < most - i and alike(x[-1 - j], y[-1 - j]):
        j += 1
    return i, j


def aligned(x: list, y: list) -> Iterator[tuple[list | None, list | None]]:
    """The children of two matched nodes in order, each with its partner or None."""
    begin, end = _ends(x, y)
    yield from zip(x[:begin], y[:begin])
    last = list(zip(x[len(x) - end :], y[len(y) - end :]))
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    i = j = 0
    for p, q in [*(_pairs(_Weights(x, y), 0, len(x), 0, len(y)) if x and y else ()), (len(x), len(y))]:
        yield from ((k, None) for k in x[i:p])
        yield from ((None, k) for k in y[j:q])
        if p < len(x):
            yield x[p], y[q]
        i, j = p + 1, q + 1
    yield from last


def size(node: list) -> int:
    return 1 + sum(map(size, node[KIDS]))


def mass(node: list) -> int:
    return node[MASS] + sum(map(mass, node[KIDS]))


def links(node: list) -> int:
    return node[LINKS] + sum(map(links, node[KIDS]))


def together(a: tuple, b: tuple) -> tuple:
    """The texts of two slots as one."""
    if a == b or not a or not b:
        return a and b
    both = sorted({*a, *b})
    return tuple(both) if len(both) <= MOST_TEXTS else VARIES


def merged(a: list, b: list) -> list:
    """One wrapper for the pages of both."""
    kids = [merged(p, q) if p and q else (p or q) for p, q in aligned(a[KIDS], b[KIDS])]
    return [a[SIGN], together(a[TEXT], b[TEXT]), a[PAGES] + b[PAGES], kids, a[MEMBERS] or b[MEMBERS], a[MASS] + b[MASS], a[LINKS] + b[LINKS]]


def bare(node: list) -> list:
    return [node[SIGN], node[TEXT], node[PAGES], [bare(k) for k in node[KIDS]], None, node[MASS], node[LINKS]]


def nodes(node: list) -> Iterator[list]:
    yield node
    for k in node[KIDS]:
        yield from nodes(k)


def least_pages(pages: int) -> float:
    """In so many pages of a host's a node must be to be template."""
    return max(LEAST_PAGES, LEAST_SHARE * pages)


def possible(wrapper: list, pages: int) -> list:
    """Without the nodes that can't be template any more, whatever the rest of the host's pages holds.

    Nodes under which varying text is cut are marked as such in MEMBERS, for `template`.
    """
    least = least_pages(pages) - (pages - wrapper[PAGES])
    if least <= 1:
        return wrapper

    def cut(n: list) -> list:
        kept, gone = [k for k in n[KIDS] if k[PAGES] >= least], [k for k in n[KIDS] if k[PAGES] < least]
        lost = n[MEMBERS] or any(map(varying, gone))
        return [n[SIGN], n[TEXT], n[PAGES], [cut(k) for k in kept], lost or None, n[MASS] + sum(map(mass, gone)), n[LINKS] + sum(map(links, gone))]

    return cut(wrapper)


def varying(node: list) -> bool:
    """Whether text varies in the node of a wrapper or below."""
    return any(len(n[TEXT]) != 1 or n[MEMBERS] for n in nodes(node))


def tag_of(node: list) -> str:
    return node[SIGN].partition(".")[0]


def content_path(wrapper: list) -> list[list]:
    """The nodes from the root to the content slot; only the root if there is none."""
    path = [wrapper]
    while True:
        at = path[-1]
        best = max(at[KIDS], key=mass, default=None)
        if tag_of(at) in MAIN or best is None or tag_of(best) in PARTIAL | HEADINGS | OTHER or best[PAGES] < CONTENT_SHARE * wrapper[PAGES] or mass(best) < CONTENT_SHARE * max(1, mass(at)):
            return path
        path.append(best)


def template(wrapper: list) -> list | None:
    """The wrapper with the digests of template texts in its nodes, OUT in those beside the content slot that aren't content, VARIES elsewhere; None if nothing is template.

    MEMBERS of the root tells whether there is a content slot within the page's body. Where
    nothing varies the pages are copies of each other, and nothing counts as template.
    """
    pages = wrapper[PAGES]
    known = False
    path = content_path(wrapper)
    found = path[-1][SIGN] and tag_of(path[-1]) not in ("html", "body") and varying(path[-1])
    inside = {id(n) for n in path} if found else set()
    named = tag_of(path[-1]) in MAIN

    def other(n: list) -> bool:
        """Of what is beside the slot: anything but headings if the slot is named as the content, else what is mostly links."""
        return tag_of(n) not in HEADINGS and (named or links(n) > mass(n))

    def mark(n: list, varies: bool, slot: bool) -> list:
        nonlocal known
        tag = tag_of(n)
        slot = slot or (bool(found) and n is path[-1])
        if tag in MAIN or tag == "body":
            varies = varying(n)
        text = n[TEXT]
        few = varies and any(text) and n[PAGES] >= max(least_pages(pages), LEAST_PAGES * len(text)) and not (slot and tag in HEADINGS)
        known = known or few
        beside = id(n) in inside and n is not path[-1]
        kids = [[k[SIGN], (OUT,), k[PAGES], [], None, 0, 0] if beside and id(k) not in inside and other(k) else mark(k, varies, slot) for k in n[KIDS]]
        return [n[SIGN], text if few else VARIES, n[PAGES], kids, None, 0, 0]

    out = mark(wrapper, False, False)
    out[MEMBERS] = True if found else None
    return out if known or found else None


def template_elements(page: list, wrapper: list, found: set[int]) -> set[int]:
    """id() of the page's elements whose own text is template, by aligning it with the wrapper."""
    if wrapper[TEXT] == (OUT,):
        found.update(id(m) for n in nodes(page) for m in n[MEMBERS])
        return found
    if page[TEXT][0] != NONE and page[TEXT][0] in wrapper[TEXT]:
        found.update(id(m) for m in page[MEMBERS])
    for p, w in aligned(page[KIDS], wrapper[KIDS]):
        if p and w:
            template_elements(p, w, found)
    return found


def main_text(page: str | None, wrapper: list | None = None) -> str:
    """The blocks of the main text, joined by line breaks; the wrapper is a result of `template`."""
    root = parse(page or "")
    silent = template_elements(collapsed([root]), wrapper, set()) if wrapper else set()
    return "\n".join(main_blocks(root, silent, bool(wrapper and wrapper[MEMBERS])))


def main_blocks(root: Element, silent: set[int], slot: bool = False) -> Iterator[str]:
    """The blocks that count; with `slot` the wrapper has told where the content is."""
    return (b for part in (not slot and _main(root)) or [root] for b in blocks(part, is_other, silent))


def _main(root: Element) -> list[Element]:
    """The outermost article or main elements that aren't part of something else."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag in MAIN and not is_other(x):
            found.append(x)
        elif not is_other(x):
            todo.extend(reversed(x.elements()))
    return found


def induce(pages: DataFrame, tables: Tables, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (host, wrapper): the template of every host that has one, as written bytes."""
    schema = "host string, part int, digest binary, pages long, wrapper binary"

    def rows(held: list[tuple[str, int, bytes | None, int, bytes]]) -> pa.RecordBatch:
        kinds = pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held), kinds)], names=["host", "part", "digest", "pages", "wrapper"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known: set[tuple[str, bytes]] = set()
        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"]):
                root = parse(page.as_py() or "")
                digest = xxhash.xxh128_digest("\n".join(main_blocks(root, set())))
                if (host, digest) in known:
                    continue
                if len(known) >= TASK_DIGESTS:
                    known.clear()
                known.add((host, digest))
                held.append((host, int.from_bytes(digest[:4]) % PARTS[0], digest, 1, pickle.dumps(bare(collapsed([root])))))
                size += len(held[-1][-1])
                if size >= TREE_BYTES:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One wrapper for the rows of a host in a task, in a part of the next round; repeated digests follow each other."""
        host, own, part, last = None, None, 0, None
        for batch in batches:
            for h, p, digest, blob in zip(batch["host"].to_pylist(), batch["part"].to_pylist(), batch["digest"].to_pylist(), batch["wrapper"]):
                if own is not None and h == host:
                    if digest is None or digest != last:
                        own, last = merged(own, pickle.loads(blob.as_py())), digest
                    continue
                if own is not None:
                    yield rows([(host, part, None, own[PAGES], pickle.dumps(own))])
                host, own, part, last = h, pickle.loads(blob.as_py()), p % PARTS[1], digest
        if own is not None:
            yield rows([(host, part, None, own[PAGES], pickle.dumps(own))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, None
        for batch in batches:
            for h, total, blob in zip(batch["host"].to_pylist(), batch["total"].to_pylist(), batch["wrapper"]):
                if total < LEAST_PAGES:
                    continue
                new = pickle.loads(blob.as_py())
                if h != host:
                    host, own = h, None
                own = possible(merged(own, new) if own else new, total)
                found = template(own) if own[PAGES] == total else None
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([pickle.dumps(found)], pa.binary())], names=["host", "wrapper"])

    parts = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(learn, schema)
    for _ in PARTS:
        parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", "digest", "wrapper").mapInArrow(merge, schema)
    whole = parts.withColumn("total", F.sum("pages").over(W.partitionBy("host"))).sortWithinPartitions("host", "wrapper").mapInArrow(finish, "host string, wrapper binary")
    return tables.write(whole, "wrappers")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", tables: Tables | None = None) -> DataFrame:
    """Rows (key, url, text, n_chars) for every page.

    Null pages are empty and have an empty text. Pages without a host, null URLs
    included, share a wrapper. Repeated rows get a row each.
    """
    tables = tables or Tables(pages.sparkSession)
    wrappers = induce(pages, tables, url, html)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    kinds = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` {pages.schema[url].dataType.simpleString()}, text string, n_chars long"
    small = size <= BROADCAST_BYTES
    if small:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
    else:
        rows = rows.join(wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple[bytes, list]] = {}

        def wrapper(host: str, blob: bytes | None) -> list | None:
            if blob is None:
                return None
            if host not in read:
                if len(read) >= 1000:
                    read.clear()
                read[host] = pickle.loads(blob)
            return read[host]

        for whole in batches:
            for i, j in chunks(text_buffer(whole["html"])[1], 1 << 22):
                batch = whole.slice(i, j - i)
                hosts = batch["host"].to_pylist()
                blobs = [known.value.get(h) for h in hosts] if small else batch["wrapper"].to_pylist()
                texts = [main_text(p.as_py(), wrapper(h, b)) for p, h, b in zip(batch["html"], hosts, blobs)]
                yield pa.RecordBatch.from_arrays([batch[key], batch[url], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return rows.mapInArrow(run, kinds)
