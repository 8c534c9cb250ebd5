"""Main text of web pages by wrappers that are inferred from the pages of a host."""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A
from pricelake.llm.url_filter import host_of
from pricelake.runtime import written

#: Bytes of all wrappers that may be sent to every task; with more, pages are joined with the wrapper of their host.
BROADCAST_BYTES = 32 << 20
#: Share of a page's free text from which on its articles are the main text; with less they are cards beside it.
ARTICLE_SHARE = 0.25
#: A text that never changes is the template's if it stands on this share of its host's different pages, and if texts that
#: change on every other page would stay the same over so many pages with a chance under this level.
TEMPLATE_SHARE, LEVEL = 0.5, 0.05
#: Pages, those with the least hashes, by which shares of a host's pages are told.
SAMPLE = 16
#: Parts in which the shapes of a host's pages are merged side by side.
BUCKETS = 64
#: Distinct shapes a task gathers before it sends them on.
GATHERED = 5_000

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea title iframe select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics annotation "
    "svg g text tspan path rect circle line object param noscript".split()
)
#: Elements that end where another of the listed ones begins beside them.
ENDS = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: Elements beyond which an end is not implied.
SCOPES = frozenset("ul ol dl table div article section body".split())
DROPPED = frozenset("head nav footer aside form button dialog menu script style".split())
MAIN = frozenset(["article", "main"])
#: Elements whose names tell of the page.
WHOLE = frozenset(["html", "body"])
#: Around the main text when outside it; an article's own header holds its title.
HEADERS = frozenset("header masthead".split())
#: Words of class, id and role that mark parts around the main text.
AROUND = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer form menu modal nav navbar navigation newsletter notice notices pagination pager popup "
    "promo promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside those in a mark; with any other word the mark is about something else.
BESIDE = frozenset(
    "area aside bar block bottom box button buttons column container content contents form group icons inner items left links list main "
    "outer panel post posts right section side site slot thread top unit wrap wrapper".split()
)

# A quote opens a value only behind an equals sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(>|\Z)", re.S
)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    """A part of a page or of a wrapper.

    In a wrapper ``many`` says that it may be repeated, ``maybe`` that it may
    be missing, and a text slot has the checksum of its text (of all its texts
    on a page) where that is always the same, and the least hashes of the pages it stands on.
    """

    __slots__ = ("label", "children", "many", "maybe", "pages", "same", "text", "places")

    def __init__(self, label, children=(), many=False, maybe=False, same=None, pages=(), text=None):
        self.label, self.children, self.many, self.maybe = label, list(children), many, maybe
        self.same, self.pages, self.text, self.places = same, tuple(pages), text, None

    def preorder(self) -> list[Node]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(reversed(node.children))
        return out

    def shape(self) -> str:
        """The part without its texts, as flat JSON: labels, flags and numbers of children from the root on."""
        return json.dumps([[n.label, n.many + 2 * n.maybe, len(n.children)] for n in self.preorder()], separators=(",", ":"))

    def slots(self) -> list[Node]:
        return [n for n in self.preorder() if n.label == "#"]

    def stats(self) -> list[tuple]:
        return [(n.same, list(n.pages)) for n in self.slots()]

    def place_of(self, label: str, at: int) -> int | None:
        """The child of that label at or behind ``at``, or else the first one."""
        if self.places is None:
            self.places = {}
            for k, child in enumerate(self.children):
                self.places.setdefault(child.label, []).append(k)
        found = self.places.get(label)
        if not found:
            return None
        k = bisect.bisect_left(found, at)
        return found[k] if k < len(found) else found[0]


def unpacked(shape: str, stats: list) -> Node:
    """The wrapper of a shape and what is known of its slots."""
    slots, root, open_ = iter(stats), None, []
    for label, flags, children in json.loads(shape):
        node = Node(label, (), bool(flags & 1), bool(flags & 2), *(next(slots) if label == "#" else (None, ())))
        if root is None:
            root = node
        else:
            open_[-1][0].children.append(node)
            open_[-1][1] -= 1
        if children:
            open_.append([node, children])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


def run_steps(call):
    """Runs a generator that yields the calls it waits for, so that deep trees need no deep stack."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def parse(page: str | None) -> Node:
    """Tree of the blocks of a page; inline markup is part of the text, comments and raw elements are left out.

    A form that holds most of the page's text is a container like others.
    """
    page = page or ""
    root = Node("")
    stack, text, opened = [root], [], {}
    names = [""]

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            stack[-1].children.append(Node("#", same=zlib.crc32(joined.encode("utf-8", "replace")), text=joined))

    def close(i):
        for name in names[i:]:
            opened[name] -= 1
        del stack[i:], names[i:]

    at = 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        text.append(page[at : found.start()])
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if found.group(1):
            if opened.get(name):
                close(len(names) - 1 - names[::-1].index(name))
            continue
        for i in range(len(stack) - 1, 0, -1):
            if name in ENDS.get(names[i], ()):
                close(i)
                break
            if names[i] in SCOPES:
                break
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        marks = sorted({w for m in MARKS.finditer(found.group(3)) for w in next(filter(None, m.groups()), "").lower().split()})
        node = Node(" ".join([name, *sorted({m for m in map(without_digits, marks) if m})]))
        stack[-1].children.append(node)
        if name not in VOID and not found.group(3).endswith("/"):
            stack.append(node)
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
    flush()
    if "form" in opened:
        order, size = root.preorder(), {}
        for node in reversed(order):
            size[id(node)] = len(node.text or "") + sum(size[id(c)] for c in node.children)
        for node in order:
            if node.label.split(" ")[0] == "form" and 2 * size[id(node)] > size[id(root)]:
                node.label = "div" + node.label[4:]
    return root


def merged(a: Node, b: Node) -> Node:
    """The least wrapper of both: texts become slots, parts that only one has become optional, neighbours of one label are repeated."""
    return run_steps(_merged(a, b))


def _merged(a: Node, b: Node, along: bool = False):
    """``along`` one page texts are strung together: a slot repeated on a page is the same where all its texts are."""
    if a.label == "#":
        same = zlib.crc32(f"{a.same} {b.same}".encode()) if along else a.same if a.same == b.same else None
        pages = sorted({*a.pages, *b.pages})[:SAMPLE]
        return Node("#", (), a.many or b.many, a.maybe or b.maybe, same, pages)
    children, i, j = [], 0, 0
    pairs = common([c.label for c in a.children], [c.label for c in b.children])
    for x, y in [*pairs, (len(a.children), len(b.children))]:
        for rest in (a.children[i:x], b.children[j:y]):
            for node in rest:
                node.maybe = True
                children.append(node)
        if x < len(a.children):
            children.append((yield _merged(a.children[x], b.children[y], along)))
        i, j = x + 1, y + 1
    return Node(a.label, (yield _folded(children, along)), a.many or b.many, a.maybe or b.maybe)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in space that is linear in both.

    Equal ends are paired first.  What is left is cut in the middle of ``a``
    and where ``b`` splits best, by the lengths of common subsequences that
    one integer of as many bits as ``b`` has entries holds per half.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, x, j, y = todo.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i == x or j == y:
            continue
        if x - i == 1:
            k = next((k for k in range(j, y) if b[k] == a[i]), None)
            if k is not None:
                out.append((i, k))
            continue
        mid = (i + x) // 2
        head, tail = _lengths(a[i:mid], b[j:y]), _lengths(a[mid:x][::-1], b[j:y][::-1])
        n = y - j
        cut = max(range(n + 1), key=lambda k: head[k] + tail[n - k])
        todo += [(i, mid, j, j + cut), (mid, x, j + cut, y)]
    return sorted(out)


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``."""
    where: dict[str, int] = {}
    for k, label in enumerate(b):
        where[label] = where.get(label, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for label in a:
        hit = row & where.get(label, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for bit in reversed(f"{row:0{len(b)}b}"):
        n += bit == "0"
        out.append(n)
    return out


def _folded(children: list[Node], along: bool):
    """Neighbours of one label as one repeated group."""
    out: list[Node] = []
    for node in children:
        if out and out[-1].label == node.label:
            maybe = out[-1].maybe and node.maybe
            out[-1] = yield _merged(out[-1], node, along)
            out[-1].many, out[-1].maybe = True, maybe
        else:
            out.append(node)
    return out


def wrapper_of(page: Node) -> Node:
    """The wrapper of a single page: repeated neighbours folded from the leaves up."""
    whole = "\n".join(s.text for s in page.slots()).encode("utf-8", "replace")
    of = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "big") >> 1
    return run_steps(_wrapper_of(page, of))


def _wrapper_of(page: Node, of: int):
    if page.label == "#":
        return Node("#", same=page.same, pages=(of,))
    children = []
    for child in page.children:
        children.append((yield _wrapper_of(child, of)))
    return Node(page.label, (yield _folded(children, True)))


def named(mark: str, names: frozenset) -> bool:
    """Whether a mark names a part by one of ``names``: it has no words but these and those that may stand beside them."""
    words = [w for w in re.split(r"[-_]+", mark) if w]
    return any(w in names for w in words) and all(w in names or w in BESIDE for w in words)


@lru_cache(1 << 16)
def around(label: str, inside: bool = False) -> bool:
    """Whether a part is not main text by its element or names; ``inside`` an article headers are."""
    name, *marks = label.split(" ")
    dropped, words = (DROPPED, AROUND) if inside else (DROPPED | HEADERS, AROUND | HEADERS)
    return name in dropped or name not in WHOLE and any(named(m, words) for m in marks)


def without_digits(mark: str) -> str:
    """A mark; of one with digits only the name of a part around the main text that is left without them, others number parts."""
    if not any(c.isdigit() for c in mark):
        return mark
    words = [w.strip("0123456789") for w in re.split(r"[-_]+", mark)]
    plain = "-".join(w for w in words if w and not any(c.isdigit() for c in w))
    return plain if named(plain, AROUND | HEADERS) else ""


def slots_of(part: Node, inside: bool = False) -> list[Node]:
    """The texts of a part, without those around the main text."""
    out, stack = [], [part]
    while stack:
        node = stack.pop()
        if node.label == "#":
            out.append(node)
        stack.extend(c for c in reversed(node.children) if c.label == "#" or not around(c.label, inside))
    return out


def articles(part: Node, through: bool = False) -> list[Node]:
    """The outermost article and main elements that are not around the main text.

    ``through`` passes parts that are around it by their names alone, not by
    their element, so that a layout container hides no article.
    """
    out, stack = [], [part]
    while stack:
        node = stack.pop()
        if node.label.split(" ")[0] in MAIN:
            out.append(node)
            continue
        shut = lambda c: around(c.label) and (not through or c.label.split(" ")[0] in DROPPED | HEADERS | MAIN)
        stack.extend(c for c in reversed(node.children) if c.label != "#" and not shut(c))
    return out


def kind_of(page: Node) -> str:
    """Which alternative of its host's wrapper a page belongs to.

    ``article`` if one holds its text, ``through`` if one in a part named like
    those around the main text does and holds more than is left without such
    parts, otherwise ``free``.
    """
    free = sum(len(s.text) for s in slots_of(page))
    size = lambda through: sum(len(s.text) for a in articles(page, through) for s in slots_of(a, True))
    inside = size(False)
    if inside and inside >= ARTICLE_SHARE * free:
        return "article"
    return "through" if size(True) > free else "free"


def template_parts(wrapper: Node) -> set[int]:
    """Ids (in Python) of the parts of a wrapper of pages without articles that belong to the template.

    Slots whose text never changes, over enough pages and a share of the
    host's pages, are constant.  The varying part is the least part that
    holds all slots that vary; beside it and the parts it lies in, and among
    its own, those go that hold nothing but constant slots.
    """
    pages = sorted({p for s in wrapper.slots() for p in s.pages})[:SAMPLE]
    inside = {id(s) for s in slots_of(wrapper)}

    def constant(slot):
        shared = len(set(slot.pages) & set(pages))
        return slot.same is not None and shared >= TEMPLATE_SHARE * len(pages) and 2.0 ** (1 - len(slot.pages)) < LEVEL

    vary, fixed = {}, {}
    for node in reversed(wrapper.preorder()):
        if node.label == "#":
            fixed[id(node)] = id(node) not in inside or constant(node)
            vary[id(node)] = not fixed[id(node)]
        else:
            fixed[id(node)] = all(fixed[id(c)] for c in node.children)
            vary[id(node)] = any(vary[id(c)] for c in node.children)
    out, node = set(), wrapper
    while True:
        out |= {id(c) for c in node.children if fixed[id(c)] and not vary[id(c)]}
        down = [c for c in node.children if vary[id(c)]]
        if len(down) != 1 or down[0].label == "#":
            return out if vary[id(wrapper)] else set()
        node = down[0]


def main_slots(wrapper: Node, kind: str) -> set[int]:
    """Ids (in Python) of the slots of a wrapper that hold main text.

    Parts that are around it by element or name are left out.  In the wrapper
    of pages with an article or main element what is in it is main.  Otherwise
    it is all the rest but the parts of the template.
    """
    if kind != "free":
        return {id(s) for a in articles(wrapper, kind == "through") for s in slots_of(a, True)}
    template = template_parts(wrapper)
    gone = {id(s) for n in wrapper.preorder() if id(n) in template for s in n.slots()}
    return {id(s) for s in slots_of(wrapper)} - gone


def extract(page: Node, wrapper: Node, slots: set[int]) -> list[str]:
    """Texts of the page that stand in the given slots of its wrapper, in order."""
    out, stack = [], [(page, wrapper)]
    while stack:
        node, model = stack.pop()
        if node.label == "#":
            if id(model) in slots:
                out.append(node.text)
            continue
        below, at = [], 0
        for child in node.children:
            place = model.place_of(child.label, at)
            if place is not None:
                at = max(at, place)
                below.append((child, model.children[place]))
        stack.extend(reversed(below))
    return out


class _Gathered:
    """Shapes of pages or wrappers with what is known of their slots; equal shapes are put together."""

    def __init__(self):
        self.found: dict[tuple, list] = {}

    def add(self, key: tuple, shape: str, stats: list) -> None:
        own = self.found.setdefault((*key, shape), stats)
        if own is not stats:
            for k, ((same, pages), (other, more)) in enumerate(zip(own, stats)):
                own[k] = (same if same == other else None, sorted({*pages, *more})[:SAMPLE])

    def rows(self):
        keys = list(self.found)
        for a in range(0, len(keys), 500):
            part = keys[a : a + 500]
            shapes = [k[-1] for k in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in part], pa.string()),
                    pa.array([k[1] for k in part], pa.string()),
                    pa.array([zlib.crc32(s.encode()) % BUCKETS for s in shapes], pa.int32()),
                    pa.array(shapes, pa.string()),
                    pa.array([json.dumps(self.found[k]) for k in part], pa.string()),
                ],
                names=["host", "kind", "bucket", "shape", "stats"],
            )
        self.found = {}


_SHAPES = "host string, kind string, bucket int, shape string, stats string"


def _shapes_of_pages(batches):
    found = _Gathered()
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            tree = parse(page)
            own = wrapper_of(tree)
            found.add((host, kind_of(tree)), own.shape(), own.stats())
            if len(found.found) > GATHERED:
                yield from found.rows()
    yield from found.rows()


def _merging(keys: tuple[str, ...]):
    """Wrappers of rows with equal ``keys``, which come in order of their shapes (or parts)."""

    def run(batches):
        now, same, node = None, _Gathered(), None

        def joined():
            """The wrapper so far with the shape that has been put together last."""
            nonlocal node
            for key, stats in same.found.items():
                own = unpacked(key[-1], stats)
                node = own if node is None else merged(node, own)
            same.found = {}
            return node

        def row():
            whole = joined()
            return pa.RecordBatch.from_pydict(
                {"host": [now[0]], "kind": [now[1]], "bucket": pa.array([now[2] if len(now) > 2 else 0], pa.int32()),
                 "shape": [whole.shape()], "stats": [json.dumps(whole.stats())]}
            )

        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if now is not None and key != now:
                    yield row()
                    node = None
                now = key
                if same.found and (r["shape"],) not in same.found:
                    joined()
                same.add((), r["shape"], [tuple(s) for s in json.loads(r["stats"])])
        if now is not None:
            yield row()

    return run


def infer(pages: DataFrame) -> DataFrame:
    """(host, kind, shape, stats): the wrappers of a host, one for each kind of page, from all its pages.

    Each task puts pages of one shape together, which no order matters for.
    The shapes of a host are merged in parts, dealt by shape, and the parts in
    turn, always in the same order: however the pages are dealt to tasks, the
    wrappers are the same, and no task sees all shapes of a host.
    """
    shapes = pages.select("host", "html").mapInArrow(_shapes_of_pages, _SHAPES)
    dealt = shapes.repartition("host", "kind", "bucket").sortWithinPartitions("host", "kind", "bucket", "shape")
    parts = dealt.mapInArrow(_merging(("host", "kind", "bucket")), _SHAPES)
    whole = parts.repartition("host", "kind").sortWithinPartitions("host", "kind", "bucket")
    return whole.mapInArrow(_merging(("host", "kind")), _SHAPES).drop("bucket")


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row per page: id, url, text (blocks joined by empty lines), n_chars.

    Pages become trees of blocks.  The trees of a host, those with and those
    without an article by themselves, are aligned one by one:
    texts that differ become slots, parts that only some have optional groups,
    neighbours of one kind repeated groups.  The wrapper, a union-free regular
    expression over all pages of the host, tells which slots hold main text,
    and each page's texts in those slots are its main text.

    Cases: a NULL or empty page gives the empty text; pages without a host
    share a wrapper; a host of one page has that page as its wrapper; a cut-off
    page is read to its end, an open tag at the end dropped; pages may be
    nested to any depth and have any number of parts side by side; repeated
    rows are extracted each; an empty table gives no rows; extra columns are
    ignored.  The result does not depend on how pages are dealt to tasks.
    """
    plain = A.with_small_batches(pages).select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.col(page).alias("html")
    )
    kinds = written(infer(plain), "wrappers")
    wrappers = kinds.groupBy("host").agg(F.collect_list(F.struct("kind", "shape", "stats")).alias("wrapper"))
    size = kinds.agg(F.coalesce(F.sum(F.octet_length("shape") + F.octet_length("stats")), F.lit(0))).first()[0]
    wrapped = plain.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")

    def run(batches):
        known: dict[str, dict[str, tuple[Node, set[int]]]] = {}
        for batch in batches:
            texts = []
            packed = batch.column("wrapper")
            for i, (host, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("host", "html")))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    nodes = {w["kind"]: unpacked(w["shape"], json.loads(w["stats"])) for w in packed[i].as_py()}
                    known[host] = {kind: (node, main_slots(node, kind)) for kind, node in nodes.items()}
                tree = parse(own)
                texts.append("\n\n".join(extract(tree, *known[host][kind_of(tree)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"]
            )

    kind = plain.schema["id"].dataType.simpleString()
    found = wrapped.mapInArrow(run, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
