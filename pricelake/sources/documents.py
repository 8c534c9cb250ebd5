"""Items and header fields of JSON documents of any size, without reading one in one task.

A document is read in pieces that end with a closing brace, split freely like
lines.  A first read makes one small summary per file block: how many quotes
stand in it, and by how much the depth changes should it start outside or
inside a string.  Summed up over the blocks of a file they tell the state in
which each block starts, and a second read cuts the items out where they
stand.  Only what lies at the edges of blocks, an item at most, travels.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricelake.runtime import written
from pricelake.schemas import JSON_HEADER, JSON_ITEMS_KEY

# Executors need not have this package installed: what they run is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Blocks whose states are sent to all tasks: about 64 MB, which stand for 256 TB of text in blocks of 128 MB.
SENT_BLOCKS = 2_000_000
#: Rows of results handed back at once, and the bytes from which on they are.
OUT_ROWS, OUT_BYTES = 10_000, 8 << 20

ITEM, INCOMPLETE, PREFIX, SUFFIX, WHOLE, KEY, FIELD = "item", "incomplete", "prefix", "suffix", "whole", "key", "field"
_CUT = "block_no long, at long, kind string, key string, item string, edge string"
_CUT_NAMES = ["block_no", "at", "kind", "key", "item", "edge"]
_QUOTE, _OPEN, _CLOSE, _ESCAPE = (ord(c) for c in '"{}\\')
_HEADER_NAMES = frozenset(JSON_HEADER.names)
# A string outside items, and whether it is a key.
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)', re.S)
_SPACE = re.compile(r"\s*")


def quotes_of(text: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped."""
    places = np.flatnonzero(text == _QUOTE)
    escapes = np.zeros(len(places), np.int64)
    back = 1
    going = (places >= back) & (text[places - back] == _ESCAPE) if len(places) else np.zeros(0, bool)
    while going.any():
        escapes[going] += 1
        back += 1
        going &= places >= back
        going[going] = text[places[going] - back] == _ESCAPE
    return places[escapes % 2 == 0]


def braces_of(text: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the braces outside strings, and whether each opens (1) or closes (-1)."""
    places = np.flatnonzero((text == _OPEN) | (text == _CLOSE))
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, np.where(text[places] == _OPEN, 1, -1)


def _joined(values: pa.Array) -> bytes:
    """Pieces with the braces that end them."""
    pieces = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.binary()))
    return pc.binary_join(pieces, b"}")[0].as_py() + b"}"


def runs(keys: list[np.ndarray | list]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal keys."""
    n = len(keys[0])
    changed = np.zeros(n, bool)
    for k in keys:
        k = np.asarray(k)
        changed[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.flatnonzero(changed).tolist(), n]
    return zip(cuts[:-1], cuts[1:])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: parity of its quotes, and by how much the depth changes should it start outside or inside a string."""
    now, quotes, steps = None, 0, [0, 0]

    def row():
        values = [*now, quotes, *steps]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in values], names=["file_key", "source_block", "quotes", "step_0", "step_1"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file_key").to_numpy(), batch.column("source_block").to_numpy()
        for a, b in runs([file, block]):
            key = (int(file[a]), int(block[a]))
            if key != now:
                if now is not None:
                    yield row()
                now, quotes, steps = key, 0, [0, 0]
            text = np.frombuffer(_joined(batch.column("value").slice(a, b - a)), np.uint8)
            own = quotes_of(text)
            # quotes so far turn the state in which the next part starts
            for p in (0, 1):
                steps[p] += int(braces_of(text, own, bool((p + quotes) % 2))[1].sum())
            quotes = (quotes + len(own)) % 2
    if now is not None:
        yield row()


def with_file_keys(rows: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` of files with a number ``file_key`` for their ``file``, and (file, file_key) of all files.

    A number is sent to Python with each row where a path would be longer than
    the row.  No two files have the same: another salt is taken if they would.
    ``files`` has the ``file`` of all; without it the rows are read for that.
    """
    files = (rows if files is None else files).select("file").distinct()
    for salt in itertools.count():
        keyed = files.select("file", F.xxhash64(F.lit(salt), "file").alias("file_key"))
        if keyed.agg(F.count_distinct("file") == F.count_distinct("file_key")).first()[0]:
            return rows.withColumn("file_key", F.xxhash64(F.lit(salt), "file")), keyed


def block_states(pieces: DataFrame) -> DataFrame:
    """(block_no, file_key, file, source_block, inside, depth, first, last) of every block: the state in which it starts.

    Blocks of a file are summed up in order: quotes so far tell which of its
    two sums of steps a block has.
    """
    return _block_states(*with_file_keys(pieces))


def _block_states(pieces: DataFrame, files: DataFrame) -> DataFrame:
    blocks = pieces.select("file_key", "source_block", "value").mapInArrow(
        _summaries, "file_key long, source_block long, quotes long, step_0 long, step_1 long"
    )
    blocks = blocks.join(files, "file_key")
    in_file = Window.partitionBy("file").orderBy("source_block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    known = blocks.withColumn("inside", inside).withColumn("step", F.when(F.col("inside"), F.col("step_1")).otherwise(F.col("step_0")))
    states = known.select(
        F.monotonically_increasing_id().alias("block_no"),
        "file_key",
        "file",
        "source_block",
        "inside",
        F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
        F.lag("source_block").over(in_file).isNull().alias("first"),
        F.lead("source_block").over(in_file).isNull().alias("last"),
    )
    return written(states, "blocks")


class _Block:
    """One block, read part by part; gives rows (block_no, at, kind, key, item, edge), or batches of them."""

    def __init__(self, block_no, inside: bool, depth: int, first: bool, last: bool, base: int, items: bool):
        self.no, self.inside, self.depth, self.last = block_no, inside, depth, last
        self.base, self.items = base, items
        #: Text since the last item's end, and where in the block it begins; where in it the open item starts.
        self.pending, self.at, self.item = [], 0, None
        self.key = None
        #: Before the first item's end the text belongs to the edge, unless the file starts here.
        self.edge = not first

    def add(self, text: bytes, ends: bool) -> Iterator[tuple]:
        """The next part; ``ends`` where it is the block's last one."""
        if ends and self.last:
            text = text[:-1]  # no brace follows the last piece of a file
        data = np.frombuffer(text, np.uint8)
        quotes = quotes_of(data)
        places, steps = braces_of(data, quotes, self.inside)
        depths = self.depth + np.cumsum(steps)
        self.inside ^= bool(len(quotes) % 2)
        start, size = 0, sum(map(len, self.pending))
        marks = np.flatnonzero(((steps < 0) & (depths == self.base)) | ((steps > 0) & (depths == self.base + 1)))
        places, steps, last_depth = places[marks], steps[marks], int(depths[-1]) if len(depths) else self.depth
        done = 0
        while done < len(places):
            if not done % 2 and self.item is None and not self.edge and not self.pending:
                # whole items without anything but punctuation before them
                many = self._plain(places[done:], steps[done:], quotes, start)
                if many:
                    ends_at = places[done + 1 : done + 2 * many : 2]
                    yield self._items(text, np.concatenate([[start], ends_at[:-1] + 1]), places[done : done + 2 * many : 2], ends_at + 1)
                    self.at += int(ends_at[-1]) + 1 - start
                    start, done = int(ends_at[-1]) + 1, done + 2 * many
                    continue
            place, step = int(places[done]), int(steps[done])
            done += 1
            if step > 0:
                self.item = size + place - start if self.item is None else self.item
                continue
            if self.item is None and not self.edge:
                continue  # the brace that closes the document
            whole = b"".join([*self.pending, text[start : place + 1]])
            yield from self._segment(whole)
            self.at += len(whole)
            self.pending, self.item, start, size = [], None, place + 1, 0
        self.depth = last_depth
        if start < len(text):
            self.pending.append(text[start:])
        if ends:
            rest = b"".join(self.pending)
            if self.edge:
                yield self.no, self.at, WHOLE if not self.last else PREFIX, None, None, _told(rest)
            elif not self.last:
                yield self.no, self.at, SUFFIX, None, None, _told(rest)
            else:
                yield from segment_rows(self.no, self.at, rest, self.item, self.base, self, self.items)

    def _plain(self, places: np.ndarray, steps: np.ndarray, quotes: np.ndarray, start: int) -> int:
        """How many of the next items begin and end in order and have no string in front of them."""
        n = len(places) // 2
        opens, closes = places[0 : 2 * n : 2], places[1 : 2 * n : 2]
        before = np.concatenate([[start], closes[:-1]]) if n else closes
        fine = (steps[0 : 2 * n : 2] > 0) & (steps[1 : 2 * n : 2] < 0)
        fine &= np.searchsorted(quotes, opens) == np.searchsorted(quotes, before)
        return n if fine.all() else int(fine.argmin())

    def _items(self, text: bytes, begins: np.ndarray, opens: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """Rows of items that lie one behind the other; a segment begins where the item before ends."""
        n = len(opens) if self.items else 0
        bounds = np.empty(2 * n + 1, np.int64)
        bounds[0 : 2 * n : 2], bounds[1::2], bounds[2 * n] = begins[:n], opens[:n], ends[-1]
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
        found = parts.take(pa.array(np.arange(1, 2 * n, 2))).cast(pa.large_string(), safe=False).cast(pa.string())
        same = lambda value, kind: pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)
        return pa.RecordBatch.from_arrays(
            [
                same(self.no, pa.int64()), pa.array(self.at + (begins[:n] - begins[0])), same(ITEM, pa.string()),
                same(self.key, pa.string()), found, pa.nulls(n, pa.string()),
            ],
            names=_CUT_NAMES,
        )

    def _segment(self, whole: bytes) -> Iterator[tuple]:
        if self.edge:
            self.edge = False
            yield self.no, self.at, PREFIX, None, None, _told(whole)
        else:
            yield from segment_rows(self.no, self.at, whole, self.item, self.base, self, self.items, True)


def _told(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def segment_rows(block_no, at, whole: bytes, item: int | None, base: int, holder, items: bool, ended: bool = False) -> Iterator[tuple]:
    """Rows of the text between two items and the item behind it: keys and header fields, then the item or that it breaks off.

    ``holder.key`` is the key under which the item before stood, if known.
    """
    lead = whole if item is None else whole[:item]
    if base and b'"' in lead:
        text = _told(lead)
        after = 0
        for found in _STRING.finditer(text):
            if found.start() < after or not found.group(2):
                continue
            holder.key = found.group(1)
            yield block_no, at + found.start(), KEY, holder.key, None, None
            if holder.key in _HEADER_NAMES:
                begin = _SPACE.match(text, found.end()).end()
                try:
                    after = json.JSONDecoder(strict=False).raw_decode(text, begin)[1]
                except ValueError:
                    continue
                yield block_no, at + found.start(), FIELD, holder.key, text[begin:after], None
    if items and item is not None:
        if ended:
            yield block_no, at, ITEM, holder.key, _told(whole[item:]), None
        else:
            yield block_no, at, INCOMPLETE, holder.key, None, None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_CUT_NAMES)


def _handed(rows: Iterator[tuple | pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, and batches as they are."""
    out, size = [], 0
    for row in rows:
        if isinstance(row, pa.RecordBatch):
            yield row
            continue
        out.append(row)
        size += sum(len(c) for c in row if isinstance(c, str))
        if len(out) >= OUT_ROWS or size >= OUT_BYTES:
            yield _table(out)
            out, size = [], 0
    if out:
        yield _table(out)


def _cutting(base: int, items: bool):
    def rows(batches):
        block, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("block_no").to_numpy()
            for a, b in runs([numbers]):
                number, state = int(numbers[a]), batch.column("state")[a].as_py()
                text = _joined(batch.column("value").slice(a, b - a))
                if block is None or block.no != number:
                    if held is not None:
                        yield from block.add(held, True)
                    # inside, depth, first, last
                    begins = (bool(state & 4), state >> 3, bool(state & 2), bool(state & 1))
                    block, held = _Block(number, *begins, base, items), None
                if held is not None:
                    yield from block.add(held, False)
                held = text
        if held is not None:
            yield from block.add(held, True)

    return lambda batches: _handed(rows(batches))


class _NoKey:
    """What is known of the key before a chain of edges."""

    key = None


def _chain(parts: list[dict], base: int, items: bool) -> Iterator[tuple]:
    """Rows of the joined texts of edges that follow each other, and the block in which they end."""
    text = "".join(p["edge"] for p in parts).encode()
    data = np.frombuffer(text, np.uint8)
    places, steps = braces_of(data, quotes_of(data), False)
    # a chain begins behind an item, or where the document does
    depths = (0 if parts[0]["first"] and parts[0]["at"] == 0 else base) + np.cumsum(steps)
    starts = places[(steps > 0) & (depths == base + 1)]
    ended = len(depths) > 0 and steps[-1] < 0 and int(depths[-1]) == base
    item = int(starts[0]) if len(starts) else None
    for row in segment_rows(parts[0]["block_no"], parts[0]["at"], text, item, base, _NoKey(), items, ended):
        yield *row, parts[-1]["block_no"]


def _edges(base: int, items: bool):
    """Edges in order to the rows of their chains."""

    def run(batches):
        key, parts = None, []

        def rows():
            found = list(_chain(parts, base, items)) if parts else []
            if found:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[*_CUT_NAMES, "end_no"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["file"], row["chain"]) != key:
                    yield from rows()
                    key, parts = (row["file"], row["chain"]), []
                parts.append(row)
        yield from rows()

    return run


def _cut(pieces: DataFrame, in_object: bool, items: bool, files: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Items and notes (keys and fields) in ``pieces`` (block_no, at, kind, key, item, end_no), the states of their blocks, and whether files have several."""
    base = 1 if in_object else 0
    pieces, files = with_file_keys(pieces, files)
    states = _block_states(pieces, files)
    blocks, whole = states.agg(F.count("*"), F.count_if(F.col("first") & F.col("last"))).first()
    packed = sum((F.col(c).cast("int") * w for c, w in (("inside", 4), ("first", 2), ("last", 1))), F.col("depth") * 8)
    state = ("block_no", "state")
    begins = states.select("file_key", "source_block", "block_no", packed.alias("state"))
    if blocks <= SENT_BLOCKS:
        read = pieces.join(F.broadcast(begins), ["file_key", "source_block"]).select(*state, "value")
    else:
        dealt = pieces.join(begins, ["file_key", "source_block"]).repartition("block_no")
        read = dealt.sortWithinPartitions("block_no", "source_row").select(*state, "value")
    if blocks == whole:
        # no file has an edge between blocks
        inner = read.mapInArrow(_cutting(base, items), _CUT).withColumn("end_no", F.col("block_no")).drop("edge")
        return inner, inner, states, False
    # Edges and notes are few and written; items, which are nearly the whole text, are not but read where they stand.
    told = written(read.mapInArrow(_cutting(base, False), _CUT), "told")
    # A chain of edges begins behind the last item's end in a block and ends with the next one's first, wherever that is.
    order = Window.partitionBy("file").orderBy("source_block", "at")
    edges = (
        told.where(F.col("kind").isin(PREFIX, SUFFIX, WHOLE))
        .join(states.select("block_no", "file", "source_block", "first"), "block_no")
        .select("file", F.count_if(F.col("kind") == SUFFIX).over(order).alias("chain"), "source_block", "at", "block_no", "first", "edge")
    )
    dealt = edges.repartition("file", "chain").sortWithinPartitions("file", "chain", "source_block", "at")
    joined = written(dealt.mapInArrow(_edges(base, items), f"{_CUT}, end_no long"), "edges")
    ends = lambda rows, *kinds: rows.where(F.col("kind").isin(*kinds)).withColumn("end_no", F.col("block_no"))
    notes = ends(told, KEY, FIELD).unionByName(joined).drop("edge")
    inner = ends(read.mapInArrow(_cutting(base, items), _CUT), ITEM, INCOMPLETE).unionByName(joined).drop("edge")
    return inner, notes, states, True


def document_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, source_block, source_row, value) of documents, which are split at closing braces whatever their size."""
    return spark.read.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
        "value",
    )


def document_items(pieces: DataFrame, in_object: bool, files: DataFrame | None = None) -> DataFrame:
    """(file, source_block, source_row, item, incomplete) with the JSON text of each item.

    An item at which the document breaks off is NULL and ``incomplete``; the
    complete ones before it count.

    ``pieces`` has (file, source_block, source_row, value), each value the text
    up to the next closing brace, as a scan of the files gives them: those of a
    block in one task, in order.  Items are the objects of a root list, lists
    inside it included, or with ``in_object`` those under the items key of a
    wrapping object.  ``source_row`` is the place of an item in its block.
    ``files`` has the ``file`` of all documents; it spares a read.
    """
    cut, notes, states, edges = _cut(pieces, in_object, True, files)
    items = cut.where(F.col("kind").isin(ITEM, INCOMPLETE))
    if in_object:
        if edges:
            items = items.join(_list_keys(notes, states), "end_no").withColumn("key", F.coalesce("key", "list_key"))
        items = items.where(F.col("key") == JSON_ITEMS_KEY)
    places = states.select("block_no", "file", "source_block")
    places = F.broadcast(places) if states.count() <= SENT_BLOCKS else places
    return items.join(places, "block_no").select(
        "file", "source_block", F.col("at").alias("source_row"), "item", (F.col("kind") == INCOMPLETE).alias("incomplete")
    )


def _list_keys(notes: DataFrame, states: DataFrame) -> DataFrame:
    """(end_no, list_key): under which key items stand that come before the first key of their block, the last one before it."""
    place = F.struct((F.col("end_no") == F.col("block_no")).cast("int"), "at")
    keys = notes.where(F.col("kind") == KEY).groupBy("end_no").agg(
        F.max_by("key", place).alias("last_key"),
        F.max_by("key", F.when(F.col("end_no") != F.col("block_no"), F.col("at"))).alias("edge_key"),
    )
    before = Window.partitionBy("file").orderBy("source_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        states.join(keys, states["block_no"] == keys["end_no"], "left")
        .withColumn("carried", F.last("last_key", ignorenulls=True).over(before))
        .select(F.col("block_no").alias("end_no"), F.coalesce("edge_key", "carried").alias("list_key"))
    )


def document_headers(pieces: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, header) of wrapped documents: the fields of ``JSON_HEADER``, wherever in the document they stand.

    A field that is told more than once counts with its last value.
    """
    _, notes, states, _ = _cut(pieces, True, False, files)
    fields = notes.where(F.col("kind") == FIELD).join(states.select("block_no", "file", "source_block"), "block_no")
    latest = fields.groupBy("file", "key").agg(F.max_by("item", F.struct("source_block", "at")).alias("value"))
    entries = F.transform(
        F.collect_list(F.struct("key", "value")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
    )
    text = latest.groupBy("file").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("text"))
    return text.select("file", F.from_json("text", JSON_HEADER).alias("header"))
