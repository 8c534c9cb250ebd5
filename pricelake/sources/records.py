"""CSV records of files whose cells hold line breaks, without reading a file in one task.

A quote opens a cell only where the cell starts; elsewhere in a plain cell it
is a character like any other.  So a line has one of two effects on what
follows, depending on whether it starts a record or lies inside a quoted cell,
and effects of lines that follow each other combine to one effect.  They are
combined inside each file block and then over the blocks of a file, so blocks
are worked on in parallel and a record may cross any number of them.  Lines
pass through a task one batch after the other, none holds a block; only what
lies at the edges of blocks is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricelake.runtime import written
from pricelake.sources.documents import SENT_BLOCKS, runs, with_file_keys

# Executors need not have this package installed: what they run is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNCLOSED_QUOTE = "unclosed_quote"

# What is inside quotes: anything but quotes, and pairs of them.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
# What may follow the closing quote of a cell.
_AFTER = r'(?:[^,"][^,]*+)?+'
# From the start of a cell: whole cells, then one that opens and doesn't close.
_OPENS = rf'(?:(?:"{_INSIDE}"{_AFTER}|[^",][^,]*+)?+,)*+"{_INSIDE}\z'
_OPEN_FROM_CLOSED = rf"^{_OPENS}"
_OPEN_FROM_OPEN = rf'^{_INSIDE}(?:\z|"{_AFTER},{_OPENS})'


def opens_quote(line: Column) -> Column:
    """True when a line that starts a record ends inside a quoted cell."""
    return F.contains(line, F.lit('"')) & line.rlike(_OPEN_FROM_CLOSED)


def stays_open(line: Column) -> Column:
    """True when a line that starts inside a quoted cell ends inside one."""
    return ~F.contains(line, F.lit('"')) | line.rlike(_OPEN_FROM_OPEN)


_EFFECTS = "file_key long, source_block long, open_0 int, open_1 int, starts_0 long, starts_1 long"
_RECORDS = "file_key long, source_block long, source_row long, value string, unclosed boolean, record_block long, record_number long"


def line_states(opens: np.ndarray, stays: np.ndarray, start: int) -> np.ndarray:
    """Whether each line starts inside a quoted cell, and at the end whether the last one ends there.

    A line ends the same way however it starts, turns the state round, or
    leaves it.  The state after some lines is that of the last fixed one, or
    else the first, turned by the turns since.
    """
    n = len(opens)
    turned, last = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    turned[1:] = np.cumsum((opens == 1) & (stays == 0))
    last[1:] = np.maximum.accumulate(np.where(opens == stays, np.arange(n), -1))
    fixed = last >= 0
    return (np.where(fixed, opens[last], start) + turned - np.where(fixed, turned[last + 1], 0)) % 2


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Lines of one block that follow each other, with the file and place of the block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file_key").to_numpy(), batch.column("source_block").to_numpy()
        for a, b in runs([file, block]):
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _flags(lines: pa.RecordBatch, name: str) -> np.ndarray:
    return lines.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _block_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: for both states in which it may start, how it ends and how many records start in it."""
    now, ends, starts = None, [0, 1], [0, 0]

    def row():
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["file_key", "source_block", "open_0", "open_1", "starts_0", "starts_1"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, *ends, *starts), kinds)], names=names)

    for key, lines in _block_runs(batches):
        if key != now:
            if now is not None:
                yield row()
            now, ends, starts = key, [0, 1], [0, 0]
        opens, stays = _flags(lines, "opens"), _flags(lines, "stays")
        for s in (0, 1):
            states = line_states(opens, stays, ends[s])
            starts[s] += int((states[:-1] == 0).sum())
            ends[s] = int(states[-1])
    if now is not None:
        yield row()


def _rows(lines: pa.RecordBatch, value: pa.Array, unclosed: pa.Array, record: tuple[int, int] | None) -> pa.RecordBatch:
    n = len(value)
    same = lambda i: pa.nulls(n, pa.int64()) if record is None else pa.repeat(pa.scalar(record[i], pa.int64()), n)
    return pa.RecordBatch.from_arrays(
        [*[lines.column(c) for c in ("file_key", "source_block", "source_row")], value, unclosed, same(0), same(1)],
        names=["file_key", "source_block", "source_row", "value", "unclosed", "record_block", "record_number"],
    )


def _cutting(crossing: bool):
    """Lines of blocks to the records that lie in one block, or, ``crossing``, to the lines of those that reach into another."""

    def parts(lines, record):
        return _rows(lines, lines.column("value"), pa.repeat(pa.scalar(False), lines.num_rows), record)

    def run(batches):
        now, state, number, held = None, 0, 0, []
        for key, lines in _block_runs(batches):
            if key != now:
                if crossing:
                    yield from (parts(h, (now[1], number)) for h in held)
                now, state, number, held = key, lines.column("open")[0].as_py(), 0, []
            lost = lines.column("lost")[0].as_py()
            states = line_states(_flags(lines, "opens"), _flags(lines, "stays"), state)
            begins = states[:-1] == 0
            numbers = number + np.cumsum(begins)
            state, number = int(states[-1]), int(numbers[-1])
            # what belongs to the record before the block, records that start in it, and the one that is never closed
            end = int(np.searchsorted(numbers, lost)) if lost >= 0 else len(numbers)
            first = min(int(np.searchsorted(numbers, 1)), end)
            if end < len(numbers) and not crossing:
                loose = lines.slice(end)
                yield _rows(loose, loose.column("value"), pa.array(begins[end:]), None)
            if first and crossing:
                carried = (lines.column("carried_block")[0].as_py(), lines.column("carried_number")[0].as_py())
                yield parts(lines.slice(0, first), carried)
            if first == end:
                continue
            at = first + np.flatnonzero(begins[first:end])
            open_at = end if end < len(numbers) or not state else (int(at[-1]) if len(at) else first)
            if not crossing and (open_at > first or held and len(at)):
                own = pa.Table.from_batches([*held, lines.slice(first, open_at - first)]).combine_chunks()
                before = sum(h.num_rows for h in held)
                places = at[at < open_at] - first + before
                places = np.concatenate([[0], places]) if held else places
                own = own.to_batches()[0]
                value = own.column("value")
                if len(places) < own.num_rows:
                    offsets = pa.array(np.append(places, own.num_rows), pa.int32())
                    value = pc.binary_join(pa.ListArray.from_arrays(offsets, value), "\n")
                    own = own.take(pa.array(places))
                yield _rows(own, value, pa.repeat(pa.scalar(False), len(value)), None)
            if open_at == end:
                held = []
            elif len(at):
                held = [lines.slice(open_at, end - open_at)]
            else:
                held = [*held, lines.slice(first, end - first)]
        if crossing:
            yield from (parts(h, (now[1], number)) for h in held)

    return run


def whole_records(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, source_block, source_row, value, unclosed) with one row per record.

    ``lines`` has the same columns but the last, with one row per line, those
    of a block in one task, in order, as a scan gives them; a record has the
    position of its first line.  Where a file ends inside a quoted cell, the
    line that opened it is ``unclosed``, and the lines after it are records of
    their own.  ``files`` has the ``file`` of all; it spares a read.
    """
    in_file = Window.partitionBy("file_key").orderBy("source_block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    lines, files = with_file_keys(lines, files)
    flagged = lines.select("file_key", "source_block", "source_row", "value").withColumns(
        {"opens": opens_quote(F.col("value")), "stays": stays_open(F.col("value"))}
    )
    effects = flagged.select("file_key", "source_block", "opens", "stays").mapInArrow(_block_effects, _EFFECTS)
    # A block has one of the effects of a line: ``mark`` is the state a fixed one ends in, with all turns before it taken back.
    blocks = (
        effects.withColumn("fixed", F.when(F.col("open_0") == F.col("open_1"), F.col("open_0")))
        .withColumn("turning", F.when(F.col("open_0") > F.col("open_1"), 1).otherwise(0))
        .withColumn("turned", F.coalesce(F.sum("turning").over(before), F.lit(0)))
        .withColumn("mark", (F.col("fixed") + F.col("turned")) % 2)
        .withColumn("open", (F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0)) + F.col("turned")) % 2)
        .withColumn("after", F.coalesce("fixed", (F.col("open") + F.col("turning")) % 2))
        .withColumn("starts", F.when(F.col("open") == 0, F.col("starts_0")).otherwise(F.col("starts_1")))
        .withColumn(
            "latest",
            F.when(F.col("starts") > 0, F.struct(F.col("source_block").alias("block"), F.col("starts").alias("number"))),
        )
        .withColumn("carried", F.last("latest", ignorenulls=True).over(before))
    )
    blocks = written(blocks.select("file_key", "source_block", "open", "after", "latest", "carried"), "blocks")
    ends = blocks.groupBy("file_key").agg(
        F.max_by("after", "source_block").alias("file_open"), F.max("latest").alias("last_record")
    )
    # Number of the record of the block that is never closed; 0 is the one before the block.
    lost = F.when(
        F.col("file_open") == 1,
        F.when(F.col("source_block") == F.col("last_record.block"), F.col("last_record.number")).when(
            F.col("source_block") > F.col("last_record.block"), F.lit(0)
        ),
    )
    states = blocks.join(ends, "file_key").select(
        "file_key",
        "source_block",
        "open",
        F.col("carried.block").alias("carried_block"),
        F.col("carried.number").alias("carried_number"),
        F.coalesce(lost, F.lit(-1)).cast("long").alias("lost"),
        ((F.col("open") == 1) | (F.col("after") == 1)).alias("crossed"),
    )
    n, crossed = blocks.agg(F.count("*"), F.count_if((F.col("open") == 1) | (F.col("after") == 1))).first()
    if n <= SENT_BLOCKS:
        read = flagged.join(F.broadcast(states), ["file_key", "source_block"])
    else:
        dealt = flagged.join(states, ["file_key", "source_block"]).repartition("file_key", "source_block")
        read = dealt.sortWithinPartitions("file_key", "source_block", "source_row")
    columns = ["file_key", "source_block", "source_row", "value", "unclosed"]
    named = lambda records: records.join(F.broadcast(files), "file_key").select("file", *columns[1:])
    inner = named(read.drop("crossed").mapInArrow(_cutting(False), _RECORDS).select(*columns))
    if not crossed:
        return inner
    record = ["file_key", "record_block", "record_number"]
    joined = (
        read.where("crossed").drop("crossed").mapInArrow(_cutting(True), _RECORDS)
        .groupBy(*record)
        .agg(F.array_sort(F.collect_list(F.struct("source_block", "source_row", "value"))).alias("l"))
        .select(
            "file_key",
            F.get("l", F.lit(0))["source_block"].alias("source_block"),
            F.get("l", F.lit(0))["source_row"].alias("source_row"),
            F.array_join("l.value", "\n").alias("value"),
            F.lit(False).alias("unclosed"),
        )
    )
    return inner.unionByName(named(joined))
