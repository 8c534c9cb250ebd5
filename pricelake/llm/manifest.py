"""Merkle manifest of a table: blocks of hashes in van Emde Boas layout, and membership proofs read from them.

Rows are leaves; the leaves of a run (a language, say), in order, are the
bottom of a binary tree, and the roots of the runs are the bottom of another.
A tree is cut into aligned blocks of ``HEIGHT`` levels.  A block is built by
one task from at most 2^HEIGHT hashes and kept as one binary value in which
its nodes stand in van Emde Boas order: the upper half of its levels first,
then the subtrees below it one after the other, each in the same order.  Where
a node stands follows from its level and index alone.  The roots of blocks are
the leaves of the next layer of blocks, until one block is left.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricelake.runtime import written

#: Levels above the leaves in a block; it has at most 2^HEIGHT leaves.
HEIGHT = 10
#: Bytes of a proof's step: where the sibling stands (left, right, none) and its digest.
STEP = 33
LEFT, RIGHT, NONE = 0, 1, 2

#: What is hashed of a row of ``documents``.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*hexes: bytes) -> bytes:
    """SHA-256, as hex text, of hex texts one after the other."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


@lru_cache(None)
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """For each level above the leaves, from 0, the places of its nodes in a block of that height."""

    def place(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
        if levels == 1:
            return np.zeros_like(index)
        top = levels // 2
        if depth < top:
            return place(depth, index, top)
        below = levels - top
        tree, inner = index >> (depth - top), index & ((1 << (depth - top)) - 1)
        return (1 << top) - 1 + tree * ((1 << below) - 1) + place(depth - top, inner, below)

    return tuple(place(height - level, np.arange(1 << (height - level)), height + 1) for level in range(height + 1))


def block_height(leaves: int, whole: bool) -> int:
    """Levels of a block: as many as lead to one node, or all if the run goes on in other blocks."""
    return HEIGHT if whole else (leaves - 1).bit_length()


def build(leaves: list[bytes], whole: bool) -> bytes:
    """A block over hex digests in van Emde Boas order; a last node without a sibling is hashed alone."""
    height = block_height(len(leaves), whole)
    out = bytearray(32 * ((1 << (height + 1)) - 1))
    row = leaves
    for level, places in enumerate(addresses(height)):
        if level:
            row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        for place, node in zip(places.tolist(), row):
            out[32 * place : 32 * place + 32] = bytes.fromhex(node.decode())
    return bytes(out)


def node(block: bytes, height: int, level: int, index: int) -> bytes:
    place = 32 * int(addresses(height)[level][index])
    return block[place : place + 32]


def siblings(block: bytes, leaves: int, whole: bool, leaf: int) -> bytes:
    """The steps of a proof from a leaf to the root of its block."""
    height = block_height(leaves, whole)
    out, index, n = [], leaf, leaves
    for level in range(height):
        other = index ^ 1
        if other >= n:
            out.append(bytes([NONE]) + bytes(32))
        else:
            out.append(bytes([LEFT if other < index else RIGHT]) + node(block, height, level, other))
        index, n = index >> 1, (n + 1) >> 1
    return b"".join(out)


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf (hex) and the steps of its proof lead to."""
    for at in range(0, len(proof), STEP):
        side, other = proof[at], proof[at + 1 : at + STEP].hex().encode()
        leaf = digest(leaf) if side == NONE else digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


def proof_digest(proof: bytes) -> str:
    """SHA-256 of the siblings' hex digests in a proof."""
    found = [proof[at + 1 : at + STEP].hex().encode() for at in range(0, len(proof), STEP) if proof[at] != NONE]
    return digest(*found).decode()


def told(value: Column) -> Column:
    """A value with its length in front, or a dash: no two rows have one text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[told(c) for c in fields]), 256))


def run_key(run: Column) -> Column:
    """A run's name that is never NULL and sorts NULL first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), run), F.lit(""))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``run``) written with ``place``, the position of each in its run.

    Rows are sorted by range over all tasks, so a run with most of the rows
    lies in many; where a task's part of a run starts follows from the counts
    of tasks and runs, which are summed up per run.
    """
    ranged = rows.repartitionByRange("run", *order).sortWithinPartitions("run", *order)
    kept = written(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftright("at", 33)
    counts = kept.groupBy("run", task.alias("task")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("run").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("run", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return kept.withColumn("task", task).join(starts, ["run", "task"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def layer(leaves: DataFrame, carried: list[str], name: str) -> DataFrame:
    """Blocks (run, block, n, whole, nodes, root, lists of the ``carried`` columns) over leaves (run, place, digest)."""
    sizes = leaves.groupBy("run").agg((F.max("place") >= 1 << HEIGHT).alias("whole"))
    dealt = leaves.withColumn("block", F.shiftright("place", HEIGHT)).join(sizes, "run")
    kinds = {c: leaves.schema[c].dataType.simpleString() for c in carried}
    schema = "run string, block long, n int, whole boolean, nodes binary, root binary" + "".join(f", {c} array<{k}>" for c, k in kinds.items())
    ordered = dealt.select("run", "block", "place", "whole", "digest", *carried).repartition("run", "block")
    found = ordered.sortWithinPartitions("run", "block", "place").mapInArrow(_building(carried), schema)
    return written(found, name)


def _building(carried: list[str]):
    def run(batches):
        key, parts = None, []

        def block():
            rows = pa.Table.from_batches(parts).combine_chunks()
            whole = rows.column("whole")[0].as_py()
            nodes = build([d.hex().encode() for d in rows.column("digest").to_pylist()], whole)
            height = block_height(rows.num_rows, whole)
            columns = {
                "run": [key[0]], "block": [key[1]], "n": pa.array([rows.num_rows], pa.int32()), "whole": [whole],
                "nodes": [nodes], "root": [node(nodes, height, height, 0)],
            }
            for c in carried:
                one = rows.column(c).combine_chunks()
                one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
                columns[c] = pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            keys = list(zip(batch.column("run").to_pylist(), batch.column("block").to_pylist()))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if parts and keys[start] != key:
                    yield block()
                    parts = []
                key = keys[start]
                parts.append(batch.slice(start, i - start))
                start = i
        if parts:
            yield block()

    return run


def forest(leaves: DataFrame, carried: list[str], name: str) -> list[DataFrame]:
    """Layers of blocks, the leaves' first; in the last one every run has a single block."""
    layers = [layer(leaves, carried, f"{name}-0")]
    while layers[-1].where("block > 0").limit(1).count():
        above = layers[-1].select("run", F.col("block").alias("place"), F.col("root").alias("digest"))
        layers.append(layer(above, [], f"{name}-{len(layers)}"))
    return layers


def paths(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(run, block, path, top): the steps from each block of the first layer to the very top.

    ``above`` has (run, path, top) for the runs' roots.
    """
    found = layers[-1].select("run", "block").join(above, "run")
    for upper in reversed(layers[1:]):
        found = upper.join(found, ["run", "block"]).select("run", "block", "n", "whole", "nodes", "path", "top").mapInArrow(
            _descending, "run string, block long, path binary, top binary"
        )
    return found


def _descending(batches):
    """Blocks with the steps above them to the steps above each of their leaves."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            steps = [siblings(row["nodes"], row["n"], row["whole"], i) + row["path"] for i in range(row["n"])]
            first = row["block"] << HEIGHT
            yield pa.RecordBatch.from_pydict(
                {
                    "run": [row["run"]] * row["n"],
                    "block": list(range(first, first + row["n"])),
                    "path": steps,
                    "top": [row["top"]] * row["n"],
                }
            )


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id: str = "doc_id",
    run: str = "lang",
    changed: Column | None = None,
    changes: dict[str, Column] | None = None,
) -> DataFrame:
    """A row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the hash of ``fields``, each with its length before it or ``-``
    where NULL.  Leaves of a run ascend by ``id``; every two neighbours become
    their hash, a last one without a neighbour the hash of itself, until one
    is left, the ``subroot``.  Subroots in the order of their runs, NULL first,
    give the ``root`` in the same way.  A row's proof is the siblings on its
    way to the root, read from the blocks; ``proof_sha256`` is their hash.

    Rows where ``changed`` holds are checked as tampered with: the leaf of
    ``fields`` after ``changes`` meets the siblings of the untampered table.
    ``folded_root`` is what leaf and siblings lead to, ``verified`` whether it
    is the root.

    Cases: NULL in any field has a hash of its own, a NULL id stands first and
    NULL runs make a run; rows with one id are ordered by their leaves, and
    repeated rows are leaves each; long texts are hashed where they are read
    and not moved; one row in a run is its subroot; an empty table gives no
    rows; extra columns are ignored, whatever their names.
    """
    changes = changes or {}
    hashed = docs.select(
        F.col(id).alias("id"),
        run_key(F.col(run)).alias("run"),
        leaf_of([F.col(c) for c in fields]).alias("digest"),
        F.when(F.lit(False) if changed is None else changed, leaf_of([changes.get(c, F.col(c)) for c in fields])).alias("other"),
    )
    layers = forest(placed(hashed, ["id", "digest"], "leaves"), ["id", "other"], "blocks")
    subroots = layers[-1].select("run", F.col("root").alias("digest"))
    named = subroots.select(F.lit("").alias("run"), F.col("run").alias("name"), "digest")
    tops = forest(placed(named, ["name"], "subroots"), ["name"], "roots")
    root = tops[-1].select("run", F.lit(b"").alias("path"), F.col("root").alias("top"))
    runs = (
        tops[0]
        .join(paths(tops, root), ["run", "block"])
        .select("n", "whole", "nodes", "path", "top", "name")
        .mapInArrow(_runs, "run string, path binary, top binary")
    )
    above = runs.join(subroots, "run").select("run", "path", F.concat("digest", "top").alias("top"))
    kind = hashed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = layers[0].join(paths(layers, written(above, "runs")), ["run", "block"])
    rows = found.select("n", "whole", "nodes", "path", "top", "id", "other").mapInArrow(_proving, schema)
    return rows.withColumnRenamed("id", id)


def _runs(batches):
    """The way of each run's root to the root of all."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "run": row["name"],
                    "path": [siblings(row["nodes"], row["n"], row["whole"], i) + row["path"] for i in range(row["n"])],
                    "top": [row["top"]] * row["n"],
                }
            )


def _proving(batches):
    """Blocks of leaves with the steps above them to a checked proof of every leaf."""
    for batch in batches:
        ids, rest = batch.column("id"), batch.drop_columns(["id"])
        for k in range(batch.num_rows):
            row = rest.slice(k, 1).to_pylist()[0]
            nodes, n, whole = row["nodes"], row["n"], row["whole"]
            height = block_height(n, whole)
            subroot, root = row["top"][:32].hex(), row["top"][32:].hex()
            out = [[], [], [], []]
            for i, other in enumerate(row["other"]):
                proof = siblings(nodes, n, whole, i) + row["path"]
                leaf = node(nodes, height, 0, i).hex()
                folded = fold((other.hex() if other is not None else leaf).encode(), proof).decode()
                for column, value in zip(out, (leaf, proof_digest(proof), folded, folded == root)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids[k].values, pa.array(out[0]), pa.array([subroot] * n), pa.array([root] * n), *map(pa.array, out[1:])],
                names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )
