"""Near-duplicate documents by HyperMinHash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A, graph
from pricelake.runtime import written

#: Registers in a band, and the chance that a pair at the threshold shares no band.
ROWS, MISSED = 5, 1e-8
#: Bits of a register that hold the leading part of its least hash.
MANTISSA = 10
#: Draws of an empty register among the others before its right neighbour is taken.
DRAWS = 32
#: Standard errors that an estimate may lie under the threshold.
MARGIN = 5
#: Documents compared in one task by registers; shingles compared in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20
#: Rows of at most 40 bytes that are sent to all executors rather than shuffling all texts.
BROADCAST_ROWS = 1_500_000


def bands_of(threshold: float) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))


def registers(sets: list[np.ndarray], n: int) -> np.ndarray:
    """HyperMinHash registers, a row for each set of sorted hashes; 0 where a bucket is empty.

    The upper half of a hash names its bucket.  Of the least lower half in a
    bucket the register keeps the number of leading zeros and the bits after
    the first one.
    """
    out = np.zeros((len(sets), n), np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = ((flat >> A.U64(32)) * A.U64(n)) >> A.U64(32)
    at = row * n + bucket.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    least = np.minimum.reduceat(flat & A.U64(0xFFFFFFFF), first)
    part, power = np.frexp(np.maximum(least, A.U64(1)).astype(np.float64))
    zeros = 32 - power
    mantissa = np.floor((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out.ravel()[at[first]] = ((zeros << MANTISSA) | mantissa) + 1
    return out


def filled(found: np.ndarray) -> np.ndarray:
    """Registers in which empty ones repeat others, drawn alike for all documents."""
    n = found.shape[1]
    out = found.copy()
    for k in range(DRAWS):
        if out.all():
            return out
        donor = (A.numbers(n, 100 + k) >> A.U64(20)) % A.U64(n)
        out = np.where(out == 0, found[:, donor.astype(np.int64)], out)
    for _ in range(n):
        if out.all():
            break
        out = np.where(out == 0, np.roll(out, -1, axis=1), out)
    return out


def band_hashes(found: np.ndarray, bands: int) -> np.ndarray:
    factors = A.numbers(bands * ROWS, 3)
    parts = (filled(found).astype(np.uint64) * factors).reshape(len(found), bands, ROWS).sum(2, dtype=np.uint64)
    return A.mix(parts + A.numbers(bands, 4)).view(np.int64)


def estimate(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of one row of registers with others, and the registers they rest on.

    Two different least hashes give the same register where they have the
    same number of leading zeros and the same mantissa; that chance follows
    from how often each number occurs on either side.
    """
    used = ((one > 0) | (others > 0)).sum(1)
    same = ((one == others) & (one > 0)).sum(1)
    zeros = (one[one > 0] - 1) >> MANTISSA
    often = np.bincount(zeros, minlength=34) / max(1, len(zeros))
    chance = (often**2).sum() / (1 << MANTISSA)
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    data, offsets = A.text_bytes(texts)
    found = A.words(A.LOWER[data], offsets)
    return A.shingles(found.hashes, found.of, size)


def _nodes(sets: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """128 bits that tell a set from others; null for the empty one."""
    keys = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        keys[i] = s.sum(dtype=np.uint64) + A.U64(len(s)), A.mix(s + A.U64(77)).sum(dtype=np.uint64)
    none = np.array([not len(s) for s in sets], bool)
    return A.fixed_binary(keys, none), none


def sketches(docs: DataFrame, text: str, size: int, threshold: float) -> DataFrame:
    """A row per document: id, text_key, n_shingles, node, registers, bands."""
    bands = bands_of(threshold)

    def run(batches):
        for part in A.chunks(batches, text):
            sets = _sets(part.column(text), size)
            node, none = _nodes(sets)
            found = registers(sets, bands * ROWS)
            keys = band_hashes(np.where(none[:, None], np.uint16(1), found), bands)
            lengths = np.where(none, 0, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    node,
                    A.fixed_binary(found, none),
                    A.lists(keys[~none].ravel(), lengths, pa.int64()),
                ],
                names=["id", "text_key", "n_shingles", "node", "registers", "bands"],
            )

    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_key long, n_shingles long, node binary, registers binary, bands array<long>"
    return docs.mapInArrow(run, schema)


def _linked_by_registers(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join, inside each group, the nodes whose estimates may reach the threshold."""

    def run(batches):
        for group in A.groups(batches, ["band", "bi", "bj"]):
            nodes = group.column("node").to_pylist()
            if len(nodes) < 2:
                continue
            found = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(nodes), -1)

            def links(i):
                near, used = estimate(found[i], found)
                return near >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))

            yield _edges(nodes, graph.spanning(len(nodes), links))

    dealt = rows.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    return dealt.mapInArrow(run, "a binary, b binary")


def _edges(nodes: list[bytes], label: np.ndarray) -> pa.RecordBatch:
    pairs = [(nodes[i], nodes[j]) for i, j in enumerate(label.tolist()) if i != j]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"]
    )


def _linked_by_sets(rows: DataFrame, share: int, whole: int) -> DataFrame:
    """Edges (a, b) that join, inside each group, the nodes whose full sets are similar enough."""

    def run(batches):
        for group in A.groups(batches, ["cluster_key", "bi", "bj"]):
            first = dict.fromkeys(group.column("node").to_pylist())
            for i, node in reversed(list(enumerate(group.column("node").to_pylist()))):
                first[node] = i
            nodes = list(first)
            if len(nodes) < 2:
                continue
            column = group.column("shingles").combine_chunks()
            sets = [column[first[node]].values.to_numpy() for node in nodes]
            sizes = np.array([len(s) for s in sets])
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            mark = np.zeros(len(values), np.int32)

            def links(i):
                own = flat[starts[i] : ends[i]]
                mark[own] = 1
                both = np.add.reduceat(mark[flat], starts)
                mark[own] = 0
                return whole * both >= share * (sizes + sizes[i] - both)

            yield _edges(nodes, graph.spanning(len(nodes), links))

    dealt = rows.repartition("cluster_key", "bi", "bj").sortWithinPartitions("cluster_key", "bi", "bj")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, share: int = 80, whole: int = 100
) -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z in lower case; a document's set
    are its distinct runs of ``words`` words.  Documents are linked where
    ``whole`` times the intersection is at least ``share`` times the union,
    and a component is named by the least id in it.

    1. Each text is read once into a 128-bit name of its set, HyperMinHash
       registers and hashes of their bands.  Equal sets are one node from here on.
    2. Nodes that share a band meet in groups (one for each distinct set of
       members); inside, corrected Jaccard estimates join those that may reach
       the threshold to clusters.  Pairs never leave the task.
    3. The sets of clustered nodes are read again, each cluster's meet in one
       task or in pairs of blocks, and links are confirmed on full sets.

    Cases: a NULL text is empty; a text without words has no shingles, is
    linked with nothing and is a component of its own; repeated rows get equal
    results; rows with a NULL id take part but name no component; extra
    columns are ignored.  A link is lost only if its pair shares no band
    (chance 1e-8 at the threshold) or its estimate is five standard errors off.
    """
    threshold = share / whole
    plain = A.with_small_batches(docs).select(
        F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("text_key")
    )
    found = written(sketches(plain, "text", words, threshold), "sketches")

    nodes = found.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    shared = (
        nodes.groupBy("band")
        .agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("members"))
        .where("n > 1")
        .groupBy("n", "members")
        .agg(F.min("band").alias("band"))
        .select("band")
    )
    buckets = written(nodes.join(shared, "band"), "buckets", rows=found.count() * bands_of(threshold))
    n_buckets = buckets.count()
    own = found.join(buckets.select("node").distinct(), "node").groupBy("node").agg(
        F.min("text_key").alias("text_key"),
        F.first("registers").alias("registers"),
        F.first("n_shingles").alias("n_shingles"),
    )
    own = written(own, "candidates", rows=n_buckets)
    met = graph.in_blocks(buckets, "band", "node", F.lit(1), BLOCK_ROWS).join(own.select("node", "registers"), "node")
    likely = graph.components(_linked_by_registers(met, threshold), n_buckets)

    roots = likely.select(F.col("root").alias("node"), "root").distinct()
    clusters = written(
        likely.union(roots).join(own.select("node", "text_key", "n_shingles"), "node"), "clusters", rows=n_buckets
    )
    n_clustered = clusters.count()
    sets = _sets_of(plain, clusters.select("text_key").distinct(), n_clustered <= BROADCAST_ROWS, words)
    sized = clusters.select("node", F.xxhash64("root").alias("cluster_key"), "n_shingles")
    members = graph.in_blocks(sized, "cluster_key", "node", F.col("n_shingles"), BLOCK_SHINGLES)
    linked = graph.components(_linked_by_sets(members.drop("n_shingles").join(sets, "node"), share, whole), n_clustered)

    least = found.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = linked.union(linked.select("root", "root").distinct()).join(least, "node")
    named = named.join(
        named.groupBy("root").agg(F.min("least").alias("component_id")), "root"
    ).select("node", "component_id")
    least = least.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        found.select("id", "n_shingles", "node")
        .join(least, "node", "left")
        .select(F.col("id").alias(id), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
    )


def _sets_of(plain: DataFrame, keys: DataFrame, few: bool, words: int) -> DataFrame:
    """(node, shingles) of the clustered nodes, read from one text each; ``few`` text keys are sent to all tasks."""
    if few:
        keys = F.broadcast(keys)

    def run(batches):
        seen = set()
        for part in A.chunks(batches, "text"):
            fresh = [i for i, key in enumerate(part.column("text_key").to_pylist()) if key not in seen and not seen.add(key)]
            if not fresh:
                continue
            sets = _sets(part.column("text").take(pa.array(fresh)), words)
            values = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [_nodes(sets)[0], A.lists(values, [len(s) for s in sets], pa.int64())], names=["node", "shingles"]
            )

    return plain.select("text", "text_key").join(keys, "text_key", "left_semi").mapInArrow(
        run, "node binary, shingles array<long>"
    )
