"""Connected components, and groups too large for one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pricelake.runtime import written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (node, root) for the nodes of undirected ``edges`` (a, b); the root is the least node reachable.

    The roots have no row.  Each round ties the neighbours of every node to
    the least of them, so paths shrink to stars in a number of rounds that
    follows the logarithm of their length.  A hub is summed up map-side, and
    the join that brings its least neighbour back may be split by the
    optimizer.  Rounds are written to the shared folder, in as many files as
    the edges of the round before need; about ``rows`` are expected at first.
    """
    kept = written(edges.where("a != b").select("a", "b").distinct(), "edges", rows=rows)
    state = _state(kept)
    while True:
        both = kept.union(kept.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        tied = tied.union(least.select("u", "m")).where("a != b").distinct()
        kept = written(tied, "edges", rows=2 * state[0])
        now = _state(kept)
        if now == state:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """Number and hash of the edges, which tell whether a round has changed them."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def in_blocks(members: DataFrame, key: str, node: str, size, limit: int) -> DataFrame:
    """Members with columns ``bi`` and ``bj``: groups (key, bi, bj) of bounded size in which every two members of a key meet.

    A group whose ``size`` (a Column, summed up) stays under ``limit`` is one
    block; a larger one is dealt to blocks by hash, and each pair of blocks is
    a group of its own.
    """
    blocks = members.groupBy(key).agg(F.ceil(F.sum(size) / limit).cast("int").alias("blocks"))
    large = blocks.where("blocks > 1")
    dealt = members.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(node), "blocks").cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns(
        {"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}
    ).drop("blocks", "own", "other")


def spanning(n: int, links: Callable[[int], np.ndarray]) -> np.ndarray:
    """Label of each of ``n`` members such that linked ones, and no others, share it through links.

    ``links(i)`` marks all members that i links with.  Members are compared
    with all others until those not yet compared are all in one part, so a
    group of near copies costs few rounds and no link is missed.
    """
    label = np.arange(n)
    open_ = np.ones(n, bool)
    i = 0
    while True:
        open_[i] = False
        found = np.unique(label[links(i)])
        if len(found):
            label[np.isin(label, np.append(found, label[i]))] = min(label[i], found[0])
        parts, sizes = np.unique(label[open_], return_counts=True)
        if len(parts) <= 1:
            return label
        rest = open_ & (label != parts[sizes.argmax()])
        i = int(rest.argmax())
