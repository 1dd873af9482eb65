"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from beatframe.llm.base import stage


def star(edges: DataFrame, large: bool, total: int, heavy: int) -> DataFrame:
    """One star step on (a, b): hang every larger (or, if not large, smaller) neighbour of a node on the least of them all.

    The least neighbours of nodes with more than one edge in ``heavy`` (at most ``heavy`` nodes) are broadcast, and the edges of
    those nodes are dealt out at random in the join for all others.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.withColumn("k", F.col("a").cast("string"))
    least = both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("a"), F.min("b")).alias("m"), F.min("a").alias("a"))
    large_node = F.col("n") * heavy > total
    hot = F.broadcast(least.where(large_node).select(F.col("k").alias("hot_k"), F.col("m").alias("hot_m")))
    rest = least.where(~large_node).select(F.col("k").alias("rest_k"), F.col("m").alias("rest_m"))
    dealt = both.join(hot, F.col("k") == F.col("hot_k"), "left").withColumn("k", F.when(F.col("hot_k").isNull(), F.col("k")).otherwise(
        F.concat(F.lit("dealt out "), F.xxhash64("b").cast("string"))))
    hung = dealt.join(rest, F.col("k") == F.col("rest_k"), "left").select("a", "b", F.coalesce("hot_m", "rest_m").alias("m")).coalesce(max(8, -(-total // 100_000)))
    if large:
        return hung.where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of one task's whole edge table: every label hooks on the least one it meets, until nothing changes."""
    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    names = pc.unique(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(table.column(c), names).to_numpy().astype(np.int64) for c in "ab")
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], least)
        np.minimum.at(hooked, label[b], least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        label = hooked[label]
    yield pa.record_batch({"node": names, "label": names.take(pa.array(label))})


def components(edges: DataFrame, heavy: int = 1000, most_rounds: int = 60, one_task: int = 0) -> DataFrame:
    """(node, label) for every node of an edge, label being the least node of its component.

    Large-star and small-star steps alternate until all components are stars; rounds grow with the logarithm of the longest path.
    Nodes with very many edges are handled apart in the joins. Each round is a table in the shared folder.

    An edge table of at most ``one_task`` rows is contracted in one task instead, which gives the same labels; at 16-byte nodes half a
    million edges take about 100 MB there.
    """
    pairs = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where(F.col("a") != F.col("b")).select("a", "b").distinct()
    e = stage(pairs, "edges", edges.count())

    def settled(t: DataFrame) -> bool:
        """Every node hangs on one parent and no parent hangs on another."""
        roles = t.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            t.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        each = roles.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        return each.where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))).isEmpty()
    if one_task and e.count() <= one_task:
        kind = e.schema["a"].dataType.simpleString()
        return stage(e.coalesce(1).mapInArrow(contract, f"node {kind}, label {kind}"), "labels")
    rounds = 0
    while not settled(e):
        if rounds == most_rounds:
            raise RuntimeError("components did not settle")
        rounds, total = rounds + 1, e.count()
        e = stage(star(stage(star(e, True, 2 * total, heavy), "edges", total), False, total, heavy), "edges", total)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
