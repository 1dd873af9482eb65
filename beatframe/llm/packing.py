"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beatframe.llm.base import n_words, stage

CAPACITIES = (512, 1024, 2048, 4096)
PIECE = "bin_id bigint, capacity bigint, used bigint, doc_id bigint, start bigint, length bigint, offset bigint"


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, attention over them, and a fixed part."""
    return capacity + capacity * capacity / 16384 + 64


def best_fit(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece (lengths falling), and the final capacity of every bin.

    A piece goes to the open bin with the least room that holds it, whatever its capacity. If none does, the capacity with the
    least cost per token it can still be filled with is opened. At the end each bin shrinks to the least capacity that holds its
    contents. Open bins are kept by room; a bitset of rooms in use finds the best fit.
    """
    rooms: dict[int, list[int]] = {}
    mask, left = 0, sum(lengths)
    where, offsets, used, opened = [], [], [], []
    for size in lengths:
        found = mask >> size
        if found:
            room = size + (found & -found).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / min(c, left), c))
            at = len(used)
            used.append(0)
            opened.append(room)
        where.append(at)
        offsets.append(used[at])
        used[at] += size
        left -= size
        room -= size
        if room:
            rooms.setdefault(room, []).append(at)
            mask |= 1 << room
    final = [min((c for c in capacities if c >= u), key=lambda c: (cost(c), c)) for u in used]
    return where, offsets, [min(f, o) if cost(f) <= cost(o) else o for f, o in zip(final, opened)]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES,
                   cost: Callable[[int], float] = sequence_cost, shard_words: int = 1 << 22) -> DataFrame:
    """One row per piece: bin, its final capacity and fill, document, first word, word count, place in the bin.

    Sizes are words. A document longer than the largest capacity is cut into full pieces and a rest. Documents are dealt evenly
    into shards of about ``shard_words`` words and each shard is packed by itself, which leaves at most a few part-filled bins per
    shard. Bin ids are unique over all shards.

    Null and empty texts have no words: one row of length 0 without a bin. Repeated rows are separate documents. An empty table
    gives an empty table. Other columns, whatever their names, are not read. Capacities must be positive; their order is free.
    """
    caps = tuple(sorted(set(capacities)))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    most = caps[-1]
    sizes = stage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), n_words(F.col(text_col)).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    pieces = sizes.withColumn("row", F.monotonically_increasing_id()).withColumn("start", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(most).cast("bigint")))).select(
        F.pmod(F.xxhash64("row", "start"), F.lit(shards)).alias("shard"), "doc_id", "row", "start",
        F.least(F.col("size") - F.col("start"), F.lit(most)).alias("length"))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("start", "ascending")])
        length = table.column("length").to_numpy()
        where, offsets, final = best_fit(length.tolist(), caps, cost)
        where = np.array(where, dtype=np.int64)
        return pa.table({"bin_id": (int(key[0].as_py()) << 32) + where, "capacity": np.array(final, dtype=np.int64)[where],
                         "used": np.bincount(where, weights=length).astype(np.int64)[where], "doc_id": table.column("doc_id"),
                         "start": table.column("start"), "length": length, "offset": np.array(offsets, dtype=np.int64)})
    packed = pieces.where("length > 0").groupBy("shard").applyInArrow(pack, PIECE)
    none = F.lit(None).cast("bigint")
    return packed.unionByName(pieces.where("length = 0").select(
        none.alias("bin_id"), none.alias("capacity"), none.alias("used"), "doc_id", "start", "length", none.alias("offset")))
