"""Byte runs that start earlier in the corpus: suffixes in buckets, ties told apart through a difference-cover sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beatframe.llm.repeats import Block, Search, search

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def runs(gone: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs that do not cross documents: their starts, ends and the number of runs before each document."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[0] = edge[-1] = True
    edge[starts] = edge[ends] = True
    before = np.r_[False, gone]
    after = np.r_[gone, False]
    first = np.flatnonzero(after & (~before | edge))
    last = np.flatnonzero(before & (~after | edge))
    return first, last, np.searchsorted(first, np.r_[starts, len(gone)])


def kept_bytes(block: Block, gone: np.ndarray) -> pa.Table:
    first, last, cuts = runs(gone, block.byte_starts, block.byte_ends)
    doc = np.repeat(np.arange(len(block.ids)), np.diff(cuts)) if len(block.ids) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(gone)]
    removed = total[block.byte_ends] - total[block.byte_starts]
    size = block.byte_ends - block.byte_starts
    span = pa.StructArray.from_arrays([pa.array(first - block.byte_starts[doc]), pa.array(last - block.byte_starts[doc])], names=["start", "end"])
    offsets = np.r_[0, np.cumsum(size - removed)]
    kept = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                                                 pa.py_buffer(block.buf[~gone].tobytes())]).cast(pa.binary())
    return pa.table({"doc_id": pa.array(block.ids, mask=block.null), "n_bytes": pa.array(size), "n_removed": pa.array(removed),
                     "spans": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), span), "kept": kept})


def remove_earlier_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, period: int = 57,
                         block_mb: int = 8) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Texts are UTF-8 bytes; order is by id (null last), then place. Returns per document its id, byte count, removed count,
    the maximal removed spans and the remaining bytes. Strings never cross documents and are judged on the input.

    Suffixes are settled in two steps (see ``repeats``): ranks of the difference-cover sample decide which suffixes can tie with
    another for the whole length, then those are sorted bucket by bucket. Only equality over ``length`` bytes matters here, so
    suffixes are ordered by a 64-bit fingerprint of that prefix and not by the bytes themselves.

    Null or empty text: no bytes, nothing removed, kept is empty. Texts shorter than ``length``: nothing removed. Rows that
    share an id are ordered by text; of identical rows one keeps its bytes. An empty table gives an empty table. Other columns,
    whatever their names, are not read. A single document is held by one task.
    """
    s = Search("byte", length, period, True)
    if s.sample_length < 8:
        raise ValueError("the period must leave sample windows of at least 8 bytes")
    return search(docs, s, kept_bytes, SCHEMA, id_col, text_col, block_mb)
