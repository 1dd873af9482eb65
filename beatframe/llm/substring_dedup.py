"""Word runs that occur anywhere else in the corpus, found through anchors at difference-cover places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beatframe.llm.repeats import Block, Search, search

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def kept_words(block: Block, gone: np.ndarray) -> pa.Table:
    """Kept words of each document, joined by one space."""
    n_docs, stay = len(block.ids), ~gone
    doc = np.repeat(np.arange(n_docs), block.ends - block.starts)
    at = np.flatnonzero(stay)
    follows = np.zeros(len(at), bool)
    follows[:-1] = doc[at][1:] == doc[at][:-1]
    edge = np.zeros(len(block.buf) + 1, np.int8)
    np.add.at(edge, block.word_starts[at], 1)
    np.add.at(edge, block.word_stops[at], -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    gap = block.word_stops[at[follows]]
    keep[gap] = True
    buf = block.buf.copy()
    buf[gap] = 32
    total = np.r_[0, np.cumsum(keep)]
    offsets = np.r_[0, np.cumsum(total[block.byte_ends] - total[block.byte_starts])]
    kept = pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                                              pa.py_buffer(buf[keep].tobytes())]).cast(pa.string())
    lost = np.r_[0, np.cumsum(gone)]
    return pa.table({"doc_id": pa.array(block.ids, mask=block.null), "n_words": pa.array(block.ends - block.starts),
                     "n_removed": pa.array(lost[block.ends] - lost[block.starts]), "kept": kept})


def remove_shared_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, period: int = 21,
                        block_mb: int = 16) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts at more than one place, all its places included.

    Words are runs of bytes other than space and 0x09 to 0x0D. Returns per document its id, word count, removed count and the
    kept words joined by one space. Anchors are windows of ``window - period + 1`` words at difference-cover places, so any two
    equal sequences share an anchor at the same distance from their starts; around each anchor that occurs twice, all sequences
    holding it are compared over their full length. Sequences never cross documents and are judged on the input.

    Null or empty text: no words, kept is empty. Texts shorter than ``window`` words lose nothing. Rows that share an id are
    separate documents. An empty table gives an empty table. Other columns, whatever their names, are not read.
    """
    s = Search("word", window, period, False)
    if s.sample_length < 1:
        raise ValueError("the window must be at least as long as the period")
    return search(docs, s, kept_words, SCHEMA, id_col, text_col, block_mb)
