"""Runs of units (bytes or words) that start at more than one place of a corpus, found through a difference cover.

A set D is a difference cover modulo v if every remainder is a difference of two members. For any two starts i and j there is then
a shift d < v with i + d and j + d both in D modulo v, so two equal runs of ``length`` units hold equal windows of
``length - v + 1`` units at places of D. The search has two rounds over blocks of documents:

1. Only windows at places of D are fingerprinted (the cover sample). A run can occur twice only if the sample windows it holds
   include one that occurs twice; all other starts are settled here.
2. The remaining starts are fingerprinted over the full length, dealt into buckets by their leading fingerprint bits, and each
   bucket is sorted by itself in one bounded task.

Documents go through one shuffle, packed and compressed by block (a range of ids). What goes to the buckets are sorted
fingerprints, once per block however often they occur in it, as compressed differences; what comes back is one bit each. A
frequent passage therefore costs one entry per block, and no task holds all its places.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from beatframe.llm.base import BYTE_UNITS, text_buffers, window_hash, word_hash, word_spans

# Perfect difference sets by modulus (fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
HASH_PART = 1 << 18
PACK = "block int, payload binary"
MESSAGE = "bucket int, block int, payload binary"


class Search(NamedTuple):
    """What counts as a repeat: the unit, the run length, the cover, and whether the first place of a run is spared."""

    unit: str
    length: int
    period: int
    first_stays: bool
    buckets: int = 1
    sample_bits: int = 48

    @property
    def sample_length(self) -> int:
        return self.length - self.period + 1


# ---------------------------------------------------------------- blocks
def pack_documents(bounds: np.ndarray, flush: int = 32 << 20):
    """Map Arrow batches of (doc_id, text) to compressed pieces of blocks."""
    def emit(held):
        tab = pa.concat_tables(held).combine_chunks()
        ids = tab.column(0).combine_chunks() if tab.num_rows else pa.array([], pa.int64())
        null = np.asarray(ids.is_null())
        num = np.asarray(ids.fill_null(0), dtype=np.int64)
        block = np.where(null, len(bounds), np.searchsorted(bounds, num, side="right"))
        order = np.argsort(block, kind="stable")
        text = tab.column(1).cast(pa.large_string()).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0)
        missing = np.asarray(text.is_null())[order]
        buf, off = text_buffers(text.fill_null("").take(pa.array(order)))
        block, num, null = block[order], num[order], null[order]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        z, keys, out = zstandard.ZstdCompressor(level=3), [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            head = np.int64(b - a).tobytes() + num[a:b].tobytes() + np.diff(off[a:b + 1]).tobytes() + null[a:b].tobytes() + missing[a:b].tobytes()
            keys.append(block[a])
            out.append(z.compress(head + buf[off[a]:off[b]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], names=["block", "payload"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.nbytes
            if size >= flush:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)
    return run


class Block:
    """Documents of one block in the order of (doc_id with null last, text), and their units end to end."""

    def __init__(self, payloads, unit: str):
        ids, lens, null, missing, bufs = [], [], [], [], []
        z = zstandard.ZstdDecompressor()
        for p in payloads:
            raw = z.decompress(p)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids.append(np.frombuffer(raw, np.int64, n, 8))
            lens.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            null.append(np.frombuffer(raw, np.bool_, n, 8 + 16 * n))
            missing.append(np.frombuffer(raw, np.bool_, n, 8 + 17 * n))
            bufs.append(np.frombuffer(raw, np.uint8, -1, 8 + 18 * n))
        ids, lens, null, missing = (np.concatenate(x) for x in (ids, lens, null, missing))
        buf = np.concatenate(bufs)
        ends = np.cumsum(lens)
        order = np.lexsort((ids, null))
        same = np.flatnonzero((ids[order][1:] == ids[order][:-1]) & (null[order][1:] == null[order][:-1]))
        if len(same):  # repeated ids: their texts decide
            at = order.tolist()
            at.sort(key=lambda k: (null[k], ids[k], buf[ends[k] - lens[k]:ends[k]].tobytes()))
            order = np.array(at)
        if not np.array_equal(order, np.arange(len(order))):
            buf = np.concatenate([buf[ends[k] - lens[k]:ends[k]] for k in order])
        self.ids, self.null, self.missing, self.buf = ids[order], null[order], missing[order], buf
        self.byte_ends = np.cumsum(lens[order])
        self.byte_starts = self.byte_ends - lens[order]
        if unit == "word":
            self.word_starts, self.word_stops = word_spans(buf, self.byte_ends)
            self.units = word_hash(buf, self.word_starts, self.word_stops)
            self.starts = np.searchsorted(self.word_starts, self.byte_starts)
            self.ends = np.searchsorted(self.word_starts, self.byte_ends)
        else:
            self.units, self.starts, self.ends = None, self.byte_starts, self.byte_ends
        self.n = len(buf) if self.units is None else len(self.units)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the runs that start at the sorted places ``at``."""
        out, cuts = np.zeros(len(at), np.uint64), np.searchsorted(at, np.arange(0, self.n + HASH_PART, HASH_PART))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                lo = k * HASH_PART
                part = slice(lo, lo + HASH_PART + length - 1)
                u = BYTE_UNITS[self.buf[part]] if self.units is None else self.units[part]
                out[a:b] = window_hash(u, length)[at[a:b] - lo]
        return out

    def mask(self, length: int) -> np.ndarray:
        """Starts from which ``length`` units of the same document follow."""
        ok = np.zeros(self.n + 1, np.int32)
        fit = self.ends - self.starts >= length
        np.add.at(ok, self.starts[fit], 1)
        np.add.at(ok, self.ends[fit] - length + 1, -1)
        return np.cumsum(ok[:-1], out=ok[:-1]) > 0

    def sample(self, s: Search) -> np.ndarray:
        """Places of the difference cover, counted within each document."""
        inside = np.arange(self.n, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.ends - self.starts)
        member = np.zeros(s.period, bool)
        member[list(COVERS[s.period])] = True
        return np.flatnonzero(member[inside % s.period] & self.mask(s.sample_length))

    def open_starts(self, s: Search, repeated: np.ndarray) -> np.ndarray:
        """Starts whose run holds a repeated sample window."""
        seen = np.zeros(self.n + s.period + 1, np.int32)
        seen[1:self.n + 1][repeated] = 1
        np.cumsum(seen, out=seen)
        seen[self.n + 1:] = seen[self.n]
        return np.flatnonzero((seen[s.period:s.period + self.n] > seen[:self.n]) & self.mask(s.length))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is much faster here than numpy's hash table."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


class Distinct:
    """Distinct fingerprints of a block, sorted, with the group of every place."""

    def __init__(self, h: np.ndarray):
        self.order = np.argsort(h)
        sorted_ = h[self.order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(h) else np.zeros(0, bool)
        self.heads = np.flatnonzero(new)
        self.values = sorted_[self.heads]
        self.counts = np.diff(np.r_[self.heads, len(h)])

    def spread(self, per_group: np.ndarray) -> np.ndarray:
        """A value per group, back at the places."""
        out = np.empty(len(self.order), per_group.dtype)
        out[self.order] = np.repeat(per_group, self.counts)
        return out

    def first_place(self) -> np.ndarray:
        """True at the first place of every group."""
        out = np.zeros(len(self.order), bool)
        if len(self.heads):
            out[np.minimum.reduceat(self.order, self.heads)] = True
        return out


# ---------------------------------------------------------------- messages
def encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct fingerprints as compressed byte planes of their differences."""
    planes = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:(bits + 7) // 8]).tobytes())


def decode(payload: bytes, bits: int) -> np.ndarray:
    width = (bits + 7) // 8
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(width, -1)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, :width] = raw.T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def bucket_cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where the buckets of the leading bits begin in sorted values."""
    edge = (np.arange(1, buckets, dtype=np.uint64)) << np.uint64(bits - int(np.log2(buckets)))
    return np.r_[0, np.searchsorted(values, edge), len(values)]


def send(block: int, values: np.ndarray, buckets: int, bits: int) -> pa.Table:
    cuts, keys, out = bucket_cuts(values, buckets, bits), [], []
    for k in range(buckets):
        if cuts[k + 1] > cuts[k]:
            keys.append(k)
            out.append(encode(values[cuts[k]:cuts[k + 1]], bits))
    return pa.table({"bucket": pa.array(keys, pa.int32()), "block": pa.array([block] * len(keys), pa.int32()), "payload": pa.array(out, pa.binary())})


def receive(answers: list[tuple[int, bytes]], n: int) -> np.ndarray:
    """Bits of a block's distinct fingerprints, in their order."""
    if not n:
        return np.zeros(0, bool)
    parts = []
    for _, payload in sorted(answers):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        parts.append(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8), count=int(np.frombuffer(raw, np.int64, 1)[0])))
    bits = np.concatenate(parts).astype(bool)
    if len(bits) != n:
        raise ValueError("answers do not fit the block's fingerprints")
    return bits


def sort_bucket(bits: int, only_later: bool):
    """One bucket: sort its fingerprints and mark those that another (or, with only_later, an earlier) block holds too."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy())
        blocks = table.column("block").to_numpy()[order]
        payloads = table.column("payload").to_pylist()
        lists = [decode(payloads[k], bits) for k in order]
        sizes = np.array([len(x) for x in lists])
        h = np.concatenate(lists)
        if only_later:
            at = np.argsort(h, kind="stable")  # lists are in block order, so the first of equals is the earliest block
            s = h[at]
            hit = np.r_[False, s[1:] == s[:-1]]
        else:
            at = np.argsort(h)
            s = h[at]
            eq = s[1:] == s[:-1]
            hit = np.r_[False, eq] | np.r_[eq, False]
        mark = np.empty(len(h), bool)
        mark[at] = hit
        z, ends, out = zstandard.ZstdCompressor(level=1), np.cumsum(sizes), []
        for b, n in zip(ends, sizes):
            out.append(z.compress(np.int64(n).tobytes() + np.packbits(mark[b - n:b]).tobytes()))
        return pa.table({"bucket": table.column("bucket").combine_chunks().slice(0, 1).take(pa.array([0] * len(out))) if len(out) else pa.array([], pa.int32()),
                         "block": pa.array(blocks, pa.int32()), "payload": pa.array(out, pa.binary())})
    return run


FULL_BITS = 64


def answers_of(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(r["bucket"], r["payload"]) for r in table.to_pylist() if r["kind"] == kind]


def repeated_sample(block: Block, s: Search, table: pa.Table) -> np.ndarray:
    """Places of the sample whose window occurs elsewhere."""
    at = block.sample(s)
    d = Distinct(block.hashes(at, s.sample_length) >> np.uint64(64 - s.sample_bits))
    return at[d.spread((d.counts > 1) | receive(answers_of(table, 1), len(d.values)))]


def send_sample(s: Search):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table.column("payload").to_pylist(), s.unit)
        h = block.hashes(block.sample(s), s.sample_length) >> np.uint64(64 - s.sample_bits)
        return send(table.column("block")[0].as_py(), distinct(h), s.buckets, s.sample_bits)
    return run


def send_open(s: Search):
    def run(packed: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(packed.column("payload").to_pylist(), s.unit)
        at = block.open_starts(s, repeated_sample(block, s, bits))
        return send(packed.column("block")[0].as_py(), distinct(block.hashes(at, s.length)), s.buckets, FULL_BITS)
    return run


def covered(block: Block, s: Search, bits: pa.Table) -> np.ndarray:
    """True at every unit that lies in a repeated run."""
    at = block.open_starts(s, repeated_sample(block, s, bits))
    d = Distinct(block.hashes(at, s.length))
    other = receive(answers_of(bits, 2), len(d.values))
    hit = d.spread(other) | ~d.first_place() if s.first_stays else d.spread(other | (d.counts > 1))
    edge = np.zeros(block.n + 1, np.int32)
    edge[at[hit]] += 1
    edge[at[hit] + s.length] -= 1
    return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def search(docs: DataFrame, s: Search, finish, schema: str, id_col: str, text_col: str, block_mb: int) -> DataFrame:
    """Run both rounds and call ``finish(block, covered)`` for every block."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_mb << 20)))
    probs = [k / n for k in range(1, n)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, probs)), F.lit(max(10_000, 100 * n))).alias("q")).first()[0] if probs else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    # Sample fingerprints only open starts for the second round: 10 bits over the corpus size open one start too many in a thousand.
    s = s._replace(buckets=1 << max(2, int(n - 1).bit_length()), sample_bits=min(56, -(-(int(total).bit_length() + 10) // 8) * 8))
    packed = rows.mapInArrow(pack_documents(bounds), PACK).groupBy("block")

    def answers(messages: DataFrame, bits: int, later: bool, kind: int) -> DataFrame:
        return messages.groupBy("bucket").applyInArrow(sort_bucket(bits, later), MESSAGE).withColumn("kind", F.lit(kind))

    one = answers(packed.applyInArrow(send_sample(s), MESSAGE), s.sample_bits, False, 1)
    two = answers(packed.cogroup(one.groupBy("block")).applyInArrow(send_open(s), MESSAGE), FULL_BITS, s.first_stays, 2)

    def last(pieces: pa.Table, bits: pa.Table) -> pa.Table:
        block = Block(pieces.column("payload").to_pylist(), s.unit)
        return finish(block, covered(block, s, bits))
    return packed.cogroup(one.unionByName(two).groupBy("block")).applyInArrow(last, schema)
