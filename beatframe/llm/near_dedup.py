"""Near-duplicate documents: MinHash bands, odd sketches, exact sets.

A document's set is its distinct word shingles. Equal sets are one node. Nodes that share a band of MinHash values are compared by
odd sketch: the MinHash samples folded into a parity bitmap, so that the population count of the XOR of two bitmaps gives the
number of samples in which the sets differ. Sketch links only cut the nodes into loose groups; inside a loose group the full sets
decide. Both comparisons give back spanning links, never all pairs, and run on blocks of bounded size: large groups are cut into
blocks, the groups found in the blocks are joined through one member each, and the members outside a key's main group are then
compared with every block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beatframe.llm.base import C1, C2, C3, attach, mix64, stage, text_buffers, unit_table, window_hash, word_hash, word_spans
from beatframe.llm.components import components

BANDS, ROWS, BITS = 26, 5, 512
SAMPLES = BANDS * ROWS
SKETCH = "doc_id bigint, th bigint, n bigint, node binary, bands array<bigint>, sketch binary"
LINK = "a binary, b binary"


# ---------------------------------------------------------------- sets and sketches
def lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of every text, end to end, and their n+1 offsets."""
    buf = lower(buf)
    ws, we = word_spans(buf, off[1:])
    wh = word_hash(buf, ws, we)
    lo, hi = np.searchsorted(ws, off[:-1]), np.searchsorted(ws, off[1:])
    runs = window_hash(wh, size)
    sets = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if b - a >= size:
            h = np.sort(runs[a:b - size + 1])
            sets.append(h[np.r_[True, h[1:] != h[:-1]]])
        else:  # all words as one; the length keeps it apart from true shingles
            sets.append(mix64(window_hash(wh[a:b], b - a) + np.uint64(b - a) * C1) if b > a else np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def sketches(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node key (16 bytes), band values and odd sketch of every non-empty set."""
    at, n = off[:-1], len(off) - 1
    keys = np.stack([np.add.reduceat(mix64(x), at), np.add.reduceat(mix64(x ^ C3), at)], axis=1)
    short = (x >> np.uint64(32)).astype(np.uint32)
    mult = (unit_table(SAMPLES, 1000) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (unit_table(SAMPLES, 5000) >> np.uint64(32)).astype(np.uint32)
    bands, sketch = np.zeros((n, BANDS), np.uint64), np.zeros((n, BITS // 64), np.uint64)
    doc, tags = np.arange(n), unit_table(BANDS, 9000)
    for k in range(SAMPLES):
        least = np.minimum.reduceat(short * mult[k] + add[k], at).astype(np.uint64)
        band = k // ROWS
        bands[:, band] = mix64(bands[:, band] * C2 + least + tags[band])
        bit = mix64(least * C1 + np.uint64(k)) % np.uint64(BITS)
        sketch[doc, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return keys, bands, sketch


def most_different(similarity: float, deviations: float) -> int:
    """XOR population count up to which two sketches may belong to sets of this similarity."""
    p = 1 - similarity
    differ = SAMPLES * p + deviations * np.sqrt(SAMPLES * p * (1 - p))
    mean = BITS / 2 * (1 - np.exp(-4 * min(differ, SAMPLES) / BITS))
    return int(np.ceil(mean + deviations / 2 * np.sqrt(mean) / 2))


def slices(off: np.ndarray, most: int = 8 << 20):
    """Ranges of rows with at most ``most`` bytes (or one row)."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b
        a = b


def sketch_documents(size: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(2)
            buf, off = text_buffers(col.fill_null("") if col.null_count else col)
            for a, b in slices(off):
                x, at = shingle_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                null = [None] * (b - a)
                node, bands, sketch = list(null), list(null), list(null)
                if len(full):
                    keys, values, bits = sketches(x, np.r_[at[:-1][full], at[-1]])
                    for j, i in enumerate(full):
                        node[i], bands[i], sketch[i] = keys[j].tobytes(), values[j].view(np.int64), bits[j].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int64)), pa.array(node, pa.binary()),
                                                  pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                                                 names=["doc_id", "th", "n", "node", "bands", "sketch"])
    return run


def set_documents(size: int):
    """Full sets of documents: (grp, node, body)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = text_buffers(batch.column(2))
            for a, b in slices(off):
                x, at = shingle_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], size)
                body = [x[p:q].tobytes() for p, q in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(body, pa.binary())], names=["grp", "node", "body"])
    return run


# ---------------------------------------------------------------- links inside blocks
def sketch_links(most: int):
    """Compare sketches: a matrix of words per block, similar when few bits differ."""
    def prepare(bodies):
        m = np.frombuffer(b"".join(bodies), np.uint64).reshape(len(bodies), -1)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            return np.bitwise_count(m[others] ^ m[i]).sum(axis=1, dtype=np.int64) <= most
        return similar
    return prepare


def set_links(percent: int):
    """Compare full sets: 100 * intersection >= percent * union, over the block's shingles in vertical order."""
    def prepare(bodies):
        size = np.array([len(b) // 8 for b in bodies])
        x = np.frombuffer(b"".join(bodies), np.uint64)
        owner = np.repeat(np.arange(len(bodies)), size)
        order = np.argsort(x, kind="stable")
        s = x[order]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        ends = np.r_[head[1:], len(s)]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.repeat(np.arange(len(head)), ends - head)
        holders, start = owner[order], np.r_[0, np.cumsum(size)]

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            mine = rank[start[i]:start[i + 1]]
            n = ends[mine] - head[mine]
            base = np.repeat(head[mine] - (np.cumsum(n) - n), n)
            both = np.bincount(holders[base + np.arange(int(n.sum()))], minlength=len(size))[others]
            return 100 * both >= percent * (size[i] + size[others] - both)
        return similar
    return prepare


def link_block(groups: np.ndarray, minor: np.ndarray, similar) -> list[tuple[int, int]]:
    """Spanning links between members of different groups of a block.

    First everybody against the first member, then each member still outside the first one's group against all others. With
    ``minor`` marks, only pairs with a marked member count: the rest was compared before.
    """
    n, out, roots = len(groups), [], groups.copy()

    def join(i: int, hits: np.ndarray) -> None:
        for r in np.unique(roots[hits]).tolist():
            if r != roots[i]:
                out.append((i, int(hits[np.flatnonzero(roots[hits] == r)[0]])))
                roots[roots == max(r, roots[i])] = min(r, roots[i])
    if minor.all():
        others = np.arange(1, n)
        join(0, others[similar(0, others)])
        todo = range(1, n)
    else:
        todo = np.flatnonzero(minor).tolist()
    for i in todo:
        if not (minor.all() and roots[i] == roots[0]):
            others = np.flatnonzero(roots != roots[i])
            if len(others):
                join(i, others[similar(i, others)])
    return out


def link_parts(prepare: Callable):
    """One task's share: many small blocks; rows are (grp, block, node, label, minor, body)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("block", "ascending"), ("node", "ascending")])
        grp, block = table.column("grp").to_pylist(), table.column("block").to_numpy()
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        minor, body = table.column("minor").to_numpy(), table.column("body").to_pylist()
        a_out, b_out, a = [], [], 0
        while a < len(grp):
            b = a + 1
            while b < len(grp) and grp[b] == grp[a] and block[b] == block[a]:
                b += 1
            numbers: dict = {}
            groups = np.array([numbers.setdefault(x, len(numbers)) for x in label[a:b]])
            if len(numbers) > 1:
                for i, j in link_block(groups, minor[a:b], prepare(body[a:b])):
                    a_out.append(node[a + i])
                    b_out.append(node[a + j])
            a = b
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})
    return run


def in_parts(rows: DataFrame, prepare: Callable, part_rows: int, total: int) -> DataFrame:
    parts = max(1, -(-total // part_rows))
    return rows.withColumn("part", F.pmod(F.xxhash64("grp", "block"), F.lit(parts))).select(
        "part", "grp", "block", "node", "label", "minor", "body").groupBy("part").applyInArrow(link_parts(prepare), LINK)


def label_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the current group of their node (a node has few rows, so this join has no hot key)."""
    found = labels.select("node", F.col("label").alias("found"))
    return rows.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")


def links(rows: DataFrame, prepare: Callable, block_rows: int, part_rows: int, name: str, one_task: int = 0) -> DataFrame | None:
    """Spanning links of all similar nodes that share a group key; rows are (grp, n, node, body), n the size of the group.

    Groups up to ``block_rows`` are one block. Larger ones are cut by a hash of the node; then, until nothing new is found, one
    member of every part found so far is compared, in blocks again; at last the members outside the main part of their group are
    copied to all its blocks.
    """
    total = rows.count()
    block = F.pmod(F.xxhash64("node", "grp"), F.ceil(F.col("n") / block_rows))
    first = rows.withColumn("block", block).withColumn("label", F.col("node")).withColumn("minor", F.lit(True))
    found = stage(in_parts(first, prepare, part_rows, total), f"{name}-links", total)
    big = rows.where(F.col("n") > block_rows)
    if big.isEmpty():
        return found
    before = -1
    while True:
        labels = components(found, one_task=one_task)
        now = label_rows(big, labels)
        heads = now.groupBy("grp", "label").agg(F.min("node").alias("node"))
        sizes = heads.groupBy("grp").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
        count = sizes.agg(F.sum("parts")).first()[0] or 0
        if not count:
            return found
        if count == before:
            break
        before = count
        ones = heads.join(sizes, "grp").join(big.select("grp", "node", "body"), ["grp", "node"]).withColumn(
            "block", F.pmod(F.xxhash64("node", "grp", F.lit(count)), F.ceil(F.col("parts") / block_rows))).withColumn("minor", F.lit(True))
        found = stage(found.unionByName(in_parts(ones, prepare, part_rows, count)), f"{name}-links")
    # what is left: members outside the main part against every block of their group
    shares = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("share"))
    main = shares.groupBy("grp").agg(F.max(F.struct("share", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rest = now.join(main.select("grp", F.col("top.label").alias("top")), "grp").withColumn("minor", F.col("label") != F.col("top"))
    blocks = F.ceil(F.col("n") / block_rows)
    spread = rest.withColumn("block", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))))
    return stage(found.unionByName(in_parts(spread, prepare, part_rows, spread.count())), f"{name}-links")


# ---------------------------------------------------------------- the operator
def fetch_texts(docs: DataFrame, asked: DataFrame, n: int, most: int = 500_000, pieces: int = 8) -> DataFrame:
    """Inner join of (doc_id, th, text) with ``n`` rows (rep_id, rep_th, node, ...) that ask for a text.

    Few texts are asked for, so up to ``pieces`` times ``most`` rows (about 50 MB each) are broadcast, a scan of the texts for each,
    and no text is shuffled; more rows are joined by key.
    """
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))
    parts = max(1, -(-n // most))
    if parts > pieces:
        return docs.join(asked, same)
    cuts = [asked.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [asked]
    return reduce(DataFrame.unionByName, [docs.join(F.broadcast(c), same) for c in cuts])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, deviations: float = 5.0,
                    block_rows: int = 4096, part_rows: int = 50_000, heavy: int = 1000, one_task: int = 0) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept and label for every row.

    Words are runs other than space and 0x09 to 0x0D with A-Z in lower case; a set holds the distinct runs of ``shingle`` words,
    or all words as one if there are fewer. Two documents are linked when 100 * intersection >= percent * union over the full
    sets; component_id is the smallest id that links reach, kept marks the rows that bear it.

    26 bands of 5 MinHash values miss a pair at similarity 0.85 with probability 2.4e-7, at 0.8 with 3.2e-5; sketches let pairs through up to
    ``deviations`` standard deviations under the limit. No cap is set on partners. Link tables of up to ``one_task`` rows are
    contracted in one task.

    Null and empty texts, and texts without words, have an empty set, are linked with nothing and kept. Null ids come after all
    others: a group of only such rows has a null component_id and all its rows are kept. Repeated rows fall into one group, and
    all rows with its smallest id are marked kept. label is a key of the group, null for empty sets. An empty table gives an empty table. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    sk = stage(d.mapInArrow(sketch_documents(shingle), SKETCH), "sketches")
    n_docs, full = sk.count(), sk.where("n > 0")
    nodes = stage(full.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep"),
                                           F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes", n_docs, 20_000)
    total = nodes.count() * BANDS
    slim = nodes.select("node", F.explode("bands").alias("grp"))
    shared = slim.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = attach(slim, shared, ["grp"], F.xxhash64("node"), total, heavy)
    rows = stage(met.join(nodes.select("node", F.col("sketch").alias("body")), "node"), "bands", total // 8)
    loose = components(links(rows, sketch_links(most_different(percent / 100, deviations)), block_rows, part_rows, "loose", one_task), heavy, one_task=one_task)
    sizes = loose.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = stage(attach(loose, sizes, ["label"], F.xxhash64("node"), total, heavy).join(nodes.select("node", "rep"), "node"), "members", n_docs)
    asked = members.select("node", F.col("label").alias("grp"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")).distinct()
    texts = fetch_texts(d.where("text IS NOT NULL"), asked, members.count())
    sets = texts.select("grp", "node", "text").mapInArrow(set_documents(shingle), "grp binary, node binary, body binary").dropDuplicates(["node"])
    exact = stage(sets.join(members.select("node", "n"), "node").select("grp", "n", "node", "body"), "sets", n_docs, 2_000)
    label = components(links(exact, set_links(percent), max(1, block_rows // 8), max(1, part_rows // 32), "exact", one_task), heavy, one_task=one_task)
    of = nodes.select("node", "n", F.col("rep.doc_id").alias("doc_id")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("component_id"))
    named = attach(of.select("node", "label", F.col("n").alias("rows")), least.select("label", "n", "component_id"), ["label"], F.xxhash64("node"), total // BANDS, heavy)
    out = attach(full.select("doc_id", "th", F.col("n").alias("n_shingles"), "node"), named.select("node", F.col("rows").alias("n"), "component_id", "label"), ["node"],
                 F.xxhash64("doc_id", F.monotonically_increasing_id()), n_docs, heavy).select("doc_id", "th", "n_shingles", "component_id", "label")
    none = sk.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                   F.lit(None).cast("binary").alias("label"))
    return out.unionByName(none).select("doc_id", F.col("th").alias("text_hash"), "n_shingles", "component_id",
                                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "label")
