"""Ranked lexical search with bag deduplication: equal bags of terms are scored once."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from beatframe.llm.base import stage

#: Terms in bytes that were lower-cased: digits, a-z and every byte of a character beyond ASCII.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: An absent id sorts last.
LAST = np.iinfo(np.int64).max


def terms(text: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a whole text, in lists of about ``piece`` bytes of text each; no term is cut."""
    at, size = 0, len(text or b"")
    while at < size:
        cut = GAP.search(text, at + piece) if at + piece < size else None
        end = cut.start() if cut else size
        yield TERM.findall(text[at:end].lower())
        at = end


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Ids and distinct terms of the items, in blocks of at most ``most_items`` items and about ``most_terms`` terms."""
    ids, sets, held = [], [], 0
    for row in items.select(id_col, F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        found = set().union(*terms(bytes(row["text"]) if row["text"] is not None else None))
        if not found:
            continue
        if ids and (len(ids) >= most_items or held + len(found) > most_terms):
            yield ids, sets
            ids, sets, held = [], [], 0
        ids.append(row[id_col])
        sets.append(found)
        held += len(found)
    if ids:
        yield ids, sets


def bag_of(text: bytes | None, places: dict[bytes, int]) -> tuple[int, bytes]:
    """Number of all terms, and the known ones as ascending pairs (place, occurrences) of 32-bit numbers."""
    n, count = 0, Counter()
    for part in terms(text):
        n += len(part)
        count.update(part)
    known = sorted((places[t], c) for t, c in count.items() if t in places)
    return n, np.array(known, "<u4").tobytes()


def bags(docs: DataFrame, places: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats) and bag of every document."""
    def cut(batches):
        for b in batches:
            got = [bag_of(t.as_buffer().to_pybytes() if t.is_valid else None, places) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["id", "n", "bag"])
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return d.mapInArrow(cut, "id bigint, n bigint, bag binary")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bag index, term place and occurrences of every entry of the bags."""
    size = np.array([len(x.as_buffer()) // 8 for x in col], np.int64)
    pairs = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in col), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), pairs[:, 0], pairs[:, 1]


def term_counts(classes: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents that hold each term, from the classes and their sizes; one row per term and task is shuffled."""
    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            row, place, _ = flat(b.column("bag"))
            np.add.at(total, place, b.column("docs").to_numpy()[row])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "docs"])
    rows = classes.select("bag", "docs").mapInArrow(count, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    return {r["term"]: r["docs"] for r in rows.collect()}


def item_grids(members: list[list[int]], weight: np.ndarray, cells: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Items in blocks: number of the first one, the terms they use, and a grid (term, item) of weights of about ``cells`` cells."""
    out, lo = [], 0
    while lo < len(members):
        hi, used = lo, set()
        while hi < len(members) and (hi == lo or len(used | set(members[hi])) * (hi - lo + 1) <= cells):
            used |= set(members[hi])
            hi += 1
        cols = np.array(sorted(used), np.int64)
        grid = np.zeros((len(cols), hi - lo), np.int64)
        for i in range(lo, hi):
            at = np.searchsorted(cols, members[i])
            grid[at, i - lo] = weight[members[i]]
        out.append((lo, cols, grid))
        lo = hi
    return out


def best_classes(classes: DataFrame, members: list[list[int]], weight: np.ndarray, k: int, cells: int = 1 << 21) -> DataFrame:
    """item, class, score and least id of the ``k`` best classes of every item in each task.

    Scores of a block of classes and a block of items are one matrix product, in doubles while every sum is an exact whole number in
    them, else in 64-bit integers.
    """
    grids, n_terms = item_grids(members, weight, cells), len(weight)
    exact = float(weight.max(initial=0)) * 1e6 * max(map(len, members)) < 2 ** 53

    def score(batches):
        best = [(np.zeros(0, np.int64),) * 3 for _ in members]
        for b in batches:
            row, place, tf = flat(b.column("bag"))
            m, cid = b.column("m").to_numpy(), b.column("class").to_numpy()
            least = b.column("least").fill_null(LAST).to_numpy()
            part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            ends = np.searchsorted(row, np.arange(len(m) + 1))
            for first, cols, grid in grids:
                spot = np.full(n_terms, -1)
                spot[cols] = np.arange(len(cols))
                rows = max(1, cells // len(cols))
                for lo in range(0, len(m), rows):
                    hi = min(lo + rows, len(m))
                    s = slice(ends[lo], ends[hi])
                    at = spot[place[s]]
                    use = at >= 0
                    x = np.zeros((hi - lo, len(cols)), np.float64 if exact else np.int64)
                    x[row[s][use] - lo, at[use]] = part[s][use]
                    got = (x @ grid.astype(x.dtype)).astype(np.int64)
                    for i in range(got.shape[1]):
                        have, old = best[first + i], got[:, i]
                        new = np.flatnonzero(old >= max(1, have[0][-1] if len(have[0]) == k else 1))
                        if len(new) > k:
                            new = new[old[new] >= np.partition(old[new], -k)[-k]]
                        if len(new):
                            v = [np.concatenate(p) for p in zip(have, (old[new], least[lo + new], cid[lo + new]))]
                            order = np.lexsort((v[2], v[1], -v[0]))[:k]
                            best[first + i] = tuple(p[order] for p in v)
        out = [(i, *p) for i, p in enumerate(best) if len(p[0])]
        if out:
            cols = [np.concatenate([np.full(len(o[1]), o[0]) for o in out]), *(np.concatenate([o[j] for o in out]) for j in (3, 1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "class", "score", "least"])
    return classes.select("class", "m", "least", "bag").mapInArrow(score, "item bigint, class bigint, score bigint, least bigint")


def first_rows(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k per group and task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           k: int = 50, most_items: int = 1000, most_terms: int = 1 << 16) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest score above 0 for each item, equal scores by ascending id.

    Terms are runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased. With N documents that hold a term, L terms in all
    of them, n terms of one document, tf occurrences in it and df documents that hold the term, the weight of a term is
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and the score is the sum of
    w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

    Every document is cut to the items' vocabulary. Documents with the same occurrences and the same m score alike for every item, so they
    form a class: grouped by hash, held together only where m and all occurrences are equal, and scored once. The k best documents lie in
    the k classes that come first by score, then least id, so only those are expanded, each to its k first members; the limits
    apply before the shuffle, so a class of a third of all documents is no hot group.

    The items are a stated query set: they pass through the driver in blocks of ``most_items`` items and about ``most_terms`` distinct
    terms (an item with more is a block of its own), and every block is one pass over the documents.

    Null texts and texts without a term have no bag and are not counted in N; items without a term return nothing. Ids are integers; null
    ids come last. Repeated rows are separate documents (or items). An empty table gives an empty table. Other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("document ids must be integers")
    spark, out = docs.sparkSession, None
    kind = items.schema[item_col].dataType.simpleString()
    for ids, sets in item_blocks(items, item_col, item_text, most_items, most_terms):
        words = sorted(set().union(*sets))
        places = {t: i for i, t in enumerate(words)}
        b = stage(bags(docs, places, id_col, text_col), "bags")
        total = b.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        m = F.expr(f"50 + CAST((CAST(50 * n AS DECIMAL(20, 0)) * CAST({total['docs']} AS DECIMAL(18, 0))) DIV {total['terms']} AS BIGINT)")
        known = b.where(F.length("bag") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("m", "bag"))
        classes = known.groupBy("hash", "m", "bag").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("least"))
        classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        df = term_counts(classes, len(words))
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
        found = best_classes(classes, [sorted(places[t] for t in s) for s in sets], weight, k)
        best = stage(first_rows(found, ["item"], [F.desc("score"), "least", "class"], k, "place").select("item", "class", "score"), "best")
        chosen = classes.join(F.broadcast(best.select("class").distinct()), "class").select("class", "hash", "m", "bag")  # at most k rows an item
        asked = F.broadcast(chosen.select("hash").distinct())
        some = first_rows(known.join(asked, "hash"), ["hash", "m", "bag"], [F.asc_nulls_last("id")], k, "place").drop("place", "n")
        rows = best.join(some.join(chosen, ["hash", "m", "bag"]).select("class", "id"), "class")
        ranked = first_rows(rows, ["item"], [F.desc("score"), F.asc_nulls_last("id")], k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"item bigint, {item_col} {kind}"))
        part = ranked.join(names, "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id bigint, score bigint")
