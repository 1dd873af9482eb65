"""Exact inner-product top-k by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

ROW = "query_id bigint, query_row bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) per component; rows without an id or with a null or non-finite component are left out."""
    sound = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    wide = F.raise_error(F.lit("a component passes 64 bits"))
    whole = lambda x: F.when(F.abs(scale * x.cast("double")) < 2.0 ** 63, F.floor(scale * x.cast("double")).cast("bigint")).otherwise(wide)
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, whole).alias("v"))


def matrices(table: pa.Table, *extra: str) -> dict[int, tuple]:
    """Vectors of a cell by dimension: (vertical matrix, ids, extra columns ...)."""
    col = table.column("v").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.int64()))
    off = np.asarray(col.offsets, dtype=np.int64)
    flat, size = np.asarray(col.values, dtype=np.int64), np.diff(off)
    others = [table.column(c).to_numpy() for c in ("id", *extra)]
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        m = flat[off[at][:, None] + np.arange(d)]
        out[int(d)] = (np.ascontiguousarray(m.T), *[o[at] for o in others])
    return out


def number_type(a: np.ndarray, b: np.ndarray):
    """A type in which all sums of products are exact; Python's integers where 64 bits might not do."""
    if not a.size or not b.size:
        return np.int64
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[0]
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 62 else object


def ranked(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, highest score first, then smaller id."""
    if score.dtype != object:
        return np.lexsort((ids, -score))[:k]
    best = np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if any(abs(x) >= 2 ** 63 for x in score[best]):
        raise OverflowError("the inner product of two vectors passes 64 bits")
    return best


def best_of(q: np.ndarray, cand: np.ndarray, rest: np.ndarray, keep: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all candidates that can be among the k best.

    Products are summed over blocks of ``step`` dimensions. After each block a candidate's score lies within partial sum plus or
    minus |rest of q| * |rest of candidate|; those whose upper bound is under the k-th best lower bound leave. Numbers that doubles
    can't hold, for which such bounds would be rounded, are summed to the end.
    """
    at, part = keep, np.zeros(len(keep), cand.dtype)
    tail = np.sqrt(np.r_[np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], 0.0])
    whole, exact = len(keep) == cand.shape[1], cand.dtype.kind == "f"
    for b, lo in enumerate(range(0, len(q), step)):
        block = cand[lo:lo + step]
        part = part + q[lo:lo + step] @ (block if whole else block[:, at])
        if exact and len(at) > k and lo + step < len(q):
            slack = tail[lo + step] * rest[b + 1][at] * (1 + 1e-6) + 1e-6
            value = part.astype(np.float64)
            floor = np.partition(value - slack, len(at) - k)[len(at) - k]
            stay = value + slack >= floor
            if stay.sum() < 0.8 * len(at):
                at, part, whole = at[stay], part[stay], False
    return at, part


def search_cell(k: int, step: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            cands = matrices(candidates)
            for d, (qm, qid, qrow) in matrices(queries, "query_row").items():
                if d not in cands:
                    continue
                cm, cid = cands[d]
                kind = number_type(qm, cm)
                qm, cm = qm.astype(kind), cm.astype(kind)
                square = cm.astype(np.float64) ** 2
                rest = [np.sqrt(square[lo:].sum(axis=0)) for lo in range(0, max(d, 1), step)]
                for j in range(len(qid)):
                    own = np.flatnonzero(cid != qid[j])
                    at, score = best_of(qm[:, j], cm, rest, own, k, step)
                    best = ranked(score, cid[at], k)
                    out["query_id"].append(np.full(len(best), qid[j]))
                    out["query_row"].append(np.full(len(best), qrow[j]))
                    out["vec_id"].append(cid[at[best]])
                    out["score"].append(score[best].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for n, x in out.items()})
    return run


def top_k_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64,
                   step: int = 8, query_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """The k highest integer inner products of every query row against all rows with another id, ties to the smaller id.

    Components become floor(scale * x). Queries and candidates are dealt evenly into a grid; each cell, a task of at most about
    ``query_rows`` by ``candidate_rows``, holds its candidates by dimension and discards them block by block (see ``best_of``),
    and the k best of the cells of a query are merged. Larger cells copy the vectors fewer times.

    Rows whose id is null, and vectors that are null or hold a null, NaN or infinite component, take no part. Only vectors of equal
    length are compared; empty vectors score 0 with each other. Rows that share the query's id count as the query itself; a repeated
    query row is answered again, a repeated candidate row counts each time. Fewer than k candidates: all. Empty tables give none. Components
    of 2^63 or more after scaling, and scores among the k best that pass 64 bits, are an error, never a wrapped number.
    """
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(vectors.where(is_query), id_col, vec_col, scale)
    n_rows, n_asked = rows.count(), asked.count()
    down, across = max(1, -(-n_asked // query_rows)), max(1, -(-n_rows // candidate_rows))
    place = F.monotonically_increasing_id()
    q = asked.withColumn("query_row", place).withColumn("q", F.pmod("query_row", F.lit(down))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    c = rows.withColumn("c", F.pmod(place, F.lit(across))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cell = [F.col("q").cast("bigint").alias("q"), F.col("c").cast("bigint").alias("c")]
    found = q.select(*cell, "id", "query_row", "v").groupBy("q", "c").cogroup(c.select(*cell, "id", "v").groupBy("q", "c")).applyInArrow(
        search_cell(k, step), ROW)
    by = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
