"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from beatframe.llm.base import n_words

FIT = "source string, source_size bigint, target double, size bigint, base bigint, extra bigint"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Target words per source: (source, source_size) in, target added.

    Sources in code point order, null last, take the weights in turn. Filling by weight with a ceiling per source has one level:
    the sources with the lowest ceiling per weight are full, the rest share what is left.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(whole)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    return t.withColumn("found", level).select("source", "source_size", F.least(F.coalesce(F.col("found") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def closest_subset(lengths: list[int], counts: list[int], budget: int, reach: int) -> list[int]:
    """How many of each length to take so that the sum is nearest to the budget (bounded knapsack over a bitset of sums).

    Bit s of a set says that sum s can be reached. Counts are cut into powers of two; the way back reads the stored sets. Sums up
    to ``budget + reach`` are kept, so a slight excess may win over a shortfall.
    """
    limit = (1 << (budget + reach + 1)) - 1
    sets, parts, now = [], [], 1
    for i, (size, n) in enumerate(zip(lengths, counts)):
        piece = 1
        while n > 0 and not now >> budget & 1:
            m = min(piece, n)
            n, piece = n - m, piece * 2
            if size * m > budget + reach:
                break
            sets.append(now)
            parts.append((i, m))
            now |= (now << size * m) & limit
    under = (now & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = now >> budget
    above = budget + (over & -over).bit_length() - 1 if over else None
    goal = above if above is not None and above - budget < budget - under else under
    take = [0] * len(lengths)
    for before, (i, m) in zip(reversed(sets), reversed(parts)):
        if not before >> goal & 1:
            goal -= lengths[i] * m
            take[i] += m
    return take


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float, most: int, seed: int) -> tuple[int, np.ndarray]:
    """Copies that every document gets, and how many documents of each length get one more."""
    size = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if not size:
        return 1, extra
    base = min(int(target // size), most)
    budget = int(round(target - base * size))
    if base >= most or budget <= 0:
        return base, extra
    if budget >= size:
        return base + 1, extra
    extra = np.clip((counts * (budget / size)).astype(np.int64) - 1, 0, counts)  # the same share of every length, less one to leave a choice
    extra[lengths == 0] = 0
    left, widest = budget - int((extra * lengths).sum()), int(lengths.max())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:  # one more of a length, in seeded order, while much is left
        if left > 2 * widest and extra[i] < counts[i] and 0 < lengths[i]:
            extra[i] += 1
            left -= int(lengths[i])
    if left > 2 * widest:
        for i in order:
            if lengths[i] and left > 2 * widest:
                m = int(min(counts[i] - extra[i], (left - 2 * widest) // lengths[i]))
                extra[i] += m
                left -= m * int(lengths[i])
    order = [i for i in order if 0 < lengths[i] and extra[i] < counts[i]]
    take = closest_subset([int(lengths[i]) for i in order], [int(counts[i] - extra[i]) for i in order], left, min(widest, left))
    for i, m in zip(order, take):
        extra[i] += m
    return base, extra


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1),
                most: int = 3, seed: int = 0, parts: int = 256) -> DataFrame:
    """Every row with how often the mix takes it: columns row (all given columns), size, source_size, target, copies.

    The mix is as large as the corpus in words. Each source gets as many whole passes as its target holds; the remaining budget is
    fitted on the counts per exact length: the same share of every length first, then a bounded knapsack over what is left. Which
    documents of a length are taken follows a seeded hash of the id; a length's documents are cut into ``parts`` by that hash,
    whole parts are taken by count, and only the part at the edge is ranked. One source's counts per length are fitted in one
    task; they are bounded by the longest text, not by the number of documents.

    Null and empty texts have size 0 and are kept once in a source with no words, else with its whole passes (at least one). Null
    is a source of its own. Repeated rows are separate documents; which of several equal ones is taken makes no difference. An
    empty table gives an empty table; clashing column names are safe inside ``row``.
    """
    d = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
                    F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")).withColumn("part", F.pmod("h", F.lit(parts)))
    counts = d.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    spectrum = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(spectrum.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        base, extra = fit_source(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), most, seed)
        return pdf[["source", "source_size", "target", "size"]].assign(base=base, extra=extra)
    fitted = spectrum.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.source", "source_size", "target", "size", "n").groupBy("source").applyInPandas(fit, FIT)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("ahead", ahead).alias("p").join(
        fitted.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")) & (F.col("p.size") == F.col("f.size"))).select(
        F.col("p.source").alias("p_source"), F.col("p.size").alias("p_size"), F.col("part").alias("p_part"), "n", "source_size", "target", "base",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("ahead"))).alias("take"))
    j = d.join(cut, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")))
    edge = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", F.col("row").getField(id_col)))
    whole = j.where(~edge).withColumn("more", (F.col("take") > 0).cast("bigint"))
    some = j.where(edge).withColumn("rank", rank).withColumn("more", (F.col("rank") <= F.col("take")).cast("bigint")).drop("rank")
    copies = F.when(F.col("size") == 0, F.greatest(F.col("base"), F.lit(1))).otherwise(F.col("base") + F.col("more"))
    return whole.unionByName(some).select("row", "size", "source_size", "target", copies.alias("copies"))
