"""Quality rules by robust multivariate outliers. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from beatframe.functions.lets import let
from beatframe.llm.base import attach, numbers, stage, words

DIMS = 5
#: Least standard deviation of each transformed statistic; added to the covariance, it keeps statistics that are all but constant usable.
FLOORS = (0.5, 0.12, 0.3, 0.3, 0.12)
#: Share of a group that the determinant is minimised over, the factor that makes its covariance consistent for normal data in five
#: dimensions, and the limit of squared distance (chi-square, five degrees of freedom, 0.99999).
SHARE, CONSISTENT, LIMIT = 0.75, 1.41, 30.86


def repeat_words(hashes: Column, window: int) -> Column:
    """Words in windows that occur twice or more; ``hashes`` holds one number per word."""
    def covered(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(ordered, lambda s: F.filter(F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
        return let(F.array_sort(again), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(
            F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))
    wins = let(hashes, lambda w: F.transform(numbers(F.size(w) - window + 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])))
    return let(wins, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_statistics(text: Column) -> Column:
    """Struct of the base statistics of a text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    word_counts = let(words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeat_words(F.transform(w, lambda x: F.xxhash64(x)), 5).alias("n_repeat_words")))
    symbols = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    return let(word_counts, lambda w: let(line_counts, lambda n: F.struct(
        w["n_words"].cast("bigint").alias("n_words"), w["word_chars"].alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        n["n_dup_lines"].cast("bigint").alias("n_dup_lines"), w["n_repeat_words"].cast("bigint").alias("n_repeat_words"), n["n_lines"].alias("n_lines"))))


def vector() -> list[Column]:
    """Transformed statistics; small counts in the denominators keep short texts steady."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [F.log1p(n), F.log((chars + 100) / (n + 20)), F.log1p(100 * F.col("n_symbols") / (chars + 100)),
            2 * F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1))), F.col("n_repeat_words") / (n + 20)]


def shape(rows: DataFrame) -> DataFrame:
    """Mean and lower Cholesky factor of the covariance per group."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(DIMS)],
                                   *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    out = sums
    for i in range(DIMS):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}") * CONSISTENT + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), c)
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("key", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 by forward substitution."""
    out = rows
    for i in range(DIMS):
        v = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        out = out.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    return out.withColumn("d2", reduce(lambda a, i: a + F.col(f"z{i}") ** 2, range(DIMS), F.lit(0.0)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", steps: int = 3,
                  least_rows: int = 50, most_groups: int = 20_000) -> DataFrame:
    """doc_id, base statistics, base_failed, distance2 and kept.

    Rows that pass the base rules are grouped by language and source. A group with fewer than ``least_rows`` of them is judged by the
    estimate of its language over all sources, and where the language has fewer, by that of the whole table. For each estimate the minimum covariance determinant is
    found from a start by medians and absolute deviations: the ``SHARE`` of rows with the least distances gives mean and covariance,
    which give new distances, ``steps`` times. A row is kept if its squared Mahalanobis distance is at most ``LIMIT``.

    Distances are cut at percentiles that combine before the shuffle, so a group of any size is spread over all tasks. The estimates
    (a row of 21 numbers per group) are broadcast up to ``most_groups`` groups; beyond, those of the largest groups are broadcast and the
    others joined by key.

    Null and empty texts have zeros and fail the base rules. Null language and null source are values of their own. Repeated rows count
    each time. distance2 is null only where no row of the table passes the base rules. An empty table gives an empty table. Other columns
    are not read.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).alias("key"),
                    F.concat(F.lit("lang "), F.to_json(F.struct(F.col(lang_col).alias("lang")))).alias("wide"),
                    text_statistics(F.col(text_col)).alias("s")).select("doc_id", "key", "wide", "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    s = stage(s.withColumn("base_failed", failed).select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector())]), "statistics")
    each = [f"x{i}" for i in range(DIMS)]
    sizes = stage(s.groupBy("key", "wide").agg(F.count_if(~F.col("base_failed")).alias("n")), "sizes")
    few = sizes.count() <= most_groups
    wides = sizes.groupBy("wide").agg(F.sum("n").alias("wide_n"), F.min("n").alias("least_n"))
    own, by_lang = F.col("n") >= least_rows, F.col("wide_n") >= least_rows
    whole = not wides.where(~by_lang).isEmpty()
    uses = [F.when(own, F.col("key")), F.when(by_lang & (F.col("least_n") < least_rows), F.col("wide")), F.lit("all" if whole else None).cast("string")]
    levels = stage(sizes.join(F.broadcast(wides) if few else wides, "wide").select(
        "key", "n", F.when(own, F.col("key")).when(by_lang, F.col("wide")).otherwise(F.lit("all")).alias("fit"), F.array_compact(F.array(*uses)).alias("uses")), "levels")
    counts = stage(levels.where("n > 0").select(F.explode("uses").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0

    def given(rows: DataFrame, facts: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(facts), "key")
        return attach(rows, facts.join(counts, "key"), ["key"], F.xxhash64(*each), total, 1000).drop("n")
    passed = s.where(~F.col("base_failed")).select("key", *each)
    good = passed.join(F.broadcast(levels) if few else levels, "key").select(F.explode("uses").alias("key"), *each)
    middle = stage(good.groupBy("key").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m{c[1]}") for c in each]), "middle")
    spread = given(good, middle).groupBy("key").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{c[1]}")), 0.5, 1000).alias(f"s{c[1]}") for c in each])
    first = middle.join(spread, "key").select("key", *[f"m{i}" for i in range(DIMS)], *[
        (F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    now = stage(first, "shape")
    for _ in range(steps):
        cut = distance(given(good, now)).groupBy("key").agg(F.percentile_approx("d2", SHARE, 1000).alias("cut"))
        inner = distance(given(good, now.join(cut, "key"))).where(F.col("d2") <= F.col("cut"))
        now = stage(shape(inner), "shape")
    verdict = levels.select("key", "fit").join(now.withColumnRenamed("key", "fit"), "fit", "left").drop("fit")
    out = s.join(F.broadcast(verdict) if few else verdict, "key", "left")
    return distance(out).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance2"),
                                (~F.col("base_failed") & (F.col("d2") <= LIMIT)).alias("kept"))
