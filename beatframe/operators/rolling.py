"""Rolling statistics, carries and run segmentation along a dense index or a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import imu_rate_warning
from ..functions.scalars import canonical_rotation, col, decode_pattern, tempo_speed
from .chunks import IDX, KEY, Halo, attach, carry, dense_index, ewma, floor_div, let, running_sum

SECOND_NS = 1_000_000_000
CLOCK_CHUNK_NS = 60 * SECOND_NS


def robust_mean(history):
    """Mean of the values within three upper-median absolute deviations of the upper median."""
    upper = lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int"))

    def with_median(v, med):
        dev = F.array_sort(F.transform(v, lambda x: F.abs(x - med)))
        return let(upper(dev) * 3, lambda lim: let(F.filter(v, lambda x: F.abs(x - med) <= lim), lambda kept: F.aggregate(
            kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)))

    return let(F.array_sort(history), lambda v: F.when(F.size(v) > 0, let(upper(v), lambda med: with_median(v, med)))
               .otherwise(0.0))


def robust_average(rows: DataFrame, value: str, n: int = 10, order: str = "beat_index", out: str = "robust") -> DataFrame:
    """Outlier-resistant mean of the last n values along a dense ``order``."""
    h = Halo(rows, back=n, idx=order)
    d = h.spread(rows).withColumn("_h", F.collect_list(value).over(h.rows(1 - n, 0)))
    return h.trim(d).withColumn(out, robust_mean(F.col("_h"))).drop("_h")


def rr_intervals(peaks: DataFrame, t: str = "t_ms", order: str = IDX, out: str = "rr_ms") -> DataFrame:
    """Difference to the previous row's time along a dense ``order`` (null on the first row)."""
    h = Halo(peaks, back=1, idx=order)
    return h.trim(h.spread(peaks).withColumn(out, F.col(t) - F.lag(t).over(h.window)))


def first_valid(rows: DataFrame, n: int = 30, valid=None, order: str = "beat_index", key=KEY) -> DataFrame:
    """First n valid rows per key.  Spark keeps at most n rows per key and task before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    d = rows if valid is None else rows.where(valid)
    ranked = d.withColumn("rank_valid", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("rank_valid") <= n)


def trend(rows: DataFrame, cols: Sequence[str], order: str = "beat_index", key=KEY) -> DataFrame:
    """Last minus first value of each column; 0 for a single row."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(*[(F.max_by(c, order) - F.min_by(c, order)).alias(f"{c}_trend") for c in cols])


def carry_last(rows: DataFrame, cols: Sequence[str], order: str = IDX) -> DataFrame:
    return carry(rows, cols, idx=order)


def carry_sentinel(rows: DataFrame, c: str, bad: float = -1, order: str = IDX) -> DataFrame:
    """Keep the last real value where the sentinel stands; the sentinel stays before the first real value."""
    d = rows.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return carry(d, [c], idx=order).withColumn(c, F.coalesce(F.col(c), F.lit(bad).cast(rows.schema[c].dataType)))


def sampling_rate(imu: DataFrame, span_ns: int = SECOND_NS, t: str = "t_ns", out: str = "rate_hz") -> DataFrame:
    """Samples per second over the trailing span; 0 with fewer than two samples.

    A copy of every sample stands where it leaves the span.  Along both, the number inside is a running count, and the oldest one inside is
    the next copy to come, so the cost of a row does not grow with the rate.  All of it is read in one order, so a task sorts its rows once.
    """
    h = Halo(imu, back=span_ns, idx=t, chunk=CLOCK_CHUNK_NS)
    both = h.spread(imu).withColumn("_leaves", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("_at", F.col(t) + F.col("_leaves") * span_ns).withColumn("_old", F.when(F.col("_leaves") == 1, F.col(t)))
    w = Window.partitionBy(*h.keys, "_chunk").orderBy("_at", "_leaves")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # rows of the same time together
    ahead = F.expr(f"lead(_old, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{k}`' for k in h.keys)}, _chunk ORDER BY _at, _leaves)")
    both = both.select("*", F.sum(F.lit(1) - F.col("_leaves")).over(upto).alias("_in"),
                       F.coalesce(F.sum("_leaves").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_left"),
                       ahead.alias("_first"))
    d = both.where("_leaves = 0").withColumn("_n", F.col("_in") - F.col("_left"))
    span = (F.col(t) - F.col("_first")) / 1e9
    rate = F.when((F.col("_n") >= 2) & (span > 0), (F.col("_n") - 1) / span).otherwise(0.0)
    return h.trim(d.withColumn(out, rate)).drop("_n", "_first", "_in", "_left", "_at", "_leaves", "_old")


def rolling_sd(imu: DataFrame, cols: Sequence[str], span_ns: int = SECOND_NS, t: str = "t_ns") -> DataFrame:
    """Population SD of each column over the trailing span.

    The clock is cut into blocks of one span, so the rows inside are the end of the block before and the start of the row's own. Counts,
    means and variances of all ends and starts are running ones, and a copy of every row carries the end it opens to where it leaves the
    span, so the cost of a row does not grow with the rate. Variances are put together around their means; no large sums are subtracted.
    """
    h = Halo(imu, back=span_ns, idx=t, chunk=CLOCK_CHUNK_NS)
    parts = [*h.keys, "_chunk", "_block"]
    start = Window.partitionBy(*parts).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # rows of the same time together
    end = Window.partitionBy(*parts).orderBy(F.col(t).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def stats(w) -> Column:
        x = [F.col(c).cast("double") for c in cols]
        return F.struct(*[F.struct(F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("m"), F.var_pop(v).over(w).alias("v")).alias(f"c{i}") for i, v in enumerate(x)])

    def sd(i: int) -> Column:
        a, b = F.col("_before")[f"c{i}"], F.col("_start")[f"c{i}"]
        n, k = F.coalesce(a["n"], F.lit(0)), b["n"]
        both = (a["v"] * n + b["v"] * k + (b["m"] - a["m"]) * (b["m"] - a["m"]) * n * k / (n + k)) / (n + k)
        return F.sqrt(F.when(n == 0, b["v"]).when(k == 0, a["v"]).otherwise(both))
    d = h.spread(imu).repartition(*h.keys, "_chunk").withColumn("_block", floor_div(F.col(t), span_ns))  # blocks stay in the task of their chunk
    d = d.select("*", stats(start).alias("_start"), stats(end).alias("_end"))
    d = d.withColumn("_leaves", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col(t) + F.col("_leaves") * span_ns).withColumn("_block", F.col("_block") + F.col("_leaves"))
    back = Window.partitionBy(*parts).orderBy(F.col("_at").desc(), F.col("_leaves").desc())
    d = d.withColumn("_before", F.last(F.when(F.col("_leaves") == 1, F.col("_end")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where("_leaves = 0").select("*", *[sd(i).alias(f"{c}_sd") for i, c in enumerate(cols)])
    return h.trim(d).drop("_block", "_start", "_end", "_leaves", "_at", "_before")


def instant_fps(frames: DataFrame, t: str = "t_ms", out: str = "fps") -> DataFrame:
    """1000 / time step, carried over rows whose clock did not advance."""
    d = rr_intervals(frames, t, out="_dt")
    return carry(d.withColumn(out, F.when(F.col("_dt") > 0, 1000.0 / F.col("_dt"))).drop("_dt"), [out])


def baseline(frames: DataFrame, value: str = "green", alpha: float = 0.02, out: str = "dc") -> DataFrame:
    """Slow exponential baseline over all frames, seeded with the first."""
    return ewma(frames, value, alpha, out, ordinal=IDX)


def runs(rows: DataFrame, state, order: str = IDX, extra_breaks: Sequence[str] = (), out: str = "run_id") -> DataFrame:
    """Number maximal runs of equal ``state`` (and equal ``extra_breaks``) along a dense ``order``."""
    h = Halo(rows, back=1, idx=order)
    key = F.struct(col(state).alias("s"), *[F.col(c) for c in extra_breaks])
    d = h.spread(rows).withColumn("_k", key)
    d = h.trim(d.withColumn("_p", F.lag("_k").over(h.window)))
    change = (F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_k"))).cast("bigint")
    return running_sum(d, {out: change}, idx=order).drop("_k", "_p")


def target_tempo(rows: DataFrame, offset: float = 0.0, bpm: str = "bpm", order: str = "beat_index", base: float = 120.0
                 ) -> DataFrame:
    """Mean of the last three rates times (1 + offset), and the playback speed it asks for."""
    h = Halo(rows, back=2, idx=order)
    d = h.spread(rows).withColumn("target_tempo", F.avg(bpm).over(h.rows(-2, 0)) * (1.0 + offset))
    return h.trim(d.withColumn("speed", tempo_speed("target_tempo", base)))


def flag_rotation_duplicates(steps: DataFrame) -> DataFrame:
    """Steps whose pattern is a rotation of an earlier stored pattern but not that pattern itself.

    The silent pattern counts as stored before the first step.
    """
    d = steps.withColumn("pattern", F.array_join(decode_pattern("a1", "a2", "a3", "a4"), "")).withColumn(
        "class", canonical_rotation(decode_pattern("a1", "a2", "a3", "a4")))
    stored = d.groupBy(KEY, "class").agg(F.min_by("pattern", "step").alias("stored"))
    silent = "0" * 8
    first = F.when(F.col("class") == silent, F.lit(silent)).otherwise(F.col("stored"))
    return d.join(stored, [KEY, "class"]).withColumn("is_duplicate", F.col("pattern") != first).drop("stored")


def label_steps(steps: DataFrame, reward_on: str = "rise") -> DataFrame:
    """Reward and next state of each step from the interval change since the last accepted step (800 ms at start)."""
    d = flag_rotation_duplicates(steps)
    d = dense_index(d, [F.col("step")], F.floor(F.col("step") / 10_000))
    kept = F.when(~F.col("is_duplicate"), F.col("ibi_ms"))
    d = carry(d.withColumn("before", kept), ["before"], inclusive=False)
    d = d.withColumn("before", F.coalesce(F.col("before"), F.lit(800.0)))
    rise = F.col("ibi_ms") > F.col("before")
    gain = rise if reward_on == "rise" else ~rise
    reward = F.when(F.col("is_duplicate"), -2).when(gain, 2).otherwise(0)
    state = F.when(F.col("is_duplicate"), "001").when(rise, "100").otherwise("010")
    return d.withColumn("reward", reward).withColumn("next_state", state)


def imu_rate_warnings(imu: DataFrame) -> DataFrame:
    """Samples whose trailing rate is below 250 Hz after 3 s in an active phase."""
    d = sampling_rate(imu)
    start = d.where("phase >= 1").groupBy(KEY).agg(F.min("t_ns").alias("_from"))
    ms = (F.col("t_ns") - F.col("_from")) / 1e6
    return attach(d, start, KEY, ["t_ns"]).where(imu_rate_warning("rate_hz", "phase", ms)).drop("_from")
