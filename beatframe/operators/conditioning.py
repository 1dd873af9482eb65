"""Signal conditioning and peak candidates: rolling frames of at most a few dozen rows.

All steps share one partitioning and one sort (``Halo``), so conditioning and candidate tests cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import FPS, green_correct, java_round, peak_time_ms
from .chunks import IDX, Halo

# Window lengths and thresholds.
WARM_UP = 20
RANGE_ROWS = 20
MIN_PROMINENCE, PROMINENCE_SHARE = 0.12, 0.35
REACH = 64  # rows a candidate test looks back through all chained windows

CONDITIONERS: dict[str, tuple[int, float, Callable[[Column], Column]]] = {}


def register_conditioner(name: str, fn: Callable[[Column], Column] = green_correct, first_window: int = 6,
                         scale: float = 10.0) -> None:
    """Add a conditioner: correction, length of the first moving average, output scale."""
    if not 1 <= first_window <= 20:
        raise ValueError("the first window must fit into the warm-up")
    CONDITIONERS[name] = (first_window, scale, fn)


register_conditioner("1", first_window=6, scale=10.0)
register_conditioner("2", first_window=4, scale=100.0)


def _mean_of_last(c: str, n: int, w, count: Column | None = None) -> Column:
    """Mean of the newest n rows, added newest first."""
    s = F.col(c)
    for k in range(1, n):
        s = s + F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    return s / (count if count is not None else F.lit(float(n)))


def _condition(d: DataFrame, h: Halo, logic: str) -> DataFrame:
    first, scale, correct = CONDITIONERS[logic]
    ready = F.col(IDX) >= WARM_UP - 1
    d = d.withColumn("corrected", correct(F.col("green_raw")))
    d = d.withColumn("ma1", F.when(ready, _mean_of_last("corrected", first, h.window)))
    held = F.least(F.lit(4), F.col(IDX) - (WARM_UP - 2)).cast("double")
    span = h.rows(-(RANGE_ROWS - 1), 0)
    d = d.select("*", F.when(ready, _mean_of_last("ma1", 4, h.window, held)).alias("ma2"),
                 F.min("ma1").over(span).alias("_lo"), F.max("ma1").over(span).alias("_hi"))
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))
    level = (F.col("ma2") - F.col("_lo")) / spread * scale
    level = F.greatest(F.lit(0.0), F.least(F.lit(scale), level))
    return (d.withColumn("ring", F.when(ready, level).otherwise(0.0))
            .withColumn("green", F.when(ready, F.col("ring")).otherwise(F.col("corrected")))
            .drop("_lo", "_hi"))


def _candidates(d: DataFrame, h: Halo) -> DataFrame:
    w, back = h.window, h.rows(-12, -1)
    d = d.select("*", *[F.lag("ring", k, 0.0).over(w).alias(f"_r{k}") for k in range(1, 5)],
                 F.min("ring").over(back).alias("_lo"), F.max("ring").over(back).alias("_hi"))
    r0, r1, r2, r3, r4 = (F.col(c) for c in ("ring", "_r1", "_r2", "_r3", "_r4"))
    need = F.greatest(F.lit(MIN_PROMINENCE), (F.col("_hi") - F.col("_lo")) * PROMINENCE_SHARE)
    shape = (r1 > r2) & (r2 > r3) & (r3 > r4) & (r1 > r0)
    base = java_round(F.col("t_ms") - F.lit(1000.0 / FPS))
    return (d.withColumn("is_shape", shape)
            .withColumn("is_cand", F.coalesce(shape & (r1 - F.col("_lo") >= need), F.lit(False)))
            .withColumn("t_peak", F.when(F.col("is_cand"), peak_time_ms(r2, r1, r0, base)))
            .drop("_r1", "_r2", "_r3", "_r4", "_lo", "_hi"))


def _turning_points(d: DataFrame, h: Halo) -> DataFrame:
    prev, nxt = F.lag("ring", 1, 0.0).over(h.window), F.lead("ring", 1).over(h.window)
    r = F.col("ring")
    return d.select("*", F.coalesce((r < prev) & (r < nxt), F.lit(False)).alias("is_low"),
                    F.coalesce((r > prev) & (r > nxt), F.lit(False)).alias("is_high"))


def condition(frames: DataFrame, logic: str = "1", chunk: int | None = None) -> DataFrame:
    """Add ``corrected``, ``ma1``, ``ma2``, ``ring`` (0 in warm-up) and ``green`` (unscaled in warm-up)."""
    h = Halo(frames, back=REACH, chunk=chunk)
    return h.trim(_condition(h.spread(frames), h, logic))


def peak_candidates(frames: DataFrame, chunk: int | None = None) -> DataFrame:
    """Shape and prominence tests on an already conditioned ``ring``; adds ``is_shape``, ``is_cand``, ``t_peak``."""
    h = Halo(frames, back=16, chunk=chunk)
    return h.trim(_candidates(h.spread(frames), h))


def signal(frames: DataFrame, logic: str = "1", chunk: int | None = None, keep_chunk: bool = False,
           turning_points: bool = True) -> DataFrame:
    """Conditioning, candidates and (optionally) turning points in one partitioning of the frames."""
    h = Halo(frames, back=REACH, ahead=1 if turning_points else 0, chunk=chunk)
    d = _candidates(_condition(h.spread(frames), h, logic), h)
    if turning_points:
        d = _turning_points(d, h)
    return h.trim(d, keep_chunk)


def strict_peaks(samples: DataFrame, idx: str = IDX, value: str = "green", chunk: int | None = None, newest: int = 0) -> DataFrame:
    """Seven-point local maxima, decided three samples late.

    Adds ``is_peak`` and, for the centre sample, ``peak_v`` and ``peak_t`` (parabolic time); with ``newest`` also that many
    samples up to the row as ``newest``.
    """
    h = Halo(samples, back=max(10, newest), idx=idx, chunk=chunk)
    d, w = h.spread(samples), h.window
    v = F.col(value)
    d = d.select("*", *[F.lag(value, k).over(w).alias(f"_g{k}") for k in range(1, 7)],
                 F.min(value).over(h.rows(-9, 0)).alias("_lo"), F.max(value).over(h.rows(-9, 0)).alias("_hi"),
                 F.lag("t_ms", 3).over(w).alias("_tc"))
    c = F.col("_g3")
    top = (v < c)
    for k in (1, 2, 4, 5, 6):
        top = top & (F.col(f"_g{k}") < c)
    need = F.greatest(F.lit(MIN_PROMINENCE), (F.col("_hi") - F.col("_lo")) * PROMINENCE_SHARE)
    frame_ms = 1000.0 / FPS
    base = F.when(F.abs(F.col("_tc") - F.col("t_ms")) <= frame_ms * 4.0, F.col("_tc")).otherwise(
        java_round(F.col("t_ms") - 3.0 * frame_ms))
    is_peak = F.coalesce(top & (c - F.col("_lo") >= need), F.lit(False))
    d = (d.withColumn("is_strict", F.coalesce(top, F.lit(False))).withColumn("is_peak", is_peak)
         .withColumn("peak_v", F.when(F.col("is_peak"), c))
         .withColumn("peak_t", F.when(F.col("is_peak"), peak_time_ms("_g4", "_g3", "_g2", base)))
         .drop("_lo", "_hi", "_tc", *[f"_g{k}" for k in range(1, 7)]))
    if newest:
        sample = F.struct(F.col("t_ms").alias("t"), v.alias("v"))
        d = d.withColumn("newest", F.collect_list(sample).over(h.rows(1 - newest, 0)))
    return h.trim(d)


def press_conditioning(frames: DataFrame, chunk: int | None = None) -> DataFrame:
    """Conditioning of the pressure-block mode: ten times the raw value, two moving averages from frame 40 on.

    Adds ``corrected`` and ``is_peak`` (shape test only, on the eight newest values).
    """
    h = Halo(frames, back=REACH, chunk=chunk)
    d, w = h.spread(frames).withColumn("_x", F.col("green_raw") * 10.0), h.window
    ready = F.col(IDX) >= 39
    d = d.withColumn("_m1", F.when(ready, _mean_of_last("_x", 6, w)))
    held = F.least(F.lit(4), F.col(IDX) - 38).cast("double")
    d = d.withColumn("corrected", F.when(ready, _mean_of_last("_m1", 4, w, held)).otherwise(F.col("_x")))
    d = d.select("*", *[F.lag("corrected", k, 0.0).over(w).alias(f"_r{k}") for k in range(1, 5)])
    r1, r2, r3, r4 = (F.col(f"_r{k}") for k in range(1, 5))
    d = d.withColumn("is_shape", (r1 > r2) & (r2 > r3) & (r3 > r4) & (r1 > F.col("corrected")))
    return h.trim(d.drop("_x", "_m1", "_r1", "_r2", "_r3", "_r4"))
