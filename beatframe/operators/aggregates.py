"""Grouped summaries.  Sums, minima and counts combine on the map side; exact percentiles use value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import finite_or, is_valid
from ..functions.scalars import VIB_ON, finite, in_zone_area, normalize_area, touch_area
from .chunks import IDX, KEY, Halo, attach, cut, floor_div
from .joins import asof_nearest, interval_join
from .rolling import first_valid, runs


# ---------------------------------------------------------------- beat context
CONTEXT = ("contact_area", "touch_pressure", "y_mean", "u_mean", "v_mean")


def beat_context(frames: DataFrame, cols: Sequence[str] = CONTEXT, beat: str = "beat_index", most: int = 10_000) -> DataFrame:
    """Per beat: medians of finite values (0 when none), latest phase, share of frames with the motor on.

    ``beat`` doesn't fall along ``frame_idx``, as ``assign_beat`` gives it.  Frames are shuffled once, by blocks of ``most`` frame
    numbers; a beat inside a block is whole there.  Only the first and the last beat of a block may go on in the next one; up to
    ``most`` frames these are put together, longer ones (hours without a beat) go through value counts, so no task holds one.
    """
    keys = [KEY, beat]
    has = [c for c in ("phase", "vib_state") if c in frames.columns]
    d = frames.where(F.col(beat).isNotNull()).select(*keys, IDX, *[F.col(c).cast("double").alias(c) for c in cols if c not in has],
                                                     *has, floor_div(F.col(IDX), most).alias("_block")).repartition(KEY, "_block")
    values = [F.collect_list(F.when(finite(c), F.col(c).cast("double"))).alias(f"_{c}") for c in cols]
    sums = [F.count(F.lit(1)).alias("_n"), F.max(IDX).alias("_end")]
    if "phase" in has:
        sums.append(F.max_by("phase", IDX).alias("phase"))
    if "vib_state" in has:  # a frame without a state is neither on nor off
        on = (F.col("vib_state") == VIB_ON).cast("bigint")
        sums += [F.sum(on).alias("_on"), F.count(on).alias("_known")]
    block = Window.partitionBy(KEY, "_block")
    parts = cut(d.groupBy(KEY, "_block", beat).agg(*values, *sums).withColumn(
        "_edge", (F.col(beat) == F.min(beat).over(block)) | (F.col(beat) == F.max(beat).over(block))).drop("_block"))

    def over_parts() -> list[Column]:
        out = [F.max_by("phase", "_end").alias("phase")] if "phase" in has else []
        return out + ([(F.sum("_on") / F.sum("_known")).alias("vib_duty_in_beat")] if "vib_state" in has else [])

    def middle(c: str) -> Column:
        v, n = F.array_sort(c), F.size(c)
        at = lambda i: F.get(v, i.cast("int"))
        return F.coalesce((at(F.floor((n - 1) / 2)) * 0.5 + at(F.floor(n / 2)) * 0.5), F.lit(0.0))

    medians = [middle(f"_{c}").alias(f"{c}_median") for c in cols]
    names = [*keys, *[f"{c}_median" for c in cols], *[{"vib_state": "vib_duty_in_beat"}.get(c, c) for c in has]]
    inner = parts.where("NOT _edge")
    if "vib_state" in has:
        inner = inner.withColumn("vib_duty_in_beat", F.col("_on") / F.col("_known"))
    inner = inner.select("*", *medians).select(*names)
    edge = parts.where("_edge")
    long = edge.select(*keys, "_n").groupBy(*keys).agg(F.sum("_n").alias("_all")).where(F.col("_all") > most).select(*keys)
    if long.isEmpty():
        short, tail = edge, None
    else:
        flagged = attach(edge, long.withColumn("_long", F.lit(True)), keys, ["_end"], "left")
        short, many = flagged.where("_long IS NULL"), flagged.where("_long")
        named = lambda c: F.transform(f"_{c}", lambda x: F.struct(F.lit(c).alias("column"), x.alias("x")))
        value = F.explode(F.flatten(F.array(*[named(c) for c in cols])))
        counts = many.select(*keys, value.alias("r")).select(*keys, "r.*").groupBy(*keys, "column", "x").agg(F.count(F.lit(1)).alias("n"))
        mid = count_quantiles(counts, [0.5], keys).groupBy(*keys).agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in cols])
        tail = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts"), *over_parts()).drop("_parts").join(mid, keys, "left").withColumns(
            {f"{c}_median": F.coalesce(f"{c}_median", F.lit(0.0)) for c in cols}).select(*names)
    joined = short.groupBy(*keys).agg(*[F.flatten(F.collect_list(f"_{c}")).alias(f"_{c}") for c in cols],
                                      F.max("_end").alias("_end"), *over_parts())
    out = inner.unionByName(joined.select("*", *medians).select(*names))
    return out if tail is None else out.unionByName(tail)


def on_run_rms(imu: DataFrame, beats: DataFrame) -> DataFrame:
    """Median over ON runs of the RMS acceleration inside each beat's ``[start_ns, end_ns]``; 0 without ON samples.

    A run breaks at any sample that is not ON and at a new burst; a run cut by a beat edge counts in both beats.
    """
    numbered = runs(imu, F.col("vib_state") == VIB_ON, extra_breaks=["burst_id"])
    x, y, z = (F.col(f"accel_{a}").cast("double") for a in "xyz")
    on = numbered.where(F.col("vib_state") == VIB_ON).select(KEY, "t_ns", "run_id", (x * x + y * y + z * z).alias("_m2"))
    spans = beats.where(F.col("end_ns") > F.col("start_ns")).select(KEY, "beat_index", "start_ns", "end_ns")
    hit = interval_join(on, spans, "t_ns", "start_ns", "end_ns", 1_000_000_000)
    per_run = hit.groupBy(KEY, "beat_index", "run_id").agg(F.sqrt(F.avg("_m2")).alias("_rms"))
    med = per_run.groupBy(KEY, "beat_index").agg(F.median("_rms").alias("imu_vib_rms_on_median"))
    return beats.select(KEY, "beat_index").join(med, [KEY, "beat_index"], "left").withColumn(
        "imu_vib_rms_on_median", F.coalesce("imu_vib_rms_on_median", F.lit(0.0)))


def beat_clock(beats: DataFrame, frames: DataFrame) -> DataFrame:
    """``start_ns``/``end_ns`` of each beat (previous beat time, or 1.5 s earlier) through the nearest frame."""
    h = Halo(beats, back=1, idx="beat_index")
    before = F.lag("t_ms").over(h.window)
    d = h.trim(h.spread(beats.select(KEY, "beat_index", "t_ms")).withColumn(
        "start_ms", F.coalesce(before, F.col("t_ms") - 1500))).withColumnRenamed("t_ms", "end_ms")
    clock = frames.select(KEY, F.col("t_ms").alias("_at"), "t_ns", IDX)
    for side in ("start", "end"):
        d = asof_nearest(d.withColumn("_at", F.col(f"{side}_ms")), clock, "_at", ["t_ns"], first=[IDX]).withColumnRenamed(
            "t_ns", f"{side}_ns").drop("_at")
    return d


def burst_ac_rms(imu: DataFrame) -> DataFrame:
    """RMS of the magnitude around its mean for the last finished ON run of each session."""
    numbered = runs(imu, F.col("vib_state") == VIB_ON)
    x, y, z = (F.col(f"accel_{a}").cast("double") for a in "xyz")
    m = F.sqrt(x * x + y * y + z * z)
    per_run = numbered.withColumn("_m", m).groupBy(KEY, "run_id").agg(
        F.max("vib_state").alias("_v"), F.min("vib_state").alias("_u"), F.avg("_m").alias("_a"),
        F.avg(F.col("_m") * F.col("_m")).alias("_q"), F.max(IDX).alias("_end"))
    last = numbered.groupBy(KEY).agg(F.max(IDX).alias("_last"))
    done = per_run.where((F.col("_v") == VIB_ON) & (F.col("_u") == VIB_ON)).join(last, KEY).where("_end < _last")
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_a") * F.col("_a")))
    return done.groupBy(KEY).agg(F.max_by(rms, "_end").alias("last_burst_ac_rms"))


# ---------------------------------------------------------------- pressure blocks
def press_blocks(frames: DataFrame, first_ms: int = 20_000, block_ms: int = 8_000) -> DataFrame:
    """Three block means of ``corrected`` and their mean.

    ``is_beat`` frames count twice in later blocks and in the last 8 s of the first one.
    """
    t = F.col("t_ms")
    block = F.when(t < first_ms, 0).when(t < first_ms + block_ms, 1).when(t < first_ms + 2 * block_ms, 2)
    twice = F.col("is_beat") & ((F.col("block") > 0) | (t >= first_ms - block_ms))
    weight = F.when(twice, 2.0).otherwise(1.0)
    d = frames.withColumn("block", block).where("block is not null")
    parts = d.groupBy(KEY, "block").agg((F.sum(F.col("corrected") * weight) / F.sum(weight)).alias("amp"))
    of = lambda b: F.coalesce(F.max(F.when(F.col("block") == b, F.col("amp"))), F.lit(0.0))
    out = parts.groupBy(KEY).agg(*[of(b).alias(f"amp{b}") for b in range(3)])
    return out.withColumn("mean_amp", (F.col("amp0") + F.col("amp1") + F.col("amp2")) / 3.0)


def mean_hr(intervals: DataFrame, rr: str = "rr_ms") -> DataFrame:
    """60000 / mean interval, 75 without any interval."""
    return intervals.groupBy(KEY).agg(F.coalesce(60000.0 / F.avg(rr), F.lit(75.0)).alias("mean_hr"))


# ---------------------------------------------------------------- session summaries
STATS = ("median", "std", "p10", "p90")


def quantiles(rows: DataFrame, cols: Sequence[str], probs: Sequence[float], key: Sequence[str] = (KEY,)) -> DataFrame:
    """Exact interpolated quantiles of unpivoted columns for groups of any size.

    Values are counted per distinct value first (combined before the shuffle); positions come from running counts
    over those, split by value range, so no group is collected.  Returns (key, column, q, value).
    """
    return count_quantiles(value_counts(rows, cols, key), probs, key)


def value_counts(rows: DataFrame, cols: Sequence[str], key: Sequence[str] = (KEY,)) -> DataFrame:
    """(key, column, x, n): how often each column has each value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
    long = rows.select(*key, pairs.alias("r")).select(*key, "r.*").where(F.col("x").isNotNull())
    return long.groupBy(*key, "column", "x").agg(F.count(F.lit(1)).alias("n"))


def count_quantiles(counts: DataFrame, probs: Sequence[float], key: Sequence[str] = (KEY,)) -> DataFrame:
    """Quantiles of counted values (key, column, x, n)."""
    keys = list(key)
    size = F.abs(F.col("x"))  # parts are 1/64 octave wide at every magnitude; 1075 lifts the smallest double above 0
    part = F.when(size > 0, F.floor((F.log2(size) + 1075) * 64) * F.signum(F.col("x"))).otherwise(0.0)
    counts = counts.withColumn("_part", part)
    gk = [*keys, "column"]
    w = Window.partitionBy(*gk, "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    base_w = Window.partitionBy(*gk).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*gk, "_part").agg(F.sum("n").alias("_pn"))
    base = parts.select(*gk, "_part", F.coalesce(F.sum("_pn").over(base_w), F.lit(0)).alias("_b"),
                        F.sum("_pn").over(Window.partitionBy(*gk)).alias("total"))
    ranked = counts.select("*", F.sum("n").over(w).alias("_cum")).join(base, [*gk, "_part"])
    hi = F.col("_b") + F.col("_cum") - 1  # zero-based positions [lo, hi] hold this value
    lo = hi - F.col("n") + 1
    outs = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("total") - 1)
        f, c = F.floor(pos), F.ceil(pos)
        outs += [F.max(F.when((lo <= f) & (f <= hi), F.col("x"))).alias(f"_f{i}"),
                 F.max(F.when((lo <= c) & (c <= hi), F.col("x"))).alias(f"_c{i}")]
    got = ranked.groupBy(*gk).agg(F.max("total").alias("total"), *outs)
    frac = lambda p: F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))
    value = lambda i, p: F.col(f"_f{i}") * (1.0 - frac(p)) + F.col(f"_c{i}") * frac(p)
    return got.select(*gk, F.explode(F.array(*[F.struct(F.lit(float(p)).alias("q"), value(i, p).alias("value"))
                                               for i, p in enumerate(probs)])).alias("r")).select(*gk, "r.*")


def session_summary(rows: DataFrame, cols: Sequence[str], layout: str = "column", key: Sequence[str] = (KEY,),
                    order: str = "beat_index") -> DataFrame:
    """Summary vector of a bounded selection (the first N valid rows).

    'column' layout: median, SD, p10, p90, trend per column; 'stat' layout: all medians, all SDs, all p10, all p90.
    """
    keys = list(key)
    aggs = []
    for c in cols:
        x = finite_or(c)
        pct = F.percentile(x, [0.5, 0.1, 0.9])
        aggs += [pct.alias(f"_{c}_p"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"_{c}_std"),
                 (F.max_by(x, order) - F.min_by(x, order)).alias(f"_{c}_trend")]
    d = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    of = {"median": lambda c: F.get(f"_{c}_p", F.lit(0)), "std": lambda c: F.col(f"_{c}_std"),
          "p10": lambda c: F.get(f"_{c}_p", F.lit(1)), "p90": lambda c: F.get(f"_{c}_p", F.lit(2)),
          "trend": lambda c: F.col(f"_{c}_trend")}
    if layout == "column":
        vec = [of[s](c) for c in cols for s in (*STATS, "trend")]
    else:
        vec = [of[s](c) for s in STATS for c in cols]
    return d.select(*keys, "n", F.array(*vec).alias("summary"))


def anchors(rows: DataFrame, n: int, cols: Sequence[str], valid: Column | None = None, order: str = "beat_index"
            ) -> DataFrame:
    """Medians of each column over the first n valid rows."""
    return first_valid(rows, n, valid, order).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), *[F.median(finite_or(c)).alias(f"{c}_anchor") for c in cols])


def valid_counts(rows: DataFrame, methods: Sequence[str] = ("M1", "M2", "M3"), key: Sequence[str] = ()) -> DataFrame:
    """Valid rows per method; expects ``<method>`` structs with sbp, dbp, valid and reject_reason."""
    test = lambda m: is_valid(F.col(m)["valid"], F.col(m)["reject_reason"], F.col(m)["sbp"], F.col(m)["dbp"])
    return rows.groupBy(*key).agg(*[F.count_if(test(m)).alias(f"{m}_valid") for m in methods])


# ---------------------------------------------------------------- images and touch
def core_means(pixels: DataFrame, values: Sequence[str] = ("yv",), key: Sequence[str] = (IDX,)) -> DataFrame:
    """Mean pixel value outside and inside of the central half, in one pass."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    core = ((x >= F.floor(w / 4)) & (x < F.floor(w * 3 / 4)) & (y >= F.floor(h / 4)) & (y < F.floor(h * 3 / 4)))
    mean = lambda keep, v: F.coalesce(F.avg(F.when(keep, F.col(v))), F.lit(0.0))
    return pixels.groupBy(*key).agg(*[mean(~core, v).alias(f"{v}_outer") for v in values], *[mean(core, v).alias(f"{v}_inner") for v in values])


def roi_means(pixels: DataFrame, inset: float = 0.30, stride: int = 4, values: Sequence[str] = ("yv",), key: Sequence[str] = (IDX,)
              ) -> DataFrame:
    """Mean pixel value per frame of the inset centre region, sampled with a stride."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    x0, y0 = F.floor(w * inset), F.floor(h * inset)
    keep = ((x >= x0) & (x < w - x0) & (y >= y0) & (y < h - y0) & ((x - x0) % stride == 0) & ((y - y0) % stride == 0))
    return pixels.groupBy(*key).agg(*[F.coalesce(F.avg(F.when(keep, F.col(v))), F.lit(0.0)).alias(f"{v}_mean")
                                      for v in values])


def touch_summary(pointers: DataFrame, geometry: dict[str, float], key: Sequence[str], order: str = "pointer"
                  ) -> DataFrame:
    """Total, in-zone and normalised area per touch event and its largest pointer (first one wins a tie).

    Expects one row per pointer; sums and the arg-max combine before the shuffle.
    """
    g = geometry
    zero = F.lit(0.0)
    area = touch_area("major", "minor", "size", F.lit(g["overlay_w"]), F.lit(g["overlay_h"]))
    d = pointers.withColumn("_area", area)
    ellipse = F.greatest(zero, F.col("major")) * F.greatest(zero, F.col("minor")) > 0
    round_axis = F.sqrt(F.col("_area") / F.lit(3.141592653589793)) * 2.0
    axis = lambda c: F.when(ellipse | (F.col("_area") <= 0), F.greatest(zero, F.col(c))).otherwise(round_axis)
    d = d.withColumn("_major", axis("major")).withColumn("_minor", axis("minor"))
    zone = in_zone_area("_area", "cx", "cy", "_major", "_minor", F.lit(g["center_x"]), F.lit(g["top_y"]),
                        F.lit(g["half_w"]), F.lit(g["half_h"]))
    best = F.struct(F.col("_area"), (-F.col(order)).alias("_o"), F.greatest(zero, F.col("pressure")).alias("pressure"),
                    F.col("cx"), F.col("cy"), F.col("_major").alias("major"), F.col("_minor").alias("minor"))
    d = d.withColumn("_zone", zone).groupBy(*key).agg(
        F.max(F.col("valid")).alias("valid"), F.sum("_area").alias("raw_area"), F.sum("_zone").alias("_zone"),
        F.max(best).alias("_best"))
    on = F.col("valid") == 1
    norm = normalize_area("_zone", F.lit(g["density"]))
    return d.select(*key, "valid", F.when(on, F.col("raw_area")).otherwise(0.0).alias("raw_area"),
                    F.when(on, norm).otherwise(0.0).alias("contact_area"),
                    *[F.col("_best")[c].alias(c) for c in ("pressure", "cx", "cy", "major", "minor")])


def largest_pointer(pointers: Column, area) -> Column:
    """Pointer struct with the largest area; ``area`` maps a pointer to its area, the first wins a tie."""
    ranked = F.transform(pointers, lambda p, i: F.struct(area(p).alias("a"), (-i).alias("o"), p.alias("p")))
    return F.array_max(ranked)["p"]


def phase_spans(rows: DataFrame, t: str = "t_ms") -> DataFrame:
    return rows.groupBy(KEY, "phase").agg(F.min(t).alias("start_time_ms"), F.max(t).alias("end_time_ms"))


def beat_stats(samples: DataFrame, value: str = "v", key: Sequence[str] = (KEY, "beat_index")) -> DataFrame:
    """Count, range and population SD of the samples of each beat (long form)."""
    return samples.groupBy(*key).agg(
        F.count(value).alias("n"), F.min(value).alias("beat_min"), F.max(value).alias("beat_max"),
        (F.max(value) - F.min(value)).alias("beat_range"), F.stddev_pop(value).alias("beat_std"))
