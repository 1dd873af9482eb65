"""Sine path: peaks, one-beat-late beats, their samples and wave features, and the wave drawn back on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import quality as q, waves
from ..functions.scalars import java_round, wrap01
from .chunks import IDX, KEY, Halo, Lift, floor_div, fold, let, move
from .conditioning import strict_peaks
from .joins import interval_join

# Refractory limits and buffer length.
REFRACTORY_MS, REFRACTORY_MAX_MS, REFRACTORY_SHARE = 500, 900, 0.58
BUFFER = 90
PATHS = ("D", "M")  # distortion and harmonic estimators keep separate peak histories

SINE_STATE = "struct<last:bigint,prev:bigint,valid_ibi:double,fit_ibi:double>"
SINE_OUT = ("struct<frame_idx:bigint,gidx:bigint,t_ms:bigint,t_peak:bigint,start_t:bigint,end_t:bigint,"
            "smoothed:double,valid_ibi:double,fit_ibi:double>")


def _reference(smoothed, valid_ibi, fit_ibi):
    return (F.when(smoothed > 0, smoothed).when(valid_ibi > 0, valid_ibi).when(fit_ibi > 0, fit_ibi)
            .otherwise(F.lit(0.0)))


def _sine_step(a, x):
    ref = _reference(x["smoothed"], a["valid_ibi"], a["fit_ibi"])
    wait = F.when(ref <= 0, REFRACTORY_MS).otherwise(F.greatest(
        F.lit(REFRACTORY_MS), F.least(F.lit(REFRACTORY_MAX_MS), java_round(ref * REFRACTORY_SHARE))))
    first = a["last"].isNull()
    accepted = first | (x["t_ms"] - a["last"] >= wait)

    # before the frame path knows an interval, the reference comes from the beats of this path
    def judged(s):
        return let(waves.values(s), lambda v: judged_values(s, v))

    def judged_values(s, v):
        ibi = (a["last"] - a["prev"]).cast("double")
        fit = F.when(x["path"] == "M", waves.sine_fit_raw(v)["amp"]).otherwise(waves.sine_fit_resampled(v)["amp"])

        def with_fit(amp):
            fitted = F.when(amp >= waves.TINY, ibi).otherwise(a["fit_ibi"])
            ok = (q.beat_reason(ibi, amp, _reference(x["smoothed"], a["valid_ibi"], fitted)) == q.OK) & (
                (x["path"] == "D") | (waves.sine_fit_raw(v)["rmse"] <= 1.0))
            return F.struct(F.when(ok, ibi).otherwise(a["valid_ibi"]).alias("valid"), fitted.alias("fit"))

        same = F.struct(a["valid_ibi"].alias("valid"), a["fit_ibi"].alias("fit"))
        return F.when(q.window_reason(s, ibi) == q.OK, let(fit, with_fit)).otherwise(same)

    inside = F.filter(x["early"], lambda s: s["t"].between(a["prev"], a["last"]))
    early = F.when((x["smoothed"] <= 0) & F.coalesce(a["last"] > a["prev"], F.lit(False)), let(inside, judged))

    def result(r):
        moved = F.struct(x["t_peak"], F.coalesce(a["last"], x["t_peak"]), F.coalesce(r["valid"], a["valid_ibi"]),
                         F.coalesce(r["fit"], a["fit_ibi"])).cast(SINE_STATE)
        out = F.struct(x["frame_idx"], x["gidx"], x["t_ms"], x["t_peak"], a["prev"], a["last"], x["smoothed"],
                       a["valid_ibi"], a["fit_ibi"]).cast(SINE_OUT)
        return move(moved, out)

    return F.when(accepted, let(early, result)).otherwise(move(a, F.lit(None).cast(SINE_OUT)))


def _known_lift() -> Lift:
    """The path's own intervals pass a chunk unread and unchanged once the frame path knows an interval."""
    def note(l, s, r, x):
        return F.struct(l["passes"] & (x["smoothed"] > 0))

    def covers(l, ran, real):
        return l["passes"] & ran["last"].eqNullSafe(real["last"]) & ran["prev"].eqNullSafe(real["prev"])

    def end(l, s, real):
        return F.when(l["passes"], s.withField("valid_ibi", real["valid_ibi"]).withField("fit_ibi", real["fit_ibi"])).otherwise(s)
    return Lift("struct<passes:boolean>", F.struct(F.lit(True)), note, covers, end)


def sine_peaks(states: DataFrame) -> DataFrame:
    """Peaks of the sine path, per estimator path.  ``start_t``/``end_t`` bound the beat that a peak completes.

    The first peak completes nothing (null bounds), the second a beat of length 0.
    """
    gated = states.where("gidx is not null").select(KEY, IDX, "gidx", "t_ms", "green",
                                                    F.col("smoothed_prev").alias("smoothed"))
    # before the frame path knows an interval, a peak's samples are needed; those frames come first, so they can be searched apart
    cands = strict_peaks(gated, idx="gidx").where("is_peak and not coalesce(smoothed <= 0, false)")
    early = strict_peaks(gated.where("smoothed <= 0"), idx="gidx", newest=BUFFER).where("is_peak")
    cands = cands.withColumn("newest", F.lit(None).cast(early.schema["newest"].dataType)).unionByName(early).select(
        KEY, IDX, "gidx", "t_ms", "smoothed", F.col("peak_t").alias("t_peak"), F.col("newest").alias("early"))
    rows = cands.withColumn("path", F.explode(F.array(*[F.lit(p) for p in PATHS])))
    init = F.struct(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(0.0), F.lit(0.0))
    # ``path`` is both a key and part of the item
    rows = rows.withColumn("_path", F.col("path")).withColumnRenamed("path", "path_key").withColumnRenamed(
        "_path", "path")
    items = ["frame_idx", "gidx", "t_ms", "t_peak", "smoothed", "path", "early"]
    return fold(rows, "gidx", items, init, _sine_step, SINE_STATE, SINE_OUT, key=[KEY, "path_key"], lift=_known_lift()).withColumnRenamed("path_key", "path")


def beat_samples(frames: DataFrame, beats: DataFrame, value: str = "green", index: str | None = None) -> DataFrame:
    """Samples with ``start_t <= t_ms <= end_t`` as an ordered array on each beat row.

    With ``index`` only the newest 90 samples up to the beat's own ``index`` are visible, and buckets follow it;
    otherwise buckets follow time.
    """
    if index:
        spans = beats.withColumn("_lo", F.col(index) - (BUFFER - 1)).withColumn("_hi", F.col(index)).drop(index)
        f = frames.select(KEY, F.col(index).alias("_i"), F.col("t_ms").alias("_t"), F.col(value).alias("_v"))
        hit = interval_join(f, spans, "_i", "_lo", "_hi", 256).where(F.col("_t").between(F.col("start_t"), F.col("end_t")))
    else:
        f = frames.select(KEY, F.col(IDX).alias("_i"), F.col("t_ms").alias("_t"), F.col(value).alias("_v"))
        hit = interval_join(f, beats, "_t", "start_t", "end_t", 10_000)
    ids = [c for c in (KEY, IDX, "beat_index", "start_t", "end_t") if c in beats.columns]
    return hit.groupBy(*ids).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("_i"), F.col("_t").alias("t"), F.col("_v").alias("v")))),
        lambda s: F.struct(s["t"].alias("t"), s["v"].alias("v"))).alias("samples"))


def beat_features(beats: DataFrame) -> DataFrame:
    """Window metrics, ratios, both fits, distortion and phases for beats with ``samples``, ``start_t``, ``end_t``."""
    ibi = (F.col("end_t") - F.col("start_t")).cast("double")
    v = waves.values("samples")
    d = beats.withColumn("beat_ibi_ms", ibi).withColumn("stats", waves.beat_stats(v))
    d = d.withColumn("window_reason", q.window_reason_of("stats.n", "stats.range", "stats.std", "beat_ibi_ms"))
    ok = F.col("window_reason") == q.OK
    d = d.withColumn("ratio", F.when(ok, waves.systole_ratio("samples", "beat_ibi_ms")))
    d = d.withColumn("fit_m", F.when(ok, waves.sine_fit_raw(v))).withColumn("fit_d", F.when(
        ok, waves.sine_fit_resampled(v)))
    d = d.withColumn("e", F.when(ok, waves.distortion(v, "fit_d.amp", "ratio.systole", "ratio.diastole")))
    d = d.withColumn("peak_phase_ms", F.when(ok, waves.peak_phase("samples", "beat_ibi_ms")))
    return d.withColumn("phase_offset_ms", waves.phase_offset("peak_phase_ms", "beat_ibi_ms"))


def sine_beats(states: DataFrame, peaks: DataFrame) -> DataFrame:
    """Completed beats per path with wave features and the reason they stop before scoring.

    Both paths nearly always complete the same beats, so samples are gathered once per distinct beat.
    """
    done = peaks.where("end_t is not null")
    spans = done.select(KEY, IDX, "gidx", "start_t", "end_t").distinct()
    gated = states.where("gidx is not null")
    feats = beat_features(beat_samples(gated, spans, index="gidx"))
    return judged(peaks.join(feats, [KEY, IDX, "start_t", "end_t"], "left"))


def judged(rows: DataFrame) -> DataFrame:
    """Reference interval and the reason a completed beat stops before scoring; rows carry ``path`` and the beat's features."""
    is_m = F.col("path") == "M"
    amp = F.when(is_m, F.col("fit_m.amp")).otherwise(F.col("fit_d.amp"))
    fitted = F.when(amp >= waves.TINY, F.col("beat_ibi_ms")).otherwise(F.col("fit_ibi"))
    ref = _reference(F.col("smoothed"), F.col("valid_ibi"), fitted)
    beat = q.beat_reason("beat_ibi_ms", amp, ref)
    reason = (F.when(F.col("end_t").isNull(), "initial_peak").when(F.col("samples").isNull(), "empty_beat_samples")
              .when(F.col("window_reason") != q.OK, F.col("window_reason")).when(beat != q.OK, beat)
              .when(is_m & (F.col("fit_m.rmse") > 1.0), "poor_sine_fit").otherwise(q.OK))
    return rows.withColumn("ref_ibi_ms", ref).withColumn("beat_reason", reason)


PHASE_STATE = "struct<shift:double,history:array<double>,missed:int>"


def phase_filter(beats: DataFrame, order: str = "beat_index", offset: str = "phase_offset_ms", ibi: str = "beat_ibi_ms"
                 ) -> DataFrame:
    """Rate-dependent smoothing of the phase offset; three limited steps in a row take the raw value."""
    out = "struct<o:bigint,phase_filtered:double>"
    quarter = 0.7853981633974483

    def step(a, x):
        hr = F.lit(60000.0) / x[ibi]
        weight = F.when(hr < 70, 0.5).when(hr < 90, 0.6).otherwise(0.7)
        limit = F.when(hr < 70, quarter * 1.5).otherwise(quarter)
        diff = x[offset] - a["shift"]
        over = F.abs(diff) > limit
        missed = F.when(over, a["missed"] + 1).otherwise(0)
        moved = a["shift"] + F.when(over, F.signum(diff) * limit).otherwise(diff) * weight
        hist = F.slice(F.concat(a["history"], F.array(moved)), -F.least(F.size(a["history"]) + 1, F.lit(3)), 3)

        def smoothed(h):
            return F.aggregate(h, F.lit(0.0), lambda s, v: s + v) / F.size(h)

        taken = F.struct(x[offset], F.array(x[offset]), F.lit(0)).cast(PHASE_STATE)
        eased = let(hist, lambda h: F.struct(smoothed(h), h, missed).cast(PHASE_STATE))
        return let(F.when(missed >= 3, taken).otherwise(eased),
                   lambda n: move(n, F.struct(x["_o"], n["shift"]).cast(out)))

    init = F.struct(F.lit(0.0), F.array().cast("array<double>"), F.lit(0))
    return fold(beats, order, [offset, ibi], init, step, PHASE_STATE, out).withColumnRenamed("o", order)


def curve_on_frames(frames: DataFrame, fits: DataFrame, offset: float = 0.25) -> DataFrame:
    """Ideal curve at every frame of a fitted beat; fits carry start_t, end_t, mean, amp, systole, diastole."""
    hit = interval_join(frames, fits, "t_ms", "start_t", "end_t", 10_000)
    span = (F.col("end_t") - F.col("start_t")).cast("double")
    pos = wrap01((F.col("t_ms") - F.col("start_t")) / span + offset)
    return hit.where(F.col("end_t") > F.col("start_t")).withColumn(
        "ideal", waves.ideal_curve(pos, "mean", "amp", "systole", "diastole"))


def fitted_wave(frames: DataFrame, fits: DataFrame, offset: float = 0.25, value: str = "green") -> DataFrame:
    """Every frame with the ideal curve scaled onto the observed range of its beat (0 outside fitted beats).

    A frame on the edge of two beats takes the later one.  The ranges of a beat are summed up before they are shuffled, and come back with the
    fits of a 10 s bucket in one row, so no frame is sorted by beat or copied.  Frames are read twice.
    """
    span = [KEY, "start_t", "end_t"]
    fits = fits.select(*span, "mean", "amp", "systole", "diastole")
    on = curve_on_frames(frames, fits, offset)
    ranges = on.groupBy(*span).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min("ideal").alias("ilo"), F.max("ideal").alias("ihi"))
    known = fits.join(ranges, span)
    size = 10_000
    bucket = F.explode(F.sequence(floor_div(F.col("start_t"), size), floor_div(F.col("end_t"), size)))
    item = F.struct("end_t", "start_t", "mean", "amp", "systole", "diastole", "lo", "hi", "ilo", "ihi")
    near = known.withColumn("_bucket", bucket).groupBy(KEY, "_bucket").agg(F.sort_array(F.collect_list(item), asc=False).alias("_fits"))
    d = frames.withColumn("_bucket", floor_div(F.col("t_ms"), size)).join(near, [KEY, "_bucket"], "left")
    d = d.withColumn("_f", F.get(F.filter("_fits", lambda f: F.col("t_ms").between(f["start_t"], f["end_t"])), F.lit(0)))
    f = F.col("_f")
    length = (f["end_t"] - f["start_t"]).cast("double")
    ideal = waves.ideal_curve(wrap01((F.col("t_ms") - f["start_t"]) / length + offset), f["mean"], f["amp"], f["systole"], f["diastole"])
    scaled = f["lo"] + (ideal - f["ilo"]) * (f["hi"] - f["lo"]) / (f["ihi"] - f["ilo"])
    out = {"sin_wave": F.when((f["hi"] > f["lo"]) & (f["ihi"] > f["ilo"]), scaled).otherwise(ideal), "sin_amplitude": f["amp"],
           "sin_mean": f["mean"], "sin_ibi_ms": length}
    return d.select(*frames.columns, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.items()])
