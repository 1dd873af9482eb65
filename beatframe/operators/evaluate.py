"""Offline analyses of recorded sessions.  Where no formula is published the definition is ours and says so."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import waves
from ..functions.lets import let
from ..functions.scalars import VIB_OFF, VIB_ON, magnitude
from .aggregates import count_quantiles, value_counts
from .chunks import KEY, attach, cut
from .joins import asof_nearest, assign_beat
from .rolling import rolling_sd


def upslope(beats: DataFrame, out: str = "sys_upslope_max") -> DataFrame:
    """Steepest rise per second after the lowest sample of each beat (ours: systole starts at the minimum)."""
    def steep(s):
        v = F.transform(s, lambda x: x["v"])
        low = (F.array_position(v, F.array_min(v)) - 1).cast("int")
        rise = lambda k: F.transform(F.slice(s, k + 2, F.size(s)), lambda x, i: (
            x["v"] - F.get(s, k + i)["v"]) / ((x["t"] - F.get(s, k + i)["t"]) / 1000.0))
        return let(low, lambda k: F.array_max(rise(k)))

    return beats.withColumn(out, let(F.col("samples"), steep))


def windows20(beats: DataFrame, cols: Sequence[str], seconds: int = 20, t: str = "t_ms", key: Sequence[str] = (KEY,)
              ) -> DataFrame:
    """Mean features per fixed window (ours: windows are aligned to the session clock)."""
    w = F.floor(F.col(t) / (seconds * 1000)).cast("bigint").alias("window")
    return beats.groupBy(*key, w).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def merge_reference(beats: DataFrame, ref: DataFrame, tolerance_ms: int = 5_000, on: str = "t_ms") -> DataFrame:
    """Nearest reference pressure of each beat; beats without one keep nulls (ours: tolerance 5 s)."""
    r = ref.withColumnsRenamed({"sbp": "ref_sbp", "dbp": "ref_dbp"})
    return asof_nearest(beats, r, on, ["ref_sbp", "ref_dbp"], tol=tolerance_ms)


def ridge_loso(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, subject: str = "subject"
               ) -> DataFrame:
    """Ridge coefficients per left-out subject (intercept first and not penalised).

    One pass gathers sums of products per subject; the k x k system of a fold uses the total minus its own sums.
    Rows never leave their tasks, only one short vector per subject does.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    k = len(cols)
    prods = [(i, j) for i in range(k) for j in range(i, k)]
    gram = rows.groupBy(subject).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in prods])
    names = [f"g{i}_{j}" for i, j in prods]
    total = gram.agg(*[F.sum(n).alias(n) for n in names]).first()
    rest = gram.select(subject, F.array(*[F.lit(float(total[n] or 0.0)) - F.col(n) for n in names]).alias("g"))
    schema = T.StructType([rest.schema[subject], T.StructField("coefs", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf["g"]:
                m = np.zeros((k, k))
                for (i, j), v in zip(prods, g):
                    m[i, j] = m[j, i] = v
                n = m[0, 0]
                if n <= 0:
                    out.append([float("nan")] * (k - 1))
                    continue
                mean = m[0, 1:] / n
                c = m[1:, 1:] - n * np.outer(mean, mean)
                w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(k - 2), c[:-1, -1])
                out.append([float(mean[-1] - mean[:-1] @ w), *map(float, w)])
            yield pd.DataFrame({subject: pdf[subject], "coefs": out})

    return rest.mapInPandas(solve, schema)


def predict_loso(rows: DataFrame, folds: DataFrame, features: Sequence[str], subject: str = "subject") -> DataFrame:
    from ..functions.models import linear_predict
    return attach(rows, folds, subject, features).withColumn("pred", linear_predict("coefs", F.array(
        *[F.col(c).cast("double") for c in features]))).drop("coefs")


def bp_errors(rows: DataFrame, pred: str = "pred", ref: str = "ref", subject: str = "subject") -> DataFrame:
    """Per subject: level error, and mean absolute / RMS error after removing both subject means."""
    means = rows.groupBy(subject).agg(F.avg(pred).alias("_p"), F.avg(ref).alias("_r"))
    d = attach(rows, means, subject, [pred, ref]).withColumn("_e", (F.col(pred) - F.col("_p")) - (F.col(ref) - F.col("_r")))
    return d.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.first("_p") - F.first("_r")).alias("level_error"),
        F.avg(F.abs("_e")).alias("centred_mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("centred_rmse"))


def tracking(rows: DataFrame, pred: str = "pred", ref: str = "ref", subject: str = "subject", by: Sequence[str] = ()
             ) -> DataFrame:
    """Correlation, concordance and sign agreement of deviations from the subject means (ours: delta = value - mean)."""
    means = rows.groupBy(subject, *by).agg(F.avg(pred).alias("_p"), F.avg(ref).alias("_r"))
    d = attach(rows, means, [subject, *by], [pred, ref]).withColumn("_x", F.col(pred) - F.col("_p")).withColumn(
        "_y", F.col(ref) - F.col("_r"))
    ccc = 2 * F.covar_pop("_x", "_y") / (F.var_pop("_x") + F.var_pop("_y") + F.pow(F.avg("_x") - F.avg("_y"), F.lit(2.0)))
    moved = (F.col("_x") != 0) & (F.col("_y") != 0)
    agree = F.avg(F.when(moved, (F.signum("_x") == F.signum("_y")).cast("double")))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("r"), ccc.alias("ccc"),
                              agree.alias("sign_agreement"))


def reject_outliers(rows: DataFrame, feature: str, ref: str, mode: str = "artifact_only", limit: float = 3.0, key=KEY
                    ) -> DataFrame:
    """Drop rows by robust z scores per key (ours: |x - median| > limit * 1.4826 * MAD).

    'mad_both' drops extremes of feature or reference; 'artifact_only' only extremes of the feature while the
    reference is normal.
    """
    # the rows are unpivoted and counted once; deviations come from the counts
    counts = cut(value_counts(rows, [feature, ref], [key]))
    middle = count_quantiles(counts, [0.5], [key]).select(key, "column", F.col("value").alias("_m"))
    moved = attach(counts, middle, [key, "column"], ["x"]).select(key, "column", F.abs(F.col("x") - F.col("_m")).alias("x"), "n")
    spread = count_quantiles(moved.groupBy(key, "column", "x").agg(F.sum("n").alias("n")), [0.5], [key]).select(key, "column", F.col("value").alias("_s"))
    of = lambda c, v, n: F.max(F.when(F.col("column") == c, F.col(v))).alias(n)
    facts = middle.join(spread, [key, "column"]).groupBy(key).agg(of(feature, "_m", "_mf"), of(ref, "_m", "_mr"), of(feature, "_s", "_sf"), of(ref, "_s", "_sr"))
    d = attach(rows, facts, key, [feature, ref])
    d = d.withColumn("_df", F.abs(F.col(feature) - F.col("_mf"))).withColumn("_dr", F.abs(F.col(ref) - F.col("_mr")))
    scale = limit * 1.4826
    far_f, far_r = F.col("_df") > F.col("_sf") * scale, F.col("_dr") > F.col("_sr") * scale
    drop = (far_f | far_r) if mode == "mad_both" else (far_f & ~far_r)
    return d.where(~drop).drop("_mf", "_mr", "_df", "_dr", "_sf", "_sr")


def decimate(frames: DataFrame, factors: Sequence[int] = (1, 2, 3, 4), idx: str = "frame_idx") -> DataFrame:
    """Each frame once per factor that keeps it, renumbered (30, 15, 10, 7.5 fps)."""
    keep = F.filter(F.array(*[F.lit(f) for f in factors]), lambda f: F.col(idx) % f == 0)
    return frames.withColumn("factor", F.explode(keep)).withColumn(idx, F.floor(F.col(idx) / F.col("factor")))


def envelope(samples: DataFrame, vanish_share: float = 0.10, value: str = "v") -> DataFrame:
    """Per session: largest beat amplitude, its beat (mean pressure point), first later beat under a share of it.

    Ours: the vanish point is the first beat after the peak below 10 % of the peak amplitude.
    """
    amp = samples.groupBy(KEY, "beat_index").agg((F.max(value) - F.min(value)).alias("amp"))
    best = F.max(F.struct(F.col("amp"), (-F.col("beat_index")).alias("_b")))
    top = amp.groupBy(KEY).agg(best.alias("_t")).select(
        KEY, F.col("_t.amp").alias("peak_amp"), (-F.col("_t._b")).alias("map_beat"))
    gone = amp.join(top, KEY).where((F.col("beat_index") > F.col("map_beat"))
                                    & (F.col("amp") < F.col("peak_amp") * vanish_share))
    return top.join(gone.groupBy(KEY).agg(F.min("beat_index").alias("vanish_beat")), KEY, "left")


def wave_break(beats: DataFrame, rest, n: int = 64) -> DataFrame:
    """Correlation of each resampled beat with the mean resampled beat of the rest phase."""
    d = beats.withColumn("_w", waves.resample(waves.values("samples"), n))
    points = d.where(rest).select(KEY, F.posexplode("_w").alias("_i", "_v"))
    mean = points.groupBy(KEY, "_i").agg(F.avg("_v").alias("_m"))
    template = mean.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))),
                                                 lambda x: x["_m"]).alias("_t"))  # n values per session
    return attach(d, template, KEY, ["beat_index"], "left").withColumn("wave_corr", F.when(F.col("_t").isNotNull(), waves.array_corr(
        F.col("_w"), F.col("_t")))).drop("_w", "_t")


def imu_rolling_sd(imu: DataFrame, cols: Sequence[str] = ("accel_x", "accel_y", "accel_z")) -> DataFrame:
    return rolling_sd(imu, cols)


def imu_on_frames(imu: DataFrame, frames: DataFrame, cols: Sequence[str] = ("accel_x", "accel_y", "accel_z"),
                  chunk_ns: int = 60_000_000_000) -> DataFrame:
    """Mean sensor values over the samples that end at each frame (ours: previous frame exclusive, own inclusive)."""
    marks = frames.select(KEY, "t_ns", F.col("frame_idx").alias("beat_index"))
    d = assign_beat(imu.drop("frame_idx"), marks, "t_ns", chunk=chunk_ns).where("beat_index is not null")
    return d.groupBy(KEY, F.col("beat_index").alias("frame_idx")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def resonance(imu: DataFrame, grid_hz: Sequence[float], key: Sequence[str] = (KEY,)) -> DataFrame:
    """Grid frequency with the largest Fourier power of |accel| over ON samples (mean removed by its grid sums); the lower one wins a tie.

    The grid becomes rows, so the plan is as wide for thousands of frequencies as for one, and the sums of a frequency combine before
    the shuffle.  Turns are taken from whole seconds and from the rest apart, so that epoch clocks keep their digits.  Samples without
    a magnitude take no part.
    """
    on = imu.where(F.col("vib_state") == VIB_ON).select(
        *key, F.expr("t_ns div 1000000000").alias("_s"), (F.expr("t_ns % 1000000000") / 1e9).alias("_r"),
        magnitude("accel_x", "accel_y", "accel_z").alias("_m")).where("_m IS NOT NULL")
    rows = on.select("*", F.explode(F.array(*[F.lit(float(f)) for f in grid_hz])).alias("_f"))
    whole = (F.col("_f") - F.floor("_f")) * F.col("_s")  # whole turns of whole seconds are left out
    rows = rows.withColumn("_a", F.lit(2.0 * math.pi) * (whole - F.floor(whole) + F.col("_f") * F.col("_r")))
    rows = rows.withColumn("_c", F.cos("_a")).withColumn("_d", F.sin("_a"))
    g = rows.groupBy(*key, "_f").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_m").alias("_m"), F.sum("_c").alias("_c"), F.sum("_d").alias("_d"),
        F.sum(F.col("_m") * F.col("_c")).alias("_mc"), F.sum(F.col("_m") * F.col("_d")).alias("_md"))
    c, d = F.col("_mc") - F.col("_m") * F.col("_c"), F.col("_md") - F.col("_m") * F.col("_d")
    best = F.max(F.struct((c * c + d * d).alias("p"), (-F.col("_f")).alias("f"))).alias("_b")
    return g.groupBy(*key).agg(F.max("n").alias("n"), best).select(
        *key, "n", (-F.col("_b.f")).alias("resonance_hz"), (F.col("_b.p") / (F.col("n") * F.col("n"))).alias("power"))


def off_window(imu: DataFrame, key: Sequence[str] = (KEY,)) -> DataFrame:
    """RMS of |accel| in ON and OFF samples (guard excluded) and their ratio."""
    m = magnitude("accel_x", "accel_y", "accel_z")
    rms = lambda state: F.sqrt(F.avg(F.when(F.col("vib_state") == state, m * m)))
    d = imu.groupBy(*key).agg(rms(VIB_ON).alias("on_rms"), rms(VIB_OFF).alias("off_rms"))
    return d.withColumn("snr", F.when(F.col("off_rms") > 0, F.col("on_rms") / F.col("off_rms")))


def ingest(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sessions whose wave and training files have landed and that are not in the ledger yet; IMU is optional."""
    has = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    done = listing.groupBy(KEY).agg(has("Wave_Data").alias("_w"), has("Training_Data").alias("_t"),
                                    has("IMU_Data").alias("has_imu"))
    return done.where("_w = 1 and _t = 1").drop("_w", "_t").join(ledger.select(KEY), KEY, "left_anti")


def paired_arms(rows: DataFrame, arms: Sequence[str] = ("passive", "active", "fused")) -> DataFrame:
    """Mean paired difference, its SD and t statistic for each pair of arms; rows have one column per arm."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f"{b}-{a}").alias("pair"), (F.col(b) - F.col(a)).alias("d"))
                                          for a, b in pairs])).alias("r")).select("r.*")
    g = long.where("d is not null").groupBy("pair").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"),
                                                        F.stddev_samp("d").alias("sd"))
    return g.withColumn("t_stat", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n")))))


def union_sessions(dfs: Sequence[DataFrame]) -> DataFrame:
    """Append-only schemas side by side; columns a table does not have become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def imu_rate(imu: DataFrame) -> DataFrame:
    """Effective sampling rate of each session."""
    span = (F.max("t_ns") - F.min("t_ns")) / 1e9
    return imu.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), span.alias("span_s")).withColumn(
        "rate_hz", F.when(F.col("span_s") > 0, (F.col("n") - 1) / F.col("span_s")).otherwise(0.0))
