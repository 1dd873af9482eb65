"""Beat detection on the frame path and valley/peak morphology.

Frames are reduced to sparse candidate rows first; only those go through the state machines.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.quality import MIN_ISO, pair_valid
from ..functions.scalars import FPS, augmentation_index, java_round, rel_ttp
from .chunks import IDX, KEY, Halo, Lift, carry, cut, ewma, fold, let, move, running_sum
from .conditioning import signal
from .joins import asof_backward

# Refractory and interval limits, histories.
REFRACTORY_MIN, REFRACTORY_MAX, REFRACTORY_SHARE = 8, 24, 0.58
MIN_INTERVAL_S, MAX_INTERVAL_S = 0.30, 1.50
BPM_HISTORY = 20
RING = 240
STEP_MS = 33  # whole milliseconds per frame in the morphology search
DEBOUNCE_MS = 100


def gate_iso(frames: DataFrame, minimum: int = MIN_ISO) -> DataFrame:
    """Frames bright enough for detection."""
    return frames.where(F.col("iso") >= minimum)


def gated_index(frames: DataFrame, chunk_col: str | None = None) -> DataFrame:
    """``gidx``: zero-based ordinal among frames that pass the low-light gate, null for the others."""
    if "iso" not in frames.columns:
        d = frames.drop(chunk_col) if chunk_col else frames
        return d.withColumn("gidx", F.col(IDX))
    ok = F.col("iso") >= MIN_ISO
    counted = running_sum(frames, {"_n": ok.cast("bigint")}, chunk_col=chunk_col)
    return counted.withColumn("gidx", F.when(ok, F.col("_n") - 1)).drop("_n")


def refractory_frames(smoothed):
    adaptive = java_round(smoothed * REFRACTORY_SHARE / (1000.0 / FPS)).cast("int")
    return F.when(smoothed <= 0, REFRACTORY_MIN).otherwise(
        F.greatest(F.lit(REFRACTORY_MIN), F.least(F.lit(REFRACTORY_MAX), adaptive)))


PEAK_STATE = ("struct<g:bigint,late:int,t:bigint,ibi:double,smoothed:double,last_ibi:double,"
              "bpm:double,history:array<double>>")
PEAK_OUT = ("struct<frame_idx:bigint,gidx:bigint,t_peak:bigint,valid:boolean,interval_ms:double,ibi_ms:double,"
            "bpm:double,bpm_sd:double,smoothed_before:double,smoothed_ibi_ms:double>")


def _peak_step(a, x):
    frames_since = x["gidx"] - a["g"] - 1 + a["late"]
    accepted = frames_since >= refractory_frames(a["smoothed"])
    interval = (x["t_peak"] - a["t"]) / 1000.0
    valid = F.coalesce(interval.between(MIN_INTERVAL_S, MAX_INTERVAL_S), F.lit(False))
    bpm = F.when(valid, F.lit(60.0) / interval)
    history = F.slice(F.concat(F.array(bpm), a["history"]), 1, BPM_HISTORY)  # newest first

    def stats(h):
        mean = F.aggregate(F.reverse(h), F.lit(0.0), lambda s, v: s + v) / F.size(h)
        return let(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(
            F.aggregate(F.reverse(h), F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(h)).alias("sd")))

    def beat(b):
        m = b["st"]["mean"]
        near = (b["bpm"] >= m - m * 0.1) & (b["bpm"] <= m + m * 0.1)
        ibi = F.when(near, F.lit(60.0) / b["bpm"] * 1000.0).otherwise(interval * 1000.0)
        return let(ibi, lambda v: F.struct(
            v.alias("ibi"), F.when(near, b["bpm"]).otherwise(a["bpm"]).alias("bpm"), b["st"]["sd"].alias("sd"),
            F.when(v == a["last_ibi"], a["smoothed"]).otherwise((a["smoothed"] + v) / 2.0).alias("smoothed"),
            b["h"].alias("h")))

    new = F.when(valid, let(F.struct(bpm.alias("bpm"), history.alias("h"), stats(history).alias("st")), beat))
    x_g, x_t = x["gidx"], x["t_peak"]

    def result(n):
        after_beat = F.struct(x_g, F.lit(0), x_t, n["ibi"], n["smoothed"], n["ibi"], n["bpm"], n["h"])
        after_other = F.struct(x_g, F.lit(1), x_t, a["ibi"], a["smoothed"], a["last_ibi"], a["bpm"], a["history"])
        hit = n.isNotNull()
        out = F.struct(x["frame_idx"], x_g, x_t, hit, F.when(hit, interval * 1000.0),
                       F.when(hit, n["ibi"]).otherwise(a["ibi"]), F.when(hit, n["bpm"]).otherwise(a["bpm"]), n["sd"],
                       a["smoothed"], F.when(hit, n["smoothed"]).otherwise(a["smoothed"])).cast(PEAK_OUT)
        return move(F.when(hit, after_beat.cast(PEAK_STATE)).otherwise(after_other.cast(PEAK_STATE)), out)

    return F.when(accepted, let(new, result)).otherwise(move(a, F.lit(None).cast(PEAK_OUT)))


def _smoother_lift() -> Lift:
    """The smoothed interval of a chunk is ``a * start + b``, as long as the start leaves every accept decision as it was.

    A wait of n frames is kept by smoothed intervals below (n + 0.5) / share per frame; the bounds on the start are taken in by a hair, and a
    start outside them runs again.
    """
    per_frame = REFRACTORY_SHARE / (1000.0 / FPS)

    def note(l, s, r, x):
        since = x["gidx"] - s["g"] - 1 + s["late"]
        edge = ((since + F.lit(0.5)) / per_frame - l["b"]) / l["a"]  # start at which this decision would turn
        open_ = (since >= REFRACTORY_MIN) & (since < REFRACTORY_MAX) & (l["a"] > 0)
        accepted = r["o"].isNotNull()
        new = F.coalesce(accepted & r["o"]["valid"] & (r["s"]["ibi"] != s["last_ibi"]), F.lit(False))
        return F.struct(F.when(new, l["a"] / 2.0).otherwise(l["a"]), F.when(new, (l["b"] + r["s"]["ibi"]) / 2.0).otherwise(l["b"]),
                        F.when(open_ & ~accepted, F.greatest(l["lo"], edge)).otherwise(l["lo"]), F.when(open_ & accepted, F.least(l["hi"], edge)).otherwise(l["hi"]))

    def others(s):
        return F.struct(*[s[c] for c in ("g", "late", "t", "ibi", "last_ibi", "bpm", "history")])

    def covers(l, ran, real):
        v = real["smoothed"]
        return others(ran).eqNullSafe(others(real)) & (ran["smoothed"] > 0) & (v > 0) & (v > l["lo"] + 1e-6) & (v < l["hi"] - 1e-6)

    def end(l, s, real):
        return s.withField("smoothed", l["a"] * real["smoothed"] + l["b"])
    zero = F.struct(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1e12))
    return Lift("struct<a:double,b:double,lo:double,hi:double>", zero, note, covers, end)


def accept_peaks(cands: DataFrame) -> DataFrame:
    """Adaptive refractory accept, interval test, BPM history and half-average smoothing in one state machine.

    The frame counter starts one late after a valid beat; the smoother starts from 0.  One row per accepted peak;
    ``valid`` marks beats, ``smoothed_before`` is the state the beat was scored with.
    """
    init = F.struct(F.lit(-8).cast("bigint"), F.lit(1), F.lit(None).cast("bigint"), F.lit(0.0), F.lit(0.0), F.lit(0.0),
                    F.lit(0.0), F.array().cast("array<double>")).cast(PEAK_STATE)
    return fold(cands, "gidx", ["frame_idx", "gidx", "t_peak"], init, _peak_step, PEAK_STATE, PEAK_OUT, lift=_smoother_lift())


def candidates_of(sig: DataFrame, chunk_col: str | None = None) -> DataFrame:
    """Sparse candidate rows of a ``signal`` table with their gated ordinal."""
    return gated_index(sig, chunk_col).where("is_cand and gidx is not null").select(
        KEY, IDX, "gidx", "t_ms", "t_peak")


def detect_beats(frames: DataFrame, logic: str = "1") -> DataFrame:
    """Frames to beats: conditioning, candidates, accept.  Invalid peaks are left out."""
    gated = "iso" in frames.columns
    sig = signal(frames, logic, keep_chunk=gated, turning_points=False)
    return accept_peaks(candidates_of(sig, "_chunk" if gated else None)).where("valid").drop("valid")


def beat_index(beats: DataFrame, order: str = IDX, out: str = "beat_index") -> DataFrame:
    """One-based ordinal of beats within a session."""
    ranked = running_sum(beats, {out: F.lit(1).cast("bigint")}, idx=order)
    return ranked


def smooth_ibi(beats: DataFrame, ibi: str = "ibi_ms", order: str = "beat_index") -> DataFrame:
    """Half-average from 0 over changed intervals only; repeats and missing intervals keep the value."""
    d = dense_from(beats, order).withColumnRenamed("_ord", "_row")
    h = Halo(d, back=1, idx="_row")
    before = F.coalesce(F.lag(ibi).over(h.window), F.lit(0.0))
    d = h.trim(h.spread(d).withColumn("_new", F.col(ibi).isNotNull() & (F.col(ibi) != before)))
    # over changed intervals the recurrence is an exponential mean; halving the first value stands for the start at 0
    x = dense_from(d.where("_new").select(KEY, "_row", F.col(ibi).cast("double").alias("_x")), "_row")
    x = ewma(x.withColumn("_x", F.when(F.col("_ord") == 0, F.col("_x") / 2.0).otherwise(F.col("_x"))), "_x", 0.5, "smoothed_ibi_ms")
    d = carry(d.join(x.select(KEY, "_row", "smoothed_ibi_ms"), [KEY, "_row"], "left"), ["smoothed_ibi_ms"], idx="_row")
    return d.withColumn("smoothed_ibi_ms", F.coalesce("smoothed_ibi_ms", F.lit(0.0))).select(*beats.columns, "smoothed_ibi_ms")


def frame_state(sig: DataFrame, peaks: DataFrame) -> DataFrame:
    """Interval and smoothed interval known at the end of each frame (0 before the first beat).

    ``smoothed_prev`` is the smoothed value one frame earlier; ``is_beat`` marks frames that close a beat.  Beats are sorted in
    among the frames of their chunk, so frames are shuffled once and joined by no frame number.
    """
    b = peaks.where("valid").select(KEY, IDX, F.col(IDX).alias("_at"), F.col("ibi_ms").alias("_i"), F.col("smoothed_ibi_ms").alias("_s"),
                                    F.col("smoothed_before").alias("_b"), F.col("bpm").alias("_bpm"), F.col("bpm_sd").alias("_sd"))
    d = asof_backward(sig, b, ["_at", "_i", "_s", "_b", "_bpm", "_sd"])
    zero, beat = F.lit(0.0), F.coalesce(F.col("_at") == F.col(IDX), F.lit(False))
    smoothed = F.coalesce("_s", zero)
    return d.select(*sig.columns, F.coalesce("_bpm", zero).alias("bpm"), F.coalesce("_sd", zero).alias("bpm_sd"), beat.alias("is_beat"),
                    F.coalesce("_i", zero).alias("ibi_ms"), smoothed.alias("smoothed_ibi_ms"), F.when(beat, F.col("_b")).otherwise(smoothed).alias("smoothed_prev"))


def local_extremes(states: DataFrame, chunk: int | None = None, max_interval_s: float = MAX_INTERVAL_S, keep_chunk: bool = False) -> DataFrame:
    """Best valley and peak of the rise and fall searches, for frames that run the search.

    Search ranges count frames back and follow the current interval.  ``max_interval_s`` bounds them; a row with a longer
    interval is an error, never a shorter search.  Only turning points enter the per-frame lists, so they stay short.
    """
    reach = min(math.floor(max_interval_s * FPS + 0.5) + 10, RING - 5) - 3
    h = Halo(states, back=reach, chunk=chunk)
    d = h.spread(states)
    point = F.struct(F.col("ring").alias("v"), F.col(IDX).alias("i"))
    span = h.rows(-reach, -2)
    d = d.select("*", F.collect_list(F.when(F.col("is_low"), point)).over(span).alias("_lows"),
                 F.collect_list(F.when(F.col("is_high"), point)).over(span).alias("_highs"))
    d = h.trim(d, keep_chunk).where("gidx is not null and not is_beat")
    n = F.least(java_round(F.col("ibi_ms") / (1000.0 / FPS)) + 10, F.lit(RING - 5))
    n = F.when(n - 3 <= reach, n).otherwise(F.raise_error(F.lit(f"an interval is longer than max_interval_s = {max_interval_s}")))
    d = d.withColumn("_n", n).withColumn("_half", F.floor(F.col("_n") / 2).cast("bigint"))
    half, last = F.col("_half"), F.col("_n") - 2

    def best(points: str, lo, hi, lowest: bool):
        pos = lambda p: F.col(IDX) - p["i"]
        sign = 1 if lowest else -1
        ranked = F.transform(F.filter(points, lambda p: (pos(p) >= lo) & (pos(p) < hi)),
                             lambda p: F.struct((p["v"] * sign).alias("k"), pos(p).alias("pos"), p["v"].alias("v"),
                                                F.pmod(p["i"] - 19, F.lit(RING)).alias("slot")))
        return F.array_min(ranked)

    return (d.withColumn("v2p_low", best("_lows", 2, half, True)).withColumn("v2p_high", best("_highs", half, last, False))
            .withColumn("p2v_high", best("_highs", 2, half - 2, False))
            .withColumn("p2v_low", best("_lows", half + 2, last, True))
            .drop("_lows", "_highs", "_n", "_half"))


def valid_pairs(ext: DataFrame) -> DataFrame:
    """One row per frame and kind with a valid valley/peak pair."""
    def rows(kind: str):
        lo, hi = F.col(f"{kind}_low"), F.col(f"{kind}_high")
        return F.struct(F.lit(kind).alias("kind"), F.abs(hi["v"] - lo["v"]).alias("amp"),
                        (F.abs(lo["pos"] - hi["pos"]) * STEP_MS).alias("dt"), F.abs(lo["slot"] - hi["slot"]).alias("gap"),
                        pair_valid(kind, lo["v"], hi["v"], lo["pos"], hi["pos"], lo["slot"], hi["slot"],
                                   F.col("ibi_ms"), STEP_MS).alias("ok"))

    both = F.filter(F.array(rows("v2p"), rows("p2v")), lambda r: r["ok"])
    keep = [KEY, IDX, "t_ms", "ibi_ms", *[c for c in ext.columns if c == "_chunk"]]
    return ext.select(*keep, F.explode(both).alias("r")).select(*keep, "r.kind", "r.amp", "r.dt", "r.gap")


def debounce_pairs(pairs: DataFrame) -> DataFrame:
    """Keep a pair when more than 100 ms passed and it does not repeat the kept pair before it, per kind."""
    state = "struct<t:bigint,amp:double,gap:bigint>"
    out = "struct<frame_idx:bigint,t_ms:bigint,ibi_ms:double,amp:double,dt:bigint,gap:bigint>"

    def step(a, x):
        late = F.coalesce(x["t_ms"] - a["t"] > DEBOUNCE_MS, F.lit(True))
        same = F.coalesce((F.abs(a["amp"] - x["amp"]) < 0.01) & (a["gap"] == x["gap"]), F.lit(False))
        keep = late & ~same
        return F.when(keep, move(F.struct(x["t_ms"], x["amp"], x["gap"]).cast(state), F.struct(
            x["frame_idx"], x["t_ms"], x["ibi_ms"], x["amp"], x["dt"], x["gap"]).cast(out))).otherwise(
            move(a, F.lit(None).cast(out)))

    none = F.struct(F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("bigint")).cast(state)
    return fold(pairs, IDX, [IDX, "t_ms", "ibi_ms", "amp", "dt", "gap"], none, step, state, out, key=[KEY, "kind"],
                chunk_col="_chunk" if "_chunk" in pairs.columns else None)


def pair_history(kept: DataFrame) -> DataFrame:
    """Morphology after each new pair: latest amplitudes, relative times (both with the interval of now) and AI."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    d = kept.groupBy(KEY, IDX).agg(F.max("t_ms").alias("t_ms"), F.max("ibi_ms").alias("ibi_ms"),
                                   of("v2p", "amp").alias("v2p_amp"), of("v2p", "dt").alias("v2p_dt"),
                                   of("p2v", "amp").alias("p2v_amp"), of("p2v", "dt").alias("p2v_dt"))
    d = carry(cut(d), ["v2p_amp", "v2p_dt", "p2v_amp", "p2v_dt"])  # read twice
    zero = F.lit(0.0)
    rel = lambda c: F.when(F.col(c).isNotNull(), rel_ttp(F.col(c).cast("double"), F.col("ibi_ms"))).otherwise(zero)
    return d.select(KEY, IDX, "t_ms", F.coalesce("v2p_amp", zero).alias("v2p_amp"),
                    F.coalesce("p2v_amp", zero).alias("p2v_amp"), rel("v2p_dt").alias("v2p_rel"),
                    rel("p2v_dt").alias("p2v_rel"),
                    augmentation_index(F.coalesce("v2p_amp", zero), F.coalesce("p2v_amp", zero)).alias("ai"))


MORPHOLOGY = ["v2p_amp", "p2v_amp", "v2p_rel", "p2v_rel", "ai"]


def morphology(states: DataFrame) -> DataFrame:
    return pair_history(debounce_pairs(valid_pairs(local_extremes(states, keep_chunk=True))))


def with_morphology(rows: DataFrame, morph: DataFrame, inclusive: bool = False) -> DataFrame:
    """Latest morphology before each row's frame; 0 before the first pair."""
    d = asof_backward(rows, morph, MORPHOLOGY, inclusive=inclusive)
    return d.select(*rows.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in MORPHOLOGY])


def bpm_stats(beats: DataFrame, n: int = BPM_HISTORY, order: str = "beat_index", interval: str = "interval_ms"
              ) -> DataFrame:
    """Mean and population SD of the last n BPM values and the 10 % outlier test; ``order`` is dense from 1."""
    h = Halo(beats, back=n, idx=order)
    d = h.spread(beats.withColumn("bpm_now", 60000.0 / F.col(interval)))
    d = d.select("*", F.avg("bpm_now").over(h.rows(1 - n, 0)).alias("bpm_mean"),
                 F.stddev_pop("bpm_now").over(h.rows(1 - n, 0)).alias("bpm_std"))
    m = F.col("bpm_mean")
    return h.trim(d.withColumn("is_outlier", ~F.col("bpm_now").between(m - m * 0.1, m + m * 0.1)))


def new_beats(rows: DataFrame, value: str = "ibi_ms", order: str = IDX) -> DataFrame:
    """Rows whose value differs from the row before, and the first row of each session."""
    return drop_repeats(rows, value, order)


def drop_repeats(rows: DataFrame, value: str, order: str = IDX) -> DataFrame:
    """Drop consecutive duplicates along a dense ``order``."""
    h = Halo(rows, back=1, idx=order)
    d = h.spread(rows).withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(h.window))
    return h.trim(d.where(F.col("_prev").isNull() | ~F.col("_prev")["v"].eqNullSafe(F.col(value)))).drop("_prev")


def carry_valid_bpm(rows: DataFrame, gate: str = "gate_ok", cols=("bpm", "bpm_sd")) -> DataFrame:
    """Latest BPM and SD that were computed on a gated frame."""
    kept = rows.select("*", *[F.when(F.col(gate) & (F.col(c) > 0), F.col(c)).alias(f"last_valid_{c}") for c in cols])
    return carry(kept, [f"last_valid_{c}" for c in cols])


def bpm_half_average(beats: DataFrame, bpm: str = "bpm_now", order: str = "beat_index") -> DataFrame:
    """(previous + new) / 2 seeded with the first value."""
    d = dense_from(beats, order)
    return ewma(d, bpm, 0.5, "bpm_smoothed").drop("_ord")


def dense_from(beats: DataFrame, order: str) -> DataFrame:
    """``_ord``: zero-based ordinal along ``order`` per session."""
    ranked = running_sum(beats, {"_ord": F.lit(1).cast("bigint")}, idx=order)
    return ranked.withColumn("_ord", F.col("_ord") - 1)

