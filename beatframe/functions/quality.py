"""Quality predicates and reject reasons: the first failing test names the reason."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lets import let
from .scalars import col, count_reasons, exposure_status, finite, normalize_reason

MIN_ISO = 300
OK = "ok"


def beat_reason(ibi, amp, ref) -> Column:
    ibi, amp, ref = col(ibi), col(amp), col(ref)
    rapid = F.when(ref > 0, F.abs(ibi - ref) / ref > 0.3).otherwise(False)
    return (F.when((ibi < 300) | (ibi > 1500), "invalid_ibi")
            .when((amp < 0.5) | (amp > 50), "invalid_amplitude")
            .when(rapid, "rapid_ibi_change").otherwise(OK))


def window_reason_of(n, spread, std, ibi, fps=30) -> Column:
    """Stability of a beat window from its sample count, range and population SD."""
    n, ibi, fps = col(n), col(ibi), col(fps)
    expected = ibi * fps / 1000.0
    too_few = n < F.greatest(F.lit(6.0), expected * 0.30)
    too_many = n > F.greatest(F.lit(16.0), expected * 2.5)
    return (F.when(n.isNull() | (n < 8) | (ibi <= 0) | (fps <= 0), "insufficient_window")
            .when(too_few | too_many, "sample_count_out_of_range")
            .when(col(spread) < 0.35, "range_too_small").when(col(std) < 0.08, "std_too_small").otherwise(OK))


def array_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def array_std(v: Column) -> Column:
    return let(array_mean(v), lambda m: F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))


def window_reason(arr, ibi, fps=30) -> Column:
    """Same test on an array of ``(t, v)`` samples."""
    def judge(v: Column) -> Column:
        return F.when(F.size(v) > 0, let(array_std(v), lambda sd: window_reason_of(
            F.size(v), F.array_max(v) - F.array_min(v), sd, ibi, fps))).otherwise("insufficient_window")

    return let(F.transform(col(arr), lambda s: s["v"]), judge)


def relttp_reason(v2p, p2v) -> Column:
    v2p, p2v = col(v2p), col(p2v)
    total = F.abs(v2p) + F.abs(p2v)
    return (F.when(~finite(v2p) | ~finite(p2v), "invalid_rel_ttp")
            .when((total < 0.80) | (total > 1.30), "rel_ttp_sum_out_of_range").otherwise(OK))


def bp_reason(sbp, dbp) -> Column:
    sbp, dbp = col(sbp), col(dbp)
    pp = sbp - dbp
    return (F.when((sbp < 60) | (sbp > 200), "sbp_out_of_range").when((dbp < 40) | (dbp > 150), "dbp_out_of_range")
            .when(sbp <= dbp, "sbp_not_above_dbp")
            .when((pp < 20) | (pp > 100), "pulse_pressure_out_of_range").otherwise(OK))


def support_reason(joined, max_clamps: int = 1) -> Column:
    return F.when(count_reasons(joined) > max_clamps, "feature_support_violation").otherwise(OK)


def fit_reason(rmse, max_rmse: float = 1.0) -> Column:
    return F.when(col(rmse) > max_rmse, "poor_sine_fit").otherwise(OK)


def quality_gate(amp, y, position_ok, area_status, touch_valid) -> Column:
    amplitude, exposure = col(amp) >= 1.5, exposure_status(y) == OK
    return F.struct((amplitude & exposure).alias("passed"), amplitude.alias("amplitude"), exposure.alias("exposure"),
                    col(position_ok).alias("position"), col(touch_valid).cast("boolean").alias("touch"),
                    (col(area_status) == OK).alias("area"))


def failed_gates(gate) -> Column:
    """Names of failed gates; empty while the overall gate passes."""
    g = col(gate)
    names = [F.when(~g[n], n) for n in ("amplitude", "exposure", "position", "touch", "area")]
    return F.when(g["passed"], "").otherwise(F.concat_ws(",", *names))


def is_valid(valid, reason, sbp, dbp) -> Column:
    sbp, dbp = col(sbp), col(dbp)
    return F.coalesce((col(valid) == 1) & (normalize_reason(reason) == OK) & finite(sbp) & finite(dbp)
                      & (sbp > 0) & (dbp > 0), F.lit(False))


def pair_valid(kind: str, v_low, v_high, pos_low, pos_high, slot_low, slot_high, ibi, step_ms: int = 33) -> Column:
    """Valley/peak pair test.  ``kind`` is 'v2p' (rise) or 'p2v' (fall); positions count frames back."""
    v_low, v_high, ibi = col(v_low), col(v_high), col(ibi)
    dt = F.abs(col(pos_low) - col(pos_high)) * step_ms
    gap = F.abs(col(slot_low) - col(slot_high))
    if kind == "v2p":
        timing, widest, drop, beat_part = (dt >= 10) & (dt <= ibi * 5), 150, 1.0, dt >= ibi * 0.125
    else:
        timing, widest, drop, beat_part = (dt >= 10) & (dt <= ibi * 4), 120, 0.5, dt <= ibi * 0.875
    ok = (F.abs(v_high - v_low) > 0.1) & timing & (gap <= widest) & (v_high > v_low - drop) & beat_part & (gap >= 3)
    return F.coalesce(ok, F.lit(False))


def finite_or(v, default=0.0) -> Column:
    v = col(v)
    return F.when(finite(v), v).otherwise(col(default))


def rr_in_band(s, lo: float, hi: float, inclusive: bool) -> Column:
    s = col(s)
    return s.between(lo, hi) if inclusive else (s > lo) & (s < hi)


def imu_rate_warning(rate_hz, phase, ms_in_phase, min_hz: float = 250.0, delay_ms: int = 3000) -> Column:
    rate = col(rate_hz)
    return (col(phase) >= 1) & (col(ms_in_phase) >= delay_ms) & (rate > 0) & (rate < min_hz)
