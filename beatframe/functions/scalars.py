"""Scalar expressions: Column in, Column out.  Nothing here shuffles or leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Device and protocol constants.
FPS = 30.0
Y_TOO_DARK, Y_TOO_BRIGHT = 35.0, 200.0
AREA_BASE, AREA_FULL, AREA_MAX = 16_000.0, 18_000.0, 18_000.0
REFERENCE_DENSITY = 2.625
PHASES = ("placement", "rest", "cold", "recovery")
PHASE_MS = {"placement": 10_000, "rest": 120_000, "cold": 60_000, "recovery": 120_000}
BURST_OFF_MS, BURST_GUARD_MS, BURST_ON_MS = 1500, 50, 500
VIB_OFF, VIB_ON, VIB_GUARD = 0, 1, 2


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def java_round(c: Column) -> Column:
    """Round half up to a whole number."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def green_correct(g) -> Column:
    return (col(g) % 30) / 30.0 * 100.0 * 3.0


def clamp(v, lo, hi) -> Column:
    """Limit to [lo, hi]; NaN and null pass through."""
    v, lo, hi = col(v), col(lo), col(hi)
    return F.when(F.isnan(v), v).when(v < lo, lo).when(v > hi, hi).otherwise(v)


def clamp01(v) -> Column:
    return clamp(v, 0.0, 1.0)


def ibi_to_bpm(ibi) -> Column:
    ibi = col(ibi)
    return F.when(ibi > 0, 60000.0 / ibi)


def hr_from(smoothed_ibi, ibi) -> Column:
    s, i = col(smoothed_ibi), col(ibi)
    return F.when(s > 0, 60000.0 / s).when(i > 0, 60000.0 / i)


def peak_time_ms(left, center, right, base, fps=FPS) -> Column:
    """Vertex of the parabola through three samples, at most half a frame from ``base``."""
    left, center, right = col(left), col(center), col(right)
    bend = left - center * 2.0 + right
    shift = F.when(F.abs(bend) > 1e-9, (left - right) * 0.5 / bend).otherwise(0.0)
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), shift))
    frame_ms = F.lit(1000.0) / F.greatest(col(fps).cast("double"), F.lit(1.0))
    return java_round(col(base) + shift * frame_ms)


def map_of(sbp, dbp) -> Column:
    return (col(sbp) + col(dbp) * 2.0) / 3.0


def pp_of(sbp, dbp) -> Column:
    return col(sbp) - col(dbp)


def dbp_of(mean_p, pulse_p) -> Column:
    return col(mean_p) - col(pulse_p) / 3.0


def sbp_of(mean_p, pulse_p) -> Column:
    return dbp_of(mean_p, pulse_p) + col(pulse_p)


def was_clamped(before, after) -> Column:
    return F.abs(col(after) - col(before)) > 1e-9


def clamp_note(label: str, before, after) -> Column:
    return F.format_string(f"{label}:%.4f->%.4f", col(before), col(after))


def _clamped(label: str, before: Column, after: Column) -> Column:
    return F.struct(after.alias("used"), F.when(was_clamped(before, after), clamp_note(label, before, after)).alias("reason"))


def clamp_feature(label: str, v, lo, hi) -> Column:
    """struct<used, reason>; reason is null when the value was inside its support."""
    v = col(v)
    return _clamped(label, v, clamp(v, lo, hi))


def clamp_feature_upper(label: str, v, hi) -> Column:
    v = col(v)
    return _clamped(label, v, F.least(v, col(hi)))


def join_reasons(*reasons: Column) -> Column:
    """All clamp notes joined by '|'; empty when nothing was clamped."""
    return F.concat_ws("|", *reasons)


def count_reasons(joined) -> Column:
    joined = col(joined)
    return F.when(F.coalesce(joined, F.lit("")) == "", 0).otherwise(F.size(F.split(joined, r"\|")))


def normalize_reason(c) -> Column:
    c = F.trim(col(c))
    return F.when(c.isNull(), "missing").when(c == "", "ok").otherwise(c)


def sanitize_csv(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[,\r\n]", "_")


def format_array(arr, sep: str = ", ", fmt: str = "%.10f") -> Column:
    return F.array_join(F.transform(col(arr), lambda x: F.format_string(fmt, x)), sep)


def rel_ttp(dt, ibi) -> Column:
    """Share of the interval as a negative number, at most 0.95 in size."""
    dt, ibi = col(dt), col(ibi)
    return -F.least(F.lit(0.95), F.when(ibi == 0, F.lit(float("inf"))).otherwise(dt / ibi))


def augmentation_index(v2p_amp, p2v_amp) -> Column:
    """Percent of the total swing; null means the previous value stays."""
    a, b = col(v2p_amp), col(p2v_amp)
    return F.when(a + b > 0, a / (a + b) * 100.0).when(a > 0, 100.0).when(b > 0, 0.0)


def elapsed_s(t, t0) -> Column:
    t, t0 = col(t), col(t0)
    return F.when(t0 > 0, (t - t0) / 1000.0).otherwise(0.0)


def wall_iso(t_ms) -> Column:
    """Epoch ms as UTC text with milliseconds, independent of the session time zone."""
    t = col(t_ms)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86_400_000).cast("int"))
    ms = F.pmod(t, F.lit(86_400_000))
    part = lambda unit, mod: F.lpad((F.floor(ms / unit) % mod).cast("string"), 3 if unit == 1 else 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(3_600_000, 24), F.lit(":"), part(60_000, 60), F.lit(":"),
                    part(1000, 60), F.lit("."), part(1, 1000))


def exposure_status(y) -> Column:
    y = col(y)
    return F.when(y < Y_TOO_DARK, "too_dark").when(y > Y_TOO_BRIGHT, "too_bright").otherwise("ok")


def area_status(area, valid) -> Column:
    area = col(area)
    low = ~col(valid).cast("boolean") | (area <= 0) | (area < AREA_BASE)
    return F.when(low, "below_base").when(area > AREA_MAX, "too_large").otherwise("ok")


def touch_area(major, minor, size, overlay_w, overlay_h) -> Column:
    """Ellipse area; a pointer without axes falls back to its size share of the overlay."""
    zero = F.lit(0.0)
    major, minor, size = (F.greatest(zero, col(c)) for c in (major, minor, size))
    w, h = col(overlay_w), col(overlay_h)
    ellipse = F.lit(math.pi) * major * minor / 4.0
    return F.when((ellipse <= 0) & (size > 0) & (w > 0) & (h > 0), size * w * h).otherwise(ellipse)


IN_ZONE_GRID = 8


def in_half_ellipse(x, y, center_x, top_y, half_w, half_h) -> Column:
    x, y, half_w, half_h = col(x), col(y), col(half_w), col(half_h)
    dx, dy = (x - col(center_x)) / half_w, (y - col(top_y)) / half_h
    return F.when((half_w <= 0) | (half_h <= 0), True).when(y < col(top_y), False).otherwise(dx * dx + dy * dy <= 1.0)


def in_zone_area(area, cx, cy, major, minor, center_x, top_y, half_w, half_h) -> Column:
    """Share of 64 fixed points of the contact ellipse that lie in the lower half ellipse, times the area."""
    area, cx, cy, major, minor = map(col, (area, cx, cy, major, minor))
    cells = IN_ZONE_GRID * IN_ZONE_GRID

    def point(i: int) -> Column:
        theta = F.lit(2.0 * math.pi * ((i // IN_ZONE_GRID + 0.5) / IN_ZONE_GRID))
        return F.struct(F.sqrt(F.lit((i % IN_ZONE_GRID + 0.5) / IN_ZONE_GRID)).alias("r"), F.cos(theta).alias("c"), F.sin(theta).alias("s"))

    def hit(p: Column) -> Column:
        x = cx + major / 2.0 * p["r"] * p["c"]
        y = cy + minor / 2.0 * p["r"] * p["s"]
        return in_half_ellipse(x, y, center_x, top_y, half_w, half_h)

    # constants, folded to one literal: no root, sine or cosine per row
    inside = F.size(F.filter(F.array(*[point(i) for i in range(cells)]), hit))
    return (F.when((area <= 0) | (major <= 0) | (minor <= 0), 0.0)
            .when((col(half_w) <= 0) | (col(half_h) <= 0), area)
            .otherwise(area * (inside / float(cells))))


def normalize_area(area, density) -> Column:
    area, density = col(area), col(density)
    scale = F.lit(REFERENCE_DENSITY) / F.when(density > 0, density).otherwise(REFERENCE_DENSITY)
    return F.when(area <= 0, 0.0).otherwise(area * scale * scale)


def press_progress(area) -> Column:
    return clamp01((col(area) - AREA_BASE) / (AREA_FULL - AREA_BASE))


def press_target(phase, elapsed_ms, cold_ms=PHASE_MS["cold"], recovery_ms=PHASE_MS["recovery"]) -> Column:
    phase = col(phase)
    t = F.greatest(F.lit(0).cast("bigint"), col(elapsed_ms)).cast("double")
    return (F.when(phase == 2, clamp01(t / col(cold_ms)))
            .when(phase == 3, clamp01(1.0 - t / col(recovery_ms))).otherwise(0.0))


def phase_remaining_ms(phase, elapsed_ms, stable_ms=None, gate_ok=None, durations=None) -> Column:
    """Time left in the phase.  Gated placement counts the stable run; a forced timeline counts elapsed time."""
    phase, d = col(phase), durations or PHASE_MS
    zero = F.lit(0).cast("bigint")
    t = F.greatest(zero, col(elapsed_ms))
    left = lambda name, used: F.greatest(zero, F.lit(d[name]).cast("bigint") - used)
    if stable_ms is None:
        placement = left("placement", t)
    else:
        stable = col(stable_ms)
        placement = F.when(~col(gate_ok) | stable.isNull(), F.lit(d["placement"]).cast("bigint")).otherwise(
            left("placement", stable))
    return (F.when(phase == 0, placement).when(phase == 1, left("rest", t)).when(phase == 2, left("cold", t))
            .when(phase == 3, left("recovery", t)).otherwise(zero))


def phase_name(phase) -> Column:
    phase = col(phase)
    out = F.when(phase == 0, PHASES[0])
    for i, name in enumerate(PHASES[1:], 1):
        out = out.when(phase == i, name)
    return out.otherwise("unknown")


def wrap01(x) -> Column:
    return F.pmod(col(x), F.lit(1.0))


def yuv_to_rgb(y, u, v) -> Column:
    """Integer conversion with 8 fractional bits, clipped to 0..255."""
    c, d, e = col(y).cast("int") - 16, col(u).cast("int") - 128, col(v).cast("int") - 128
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(x, 8)))
    return F.struct(clip(298 * c + 409 * e + 128).alias("r"), clip(298 * c - 100 * d - 208 * e + 128).alias("g"),
                    clip(298 * c + 516 * d + 128).alias("b"))


def magnitude(x, y, z) -> Column:
    x, y, z = col(x).cast("double"), col(y).cast("double"), col(z).cast("double")
    return F.sqrt(x * x + y * y + z * z)


def burst_state(t_ms) -> Column:
    """struct<state, cycle> of the off / guard / on / guard schedule."""
    t = col(t_ms).cast("bigint")
    cycle = BURST_OFF_MS + BURST_ON_MS + 2 * BURST_GUARD_MS
    pos = F.pmod(t, F.lit(cycle).cast("bigint"))
    on_from = BURST_OFF_MS + BURST_GUARD_MS
    state = (F.when(pos < BURST_OFF_MS, VIB_OFF).when(pos < on_from, VIB_GUARD)
             .when(pos < on_from + BURST_ON_MS, VIB_ON).otherwise(VIB_GUARD))
    return F.struct(state.alias("state"), F.floor(t / cycle).cast("bigint").alias("cycle"))


def tempo_speed(target_tempo, base_tempo=120.0) -> Column:
    base = col(base_tempo)
    return clamp(col(target_tempo) / F.when(base > 0, base).otherwise(120.0), 0.5, 4.0)


def decode_pattern(a1, a2, a3, a4) -> Column:
    """Eight on/off slots from four action integers."""
    a1, a2, a3, a4 = (col(c).cast("int") for c in (a1, a2, a3, a4))
    bit = lambda a, i: F.shiftright(a, i).bitwiseAND(F.lit(1))
    return F.array(a1, bit(a4, 0), bit(a3, 0), bit(a4, 1), a2, bit(a4, 2), bit(a3, 1), bit(a4, 3))


def canonical_rotation(pattern) -> Column:
    """Smallest rotation as text, equal for all rotations of a pattern."""
    p = col(pattern)
    n = F.size(p)
    rotate = lambda k: F.array_join(F.concat(F.slice(p, k + 1, n), F.slice(p, 1, k)), "")
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), rotate))


def normalize_session_id(c, fallback_ms=None) -> Column:
    """Trim and replace everything outside [A-Za-z0-9._-]; blank ids become a timestamp when one is given."""
    text = F.trim(col(c))
    clean = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    if fallback_ms is None:
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).otherwise(clean)
    return F.when(F.coalesce(text, F.lit("")) == "", compact_time(fallback_ms)).otherwise(clean)


def compact_time(t_ms) -> Column:
    iso = wall_iso(t_ms)
    return F.concat(F.regexp_replace(F.substring(iso, 1, 10), "-", ""), F.lit("_"),
                    F.regexp_replace(F.substring(iso, 12, 8), ":", ""))


def base_name(subject, mode, t_ms) -> Column:
    subject = F.when(F.coalesce(col(subject), F.lit("")) == "", "session").otherwise(col(subject))
    return F.concat(subject, F.lit("_m"), col(mode).cast("string"), F.lit("_"), compact_time(t_ms))


def epoch_ms(ts) -> Column:
    """Milliseconds since 1970 of a timestamp as written, whatever the session time zone."""
    ts = col(ts)
    us = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("bigint")
    return (F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000 + F.hour(ts) * 3_600_000
            + F.minute(ts) * 60_000 + us)


def utc_timestamp(ts) -> Column:
    """Instant of a timestamp as written, read as UTC, whatever the session time zone."""
    ts = col(ts)
    us = F.round(F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.timestamp_micros(F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
                              + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + us)
