"""Beat-array functions: bounded arrays (at most 90 samples) in, Columns out."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .lets import let
from .quality import array_mean, array_std
from .scalars import col

DEFAULT_SYSTOLE = 1.0 / 3.0
FIT_POINTS = 64
PHASE_SHIFT = -math.pi / 4.0
TWO_PI = 2.0 * math.pi
TINY = 1e-6


def values(arr) -> Column:
    return F.transform(col(arr), lambda s: s["v"])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def beat_stats(v) -> Column:
    """struct<n, min, max, range, std> of one beat window."""
    return let(col(v), _stats)


def _stats(v: Column) -> Column:
    return F.struct(F.size(v).alias("n"), F.array_min(v).alias("min"), F.array_max(v).alias("max"),
                    (F.array_max(v) - F.array_min(v)).alias("range"), array_std(v).alias("std"))


def centered_ma(v, k) -> Column:
    """Centred moving mean of odd width k, cut at both ends."""
    half = F.floor(col(k) / 2).cast("int")

    def smooth(v: Column) -> Column:
        def around(x: Column, i: Column) -> Column:
            lo, hi = F.greatest(F.lit(0), i - half), F.least(F.size(v) - 1, i + half)
            return _sum(F.slice(v, lo + 1, hi - lo + 1)) / (hi - lo + 1)
        return F.transform(v, around)

    return let(col(v), smooth)


def smoothing_width(n: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(7), F.floor(n / 10).cast("int")))


def _first_max(v: Column, upto: Column) -> Column:
    """Zero-based index of the first maximum among the first ``upto`` values."""
    return let(F.slice(v, 1, upto), lambda head: (F.array_position(head, F.array_max(head)) - 1).cast("int"))


def search_head(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(3), F.floor(n * F.lit(0.2)).cast("int")))


def systole_ratio(arr, ibi) -> Column:
    """struct<systole, diastole>: from the smoothed peak in the first fifth to the lowest point before 80 %."""
    arr, ibi = col(arr), col(ibi)
    default = F.struct(F.lit(DEFAULT_SYSTOLE).alias("systole"), F.lit(2.0 / 3.0).alias("diastole"))

    def with_smooth(sm: Column) -> Column:
        n = F.size(sm)

        def with_peak(p: Column) -> Column:
            end = F.least(n - 1, F.floor(n * F.lit(0.8)).cast("int"))
            part = F.slice(sm, p + 1, end - p + 1)
            valley = let(part, lambda x: p + (F.array_position(x, F.array_min(x)) - 1).cast("int"))
            span = let(valley, lambda k: (F.get(arr, k)["t"] - F.get(arr, p)["t"]).cast("double"))

            def ratios(d: Column) -> Column:
                s, dd = (ibi - d) / ibi, d / ibi
                bad = (d < 0) | (d > ibi * 0.9) | (dd < 0.1) | (dd > 0.9) | (s < 0.1) | (s > 0.9)
                return F.when(bad, default).otherwise(F.struct(s.alias("systole"), dd.alias("diastole")))

            return let(span, ratios)

        return let(_first_max(sm, search_head(n)), with_peak)

    return F.when((F.size(arr) < 3) | (ibi <= 0), default).otherwise(
        let(centered_ma(values(arr), smoothing_width(F.size(arr))), with_smooth))


def resample(v, n: int = FIT_POINTS) -> Column:
    """Linear interpolation to n points, end points kept."""
    grid = F.sequence(F.lit(0), F.lit(n - 1))

    def spread(v: Column) -> Column:
        last = F.size(v) - 1

        def at(i: Column) -> Column:
            return let((i * last) / float(n - 1), lambda p: let(F.floor(p).cast("int"), lambda k: (
                F.get(v, k) * (F.lit(1.0) - (p - k)) + F.get(v, F.least(k + 1, last)) * (p - k))))

        return F.when(F.size(v) > 0, F.transform(grid, at)).otherwise(F.transform(grid, lambda i: F.lit(0.0)))

    return let(col(v), spread)


def _harmonic(v: Column) -> Column:
    """struct<a, b> of the first harmonic, angle 2 pi n / N."""
    n = F.size(v)
    part = lambda fn: _sum(F.transform(v, lambda x, i: x * fn(F.lit(TWO_PI) * i / n))) * 2.0 / n
    return F.struct(part(F.sin).alias("a"), part(F.cos).alias("b"))


def _fit(v: Column, mean: Column, ab: Column, with_rmse: bool) -> Column:
    amp = F.sqrt(ab["a"] * ab["a"] + ab["b"] * ab["b"])
    small = amp < TINY
    raw = F.atan2(ab["b"], ab["a"])
    phi = F.when(raw < 0, raw + F.lit(TWO_PI)).otherwise(raw)
    n = F.size(v)
    err = lambda x, i: let(F.lit(TWO_PI) * i / n, lambda g: x - (
        mean + ab["a"] * F.sin(g) + ab["b"] * F.cos(g)))
    rmse = F.sqrt(_sum(F.transform(v, lambda x, i: let(err(x, i), lambda d: d * d))) / n)
    zero = F.lit(0.0)
    fields = [mean.alias("mean"), ab["a"].alias("a"), ab["b"].alias("b"), F.when(small, zero).otherwise(amp).alias("amp"),
              F.when(small, zero).otherwise(phi).alias("phi"),
              F.when(small, zero).otherwise(F.sin(phi)).alias("sin_phi"),
              F.when(small, F.lit(1.0)).otherwise(F.cos(phi)).alias("cos_phi")]
    if with_rmse:
        fields.append(F.when(small, zero).otherwise(rmse).alias("rmse"))
    return F.struct(*fields)


def sine_fit_raw(v) -> Column:
    """First harmonic of the mean-free samples: mean, a, b, amp, phi, sin_phi, cos_phi, rmse."""
    def fit(v: Column) -> Column:
        return let(array_mean(v), lambda m: let(let(F.transform(v, lambda x: x - m), _harmonic),
                                                lambda ab: _fit(v, m, ab, True)))
    return let(col(v), fit)


def sine_fit_resampled(v, n: int = FIT_POINTS) -> Column:
    """First harmonic of the resampled beat, mean kept in."""
    def fit(v: Column) -> Column:
        return let(array_mean(v), lambda m: let(let(resample(v, n), _harmonic), lambda ab: _fit(v, m, ab, False)))
    return let(col(v), fit)


def basis(phase, systole, diastole) -> Column:
    """Asymmetric cosine in 0..1 with the falling part of length ``diastole``; its top lies after 0 by pi/4."""
    phase, systole, diastole = col(phase), col(systole), col(diastole)
    pi = F.lit(math.pi)
    angle = F.when(phase <= diastole, phase * (F.lit(1.0) / diastole) * pi).otherwise(
        pi + (phase - diastole) * (F.lit(1.0) / systole) * pi)
    return (F.cos(angle + F.lit(PHASE_SHIFT)) + 1.0) / 2.0


def ideal_curve(position, mean, amp, systole, diastole) -> Column:
    return col(mean) + col(amp) * basis(position, systole, diastole)


def distortion(v, amp, systole, diastole) -> Column:
    """RMS distance of the samples from mean + amp * basis; 0 for a flat fit."""
    amp = col(amp)

    def rms(v: Column) -> Column:
        n = F.size(v)
        return let(array_mean(v), lambda m: F.sqrt(_sum(F.transform(v, lambda x, i: let(
            x - ideal_curve(i.cast("double") / n, m, amp, systole, diastole), lambda d: d * d))) / n))

    return F.when(amp < TINY, 0.0).otherwise(let(col(v), rms))


def peak_phase(arr, ibi) -> Column:
    """Time of the raw maximum in the first fifth, wrapped into [0, ibi)."""
    arr, ibi = col(arr), col(ibi)
    first = let(values(arr), lambda v: _first_max(v, search_head(F.size(v))))
    at = F.get(arr, first)["t"] - F.get(arr, F.lit(0))["t"]
    return F.when(F.size(arr) < 3, 0.0).otherwise(F.pmod(at.cast("double"), ibi))


def phase_offset(peak_time, ibi) -> Column:
    return F.pmod(-col(peak_time), col(ibi))


def array_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays; null when one is constant."""
    def bound(r: Column) -> Column:
        return _corr(r["x"], r["y"])

    return let(F.struct(a.alias("x"), b.alias("y")), bound)


def _corr(a: Column, b: Column) -> Column:
    def with_means(m: Column) -> Column:
        s = lambda f: _sum(F.zip_with(a, b, f))
        cov = s(lambda x, y: (x - m["a"]) * (y - m["b"]))
        va, vb = s(lambda x, y: (x - m["a"]) * (x - m["a"])), s(lambda x, y: (y - m["b"]) * (y - m["b"]))
        return let(va * vb, lambda d: F.when(d > 0, cov / F.sqrt(d)))

    return let(F.struct(array_mean(a).alias("a"), array_mean(b).alias("b")), with_means)
