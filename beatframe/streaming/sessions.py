"""Live sessions in typed state: frames in, scored beats and one closing record per recording out.

Only decisions that depend on earlier ones are taken in the state step: peaks, intervals, valley/peak pairs and sine-path beats.  What a beat
needs for its scores leaves the state with it, and features, models and variants are the Column functions of the batch plan.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.quality import MIN_ISO
from ..functions.scalars import FPS
from ..functions.waves import FIT_POINTS, TINY, TWO_PI
from ..operators import beats as bt
from ..operators.beats import BUFFER, PATHS, REFRACTORY_MAX_MS, REFRACTORY_MS, REFRACTORY_SHARE
from ..operators.chunks import KEY
from ..operators.conditioning import MIN_PROMINENCE, PROMINENCE_SHARE, WARM_UP
from ..operators.detect import BPM_HISTORY, DEBOUNCE_MS, MAX_INTERVAL_S, MIN_INTERVAL_S, MORPHOLOGY, RING, STEP_MS
from ..plans import session as plan
from .live import _candidates, _half_up, _ring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package: the state step uses no module of it

METHODS = ("M1", "M2", "M3")
TAIL = 128  # raw frames kept: 30 to condition, 54 to search
FRAME_MS = 1000.0 / FPS
MORPH = ", ".join(f"{c} double" for c in MORPHOLOGY)
M1_IN = f"frame_idx bigint, interval_ms double, smoothed_before double, {MORPH}"
SINE_IN = f"frame_idx bigint, start_t bigint, end_t bigint, smoothed double, valid_ibi double, fit_ibi double, ts array<bigint>, vs array<double>, {MORPH}"
OUT = ("kind string, started_us bigint, beat_index bigint, frame_idx bigint, gidx bigint, t_ms bigint, ibi_ms double, smoothed_ibi_ms double, bpm double, bpm_sd double, "
       f"iso int, m1_in struct<{M1_IN}>, d_in struct<{SINE_IN}>, m_in struct<{SINE_IN}>, n_frames bigint, n_gated bigint, n_beats bigint, ended_us bigint")
OUT_NAMES = ["kind", "started_us", "beat_index", "frame_idx", "gidx", "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd", "iso", "m1_in", "d_in", "m_in", "n_frames", "n_gated",
             "n_beats", "ended_us"]
CORE = ("n bigint, g bigint, first_us bigint, last_us bigint, pos bigint, late int, t bigint, ibi double, smoothed double, last_ibi double, bpm double, sd double, "
        "history array<double>, rows bigint, row_ibi double, beats bigint")
STATES = {  # name -> (key of a map, value); a recording is one value, as each call of the state store is a message to the JVM
    "clock": (None, "passed_ms bigint, timer_ms bigint"),
    "recording": (None, f"core struct<{CORE}>, morph struct<v_amp double, v_dt bigint, p_amp double, p_dt bigint, {MORPH}>, scored struct<{M1_IN}>, "
                        "pairs map<string, struct<t bigint, amp double, gap bigint>>, sine map<string, struct<last bigint, prev bigint, valid_ibi double, fit_ibi double>>, "
                        f"done map<string, struct<{SINE_IN}>>, tail_raw array<double>, tail_t array<bigint>, tail_ok array<boolean>, "
                        "sample_gidx array<bigint>, sample_t array<bigint>, sample_v array<double>"),
    "held": ("span bigint", "us array<bigint>, tie array<bigint>, t array<bigint>, raw array<double>, iso array<int>"),
}
SPANS = 8  # parts of the watermark's delay that held frames are kept by, a second at least


#: Columns of the state step's input (no leading underscores: they are fields of a tuple there) and their types.
FEED = {"at_us": "int64", "tie_rank": "int64", "at_ms": "int64", "green_raw": "float64", "iso_now": "int64"}


@dataclass
class Recording:
    """Everything the detector remembers of one recording; the fields are the state variables."""
    core: list = field(default_factory=lambda: [0, 0, 0, 0, -8, 1, -1, 0.0, 0.0, 0.0, 0.0, 0.0, [], 0, None, 0])
    morph: list = field(default_factory=lambda: [None, None, None, None, 0.0, 0.0, 0.0, 0.0, 0.0])
    scored: tuple | None = None
    pairs: dict = field(default_factory=dict)
    sine: dict = field(default_factory=dict)
    done: dict = field(default_factory=dict)
    tail: list = field(default_factory=list)
    samples: list = field(default_factory=list)


def _best(points: list, f: int, lo: int, hi: int, sign: int):
    """Lowest (sign 1) or highest (-1) turning point between ``lo`` and ``hi`` frames back, the nearest of equals: value, distance, slot."""
    near = [(v * sign, f - i, v) for i, v in points if lo <= f - i < hi]
    if not near:
        return None
    _, pos, v = min(near)
    return v, pos, (f - pos - (WARM_UP - 1)) % RING


def _pair(kind: str, low, high, ibi: float):
    """Size, time and ring distance of a valid valley/peak pair, else None."""
    if low is None or high is None:
        return None
    rise, dt, gap = high[0] - low[0], abs(low[1] - high[1]) * STEP_MS, abs(low[2] - high[2])
    if kind == "v2p":
        ok = dt <= ibi * 5 and gap <= 150 and high[0] > low[0] - 1.0 and dt >= ibi * 0.125
    else:
        ok = dt <= ibi * 4 and gap <= 120 and high[0] > low[0] - 0.5 and dt <= ibi * 0.875
    return (abs(rise), dt, gap) if ok and abs(rise) > 0.1 and dt >= 10 and gap >= 3 else None


def _search(r: Recording, f: int, t: int, ibi: float, lows: list, highs: list) -> None:
    """Valley/peak search of one frame, debounced; a kept pair renews the morphology."""
    n = min(_half_up(ibi / FRAME_MS) + 10, RING - 5)
    half, last = n // 2, n - 2
    found = {"v2p": _pair("v2p", _best(lows, f, 2, half, 1), _best(highs, f, half, last, -1), ibi),
             "p2v": _pair("p2v", _best(lows, f, half + 2, last, 1), _best(highs, f, 2, half - 2, -1), ibi)}
    kept = False
    for k, (kind, p) in enumerate(found.items()):
        old = r.pairs.get(kind)
        if p is None or (old and (t - old[0] <= DEBOUNCE_MS or (abs(old[1] - p[0]) < 0.01 and old[2] == p[2]))):
            continue
        r.pairs[kind] = (t, p[0], p[2])
        r.morph[2 * k:2 * k + 2] = p[0], p[1]
        kept = True
    if kept:
        a, v_dt, b, p_dt = r.morph[:4]
        a, b = a or 0.0, b or 0.0
        rel = [0.0 if dt is None else -min(0.95, dt / ibi) for dt in (v_dt, p_dt)]
        r.morph[4:] = a, b, *rel, a / (a + b) * 100.0


def _fit(v: np.ndarray, points: int | None) -> tuple[float, float]:
    """Amplitude and RMS error of the first harmonic: of the mean-free samples, or of ``points`` interpolated ones (no error)."""
    m = v.mean()
    if points:
        p = np.arange(points) * (len(v) - 1) / (points - 1.0)
        k = np.floor(p).astype(int)
        x = v[k] * (1.0 - (p - k)) + v[np.minimum(k + 1, len(v) - 1)] * (p - k)
    else:
        x = v - m
    g = TWO_PI * np.arange(len(x)) / len(x)
    a, b = (x * np.sin(g)).sum() * 2.0 / len(x), (x * np.cos(g)).sum() * 2.0 / len(x)
    amp = math.sqrt(a * a + b * b)
    if amp < TINY:
        return 0.0, 0.0
    return amp, 0.0 if points else math.sqrt(((x - a * np.sin(g) - b * np.cos(g)) ** 2).mean())


def _stable(v: np.ndarray, ibi: float) -> bool:
    """Stability of a beat window: sample count, range and spread."""
    expected = ibi * FPS / 1000.0
    return (len(v) >= 8 and ibi > 0 and max(6.0, expected * 0.30) <= len(v) <= max(16.0, expected * 2.5) and v.max() - v.min() >= 0.35 and v.std() >= 0.08)


def _reference(*known: float) -> float:
    return next((x for x in known if x > 0), 0.0)


def _sine_step(r: Recording, path: str, f: int, t: int, t_peak: int, smoothed: float) -> None:
    """Accept a sine-path peak and remember the beat it completes."""
    last, prev, valid, fit = r.sine.get(path, (None, None, 0.0, 0.0))
    ref = _reference(smoothed, valid, fit)
    wait = REFRACTORY_MS if ref <= 0 else max(REFRACTORY_MS, min(REFRACTORY_MAX_MS, _half_up(ref * REFRACTORY_SHARE)))
    if last is not None and t - last < wait:
        return
    inside = [(s[1], s[2]) for s in r.samples if last is not None and prev <= s[1] <= last]
    r.done[path] = (f, prev, last, smoothed, valid, fit, [a for a, _ in inside] or None, [b for _, b in inside] or None, *r.morph[4:])
    if smoothed <= 0 and last is not None and last > prev and inside:  # before the frame path knows an interval
        v, ibi = np.array([b for _, b in inside]), float(last - prev)
        if _stable(v, ibi):
            amp, rmse = _fit(v, None if path == "M" else FIT_POINTS)
            fit = ibi if amp >= TINY else fit
            ref = _reference(smoothed, valid, fit)
            steady = 300 <= ibi <= 1500 and 0.5 <= amp <= 50 and not (ref > 0 and abs(ibi - ref) / ref > 0.3)
            if steady and (path == "D" or rmse <= 1.0):
                valid = ibi
    r.sine[path] = (t_peak, t_peak if last is None else last, valid, fit)


def _strict_peak(samples: list) -> int | None:
    """Time of a seven-point maximum three samples back, if there is one."""
    if len(samples) < 7:
        return None
    v = [s[2] for s in samples[-10:]]
    c, lo, hi = v[-4], min(v), max(v)
    if not all(x < c for i, x in enumerate(v[-7:]) if i != 3) or c - lo < max(MIN_PROMINENCE, (hi - lo) * PROMINENCE_SHARE):
        return None
    t, centre = samples[-1][1], samples[-4][1]
    base = centre if abs(centre - t) <= FRAME_MS * 4.0 else _half_up(t - 3.0 * FRAME_MS)
    bend = v[-5] - c * 2.0 + v[-3]
    shift = (v[-5] - v[-3]) * 0.5 / bend if abs(bend) > 1e-9 else 0.0
    return _half_up(base + max(-0.5, min(0.5, shift)) * FRAME_MS)


def advance(r: Recording, us: np.ndarray, t_ms: np.ndarray, raw: np.ndarray, iso: np.ndarray) -> list[tuple]:
    """Consecutive frames of a recording in order; returns its new beat rows."""
    n, g, first_us, _, pos, late, t, ibi, smoothed, last_ibi, bpm, sd, hist, rows, row_ibi, beats = r.core
    k = len(r.tail)
    raw = np.concatenate([np.array([x[0] for x in r.tail], float), raw])
    t_all = np.concatenate([np.array([x[1] for x in r.tail], np.int64), t_ms])
    ok = np.concatenate([np.array([x[2] for x in r.tail], bool), iso >= MIN_ISO])
    idx = np.arange(n - k, n + len(us))
    ring = _ring(raw, idx)
    green = np.where(idx >= WARM_UP - 1, ring, (raw % 30) / 30.0 * 100.0 * 3.0)
    before, after = np.concatenate([[0.0], ring[:-1]]), np.concatenate([ring[1:], [np.nan]])
    turn = {s: [(int(idx[i]), float(ring[i])) for i in np.flatnonzero((s * ring < s * before) & (s * ring < s * after))] for s in (1, -1)}
    peaks, out, at = dict(_candidates(ring, t_all, k)), [], {1: 0, -1: 0}
    for i in range(k, len(raw)):
        if not ok[i]:
            continue
        f, g, now, held, is_beat = int(idx[i]), g + 1, int(t_all[i]), smoothed, False
        if i in peaks:
            wait = 8 if smoothed <= 0 else max(8, min(24, _half_up(smoothed * 0.58 / FRAME_MS)))
            if g - 1 - pos - 1 + late >= wait:
                gap = (peaks[i] - t) / 1000.0
                is_beat = t >= 0 and MIN_INTERVAL_S <= gap <= MAX_INTERVAL_S
                if is_beat:
                    rate = 60.0 / gap
                    hist = (hist + [rate])[-BPM_HISTORY:]
                    mean = sum(hist) / len(hist)
                    sd = math.sqrt(sum((v - mean) * (v - mean) for v in hist) / len(hist))
                    near = mean - mean * 0.1 <= rate <= mean + mean * 0.1
                    ibi = 60.0 / rate * 1000.0 if near else gap * 1000.0
                    bpm = rate if near else bpm
                    smoothed = smoothed if ibi == last_ibi else (smoothed + ibi) / 2.0
                    last_ibi, beats = ibi, beats + 1
                    r.scored = (f, gap * 1000.0, held, *r.morph[4:])
                late, pos, t = int(not is_beat), g - 1, peaks[i]
        r.samples.append((g - 1, now, float(green[i])))
        del r.samples[:-BUFFER]
        top = _strict_peak(r.samples)
        if top is not None:
            for path in PATHS:
                _sine_step(r, path, f, now, top, held)
        if not is_beat and ibi > 0:
            near = {}
            for s, points in turn.items():  # turning points that the search of this frame reaches
                while at[s] < len(points) and points[at[s]][0] < f - 54:
                    at[s] += 1
                near[s] = [p for p in points[at[s]:at[s] + 54] if p[0] <= f - 2]
            _search(r, f, now, ibi, near[1], near[-1])
        if row_ibi is None or ibi != row_ibi:
            rows, row_ibi = rows + 1, ibi
            out.append(("beat", first_us if n else int(us[0]), rows, f, g - 1, now, ibi, smoothed, bpm, sd, int(iso[i - k]), r.scored, r.done.get("D"), r.done.get("M"),
                        None, None, None, None))
    r.core = [n + len(us), g, first_us if n else int(us[0]), int(us[-1]), pos, late, t, ibi, smoothed, last_ibi, bpm, sd, hist, rows, row_ibi, beats]
    r.tail = list(zip(raw[-TAIL:].tolist(), t_all[-TAIL:].tolist(), ok[-TAIL:].tolist()))
    return out


def closing(r: Recording) -> tuple:
    """Record of a finished recording."""
    n, g, first_us, last_us, _, _, _, ibi, smoothed, _, bpm, sd, _, rows, _, beats = r.core
    return ("end", first_us, rows, n - 1, g - 1, None, ibi, smoothed, bpm, sd, None, None, None, None, n, g, beats, last_us)


class SessionProcessor(StatefulProcessor):
    """Holds frames until the watermark passes them, detects in time order, and closes a recording after ``idle_us`` without a frame.

    Held frames lie in a map by spans of ``span_us``, so a micro-batch writes only the spans it touches, few of them however far apart
    frames are; what the detector remembers is one bounded value.  One timer a session: the next frame to release, or the end of the recording.
    """

    def __init__(self, idle_us: int, clocked: bool, key_name: str, span_us: int = 1_000_000) -> None:
        self.idle_us, self.clocked, self.key_name, self.span_us = idle_us, clocked, key_name, span_us

    def init(self, handle) -> None:
        self.handle, self.var = handle, {}
        for name, (key, value) in STATES.items():
            self.var[name] = handle.getValueState(name, value) if key is None else handle.getMapState(name, key, value)

    def close(self) -> None:
        pass

    def _load(self) -> Recording | None:
        x = self.var["recording"].get()
        if x is None:
            return None
        core, morph, scored, pairs, sine, done, *rings = x
        plain = [{k: tuple(y) for k, y in m.items()} for m in (pairs, sine, done)]
        return Recording(list(core), list(morph), None if scored is None else tuple(scored), *plain, tail=list(zip(*rings[:3])), samples=list(zip(*rings[3:])))

    def _store(self, r: Recording) -> None:
        rings = [list(x) for rows in (r.tail, r.samples) for x in (zip(*rows) if rows else ((), (), ()))]
        self.var["recording"].update((tuple(r.core), tuple(r.morph), r.scored, r.pairs, r.sine, r.done, *rings))

    def _release(self, mark: int, clock: tuple | None, spans: list[int]) -> list[tuple]:
        """Frames up to the watermark, in order, through the detector; then the next timer.  ``spans``: those that hold frames, in order."""
        v, out = self.var, []
        passed, timer = clock or (-(2 ** 62), None)
        due, first = [s for s in spans if (s - 1) * self.span_us < mark * 1000], None
        r = r0 = self._load() if clock else None
        ready = 0
        if due:
            feed = [np.concatenate(x) for x in zip(*[[np.array(a, kind) for a, kind in zip(v["held"].getValue((s,)), FEED.values())] for s in due])]
            order = np.lexsort((feed[1], feed[0]))
            us, tie, t, raw, iso = (x[order] for x in feed)
            ready = int(np.searchsorted(us, mark * 1000, side="right"))
            if ready:
                gaps = np.diff(us[:ready], prepend=us[0] if r is None else r.core[3])
                for part in np.split(np.arange(ready), np.flatnonzero(gaps > self.idle_us)):
                    if not len(part):
                        continue
                    if r is not None and gaps[part[0]] > self.idle_us:
                        out.append(closing(r))
                        r = None
                    r = r or Recording()
                    at = t[part] if self.clocked else np.floor((r.core[0] + np.arange(len(part))) * 1000 / FPS).astype(np.int64)
                    out += advance(r, us[part], at, raw[part], iso[part])
                for s in due[:-1] if ready < len(us) else due:
                    v["held"].removeKey((s,))
                if ready < len(us):  # the watermark lies inside the last span
                    v["held"].updateValue((due[-1],), tuple(x[ready:].tolist() for x in (us, tie, t, raw, iso)))
            if ready < len(us):
                first = int(us[ready])
        later = spans[len(due):]
        if first is None and later:
            first = min(v["held"].getValue((later[0],))[0])
        if r is not None and first is None and (r.core[3] + self.idle_us) // 1000 <= mark:
            out.append(closing(r))
            r = None
        if r is not None and (r is not r0 or ready):
            self._store(r)
        elif r is None and r0 is not None:
            v["recording"].clear()
        due_ms = None
        if first is not None:
            due_ms = max(mark + 1, -(-int(first) // 1000))
        elif r is not None:
            due_ms = max(mark + 1, (r.core[3] + self.idle_us) // 1000)
        if due_ms != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due_ms is not None:
                self.handle.registerTimer(due_ms)
        if due_ms is None:
            v["clock"].clear()
        else:
            v["clock"].update((max(passed, mark), due_ms))
        return out

    def _rows(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            names = ["frame_idx", "interval_ms", "smoothed_before", *MORPHOLOGY], ["frame_idx", "start_t", "end_t", "smoothed", "valid_ibi", "fit_ibi", "ts", "vs", *MORPHOLOGY]
            cols = {c: [o[i] for o in out] for i, c in enumerate(OUT_NAMES)}
            for c in ("m1_in", "d_in", "m_in"):
                cols[c] = [None if x is None else dict(zip(names[c != "m1_in"], x)) for x in cols[c]]
            frame = pd.DataFrame({c: pd.Series(x, dtype="object") for c, x in cols.items()})
            frame.insert(0, self.key_name, [key[0]] * len(out))
            for c in ("beat_index", "frame_idx", "gidx", "t_ms", "n_frames", "n_gated", "n_beats", "ended_us", "started_us"):
                frame[c] = frame[c].astype("Int64")
            frame["iso"] = frame["iso"].astype("Int32")
            for c in ("ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd"):
                frame[c] = frame[c].astype(float)
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        v, mark = self.var, max(timerValues.getCurrentWatermarkInMs(), 0)
        clock = v["clock"].get()
        held = {k[0] for k in v["held"].keys()} if clock else set()
        for b in rows:
            us = b["at_us"].to_numpy(np.int64)
            use = ~np.isnan(b["green_raw"].to_numpy(float)) & (us > (clock[0] * 1000 if clock else -(2 ** 63)))  # rows without a value only move the watermark
            spans = -(-us // self.span_us)  # a span ends where its number says, so that it is released whole
            for s in np.unique(spans[use]).tolist():
                at = use & (spans == s)
                new = tuple(b[c].to_numpy(kind)[at].tolist() for c, kind in FEED.items())
                old = v["held"].getValue((s,)) if s in held else ([],) * len(new)
                v["held"].updateValue((s,), tuple(list(a) + x for a, x in zip(old, new)))
                held.add(s)
        yield from self._rows(key, self._release(mark, clock, sorted(held)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = self.var["clock"].get()
        spans = sorted(k[0] for k in self.var["held"].keys())
        yield from self._rows(key, self._release(timerValues.getCurrentWatermarkInMs(), (clock[0], None) if clock else None, spans))  # the timer that fired is gone


def stream_sessions(stream: DataFrame, ts: str = "ts", tie: str | None = None, watermark: str = "10 seconds", clock: str = "t_ms", idle: float = 1800.0) -> DataFrame:
    """Frames of many sessions in; rows of kind 'beat' (a beat with what its scores need) and 'end' (one per recording) out.

    Frames wait until the watermark passes them, so order inside the watermark does not matter; frames behind it are lost, and rows whose
    green_raw is null only move it.  A recording ends when its session is silent for ``idle`` seconds; the session's next frame starts a new
    one, which ``started_us`` tells apart.  Needs the RocksDB state store (``use_typed_state``).
    """
    d = stream.withWatermark(ts, watermark)
    clocked = clock in stream.columns
    iso = F.coalesce(F.col("iso"), F.lit(0)) if "iso" in stream.columns else F.lit(600)
    d = d.select(KEY, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.coalesce(F.col(tie) if tie else F.lit(0), F.lit(0)).cast("bigint").alias("tie_rank"),
                 F.coalesce(F.col(clock) if clocked else F.lit(-1), F.lit(-1)).cast("bigint").alias("at_ms"), F.col("green_raw").cast("double").alias("green_raw"),
                 iso.cast("int").alias("iso_now"))
    out = StructType([StructField(KEY, stream.schema[KEY].dataType), *_parse_datatype_string(OUT).fields])
    delay_us = stream.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{watermark}'"))).first()[0]
    step = SessionProcessor(int(idle * 1_000_000), clocked, KEY, max(1_000_000, delay_us // SPANS))
    return d.groupBy(KEY).transformWithStateInPandas(step, out, "append", "eventTime")


def use_typed_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def score_rows(rows: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Scores of streamed beat rows, by the functions of the batch plan; columns as ``plans.session.scored_beats`` plus ``started_us``.

    With fewer ``methods`` only these are planned and scored, and the variants, which need them all, are left out.
    """
    keep = [c for c in rows.columns if c not in ("kind", "m1_in", "d_in", "m_in", "n_frames", "n_gated", "n_beats", "ended_us")]
    feeds = {"M1": "m1_in", "M2": "d_in", "M3": "m_in"}
    d = rows.where("kind = 'beat'").select(*keep, *[feeds[k] for k in METHODS if k in methods])

    def spread(d: DataFrame, c: str, scored, row) -> DataFrame:
        """Fields of struct ``c`` as columns, scored, and folded back to one struct (null where there was none)."""
        base, fields = d.columns, [f for f in d.schema[c].dataType.names if f != "frame_idx"]
        x = scored(d.select(*base, *[F.col(f"{c}.{f}").alias(f) for f in fields]))
        name = {"m1_in": "m1_row", "d_in": "m2_row", "m_in": "m3_row"}[c]
        return x.select(*base, F.when(F.col(c).isNotNull(), row).alias(name)).drop(c)

    def sine(path: str, method: str):
        def scored(x: DataFrame) -> DataFrame:
            samples = F.arrays_zip(F.col("ts").alias("t"), F.col("vs").alias("v"))
            x = bt.beat_features(x.withColumn("samples", samples).withColumn("path", F.lit(path)))
            return plan.sine_scored(bt.judged(x), method)
        return scored
    if "M1" in methods:
        d = spread(d, "m1_in", plan.timing_scored, F.struct("M1", "hr", "v2p_amp", "v2p_rel", "p2v_rel", "ai"))
    if "M2" in methods:
        d = spread(d, "d_in", sine("D", "M2"), plan.sine_row("M2"))
    if "M3" in methods:
        d = spread(d, "m_in", sine("M", "M3"), plan.sine_row("M3"))
    if set(methods) >= set(METHODS):
        return plan.with_variants(d)
    return d.select("*", *[F.col(f"{k.lower()}_row")[k].alias(k) for k in METHODS if k in methods])


def session_ends(rows: DataFrame) -> DataFrame:
    """One closing record per recording."""
    return rows.where("kind = 'end'").select(KEY, "started_us", "ended_us", "n_frames", "n_gated", "n_beats", F.col("beat_index").alias("n_rows"),
                                             F.col("ibi_ms").alias("last_ibi_ms"), F.col("smoothed_ibi_ms").alias("last_smoothed_ms"), F.col("bpm").alias("last_bpm"))
