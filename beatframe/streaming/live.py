"""Live feeds: per-session detector state over micro-batches, snapshots, throttled state, session ends.

A micro-batch bounds what one task sees of a session (limit the source with ``maxOffsetsPerTrigger`` or
``maxFilesPerTrigger``); between batches 64 raw values, a few scalars and the frames ahead of the watermark are kept per session.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.quality import MIN_ISO
from ..functions.scalars import FPS
from ..operators.chunks import KEY, ensure_checkpoint_dir
from ..operators.conditioning import MIN_PROMINENCE, PROMINENCE_SHARE, RANGE_ROWS, REACH, WARM_UP
from ..operators.detect import BPM_HISTORY, MAX_INTERVAL_S, MIN_INTERVAL_S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

FEED = {"_us": "int64", "_tie": "int64", "_t": "int64", "green_raw": "float64", "iso": "int64"}
STATE = ("n bigint, g bigint, last_us bigint, raw array<double>, pos bigint, late int, t bigint, ibi double, "
         "smoothed double, last_ibi double, bpm double, history array<double>, passed_ms bigint, "
         "held_us array<bigint>, held_tie array<bigint>, held_t array<bigint>, held_raw array<double>, held_iso array<int>")
START = (0, 0, -(2**62), [], -8, 1, -1, 0.0, 0.0, 0.0, 0.0, [])
OUT = ("frame_idx bigint, gidx bigint, t_peak bigint, interval_ms double, ibi_ms double, bpm double, bpm_sd double, "
       "smoothed_before double, smoothed_ibi_ms double")


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(min(k, len(x))), x[: max(0, len(x) - k)]])


def _rolling(x: np.ndarray, n: int, fn, fill: float) -> np.ndarray:
    padded = np.concatenate([np.full(n - 1, fill), x])
    return fn(np.lib.stride_tricks.sliding_window_view(padded, n), axis=1)


def _ring(raw: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Conditioned values of consecutive frames, in the same order of operations as the batch windows."""
    c = (raw % 30) / 30.0 * 100.0 * 3.0
    ready = idx >= WARM_UP - 1
    m1 = c.copy()
    for k in range(1, 6):
        m1 = m1 + _shift(c, k)
    m1 = np.where(ready, m1 / 6.0, 0.0)
    m2 = m1.copy()
    for k in range(1, 4):
        m2 = m2 + _shift(m1, k)
    m2 = m2 / np.maximum(1, np.minimum(4, idx - (WARM_UP - 2)))
    lo = _rolling(np.where(ready, m1, np.inf), RANGE_ROWS, np.min, np.inf)
    hi = _rolling(np.where(ready, m1, -np.inf), RANGE_ROWS, np.max, -np.inf)
    with np.errstate(invalid="ignore"):
        level = (m2 - lo) / np.maximum(hi - lo, 1.0) * 10.0
    return np.where(ready, np.clip(level, 0.0, 10.0), 0.0)


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _candidates(r: np.ndarray, t_ms: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Positions (from ``first`` on) and interpolated times of peak candidates."""
    r1, r2, r3, r4 = (_shift(r, k) for k in (1, 2, 3, 4))
    lo = _rolling(_shift(r, 1), 12, np.min, 0.0)
    hi = _rolling(_shift(r, 1), 12, np.max, 0.0)
    need = np.maximum(MIN_PROMINENCE, (hi - lo) * PROMINENCE_SHARE)
    hit = (r1 > r2) & (r2 > r3) & (r3 > r4) & (r1 > r) & (r1 - lo >= need)
    frame = 1000.0 / FPS
    for i in np.nonzero(hit)[0]:
        if i < first:
            continue
        bend = r2[i] - r1[i] * 2.0 + r[i]
        shift = (r2[i] - r[i]) * 0.5 / bend if abs(bend) > 1e-9 else 0.0
        yield int(i), _half_up(_half_up(t_ms[i] - frame) + max(-0.5, min(0.5, shift)) * frame)


def _advance(key: tuple, s: tuple, feed: dict[str, np.ndarray], clocked: bool) -> tuple[tuple, list[tuple]]:
    """Detector state after consecutive frames in order, and the beats they close."""
    n, g, tail, fresh = s[0], s[1], np.array(s[3], dtype=float), len(feed["_us"])
    raw = np.concatenate([tail, feed["green_raw"]])
    idx = np.arange(n - len(tail), n + fresh)
    t_all = np.floor(idx * 1000 / FPS).astype("int64")
    if clocked:
        t_all[len(tail):] = feed["_t"]
    ok = np.concatenate([np.zeros(len(tail), bool), feed["iso"] >= MIN_ISO])
    gidx = g - 1 + np.cumsum(ok)
    pos, late, t, ibi, smoothed, last_ibi, bpm_now, hist = *s[4:11], list(s[11])
    rows = []
    for i, t_peak in _candidates(_ring(raw, idx), t_all, len(tail)):
        if not ok[i]:
            continue
        wait = 8 if smoothed <= 0 else max(8, min(24, _half_up(smoothed * 0.58 / (1000.0 / FPS))))
        if gidx[i] - pos - 1 + late < wait:
            continue
        interval = (t_peak - t) / 1000.0
        if t >= 0 and MIN_INTERVAL_S <= interval <= MAX_INTERVAL_S:
            bpm = 60.0 / interval
            hist = (hist + [bpm])[-BPM_HISTORY:]
            mean = sum(hist) / len(hist)
            sd = math.sqrt(sum((v - mean) * (v - mean) for v in hist) / len(hist))
            near = mean - mean * 0.1 <= bpm <= mean + mean * 0.1
            ibi = 60.0 / bpm * 1000.0 if near else interval * 1000.0
            bpm_now = bpm if near else bpm_now
            before = smoothed
            smoothed = smoothed if ibi == last_ibi else (smoothed + ibi) / 2.0
            last_ibi, late = ibi, 0
            rows.append((*key, int(idx[i]), int(gidx[i]), t_peak, interval * 1000.0, ibi, bpm_now, sd, before, smoothed))
        else:
            late = 1
        pos, t = int(gidx[i]), t_peak
    return (n + fresh, int(gidx[-1]) + 1, int(feed["_us"][-1]), raw[-REACH:].tolist(), pos, late, t, ibi,
            smoothed, last_ibi, bpm_now, hist), rows


def _stepper(idle_us: int, clocked: bool):
    """State step: frames are held until the watermark passes them, so they are always processed in time order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = tuple(state.get) if state.exists else None
        s, passed = (saved[:12], saved[12]) if saved else (START, -(2**62))
        held = saved[13:] if saved else [[]] * len(FEED)
        parts = [b for b in batches if len(b)]
        feed = {c: np.concatenate([np.array(h, dtype=kind), *[b[c].to_numpy(dtype=kind) for b in parts]])
                for (c, kind), h in zip(FEED.items(), held)}
        mark = state.getCurrentWatermarkMs()
        # rows without a value only move the watermark; rows behind the released point are late
        order = np.lexsort((feed["_tie"], feed["_us"]))
        order = order[~np.isnan(feed["green_raw"][order]) & (feed["_us"][order] > passed * 1000)]
        feed = {c: v[order] for c, v in feed.items()}
        us = feed["_us"]
        ready, rows = int(np.searchsorted(us, mark * 1000, side="right")), []
        if ready:
            gaps = np.diff(us[:ready], prepend=us[0] if s[0] == 0 else s[2])
            for part in np.split(np.arange(ready), np.flatnonzero(gaps > idle_us)):
                if len(part):
                    s, beats = _advance(key, START if gaps[part[0]] > idle_us else s,
                                        {c: v[part[0]:part[-1] + 1] for c, v in feed.items()}, clocked)
                    rows += beats
        waiting = len(us) > ready
        if waiting:
            due = -(-int(us[ready]) // 1000) - 1
        else:
            due = (s[2] + idle_us) // 1000
        if not waiting and (s[0] == 0 or due <= mark):
            if state.exists:
                state.remove()
        else:
            state.update((*s, max(passed, mark), *(v[ready:].tolist() for v in feed.values())))
            state.setTimeoutTimestamp(max(mark + 1, due))
        if rows:
            yield pd.DataFrame(rows, columns=[KEY, *[c.split()[0] for c in OUT.split(", ")]])
    return step


def stream_beats(stream: DataFrame, ts: str = "ts", tie: str | None = None, watermark: str = "10 seconds", clock: str = "t_ms",
                 idle: float = 1800.0) -> DataFrame:
    """Frames of many sessions in, beats out (append).  Needs session_id, green_raw and an event time column.

    The frame clock is the column ``clock`` in ms; without such a column frames count as taken at the fixed rate.

    Frames wait in the state until the watermark passes them and are then processed in the order of event time, so
    any order within the watermark gives the same beats; only frames behind it are lost.  Frames are numbered per
    session; dark frames count for the conditioning but never reach the detector.  Rows whose green_raw is null are no
    frames, they only move the watermark (keep-alives of a quiet feed).  A session that is silent for ``idle`` seconds of event
    time leaves the state; frames after such a gap start it anew.  Without such a gap equal to ``detect_beats``.
    """
    d = stream.withWatermark(ts, watermark)
    iso = F.coalesce(F.col("iso"), F.lit(0)) if "iso" in stream.columns else F.lit(600)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    clocked = clock in stream.columns
    d = d.select(KEY, ts, us.alias("_us"), F.coalesce(F.col(tie) if tie else F.lit(0), F.lit(0)).cast("bigint").alias("_tie"),
                 F.coalesce(F.col(clock) if clocked else F.lit(-1), F.lit(-1)).cast("bigint").alias("_t"),
                 F.col("green_raw").cast("double").alias("green_raw"), iso.cast("int").alias("iso"))
    kind = stream.schema[KEY].dataType.simpleString()
    return d.groupBy(KEY).applyInPandasWithState(
        _stepper(int(idle * 1_000_000), clocked), f"{KEY} {kind}, {OUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_state(stream: DataFrame, every: str = "100 milliseconds", ts: str = "ts", cols=("green_raw",),
                 watermark: str = "10 seconds") -> DataFrame:
    """Last value per session and tumbling window."""
    d = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    return d.groupBy(KEY, F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.max_by(c, ts).alias(c) for c in cols]).select(
        KEY, F.col("w.start").alias("start"), "n", *cols)


def finish_sessions(stream: DataFrame, timeout: str = "30 seconds", ts: str = "ts", watermark: str = "10 seconds"
                    ) -> DataFrame:
    """One row per session once no frame arrived for ``timeout``."""
    d = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    return d.groupBy(KEY, F.session_window(ts, timeout).alias("w")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.max_by("green_raw", ts).alias("last_green")).select(
        KEY, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_frames", "last_green")


SAVE_BUCKETS = 64


def autosave(beats: DataFrame, path: str, checkpoint: str, every: int = 60, buckets: int = SAVE_BUCKETS):
    """Keep a table of all beats and rewrite the snapshot of a session each time it passes a multiple of ``every``.

    Beats are partitioned by a bucket of the session and the batch.  Counts per session go on from the counts of the batch before, and only
    the buckets of sessions that are due are read.  Batches run one after another, so one save is in flight; a repeated
    batch overwrites its own part and its own counts.
    """
    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")).withColumn("batch", F.lit(epoch).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/beats")
        kind = StructType([batch.schema[KEY], StructField("bucket", IntegerType()), StructField("n", LongType())])
        before = spark.read.schema(kind).parquet(f"{path}/counts/{epoch - 1}") if epoch else spark.createDataFrame([], kind)
        fresh = rows.groupBy(KEY, "bucket").agg(F.count(F.lit(1)).alias("new"))
        now = before.join(fresh, [KEY, "bucket"], "full").select(KEY, "bucket", F.coalesce("n", F.lit(0)).alias("old"),
                                                                 (F.coalesce("n", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("n"))
        now.write.mode("overwrite").parquet(f"{path}/counts/{epoch}")
        counted = spark.read.parquet(f"{path}/counts/{epoch}")
        due = counted.where(F.floor(F.col("n") / every) > F.floor(F.col("old") / every)).select(KEY, "bucket")
        full = due.select("bucket").distinct().collect()  # at most ``buckets`` numbers
        if full:
            held = spark.read.parquet(f"{path}/beats").where(F.col("bucket").isin([r.bucket for r in full]) & (F.col("batch") <= epoch))
            held.join(due.select(KEY), KEY, "left_semi").drop("bucket", "batch").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(f"{path}/snapshot")

    return beats.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that is available into a new table of the shared checkpoint folder and read it back."""
    spark: SparkSession = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
