"""Typed live state: scored beats as in batch, closing records, table commits."""

import pytest
from pyspark.sql import functions as F

from beatframe.operators.chunks import cut
from beatframe.plans import session as plan
from beatframe.streaming import live, sessions
from test_live import stream_of


def plain(d):
    cols = ["beat_index", "frame_idx", "gidx", "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd"]
    out = [F.col(c) for c in cols]
    for m in ("M1", "M2", "M3"):
        out += [F.col(f"{m}.{f}").alias(f"{m}_{f}") for f in ("sbp", "dbp", "output_valid", "reject_reason", "feature_clamp_reason", "used", "map_terms")]
    for k in ("e_only", "e2", "local_a"):
        out += [F.col(f"{k}.{f}").alias(f"{k}_{f}") for f in ("sbp", "dbp", "reject_reason", "e_used")]

    def near(v):
        return [near(x) for x in v] if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v
    return [tuple(near(x) for x in r) for r in d.select(*out).orderBy("beat_index").collect()]


def noisy(wave, name="step_hr", n=600):
    """A wave with a second bump, dark frames and some noise, so that every branch of the scores is met."""
    i = F.col("frame_idx")
    shape = F.sin(i * 0.9) * 0.4 + F.sin(i * 0.05) * 0.8 + F.pmod(i * 7919, F.lit(101)) / 400.0
    return wave(name, n).withColumn("green_raw", F.col("green_raw") + 10 + shape).withColumn("iso", F.when(i.between(200, 207), 100).otherwise(400))


@pytest.fixture(scope="module")
def batch(spark, wave):
    frames = noisy(wave)
    return frames, plain(cut(plan.scored_beats(plan.analyse(frames))))


@pytest.mark.parametrize("parts,shuffle,swap", [(6, True, 60), (14, False, 0)])
def test_scores_equal_batch(spark, batch, tmp_path, parts, shuffle, swap):
    sessions.use_typed_state(spark)
    frames, want = batch
    s = sessions.stream_sessions(stream_of(spark, frames, str(tmp_path / "in"), parts, shuffle, swap))
    rows = live.run_available(s)
    got = plain(sessions.score_rows(rows))
    assert len(want) > 10 and got == want
    reasons = {r[i] for r in want for i in (11, 18, 25)}
    assert len(reasons) > 2
    end = sessions.session_ends(rows).collect()
    assert len(end) == 1 and end[0].n_frames == 600 and end[0].n_rows == len(want)


def test_tables_are_committed_once(spark, wave, tmp_path, monkeypatch):
    from beatframe.streaming import commits

    # the wide rows are the batch plan's own; three columns of them are enough to follow the commits
    monkeypatch.setattr(commits, "training_rows", lambda d: d.select("session_id", "beat_index", F.col("M1.reject_reason").alias("M1_reject_reason")))

    sessions.use_typed_state(spark)
    frames = noisy(wave, "sine75", 420)
    s = sessions.stream_sessions(stream_of(spark, frames, str(tmp_path / "in"), 3), idle=60.0, watermark="1 seconds")
    out, calls = str(tmp_path / "out"), []

    def save(batch, epoch):
        """The second batch is broken off before its commit and written again; the one that ends the recording is written twice."""
        kept = spark.createDataFrame(batch.collect(), batch.schema)
        if len(calls) == 1:
            write = commits._write

            def broken(df, path, name, number):
                if name == "commits":
                    raise OSError("lost")
                write(df, path, name, number)
            commits._write = broken
            with pytest.raises(OSError):
                commits.save_batch(kept, epoch, out, every=8)
            commits._write = write
            assert {r["epoch"] for r in commits.read_committed(spark, out, "rows").select("epoch").distinct().collect()} <= set(calls)
        commits.save_batch(kept, epoch, out, every=8, tables=("training", "ibi", "method_M1"))
        if not kept.where("kind = 'end'").isEmpty():
            commits.save_batch(kept, epoch, out, every=8, tables=("ibi",))
        calls.append(epoch)
    s.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    want = cut(plan.scored_beats(plan.analyse(frames)))
    assert plain(commits.read_beats(spark, out)) == plain(want)
    whole = want.select("beat_index", F.col("M1.reject_reason").alias("M1_reject_reason")).orderBy("beat_index").collect()
    assert commits.read_committed(spark, out, "training").select("beat_index", "M1_reject_reason").orderBy("beat_index").collect() == whole
    for name in ("ibi", "method_M1"):
        assert commits.read_committed(spark, out, name).count() == len(whole)
    assert commits.read_committed(spark, out, "ends").count() == 1
    snap = commits.read_snapshot(spark, out).orderBy("beat_index").collect()
    per_batch = {r["epoch"]: r["n"] for r in commits.read_committed(spark, out, "rows").where("kind = 'beat'").groupBy("epoch").agg(F.max("beat_index").alias("n")).collect()}
    due = [n for e, n in sorted(per_batch.items()) if n // 8 > max([m for k, m in per_batch.items() if k < e], default=0) // 8]
    assert due and [r["beat_index"] for r in snap] == list(range(1, due[-1] + 1))
    assert [r["M1_reject_reason"] for r in snap] == [r["M1_reject_reason"] for r in whole[:due[-1]]]


class FakeState:
    """State of one key that counts its calls."""

    def __init__(self):
        self.at, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"get": lambda: self.at.get(()), "update": lambda v: self.at.update({(): v}), "clear": lambda: self.at.clear(), "keys": lambda: iter(list(self.at)),
                    "getValue": lambda k: self.at.get(k), "updateValue": lambda k, v: self.at.update({k: v}), "removeKey": lambda k: self.at.pop(k)}[name](*args)
        return call


class FakeHandle:
    def __init__(self):
        self.states, self.timers = [], set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, *_):
        self.states.append(FakeState())
        return self.states[-1]

    def getMapState(self, *_):
        return self.getValueState()


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def fed(span_s, order, marks):
    """Rows of frames that lie an hour apart, fed in three batches, and the calls of the state store."""
    import numpy as np
    import pandas as pd

    n, hour = 360, 3_600_000_000
    i = np.arange(n)
    frames = pd.DataFrame({"at_us": i * hour, "tie_rank": 0, "at_ms": -1, "green_raw": 5 + 4 * np.cos(2 * np.pi * i / 30), "iso_now": 600})
    step, handle = sessions.SessionProcessor(10**15, False, "session_id", span_s * 1_000_000), FakeHandle()
    step.init(handle)
    out = []
    for part, mark in zip(np.array_split(np.array(order(i)), len(marks)), marks):
        out += step.handleInputRows(("a",), iter([frames.iloc[part]]), Mark(mark))
    out += step.handleExpiredTimer(("a",), Mark(n * 3_600_000 + 10**12 + 1), None)
    rows = [tuple(r) for d in out for r in d[["kind", "frame_idx", "ibi_ms", "smoothed_ibi_ms", "n_frames"]].astype(object).where(lambda x: x.notna(), None).values]
    assert not any(s.at for s in handle.states) or handle.timers
    return rows, sum(s.calls for s in handle.states)


def test_sparse_frames_cost_few_state_calls():
    """A frame an hour is kept by spans of the watermark's delay, not one by one; the rows are those of a second a span."""
    hour = 3_600_000
    marks = [0, 100 * hour + 1, 220 * hour + 1]  # inside a span
    want, many = fed(1, lambda i: i, marks)
    got, few = fed(15 * 3600, lambda i: i, marks)
    assert got == want and len(got) == 3 and got[-1][0] == "end" and got[-1][4] == 360
    assert few < 150 < many


def test_state_step_needs_no_package():
    """What the workers get holds no reference to a module of the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    data = cloudpickle.dumps(sessions.SessionProcessor(1, False, "session_id"))
    code = "import sys; from pyspark import cloudpickle; p = cloudpickle.loads(sys.stdin.buffer.read()); print(p.span_us, 'beatframe' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd="/")
    assert out.stdout.split() == [b"1000000", b"False"], out.stderr


def test_only_asked_methods_are_scored(spark):
    """Tables that hold one method plan and score that one, with the rows of the whole plan."""
    from beatframe.streaming import commits

    rows = spark.createDataFrame([], f"session_id string, {sessions.OUT}")
    whole, one = commits.scored_for(("training",), rows), commits.scored_for(("ibi", "method_M1"), rows)
    assert {"M1", "M2", "M3", "e2"} <= set(whole.columns) and "M2" not in one.columns and one.schema["M1"].dataType == whole.schema["M1"].dataType
    text = one._jdf.queryExecution().analyzed().toString()
    assert "d_in" not in text.split("LogicalRDD")[0].split("LocalRelation")[0] and len(text) < len(whole._jdf.queryExecution().analyzed().toString()) / 4
