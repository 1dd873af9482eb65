"""Frames are shuffled by chunk, as seldom as the plans can do with, and never by their number."""

from pyspark.sql import functions as F

from beatframe.operators import chunks as ch, detect as det
from beatframe.operators.conditioning import signal


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_frame_state_joins_no_frames_by_number(spark, wave):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sig = ch.cut(det.gated_index(signal(wave("step_hr", 400))))
        peaks = ch.cut(det.accept_peaks(sig.where("is_cand")))
        states = det.frame_state(sig, peaks)
        assert "hashpartitioning(frame_idx" not in plan_of(states) and not any(
            "hashpartitioning(session_id" in x and "frame_idx" in x.split("hashpartitioning")[1] for x in plan_of(states).split("\n"))
        beats = {r.frame_idx: r for r in peaks.where("valid").collect()}
        assert len(beats) > 5
        last = None
        for r in states.orderBy("frame_idx").collect():
            now = beats.get(r.frame_idx)
            assert r.is_beat == (now is not None)
            assert r.smoothed_prev == (now.smoothed_before if now else last.smoothed_ibi_ms if last else 0.0)
            last = now or last
            assert (r.ibi_ms, r.smoothed_ibi_ms, r.bpm) == ((last.ibi_ms, last.smoothed_ibi_ms, last.bpm) if last else (0.0, 0.0, 0.0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_go_into_the_fold_where_they_are(spark, wave, monkeypatch):
    plans, stored = [], ch.cut
    monkeypatch.setattr(ch, "cut", lambda d: plans.append(plan_of(d)) or stored(d))
    sig = stored(signal(wave("sine75", 400))).withColumn("gidx", F.col("frame_idx")).withColumn("is_beat", F.lit(False)).withColumn("ibi_ms", F.lit(800.0))
    pairs = det.valid_pairs(det.local_extremes(sig, keep_chunk=True))
    kept = det.debounce_pairs(pairs).count()
    assert kept > 3 and len(plans) == 1  # one chunk a key: rows are stored once and run where they are
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert kept == det.debounce_pairs(pairs.drop("_chunk")).count()
