"""Rounds of the chunked state machines, and equality with one pass."""

import math

import pytest
from pyspark.sql import functions as F

from beatframe.operators import beats as bt, chunks as ch, detect as det


def one_pass(spark, rows, run):
    """The same operator with all of a session in one chunk."""
    spark.conf.set("beatframe.foldItems", "1000000")
    try:
        return run(rows).collect()
    finally:
        spark.conf.unset("beatframe.foldItems")


def chunked(spark, rows, run, items):
    spark.conf.set("beatframe.foldItems", str(items))
    try:
        got = run(rows).collect()
        return got, ch.fold.rounds
    finally:
        spark.conf.unset("beatframe.foldItems")


def near(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def steady(spark, chunks, items):
    """Peaks 1000 ms apart, then 800 ms for the rest: the smoother stays between the two for ever."""
    i = F.col("id")
    g = F.when(i < 10, i * 30).otherwise(300 + (i - 10) * 24)
    t = F.when(i < 10, i * 1000).otherwise(10_000 + (i - 10) * 800)
    return spark.range(chunks * items).select(F.lit("s").alias("session_id"), g.alias("frame_idx"), g.alias("gidx"), t.alias("t_peak"))


def test_steady_pulse_of_a_thousand_chunks(spark):
    rows = steady(spark, 1000, 24)
    got, rounds = chunked(spark, rows, det.accept_peaks, 24)
    assert len(got) == 24_000 and rounds <= math.log2(1000)
    late = [r for r in got if r.gidx > 2000]
    assert {r.smoothed_ibi_ms for r in late} == {650.0}  # (0 + 1000) / 2, then (500 + 800) / 2
    few = steady(spark, 20, 24)
    assert near(chunked(spark, few, det.accept_peaks, 24)[0]) == near(one_pass(spark, few, det.accept_peaks))


@pytest.mark.parametrize("step,spread", [(7, 3), (9, 9), (5, 5)])
def test_noisy_candidates_equal_one_pass(spark, step, spread):
    """Candidates so dense that the wait decides often, and on the smoothed interval."""
    i = F.col("id")
    g = i * step + F.pmod(F.xxhash64(i), F.lit(spread))
    rows = spark.range(3000).select(F.lit("s").alias("session_id"), g.alias("frame_idx"), g.alias("gidx"), (g * 33 + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(11))).alias("t_peak"))
    got, rounds = chunked(spark, rows, det.accept_peaks, 40)
    assert near(got) == near(one_pass(spark, rows, det.accept_peaks)) and rounds < 75


def test_sine_path_passes_known_intervals(spark, wave):
    from beatframe.operators.conditioning import signal
    frames = wave("step_hr", 2400)
    sig = ch.cut(det.gated_index(signal(frames)))
    states = ch.cut(det.frame_state(sig, det.accept_peaks(sig.where("is_cand and gidx is not null"))))
    got, rounds = chunked(spark, states, bt.sine_peaks, 6)
    assert near(got) == near(one_pass(spark, states, bt.sine_peaks)) and len(got) > 150
    assert rounds <= 4
