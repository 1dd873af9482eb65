"""Closed-form waves and the behaviours that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from beatframe.functions import waves
from beatframe.operators import beats as bt, detect as det
from beatframe.operators.chunks import cut, ewma
from beatframe.operators.conditioning import signal


def beats_of(df):
    out = {}
    for r in det.detect_beats(df).orderBy("session_id", "frame_idx").collect():
        out.setdefault(r.session_id, []).append((r.frame_idx, r.ibi_ms, r.smoothed_ibi_ms))
    return out


def test_known_intervals(wave):
    frames = wave("sine60").unionByName(wave("sine75")).unionByName(wave("step_hr")).unionByName(wave("spike")).unionByName(wave("flat"))
    got = beats_of(frames)
    assert [b[1] for b in got["sine60"]] == [1000.0] * 18
    assert {b[2] for b in got["sine60"]} == {500.0}  # repeats are skipped, the smoother started at 0
    assert [b[1] for b in got["sine75"]] == pytest.approx([800.0] * 23)
    assert [b[1] for b in got["step_hr"]][7:11] == pytest.approx([1000, 987, 813, 800])
    assert [b[2] for b in got["step_hr"]][7:11] == pytest.approx([500, 743.5, 778.25, 789.125])
    assert len(got["spike"]) == 17
    assert "flat" not in got


def test_chunks_do_not_change_beats(spark, wave, request):
    frames = cut(wave("step_hr").unionByName(wave("spike")))
    whole = beats_of(frames)
    request.getfixturevalue("small_chunks")
    assert beats_of(frames) == whole


def test_fold_with_wrong_guesses_is_repaired(spark):
    """A counter never forgets, so every guessed start is wrong until the real end of the chunk before arrives."""
    from beatframe.operators.chunks import fold, move
    rows = spark.range(40).select(F.lit("a").alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") % 7).alias("x"))
    out = "struct<frame_idx:bigint,total:bigint>"
    step = lambda a, x: move(F.struct(a["n"] + x["x"]), F.struct(x["frame_idx"], a["n"] + x["x"]).cast(out))
    got = fold(rows, "frame_idx", ["frame_idx", "x"], F.struct(F.lit(0).cast("bigint")), step, "struct<n:bigint>", out, items=6, tail=2)
    total, want = 0, []
    for i in range(40):
        total += i % 7
        want.append((i, total))
    assert [(r.frame_idx, r.total) for r in got.orderBy("frame_idx").collect()] == want


def test_fit_amplitudes(spark):
    wave = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 5 + 4 * F.cos(2 * math.pi * i / 30.0))
    r = spark.range(1).select(waves.sine_fit_raw(wave(30)).alias("a"), waves.sine_fit_raw(wave(31)).alias("b")).first()
    assert r.a.amp == pytest.approx(4.0) and r.a.phi == pytest.approx(math.pi / 2) and r.a.rmse == pytest.approx(0, abs=1e-9)
    assert r.b.amp == pytest.approx(4.0586, abs=1e-4)  # both edges of the window are samples


@pytest.mark.parametrize("systole,amp,e", [(1 / 3, 1.9098, 1.314772), (1 / 2, 2.0, 1.224745)])
def test_distortion_of_its_own_basis(spark, systole, amp, e):
    v = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: 5 + 4 * waves.basis(i / 30.0, F.lit(systole), F.lit(1 - systole)))
    r = spark.range(1).select(v.alias("v")).select(waves.sine_fit_raw("v")["amp"].alias("a"), "v").select(
        "a", waves.distortion("v", "a", F.lit(systole), F.lit(1 - systole)).alias("e")).first()
    assert r.a == pytest.approx(amp, abs=1e-4) and r.e == pytest.approx(e, abs=1e-5)


def states(df):
    sig = cut(det.gated_index(signal(df)))
    return cut(det.frame_state(sig, det.accept_peaks(sig.where("is_cand"))))


def test_sine_path(spark, wave, request):
    st = states(wave("step_hr"))
    run = lambda: [tuple(r) for r in bt.sine_beats(st, cut(bt.sine_peaks(st))).select(
        "path", "frame_idx", "start_t", "end_t", "beat_reason", F.round("e", 9)).orderBy("path", "frame_idx").collect()]
    whole = run()
    d = [r for r in whole if r[0] == "D"]
    assert d[0][4] == "initial_peak" and d[1][2] == d[1][3]
    assert any(r[4] == "rapid_ibi_change" for r in whole) and any(r[4] == "ok" for r in whole)
    request.getfixturevalue("small_chunks")
    assert run() == whole


def test_morphology_chunks(spark, wave, request):
    st = states(wave("step_hr"))
    run = lambda: [tuple(r) for r in det.morphology(st).orderBy("frame_idx").collect()]
    whole = run()
    assert whole and all(-0.95 <= r.v2p_rel <= 0 for r in det.morphology(st).collect())
    request.getfixturevalue("small_chunks")
    assert run() == whole


def test_ewma_over_many_blocks(spark):
    n = 2000
    rows = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("_ord"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    for alpha in (0.02, 0.3, 0.5):
        got = [r.s for r in ewma(rows, "x", alpha, "s").orderBy("_ord").collect()]
        s, worst = None, 0.0
        for i in range(n):
            x = float(i * 37 % 101)
            s = x if s is None else alpha * x + (1 - alpha) * s
            worst = max(worst, abs(s - got[i]))
        assert worst < 1e-9


def test_fitted_wave_sorts_no_frames_by_beat(spark):
    # a window per beat and a group per frame held two sorts of all frames in one task
    frames = spark.range(0, 700).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") * 33).alias("t_ms"),
                                        F.when(F.col("id") < 60, 3.0).otherwise(F.col("id") * 7 % 13).cast("double").alias("green"))
    spans = [(0, 990), (990, 1980), (1980, 2970), (9570, 10560), (9900, 20000), (20000, 20000), (22000, 21000)]
    fits = spark.createDataFrame([(1, a, b, 5.0, 2.0 + i, 0.4, 0.6) for i, (a, b) in enumerate(spans)],
                                 "session_id int, start_t long, end_t long, mean double, amp double, systole double, diastole double")
    out = bt.fitted_wave(frames, fits)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.frame_idx: r for r in out.collect()}
    assert len(got) == 700
    green = {i: (3.0 if i < 60 else float(i * 7 % 13)) for i in range(700)}

    def ideal(i, k):
        a, b = spans[k]
        ph = ((33 * i - a) / (b - a) + 0.25) % 1.0
        angle = ph / 0.6 * math.pi if ph <= 0.6 else math.pi + (ph - 0.6) / 0.4 * math.pi
        return 5.0 + (2.0 + k) * (math.cos(angle - math.pi / 4) + 1) / 2

    for i in range(700):
        holding = [k for k, (a, b) in enumerate(spans) if b > a and a <= 33 * i <= b]
        if not holding:
            assert got[i].sin_wave == got[i].sin_amplitude == got[i].sin_ibi_ms == 0.0
            continue
        k = max(holding, key=lambda k: spans[k][1])
        inside = [j for j in range(700) if spans[k][0] <= 33 * j <= spans[k][1]]
        g, c = [green[j] for j in inside], [ideal(j, k) for j in inside]
        want = min(g) + (ideal(i, k) - min(c)) * (max(g) - min(g)) / (max(c) - min(c)) if max(g) > min(g) else ideal(i, k)
        assert got[i].sin_wave == pytest.approx(want) and got[i].sin_amplitude == 2.0 + k and got[i].sin_ibi_ms == spans[k][1] - spans[k][0]
