"""Limits of every reason, scoring invariants, replays and joins on hand-written rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.functions import models as m, quality as q, scalars as s
from beatframe.operators import aggregates as agg, chunks as ch, detect as det, evaluate as ev, joins as jn, phases as ph, replay as rp, rolling as ro
from beatframe.sources import tables as t


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_reason_limits(spark):
    L = F.lit
    cases = {
        "invalid_ibi": q.beat_reason(L(299.9), L(5.0), L(0.0)), "ok1": q.beat_reason(L(300.0), L(0.5), L(0.0)),
        "ok2": q.beat_reason(L(1500.0), L(50.0), L(0.0)), "invalid_amplitude": q.beat_reason(L(800.0), L(0.49), L(0.0)),
        "rapid_ibi_change": q.beat_reason(L(800.0), L(5.0), L(600.0)), "ok3": q.beat_reason(L(800.0), L(5.0), L(700.0)),
        "sbp_out_of_range": q.bp_reason(L(59.9), L(45.0)), "dbp_out_of_range": q.bp_reason(L(100.0), L(39.0)),
        "sbp_not_above_dbp": q.bp_reason(L(90.0), L(90.0)), "pulse_pressure_out_of_range": q.bp_reason(L(100.0), L(81.0)),
        "ok4": q.bp_reason(L(100.0), L(80.0)), "insufficient_window": q.window_reason_of(L(7), L(5.0), L(1.0), L(200.0)),
        "sample_count_out_of_range": q.window_reason_of(L(76), L(5.0), L(1.0), L(1000.0)), "ok5": q.window_reason_of(L(75), L(5.0), L(1.0), L(1000.0)),
        "range_too_small": q.window_reason_of(L(30), L(0.34), L(1.0), L(1000.0)), "std_too_small": q.window_reason_of(L(30), L(0.35), L(0.07), L(1000.0)),
        "rel_ttp_sum_out_of_range": q.relttp_reason(L(-0.3), L(-0.4)), "ok6": q.relttp_reason(L(-0.4), L(-0.4)),
        "invalid_rel_ttp": q.relttp_reason(L(float("nan")), L(-0.4)), "poor_sine_fit": q.fit_reason(L(1.01)), "ok7": q.fit_reason(L(1.0))}
    r = one(spark, **cases)
    for name in cases:
        assert r[name] == name.rstrip("1234567"), name


def test_clamps_and_scores(spark):
    from types import SimpleNamespace
    d = spark.createDataFrame([(3.0, 70.0), (9.0, 70.0), (9.0, 200.0)], "a double, hr double").coalesce(1)
    d = m.predict(d, "M2", {"A": F.col("a"), "HR": F.col("hr"), "V2P_relTTP": F.lit(-0.5), "P2V_relTTP": F.lit(-0.5), "E": F.lit(1.0)}, "p")
    rows = {(x.a, x.hr): x.p for x in d.collect()}
    r = SimpleNamespace(none=rows[(3.0, 70.0)], one=rows[(9.0, 70.0)], two=rows[(9.0, 200.0)])
    assert r.none.feature_clamp_reason == "ok" and r.none.output_valid == 1
    assert r.one.feature_clamp_reason == "A:9.0000->5.0983" and r.one.reject_reason == "ok"
    assert r.two.reject_reason == "feature_support_violation" and r.two.sbp is None
    x = r.none
    assert sum(x.map_terms) == pytest.approx(x.map_raw) and x.dbp_raw == pytest.approx(x.map_raw - x.pp_raw / 3)
    assert x.sbp_raw - x.dbp_raw == pytest.approx(x.pp_raw)


def test_postprocess_holds_state(spark):
    rows = spark.createDataFrame([(1, 1, 120.0, 80.0, 1, "ok"), (1, 2, 90.0, 60.0, 0, "x"), (1, 3, 130.0, 80.0, 1, " ")],
                                 "session_id int, beat_index long, sbp double, dbp double, output_valid int, reject_reason string")
    r = rp.postprocess(rows).orderBy("beat_index").collect()
    assert (r[1].map_smoothed, r[1].postprocess_applied) == (0.0, 0)
    first, third = (120 + 160) / 3, (130 + 160) / 3
    assert r[0].map_smoothed == pytest.approx(first) and r[2].map_smoothed == pytest.approx(0.3 * third + 0.7 * first)
    assert r[2].pp_smoothed == pytest.approx(45.0)


def test_baseline_layouts(spark):
    vals = [(1, 10.0), (2, 30.0), (3, 20.0)]
    rows = spark.createDataFrame([(1, i, {"a": v, "b": 2 * v}, "M1", 1, "ok") for i, v in vals] + [(2, 1, {"a": 1.0}, "M1", 0, "bad")],
                                 "session_id int, beat_index long, features map<string,double>, method string, output_valid int, reject_reason string")
    names = ["a", "b"]
    coef = [(series, "M1", names, names, 2, 0.5, 90.0, 40.0, [1.0] + [1.0] * n, [2.0] + [0.0] * n, [0.0, 1.0, 0.0], [0.0, 0.0, 0.5])
            for series, n in (("RICH_BASELINE", 10), ("INITIAL_BASELINE", 8), ("SHARED_D_BASELINE", 8))]
    from catalog.model_queries import COEF_DDL
    c = spark.createDataFrame(coef, COEF_DDL)
    base = {r.series: r for r in rp.baselines(rows, c).collect()}
    # first two rows: a = 10, 30: median 20, sd 10, p10 12, p90 28, trend 20; b is twice that
    assert base["RICH_BASELINE"].baseline_map_raw == pytest.approx(1 + 3 * (20 + 10 + 12 + 28 + 20))
    assert base["INITIAL_BASELINE"].baseline_map_raw == pytest.approx(1 + 3 * (20 + 10 + 12 + 28))
    out = {(r.session_id, r.beat_index, r.series): r for r in rp.replay(rows, c).collect()}
    r = out[(1, 3, "INITIAL_BASELINE")]
    assert r.map_raw == pytest.approx(90 + 0.5 * (211 - 90) + 0.0) and r.initial_baseline_beats == 2
    assert out[(2, 1, "RICH_BASELINE")].reject_reason == "missing"  # no valid row in that session
    assert all(x.map == 0 and x.reject_reason == "missing" for x in rp.replay(rows, None).collect())


def test_nearest_ties_and_distance(spark):
    left = spark.createDataFrame([(1, 1500), (1, 3000), (1, 9000), (1, 2000)], "session_id int, t_ms long")
    right = spark.createDataFrame([(1, 1000, 0, "a"), (1, 2000, 1, "b"), (1, 2000, 2, "c"), (1, 8000, 3, "d")], "session_id int, t_ms long, i int, v string")
    for chunk in (700, 100_000):
        got = {r.t_ms: r.v for r in jn.asof_nearest(left, right, "t_ms", ["v"], tol=1000, first=["i"], chunk=chunk).collect()}
        assert got == {1500: "a", 2000: "b", 3000: None, 9000: None}  # earlier wins a tie; exactly 1000 ms is no match


def test_nearest_is_one_sort_of_the_rows(spark):
    """Random times in many chunks against a search over all rows, and one exchange of the left rows in the plan."""
    i = F.col("id")
    left = spark.range(400).select((i % 3).alias("k"), F.when(i % 50 != 7, F.pmod(F.xxhash64(i), F.lit(5000))).alias("t"), i.alias("n"))
    right = spark.range(150).select((i % 2).alias("k"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(4000)).alias("t"), i.alias("v"), F.lit("x").alias("n"))
    got = jn.asof_nearest(left, right, "t", ["v", "n"], key="k", first=["v"], chunk=130)
    assert got.columns == ["k", "t", "n", "v", "n_right"]
    rows, hits = got.collect(), right.collect()
    assert len(rows) == 400
    for r in rows:
        near = [(abs(h.t - r.t), h.t, h.v) for h in hits if h.k == r.k] if r.t is not None else []
        assert r.v == (min(near)[2] if near else None)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    rows = [n for n, line in enumerate(plan) if "Union" in line]
    shuffles = [line for line in plan if "Exchange hashpartitioning(k" in line and "_c" in line]
    assert len(rows) == 2 and len(shuffles) == 3  # both sides, the chunks of the left, the chunk summaries


def test_on_runs(spark):
    rows = [(1, i, i * 100, 3.0, 0.0, 4.0, v, b) for i, (v, b) in enumerate([(0, 0), (1, 0), (1, 0), (1, 1), (2, 1), (1, 1), (0, 1)])]
    imu = spark.createDataFrame(rows, "session_id int, frame_idx long, t_ns long, accel_x double, accel_y double, accel_z double, vib_state int, burst_id int")
    assert ro.runs(imu, F.col("vib_state") == 1, extra_breaks=["burst_id"]).select("run_id").distinct().count() == 6
    beats = spark.createDataFrame([(1, 1, 0, 600), (1, 2, 0, 50)], "session_id int, beat_index long, start_ns long, end_ns long")
    got = {r.beat_index: r.imu_vib_rms_on_median for r in agg.on_run_rms(imu, beats).collect()}
    assert got == {1: 5.0, 2: 0.0}


def test_phase_machine(spark):
    frames = spark.range(0, 400).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") * 33).alias("t_ms"),
                                        (F.col("id") != 10).alias("gate_ok"))
    cfg = {"placement": 1000, "rest": 2000, "cold": 1000, "recovery": 1000}
    r = {x.name: (x.start_time_ms, x.end_time_ms) for x in ph.phase_machine(frames, config=cfg).collect()}
    start = 11 * 33
    rest = next(i * 33 for i in range(12, 400) if i * 33 - start >= 1000)
    assert r["placement"] == (0, rest) and r["rest"][0] == rest
    forced = {x.name: x.start_time_ms for x in ph.phase_machine(frames, config=cfg, forced=True).collect()}
    assert forced["rest"] == next(i * 33 for i in range(400) if i * 33 >= 1000)
    never = ph.phase_machine(frames.withColumn("gate_ok", F.lit(False))).collect()
    assert {x.start_time_ms for x in never if x.phase > 0} == {-1}


def test_quantiles_match_percentile(spark):
    d = spark.range(5000).select((F.col("id") % 3).alias("session_id"), (F.sin("id") * 100).alias("x"))
    want = {r.session_id: r.p for r in d.groupBy("session_id").agg(F.percentile("x", [0.1, 0.5, 0.9]).alias("p")).collect()}
    for r in agg.quantiles(d, ["x"], [0.1, 0.5, 0.9]).collect():
        assert r.value == pytest.approx(want[r.session_id][[0.1, 0.5, 0.9].index(r.q)])


def test_flat_files_feed_the_detector(spark, wave, tmp_path):
    frames = wave("step_hr").withColumn("elapsed_s", F.col("t_ms") / 1000.0)
    text = t.formatted(frames.drop("session_id"), t.FRAME_FORMAT, t.FRAME_HEADER).toPandas()
    (tmp_path / "f").mkdir()
    text.to_csv(str(tmp_path / "f" / "my run_1_Wave_Data.csv"), index=False)
    back = t.read_frames(spark, str(tmp_path / "f"))
    assert {r.session_id for r in back.select("session_id").distinct().collect()} == {"my run_1"}
    rounded = frames.withColumn("green_raw", F.round("green_raw", 4))
    key = lambda d: sorted((r.frame_idx, r.t_peak, r.ibi_ms) for r in d.collect())
    assert key(det.detect_beats(back)) == key(det.detect_beats(rounded))


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.95, 0.9999])
def test_ewma_of_any_alpha(spark, alpha):
    import math as m
    values = [100 * m.sin(i) for i in range(1200)]
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, _ord long, v double")
    got = [r.e for r in ch.ewma(d, "v", alpha, "e").orderBy("_ord").collect()]
    want, s = [], values[0]
    for v in values:
        s = s + alpha * (v - s) if want else v
        want.append(s)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_half_average_of_a_steady_pulse(spark, small_chunks):
    values = [0.0, 800.0] + [1000.0] * 300 + [None, 1000.0, 900.0, 900.0]
    d = spark.createDataFrame([("s", 2 * i + 1, v) for i, v in enumerate(values)], "session_id string, beat_index long, ibi_ms double")
    got = [r.smoothed_ibi_ms for r in det.smooth_ibi(d).orderBy("beat_index").collect()]
    assert got[:3] == [0.0, 400.0, 700.0] and set(got[2:303]) == {700.0} and got[-2:] == [got[-1]] * 2


def test_search_reach_is_checked(spark):
    d = spark.createDataFrame([("s", i, i, i * 33, 5.0, False, False, False, 1700.0) for i in range(80)],
                              "session_id string, frame_idx long, gidx long, t_ms long, ring double, is_low boolean, is_high boolean, is_beat boolean, ibi_ms double")
    with pytest.raises(Exception, match="max_interval_s"):
        det.local_extremes(d).collect()
    assert det.local_extremes(d, max_interval_s=2.0).count() == 80


def test_latest_phase_wins(spark):
    rows = spark.createDataFrame([("s", 5), ("s", 15), ("s", 99)], "session_id string, t_ms long")
    line = spark.createDataFrame([("s", 0, 0, 20), ("s", 1, 10, 30)], "session_id string, phase int, start_time_ms long, end_time_ms long")
    assert {r.t_ms: r.phase for r in jn.label_phase(rows, line).collect()} == {5: 0, 15: 1, 99: None}


def test_files(spark, tmp_path):
    rows = spark.range(5).select(F.lit("s1").alias("session_id"), (F.col("id") / 30).alias("elapsed_s"), (F.col("id") * 1.5).alias("green"),
                                 (F.col("id") * 7).alias("t_elapsed_ns"), (F.col("id") * 0.12345).alias("green_raw"))
    t.write_frames(rows, str(tmp_path / "a"), mirror=str(tmp_path / "b"))
    text = sorted(x.value for x in spark.read.text(str(tmp_path / "a")).collect())
    assert any("0.033, 1.50, 0.00" in x for x in text)
    for d in ("a", "b"):
        back = t.read_frames(spark, str(tmp_path / d)).orderBy("t_elapsed_ns").collect()
        assert [x.green for x in back] == [0.0, 1.5, 3.0, 4.5, 6.0] and back[1].green_raw == pytest.approx(0.1235) and back[0].session_id == "s1"
    t.write_series(rows, str(tmp_path / "s"), "green", "elapsed_s")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 5


def test_coefficient_files(spark, tmp_path):
    model = {"RTBP": {"features": ["M1_A_used"], "MAP": [1, 2], "PP": [3, 4]},
             "SinBP_D": {"residual_features": ["M2_E_used"], "residual_MAP": [0, 1], "residual_PP": [0, 2]},
             "SinBP_M": {"features": ["M3_A_used"], "MAP": [1, 2], "PP": [3, 4]}}
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"models": model}))
    rows, models, blend = t.load_coefficients(spark, str(p))
    assert rows is None and models["M2"]["residual_pp"] == [0.0, 2.0] and blend == {}  # no baseline groups: replay stays empty
    g = {"feature_names": ["a"], "summary_source_columns": ["a"], "baseline_MAP": [1.0], "baseline_PP": [1.0], "delta_MAP": [0.0], "delta_PP": [0.0]}
    p.write_text(json.dumps({"models": model, **{k: {n: g for n in model} for k in t.SERIES_KEYS.values()},
                             t.BLEND_KEY: {"dynamic_gain_MAP": 0.4, "dynamic_gain_PP_by_method": {"SinBP_D": 0.1}}}))
    rows, _, blend = t.load_coefficients(spark, str(p))
    assert rows.count() == 9 and rows.first().initial_baseline_beats == 30
    assert blend == {"dynamic_gain_MAP": 0.4, "dynamic_gain_PP_by_method": {"M2": 0.1}}
    lines = tmp_path / "l.txt"
    lines.write_text("1,2,3\n4,x,6\n")
    assert t.load_linear_coefs(spark, str(lines)) == ((1.0, 2.0, 0.03), (4.0, 0.3, 0.02))
    assert t.load_linear_coefs(spark, str(tmp_path / "none"))[0] == m.PRESSURE_SBP


def test_meta_roundtrip(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"session_id": "a", "session_number": 2, "phase_timeline": [
        {"phase": 0, "name": "placement", "start_time_ms": 5, "end_time_ms": 9}]}, indent=2))
    d = t.read_meta(spark, str(tmp_path / "m.json"))
    t.write_meta(d, str(tmp_path / "out"))
    again = t.read_meta(spark, str(tmp_path / "out")).first()
    assert again.phase_timeline[0].end_time_ms == 9 and again.session_number == 2


def test_array_helpers(spark):
    r = one(spark, rot=s.canonical_rotation(F.array(*[F.lit(x) for x in (0, 1, 0, 0, 0, 0, 0, 1)])), g=s.green_correct(F.lit(95.0)),
            big=agg.largest_pointer(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(n).alias("n")) for a, n in ((1.0, "x"), (3.0, "y"), (3.0, "z"))]),
                                    lambda p: p["area"])["n"])
    assert r.rot == "00000101" and r.g == pytest.approx(50.0) and r.big == "y"


def test_ridge_folds_match_direct_solution(spark):
    import numpy as np
    from beatframe.operators import evaluate as ev
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(i % 4, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "subject int, a double, b double, y double")
    for r in ev.ridge_loso(rows, ["a", "b"], "y").collect():
        keep = np.arange(60) % 4 != r.subject
        xc, yc = x[keep] - x[keep].mean(0), y[keep] - y[keep].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        assert r.coefs == pytest.approx([y[keep].mean() - x[keep].mean(0) @ w, *w])


def test_phase_filter_against_plain_loop(spark):
    from beatframe.operators.beats import phase_filter
    data = [(1, i, 700.0 + 30 * (i % 9), float((i * 53) % 17) / 6) for i in range(40)]
    got = [r.phase_filtered for r in phase_filter(spark.createDataFrame(data, "session_id int, beat_index long, beat_ibi_ms double, phase_offset_ms double")).orderBy("beat_index").collect()]
    shift, hist, missed, want = 0.0, [], 0, []
    for _, _, ibi, raw in data:
        hr = 60000 / ibi
        weight, limit = (0.5 if hr < 70 else 0.6 if hr < 90 else 0.7), 0.7853981633974483 * (1.5 if hr < 70 else 1.0)
        diff = raw - shift
        if abs(diff) > limit:
            diff, missed = (limit if diff > 0 else -limit), missed + 1
        else:
            missed = 0
        if missed >= 3:
            shift, hist, missed = raw, [raw], 0
        else:
            hist = (hist + [shift + diff * weight])[-3:]
            shift = sum(hist) / len(hist)
        want.append(shift)
    assert got == pytest.approx(want)


def test_beat_clock(spark, small_chunks):
    frames = spark.range(0, 300).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") * 100).alias("t_ms"), (F.col("id") * 7).alias("t_ns"))
    beats = spark.createDataFrame([(1, 1, 2000), (1, 2, 2840), (1, 3, 3660)], "session_id int, beat_index long, t_ms long")
    got = {r.beat_index: (r.start_ns, r.end_ns) for r in agg.beat_clock(beats, frames).collect()}
    assert got == {1: (5 * 7, 20 * 7), 2: (20 * 7, 28 * 7), 3: (28 * 7, 37 * 7)}


def test_missing_pair_has_no_relative_time(spark):
    rows = [("a", 5, 100, 800.0, "v2p", 2.0, 330, 10), ("a", 40, 1300, 800.0, "p2v", 1.0, 264, 8)]
    kept = spark.createDataFrame(rows, "session_id string, frame_idx long, t_ms long, ibi_ms double, kind string, amp double, dt long, gap long")
    got = det.pair_history(kept).orderBy("frame_idx").collect()
    assert (got[0].v2p_rel, got[0].p2v_rel, got[0].p2v_amp) == (-0.4125, 0.0, 0.0)
    assert (got[1].v2p_rel, got[1].p2v_rel) == (-0.4125, -0.33)


def test_beat_medians_of_any_length(spark):
    """Beats inside a block, over a block edge, and one of many blocks give what the in-group median gives."""
    i = F.col("id")
    beat = F.when(i < 95, F.floor(i / 30)).when(i < 4_000, F.lit(4)).when(i < 4_990, 5 + F.floor((i - 4_000) / 33))
    d = spark.range(0, 5_000, 1, 3).select(
        F.lit("s").alias("session_id"), i.alias("frame_idx"), beat.cast("bigint").alias("beat_index"),
        F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(997)) / 8.0).alias("a"),
        F.when(i < 30, F.lit(None)).otherwise(F.col("id") % 13).cast("int").alias("b"),
        (F.floor(i / 50) % 4).cast("int").alias("phase"), (i % 3).cast("int").alias("vib_state"))
    ok = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    want = d.where("beat_index IS NOT NULL").groupBy("session_id", "beat_index").agg(
        F.coalesce(F.median(ok("a")), F.lit(0.0)).alias("a_median"), F.coalesce(F.median(ok("b")), F.lit(0.0)).alias("b_median"),
        F.max_by("phase", "frame_idx").alias("phase"), F.avg((F.col("vib_state") == 1).cast("double")).alias("vib_duty_in_beat"))
    want = sorted(tuple(r) for r in want.collect())
    for most in (70, 10_000):
        got = agg.beat_context(d, ["a", "b"], most=most)
        assert got.columns == ["session_id", "beat_index", "a_median", "b_median", "phase", "vib_duty_in_beat"]
        got = sorted(tuple(r) for r in got.collect())
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [x for r in got for x in r[2:]] == pytest.approx([x for r in want for x in r[2:]])
    bare = agg.beat_context(d.drop("phase", "vib_state"), ["a"], most=70)
    assert bare.columns == ["session_id", "beat_index", "a_median"] and bare.count() == len(want)
    assert agg.beat_context(d.limit(0), ["a"]).count() == 0


def test_resonance_on_a_fine_grid(spark):
    """2,000 frequencies: a plan as wide as for one, epoch clocks, and the powers of a plain sum."""
    start, n = 1_700_000_000_123_456_789, 4_000
    t = F.lit(start) + F.col("id") * 2_500_000
    value = 9.0 + F.sin(2 * math.pi * 63.37 * F.col("id") * 0.0025)
    imu = spark.range(n).select(F.lit("s").alias("session_id"), t.alias("t_ns"), value.alias("accel_x"), F.lit(0.0).alias("accel_y"),
                                F.lit(0.0).alias("accel_z"), F.lit(1).alias("vib_state"))
    imu = imu.withColumn("accel_x", F.when(F.col("t_ns") != start, F.col("accel_x")))
    grid = [20.0 + 0.07 * k for k in range(2_000)]
    got = ev.resonance(imu, grid)
    one, all_ = (ev.resonance(imu, g)._jdf.queryExecution().optimizedPlan() for g in (grid[:1], grid))
    assert len(one.toString().splitlines()) == len(all_.toString().splitlines()) and got.schema == ev.resonance(imu, grid[:1]).schema
    x = np.arange(1, n)
    m = 9.0 + np.sin(2 * np.pi * 63.37 * x * 0.0025)
    power = [abs(((m - m.mean()) * np.exp(-2j * np.pi * f * x * 0.0025)).sum()) ** 2 / (n - 1) ** 2 for f in grid]
    r = got.first()
    assert (r.n, r.resonance_hz) == (n - 1, grid[int(np.argmax(power))]) and r.power == pytest.approx(max(power), rel=1e-6)


def test_rolling_sd_does_not_look_at_every_row_of_the_span_again(spark):
    """No moving frame, one shuffle, and the values of the plain definition with ties, gaps, nulls and large levels."""
    import numpy as np

    from beatframe.operators.rolling import rolling_sd

    rng = np.random.default_rng(5)
    t_ns = np.sort(rng.integers(0, 130_000, 900)) * 1_000_000
    t_ns[10:14] = t_ns[10]
    t_ns[400:] += 7_000_000_000
    x = [None if i % 17 == 3 else float(v) for i, v in enumerate(1e6 + rng.normal(0, 0.5, 900))]
    d = spark.createDataFrame([("a", i, int(t), v) for i, (t, v) in enumerate(zip(t_ns, x))], "session_id string, frame_idx long, t_ns long, x double").union(
        spark.createDataFrame([("b", 0, 5, 1.0), ("b", 1, 1_000_000_005, 3.0), ("b", 2, 2_000_000_006, 9.0)], "session_id string, frame_idx long, t_ns long, x double"))
    out = rolling_sd(d, ["x"])
    got = {(r.session_id, r.frame_idx): r.x_sd for r in out.collect()}
    assert [got["b", i] for i in range(3)] == [0.0, 1.0, 0.0] and len(got) == 903
    for i, at in enumerate(t_ns):
        inside = [v for s, v in zip(t_ns, x) if at - 1_000_000_000 <= s <= at and v is not None]
        assert got["a", i] is None if not inside else abs(got["a", i] - np.std(inside)) < 1e-6
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "-1000000000" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_sampling_rate_reads_its_rows_in_one_order(spark):
    # a second, descending order of the same rows doubled the sort memory of a task
    t = [0, 0, 400, 1000, 1000, 1001, 2000, 59_999, 60_000, 60_999, 61_000, 61_000, 62_001]
    d = spark.createDataFrame([(1, i, x * 1_000_000) for i, x in enumerate(t)], "session_id int, frame_idx int, t_ns long")
    out = ro.sampling_rate(d)
    assert " DESC" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.frame_idx: r.rate_hz for r in out.collect()}
    for i, x in enumerate(t):
        inside = [y for y in t if x - 1000 <= y <= x]
        span = (x - min(inside)) / 1000
        assert got[i] == pytest.approx((len(inside) - 1) / span if len(inside) >= 2 and span > 0 else 0.0)
