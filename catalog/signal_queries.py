"""Conditioning, detection, rolling statistics, joins, beat arrays, aggregates and phases over whole tables."""

from pyspark.sql import functions as F

from beatframe.functions import quality as q, waves
from beatframe.operators import aggregates as agg, beats as bt, conditioning as cond, detect as det, joins as jn
from beatframe.operators import phases as ph, rolling as ro
from beatframe.operators.chunks import cut, ewma
from .base import (BF, EV, IMU, LI, PX, REF, ST, event_frames, feature_rows, imu_samples, line_frames, pixels,
                   query, r6, reference_bp, rounded, steps, table)

C = F.col
W = "WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)"


def cond_sql(src: str, first: int = 6, scale: str = "10.0") -> str:
    lags = " + ".join(["corrected"] + [f"coalesce(lag(corrected, {k}) OVER w, 0)" for k in range(1, first)])
    return f"""c0 AS (SELECT *, (green_raw % 30) / 30.0 * 100.0 * 3.0 AS corrected FROM {src}),
c1 AS (SELECT *, CASE WHEN frame_idx >= 19 THEN ({lags}) / {first}.0 END AS ma1 FROM c0 {W}),
c2 AS (SELECT *, CASE WHEN frame_idx >= 19 THEN (ma1 + coalesce(lag(ma1) OVER w, 0) + coalesce(lag(ma1, 2) OVER w, 0) + coalesce(lag(ma1, 3) OVER w, 0))
 / CAST(least(4, frame_idx - 18) AS DOUBLE) END AS ma2, min(ma1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo_,
 max(ma1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi_ FROM c1 {W}),
c3 AS (SELECT * EXCLUDE (lo_, hi_), CASE WHEN frame_idx >= 19 THEN greatest(0.0, least({scale}, (ma2 - lo_) / greatest(hi_ - lo_, 1.0) * {scale})) ELSE 0.0 END AS ring FROM c2),
c4 AS (SELECT *, CASE WHEN frame_idx >= 19 THEN ring ELSE corrected END AS green FROM c3)"""


PEAK_T = ("CAST(floor({base} + greatest(-0.5, least(0.5, CASE WHEN abs({l} - {c} * 2.0 + {r}) > 1e-9 THEN ({l} - {r}) * 0.5 / ({l} - {c} * 2.0 + {r}) ELSE 0.0 END))"
          " * (1000.0::DOUBLE / 30.0::DOUBLE) + 0.5) AS BIGINT)")
CAND = f"""c5 AS (SELECT *, lag(ring, 1, 0.0) OVER w AS r1, lag(ring, 2, 0.0) OVER w AS r2, lag(ring, 3, 0.0) OVER w AS r3, lag(ring, 4, 0.0) OVER w AS r4,
 min(ring) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS lo_, max(ring) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hi_ FROM c4 {W}),
c6 AS (SELECT *, r1 > r2 AND r2 > r3 AND r3 > r4 AND r1 > ring AS is_shape,
 coalesce(r1 > r2 AND r2 > r3 AND r3 > r4 AND r1 > ring AND r1 - lo_ >= greatest(0.12, (hi_ - lo_) * 0.35), false) AS is_cand FROM c5),
sig AS (SELECT * EXCLUDE (r1, r2, r3, r4, lo_, hi_), CASE WHEN is_cand THEN {PEAK_T.format(base="floor(t_ms - 1000.0::DOUBLE / 30 + 0.5)", l="r2", c="r1", r="ring")} END AS t_peak FROM c6)"""
PEAKS = """peaks AS (
SELECT session_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, CAST(-8 AS BIGINT) AS g, 1 AS late, CAST(NULL AS BIGINT) AS t, false AS hit, false AS ok,
 0.0::DOUBLE AS ibi, 0.0::DOUBLE AS sm, 0.0::DOUBLE AS last_ibi, 0.0::DOUBLE AS bpm, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS interval_ms, CAST([] AS DOUBLE[]) AS hist, 0.0::DOUBLE AS before
FROM (SELECT DISTINCT session_id FROM cand)
UNION ALL
SELECT session_id, k, frame_idx, CASE WHEN hit THEN gidx ELSE g END, CASE WHEN ok THEN 0 WHEN hit THEN 1 ELSE late END, CASE WHEN hit THEN t_peak ELSE t END, hit, ok,
 CASE WHEN ok THEN nibi ELSE ibi END, CASE WHEN NOT ok OR nibi = last_ibi THEN sm ELSE (sm + nibi) / 2.0 END, CASE WHEN ok THEN nibi ELSE last_ibi END,
 CASE WHEN ok AND near THEN nbpm ELSE bpm END, nsd, intv * 1000.0, CASE WHEN ok THEN h ELSE hist END, sm
FROM (SELECT *, CASE WHEN near THEN 60.0::DOUBLE / nbpm * 1000.0 ELSE intv * 1000.0 END AS nibi FROM (
 SELECT *, nbpm >= mean - mean * 0.1 AND nbpm <= mean + mean * 0.1 AS near, sqrt(list_sum(list_transform(h, lambda v: (v - mean) * (v - mean))) / len(h)) AS nsd FROM (
 SELECT *, list_sum(h) / len(h) AS mean FROM (
 SELECT *, CASE WHEN len(hist) >= 20 THEN list_append(hist[2:], nbpm) ELSE list_append(hist, nbpm) END AS h FROM (
 SELECT *, hit2 AS hit, ok2 AS ok, 60.0::DOUBLE / intv AS nbpm FROM (
 SELECT *, coalesce(hit2 AND intv >= 0.3 AND intv <= 1.5, false) AS ok2 FROM (
 SELECT p.session_id, c.k, c.frame_idx, c.gidx, c.t_peak, p.g, p.late, p.t, p.ibi, p.sm, p.last_ibi, p.bpm, p.hist, (c.t_peak - p.t) / 1000.0::DOUBLE AS intv,
  c.gidx - p.g - 1 + p.late >= CASE WHEN p.sm <= 0 THEN 8 ELSE greatest(8, least(24, floor(p.sm * 0.58 / (1000.0::DOUBLE / 30.0::DOUBLE) + 0.5))) END AS hit2
 FROM peaks p JOIN cand c ON c.session_id = p.session_id AND c.k = p.k + 1)))))))),
beats AS (SELECT session_id, frame_idx, g AS gidx, t AS t_peak, interval_ms, ibi AS ibi_ms, bpm, sd AS bpm_sd, before AS smoothed_before, sm AS smoothed_ibi_ms FROM peaks WHERE ok)"""


def peaks_sql(src: str, gated: bool) -> str:
    """Everything up to ``beats`` (recursive over candidate ordinals)."""
    g = ("CASE WHEN iso >= 300 THEN sum(CASE WHEN iso >= 300 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) - 1 END" if gated else "frame_idx")
    keep = "iso >= 300 AND is_cand" if gated else "is_cand"
    return f"""{cond_sql(src)}, {CAND},
sg AS (SELECT *, CAST({g} AS BIGINT) AS gidx FROM sig {W}),
cand AS MATERIALIZED (SELECT session_id, frame_idx, gidx, t_peak, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) AS k FROM sg WHERE {keep}),
{PEAKS}"""


BEATS_COLS = ["interval_ms", "ibi_ms", "bpm", "bpm_sd", "smoothed_before", "smoothed_ibi_ms"]
BEATS_R = ", ".join(f"round({c}, 6) AS {c}" for c in BEATS_COLS)


@query("flagship_session_rates", f"""WITH RECURSIVE {EV}, {peaks_sql('ev', True)}
SELECT session_id, count(*) AS n_beats, round(avg(ibi_ms), 6) AS mean_ibi_ms, round(60000.0 / avg(ibi_ms), 6) AS mean_hr,
 round(max_by(smoothed_ibi_ms, frame_idx), 6) AS last_smoothed_ms FROM beats GROUP BY 1""")
def flagship(spark, sf):
    b = det.detect_beats(event_frames(spark, sf))
    return b.groupBy("session_id").agg(
        F.count("*").alias("n_beats"), r6(F.avg("ibi_ms")).alias("mean_ibi_ms"), r6(60000.0 / F.avg("ibi_ms")).alias("mean_hr"),
        r6(F.max_by("smoothed_ibi_ms", "frame_idx")).alias("last_smoothed_ms"))


@query("f1_accept_peaks", f"""WITH RECURSIVE {LI}, {peaks_sql('li', False)}
SELECT session_id, frame_idx, gidx, t_peak, {BEATS_R} FROM beats""")
def accept(spark, sf):
    return rounded(det.detect_beats(line_frames(spark, sf)), *BEATS_COLS)


COND_COLS = ["corrected", "ma1", "ma2", "ring", "green"]
for logic, first, scale in (("1", 6, "10.0"), ("2", 4, "100.0")):
    query(f"w1_w4_condition_logic{logic}", f"WITH {LI}, {cond_sql('li', first, scale)} SELECT session_id, frame_idx, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in COND_COLS) + " FROM c4")(
        lambda spark, sf, logic=logic: rounded(cond.condition(line_frames(spark, sf), logic), *COND_COLS).select(
            "session_id", "frame_idx", *COND_COLS))


@query("w5_w6_peak_candidates", f"WITH {LI}, {cond_sql('li')}, {CAND} SELECT session_id, frame_idx, CAST(is_cand AS INT) AS is_cand, t_peak FROM sig WHERE is_shape")
def candidates(spark, sf):
    return cond.signal(line_frames(spark, sf), turning_points=False).where("is_shape").select(
        "session_id", "frame_idx", C("is_cand").cast("int").alias("is_cand"), "t_peak")


STRICT = f"""s1 AS (SELECT *, lag(green, 1) OVER w AS g1, lag(green, 2) OVER w AS g2, lag(green, 3) OVER w AS g3, lag(green, 4) OVER w AS g4, lag(green, 5) OVER w AS g5,
 lag(green, 6) OVER w AS g6, min(green) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lo_, max(green) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hi_,
 lag(t_ms, 3) OVER w AS tc FROM c4 {W}),
s2 AS (SELECT *, coalesce(green < g3 AND g1 < g3 AND g2 < g3 AND g4 < g3 AND g5 < g3 AND g6 < g3 AND g3 - lo_ >= greatest(0.12, (hi_ - lo_) * 0.35), false) AS is_peak FROM s1)"""


@query("w7_w8_strict_peaks", f"""WITH {LI}, {cond_sql('li')}, {STRICT} SELECT session_id, frame_idx, round(g3, 6) AS peak_v, {PEAK_T.format(base="tc", l="g4", c="g3", r="g2")} AS peak_t FROM s2 WHERE is_peak""")
def strict(spark, sf):
    return cond.strict_peaks(cond.condition(line_frames(spark, sf))).where("is_peak").select(
        "session_id", "frame_idx", r6("peak_v").alias("peak_v"), "peak_t")


# frames with an interval that only depends on the frame, so that the search can be checked without the detector
EXT = f"""x0 AS (SELECT *, 600.0 + frame_idx % 300 AS ibi_ms, ring < lag(ring, 1, 0.0) OVER w AND ring < lead(ring) OVER w AS low, ring > lag(ring, 1, 0.0) OVER w AND ring > lead(ring) OVER w AS high FROM c4 {W}),
x1 AS (SELECT *, list(CASE WHEN low THEN {{'v': ring, 'i': frame_idx}} END) OVER (w ROWS BETWEEN 56 PRECEDING AND 2 PRECEDING) AS lows,
 list(CASE WHEN high THEN {{'v': ring, 'i': frame_idx}} END) OVER (w ROWS BETWEEN 56 PRECEDING AND 2 PRECEDING) AS highs, CAST(least(floor(ibi_ms / (1000.0::DOUBLE / 30) + 0.5) + 10, 235) AS BIGINT) AS n FROM x0 {W}),
x2 AS (SELECT *, n // 2 AS half FROM x1)"""


def _best(points, lo, hi, sign):
    return (f"list_sort(list_transform(list_filter({points}, lambda p: p IS NOT NULL AND frame_idx - p.i >= {lo} AND frame_idx - p.i < {hi}), "
            f"lambda p: {{'k': p.v * {sign}, 'pos': frame_idx - p.i, 'v': p.v, 'slot': (p.i - 19 + 240) % 240}}))[1]")


EXT3 = f"""{EXT}, x3 AS (SELECT session_id, frame_idx, t_ms, ibi_ms, {_best('lows', '2', 'half', 1)} AS v2p_low, {_best('highs', 'half', 'n - 2', -1)} AS v2p_high,
 {_best('highs', '2', 'half - 2', -1)} AS p2v_high, {_best('lows', 'half + 2', 'n - 2', 1)} AS p2v_low FROM x2),
pr AS (SELECT session_id, frame_idx, t_ms, ibi_ms, 'v2p' AS kind, abs(v2p_high.v - v2p_low.v) AS amp, abs(v2p_low.pos - v2p_high.pos) * 33 AS dt, abs(v2p_low.slot - v2p_high.slot) AS gap,
 v2p_high.v - v2p_low.v AS rise FROM x3 UNION ALL
 SELECT session_id, frame_idx, t_ms, ibi_ms, 'p2v', abs(p2v_high.v - p2v_low.v), abs(p2v_low.pos - p2v_high.pos) * 33, abs(p2v_low.slot - p2v_high.slot), p2v_high.v - p2v_low.v FROM x3),
pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY frame_idx) AS k FROM pr WHERE amp > 0.1 AND dt >= 10 AND gap >= 3 AND
 CASE kind WHEN 'v2p' THEN dt <= ibi_ms * 5 AND gap <= 150 AND rise > -1.0 AND dt >= ibi_ms * 0.125 ELSE dt <= ibi_ms * 4 AND gap <= 120 AND rise > -0.5 AND dt <= ibi_ms * 0.875 END)"""


def _search_frames(spark, sf):
    d = cond.signal(line_frames(spark, sf))
    return (d.withColumn("ibi_ms", 600.0 + C("frame_idx") % 300).withColumn("gidx", C("frame_idx")).withColumn("is_beat", F.lit(False)))


@query("w9_q10_extreme_pairs", f"WITH {LI}, {cond_sql('li')}, {EXT3} SELECT session_id, frame_idx, kind, round(amp, 6) AS amp, dt, gap FROM pairs")
def pairs(spark, sf):
    return rounded(det.valid_pairs(det.local_extremes(_search_frames(spark, sf))).drop("t_ms", "ibi_ms"), "amp")


KEPT = """kept AS (SELECT session_id, kind, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS BIGINT) AS t, CAST(NULL AS DOUBLE) AS amp, CAST(NULL AS BIGINT) AS gap, CAST(NULL AS BIGINT) AS dt, 0.0::DOUBLE AS ibi_ms, false AS hit
FROM (SELECT DISTINCT session_id, kind FROM pairs)
UNION ALL SELECT session_id, kind, k, frame_idx, CASE WHEN hit THEN nt ELSE t END, CASE WHEN hit THEN namp ELSE amp END, CASE WHEN hit THEN ngap ELSE gap END, ndt, nibi, hit FROM (
 SELECT a.session_id, a.kind, p.k, p.frame_idx, a.t, a.amp, a.gap, p.t_ms AS nt, p.amp AS namp, p.gap AS ngap, p.dt AS ndt, CAST(p.ibi_ms AS DOUBLE) AS nibi,
  coalesce(p.t_ms - a.t > 100, true) AND NOT coalesce(abs(a.amp - p.amp) < 0.01 AND a.gap = p.gap, false) AS hit
 FROM kept a JOIN pairs p ON p.session_id = a.session_id AND p.kind = a.kind AND p.k = a.k + 1))"""


@query("f13_q11_debounced_pairs", f"WITH RECURSIVE {LI}, {cond_sql('li')}, {EXT3}, {KEPT} SELECT session_id, kind, frame_idx, round(amp, 6) AS amp, dt, gap FROM kept WHERE hit")
def debounced(spark, sf):
    kept = det.debounce_pairs(det.valid_pairs(det.local_extremes(_search_frames(spark, sf), keep_chunk=True)))
    return rounded(kept.select("session_id", "kind", "frame_idx", "amp", "dt", "gap"), "amp")


@query("j7_p11_morphology", f"""WITH RECURSIVE {LI}, {cond_sql('li')}, {EXT3}, {KEPT},
m0 AS (SELECT session_id, frame_idx, max(ibi_ms) AS ibi, max(amp) FILTER (WHERE kind = 'v2p') AS va, max(dt) FILTER (WHERE kind = 'v2p') AS vd, max(amp) FILTER (WHERE kind = 'p2v') AS pa,
 max(dt) FILTER (WHERE kind = 'p2v') AS pd FROM kept WHERE hit GROUP BY 1, 2),
m1 AS (SELECT session_id, frame_idx, ibi, coalesce(last_value(va IGNORE NULLS) OVER u, 0) AS va, last_value(vd IGNORE NULLS) OVER u AS vd, coalesce(last_value(pa IGNORE NULLS) OVER u, 0) AS pa,
 last_value(pd IGNORE NULLS) OVER u AS pd FROM m0 WINDOW u AS (PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT session_id, frame_idx, round(va, 6) AS v2p_amp, round(pa, 6) AS p2v_amp, round(CASE WHEN vd IS NULL THEN 0.0 ELSE -least(0.95, vd / ibi) END, 6) AS v2p_rel, round(CASE WHEN pd IS NULL THEN 0.0 ELSE -least(0.95, pd / ibi) END, 6) AS p2v_rel,
 round(va / (va + pa) * 100, 6) AS ai FROM m1""")
def morphology(spark, sf):
    return rounded(det.morphology(_search_frames(spark, sf)), *det.MORPHOLOGY).drop("t_ms")


# ---------------------------------------------------------------- rolling statistics on the feature rows
@query("w10_bpm_stats", f"""WITH {BF}, x AS (SELECT *, avg(HR) OVER u AS m, stddev_pop(HR) OVER u AS s FROM bf WINDOW u AS (PARTITION BY session_id ORDER BY beat_index ROWS 19 PRECEDING))
SELECT session_id, beat_index, round(m, 6) AS bpm_mean, round(s, 5) AS bpm_std, CAST(HR < m - m * 0.1 - 1e-9 OR HR > m + m * 0.1 + 1e-9 AS INT) AS is_outlier FROM x""")
def bpm_stats(spark, sf):
    d = feature_rows(spark, sf).withColumn("interval_ms", 60000.0 / C("HR"))
    d = det.bpm_stats(d).select("session_id", "beat_index", r6("bpm_mean").alias("bpm_mean"), F.round("bpm_std", 5).alias("bpm_std"), C("is_outlier").cast("int").alias("is_outlier"))
    return d


@query("w11_robust_average", f"""WITH {BF}, x AS (SELECT *, list_sort(list(A) OVER (PARTITION BY session_id ORDER BY beat_index ROWS 9 PRECEDING)) AS h FROM bf),
y AS (SELECT *, h[len(h) // 2 + 1] AS med FROM x), z AS (SELECT *, list_sort(list_transform(h, lambda v: abs(v - med))) AS d FROM y),
k AS (SELECT *, list_filter(h, lambda v: abs(v - med) <= 3 * d[len(d) // 2 + 1]) AS f FROM z) SELECT session_id, beat_index, round(list_sum(f) / len(f), 6) AS robust FROM k""")
def robust(spark, sf):
    return rounded(ro.robust_average(feature_rows(spark, sf), "A", 10).select("session_id", "beat_index", "robust"), "robust")


@query("w12_w13_changes", f"""WITH {LI}, x AS (SELECT *, lag(green_raw) OVER w AS p FROM li {W}) SELECT session_id, frame_idx, green_raw FROM x WHERE p IS NULL OR p <> green_raw""")
def changes(spark, sf):
    return det.drop_repeats(line_frames(spark, sf), "green_raw").select("session_id", "frame_idx", "green_raw")


@query("w14_rr_intervals", f"""WITH {EV} SELECT session_id, frame_idx, ts_ms - lag(ts_ms) OVER w AS rr_ms FROM ev {W}""")
def rr(spark, sf):
    return ro.rr_intervals(event_frames(spark, sf), "ts_ms").select("session_id", "frame_idx", "rr_ms")


VALID = "abs(V2P) + abs(P2V) BETWEEN 0.80 AND 1.30"
FIRST = f"fv AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY beat_index) AS rk FROM bf WHERE {VALID})"


@query("w15_first_valid", f"WITH {BF}, {FIRST} SELECT session_id, beat_index, rk AS rank_valid FROM fv WHERE rk <= 30")
def first_valid(spark, sf):
    d = ro.first_valid(feature_rows(spark, sf), 30, q.relttp_reason("V2P", "P2V") == "ok")
    return d.select("session_id", "beat_index", "rank_valid")


@query("w16_trend", f"WITH {BF} SELECT session_id, round(max_by(A, beat_index) - min_by(A, beat_index), 6) AS A_trend, round(max_by(E, beat_index) - min_by(E, beat_index), 6) AS E_trend FROM bf GROUP BY 1")
def trend(spark, sf):
    return rounded(ro.trend(feature_rows(spark, sf), ["A", "E"]), "A_trend", "E_trend")


@query("w17_f12_carry_last", f"""WITH {EV} SELECT session_id, frame_idx, last_value(CASE WHEN iso >= 300 THEN green_raw END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_bright FROM ev {W}""")
def carry_last(spark, sf):
    d = event_frames(spark, sf).withColumn("last_bright", F.when(C("iso") >= 300, C("green_raw")))
    return ro.carry_last(d, ["last_bright"]).select("session_id", "frame_idx", "last_bright")


@query("f12_carry_valid_bpm", f"""WITH {EV} SELECT session_id, frame_idx, round(last_value(CASE WHEN iso >= 300 AND green_raw > 20 THEN green_raw - 20 END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS last_valid_bpm FROM ev {W}""")
def carry_bpm(spark, sf):
    d = event_frames(spark, sf).withColumn("bpm", C("green_raw") - 20).withColumn("gate_ok", C("iso") >= 300)
    return rounded(det.carry_valid_bpm(d, cols=("bpm",)).select("session_id", "frame_idx", "last_valid_bpm"), "last_valid_bpm")


@query("p21_carry_sentinel", f"""WITH {EV}, x AS (SELECT *, CASE WHEN iso < 300 THEN -1 ELSE iso END AS v FROM ev)
SELECT session_id, frame_idx, coalesce(last_value(CASE WHEN v >= 0 THEN v END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), -1) AS iso FROM x {W}""")
def sentinel(spark, sf):
    d = event_frames(spark, sf).withColumn("iso", F.when(C("iso") < 300, -1).otherwise(C("iso")))
    return ro.carry_sentinel(d, "iso").select("session_id", "frame_idx", "iso")


@query("w18_sampling_rate", f"""WITH {IMU}, x AS (SELECT *, count(*) OVER r AS n, min(t_ns) OVER r AS a FROM imu WINDOW r AS (PARTITION BY session_id ORDER BY t_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW))
SELECT session_id, frame_idx, round(CASE WHEN n >= 2 AND t_ns > a THEN (n - 1) / ((t_ns - a) / 1e9::DOUBLE) ELSE 0 END, 6) AS rate_hz FROM x""")
def sampling_rate(spark, sf):
    return rounded(ro.sampling_rate(imu_samples(spark, sf)).select("session_id", "frame_idx", "rate_hz"), "rate_hz")


@query("q14_imu_rate_warning", f"""WITH {EV}, im AS (SELECT session_id, frame_idx, phase, ts_ms * 20 AS t_ns FROM ev),
x AS (SELECT *, count(*) OVER r AS n, min(t_ns) OVER r AS a FROM im WINDOW r AS (PARTITION BY session_id ORDER BY t_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW)),
p AS (SELECT session_id, min(t_ns) AS f FROM im WHERE phase >= 1 GROUP BY 1)
SELECT session_id, frame_idx FROM x JOIN p USING (session_id) WHERE phase >= 1 AND (t_ns - f) / 1e6 >= 3000 AND n >= 2 AND t_ns > a AND (n - 1) / ((t_ns - a) / 1e9::DOUBLE) < 250""")
def rate_warning(spark, sf):
    im = event_frames(spark, sf).select("session_id", "frame_idx", "phase", (C("ts_ms") * 20).alias("t_ns"))
    return ro.imu_rate_warnings(im).select("session_id", "frame_idx")


@query("w19_instant_fps", f"""WITH {EV}, x AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS dt FROM ev {W}) SELECT session_id, frame_idx,
 round(last_value(CASE WHEN dt > 0 THEN 1000.0::DOUBLE / dt END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS fps FROM x {W}""")
def fps(spark, sf):
    return rounded(ro.instant_fps(event_frames(spark, sf), "ts_ms").select("session_id", "frame_idx", "fps"), "fps")


@query("w21_beat_index", f"WITH {EV} SELECT session_id, frame_idx, row_number() OVER w AS beat_index FROM ev WHERE iso >= 300 {W}")
def beat_index(spark, sf):
    return det.beat_index(det.gate_iso(event_frames(spark, sf))).select("session_id", "frame_idx", "beat_index")


@query("p26_target_tempo", f"""WITH {BF}, x AS (SELECT *, avg(HR) OVER (PARTITION BY session_id ORDER BY beat_index ROWS 2 PRECEDING) * (1.0 + 0.05::DOUBLE) AS t FROM bf)
SELECT session_id, beat_index, round(t, 6) AS target_tempo, round(greatest(0.5::DOUBLE, least(4.0::DOUBLE, t / 120.0)), 6) AS speed FROM x""")
def tempo(spark, sf):
    return rounded(ro.target_tempo(feature_rows(spark, sf), 0.05, "HR"), "target_tempo", "speed").select(
        "session_id", "beat_index", "target_tempo", "speed")


# ---------------------------------------------------------------- folds with a linear state


@query("f2_smooth_ibi", f"""WITH RECURSIVE {BF}, src AS MATERIALIZED (SELECT session_id, beat_index, 60000.0::DOUBLE / HR AS ibi FROM bf),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS beat_index, 0.0::DOUBLE AS s, 0.0::DOUBLE AS last FROM (SELECT DISTINCT session_id FROM src)
UNION ALL SELECT f.session_id, c.beat_index, CASE WHEN c.ibi = f.last THEN f.s ELSE (f.s + c.ibi) / 2.0 END, c.ibi FROM f JOIN src c ON c.session_id = f.session_id AND c.beat_index = f.beat_index + 1)
SELECT session_id, beat_index, round(s, 6) AS smoothed_ibi_ms FROM f WHERE beat_index > 0""")
def smooth(spark, sf):
    d = feature_rows(spark, sf).select("session_id", "beat_index", (60000.0 / C("HR")).alias("ibi_ms"))
    return rounded(det.smooth_ibi(d).select("session_id", "beat_index", "smoothed_ibi_ms"), "smoothed_ibi_ms")


def _ewma_sql(src, value, alpha, out):
    return f"""f AS (SELECT session_id, frame_idx, {value} AS s FROM {src} WHERE frame_idx = 0
UNION ALL SELECT f.session_id, c.frame_idx, f.s + {alpha}::DOUBLE * (c.{value} - f.s) FROM f JOIN {src} c ON c.session_id = f.session_id AND c.frame_idx = f.frame_idx + 1)
SELECT session_id, frame_idx, round(s, 6) AS {out} FROM f"""


@query("f4_baseline", f"WITH RECURSIVE {LI}, src AS MATERIALIZED (SELECT session_id, frame_idx, green_raw FROM li), {_ewma_sql('src', 'green_raw', '0.02', 'dc')}")
def baseline(spark, sf):
    return rounded(ro.baseline(line_frames(spark, sf), "green_raw").select("session_id", "frame_idx", "dc"), "dc")


@query("f3_ewma", f"WITH RECURSIVE {LI}, src AS MATERIALIZED (SELECT session_id, frame_idx, green_raw * 0.70710678::DOUBLE AS green_raw FROM li), {_ewma_sql('src', 'green_raw', '0.3', 'smoothed')}")
def ewma_query(spark, sf):
    return rounded(ewma(line_frames(spark, sf).withColumn("green_raw", C("green_raw") * 0.70710678), "green_raw", 0.3, "smoothed", ordinal="frame_idx").select("session_id", "frame_idx", "smoothed"), "smoothed")


@query("f10_bpm_half_average", f"""WITH RECURSIVE {BF}, src AS MATERIALIZED (SELECT session_id, beat_index - 1 AS frame_idx, HR FROM bf), {_ewma_sql('src', 'HR', '0.5', 'bpm_smoothed')}""")
def half_average(spark, sf):
    d = feature_rows(spark, sf).withColumn("bpm_now", C("HR"))
    return rounded(det.bpm_half_average(d).select("session_id", (C("beat_index") - 1).alias("frame_idx"), "bpm_smoothed"), "bpm_smoothed")


@query("f11_runs", f"""WITH {IMU}, x AS (SELECT *, CASE WHEN lag(vib_state) OVER w IS NULL OR lag(vib_state) OVER w <> vib_state THEN 1 ELSE 0 END AS c FROM imu {W}),
y AS (SELECT *, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS run_id FROM x {W}) SELECT session_id, run_id, max(vib_state) AS vib_state, count(*) AS n, min(frame_idx) AS first_idx FROM y GROUP BY 1, 2""")
def runs(spark, sf):
    return ro.runs(imu_samples(spark, sf), "vib_state").groupBy("session_id", "run_id").agg(
        F.max("vib_state").alias("vib_state"), F.count("*").alias("n"), F.min("frame_idx").alias("first_idx"))


@query("f9_phase_filter")
def phase_filter(spark, sf):
    d = feature_rows(spark, sf).select("session_id", "beat_index", (60000.0 / C("HR")).alias("beat_ibi_ms"), (C("A") * 40).alias("phase_offset_ms"))
    return rounded(bt.phase_filter(d), "phase_filtered")


ROT = "list_sort(list_transform(range(0, 8), lambda k: pattern[k + 1:] || pattern[1:k]))[1]"
PAT = "concat(a1, a4 & 1, a3 & 1, (a4 >> 1) & 1, a2, (a4 >> 2) & 1, (a3 >> 1) & 1, (a4 >> 3) & 1)"
DUP = f"""d0 AS (SELECT *, {PAT} AS pattern FROM st), d1 AS (SELECT *, {ROT} AS class FROM d0),
d2 AS (SELECT *, CASE WHEN class = '00000000' THEN '00000000' ELSE first_value(pattern) OVER (PARTITION BY session_id, class ORDER BY step) END AS stored FROM d1),
d3 AS (SELECT *, pattern <> stored AS is_duplicate FROM d2)"""


@query("p28_rotation_duplicates", f"WITH {ST}, {DUP} SELECT session_id, step, pattern, class, CAST(is_duplicate AS INT) AS is_duplicate FROM d3")
def rotations(spark, sf):
    return ro.flag_rotation_duplicates(steps(spark, sf)).select("session_id", "step", "pattern", "class", C("is_duplicate").cast("int").alias("is_duplicate"))


@query("f14_step_labels", f"""WITH {ST}, {DUP}, e AS (SELECT *, coalesce(last_value(CASE WHEN NOT is_duplicate THEN ibi_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 800.0) AS before FROM d3)
SELECT session_id, step, round(before, 6) AS before, CASE WHEN is_duplicate THEN -2 WHEN ibi_ms > before THEN 2 ELSE 0 END AS reward, CASE WHEN is_duplicate THEN '001' WHEN ibi_ms > before THEN '100' ELSE '010' END AS next_state FROM e""")
def labels(spark, sf):
    return rounded(ro.label_steps(steps(spark, sf)).select("session_id", "step", "before", "reward", "next_state"), "before")


# ---------------------------------------------------------------- joins


@query("j1_nearest_reference", f"""WITH {EV}, {REF}, e AS (SELECT session_id, frame_idx, ts_ms - 757382400000 + (frame_idx % 4) * 21600000 AS t_ms FROM ev),
r AS (SELECT session_id, t_ms, arg_min(sbp, o_orderkey) AS sbp FROM ref GROUP BY 1, 2),
b AS (SELECT e.*, r.t_ms AS bt, r.sbp AS bs FROM e ASOF LEFT JOIN r ON e.session_id = r.session_id AND e.t_ms >= r.t_ms),
f AS (SELECT b.*, r.t_ms AS ft, r.sbp AS fs FROM b ASOF LEFT JOIN r ON b.session_id = r.session_id AND b.t_ms <= r.t_ms)
SELECT session_id, frame_idx, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t_ms - bt <= ft - t_ms) THEN CASE WHEN t_ms - bt < 86400000 THEN bs END ELSE CASE WHEN ft - t_ms < 86400000 THEN fs END END AS sbp FROM f""")
def nearest(spark, sf):
    e = event_frames(spark, sf).select("session_id", "frame_idx", (C("ts_ms") - 757382400000 + (C("frame_idx") % 4) * 21600000).alias("t_ms"))
    return jn.asof_nearest(e, reference_bp(spark, sf), "t_ms", ["sbp"], tol=86_400_000, first=["o_orderkey"], chunk=30 * 86_400_000).select(
        "session_id", "frame_idx", "sbp")


@query("j2_wall_to_clock", f"""WITH {EV}, e AS (SELECT session_id, frame_idx, ts_ms, ts_ms * 1000 + frame_idx AS t_ns FROM ev), r AS (SELECT session_id, ts_ms, arg_min(t_ns, frame_idx) AS t_ns FROM e GROUP BY 1, 2),
b AS (SELECT session_id, frame_idx AS beat_index, ts_ms + 40000000 AS t FROM e),
x AS (SELECT b.*, r.ts_ms AS t1, r.t_ns AS n1 FROM b ASOF LEFT JOIN r ON b.session_id = r.session_id AND b.t >= r.ts_ms),
y AS (SELECT x.*, r.ts_ms AS t2, r.t_ns AS n2 FROM x ASOF LEFT JOIN r ON x.session_id = r.session_id AND x.t <= r.ts_ms)
SELECT session_id, beat_index, CASE WHEN t1 IS NOT NULL AND (t2 IS NULL OR t - t1 <= t2 - t) THEN n1 ELSE n2 END AS t_ns FROM y""")
def wall_clock(spark, sf):
    e = event_frames(spark, sf).select("session_id", "frame_idx", "ts_ms", (C("ts_ms") * 1000 + C("frame_idx")).alias("t_ns"))
    b = e.select("session_id", C("frame_idx").alias("beat_index"), (C("ts_ms") + 40_000_000).alias("ts_ms"))
    return jn.asof_nearest(b, e, "ts_ms", ["t_ns"], first=["frame_idx"], chunk=7 * 86_400_000).select("session_id", "beat_index", "t_ns")


MARKS = "b AS (SELECT session_id, frame_idx, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) AS beat_index FROM ev WHERE iso >= 700)"


def _marks(frames):
    return det.beat_index(frames.where("iso >= 700")).select("session_id", "frame_idx", "beat_index")


@query("j3_assign_beat", f"""WITH {EV}, {MARKS} SELECT ev.session_id, ev.frame_idx, b.beat_index FROM ev ASOF LEFT JOIN b ON ev.session_id = b.session_id AND ev.frame_idx <= b.frame_idx""")
def assign(spark, sf):
    e = event_frames(spark, sf)
    return jn.assign_beat(e, _marks(e)).select("session_id", "frame_idx", "beat_index")


BEATW = "bw AS (SELECT session_id, i AS beat_index, i * 800 AS start_t, i * 800 + 800 AS end_t FROM (SELECT session_id, unnest(range(n)) AS i FROM (SELECT session_id, max(t_ms) // 800 AS n FROM li GROUP BY 1)))"


def _windows(frames):
    """Fixed 800 ms beats over each session."""
    n = frames.groupBy("session_id").agg(F.floor(F.max("t_ms") / 800).cast("bigint").alias("n")).where("n > 0")
    return n.select("session_id", F.explode(F.sequence(F.lit(0).cast("bigint"), C("n") - 1)).alias("beat_index")).select(
        "session_id", "beat_index", (C("beat_index") * 800).alias("start_t"), (C("beat_index") * 800 + 800).alias("end_t"))


SMP = "sm AS (SELECT bw.*, li.frame_idx, li.t_ms, li.green_raw / 5 AS v, row_number() OVER (PARTITION BY bw.session_id, bw.beat_index ORDER BY li.frame_idx) - 1 AS i, count(*) OVER (PARTITION BY bw.session_id, bw.beat_index) AS n FROM bw JOIN li ON li.session_id = bw.session_id AND li.t_ms BETWEEN start_t AND end_t)"


def _line_beats(spark, sf):
    f = line_frames(spark, sf).withColumn("v", C("green_raw") / 5)
    return bt.beat_samples(f, _windows(f), "v")


@query("j4_j5_interval_join", f"WITH {LI}, {BEATW}, {SMP} SELECT session_id, beat_index, count(*) AS n, min(frame_idx) AS a, max(frame_idx) AS b, round(sum(v), 6) AS total FROM sm GROUP BY 1, 2")
def interval(spark, sf):
    f = line_frames(spark, sf)
    hit = jn.interval_join(f, _windows(f), "t_ms", "start_t", "end_t", 10_000)
    return hit.groupBy("session_id", "beat_index").agg(F.count("*").alias("n"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), r6(F.sum(C("green_raw") / 5)).alias("total"))


@query("j7_asof_backward", f"""WITH {EV}, {MARKS} SELECT ev.session_id, ev.frame_idx, b.beat_index FROM ev ASOF LEFT JOIN b ON ev.session_id = b.session_id AND ev.frame_idx > b.frame_idx""")
def asof(spark, sf):
    e = event_frames(spark, sf)
    return jn.asof_backward(e, _marks(e), ["beat_index"], inclusive=False).select("session_id", "frame_idx", "beat_index")


@query("j8_align", f"""WITH {BF}, r AS (SELECT session_id, beat_index, E FROM bf WHERE beat_index % 3 = 0) SELECT bf.session_id, bf.beat_index, coalesce(r.E, 0.0) AS e_aligned FROM bf LEFT JOIN r USING (session_id, beat_index)""")
def align(spark, sf):
    d = feature_rows(spark, sf)
    right = d.where("beat_index % 3 = 0").select("session_id", "beat_index", C("E").alias("e_aligned"))
    return jn.align(d.select("session_id", "beat_index"), right, {"e_aligned": 0.0})


@query("j10_label_phase", f"""WITH {EV}, tl AS (SELECT session_id, phase, min(ts_ms) AS a, min(ts_ms) + 86400000 * 10 AS b FROM ev GROUP BY 1, 2),
x AS (SELECT ev.session_id, ev.frame_idx, max(struct_pack(a := tl.a, b := tl.b, p := tl.phase)) AS m FROM ev JOIN tl ON tl.session_id = ev.session_id AND ts_ms >= a AND ts_ms < b GROUP BY 1, 2)
SELECT ev.session_id, ev.frame_idx, x.m.p AS phase FROM ev LEFT JOIN x USING (session_id, frame_idx)""")
def phase_label(spark, sf):
    e = event_frames(spark, sf)
    tl = e.groupBy("session_id", "phase").agg(F.min("ts_ms").alias("start_time_ms"), (F.min("ts_ms") + 86_400_000 * 10).alias("end_time_ms"))
    return jn.label_phase(e.drop("phase"), tl, "ts_ms").select("session_id", "frame_idx", "phase")


# ---------------------------------------------------------------- beat arrays
@query("b1_a18_beat_samples", f"WITH {LI}, {BEATW}, {SMP} SELECT session_id, beat_index, max(n) AS n, round(min(v), 6) AS mn, round(max(v), 6) AS mx, round(max(v) - min(v), 6) AS rg, round(stddev_pop(v), 6) AS sd, list(CAST(round(v * 10) AS BIGINT) ORDER BY i)::VARCHAR AS samples FROM sm GROUP BY 1, 2")
def samples(spark, sf):
    v = waves.values("samples")
    d = _line_beats(spark, sf).withColumn("s", waves.beat_stats(v))
    text = F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.round(x * 10).cast("bigint").cast("string")), ", "), F.lit("]"))
    return d.select("session_id", "beat_index", C("s.n").cast("bigint").alias("n"), r6("s.min").alias("mn"), r6("s.max").alias("mx"), r6("s.range").alias("rg"), r6("s.std").alias("sd"), text.alias("samples"))


SMOOTH = """k0 AS (SELECT *, greatest(3, least(7, n // 10)) // 2 AS hw FROM sm),
k1 AS (SELECT a.session_id, a.beat_index, a.i, any_value(a.n) AS n, any_value(a.t_ms) AS t, list_reduce(list(b.v ORDER BY b.i), lambda x, y: x + y) / count(*) AS v FROM k0 a JOIN sm b ON a.session_id = b.session_id AND a.beat_index = b.beat_index AND b.i BETWEEN a.i - a.hw AND a.i + a.hw GROUP BY 1, 2, 3)"""
RATIO = """k2 AS (SELECT session_id, beat_index, any_value(n) AS n, min(struct_pack(v := -v, i := i, t := t)) AS p FROM k1 WHERE i < greatest(3, CAST(floor(n * 0.2::DOUBLE) AS INT)) GROUP BY 1, 2),
k3 AS (SELECT k1.session_id, k1.beat_index, any_value(k2.p.t) AS pt, min(struct_pack(v := k1.v, i := k1.i, t := k1.t)) AS q FROM k1 JOIN k2 USING (session_id, beat_index) WHERE k1.i >= k2.p.i AND k1.i <= least(k1.n - 1, CAST(floor(k1.n * 0.8::DOUBLE) AS INT)) GROUP BY 1, 2),
k4 AS (SELECT session_id, beat_index, CAST(q.t - pt AS DOUBLE) AS d FROM k3),
ratio AS (SELECT session_id, beat_index, CASE WHEN d < 0 OR d > 720 OR d / 800 < 0.1 OR d / 800 > 0.9 OR (800 - d) / 800 < 0.1 OR (800 - d) / 800 > 0.9 THEN 1.0::DOUBLE / 3 ELSE (800 - d) / 800 END AS sy,
 CASE WHEN d < 0 OR d > 720 OR d / 800 < 0.1 OR d / 800 > 0.9 OR (800 - d) / 800 < 0.1 OR (800 - d) / 800 > 0.9 THEN 2.0::DOUBLE / 3 ELSE d / 800 END AS di FROM k4)"""


@query("b2_w20_systole_ratio", f"WITH {LI}, {BEATW}, {SMP}, {SMOOTH}, {RATIO} SELECT session_id, beat_index, round(sy, 6) AS systole, round(di, 6) AS diastole FROM ratio")
def ratio(spark, sf):
    d = _line_beats(spark, sf).withColumn("r", waves.systole_ratio("samples", F.lit(800.0)))
    return d.select("session_id", "beat_index", r6("r.systole").alias("systole"), r6("r.diastole").alias("diastole"))


RES = """rs AS (SELECT a.session_id, a.beat_index, j, any_value(j * (a.n - 1) / 63.0::DOUBLE - floor(j * (a.n - 1) / 63.0::DOUBLE)) AS f, max(CASE WHEN a.i = CAST(floor(j * (n - 1) / 63.0::DOUBLE) AS INT) THEN v END) AS v0,
 max(CASE WHEN a.i = least(CAST(floor(j * (n - 1) / 63.0::DOUBLE) AS INT) + 1, n - 1) THEN v END) AS v1 FROM sm a, range(0, 64) t(j)
 WHERE a.i BETWEEN CAST(floor(j * (n - 1) / 63.0::DOUBLE) AS INT) AND CAST(floor(j * (n - 1) / 63.0::DOUBLE) AS INT) + 1 GROUP BY 1, 2, 3),
rp AS (SELECT session_id, beat_index, j, v0 * (1 - f) + v1 * f AS v FROM rs)"""
FITD = "fd AS (SELECT session_id, beat_index, sum(v * sin(2 * pi() * j / 64)) * 2 / 64 AS a, sum(v * cos(2 * pi() * j / 64)) * 2 / 64 AS b FROM rp GROUP BY 1, 2)"


@query("b3_b6_resampled_fit", f"""WITH {LI}, {BEATW}, {SMP}, {RES}, {FITD} SELECT session_id, beat_index, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(a * a + b * b), 6) AS amp,
 round(CASE WHEN atan2(b, a) < 0 THEN atan2(b, a) + 2 * pi() ELSE atan2(b, a) END, 6) AS phi FROM fd""")
def fit_d(spark, sf):
    d = _line_beats(spark, sf).withColumn("f", waves.sine_fit_resampled(waves.values("samples")))
    return d.select("session_id", "beat_index", *[r6(f"f.{c}").alias(c) for c in ("a", "b", "amp", "phi")])


FITM = """m0 AS (SELECT *, avg(v) OVER (PARTITION BY session_id, beat_index) AS mean FROM sm),
fm AS (SELECT session_id, beat_index, any_value(mean) AS mean, sum((v - mean) * sin(2 * pi() * i / n)) * 2 / any_value(n) AS a, sum((v - mean) * cos(2 * pi() * i / n)) * 2 / any_value(n) AS b FROM m0 GROUP BY 1, 2)"""


@query("b4_b5_raw_fit", f"""WITH {LI}, {BEATW}, {SMP}, {FITM}, e AS (SELECT session_id, beat_index, sqrt(avg(power(v - (fm.mean + a * sin(2 * pi() * i / n) + b * cos(2 * pi() * i / n)), 2))) AS rmse FROM sm JOIN fm USING (session_id, beat_index) GROUP BY 1, 2)
SELECT session_id, beat_index, round(mean, 6) AS mean, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(a * a + b * b), 6) AS amp, round(b / sqrt(a * a + b * b), 6) AS sin_phi, round(a / sqrt(a * a + b * b), 6) AS cos_phi, round(rmse, 6) AS rmse FROM fm JOIN e USING (session_id, beat_index)""")
def fit_m(spark, sf):
    d = _line_beats(spark, sf).withColumn("f", waves.sine_fit_raw(waves.values("samples")))
    return d.select("session_id", "beat_index", *[r6(f"f.{c}").alias(c) for c in ("mean", "a", "b", "amp", "sin_phi", "cos_phi", "rmse")])


BASIS = "(cos(CASE WHEN ph <= di THEN ph * (1 / di) * pi() ELSE pi() + (ph - di) * (1 / sy) * pi() END - pi() / 4) + 1) / 2"


@query("b7_b8_distortion", f"""WITH {LI}, {BEATW}, {SMP}, {SMOOTH}, {RATIO}, {RES}, {FITD}, u AS (SELECT sm.*, i / CAST(n AS DOUBLE) AS ph, avg(v) OVER (PARTITION BY session_id, beat_index) AS mean, sy, di, sqrt(a * a + b * b) AS amp FROM sm JOIN ratio USING (session_id, beat_index) JOIN fd USING (session_id, beat_index))
SELECT session_id, beat_index, round(sqrt(avg(power(v - (mean + amp * {BASIS}), 2))), 6) AS e FROM u GROUP BY 1, 2""")
def distortion(spark, sf):
    v = waves.values("samples")
    d = _line_beats(spark, sf).withColumn("r", waves.systole_ratio("samples", F.lit(800.0))).withColumn("f", waves.sine_fit_resampled(v))
    return d.select("session_id", "beat_index", r6(waves.distortion(v, "f.amp", "r.systole", "r.diastole")).alias("e"))


@query("b9_b10_peak_phase", f"""WITH {LI}, {BEATW}, {SMP}, p AS (SELECT session_id, beat_index, min(struct_pack(v := -v, i := i, t := t_ms)) AS p FROM sm WHERE i < greatest(3, CAST(floor(n * 0.2::DOUBLE) AS INT)) GROUP BY 1, 2),
z AS (SELECT session_id, beat_index, min(t_ms) AS t0 FROM sm GROUP BY 1, 2)
SELECT session_id, beat_index, CAST((p.t - t0) % 800 AS DOUBLE) AS peak_ms, CAST((800 - (p.t - t0) % 800) % 800 AS DOUBLE) AS offset_ms FROM p JOIN z USING (session_id, beat_index)""")
def peak_phase(spark, sf):
    d = _line_beats(spark, sf).withColumn("peak_ms", waves.peak_phase("samples", F.lit(800.0)))
    return d.select("session_id", "beat_index", "peak_ms", waves.phase_offset("peak_ms", F.lit(800.0)).alias("offset_ms"))


@query("b11_b13_j9_s9_fitted_wave", f"""WITH {LI}, {BEATW}, fit AS (SELECT *, 5.0::DOUBLE AS mean, 2.0::DOUBLE + beat_index % 3 AS amp, 0.4::DOUBLE AS sy, 0.6::DOUBLE AS di FROM bw),
o AS (SELECT fit.*, li.frame_idx, green_raw AS g, (t_ms - start_t) / 800.0::DOUBLE + 0.25 - floor((t_ms - start_t) / 800.0::DOUBLE + 0.25) AS ph FROM fit JOIN li ON li.session_id = fit.session_id AND t_ms BETWEEN start_t AND end_t),
o2 AS (SELECT *, mean + amp * {BASIS} AS ideal FROM o),
o3 AS (SELECT *, min(g) OVER q AS gl, max(g) OVER q AS gh, min(ideal) OVER q AS il, max(ideal) OVER q AS ih FROM o2 WINDOW q AS (PARTITION BY session_id, beat_index)),
o4 AS (SELECT session_id, frame_idx, arg_max(CASE WHEN gh > gl AND ih > il THEN gl + (ideal - il) * (gh - gl) / (ih - il) ELSE ideal END, beat_index) AS wv, arg_max(amp, beat_index) AS am FROM o3 GROUP BY 1, 2)
SELECT li.session_id, li.frame_idx, round(coalesce(wv, 0), 6) AS sin_wave, coalesce(am, 0) AS sin_amplitude FROM li LEFT JOIN o4 USING (session_id, frame_idx)""")
def fitted(spark, sf):
    f = cut(line_frames(spark, sf))
    fits = _windows(f).select("session_id", "start_t", "end_t", F.lit(5.0).alias("mean"), (2.0 + C("beat_index") % 3).alias("amp"), F.lit(0.4).alias("systole"), F.lit(0.6).alias("diastole"))
    return rounded(bt.fitted_wave(f, fits, value="green_raw").select("session_id", "frame_idx", "sin_wave", "sin_amplitude"), "sin_wave")


@query("w20_centered_ma", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * list_sum(embedding[greatest(1, i - 2):least(64, i + 2)]::DOUBLE[]) / len(embedding[greatest(1, i - 2):least(64, i + 2)]))), 6) AS checksum FROM embeddings")
def centered(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", C("embedding").cast("array<double>"))
    sm = waves.centered_ma("v", F.lit(5))
    return e.select("vec_id", r6(F.aggregate(F.transform(sm, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)).alias("checksum"))


# ---------------------------------------------------------------- aggregates
@query("a1_a3_beat_context", f"""WITH {EV}, {MARKS}, x AS (SELECT ev.*, b.beat_index FROM ev ASOF JOIN b ON ev.session_id = b.session_id AND ev.frame_idx <= b.frame_idx)
SELECT session_id, beat_index, round(median(green_raw), 6) AS green_raw_median, round(median(iso), 6) AS iso_median, max_by(phase, frame_idx) AS phase, round(avg(CASE WHEN phase = 1 THEN 1.0 ELSE 0.0 END), 6) AS vib_duty_in_beat FROM x GROUP BY 1, 2""")
def context(spark, sf):
    e = event_frames(spark, sf).withColumn("vib_state", C("phase"))
    d = agg.beat_context(jn.assign_beat(e, _marks(e)), ["green_raw", "iso"])
    return rounded(d, "green_raw_median", "iso_median", "vib_duty_in_beat")


IMUB = "ib AS (SELECT DISTINCT session_id, t_ns // 400000000 AS beat_index, t_ns // 400000000 * 400000000 AS start_ns, t_ns // 400000000 * 400000000 + 400000000 AS end_ns FROM imu)"


def _imu_beats(imu):
    return imu.select("session_id", F.floor(C("t_ns") / 400_000_000).alias("beat_index")).distinct().select(
        "session_id", "beat_index", (C("beat_index") * 400_000_000).alias("start_ns"), (C("beat_index") * 400_000_000 + 400_000_000).alias("end_ns"))


@query("a4_on_run_rms", f"""WITH {IMU}, {IMUB}, x AS (SELECT ib.session_id, beat_index, frame_idx, burst_id, vib_state, sqrt(0) + CAST(accel_x AS DOUBLE) * accel_x + CAST(accel_y AS DOUBLE) * accel_y + CAST(accel_z AS DOUBLE) * accel_z AS m2 FROM ib JOIN imu ON imu.session_id = ib.session_id AND t_ns BETWEEN start_ns AND end_ns),
r AS (SELECT session_id, beat_index, burst_id, sqrt(avg(m2)) AS rms FROM x WHERE vib_state = 1 GROUP BY 1, 2, 3)
SELECT ib.session_id, ib.beat_index, round(coalesce(median(rms), 0), 6) AS imu_vib_rms_on_median FROM ib LEFT JOIN r USING (session_id, beat_index) GROUP BY 1, 2""")
def on_rms(spark, sf):
    imu = imu_samples(spark, sf)
    return rounded(agg.on_run_rms(imu, _imu_beats(imu)), "imu_vib_rms_on_median")


@query("a5_burst_ac_rms", f"""WITH {IMU}, x AS (SELECT *, sqrt(CAST(accel_x AS DOUBLE) * accel_x + CAST(accel_y AS DOUBLE) * accel_y + CAST(accel_z AS DOUBLE) * accel_z) AS m, max(frame_idx) OVER (PARTITION BY session_id) AS last FROM imu),
r AS (SELECT session_id, burst_id, stddev_pop(m) AS s, max(frame_idx) AS e, any_value(last) AS last FROM x WHERE vib_state = 1 GROUP BY 1, 2) SELECT session_id, round(max_by(s, e), 6) AS last_burst_ac_rms FROM r WHERE e < last GROUP BY 1""")
def ac_rms(spark, sf):
    return rounded(agg.burst_ac_rms(imu_samples(spark, sf)), "last_burst_ac_rms")


@query("a6_a8_press_blocks", f"""WITH {LI}, x AS (SELECT *, t_ms * 2 AS t, frame_idx % 25 = 0 AS beat FROM li), y AS (SELECT *, CASE WHEN t < 20000 THEN 0 WHEN t < 28000 THEN 1 WHEN t < 36000 THEN 2 END AS b FROM x),
z AS (SELECT session_id, b, sum(green_raw * CASE WHEN beat AND (b > 0 OR t >= 12000) THEN 2 ELSE 1 END) / sum(CASE WHEN beat AND (b > 0 OR t >= 12000) THEN 2 ELSE 1 END) AS a FROM y WHERE b IS NOT NULL GROUP BY 1, 2),
p AS (SELECT session_id, coalesce(max(a) FILTER (WHERE b = 0), 0) AS a0, coalesce(max(a) FILTER (WHERE b = 1), 0) AS a1, coalesce(max(a) FILTER (WHERE b = 2), 0) AS a2 FROM z GROUP BY 1)
SELECT session_id, round(a0, 6) AS amp0, round(a1, 6) AS amp1, round(a2, 6) AS amp2, round((a0 + a1 + a2) / 3, 6) AS mean_amp FROM p""")
def blocks(spark, sf):
    d = line_frames(spark, sf).select("session_id", (C("t_ms") * 2).alias("t_ms"), C("green_raw").alias("corrected"), (C("frame_idx") % 25 == 0).alias("is_beat"))
    return rounded(agg.press_blocks(d), "amp0", "amp1", "amp2", "mean_amp")


@query("a7_mean_hr", f"WITH {EV}, x AS (SELECT session_id, ts_ms - lag(ts_ms) OVER w AS rr FROM ev {W}) SELECT session_id, round(coalesce(60000.0::DOUBLE / avg(rr), 75), 9) AS mean_hr FROM x GROUP BY 1")
def hr(spark, sf):
    return agg.mean_hr(ro.rr_intervals(event_frames(spark, sf), "ts_ms")).select("session_id", F.round("mean_hr", 9).alias("mean_hr"))


SUMCOLS = ("A", "HR", "E")


def _sum_sql(layout):
    f = lambda s, c: {"median": f"median({c})", "std": f"stddev_pop({c})", "p10": f"quantile_cont({c}, 0.1)", "p90": f"quantile_cont({c}, 0.9)", "trend": f"max_by({c}, beat_index) - min_by({c}, beat_index)"}[s]
    stats = ["median", "std", "p10", "p90"]
    vec = [f(s, c) for c in SUMCOLS for s in (*stats, "trend")] if layout == "column" else [f(s, c) for s in stats for c in SUMCOLS]
    return f"WITH {BF}, {FIRST}, x AS (SELECT session_id, [{', '.join(vec)}] AS v FROM fv WHERE rk <= 30 GROUP BY 1) SELECT session_id, i, round(v[i], 6) AS value FROM x, range(1, {len(vec) + 1}) t(i)"


for name, layout in (("a9_column_summary", "column"), ("a10_stat_summary", "stat")):
    @query(name, _sum_sql(layout))
    def summary(spark, sf, layout=layout):
        d = ro.first_valid(feature_rows(spark, sf), 30, q.relttp_reason("V2P", "P2V") == "ok")
        s = agg.session_summary(d, SUMCOLS, layout)
        return s.select("session_id", F.posexplode("summary").alias("i", "value")).select("session_id", (C("i") + 1).cast("bigint").alias("i"), r6("value").alias("value"))


@query("a11_quantiles", f"""WITH {BF}, x AS (SELECT session_id, unnest([0.1, 0.5, 0.9]) AS q, unnest([quantile_cont(A, 0.1), quantile_cont(A, 0.5), quantile_cont(A, 0.9)]) AS a, unnest([quantile_cont(P2V, 0.1), quantile_cont(P2V, 0.5), quantile_cont(P2V, 0.9)]) AS p FROM bf GROUP BY 1)
SELECT session_id, 'A' AS "column", q, round(a, 6) AS value FROM x UNION ALL SELECT session_id, 'P2V', q, round(p, 6) FROM x""")
def quantiles(spark, sf):
    return rounded(agg.quantiles(feature_rows(spark, sf), ["A", "P2V"], [0.1, 0.5, 0.9]), "value")


@query("a12_population_sd", f"WITH {BF} SELECT session_id, round(coalesce(stddev_pop(A), 0), 6) AS sd FROM bf GROUP BY 1")
def sd(spark, sf):
    return feature_rows(spark, sf).groupBy("session_id").agg(r6(F.coalesce(F.stddev_pop("A"), F.lit(0.0))).alias("sd"))


@query("a13_anchors", f"WITH {BF}, {FIRST} SELECT session_id, count(*) AS n, round(median(A), 6) AS A_anchor, round(median(V2P), 6) AS V2P_anchor FROM fv WHERE rk <= 30 GROUP BY 1")
def anchors(spark, sf):
    return rounded(agg.anchors(feature_rows(spark, sf), 30, ["A", "V2P"], q.relttp_reason("V2P", "P2V") == "ok"), "A_anchor", "V2P_anchor")


@query("a14_roi_means", f"WITH {PX} SELECT frame_idx, round(avg(yv), 6) AS yv_mean FROM px WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6 AND (x - 2) % 2 = 0 AND (y - 2) % 2 = 0 GROUP BY 1")
def roi(spark, sf):
    return rounded(agg.roi_means(pixels(spark, sf), stride=2), "yv_mean")


@query("a15_outer_inner_means", f"WITH {PX} SELECT frame_idx, round(avg(yv) FILTER (WHERE NOT (x >= 2 AND x < 6 AND y >= 2 AND y < 6)), 6) AS outer_mean, round(avg(yv) FILTER (WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6), 6) AS inner_mean FROM px GROUP BY 1")
def halves(spark, sf):
    d = agg.core_means(pixels(spark, sf)).withColumnsRenamed({"yv_outer": "outer_mean", "yv_inner": "inner_mean"})
    return rounded(d, "outer_mean", "inner_mean")


GEO = {"overlay_w": 1080.0, "overlay_h": 2400.0, "center_x": 180.0, "top_y": 150.0, "half_w": 0.0, "half_h": 0.0, "density": 3.1}


@query("a16_w22_touch_summary", """WITH p AS (SELECT l_orderkey AS touch_id, l_orderkey % 5 > 0 AS ok, l_partkey * 10 + l_linenumber AS pointer, greatest(0, l_quantity - 5) AS mj, l_tax * 1000 AS mn, l_discount AS size, l_extendedprice AS cx FROM lineitem),
a AS (SELECT *, CASE WHEN pi() * mj * mn / 4 <= 0 AND size > 0 THEN size * 1080.0 * 2400.0 ELSE pi() * mj * mn / 4 END AS area FROM p)
SELECT touch_id, CAST(bool_or(ok) AS INT) AS valid, round(CASE WHEN bool_or(ok) THEN sum(area) ELSE 0 END, 4) AS raw_area, round(CASE WHEN bool_or(ok) THEN sum(area) * power(2.625 / 3.1, 2) ELSE 0 END, 4) AS contact_area, arg_min(cx, struct_pack(a := -area, o := pointer)) AS cx FROM a GROUP BY 1""")
def touch(spark, sf):
    li = table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("touch_id"), (C("l_orderkey") % 5 > 0).cast("int").alias("valid"), (C("l_partkey") * 10 + C("l_linenumber")).alias("pointer"),
        (C("l_quantity") - 5).alias("major"), (C("l_tax") * 1000).alias("minor"), C("l_discount").alias("size"), C("l_extendedprice").alias("cx"), C("l_tax").alias("cy"), C("l_discount").alias("pressure"))
    d = agg.touch_summary(li, GEO, ["touch_id"])
    return d.select("touch_id", "valid", F.round("raw_area", 4).alias("raw_area"), F.round("contact_area", 4).alias("contact_area"), "cx")


@query("a17_phase_spans", f"WITH {EV} SELECT session_id, phase, min(ts_ms) AS start_time_ms, max(ts_ms) AS end_time_ms FROM ev GROUP BY 1, 2")
def spans(spark, sf):
    return agg.phase_spans(event_frames(spark, sf), "ts_ms")


GATE = f"""g AS (SELECT *, green_raw % 7 > 0 AS ok FROM li), g1 AS (SELECT *, ok AND NOT coalesce(lag(ok) OVER w, false) AS b FROM g {W}), g2 AS (SELECT *, last_value(CASE WHEN b THEN t_ms END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS f FROM g1 {W}),
s1 AS (SELECT session_id, min(t_ms) AS t FROM g2 WHERE ok AND t_ms > f AND t_ms - f >= 400 GROUP BY 1), s2 AS (SELECT li.session_id, min(li.t_ms) AS t FROM li JOIN s1 USING (session_id) WHERE li.t_ms >= s1.t + 3000 GROUP BY 1),
s3 AS (SELECT li.session_id, min(li.t_ms) AS t FROM li JOIN s2 USING (session_id) WHERE li.t_ms >= s2.t + 2000 GROUP BY 1), s4 AS (SELECT li.session_id, max(li.t_ms) AS t FROM li JOIN s3 USING (session_id) WHERE li.t_ms >= s3.t + 4000 GROUP BY 1),
b AS (SELECT session_id, min(t_ms) AS t FROM li GROUP BY 1), al AS (SELECT b.session_id, b.t AS t0, s1.t AS t1, s2.t AS t2, s3.t AS t3, s4.t AS t4 FROM b LEFT JOIN s1 USING (session_id) LEFT JOIN s2 USING (session_id) LEFT JOIN s3 USING (session_id) LEFT JOIN s4 USING (session_id))"""


@query("f8_phase_machine", f"""WITH {LI}, {GATE} SELECT session_id, 0 AS phase, 'placement' AS name, coalesce(t0, -1) AS start_time_ms, coalesce(t1, -1) AS end_time_ms FROM al UNION ALL SELECT session_id, 1, 'rest', coalesce(t1, -1), coalesce(t2, -1) FROM al
UNION ALL SELECT session_id, 2, 'cold', coalesce(t2, -1), coalesce(t3, -1) FROM al UNION ALL SELECT session_id, 3, 'recovery', coalesce(t3, -1), coalesce(t4, -1) FROM al""")
def machine(spark, sf):
    d = line_frames(spark, sf).withColumn("gate_ok", C("green_raw") % 7 > 0)
    return ph.phase_machine(d, config={"placement": 400, "rest": 3000, "cold": 2000, "recovery": 4000})


def states_of(spark, sf, gated: bool = False):
    """Frames with detector state, stored once so that later steps do not repeat the detection."""
    f = event_frames(spark, sf) if gated else line_frames(spark, sf)
    sig = cut(det.gated_index(cond.signal(f)).drop("green_raw", "corrected", "ma1", "ma2", "is_shape"))
    return cut(det.frame_state(sig.drop("is_cand", "t_peak"), det.accept_peaks(sig.where("is_cand and gidx is not null"))))


@query("f5_f7_b_sine_beats")
def sine_beats(spark, sf):
    st = states_of(spark, sf)
    d = bt.sine_beats(st, cut(bt.sine_peaks(st)))
    return d.select("session_id", "path", "frame_idx", "t_peak", "start_t", "end_t", "beat_reason", r6("e").alias("e"), r6("fit_m.amp").alias("amp_m"), r6("fit_d.amp").alias("amp_d"))


