"""Scalar functions and predicates: each query is one map over a whole table."""

from pyspark.sql import functions as F

from beatframe.functions import models as m, quality as q, scalars as s
from .base import BF0, EV, REF, ROW, ROWS, ST, event_frames, feature_rows, query, r6, reference_bp, steps, table

C = F.col


def features(fn):
    return lambda spark, sf: fn(feature_rows(spark, sf, indexed=False))


def events(fn):
    return lambda spark, sf: fn(table(spark, sf, "events"))


def lines(fn):
    return lambda spark, sf: fn(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "session_id"))


def add(name, fn, sql):
    query(name, sql)(fn)


LROW = "l_suppkey AS session_id, l_orderkey, l_linenumber, l_partkey"

add("p1_green_correct", lines(lambda d: d.select(*ROW, r6(s.green_correct("l_quantity")).alias("green"))),
    f"SELECT {LROW}, round((l_quantity % 30) / 30.0 * 100.0 * 3.0, 6) AS green FROM lineitem")
add("p2_clamp", lines(lambda d: d.select(*ROW, s.clamp("l_quantity", 10.0, 40.0).alias("v"), s.clamp01(C("l_quantity") / 25).alias("u"))),
    f"SELECT {LROW}, greatest(10.0::DOUBLE, least(40.0::DOUBLE, l_quantity)) AS v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 25)) AS u FROM lineitem")
add("p3_hr_from", events(lambda d: d.withColumn("ibi", 500 + C("value")).withColumn("sm", C("value") - 20).select(
    "event_id", r6(s.ibi_to_bpm("ibi")).alias("bpm"), r6(s.hr_from("sm", "ibi")).alias("hr"))),
    """SELECT event_id, round(60000.0::DOUBLE / (500 + value), 6) AS bpm,
 round(CASE WHEN value - 20 > 0 THEN 60000.0::DOUBLE / (value - 20) ELSE 60000.0::DOUBLE / (500 + value) END, 6) AS hr FROM events""")
add("p4_peak_time", lines(lambda d: d.select(*ROW, s.peak_time_ms(
    C("l_quantity"), C("l_quantity") + C("l_tax") * 100, C("l_quantity") + C("l_discount") * 100 - 4, C("l_partkey") * 33).alias("t_peak"))),
    f"""SELECT {LROW}, CAST(floor(l_partkey * 33 + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, CASE WHEN abs(l - 2 * c + r) > 1e-9
 THEN 0.5 * (l - r) / (l - 2 * c + r) ELSE 0 END)) * (1000.0::DOUBLE / 30) + 0.5) AS BIGINT) AS t_peak
FROM (SELECT *, l_quantity AS l, l_quantity + l_tax * 100 AS c, l_quantity + l_discount * 100 - 4 AS r FROM lineitem)""")
add("p5_map_pp", lambda sp, sf: reference_bp(sp, sf).withColumn("m", s.map_of("sbp", "dbp")).withColumn("p", s.pp_of("sbp", "dbp")).select(
    "o_orderkey", r6("m").alias("map"), r6("p").alias("pp"), r6(s.sbp_of("m", "p")).alias("sbp_back"), r6(s.dbp_of("m", "p")).alias("dbp_back")),
    f"""WITH {REF} SELECT o_orderkey, round((sbp + 2 * dbp) / 3.0, 6) AS map, round(sbp - dbp, 6) AS pp, round(sbp, 6) AS sbp_back,
 round(dbp, 6) AS dbp_back FROM ref""")


def _clamps(d):
    a = s.clamp_feature("A", "A", *m.M1_SUPPORT["A"])
    h = s.clamp_feature("HR", "HR", *m.M1_SUPPORT["HR"])
    e = s.clamp_feature_upper("E", "E", 4.81)
    joined = s.join_reasons(a["reason"], h["reason"], e["reason"])
    return d.select(*ROW, r6(a["used"]).alias("a_used"), r6(h["used"]).alias("hr_used"), r6(e["used"]).alias("e_used"),
                    joined.alias("reason"), s.count_reasons(joined).alias("n_clamped"), q.support_reason(joined).alias("support"))


CL = """cl AS (SELECT *, greatest(0.838976::DOUBLE, least(9.636604::DOUBLE, A)) AS ua, greatest(59.436808::DOUBLE, least(108.624444::DOUBLE, HR)) AS uh,
 least(E, 4.81::DOUBLE) AS ue FROM bf),
cr AS (SELECT *, concat_ws('|', CASE WHEN abs(ua - A) > 1e-9 THEN printf('A:%.4f->%.4f', A, ua) END,
 CASE WHEN abs(uh - HR) > 1e-9 THEN printf('HR:%.4f->%.4f', HR, uh) END, CASE WHEN abs(ue - E) > 1e-9 THEN printf('E:%.4f->%.4f', E, ue) END) AS reason FROM cl)"""
add("p6_feature_clamp_reason", features(_clamps),
    f"""WITH {BF0}, {CL} SELECT {ROWS}, round(ua, 6) AS a_used, round(uh, 6) AS hr_used, round(ue, 6) AS e_used, reason,
 CASE WHEN reason = '' THEN 0 ELSE len(string_split(reason, '|')) END AS n_clamped,
 CASE WHEN reason <> '' AND len(string_split(reason, '|')) > 1 THEN 'feature_support_violation' ELSE 'ok' END AS support FROM cr""")
add("p7_normalize_reason", events(lambda d: d.select("event_id", s.normalize_reason(
    F.when(C("event_type") == "click", None).when(C("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type"))).alias("reason"))),
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'missing' WHEN 'view' THEN 'ok' ELSE event_type END AS reason FROM events""")
add("p8_sanitize_csv", lambda sp, sf: table(sp, sf, "documents").select("doc_id", s.sanitize_csv("text").alias("text")),
    "SELECT doc_id, replace(replace(replace(coalesce(text, ''), ',', '_'), chr(10), '_'), chr(13), '_') AS text FROM documents")
add("p9_format_array", features(lambda d: d.select(*ROW, s.format_array(F.array("A", "HR"), ";", "%.3f").alias("text"))),
    f"WITH {BF0} SELECT {ROWS}, array_to_string(list_transform([A, HR], lambda x: printf('%.3f', x)), ';') AS text FROM bf")
add("p10_rel_ttp", events(lambda d: d.select("event_id", r6(s.rel_ttp(C("value") * 10, C("value") + 60)).alias("rel"))),
    "SELECT event_id, round(-least(0.95::DOUBLE, value * 10 / (value + 60)), 6) AS rel FROM events")
add("p11_augmentation_index", lines(lambda d: d.select(*ROW, r6(s.augmentation_index(C("l_discount") * 10, C("l_tax") * 10)).alias("ai"))),
    f"""SELECT {LROW}, round(CASE WHEN l_discount * 10 + l_tax * 10 > 0 THEN l_discount * 10 / (l_discount * 10 + l_tax * 10) * 100 END, 6) AS ai FROM lineitem""")
add("p12_elapsed_iso", events(lambda d: d.withColumn("t", s.epoch_ms("ts")).select(
    "event_id", r6(s.elapsed_s("t", F.lit(1704067200000))).alias("elapsed_s"), s.wall_iso("t").alias("wall_time"))),
    "SELECT event_id, round((epoch_us(ts) // 1000 - 1704067200000) / 1000.0::DOUBLE, 6) AS elapsed_s, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS wall_time FROM events")
add("p13_exposure_status", lines(lambda d: d.select(*ROW, s.exposure_status(C("l_quantity") * 5).alias("status"))),
    f"SELECT {LROW}, CASE WHEN l_quantity * 5 < 35 THEN 'too_dark' WHEN l_quantity * 5 > 200 THEN 'too_bright' ELSE 'ok' END AS status FROM lineitem")
add("p14_area_status", lines(lambda d: d.select(*ROW, s.area_status(C("l_quantity") * 500, C("l_linenumber") % 2 == 1).alias("status"))),
    f"""SELECT {LROW}, CASE WHEN l_linenumber % 2 <> 1 OR l_quantity * 500 < 16000 THEN 'below_base' WHEN l_quantity * 500 > 18000 THEN 'too_large' ELSE 'ok' END AS status FROM lineitem""")
add("p15_touch_area", lines(lambda d: d.select(*ROW, r6(s.touch_area(C("l_quantity") - 10, C("l_tax") * 1000, C("l_discount"), F.lit(1080.0), F.lit(2400.0))).alias("area"))),
    f"""SELECT {LROW}, round(CASE WHEN pi() * mj * mn / 4 <= 0 AND l_discount > 0 THEN l_discount * 1080.0 * 2400.0 ELSE pi() * mj * mn / 4 END, 6) AS area
FROM (SELECT *, greatest(0, l_quantity - 10) AS mj, greatest(0, l_tax * 1000) AS mn FROM lineitem)""")
add("p16_in_zone_area", lines(lambda d: d.select(*ROW, r6(s.in_zone_area(C("l_quantity") * 100, C("l_quantity") * 7.03, C("l_tax") * 4013.0, F.lit(160.0), F.lit(120.0), F.lit(180.0), F.lit(150.0), F.lit(110.0), F.lit(90.0))).alias("area"))),
    f"""WITH pts AS (SELECT i, sqrt((i % 8 + 0.5) / 8) AS rad, 2 * pi() * ((i // 8 + 0.5) / 8) AS th FROM range(64) t(i)),
d AS (SELECT DISTINCT l_quantity, l_tax FROM lineitem),
z AS (SELECT l_quantity, l_tax, count(*) FILTER (WHERE l_tax * 4013.0 + 60.0 * rad * sin(th) >= 150.0 AND
 power((l_quantity * 7.03 + 80.0 * rad * cos(th) - 180.0) / 110.0, 2) + power((l_tax * 4013.0 + 60.0 * rad * sin(th) - 150.0) / 90.0, 2) <= 1.0) AS n FROM d, pts GROUP BY ALL)
SELECT {LROW}, round(l_quantity * 100 * (n / 64.0::DOUBLE), 6) AS area FROM lineitem JOIN z USING (l_quantity, l_tax)""")
add("p17_normalize_area", lines(lambda d: d.select(*ROW, r6(s.normalize_area(C("l_extendedprice") / 3, C("l_tax") * 40 + 0.37)).alias("area"))),
    f"""SELECT {LROW}, round(l_extendedprice / 3 * power(2.625::DOUBLE / (l_tax * 40 + 0.37::DOUBLE), 2), 6) AS area FROM lineitem""")
add("p18_press_progress", lines(lambda d: d.select(*ROW, r6(s.press_progress(C("l_quantity") * 500)).alias("progress"))),
    f"SELECT {LROW}, round(greatest(0, least(1, (l_quantity * 500 - 16000) / 2000)), 6) AS progress FROM lineitem")
EVP = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"
add("p19_press_target", events(lambda d: d.withColumn("phase", F.expr(EVP)).withColumn("t", F.floor(C("value") * 1500).cast("bigint")).select(
    "event_id", r6(s.press_target("phase", "t")).alias("target"), s.phase_remaining_ms("phase", "t").alias("remaining_ms"))),
    f"""SELECT event_id, round(CASE phase WHEN 2 THEN least(1, t / 60000.0::DOUBLE) WHEN 3 THEN greatest(0, 1 - t / 120000.0::DOUBLE) ELSE 0 END, 6) AS target,
 greatest(0, CASE phase WHEN 0 THEN 10000 WHEN 1 THEN 120000 WHEN 2 THEN 60000 ELSE 120000 END - t) AS remaining_ms
FROM (SELECT event_id, {EVP} AS phase, CAST(floor(value * 1500) AS BIGINT) AS t FROM events)""")
add("p20_phase_name", events(lambda d: d.select("event_id", s.phase_name(F.expr(EVP) + F.when(C("value") > 50, 2).otherwise(0)).alias("phase"))),
    f"""SELECT event_id, CASE {EVP} + CASE WHEN value > 50 THEN 2 ELSE 0 END WHEN 0 THEN 'placement' WHEN 1 THEN 'rest' WHEN 2 THEN 'cold' WHEN 3 THEN 'recovery' ELSE 'unknown' END AS phase FROM events""")
add("p22_wrap01", events(lambda d: d.select("event_id", r6(s.wrap01((C("value") - 20) / 7)).alias("pos"))),
    "SELECT event_id, round((value - 20) / 7 - floor((value - 20) / 7), 6) AS pos FROM events")
add("p23_yuv_to_rgb", lines(lambda d: d.withColumn("c", s.yuv_to_rgb(C("l_quantity") * 5, C("l_partkey") % 256, C("l_orderkey") % 256)).select(*ROW, "c.r", "c.g", "c.b")),
    f"""SELECT {LROW}, greatest(0, least(255, CAST(floor((298 * c + 409 * e + 128) / 256.0) AS INT))) AS r,
 greatest(0, least(255, CAST(floor((298 * c - 100 * d - 208 * e + 128) / 256.0) AS INT))) AS g,
 greatest(0, least(255, CAST(floor((298 * c + 516 * d + 128) / 256.0) AS INT))) AS b
FROM (SELECT *, CAST(l_quantity * 5 AS INT) - 16 AS c, CAST(l_partkey % 256 AS INT) - 128 AS d, CAST(l_orderkey % 256 AS INT) - 128 AS e FROM lineitem)""")
add("p24_magnitude", lines(lambda d: d.select(*ROW, r6(s.magnitude("l_quantity", C("l_discount") * 100, C("l_tax") * 100)).alias("mag"))),
    f"SELECT {LROW}, round(sqrt(l_quantity * l_quantity + l_discount * 100 * (l_discount * 100) + l_tax * 100 * (l_tax * 100)), 6) AS mag FROM lineitem")
add("p25_burst_state", lines(lambda d: d.withColumn("b", s.burst_state(C("l_orderkey") * 37)).select(*ROW, "b.state", "b.cycle")),
    f"""SELECT {LROW}, CASE WHEN t % 2100 < 1500 THEN 0 WHEN t % 2100 < 1550 THEN 2 WHEN t % 2100 < 2050 THEN 1 ELSE 2 END AS state, t // 2100 AS cycle
FROM (SELECT *, l_orderkey * 37 AS t FROM lineitem)""")
add("p27_decode_pattern", lambda sp, sf: steps(sp, sf).select("step", F.array_join(s.decode_pattern("a1", "a2", "a3", "a4"), "").alias("pattern")),
    f"""WITH {ST} SELECT step, concat(a1, a4 & 1, a3 & 1, (a4 >> 1) & 1, a2, (a4 >> 2) & 1, (a3 >> 1) & 1, (a4 >> 3) & 1) AS pattern FROM st""")
add("s17_session_id", lambda sp, sf: table(sp, sf, "pages").select("page_id", s.normalize_session_id("url").alias("session_id"), s.base_name(
    F.lit("a"), C("page_id") % 6, F.lit(1700000000000) + C("page_id") * 61_000).alias("base_name")),
    """SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]', '_', 'g') AS session_id,
 'a_m' || (page_id % 6) || '_' || strftime(make_timestamp_ms(1700000000000 + page_id * 61000), '%Y%m%d_%H%M%S') AS base_name FROM pages""")

add("q2_beat_reason", features(lambda d: d.select(*ROW, q.beat_reason(C("HR") * 8, C("A") * 5, F.lit(700.0)).alias("reason"))),
    f"""WITH {BF0} SELECT {ROWS}, CASE WHEN HR * 8 < 300 OR HR * 8 > 1500 THEN 'invalid_ibi' WHEN A * 5 < 0.5 OR A * 5 > 50 THEN 'invalid_amplitude'
 WHEN abs(HR * 8 - 700.0::DOUBLE) / 700.0::DOUBLE > 0.3 THEN 'rapid_ibi_change' ELSE 'ok' END AS reason FROM bf""")
add("q3_window_reason", lines(lambda d: d.select(*ROW, q.window_reason_of(C("l_quantity").cast("int"), C("l_discount") * 10, C("l_tax") * 4, F.lit(800.0)).alias("reason"))),
    f"""SELECT {LROW}, CASE WHEN CAST(l_quantity AS INT) < 8 THEN 'insufficient_window' WHEN CAST(l_quantity AS INT) < 7.2 OR CAST(l_quantity AS INT) > 60 THEN 'sample_count_out_of_range'
 WHEN l_discount * 10 < 0.35 THEN 'range_too_small' WHEN l_tax * 4 < 0.08 THEN 'std_too_small' ELSE 'ok' END AS reason FROM lineitem""")
add("q4_relttp_reason", features(lambda d: d.select(*ROW, q.relttp_reason("V2P", "P2V").alias("reason"))),
    f"WITH {BF0} SELECT {ROWS}, CASE WHEN abs(V2P) + abs(P2V) < 0.80 OR abs(V2P) + abs(P2V) > 1.30 THEN 'rel_ttp_sum_out_of_range' ELSE 'ok' END AS reason FROM bf")
add("q5_bp_reason", lambda sp, sf: reference_bp(sp, sf).select("o_orderkey", q.bp_reason(C("sbp") * 1.4, C("dbp") * 1.1).alias("reason")),
    f"""WITH {REF}, x AS (SELECT o_orderkey, sbp * 1.4::DOUBLE AS s, dbp * 1.1::DOUBLE AS d FROM ref) SELECT o_orderkey, CASE WHEN s < 60 OR s > 200 THEN 'sbp_out_of_range'
 WHEN d < 40 OR d > 150 THEN 'dbp_out_of_range' WHEN s <= d THEN 'sbp_not_above_dbp' WHEN s - d < 20 OR s - d > 100 THEN 'pulse_pressure_out_of_range' ELSE 'ok' END AS reason FROM x""")
add("q6_support_reason", features(lambda d: _clamps(d).groupBy("session_id", "support").agg(F.count("*").alias("n"))),
    f"""WITH {BF0}, {CL} SELECT session_id, CASE WHEN reason <> '' AND len(string_split(reason, '|')) > 1 THEN 'feature_support_violation' ELSE 'ok' END AS support, count(*) AS n FROM cr GROUP BY ALL""")
add("q7_fit_reason", lines(lambda d: d.select(*ROW, q.fit_reason(C("l_quantity") / 25).alias("reason"))),
    f"SELECT {LROW}, CASE WHEN l_quantity / 25 > 1.0 THEN 'poor_sine_fit' ELSE 'ok' END AS reason FROM lineitem")


def _gate(d):
    g = q.quality_gate(C("l_tax") * 30, C("l_quantity") * 5, C("l_orderkey") % 2 == 0, s.area_status(C("l_quantity") * 500, F.lit(True)), C("l_partkey") % 3 > 0)
    return d.withColumn("g", g)


GATE = """g AS (SELECT *, l_tax * 30 >= 1.5 AS amp, l_quantity * 5 >= 35 AND l_quantity * 5 <= 200 AS ex, l_orderkey % 2 = 0 AS pos,
 l_partkey % 3 > 0 AS tch, l_quantity * 500 BETWEEN 16000 AND 18000 AS area FROM lineitem)"""
add("q8_quality_gate", lines(lambda d: _gate(d).select(*ROW, *[C("g")[n].cast("int").alias(n) for n in ("passed", "amplitude", "exposure", "position", "touch", "area")])),
    f"""WITH {GATE} SELECT {LROW}, CAST(amp AND ex AS INT) AS passed, CAST(amp AS INT) AS amplitude, CAST(ex AS INT) AS exposure, CAST(pos AS INT) AS position,
 CAST(tch AS INT) AS touch, CAST(area AS INT) AS area FROM g""")
add("q15_failed_gates", lines(lambda d: _gate(d).select(*ROW, q.failed_gates("g").alias("failed"))),
    f"""WITH {GATE} SELECT {LROW}, CASE WHEN amp AND ex THEN '' ELSE concat_ws(',', CASE WHEN NOT amp THEN 'amplitude' END, CASE WHEN NOT ex THEN 'exposure' END,
 CASE WHEN NOT pos THEN 'position' END, CASE WHEN NOT tch THEN 'touch' END, CASE WHEN NOT area THEN 'area' END) END AS failed FROM g""")
add("q9_is_valid", lambda sp, sf: reference_bp(sp, sf).where(q.is_valid(C("o_orderkey") % 2, F.when(C("sbp") > 140, "x").otherwise(" "), "sbp", C("dbp") - 40)).select("o_orderkey"),
    f"WITH {REF} SELECT o_orderkey FROM ref WHERE o_orderkey % 2 = 1 AND sbp <= 140 AND dbp - 40 > 0")
add("q10_pair_valid", lines(lambda d: d.select(*ROW, *[q.pair_valid(k, C("l_discount") * 100, C("l_tax") * 100, C("l_quantity").cast("int"), C("l_linenumber") * 3,
                                                                 C("l_partkey") % 240, C("l_orderkey") % 240, F.lit(800.0)).cast("int").alias(k) for k in ("v2p", "p2v")])),
    f"""SELECT {LROW}, CAST(abs(hi - lo) > 0.1 AND dt >= 10 AND dt <= 4000 AND gap <= 150 AND hi > lo - 1.0 AND dt >= 100 AND gap >= 3 AS INT) AS v2p,
 CAST(abs(hi - lo) > 0.1 AND dt >= 10 AND dt <= 3200 AND gap <= 120 AND hi > lo - 0.5 AND dt <= 700 AND gap >= 3 AS INT) AS p2v
FROM (SELECT *, l_discount * 100 AS lo, l_tax * 100 AS hi, abs(CAST(l_quantity AS INT) - l_linenumber * 3) * 33 AS dt, abs(l_partkey % 240 - l_orderkey % 240) AS gap FROM lineitem)""")
add("q12_finite_or", lines(lambda d: d.select(*ROW, r6(q.finite_or(F.when(C("l_tax") == 0, F.lit(float("nan"))).when(C("l_discount") == 0, F.lit(float("inf"))).otherwise(C("l_quantity")), -1.0)).alias("v"))),
    f"SELECT {LROW}, CASE WHEN l_tax = 0 OR l_discount = 0 THEN -1.0::DOUBLE ELSE l_quantity END AS v FROM lineitem")
add("q13_rr_in_band", events(lambda d: d.select("event_id", q.rr_in_band(C("value") / 50, 0.4, 1.5, False).cast("int").alias("open"), q.rr_in_band(C("value") / 50, 0.3, 1.5, True).cast("int").alias("closed"))),
    "SELECT event_id, CAST(value / 50 > 0.4 AND value / 50 < 1.5 AS INT) AS open, CAST(value / 50 >= 0.3 AND value / 50 <= 1.5 AS INT) AS closed FROM events")
add("m11_press_bp", features(lambda d: d.withColumn("b", m.press_bp("HR", "A")).select(*ROW, r6("b.sbp").alias("sbp"), r6("b.dbp").alias("dbp"))),
    f"WITH {BF0} SELECT {ROWS}, round(55 + 0.5 * HR + 0.03 * A, 6) AS sbp, round(40 + 0.3 * HR + 0.02 * A, 6) AS dbp FROM bf")
add("m10_calibrate", lambda sp, sf: reference_bp(sp, sf).withColumn("c", m.calibrate(s.map_of("sbp", "dbp"), s.pp_of("sbp", "dbp"), coef=(2.0, 0.9, -1.0, 1.1))).select(
    "o_orderkey", r6("c.map").alias("map"), r6("c.pp").alias("pp"), r6("c.sbp").alias("sbp"), r6("c.dbp").alias("dbp")),
    f"""WITH {REF}, x AS (SELECT o_orderkey, 2.0::DOUBLE + 0.9::DOUBLE * ((sbp + 2 * dbp) / 3.0) AS m, -1.0::DOUBLE + 1.1::DOUBLE * (sbp - dbp) AS p FROM ref)
SELECT o_orderkey, round(m, 6) AS map, round(p, 6) AS pp, round(m - p / 3.0 + p, 6) AS sbp, round(m - p / 3.0, 6) AS dbp FROM x""")
add("q1_low_light_gate", lambda sp, sf: event_frames(sp, sf).where("iso >= 300").groupBy("session_id").agg(F.count("*").alias("n"), r6(F.avg("green_raw")).alias("mean_green")),
    f"WITH {EV} SELECT session_id, count(*) AS n, round(avg(green_raw), 6) AS mean_green FROM ev WHERE iso >= 300 GROUP BY 1")

