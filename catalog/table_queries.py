"""Output tables: frame and sensor rows as written, method tables, interval tables, events, training table."""

import uuid

from pyspark.sql import functions as F

from beatframe.functions import models as m
from beatframe.operators.aggregates import phase_spans
from beatframe.functions.scalars import phase_name
from beatframe.operators.chunks import ensure_checkpoint_dir
from beatframe.operators.detect import detect_beats
from beatframe.plans import session as plan
from beatframe.sources import tables as t
from .base import BF, EV, IMU, LI, event_frames, feature_rows, imu_samples, line_frames, query, r6, rounded
from .model_queries import coefficient_fixture, feats, post_sql, score_sql
from .signal_queries import BEATS_COLS, BEATS_R, peaks_sql

C = F.col


# what each file column holds: Spark expression over event frames, SQL over ev, decimals
FRAME_FILL = {"elapsed_s": ("t_ms / 1000.0", "t_ms / 1000.0::DOUBLE"), "green": ("green_raw", "green_raw"), "sin_wave": ("green_raw * 3", "green_raw * 3"),
              "y_mean": ("green_raw * 2", "green_raw * 2"), "u_mean": ("green_raw + 1", "green_raw + 1"), "v_mean": ("green_raw + 2", "green_raw + 2"),
              "contact_area": ("frame_idx * 10", "frame_idx * 10"), "touch_pressure": ("green_raw / 100", "green_raw / 100"),
              "touch_cx": ("frame_idx + 0.5D", "frame_idx + 0.5::DOUBLE"), "touch_cy": ("frame_idx + 0.25D", "frame_idx + 0.25::DOUBLE"),
              "touch_major": ("iso", "iso"), "touch_minor": ("iso + 1", "iso + 1"), "touch_valid": ("frame_idx % 2", "frame_idx % 2"),
              "phase": ("phase", "phase"), "press_target": ("iso * 0.125D", "iso * 0.125::DOUBLE"), "t_elapsed_ns": ("ts_ms * 1000", "ts_ms * 1000"),
              "vib_state": ("frame_idx % 3", "frame_idx % 3"), "burst_id": ("floor(frame_idx / 7)", "frame_idx // 7"), "green_raw": ("green_raw", "green_raw")}


def _file_sql(fmt, of):
    return ", ".join(f"CAST(CAST({of(c)} AS BIGINT) AS VARCHAR) AS {c}" if d is None else f"printf('%.{d}f', CAST({of(c)} AS DOUBLE)) AS {c}"
                     for c, d in fmt)


@query("s1_frame_rows", f"WITH {EV} SELECT session_id, {_file_sql(t.FRAME_FORMAT, lambda c: FRAME_FILL[c][1])} FROM ev")
def frame_rows(spark, sf):
    f = event_frames(spark, sf)
    return t.formatted(f.select("session_id", *[F.expr(e).alias(c) for c, (e, _) in FRAME_FILL.items()]), t.FRAME_FORMAT)


IMU_FILL = {"t_elapsed_ns": "t_ns", "gyro_x": "0", "gyro_y": "0", "gyro_z": "0", "phase": "0"}


@query("s2_imu_rows", f"WITH {IMU} SELECT session_id, {_file_sql(t.IMU_FORMAT, lambda c: IMU_FILL.get(c, c))} FROM imu")
def imu_rows(spark, sf):
    return t.formatted(imu_samples(spark, sf).withColumnRenamed("t_ns", "t_elapsed_ns"), t.IMU_FORMAT)


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("s1_files_to_beats", f"""WITH RECURSIVE {LI}, {peaks_sql('li', False)} SELECT session_id, frame_idx, gidx, t_peak, {BEATS_R} FROM beats""")
def files_to_beats(spark, sf):
    path = _folder(spark, "frames")
    t.write_frames(line_frames(spark, sf).withColumn("elapsed_s", C("t_ms") / 1000.0), path)
    d = rounded(detect_beats(t.read_frames(spark, path)), *BEATS_COLS)
    return d.withColumn("session_id", C("session_id").cast("bigint"))


@query("s2_files_round_trip", f"WITH {IMU} SELECT session_id, frame_idx, t_ns, round(CAST(accel_x AS DOUBLE), 6) AS accel_x, round(CAST(accel_y AS DOUBLE), 6) AS accel_y, round(CAST(accel_z AS DOUBLE), 6) AS accel_z, vib_state, burst_id FROM imu")
def imu_round_trip(spark, sf):
    path = _folder(spark, "imu")
    t.write_imu(imu_samples(spark, sf).withColumnRenamed("t_ns", "t_elapsed_ns"), path)
    d = t.read_imu(spark, path).select("session_id", "frame_idx", "t_ns", "accel_x", "accel_y", "accel_z", "vib_state", "burst_id")
    return rounded(d.withColumn("session_id", C("session_id").cast("bigint")), "accel_x", "accel_y", "accel_z")


SCORE_SRC = ", src AS MATERIALIZED (SELECT session_id, beat_index, CASE WHEN ran = 1 THEN s ELSE 0 END AS s, CASE WHEN ran = 1 THEN d ELSE 0 END AS d, reason = 'ok' AS ok FROM sc), "
for _k, _name in (("M1", "s4_method_table_m1"), ("M3", "s5_method_table_m3"), ("M2", "s6_method_table_m2")):
    @query(_name, score_sql(_k, "", f"WITH RECURSIVE {BF}") + SCORE_SRC + post_sql("src", ["session_id"]))
    def method_table(spark, sf, k=_k):
        d = m.predict(feature_rows(spark, sf), k, feats()).select("session_id", "beat_index", (C("beat_index") * 800).alias("t_ms"), k)
        out = t.method_table(d, k)
        return out.select("session_id", "beat_index", *[F.round(c, 5).alias(c) for c in ("map_raw", "map_smoothed", "pp_smoothed", "sbp_smoothed", "dbp_calibrated")], "postprocess_applied")


@query("s7_raw_table", f"""WITH {EV}, i AS (SELECT session_id, frame_idx, ts_ms + 5400000 AS t_ms, green_raw AS ibi_ms FROM ev), f AS (SELECT session_id, ts_ms // 10000 AS t_ms, arg_min(green_raw, frame_idx) AS g FROM ev GROUP BY 1, 2),
j AS (SELECT session_id, frame_idx, t_ms // 10000 AS t_ms, ibi_ms FROM i), b AS (SELECT j.*, f.t_ms AS bt, f.g AS bg FROM j ASOF LEFT JOIN f ON j.session_id = f.session_id AND j.t_ms >= f.t_ms),
n AS (SELECT b.*, f.t_ms AS ft, f.g AS fg FROM b ASOF LEFT JOIN f ON b.session_id = f.session_id AND b.t_ms <= f.t_ms)
SELECT session_id, frame_idx, ibi_ms, coalesce(CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t_ms - bt <= ft - t_ms) THEN CASE WHEN t_ms - bt < 1000 THEN bg END ELSE CASE WHEN ft - t_ms < 1000 THEN fg END END, 0) AS green_near FROM n""")
def raw_table(spark, sf):
    e = event_frames(spark, sf).withColumn("green", C("green_raw"))
    ibi = e.select("session_id", "frame_idx", F.floor((C("ts_ms") + 5_400_000) / 10_000).alias("t_ms"), C("green_raw").alias("ibi_ms"))
    d = t.raw_table(ibi, e.withColumn("t_ms", F.floor(C("ts_ms") / 10_000)))
    return d.select("session_id", "frame_idx", "ibi_ms", "green_near")


@query("s8_ibi_table", f"""WITH {LI}, x AS (SELECT *, green_raw * 20 AS ibi_ms, lag(green_raw) OVER (PARTITION BY session_id ORDER BY frame_idx) AS p FROM li) SELECT session_id, frame_idx, ibi_ms, strftime(make_timestamp_ms(t_ms), '%Y-%m-%dT%H:%M:%S.%g') AS wall_time FROM x WHERE p IS NULL OR p <> green_raw""")
def ibi_table(spark, sf):
    d = t.ibi_table(line_frames(spark, sf).withColumn("ibi_ms", C("green_raw") * 20))
    return d.select("session_id", "frame_idx", "ibi_ms", "wall_time")


@query("s11_session_meta", f"""WITH {EV}, p AS (SELECT session_id, phase, min(ts_ms) AS a, max(ts_ms) AS b FROM ev GROUP BY 1, 2) SELECT session_id, '{{"session_id":' || session_id || ',"phase_timeline":[' ||
 string_agg('{{"phase":' || phase || ',"name":"' || ['placement', 'rest', 'cold', 'recovery'][phase + 1] || '","start_time_ms":' || a || ',"end_time_ms":' || b || '}}', ',' ORDER BY phase) || ']}}' AS json FROM p GROUP BY 1""")
def meta(spark, sf):
    spans = phase_spans(event_frames(spark, sf), "ts_ms").withColumn("name", phase_name("phase"))
    return t.timeline_json(spans).select("session_id", "json")


@query("s13_beat_events", f"""WITH {EV} SELECT session_id, frame_idx AS beat_index, '{{"event":"bp_beat","session_id":' || session_id || ',"beat_index":' || frame_idx || ',"timestamp_ms":' || ts_ms || ',"camera":{{"iso":' || iso || ',"exposure_time_ns":-1,"fps":30}},"rtbp":{{"sbp":0.0,"dbp":0.0,"postprocess_applied":0}},"sinbp_d":{{"sbp":0.0,"dbp":0.0,"postprocess_applied":0}},"sinbp_m":{{"sbp":0.0,"dbp":0.0,"postprocess_applied":0}}}}' AS json FROM ev""")
def beat_events(spark, sf):
    e = event_frames(spark, sf).select("session_id", C("frame_idx").alias("beat_index"), C("ts_ms").alias("t_ms"), "iso")
    return t.beat_events(e)


@query("s12_coefficients", "SELECT session_id, 9 AS n_models FROM (SELECT DISTINCT l_suppkey AS session_id FROM lineitem)")
def coefficients(spark, sf):
    from beatframe.operators.joins import with_coefficients
    rows = feature_rows(spark, sf).select("session_id").distinct().withColumn("method", F.explode(F.array(*[F.lit(k) for k in ("M1", "M2", "M3")])))
    return with_coefficients(rows, coefficient_fixture(spark), ["method"]).groupBy("session_id").agg(F.count("*").cast("int").alias("n_models"))


def _frames(spark, sf):
    return line_frames(spark, sf).withColumn("y_mean", C("green_raw") * 4).withColumn("vib_state", (C("frame_idx") % 3).cast("int")).withColumn(
        "phase", F.least(F.lit(3), F.floor(C("t_ms") / 6000)).cast("int"))


@query("s3_training_table")
def training(spark, sf):
    d = plan.training_table(_frames(spark, sf))
    keep = ["session_id", "beat_index", "frame_idx", "ibi_ms", "M1_SBP", "M1_reject_reason", "M2_SBP", "M2_reject_reason", "M3_SBP", "M3_reject_reason", "M1_map_smoothed",
            "M3_map_smoothed", "e_only_sbp", "e_only_map_smoothed", "local_a_sbp", "y_mean_median", "phase", "vib_duty_in_beat"]
    return d.select(*[r6(c).alias(c) if dict(d.dtypes)[c] == "double" else C(c) for c in keep])


