"""Recording files in and out: frame and sensor tables, method tables, metadata, coefficients, series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.models import ALPHA_MAP, ALPHA_PP, CALIBRATION, PRESSURE_DBP, PRESSURE_SBP
from ..functions.scalars import elapsed_s, sanitize_csv, wall_iso
from ..operators.chunks import KEY, cut, dense_index, floor_div
from .files import file_tasks, list_in_few_tasks, write_keyed

# File formats (column, decimals; None prints as is).
FRAME_FORMAT = (("elapsed_s", 3), ("green", 2), ("sin_wave", 2), ("y_mean", 2), ("u_mean", 2), ("v_mean", 2),
                ("contact_area", 2), ("touch_pressure", 4), ("touch_cx", 2), ("touch_cy", 2), ("touch_major", 2),
                ("touch_minor", 2), ("touch_valid", None), ("phase", None), ("press_target", 4), ("t_elapsed_ns", None),
                ("vib_state", None), ("burst_id", None), ("green_raw", 4))
FRAME_HEADER = ("経過時間_秒", "Green", "SinWave", "Y_mean", "U_mean", "V_mean", "contact_area", "touch_pressure", "touch_cx",
                "touch_cy", "touch_major", "touch_minor", "touch_valid", "phase", "press_target", "t_elapsed_ns", "vib_state",
                "burst_id", "green_raw")
IMU_FORMAT = (("t_elapsed_ns", None), ("accel_x", 6), ("accel_y", 6), ("accel_z", 6), ("gyro_x", 6), ("gyro_y", 6),
              ("gyro_z", 6), ("vib_state", None), ("burst_id", None), ("phase", None))
INTS = {"touch_valid", "phase", "vib_state", "burst_id"}
LONGS = {"t_elapsed_ns"}


def _schema(fmt) -> T.StructType:
    kind = lambda c: T.IntegerType() if c in INTS else T.LongType() if c in LONGS else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c, _ in fmt])


def _text(c: str, decimals: int | None, present: Sequence[str]) -> Column:
    value = F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0)
    if decimals is None:
        return value.cast("bigint").cast("string")
    return F.format_string(f"%.{decimals}f", value.cast("double"))


def formatted(df: DataFrame, fmt, header: Sequence[str] | None = None) -> DataFrame:
    """Fixed-decimal text columns in file order; missing values print as 0."""
    names = header or [c for c, _ in fmt]
    keep = [KEY] if KEY in df.columns else []
    return df.select(*keep, *[_text(c, d, df.columns).alias(n) for (c, d), n in zip(fmt, names)])


def _read(spark: SparkSession, path: str, fmt, kind: str) -> DataFrame:
    """Rows of ``session_id=<name>`` folders or of flat ``<name>_<kind>.csv`` files."""
    list_in_few_tasks(spark)
    d = spark.read.csv(path, schema=_schema(fmt), header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True,
                       pathGlobFilter="*.csv")
    file = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    folder = F.regexp_extract(file, r"session_id=([^/]+)/", 1)
    return d.withColumn(KEY, F.when(folder != "", folder).otherwise(F.regexp_extract(file, rf"([^/]+)_{kind}\.csv$", 1)))


def _write(df: DataFrame, path: str, fmt, header, order: str, mirror: str | None) -> None:
    """One folder per session; the file separator is a comma and a space.

    The formatted rows are stored once; with ``mirror`` they are written twice from there.
    """
    spark, text = df.sparkSession, formatted(df, fmt, header)
    cols = [c for c in text.columns if c != KEY]
    padded = text.select(KEY, cols[0], *[F.concat(F.lit(" "), F.col(c)).alias(f" {c}") for c in cols[1:]])
    padded = cut(padded.withColumn("_o", F.col(cols[0]).cast("double")))  # a sample finds the ranges; without this all before it runs twice
    padded = padded.repartitionByRange(file_tasks(spark), KEY, "_o")
    if mirror:
        padded = cut(padded.sortWithinPartitions(KEY, "_o"))
    for target in filter(None, (path, mirror)):
        write_keyed(padded, target, [KEY], ["_o"], "overwrite", ignoreLeadingWhiteSpace=False, quoteAll=False)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames as the detector takes them: file columns, ``t_ms``, ``t_ns`` and a dense ``frame_idx`` in time order."""
    d = cut(_read(spark, path, FRAME_FORMAT, "Wave_Data").withColumn(
        "t_ms", F.round(F.coalesce("elapsed_s", F.lit(0.0)) * 1000).cast("bigint")).withColumn("t_ns", F.col("t_elapsed_ns")))  # as in read_imu
    return dense_index(d, [F.col("t_ms"), F.col("t_ns")], floor_div(F.col("t_ms"), 60_000))


def write_frames(df: DataFrame, path: str, mirror: str | None = None) -> None:
    _write(df, path, FRAME_FORMAT, FRAME_HEADER, "elapsed_s", mirror)


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """Sensor samples: file columns, ``t_ns`` and a dense ``frame_idx`` in time order."""
    d = cut(_read(spark, path, IMU_FORMAT, "IMU_Data").withColumn("t_ns", F.coalesce("t_elapsed_ns", F.lit(0).cast("bigint"))))  # the index reads rows twice
    return dense_index(d, [F.col("t_ns")], floor_div(F.col("t_ns"), 60_000_000_000))


def write_imu(df: DataFrame, path: str, mirror: str | None = None) -> None:
    _write(df, path, IMU_FORMAT, None, "t_elapsed_ns", mirror)


def write_series(df: DataFrame, path: str, value: str, time: str, mirror: str | None = None) -> None:
    """Two-column value/time file."""
    text = df.select(F.format_string("%.2f", F.col(value).cast("double")).alias("value"), F.col(time).alias("time"))
    text = cut(text) if mirror else text
    for target in filter(None, (path, mirror)):
        text.write.mode("overwrite").option("header", True).csv(target)


# ---------------------------------------------------------------- method tables
def post_columns(method: str) -> list[Column]:
    a, b, c, d = CALIBRATION[method]
    return [F.lit(v).alias(n) for n, v in (("POST_map_a", a), ("POST_map_b", b), ("POST_pp_a", c), ("POST_pp_b", d),
                                          ("POST_alpha_map", ALPHA_MAP), ("POST_alpha_pp", ALPHA_PP))]


def method_table(beats: DataFrame, method: str, start_ms: Column | str | None = None) -> DataFrame:
    """Per-beat table of one method with its postprocess; ``*_process`` repeats the unsmoothed pressures.

    ``beats`` has beat_index, t_ms, and a struct ``<method>`` as made by ``models.predict``; further columns of the
    method (features, fits, window metrics) are passed through.
    """
    from ..functions.models import MODELS
    from ..operators.replay import POST, postprocess

    names = MODELS[method].features
    s = F.col(method)
    num = lambda f: F.coalesce(s[f], F.lit(0.0))
    extra = [c for c in beats.columns if c not in (KEY, "beat_index", "t_ms", "M1", "M2", "M3")]
    rows = beats.select(KEY, "beat_index", "t_ms", *extra, *[
        F.coalesce(F.get(s["used"], F.lit(i)), F.lit(0.0)).alias(f"{n}_used") for i, n in enumerate(names)],
        num("sbp").alias("sbp"), num("dbp").alias("dbp"), num("sbp").alias("sbp_process"), num("dbp").alias("dbp_process"),
        num("sbp").alias("sbp_raw"), num("dbp").alias("dbp_raw"), s["constraint_applied"].alias("constraint_applied"),
        s["clamp_applied"].alias("clamp_applied"), s["feature_clamp_applied"].alias("feature_clamp_applied"),
        s["output_valid"].alias("output_valid"), sanitize_csv(s["feature_clamp_reason"]).alias("feature_clamp_reason"),
        sanitize_csv(s["reject_reason"]).alias("reject_reason"))
    d = postprocess(rows, method)
    t0 = F.lit(0) if start_ms is None else F.col(start_ms) if isinstance(start_ms, str) else start_ms
    lead = [KEY, "beat_index", elapsed_s("t_ms", t0).alias("elapsed_s")]
    rest = [c for c in d.columns if c not in (KEY, "beat_index", "t_ms", *POST, "postprocess_applied")]
    return d.select(*lead, *rest, *POST, "postprocess_applied", *post_columns(method))


def ibi_table(rows: DataFrame) -> DataFrame:
    """Interval rows without consecutive repeats."""
    from ..operators.detect import drop_repeats
    keep = [c for c in ("ibi_ms", "bpm_sd", "smoothed_ibi_ms", "smoothed_bpm", "t_ms") if c in rows.columns]
    d = drop_repeats(rows, "ibi_ms")
    return d.select(KEY, "frame_idx", *keep, *([wall_iso("t_ms").alias("wall_time")] if "t_ms" in keep else []))


def raw_table(ibi: DataFrame, frames: DataFrame, start_ms: int = 0) -> DataFrame:
    """Every interval row with the value of the nearest frame less than 1 s away (0 otherwise)."""
    from ..operators.joins import asof_nearest
    f = frames.select(KEY, "t_ms", F.col("green").alias("green_near"), F.col("frame_idx").alias("_first"))
    d = asof_nearest(ibi, f, "t_ms", ["green_near"], tol=1000, first=["_first"])
    return d.withColumn("elapsed_s", elapsed_s("t_ms", F.lit(start_ms))).withColumn(
        "green_near", F.coalesce("green_near", F.lit(0.0)))


# ---------------------------------------------------------------- metadata and coefficients
META = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("subject_id", T.StringType()),
    T.StructField("session_number", T.IntegerType()), T.StructField("mode", T.IntegerType()),
    T.StructField("recording_start_time_ms", T.LongType()), T.StructField("recording_end_time_ms", T.LongType()),
    T.StructField("completed", T.BooleanType()), T.StructField("app_version", T.StringType()),
    T.StructField("coefficient_version", T.StringType()), T.StructField("clock", T.StringType()),
    T.StructField("selftest", T.MapType(T.StringType(), T.StringType())),
    T.StructField("vibration", T.MapType(T.StringType(), T.StringType())),
    T.StructField("imu", T.MapType(T.StringType(), T.StringType())),
    T.StructField("quality_gate", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.MapType(T.StringType(), T.StringType())),
    T.StructField("phase_timeline", T.ArrayType(T.StructType([
        T.StructField("phase", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("start_time_ms", T.LongType()), T.StructField("end_time_ms", T.LongType())])))])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).json(path, multiLine=True)


def write_meta(meta: DataFrame, path: str) -> None:
    meta.select(F.to_json(F.struct(*meta.columns)).alias("value")).write.mode("overwrite").text(path)


def timeline_json(timeline: DataFrame) -> DataFrame:
    """Four-row phase timelines folded into one metadata array per session."""
    spans = F.array_sort(F.collect_list(F.struct("phase", "name", "start_time_ms", "end_time_ms")))
    return timeline.groupBy(KEY).agg(spans.alias("phase_timeline")).withColumn(
        "json", F.to_json(F.struct(KEY, "phase_timeline")))


# Keys of the coefficient file.
SERIES_KEYS = {"INITIAL_BASELINE": "experimental_smartphone_initial_baseline",
               "RICH_BASELINE": "experimental_smartphone_rich_baseline",
               "SHARED_D_BASELINE": "experimental_smartphone_shared_sinbpd_baseline"}
BLEND_KEY = "experimental_smartphone_rich_dynamic_blend"
METHOD_KEYS = {"M1": "RTBP", "M2": "SinBP_D", "M3": "SinBP_M"}
_NUMS = T.ArrayType(T.DoubleType())
_ADAPTIVE = T.StructType([
    T.StructField("feature_names", T.ArrayType(T.StringType())), T.StructField("summary_source_columns", T.ArrayType(T.StringType())),
    T.StructField("initial_baseline_beats", T.IntegerType()), T.StructField("baseline_shrinkage", T.DoubleType()),
    T.StructField("population_MAP_anchor", T.DoubleType()), T.StructField("population_PP_anchor", T.DoubleType()),
    T.StructField("baseline_MAP", _NUMS), T.StructField("baseline_PP", _NUMS), T.StructField("delta_MAP", _NUMS),
    T.StructField("delta_PP", _NUMS)])
_MODEL = T.StructType([
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("MAP", _NUMS), T.StructField("PP", _NUMS),
    T.StructField("residual_features", T.ArrayType(T.StringType())), T.StructField("residual_MAP", _NUMS),
    T.StructField("residual_PP", _NUMS)])
_GAINS = T.MapType(T.StringType(), T.DoubleType())
_BLEND = T.StructType([
    T.StructField("dynamic_anchor_beats", T.IntegerType()), T.StructField("dynamic_gain_MAP", T.DoubleType()),
    T.StructField("dynamic_gain_PP", T.DoubleType()), T.StructField("dynamic_gain_MAP_by_method", _GAINS),
    T.StructField("dynamic_gain_PP_by_method", _GAINS)])
COEFFICIENT_FILE = T.StructType(
    [T.StructField(k, T.MapType(T.StringType(), _ADAPTIVE)) for k in SERIES_KEYS.values()]
    + [T.StructField("models", T.MapType(T.StringType(), _MODEL)), T.StructField(BLEND_KEY, _BLEND)])


def load_coefficients(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict, dict]:
    """Baseline coefficients as rows, the dynamic models and the blend settings of one JSON file.

    The rows are None when any group, method or required list is missing: a replay then gives empty series.
    """
    raw = spark.read.schema(COEFFICIENT_FILE).json(path, multiLine=True)
    rows, complete = None, True
    for series, key in SERIES_KEYS.items():
        for m, name in METHOD_KEYS.items():
            g = F.col(key)[name]
            d = raw.select(
                F.lit(series).alias("series"), F.lit(m).alias("method"), g["feature_names"].alias("feature_names"),
                g["summary_source_columns"].alias("summary_source_columns"),
                F.coalesce(g["initial_baseline_beats"], F.lit(30)).alias("initial_baseline_beats"),
                F.coalesce(g["baseline_shrinkage"], F.lit(1.0)).alias("baseline_shrinkage"),
                F.coalesce(g["population_MAP_anchor"], F.lit(0.0)).alias("population_map_anchor"),
                F.coalesce(g["population_PP_anchor"], F.lit(0.0)).alias("population_pp_anchor"),
                g["baseline_MAP"].alias("baseline_map"), g["baseline_PP"].alias("baseline_pp"),
                g["delta_MAP"].alias("delta_map"), g["delta_PP"].alias("delta_pp"))
            rows = d if rows is None else rows.unionByName(d)
    needed = ("feature_names", "summary_source_columns", "baseline_map", "baseline_pp", "delta_map", "delta_pp")
    full = rows.dropna(subset=list(needed))
    complete = full.count() == len(SERIES_KEYS) * len(METHOD_KEYS)  # nine rows of one file
    head = raw.select("models", BLEND_KEY).first()
    models = {}
    for m, name in METHOD_KEYS.items():
        x = (head["models"] or {}).get(name) if head else None
        if x is not None:
            models[m] = ({"features": x["residual_features"], "residual_map": x["residual_MAP"], "residual_pp": x["residual_PP"]}
                         if m == "M2" else {"features": x["features"], "map": x["MAP"], "pp": x["PP"]})
    back = {v: k for k, v in METHOD_KEYS.items()}
    b = head[BLEND_KEY].asDict(recursive=True) if head and head[BLEND_KEY] else {}
    blend = {k: ({back[n]: g for n, g in v.items() if n in back and g == g and abs(g) != float("inf")} if isinstance(v, dict) else v)
             for k, v in b.items() if v is not None and (isinstance(v, dict) or (v == v and abs(v) != float("inf")))}
    return (full if complete else None), models, blend


def load_linear_coefs(spark: SparkSession, path: str) -> tuple[tuple, tuple]:
    """Two comma-separated lines of three numbers; the defaults stay for whatever cannot be read."""
    try:
        lines = [r.value for r in spark.read.text(path).limit(2).collect()]
    except Exception:  # a missing file keeps the defaults
        return PRESSURE_SBP, PRESSURE_DBP
    out = [list(PRESSURE_SBP), list(PRESSURE_DBP)]
    if len(lines) == 2:
        parts = [line.split(",") for line in lines]
        try:
            for i in range(3):
                for j in range(2):
                    out[j][i] = float(parts[j][i])
        except (ValueError, IndexError):
            pass
    return tuple(out[0]), tuple(out[1])


# ---------------------------------------------------------------- beat events
def beat_events(beats: DataFrame, fps: int = 30) -> DataFrame:
    """One JSON event per beat with camera settings and the three methods' displayed pressures."""
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in beats.columns else F.lit(d)
    camera = F.struct(get("iso", -1).alias("iso"), get("exposure_time_ns", -1).alias("exposure_time_ns"), F.lit(fps).alias("fps"))

    def method(name: str) -> Column:
        if name not in beats.columns:
            return F.struct(F.lit(0.0).alias("sbp"), F.lit(0.0).alias("dbp"), F.lit(0).alias("postprocess_applied"))
        s = F.col(name)
        return F.struct(F.coalesce(s["sbp"], F.lit(0.0)).alias("sbp"), F.coalesce(s["dbp"], F.lit(0.0)).alias("dbp"),
                        F.coalesce(s["output_valid"], F.lit(0)).alias("postprocess_applied"))

    body = F.struct(F.lit("bp_beat").alias("event"), F.col(KEY), F.col("beat_index"), F.col("t_ms").alias("timestamp_ms"),
                    camera.alias("camera"), method("M1").alias("rtbp"), method("M2").alias("sinbp_d"),
                    method("M3").alias("sinbp_m"))
    return beats.select(KEY, "beat_index", F.to_json(body).alias("json"))


