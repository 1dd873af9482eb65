"""Streaming operators run over the events table as it becomes available."""

import uuid

from pyspark.sql import functions as F

from beatframe.functions.scalars import utc_timestamp
from beatframe.operators.chunks import ensure_checkpoint_dir
from beatframe.sources import files, tables as t
from beatframe.streaming import commits, landing, live, sessions
from .base import EV, LI, query, r6, rounded, table
from .model_queries import score_sql
from .signal_queries import BEATS_COLS, BEATS_R, EXT3, KEPT, peaks_sql

C = F.col
YEARS = 1e9  # the events of a user lie hours apart and count as one session


def last_sign(spark, sf):
    """Folder with one keep-alive a day after the last event: it moves the watermark past every frame."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/sign-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    e.agg(*[(F.max(c) + F.expr("INTERVAL 1 DAY") if c == "ts" else F.lit(None)).cast(e.schema[c].dataType).alias(c) if c != "user_id"
            else F.max(c).alias(c) for c in e.columns]).write.parquet(path)
    return path


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    e = e.unionByName(spark.readStream.schema(schema).parquet(last_sign(spark, sf)))
    return e.select(C("user_id").alias("session_id"), utc_timestamp("ts").alias("ts"), "event_id", C("value").alias("green_raw"),
                    (F.regexp_extract("props", r'"k": (\d+)', 1).cast("int") * 10).alias("iso"))


@query("x1_x2_x8_stream_beats", f"WITH RECURSIVE {EV}, {peaks_sql('ev', True)} SELECT session_id, frame_idx, gidx, t_peak, {BEATS_R} FROM beats")
def stream_beats(spark, sf):
    d = live.run_available(live.stream_beats(event_stream(spark, sf), tie="event_id", idle=YEARS))
    return rounded(d, *BEATS_COLS)


@query("x3_stream_events", f"""WITH RECURSIVE {EV}, {peaks_sql('ev', True)} SELECT session_id, gidx AS beat_index, '{{"event":"bp_beat","session_id":' || session_id || ',"beat_index":' || gidx || ',"timestamp_ms":' || t_peak || '}}' AS json FROM beats""")
def stream_events(spark, sf):
    b = live.stream_beats(event_stream(spark, sf), tie="event_id", idle=YEARS)
    e = t.beat_events(b.select("session_id", C("gidx").alias("beat_index"), C("t_peak").alias("t_ms")))
    d = live.run_available(e)
    return d.select("session_id", "beat_index", F.concat(F.regexp_extract("json", r"^(.*?),\"camera\"", 1), F.lit("}")).alias("json"))


@query("x5_latest_state", "SELECT user_id AS session_id, epoch_us(ts) // 600000000 * 600 AS start_s, count(*) AS n, arg_max(value, ts) AS green_raw FROM events GROUP BY 1, 2")
def latest(spark, sf):
    d = live.run_available(live.latest_state(event_stream(spark, sf), "600 seconds"))
    return d.select("session_id", F.unix_seconds("start").alias("start_s"), "n", "green_raw")


@query("x6_finish_sessions", """WITH a AS (SELECT user_id AS session_id, ts, value, CASE WHEN ts - lag(ts) OVER u < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT session_id, epoch_us(min(ts)) AS started_us, count(*) AS n_frames, arg_max(value, ts) AS last_green FROM g GROUP BY session_id, k""")
def finish(spark, sf):
    d = live.run_available(live.finish_sessions(event_stream(spark, sf), "4 hours"))
    return d.select("session_id", F.unix_micros("started").alias("started_us"), "n_frames", "last_green")


# ---------------------------------------------------------------- whole sessions in typed state
PARTS, YEAR_S = 5, 365 * 86_400


def line_stream(spark, sf):
    """lineitem as a feed: time-ordered Parquet parts, one after another, and a keep-alive two years later; frames and the delay of the watermark."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}"
    li = table(spark, sf, "lineitem")
    at = F.unix_micros(C("l_shipdate").cast("timestamp")) + C("l_orderkey") * 8 + C("l_linenumber")
    d = li.select(C("l_suppkey").alias("session_id"), F.timestamp_micros(at).alias("ts"), (C("l_partkey") * 1_000_000_000 + F.round(C("l_extendedprice") * 100).cast("bigint")).alias("tie"),
                  C("l_quantity").cast("double").alias("green_raw"))
    lo, hi = d.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = (hi - lo) // PARTS + 1
    for k in range(PARTS):
        d.where((F.unix_micros("ts") >= lo + k * step) & (F.unix_micros("ts") < lo + (k + 1) * step)).write.mode("append").parquet(path)
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    d.limit(1).withColumn("ts", F.timestamp_micros(F.lit(hi + step + 2 * YEAR_S * 1_000_000))).withColumn("green_raw", F.lit(None).cast("double")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", max(1, files // PARTS)).parquet(path)
    return stream, f"{step // 1_000_000 + 1} seconds"


def session_rows(spark, sf):
    sessions.use_typed_state(spark)
    stream, delay = line_stream(spark, sf)
    return sessions.stream_sessions(stream, tie="tie", watermark=delay, idle=YEAR_S)


MORPH_SQL = f"""{KEPT},
m0 AS (SELECT session_id, frame_idx, max(ibi_ms) AS ibi, max(amp) FILTER (WHERE kind = 'v2p') AS va, max(dt) FILTER (WHERE kind = 'v2p') AS vd, max(amp) FILTER (WHERE kind = 'p2v') AS pa,
 max(dt) FILTER (WHERE kind = 'p2v') AS pd FROM kept WHERE hit GROUP BY 1, 2),
m1 AS (SELECT session_id, frame_idx, ibi, coalesce(last_value(va IGNORE NULLS) OVER u, 0) AS va, last_value(vd IGNORE NULLS) OVER u AS vd,
 last_value(pd IGNORE NULLS) OVER u AS pd FROM m0 WINDOW u AS (PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
mo AS (SELECT session_id, frame_idx, va, CASE WHEN vd IS NULL THEN 0.0 ELSE -least(0.95, vd / ibi) END AS vr, CASE WHEN pd IS NULL THEN 0.0 ELSE -least(0.95, pd / ibi) END AS pr FROM m1)"""
#: Frames with the state of the detector, the pairs found under it, and the timing model at every beat.
LIVE = f"""{LI}, {peaks_sql('li', False)},
fs0 AS (SELECT c4.*, b.ibi_ms AS nb, b.smoothed_ibi_ms AS ns FROM c4 LEFT JOIN beats b ON b.session_id = c4.session_id AND b.frame_idx = c4.frame_idx),
fs AS (SELECT * EXCLUDE (nb, ns), nb IS NOT NULL AS is_beat, coalesce(last_value(nb IGNORE NULLS) OVER u, 0.0) AS ibi_ms, coalesce(last_value(ns IGNORE NULLS) OVER u, 0.0) AS sm
 FROM fs0 WINDOW u AS (PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
{EXT3.replace("600.0 + frame_idx % 300 AS ibi_ms, ", "").replace("FROM c4 WINDOW", "FROM fs WINDOW").replace("FROM x2)", "FROM x2 WHERE NOT is_beat)")}, {MORPH_SQL},
br AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) AS beat_index FROM (
 SELECT session_id, frame_idx, t_ms, ibi_ms, sm, is_beat, lag(ibi_ms) OVER (PARTITION BY session_id ORDER BY frame_idx) AS old FROM fs) WHERE old IS DISTINCT FROM ibi_ms),
bf AS (SELECT b.session_id, b.frame_idx, coalesce(mo.va, 0.0) AS A, 60000.0 / CASE WHEN b.smoothed_before > 0 THEN b.smoothed_before ELSE b.interval_ms END AS HR,
 coalesce(mo.vr, 0.0) AS V2P, coalesce(mo.pr, 0.0) AS P2V FROM beats b ASOF LEFT JOIN mo ON mo.session_id = b.session_id AND b.frame_idx > mo.frame_idx)"""


@query("x2_stream_scores", score_sql("M1", "", f"WITH RECURSIVE {LIVE}") + """ SELECT br.session_id, br.beat_index, br.frame_idx, br.t_ms, round(br.ibi_ms, 6) AS ibi_ms, round(br.sm, 6) AS smoothed_ibi_ms,
 round(sc.A, 6) AS v2p_amp, round(sc.V2P, 6) AS v2p_rel, round(sc.P2V, 6) AS p2v_rel, round(sc.HR, 6) AS hr, sc.reason AS reject_reason, round(CASE WHEN ran = 1 THEN s END, 6) AS sbp,
 round(CASE WHEN ran = 1 THEN d END, 6) AS dbp FROM br LEFT JOIN sc ON sc.session_id = br.session_id AND sc.frame_idx = br.frame_idx""")
def stream_scores(spark, sf):
    d = sessions.score_rows(live.run_available(session_rows(spark, sf)), ("M1",))
    r = C("m1_row")
    return d.select("session_id", "beat_index", "frame_idx", "t_ms", *[r6(c).alias(c) for c in ("ibi_ms", "smoothed_ibi_ms")], *[r6(r[c]).alias(c) for c in ("v2p_amp", "v2p_rel", "p2v_rel", "hr")],
                    r["M1"]["reject_reason"].alias("reject_reason"), r6(r["M1"]["sbp"]).alias("sbp"), r6(r["M1"]["dbp"]).alias("dbp"))


@query("x6_final_tables", score_sql("M1", "", f"WITH RECURSIVE {LIVE}") + """ SELECT f.session_id, f.n_frames, coalesce(b.n_beats, 0) AS n_beats, r.n_rows, r.n_rows AS n_ibi, r.n_rows AS n_method,
 round(r.last_smoothed_ms, 6) AS last_smoothed_ms, coalesce(b.n_valid, 0) AS n_valid, round(coalesce(b.sum_sbp, 0.0), 4) AS sum_sbp FROM (SELECT session_id, count(*) AS n_frames FROM li GROUP BY 1) f
 JOIN (SELECT br.session_id, count(*) AS n_rows, any_value(z.z) AS last_smoothed_ms FROM br JOIN (SELECT session_id, max_by(sm, frame_idx) AS z FROM fs GROUP BY 1) z ON z.session_id = br.session_id GROUP BY 1) r
 ON r.session_id = f.session_id LEFT JOIN (SELECT x.session_id, count(*) AS n_beats, sum(CASE WHEN br.frame_idx IS NOT NULL AND x.ran = 1 AND x.reason = 'ok' THEN 1 ELSE 0 END) AS n_valid,
 sum(CASE WHEN br.frame_idx IS NOT NULL AND x.ran = 1 THEN x.s END) AS sum_sbp FROM sc x LEFT JOIN br ON br.session_id = x.session_id AND br.frame_idx = x.frame_idx GROUP BY 1) b ON b.session_id = f.session_id""")
def final_tables(spark, sf):
    rows = session_rows(spark, sf)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
    commits.save_sessions(rows, f"{path}/out", f"{path}/progress", tables=("ibi", "method_M1")).trigger(availableNow=True).start().awaitTermination()
    read = lambda name: commits.read_committed(spark, f"{path}/out", name)
    ends = read("ends").select("session_id", C("started_us"), "n_frames", "n_beats", "n_rows", r6("last_smoothed_ms").alias("last_smoothed_ms"))
    ends = ends.withColumn("id", F.concat_ws("@", C("session_id").cast("string"), C("started_us").cast("string")))
    meth = read("method_M1").groupBy(C("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_method"), F.count_if(C("output_valid") == 1).alias("n_valid"), F.round(F.sum("sbp"), 4).alias("sum_sbp"))
    ibi = read("ibi").groupBy(C("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_ibi"))
    return ends.join(ibi, "id").join(meth, "id").drop("id", "started_us")


@query("d15_landed_files", """WITH l AS (SELECT user_id AS session_id, CASE event_type WHEN 'click' THEN 'Wave_Data' WHEN 'view' THEN 'Training_Data' ELSE 'IMU_Data' END AS kind FROM events WHERE value > 60)
SELECT session_id, max(CASE WHEN kind = 'IMU_Data' THEN 1 ELSE 0 END) AS has_imu FROM l GROUP BY 1 HAVING bool_or(kind = 'Wave_Data') AND bool_or(kind = 'Training_Data')""")
def landed(spark, sf):
    """Events written as files of their sessions and kinds, listed as a stream and taken into a ledger."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").where("value > 60").withColumn("kind", F.expr("CASE event_type WHEN 'click' THEN 'Wave_Data' WHEN 'view' THEN 'Training_Data' ELSE 'IMU_Data' END"))
    e = e.select(C("user_id").alias("session_id"), "kind", "event_id", "value").repartition(files.file_tasks(spark), "session_id", "kind")
    files.write_keyed(e, f"{base}/in", ["session_id", "kind"])
    landing.ingest_landed(landing.landed_files(spark, f"{base}/in"), f"{base}/ledger").trigger(availableNow=True).start().awaitTermination()
    return landing.read_ledger(spark, f"{base}/ledger").select(C("session_id").cast("bigint").alias("session_id"), "has_imu")
