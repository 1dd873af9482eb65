"""Registry, table access and the mapping of the given tables onto recordings (same meaning in Spark and SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beatframe.functions.scalars import burst_state, epoch_ms
from beatframe.operators.chunks import dense_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- recordings
def event_frames(spark, sf) -> DataFrame:
    """events as short sessions: one per user, in time order."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.col("value").alias("green_raw"),
        (F.regexp_extract("props", r'"k": (\d+)', 1).cast("int") * 10).alias("iso"),
        F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END").alias("phase"))
    d = dense_index(e, [F.col("ts"), F.col("event_id")], F.floor(F.unix_date(F.col("ts").cast("date")) / 7))
    return d.select("session_id", "frame_idx", "green_raw", "iso", "phase",
                    F.floor(F.col("frame_idx") * 1000 / 30).cast("bigint").alias("t_ms"), epoch_ms("ts").alias("ts_ms"))


EV = """ev AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
 value AS green_raw, 10 * CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS iso,
 CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS phase,
 CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 1000 / 30) AS BIGINT) AS t_ms,
 epoch_us(ts) // 1000 AS ts_ms FROM events)"""


def line_rows(spark, sf, *cols: str, session: Column | None = None) -> DataFrame:
    """lineitem as long sessions: one per supplier, in ship order, with a dense frame index."""
    li = table(spark, sf, "lineitem").withColumn("session_id", F.col("l_suppkey") if session is None else session)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    keep = li.select("session_id", *order, *cols)
    return dense_index(keep, [F.col(c) for c in order], F.year("l_shipdate") * 12 + F.month("l_shipdate")).drop(*order)


LINES = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"  # a total order of lineitem
LI_ORDER = f"PARTITION BY l_suppkey {LINES}"


def line_frames(spark, sf) -> DataFrame:
    return line_rows(spark, sf, "l_quantity").select(
        "session_id", "frame_idx", F.col("l_quantity").alias("green_raw"),
        F.floor(F.col("frame_idx") * 1000 / 30).cast("bigint").alias("t_ms"))


LI = f"""li AS (SELECT l_suppkey AS session_id, row_number() OVER ({LI_ORDER}) - 1 AS frame_idx, l_quantity AS green_raw,
 CAST(floor((row_number() OVER ({LI_ORDER}) - 1) * 1000 / 30) AS BIGINT) AS t_ms FROM lineitem)"""


def imu_samples(spark, sf) -> DataFrame:
    """lineitem as ten motion-sensor sessions at 400 Hz, many motor cycles each."""
    d = line_rows(spark, sf, "l_quantity", "l_discount", "l_tax", session=F.col("l_suppkey") % 10)
    ms = F.floor(F.col("frame_idx") * 2.5).cast("bigint")
    b = burst_state(ms)
    return d.select("session_id", "frame_idx", (F.col("frame_idx") * 2_500_000).alias("t_ns"),
                    F.col("l_quantity").cast("float").alias("accel_x"), (F.col("l_discount") * 100).cast("float").alias("accel_y"),
                    (F.col("l_tax") * 100).cast("float").alias("accel_z"), b["state"].alias("vib_state"),
                    b["cycle"].alias("burst_id"))


IMU_ORDER = f"PARTITION BY l_suppkey % 10 {LINES}"
IMU = f"""im0 AS (SELECT l_suppkey % 10 AS session_id, row_number() OVER ({IMU_ORDER}) - 1 AS frame_idx, CAST(l_quantity AS FLOAT) AS accel_x,
 CAST(l_discount * 100 AS FLOAT) AS accel_y, CAST(l_tax * 100 AS FLOAT) AS accel_z FROM lineitem),
im1 AS (SELECT *, frame_idx * 2500000 AS t_ns, CAST(floor(frame_idx * 2.5) AS BIGINT) AS ms FROM im0),
imu AS (SELECT session_id, frame_idx, t_ns, accel_x, accel_y, accel_z, CASE WHEN ms % 2100 < 1500 THEN 0 WHEN ms % 2100 < 1550 THEN 2
 WHEN ms % 2100 < 2050 THEN 1 ELSE 2 END AS vib_state, ms // 2100 AS burst_id FROM im1)"""

FEATURES = {"A": "0.5 + l_quantity / 5", "HR": "50 + 600 * l_discount", "V2P": "-(0.3 + 8 * l_tax)",
            "P2V": "-(0.25 + (l_quantity % 10) / 15)", "E": "60 * l_discount"}


def feature_rows(spark, sf, indexed: bool = True) -> DataFrame:
    """Beat features from lineitem; without an index the rows stay where they were read."""
    cols = ("l_quantity", "l_discount", "l_tax")
    exprs = [F.expr(v).alias(k) for k, v in FEATURES.items()]
    if not indexed:
        li = table(spark, sf, "lineitem")
        return li.select(F.col("l_suppkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", *exprs)
    d = line_rows(spark, sf, *cols)
    return d.select("session_id", (F.col("frame_idx") + 1).alias("beat_index"), (F.col("session_id") % 10).alias("subject"),
                    *exprs)


_F_SQL = ", ".join(f"{v} AS {k}" for k, v in FEATURES.items())
BF = (f"bf AS (SELECT l_suppkey AS session_id, row_number() OVER ({LI_ORDER}) AS beat_index, l_suppkey % 10 AS subject, {_F_SQL} "
      "FROM lineitem)")
BF0 = f"bf AS (SELECT l_suppkey AS session_id, l_orderkey, l_linenumber, l_partkey, {_F_SQL} FROM lineitem)"
ROW = ["session_id", "l_orderkey", "l_linenumber", "l_partkey"]
ROWS = ", ".join(ROW)


def reference_bp(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 100).alias("session_id"), F.col("o_orderkey"), epoch_ms("o_orderdate").alias("t_ms"),
                    (90 + F.col("o_totalprice") % 60).alias("sbp"),
                    (90 + F.col("o_totalprice") % 60 - 20 - F.col("o_totalprice") % 40).alias("dbp"))


REF = """ref AS (SELECT o_custkey % 100 AS session_id, o_orderkey, epoch_us(o_orderdate) // 1000 AS t_ms, 90 + o_totalprice % 60 AS sbp,
 90 + o_totalprice % 60 - 20 - o_totalprice % 40 AS dbp FROM orders)"""


def pixels(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("frame_idx"), F.posexplode("embedding").alias("i", "e")).select(
        "frame_idx", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        F.floor(128 + 127 * F.col("e").cast("double")).cast("int").alias("yv"), F.lit(8).alias("width"), F.lit(8).alias("height"))


PX = """px AS (SELECT vec_id AS frame_idx, (i - 1) % 8 AS x, CAST((i - 1) // 8 AS INT) AS y,
 CAST(floor(128 + 127 * CAST(embedding[i] AS DOUBLE)) AS INT) AS yv FROM embeddings, range(1, 65) t(i))"""


def steps(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("step"),
                    (F.col("event_id") % 2).cast("int").alias("a1"), (F.floor(F.col("event_id") / 2) % 2).cast("int").alias("a2"),
                    (F.col("event_id") % 4).cast("int").alias("a3"), (F.col("event_id") % 16).cast("int").alias("a4"),
                    (600 + F.col("value")).alias("ibi_ms"))


ST = """st AS (SELECT user_id AS session_id, event_id AS step, CAST(event_id % 2 AS INT) AS a1, CAST((event_id // 2) % 2 AS INT) AS a2,
 CAST(event_id % 4 AS INT) AS a3, CAST(event_id % 16 AS INT) AS a4, 600 + value AS ibi_ms FROM events)"""
