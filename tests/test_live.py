"""Streams against batch, snapshots, whole plans."""

import glob

from pyspark.sql import functions as F

from beatframe.operators import detect as det
from beatframe.plans import session as plan
from beatframe.streaming import live


def write_part(d, path, shuffle=False):
    (d.orderBy(F.rand(3)) if shuffle else d).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, frames, path, parts, shuffle=False, swap=0):
    """A feed of files, one micro-batch each, and a keep-alive at the end; ``swap`` frames at each cut change sides."""
    d = frames.withColumn("ts", F.timestamp_millis(F.col("t_ms") + 1_700_000_000_000))
    n = d.count()
    near = F.pmod(F.col("frame_idx"), F.lit(2 * swap + 1)) - swap if swap else F.lit(0)
    at = F.least(F.greatest(F.col("frame_idx") + near, F.lit(0)), F.lit(n - 1))
    for k in range(parts):
        write_part(d.where((at >= k * n // parts) & (at < (k + 1) * n // parts)), path, shuffle)
    late = d.orderBy(F.desc("frame_idx")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    write_part(late.withColumn("green_raw", F.lit(None).cast("double")), path)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)


def key(rows):
    return sorted((r.frame_idx, r.t_peak, round(r.ibi_ms, 9), round(r.smoothed_ibi_ms, 9)) for r in rows)


def test_stream_equals_batch(spark, wave, tmp_path):
    frames = wave("step_hr")
    want = key(det.detect_beats(frames).collect())
    for shuffle in (False, True):
        s = stream_of(spark, frames, str(tmp_path / f"in{shuffle}"), 5, shuffle)
        assert key(live.run_available(live.stream_beats(s)).collect()) == want


def test_stream_keeps_the_frame_clock(spark, wave, tmp_path):
    frames = wave("sine75").withColumn("t_ms", F.floor(F.col("frame_idx") * 1000 / 24).cast("bigint")).where("frame_idx <> 301")
    frames = frames.withColumn("frame_idx", F.col("frame_idx") - (F.col("frame_idx") > 301).cast("int"))
    got = key(live.run_available(live.stream_beats(stream_of(spark, frames, str(tmp_path / "in"), 4))).collect())
    assert got == key(det.detect_beats(frames).collect())
    assert abs(sorted(r[2] for r in got)[len(got) // 2] - 1000) < 2


def test_frames_swapped_across_batches(spark, wave, tmp_path):
    frames = wave("step_hr")
    want = key(det.detect_beats(frames).collect())
    s = stream_of(spark, frames, str(tmp_path / "in"), 6, True, swap=60)
    assert key(live.run_available(live.stream_beats(s)).collect()) == want


def test_idle_sessions_leave_the_state(spark, wave, tmp_path):
    early = wave("sine60", 300)
    again = early.withColumn("t_ms", F.col("t_ms") + 3_600_000).withColumn("frame_idx", F.col("frame_idx") + 300)
    s = stream_of(spark, early.unionByName(again), str(tmp_path / "in"), 2)
    q = live.stream_beats(s, idle=60.0).writeStream.format("memory").queryName("idle").option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    once = key(det.detect_beats(early).collect())
    got = spark.table("idle").collect()
    assert sorted(r.frame_idx for r in got) == sorted([r[0] for r in once] * 2)


def test_autosave(spark, wave, tmp_path):
    s = stream_of(spark, wave("sine60"), str(tmp_path / "in"), 3)
    q = live.autosave(live.stream_beats(s), str(tmp_path / "out"), str(tmp_path / "ckpt"), every=5).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "beats")).count() == 18
    snap = spark.read.parquet(str(tmp_path / "out" / "snapshot"))
    batches = spark.read.parquet(str(tmp_path / "out" / "beats")).groupBy("batch").count().orderBy("batch").collect()
    total, want = 0, 0
    for r in batches:  # the snapshot holds what was there at the last batch that passed a multiple of five
        want = total + r["count"] if (total + r["count"]) // 5 > total // 5 else want
        total += r["count"]
    assert len(batches) > 1 and snap.count() == want and glob.glob(str(tmp_path / "out" / "snapshot" / "session_id=sine60"))


def test_training_table(spark, wave):
    frames = wave("step_hr").withColumn("y_mean", F.lit(100.0)).withColumn("vib_state", F.lit(1)).withColumn("phase", F.lit(1))
    rows = plan.training_table(frames).orderBy("beat_index").collect()
    assert rows[0].beat_index == 1 and rows[0].ibi_ms == 0.0 and rows[0].M1_reject_reason == "missing"
    assert all(r.M1_SBP == r.M1_SBP_process for r in rows)
    assert rows[1].y_mean_median == 100.0 and rows[1].vib_duty_in_beat == 1.0
    assert len(rows[0].asDict()) > 300


def test_entry(spark):
    import __spark_entry__ as e
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 120
    assert e.entry(spark).count() > 0
