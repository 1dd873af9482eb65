"""Ingest of files that land in steps."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beatframe.streaming import landing


def land(folder, *names, text="a, b\n1, 2\n"):
    for n in names:
        Path(folder, n).parent.mkdir(parents=True, exist_ok=True)
        Path(folder, n).write_text(text)


def run(spark, folder, path):
    landing.ingest_landed(landing.landed_files(spark, str(folder), 3), str(path)).trigger(availableNow=True).start().awaitTermination()
    return {(r.session_id, r.has_imu) for r in landing.read_ledger(spark, str(path)).collect()}


def test_files_land_in_three_steps(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", tmp_path / "ledger"
    land(folder, "a_1_Wave_Data.csv", "a_1_Training_Data.csv", "a_1_IMU_Data.csv", "b_Wave_Data.csv", "notes.csv")
    land(folder, "c_Training_Data.csv", text="")
    assert run(spark, folder, path) == {("a_1", 1)}  # b waits for its second file, c is empty
    land(folder, "b_Training_Data.csv", "session_id=d/kind=Wave_Data/part-0.csv", "a_1_IMU_Data_late.csv")
    good = landing.write_part

    def fails(df, to, name, epoch):
        if name == "commits":
            raise OSError("lost before the commit")
        good(df, to, name, epoch)
    monkeypatch.setattr(landing, "write_part", fails)
    with pytest.raises(Exception):
        run(spark, folder, path)
    monkeypatch.setattr(landing, "write_part", good)
    assert {r.session_id for r in landing.read_ledger(spark, str(path)).collect()} == {"a_1"}  # written, not committed
    assert run(spark, folder, path) == {("a_1", 1), ("b", 0)}
    land(folder, "session_id=d/kind=Training_Data/part-0.csv", "b_IMU_Data.csv")
    both = run(spark, folder, path)
    assert both == {("a_1", 1), ("b", 1), ("d", 0)}  # a late sensor file is seen, the session is not taken again
    assert run(spark, folder, path) == both
    rows = landing.read_ledger(spark, str(path))
    assert rows.count() == 3


def test_files_of_many_sessions_are_written_by_many_tasks(spark, tmp_path):
    """Small rows aren't merged into one task that writes the files of all sessions one after another."""
    import re

    from beatframe.sources import tables as t

    frames = spark.range(0, 120, 1, 4).select((F.col("id") % 40).alias("session_id"), F.col("id").alias("elapsed_s"), F.lit(1.0).alias("green"))
    t.write_frames(frames, str(tmp_path / "out"))
    tasks = {re.match(r"part-(\d+)", p.name).group(1) for p in (tmp_path / "out").rglob("part-*.csv")}
    assert len(tasks) > 8
    assert t.read_frames(spark, str(tmp_path / "out")).count() == 120
