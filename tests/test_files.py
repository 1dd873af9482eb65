"""Small files by key: the same as Spark's own writer puts, without a process for each file."""

from pyspark.sql import functions as F

from beatframe.sources import files
from beatframe.streaming import landing


def contents(folder):
    out = {}
    for p in sorted(folder.rglob("part-*.csv")):
        out.setdefault(str(p.parent.relative_to(folder)), []).append(p.read_text(encoding="utf-8"))
    return {k: sorted(v) for k, v in out.items()}


def test_files_are_those_of_spark(spark, tmp_path):
    keys = ["a", "b/c", "x=1 +%'", "é#", None, ""]
    rows = spark.createDataFrame([(k, i % 2, i, f' "q", {i}', None if i % 3 else 1e10 * i) for k in keys for i in range(7)], "s string, kind int, n int, ` text` string, v double")
    rows = rows.repartition(3, "s", "kind")
    options = {"ignoreLeadingWhiteSpace": False, "quoteAll": False}
    files.write_keyed(rows, str(tmp_path / "out"), ["s", "kind"], ["n"], **options)
    rows.sortWithinPartitions("s", "kind", "n").drop("n").write.options(**options).partitionBy("s", "kind").csv(str(tmp_path / "spark"), header=True)
    ours, theirs = contents(tmp_path / "out"), contents(tmp_path / "spark")
    ours = {k: sorted(x for f in v for x in f.splitlines()) for k, v in ours.items()}
    theirs = {k: sorted(x for f in v for x in f.splitlines()) for k, v in theirs.items()}
    for v in (ours, theirs):  # null and "" share a folder; each file of it has a header
        for k in v:
            v[k] = sorted(set(v[k]))
    assert ours == theirs and len(ours) == 10


def test_no_checksum_files_and_whole_overwrite(spark, tmp_path):
    """Checksums and their rights were four processes a file."""
    rows = spark.range(0, 40, 1, 4).select((F.col("id") % 20).alias("k"), "id")
    for part in (rows, rows.where("k < 5")):
        files.write_keyed(part.repartition(4, "k"), f"file://{tmp_path}/out", ["k"], mode="overwrite")
    assert len(list((tmp_path / "out").rglob("part-*.csv"))) == 5
    assert not list((tmp_path / "out").rglob(".part-*"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert {(int(r.k), int(r.id)) for r in back.collect()} == {(k, i) for k in range(5) for i in (k, k + 20)}


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    """40 folders made 40 tasks, and 90,000 make 10,000, three times a batch."""
    spark.conf.unset(files.LISTING)
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("session_id"), F.lit("Wave_Data").alias("kind"), "id")
    files.write_keyed(rows, str(tmp_path / "in"), ["session_id", "kind"])
    spark.sparkContext.setJobGroup("list", "list")
    d = landing.landed_files(spark, str(tmp_path / "in"))
    track = spark.sparkContext.statusTracker()
    stages = [s for j in track.getJobIdsForGroup("list") for s in track.getJobInfo(j).stageIds]
    assert d.isStreaming and 0 < max(track.getStageInfo(s).numTasks for s in stages) <= 16


def test_frame_files_are_read_once(spark, tmp_path):
    """The index reads its rows twice; the files were parsed twice for it."""
    from beatframe.sources import tables as t

    t.write_frames(spark.range(0, 60, 1, 4).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("elapsed_s"), F.lit(1.0).alias("green")), str(tmp_path / "out"))
    d = t.read_frames(spark, str(tmp_path / "out"))
    assert "FileScan csv" not in d._jdf.queryExecution().toString()
    assert sorted((r.session_id, r.frame_idx, r.t_ms) for r in d.collect()) == sorted((str(k), i, 1000 * (3 * i + k)) for k in range(3) for i in range(20))
