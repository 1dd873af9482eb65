"""Tables of live sessions: one commit for all tables of a micro-batch, versioned snapshots, final tables of ended recordings.

A batch writes its part of every table under its own number and a commit row last.  Readers take committed parts only, so a batch that
failed half way is not seen, and one that is repeated writes the same parts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.chunks import KEY, cut
from ..plans.session import training_rows
from ..sources.tables import method_table
from .sessions import METHODS, score_rows, session_ends

BUCKETS = 64


def recordings(scored: DataFrame) -> DataFrame:
    """Beat rows keyed by recording: the session and its start, as a session may have several."""
    return scored.withColumn(KEY, F.concat_ws("@", F.col(KEY).cast("string"), F.col("started_us").cast("string")))


FINAL = ("training", "ibi", "method_M1", "method_M2", "method_M3")


def final_table(name: str, beats: DataFrame) -> DataFrame:
    """One of the tables that are kept of an ended recording, from its scored beats."""
    if name == "training":
        return training_rows(beats)
    if name == "ibi":
        return beats.select(KEY, "beat_index", "frame_idx", "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd")
    method = name.removeprefix("method_")
    return method_table(beats.select(KEY, "beat_index", "t_ms", method), method)


def scored_for(names: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """Beats of recordings with the scores that the tables ``names`` hold: all of them only where training rows are among these."""
    if {"training", "snapshot"} & set(names):
        return recordings(score_rows(rows))
    methods = tuple(m for m in METHODS if f"method_{m}" in names)
    return recordings(score_rows(rows, methods)).select(KEY, "beat_index", "frame_idx", "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd", *methods)


def _write(df: DataFrame, path: str, name: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")


def save_batch(rows: DataFrame, epoch: int, path: str, every: int = 60, tables: tuple[str, ...] = FINAL) -> None:
    """One micro-batch of ``stream_sessions``: the log of its rows, closing records, snapshots that are due, final tables of ended
    recordings, commit.

    A snapshot of a recording is due when its beats pass a multiple of ``every``; it is a new version, older ones stay readable.  The log's
    files are sorted by a bucket of the session, so only row groups that hold such recordings are read, and only their beats are scored.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")
    log = rows.withColumn("bucket", bucket)
    _write(log.sortWithinPartitions("bucket"), path, "rows", epoch)  # the state step runs once; an empty batch leaves a file with the columns
    kind = StructType([*log.schema.fields, StructField("epoch", LongType())])
    whole = spark.read.schema(kind).parquet(f"{path}/rows").where(F.col("epoch") <= epoch)
    now, ids = whole.where(F.col("epoch") == epoch), [KEY, "started_us"]
    ended = now.where("kind = 'end'")
    _write(session_ends(ended), path, "ends", epoch)
    due = now.where((F.col("kind") == "beat") & (F.col("beat_index") % every == 0))
    for marks, names in ((due, ("snapshot",)), (ended, tables)):
        buckets = [r["bucket"] for r in marks.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if not buckets:
            continue
        held = whole.where(F.col("bucket").isin(buckets)).drop("bucket", "epoch").join(marks.select(*ids).distinct(), ids, "left_semi")
        beats = cut(scored_for(names, held))
        for name in names:
            _write(final_table("training" if name == "snapshot" else name, beats), path, name, epoch)
    _write(spark.range(1).select(F.lit(epoch).cast("bigint").alias("number")), path, "commits", epoch)


def save_sessions(rows: DataFrame, path: str, checkpoint: str, every: int = 60, tables: tuple[str, ...] = FINAL):
    """Writer of all tables of ``stream_sessions`` rows; batches run one after another."""
    def save(batch: DataFrame, epoch: int) -> None:
        save_batch(batch, epoch, path, every, tables)
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append")


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of committed batches, with their ``epoch``."""
    epochs = spark.read.parquet(f"{path}/commits").select(F.col("number").alias("epoch"))
    return spark.read.parquet(f"{path}/{name}").withColumn("epoch", F.col("epoch").cast("bigint")).join(epochs, "epoch", "left_semi")


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    """Scored beats of all committed batches."""
    return score_rows(read_committed(spark, path, "rows").drop("bucket"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest committed version of each recording's training rows."""
    d = read_committed(spark, path, "snapshot")
    last = d.groupBy(KEY).agg(F.max("epoch").alias("epoch"))
    return d.join(last, [KEY, "epoch"])
