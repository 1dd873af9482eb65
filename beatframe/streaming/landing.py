"""Sessions out of files that land one by one: a streaming listing, and a ledger that only grows and takes each session once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chunks import KEY
from ..operators.evaluate import ingest
from ..sources.files import list_in_few_tasks
from .commits import _write as write_part, read_committed

KINDS = ("Wave_Data", "Training_Data", "IMU_Data")
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, folder: str, per_batch: int = 100_000) -> DataFrame:
    """Stream of (session_id, kind, path, length), one row per file; the files' content isn't read.

    Names are ``<session>_<kind>.csv``, or folders ``session_id=<session>/kind=<kind>`` hold the parts of a file. Other files and empty
    ones are left out; files have to be moved into ``folder`` whole, as each path is seen once.
    """
    list_in_few_tasks(spark)
    d = (spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
         .option("maxFilesPerTrigger", per_batch).load(folder))
    kinds = "|".join(KINDS)
    flat, parts = rf"([^/]+)_({kinds})\.csv$", rf"session_id=([^/]+)/kind=({kinds})/[^/]+$"
    name = lambda i: F.when(F.rlike("path", F.lit(parts)), F.regexp_extract("path", parts, i)).otherwise(F.regexp_extract("path", flat, i))
    return d.select(name(1).alias(KEY), name(2).alias("kind"), "path", "length").where(f"{KEY} <> '' AND length > 0")


def save_landed(files: DataFrame, epoch: int, path: str) -> None:
    """One micro-batch: its files, the sessions that it completes, commit.

    Only sessions with a file in the batch are looked at, so one that waits costs nothing until its next file. Later files of a taken
    session don't take it again.
    """
    spark = files.sparkSession
    write_part(files, path, "arrivals", epoch)
    seen = spark.read.parquet(f"{path}/arrivals").where(F.col("epoch") <= epoch)
    touched = seen.where(F.col("epoch") == epoch).select(KEY).distinct()
    taken = spark.read.parquet(f"{path}/ledger").where(F.col("epoch") < epoch) if epoch else touched.limit(0)
    write_part(ingest(seen.join(touched, KEY, "left_semi"), taken).select(KEY), path, "ledger", epoch)
    write_part(spark.range(1).select(F.lit(epoch).cast("bigint").alias("number")), path, "commits", epoch)


def ingest_landed(files: DataFrame, path: str):
    """Writer of the ledger of ``landed_files``; the progress of the stream is kept beside the ledger, as one means nothing without the other."""
    def save(batch: DataFrame, epoch: int) -> None:
        save_landed(batch, epoch, path)
    return files.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/progress").outputMode("append")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """session_id, the batch (``epoch``) that took it and has_imu of every session so far.

    has_imu tells whether a sensor file has landed up to now, in whatever batch, so it doesn't hang on how files fell into batches.
    """
    imu = read_committed(spark, path, "arrivals").where("kind = 'IMU_Data'").select(KEY).distinct().withColumn("has_imu", F.lit(1))
    return read_committed(spark, path, "ledger").join(imu, KEY, "left").withColumn("has_imu", F.coalesce("has_imu", F.lit(0)))
