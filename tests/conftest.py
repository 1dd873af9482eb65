import math
import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def small_chunks(spark):
    """Cut sessions into tiny chunks so that every edge is crossed."""
    spark.conf.set("beatframe.chunkRows", "70")
    spark.conf.set("beatframe.foldItems", "40")
    yield
    spark.conf.unset("beatframe.chunkRows")
    spark.conf.unset("beatframe.foldItems")


@pytest.fixture(scope="session")
def wave(spark):
    def make(name, n=600):
        i = F.col("id").cast("double")
        value = {"sine60": 5 + 4 * F.cos(2 * math.pi * i / 30), "sine75": 5 + 4 * F.cos(2 * math.pi * i / 24),
                 "step_hr": 5 + 4 * F.cos(2 * math.pi * F.when(i < 300, i / 30).otherwise((i - 300) / 24)),
                 "spike": 5 + 4 * F.cos(2 * math.pi * F.when(i < 300, i / 30).when(i < 348, (i - 300) / 48).otherwise((i - 348) / 30)),
                 "flat": F.lit(5.0)}[name]
        return spark.range(0, n, 1, 2).select(F.lit(name).alias("session_id"), F.col("id").alias("frame_idx"), value.alias("green_raw"),
                                              F.floor(F.col("id") * 1000 / 30).cast("bigint").alias("t_ms"))
    return make
