"""Many small CSV files in folders by key."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Each task moves the files it wrote when it ends, instead of the driver one after another at the end of the job.
TASKS_MOVE = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
RESERVED = re.compile(r"""["#%'*/:=?\\{\[\]^\x01-\x1f\x7f]""")  # characters that Spark escapes in the names of partition folders


def file_tasks(spark: SparkSession) -> int:
    """Tasks to write many small files with: a fixed number, as partitions merged by their size would leave all files to one task."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def list_in_few_tasks(spark: SparkSession) -> None:
    """Folders and files are listed in a few tasks a core, where the session says nothing else: Spark makes a task for each, up to 10,000 a listing."""
    if LISTING not in spark.conf.getAll:
        spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system knows it, None on other file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _name(key: str, value: str | None) -> str:
    return f"{key}={RESERVED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else NO_VALUE}"


def _puts(folder: str, by: Sequence[str], head: str | None):
    """Function of a task that writes the files of its rows (``by``, line); rows of a folder come one after another."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, at, out, name = TaskContext.get().partitionId(), 0, None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, name)  # a file is seen when it is whole
        for b in batches:
            *keys, lines = (c.to_pylist() for c in b.columns)
            for where, rows in groupby(zip(*keys, lines), key=lambda r: r[:-1]):
                if where != at:
                    close()
                    here, at = os.path.join(folder, *[_name(k, v) for k, v in zip(by, where)]), where
                    os.makedirs(here, exist_ok=True)
                    name = f"{here}/part-{task:05d}-{n}.csv"
                    out, n = open(f"{here}/.part-{task:05d}-{n}", "w", encoding="utf-8", newline=""), n + 1
                    if head is not None:
                        out.write(f"{head}\n")
                out.writelines(f"{r[-1]}\n" for r in rows)
        close()
        yield pa.RecordBatch.from_pydict({"files": [n]})
    return put


def write_keyed(rows: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = (), mode: str = "error", **options) -> None:
    """``rows.write.partitionBy(*by).csv(path, header=True)``; each partition of ``rows`` writes a file per key it holds, sorted by ``order``.

    On a local file system Hadoop starts four processes for each file it makes (``chmod`` of it and of its checksum, twice), which takes far longer than the
    file. There the lines are formatted by Spark all the same and the tasks put them into files themselves.
    """
    spark, cols = rows.sparkSession, [c for c in rows.columns if c not in (*by, *order)]
    rows = rows.sortWithinPartitions(*by, *order)
    folder = local_folder(spark, path)
    if folder is None:
        rows.drop(*order).write.mode(mode).options(**TASKS_MOVE, **options).partitionBy(*by).csv(path, header=True)
        return
    rows.limit(0).select(*by, *cols).write.mode(mode).partitionBy(*by).csv(path)  # what lies there goes, or is an error
    line = lambda *c: F.to_csv(F.struct(*c), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    head = spark.range(1).select(line(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(cols)])).first()[0]
    texts = rows.select(*[F.col(k).cast("string") for k in by], line(*[F.col(f"`{c}`") for c in cols]).alias("_line"))
    texts.mapInArrow(_puts(folder, list(by), head), "files bigint").write.format("noop").mode("overwrite").save()
