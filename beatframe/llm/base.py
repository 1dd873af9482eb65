"""Shared helpers: stages in the shared folder, the word pattern, numpy hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbers(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; a local one is set only where the session names none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("beatframe.testFolder", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="beatframe-")
        spark.conf.set("beatframe.testFolder", d)
    return d.rstrip("/")


def stage(df: DataFrame, name: str, rows: int | None = None, per_task: int = 100_000) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, keeps column pruning, survives lost executors.

    Where the number of rows is known, no more tasks than one per ``per_task`` rows (but 8 at least) write it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // per_task)))
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, total: int, heavy: int) -> DataFrame:
    """Inner join of many rows with facts by key, where ``facts.n`` says how many rows a key has.

    Keys with more than one row in ``heavy`` are at most ``heavy``, so their facts are broadcast and their rows dealt out by
    ``spread``; the facts of the others are joined by key.
    """
    large = F.col("n") * heavy > total
    names = [c for c in facts.columns if c not in keys]
    hot = F.broadcast(facts.where(large).select(*keys, F.struct(*names).alias("hot")))
    rest = facts.where(~large).select(*keys, F.xxhash64(*keys).alias("deal"), F.struct(*names).alias("fact"))
    dealt = rows.join(hot, keys, "left").withColumn("deal", F.when(F.col("hot").isNotNull(), spread).otherwise(F.xxhash64(*keys)))
    both = dealt.join(rest, [*keys, "deal"], "left").withColumn("fact", F.coalesce("hot", "fact"))
    return both.where("fact IS NOT NULL").select(*rows.columns, *[F.col("fact")[c].alias(c) for c in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * C2
    x ^= x >> np.uint64(27)
    x *= C3
    return x ^ (x >> np.uint64(31))


def unit_table(n: int = 256, seed: int = 1) -> np.ndarray:
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * C1)


BYTE_UNITS = unit_table()


def window_hash(units: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprint of every run of ``length`` units, by doubling; one value per start."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    cur, done, off, k = units, None, 0, 1
    while True:
        if length & k:
            part = cur[off:off + n]
            if done is None:
                done = part.copy()
            else:
                done *= C2
                done += part
                done ^= done >> np.uint64(29)
            off += k
        if 2 * k > length:
            return mix64(done)
        nxt = cur[:-k] * C3
        nxt += cur[k:]
        nxt ^= nxt >> np.uint64(32)
        cur, k = nxt, 2 * k


def word_spans(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated texts that end at ``ends``."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(buf))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hash(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, part: int = 1 << 17) -> np.ndarray:
    """64-bit fingerprint of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(starts), part):
        s = starts[lo:lo + part]
        size = stops[lo:lo + part] - s
        power = np.ones(int(size.max()) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(power) - 1, C1 | np.uint64(1)), out=power[1:])
        first = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(first, size)
        vals = BYTE_UNITS[buf[np.repeat(s, size) + inner]] * power[inner]
        out[lo:lo + part] = mix64(np.add.reduceat(vals, first) + size.astype(np.uint64) * C3)
    return out


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string or binary array (no nulls, any slice)."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]
