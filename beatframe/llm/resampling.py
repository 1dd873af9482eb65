"""Importance resampling towards a target text set: weights from bucket gains, winners by distributed quickselect."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from beatframe.llm.base import stage, text_buffers

BUCKETS, RUNS = 10_000, 3
FULL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


TABLE = crc_table()


def crc_append(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int = 64) -> np.ndarray:
    """States of the checksum after one more word each; bytes beyond ``most`` of a word go one word at a time."""
    out, size = state.copy(), stops - starts
    at = np.flatnonzero(size > 0)
    for k in range(min(most, int(size.max(initial=0)))):
        s = out[at]
        out[at] = TABLE[(s & np.uint32(255)) ^ buf[starts[at] + k]] ^ (s >> np.uint32(8))
        at = at[size[at] > k + 1]
    for i in at:
        out[i] = np.uint32(zlib.crc32(buf[starts[i] + most:stops[i]].tobytes(), int(out[i] ^ FULL))) ^ FULL
    return out


def term_spans(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and stops of the words of concatenated texts that end at ``ends``."""
    buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    inside = ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    edge = np.zeros(len(buf) + 1, bool)
    edge[ends] = True
    first, last = inside & edge[:-1], inside & edge[1:]
    first[1:] |= inside[1:] & ~inside[:-1]
    last[:-1] |= inside[:-1] & ~inside[1:]
    if len(buf):
        first[0], last[-1] = inside[0], inside[-1]
    return buf, np.flatnonzero(first), np.flatnonzero(last) + 1


def features(col, block: int = 1 << 16, part: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Text index and bucket of every run of 1 to ``RUNS`` words, block by block, with the length of the runs.

    Texts are taken together up to about ``part`` bytes; a longer one is taken by itself, and its runs in blocks of ``block`` starts.
    """
    buf, off = text_buffers(col)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + part, "right")) - 1)
        ends = off[lo + 1:hi + 1] - off[lo]
        low, starts, stops = term_spans(buf[off[lo]:off[hi]], ends)
        owner = np.searchsorted(ends, starts, "right")
        for b in range(0, len(starts), block):
            n = min(block, len(starts) - b)
            state, at = np.full(n, FULL), np.arange(b, b + n)
            for run in range(RUNS):
                if run:
                    more = at + run < len(starts)
                    more[more] = owner[at[more] + run] == owner[at[more]]
                    at, state = at[more], state[more]
                    state = TABLE[(state & np.uint32(255)) ^ np.uint32(32)] ^ (state >> np.uint32(8))
                state = crc_append(state, low, starts[at + run], stops[at + run])
                yield lo + owner[at], ((state ^ FULL) % np.uint32(BUCKETS)).astype(np.int64), run + 1
        lo = hi


def bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Features of all texts per bucket; at most one row per bucket and task is shuffled."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column("text")):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    d = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = np.zeros(BUCKETS, np.int64)
    for r in d.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus, target)], np.int64)


def text_weight(text: Column, gains: np.ndarray) -> Column:
    """Struct of words, features and the sum of their gains."""
    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(col: pa.Array) -> pa.Array:
        words, found, weight = np.zeros((3, len(col)), np.int64)
        for owner, bucket, run in features(col):
            n = np.bincount(owner, minlength=len(col))
            found += n
            words += n * (run == 1)
            weight += np.bincount(owner, weights=gains[bucket], minlength=len(col)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in (words, found, weight)], ["n_words", "n_features", "weight"])
    return weigh(F.coalesce(text, F.lit("")))


def key_of(values) -> Column:
    return F.struct(*[F.lit(v).cast(t) for v, t in zip(values, ("bigint", "boolean", "bigint", "bigint", "bigint"))])


def kth_key(keys: DataFrame, k: int, pivots: int = 16, seed: int = 0):
    """The k-th least of the distinct ``key`` structs.

    Each round draws random pivot keys among those still possible, counts the keys between and at the pivots exactly, and narrows to the part
    that holds the k-th. Rounds grow with the logarithm of the rows; pivots and counts are all the driver sees.
    """
    low = high = None
    while True:
        inside = keys
        if low is not None:
            inside = inside.where(F.col("key") > key_of(low))
        if high is not None:
            inside = inside.where(F.col("key") < key_of(high))
        drawn = inside.select("key", F.xxhash64("key", F.lit(seed)).alias("draw")).orderBy("draw", "key").limit(pivots)
        at = sorted((tuple(r["key"]) for r in drawn.collect()), key=lambda t: (t[0], t[1], t[2] is not None, t[2] or 0, *t[3:]))
        line = F.array(*[key_of(p) for p in at])
        part = 2 * F.size(F.filter(line, lambda p: p < F.col("key"))) + F.exists(line, lambda p: p == F.col("key")).cast("int")
        counts = {r["part"]: r["count"] for r in inside.groupBy(part.alias("part")).count().collect()}
        for i in range(2 * len(at) + 1):  # even: between pivots; odd: at one
            if k <= counts.get(i, 0):
                break
            k -= counts.get(i, 0)
        if i % 2:
            return at[i // 2]
        low, high = at[i // 2 - 1] if i else low, at[i // 2] if i // 2 < len(at) else high
        seed += 1


def ranked(keys: DataFrame, n: int, per_part: int = 50_000) -> DataFrame:
    """Rows with rank 1 .. n by ``key``: cut into ranges, ranked within each, and shifted by the rows of the ranges before."""
    parts = max(8, min(4096, -(-n // per_part)))
    cut = stage(keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    before = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(ahead, F.lit(0))).select("part", "before")
    here = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return cut.withColumn("here", here).join(F.broadcast(before), "part").withColumn("rank", (F.col("before") + F.col("here")).cast("bigint")).drop("part", "here", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5,
             least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Features are the runs of 1 to 3 words of a text, each in one of 10,000 buckets by CRC-32. A bucket's gain is the log ratio of its
    smoothed share in the target to that in the corpus, in thousandths; a text's weight is the sum over its features. The score adds
    Gumbel noise from a hash of seed and id, so the highest scores are a draw without replacement in proportion to the weights' exponentials.
    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) highest scores are drawn, ties to the smaller id.

    Counts are exact over all texts; 10,000 gains go to the tasks. The draw never sorts the corpus: a distributed quickselect finds the last
    winner's key, and the winners alone are sorted and ranked, range by range.

    Null and empty texts have no features, weight 0 and are never drawn. A null id counts as an empty one for the noise and comes last in ties;
    of rows that share id and score the one with the smaller text hash comes first. Repeated rows count each time. An empty table gives an
    empty table. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    w = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), noise.alias("noise"), text_weight(F.col(text_col), gains).alias("w"))
    w = w.select("id", "tie", "w.*", (F.col("w.weight") + F.col("noise")).cast("bigint").alias("score"))
    rows = stage(w.withColumn("row", F.monotonically_increasing_id()), "weights")
    rows = rows.withColumn("key", F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("late"), F.col("id").cast("bigint").alias("id"), "tie", "row"))
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * percent // 100
    shown = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        out = rows.select(*shown, none)
    else:
        last = key_of(kth_key(rows.where(able).select("key"), k))
        won = able & (F.col("key") <= last)
        out = rows.where(~won).select(*shown, none).unionByName(ranked(rows.where(won), k).select(*shown, "rank"))
    return out.withColumnRenamed("id", "doc_id")
