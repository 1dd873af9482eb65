"""Ordered computations over sessions of any length.

A session may hold a large share of all rows, so no operator here puts a whole
session into one task.  Rows are cut into chunks of ``frame_idx`` and the work
is partitioned by ``(session_id, chunk)``:

* ``Halo``      rolling frames: the few rows a frame reaches over a chunk edge
                are copied into the neighbouring chunk and dropped afterwards;
* ``running_sum`` / ``carry`` / ``ewma``  unbounded prefixes: a local pass per
                chunk plus a prefix over one summary row per chunk;
* ``fold``      state machines: chunks start from a state guessed on the tail of
                the chunk before, are checked against its real end state, and
                only chunks that started wrongly are run again.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.lets import let

KEY = "session_id"
IDX = "frame_idx"
DEFAULT_CHUNK_ROWS = 16_384


def chunk_rows(df: DataFrame, chunk: int | None = None) -> int:
    """Rows of ordinal space per chunk (session setting ``beatframe.chunkRows``)."""
    if chunk is not None:
        return chunk
    return int(df.sparkSession.conf.get("beatframe.chunkRows", str(DEFAULT_CHUNK_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a scratch one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the shared checkpoint folder and go on from the stored copy.

    Later steps read only the columns they use, and lost executors repeat only their own stage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def floor_div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("bigint")


class Halo:
    """Rolling window whose frame reaches at most ``back`` / ``ahead`` rows of a dense index."""

    def __init__(self, df: DataFrame, back: int = 0, ahead: int = 0, key=KEY, idx: str = IDX,
                 chunk: int | None = None):
        self.keys, self.idx, self.back, self.ahead = _keys(key), idx, back, ahead
        self.chunk = chunk_rows(df, chunk)
        self.window = Window.partitionBy(*self.keys, "_chunk").orderBy(idx)

    def spread(self, df: DataFrame) -> DataFrame:
        i = F.col(self.idx)
        first = F.greatest(F.lit(0).cast("bigint"), floor_div(i - self.ahead, self.chunk))
        last = floor_div(i + self.back, self.chunk)
        return df.withColumn("_chunk", F.explode(F.sequence(first, last)))

    def rows(self, lo: int, hi: int):
        assert -lo <= self.back and hi <= self.ahead, "frame is wider than the halo"
        return self.window.rowsBetween(lo, hi)

    def trim(self, df: DataFrame, keep_chunk: bool = False) -> DataFrame:
        own = df.where(floor_div(F.col(self.idx), self.chunk) == F.col("_chunk"))
        return own if keep_chunk else own.drop("_chunk")


def dense_index(df: DataFrame, order: Sequence[Column], bucket: Column, key=KEY, out: str = IDX) -> DataFrame:
    """Zero-based ordinal per key; ``bucket`` must not decrease along ``order``.

    Ranks inside ``(key, bucket)`` and adds the size of all earlier buckets.
    """
    keys = _keys(key)
    d = df.withColumn("_bucket", bucket)
    local = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    before = (
        d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(before, [*keys, "_bucket"])
        .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
        .drop("_bucket", "_rn", "_base")
    )


def running_sum(df: DataFrame, sums: dict[str, Column], key=KEY, idx: str = IDX, chunk: int | None = None,
                order: Sequence[Column] | None = None, chunk_col: str | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Inclusive running sums along ``idx`` for any number of columns, one shuffle of the rows.

    ``chunk_col`` names a chunk column the rows are already partitioned by (left by ``Halo.trim``).  Rows ``beside``, a few per key, are
    joined to the row of each chunk and come to its rows with that, so they cost no shuffle of their own; keys without any go.
    """
    keys, n = _keys(key), chunk_rows(df, chunk)
    d = df.withColumnRenamed(chunk_col, "_c") if chunk_col else df.withColumn("_c", floor_div(F.col(idx), n))
    for name, c in sums.items():
        d = d.withColumn(f"_v_{name}", c)
    w = Window.partitionBy(*keys, "_c").orderBy(*(order or [F.col(idx)]))
    local = d.select("*", *[F.sum(f"_v_{name}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_l_{name}")
                            for name in sums])
    prior = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_c").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    base = totals.select(*keys, "_c", *[F.coalesce(F.sum(f"_t_{name}").over(prior), F.lit(0)).alias(f"_b_{name}")
                                        for name in sums])
    joined = local.join(base if beside is None else base.join(beside, keys), [*keys, "_c"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_b_{name}") + F.col(f"_l_{name}"))
    return joined.drop("_c", *[f"_{p}_{name}" for p in "vlb" for name in sums])


def carry(df: DataFrame, cols: Sequence[str], key=KEY, idx: str = IDX, chunk: int | None = None,
          order: Sequence[Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Replace nulls in ``cols`` by the last earlier non-null value of the same key."""
    keys, n, cols = _keys(key), chunk_rows(df, chunk), list(cols)
    order = list(order or [F.col(idx)])
    d = df.withColumn("_c", floor_div(F.col(idx), n))
    w = Window.partitionBy(*keys, "_c").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    last_of = [F.max(F.when(F.col(c).isNotNull(), F.struct(rank.alias("r"), F.col(c).alias("v"))))["v"].alias(f"_e_{c}")
               for c in cols]
    ends = d.groupBy(*keys, "_c").agg(*last_of)
    prior = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_c", *[F.last(f"_e_{c}", ignorenulls=True).over(prior).alias(f"_p_{c}") for c in cols])
    local = d.select(*[c for c in d.columns if c not in cols],
                     *[F.last(c, ignorenulls=True).over(frame).alias(c) for c in cols])
    joined = local.join(ends, [*keys, "_c"])
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_p_{c}")).alias(c) if c in cols else F.col(c)
                           for c in df.columns])


ATTACH_PARTS = 32


def attach(rows: DataFrame, small: DataFrame, key, by: Sequence[str], how: str = "inner", parts: int = ATTACH_PARTS) -> DataFrame:
    """Join one row per key to rows that may crowd on a key.

    The rows of a key are dealt into ``parts`` by a hash of the columns ``by`` and the small side is copied once per part, so a
    hot key is that many join tasks.
    """
    keys = _keys(key)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def ewma_block(alphas: Sequence[float]) -> int:
    """Rows per block: (1-alpha)^-block stays inside a double, and few blocks reach into the next."""
    if any(not 0.0001 <= a < 1 for a in alphas):
        raise ValueError("alpha must lie within 0.0001 and 1")
    block = 512 if min(alphas) >= 0.01 else 16_384
    return max(1, min([block, *[int(620 / -math.log(1.0 - a)) for a in alphas]]))


def ewma(df: DataFrame, value: str, alpha: float, out: str, key=KEY, ordinal: str = "_ord") -> DataFrame:
    """Exponential mean of one column, seeded with the first value; see ``ewma_many``."""
    return ewma_many(df, {out: (value, alpha)}, key, ordinal)


def ewma_many(df: DataFrame, outs: dict[str, tuple[str, float]], key=KEY, ordinal: str = "_ord") -> DataFrame:
    """Exponential means ``{out: (value, alpha)}`` along ``ordinal``, which is dense and zero-based per key.

    Inside a block the recurrence is a running sum of values scaled by (1-alpha)^-position.  Blocks are full, so the
    state that enters block b is a sum over earlier block ends weighted by (1-alpha)^(block * distance); terms
    below the resolution of a double are left out.
    """
    size = ewma_block([a for _, a in outs.values()])
    keys, o = _keys(key), F.col(ordinal)
    pos = (o % size).cast("double")
    d = df.withColumn("_blk", floor_div(o, size))
    scaled = {n: F.when(o == 0, F.col(v)).otherwise(F.col(v) * F.lit(a)) * F.pow(F.lit(1.0 - a), -pos)
              for n, (v, a) in outs.items()}
    w = Window.partitionBy(*keys, "_blk").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[(F.sum(x).over(w) * F.pow(F.lit(1.0 - outs[n][1]), pos)).alias(f"_s_{n}")
                            for n, x in scaled.items()])
    ends = d.groupBy(*keys, "_blk").agg(*[(F.sum(x) * F.lit((1.0 - outs[n][1]) ** (size - 1))).alias(f"_e_{n}")
                                          for n, x in scaled.items()])
    wb = Window.partitionBy(*keys).orderBy("_blk")

    def entering(n: str) -> Column:
        q = 1.0 - outs[n][1]
        reach = max(1, math.ceil(45.0 / (-size * math.log(q))))
        return sum((F.coalesce(F.lag(f"_e_{n}", j).over(wb), F.lit(0.0)) * F.lit(q ** (size * (j - 1)))
                    for j in range(2, reach + 1)), F.coalesce(F.lag(f"_e_{n}", 1).over(wb), F.lit(0.0)))

    enter = ends.select(*keys, "_blk", *[entering(n).alias(f"_in_{n}") for n in outs])
    joined = local.join(enter, [*keys, "_blk"])
    return joined.select(*[c for c in df.columns if c not in outs], *[
        (F.col(f"_s_{n}") + F.col(f"_in_{n}") * F.pow(F.lit(1.0 - outs[n][1]), pos + 1)).alias(n) for n in outs])


Step = Callable[[Column, Column], Column]


def move(state: Column, out: Column | None) -> Column:
    """Result of one step: the next state and an output struct (null for none)."""
    return F.struct(state.alias("s"), out.alias("o"))


def _run(arr: Column, start: Column, step: Step, state: str, out: str | None) -> Column:
    """Left fold; with ``out`` the accumulator also gathers one output row per accepted item."""
    if out is None:
        return F.aggregate(arr, start.cast(state), lambda a, x: step(a, x)["s"].cast(state))
    zero = F.struct(start.cast(state).alias("s"), F.array().cast(f"array<{out}>").alias("o"))

    def merge(a: Column, x: Column) -> Column:
        return let(step(a["s"], x), lambda r: F.struct(
            r["s"].cast(state).alias("s"),
            F.when(r["o"].isNotNull(), F.array_append(a["o"], r["o"].cast(out))).otherwise(a["o"]).alias("o")))

    return F.aggregate(arr, zero, merge)


FOLD_ITEMS = 512
FOLD_TAIL = 256


@dataclass(frozen=True)
class Lift:
    """What a chunk's run says about starts it did not run from.

    A note is gathered beside the state: ``note(note, state, moved, item)`` after each step, from ``start``.  ``covers(note, ran, real)``
    tells whether the chunk would have taken the same decisions from ``real`` as from ``ran``; ``end(note, end, real)`` is the end it would
    have reached.
    """
    kind: str
    start: Column
    note: Callable[[Column, Column, Column, Column], Column]
    covers: Callable[[Column, Column, Column], Column]
    end: Callable[[Column, Column, Column], Column]


def _run_noted(arr: Column, start: Column, step: Step, state: str, lift: Lift) -> Column:
    """Left fold to the end state and the note."""
    zero = F.struct(start.cast(state).alias("s"), lift.start.cast(lift.kind).alias("l"))
    return F.aggregate(arr, zero, lambda a, x: let(step(a["s"], x), lambda r: F.struct(
        r["s"].cast(state).alias("s"), lift.note(a["l"], a["s"], r, x).cast(lift.kind).alias("l"))))


def _real_starts(chunks: Column, state: str, lift: Lift) -> Column:
    """Along a key's chunks (start, end, note): the start each one really has, and whether it must run again from it."""
    kind = f"struct<_c:bigint,start:{state},again:boolean>"
    first = let(F.get(chunks, 0), lambda c: F.struct(c["end"].alias("s"), F.array(F.struct(c["_c"].cast("bigint"), c["start"], F.lit(False))).cast(f"array<{kind}>").alias("o")))

    def link(a: Column, c: Column) -> Column:
        def judged(same: Column) -> Column:
            end = F.when(same, c["end"]).otherwise(lift.end(c["l"], c["end"], a["s"]).cast(state))
            again = ~same & ~F.coalesce(lift.covers(c["l"], c["start"], a["s"]), F.lit(False))
            return F.struct(end.alias("s"), F.array_append(a["o"], F.struct(c["_c"].cast("bigint"), a["s"], again).cast(kind)).alias("o"))
        return let(c["start"].eqNullSafe(a["s"]), judged)
    return F.aggregate(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))), first, link)["o"]


def fold(rows: DataFrame, order: str, item: Sequence[str], init: Column, step: Step, state: str, out: str,
         key=KEY, items: int | None = None, tail: int = FOLD_TAIL, lift: Lift | None = None, chunk_col: str | None = None) -> DataFrame:
    """Run a state machine along ``order`` (unique per key) and return its output rows.

    ``step(state, item)`` returns ``move(next state, output struct or null)``.  Rows are shuffled once, into one array per key
    and span of ``order`` (``beatframe.chunkRows``); arrays are cut into chunks of at most ``items`` rows.  Only keys with more
    than one chunk need checking; their chunks are run again until every chunk starts from the real end of the one before, so
    the result equals one pass over the whole key.  Keys with a single chunk run where they are stored.  ``chunk_col`` names the
    chunk column of ``order`` that the rows are already partitioned by (left by ``Halo.trim``); then they aren't shuffled.

    With ``lift`` a chunk that started from a wrong guess runs again only if a decision in it hangs on that: otherwise its end follows from
    its note, and one pass over a key's chunk summaries carries the real state through all of them.  ``fold.rounds`` tells how often
    chunks were run again.
    """
    keys = _keys(key)
    items = items or int(rows.sparkSession.conf.get("beatframe.foldItems", str(FOLD_ITEMS)))
    fold.rounds = 0
    first = F.col(order) if order in item else F.col(order).alias("_o")
    payload = F.struct(first, *[F.col(c) for c in item if c != order])
    span = F.col(chunk_col) if chunk_col else floor_div(F.col(order), chunk_rows(rows))
    spans = rows.dropna(subset=[*keys, order]).select(*keys, span.alias("_s"), payload.alias("p"))
    spans = cut(spans.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list("p")).alias("arr")).withColumn("_k", F.ceil(F.size("arr") / items)))
    result = lambda d, start: d.select(
        *keys, F.explode(_run(F.col("arr"), start, step, state, out)["o"]).alias("r")).select(*keys, "r.*")

    many = spans.groupBy(*keys).agg(F.sum("_k").alias("_n")).where("_n > 1").select(*keys)
    if many.limit(1).count() == 0:
        return result(spans, init)
    many = cut(many)
    single = result(spans.join(many, keys, "left_anti"), init)
    parts = cut(_pieces(spans.join(many, keys, "left_semi"), keys))
    tails = parts.select(*keys, (F.col("_c") + 1).alias("_c"), F.slice("arr", -F.least(F.size("arr"), F.lit(tail)),
                                                                     F.least(F.size("arr"), F.lit(tail))).alias("t"))
    guess = parts.join(tails, [*keys, "_c"], "left").withColumn(
        "start", F.when(F.col("_c") == 0, init.cast(state)).otherwise(_run(F.col("t"), init, step, state, None)))
    if lift is not None:
        noted = lambda d: d.select(*keys, "_c", "start", _run_noted(F.col("arr"), F.col("start"), step, state, lift).alias("r")).select(
            *keys, "_c", "start", F.col("r.s").alias("end"), F.col("r.l").alias("l"))
        ends = cut(noted(guess))
        while True:
            summary = F.array_sort(F.collect_list(F.struct("_c", "start", "end", "l")), lambda a, b: (a["_c"] - b["_c"]).cast("int"))
            real = ends.groupBy(*keys).agg(summary.alias("chunks")).select(*keys, F.inline(_real_starts(F.col("chunks"), state, lift)))
            real = cut(real)
            again = real.where("again").drop("again")
            if again.limit(1).count() == 0:
                return single.unionByName(result(parts.join(real.drop("again"), [*keys, "_c"]), F.col("start")))
            fold.rounds += 1
            redone = noted(again.join(parts, [*keys, "_c"]))
            ends = cut(ends.join(again.select(*keys, "_c"), [*keys, "_c"], "left_anti").unionByName(redone))
    ends = cut(guess.select(*keys, "_c", "start", _run(F.col("arr"), F.col("start"), step, state, None).alias("end")))
    while True:
        real = ends.select(*keys, (F.col("_c") + 1).alias("_c"), F.col("end").alias("real"))
        checked = ends.join(real, [*keys, "_c"], "left")
        wrong = (F.col("_c") > 0) & ~F.col("start").eqNullSafe(F.col("real"))
        again = checked.where(wrong).select(*keys, "_c", F.col("real").alias("start"))
        if again.limit(1).count() == 0:
            break
        fold.rounds += 1
        redone = again.join(parts, [*keys, "_c"]).select(
            *keys, "_c", "start", _run(F.col("arr"), F.col("start"), step, state, None).alias("end"))
        ends = cut(ends.join(again.select(*keys, "_c"), [*keys, "_c"], "left_anti").unionByName(redone))
    return single.unionByName(result(parts.join(ends.select(*keys, "_c", "start"), [*keys, "_c"]), F.col("start")))


fold.rounds = 0


def _pieces(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of spans (``_s``) cut into ``_k`` consecutive chunks of near equal size, numbered without gaps per key."""
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.select(*keys, "_s", "_k").withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    size = F.ceil(F.size("arr") / F.col("_k")).cast("int")
    piece = lambda j: F.struct((F.col("_b") + j).alias("_c"), F.slice("arr", (j * size + 1).cast("int"), size).alias("arr"))
    return spans.join(base, [*keys, "_s"]).select(*keys, F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1), piece)))
