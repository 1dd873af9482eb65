"""Session phases: gated or forced placement, then rest, cold and recovery, each snapped to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import PHASE_MS, PHASES, phase_name
from .chunks import IDX, KEY, attach, cut, floor_div


def durations(overrides: dict[str, int] | None = None) -> dict[str, int]:
    """Requested durations; zero or negative ones fall back to the defaults."""
    return {p: (v if (v := (overrides or {}).get(p, 0)) > 0 else PHASE_MS[p]) for p in PHASES}


CHUNK_FRAMES = 512


def frame_chunks(frames: DataFrame, gate: str | None) -> DataFrame:
    """One stored row per ``CHUNK_FRAMES`` frames: times in frame order with the gate, and the least and greatest time."""
    passed = F.coalesce(F.col(gate), F.lit(False)) if gate else F.lit(True)
    item = F.struct(F.col(IDX).alias("i"), F.col("t_ms").alias("t"), passed.alias("ok"))
    d = frames.groupBy(KEY, floor_div(F.col(IDX), CHUNK_FRAMES).alias("chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("arr"), F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    return cut(d)


def gated_ready(chunks: DataFrame, placement: int) -> DataFrame:
    """First time per session that lies ``placement`` ms or more into an unbroken run of passing frames.

    A chunk knows when the run at its end began, unless it passes from its first frame on; then that is what the chunks before it say.
    """
    def follow(a, x):
        begun = F.when(~x["ok"], F.lit(None)).otherwise(F.coalesce(a["from"], x["t"])).cast("bigint")
        return F.struct(begun.alias("from"), (a["through"] & x["ok"]).alias("through"))
    none = F.lit(None).cast("bigint")
    at_end = F.aggregate("arr", F.struct(none.alias("from"), F.lit(True).alias("through")), follow)
    d = chunks.select(KEY, "chunk", "arr", at_end.alias("e"))
    w = Window.partitionBy(KEY).orderBy("chunk")
    first = F.row_number().over(w) == 1
    known = F.when(first | ~F.col("e.through"), F.struct(F.col("e.from").alias("from")))
    d = d.withColumn("known", known).withColumn("before", F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def search(a, x):
        begun = F.when(x["ok"], F.coalesce(a["from"], x["t"])).cast("bigint")
        hit = x["ok"] & (x["t"] > begun) & (x["t"] - begun >= placement)
        return F.struct(begun.alias("from"), F.when(hit, F.least(a["at"], x["t"])).otherwise(a["at"]).cast("bigint").alias("at"))
    found = F.aggregate("arr", F.struct(F.col("before.from").alias("from"), none.alias("at")), search)["at"]
    return d.groupBy(KEY).agg(F.min(found).alias("s1"))


def first_at(chunks: DataFrame, due: DataFrame, out: str) -> DataFrame:
    """First frame time at or after ``_due`` per session; only the chunk that holds the mark looks at its frames."""
    d = attach(chunks.select(KEY, "lo", "hi", F.transform("arr", lambda x: x["t"]).alias("ts")), due, KEY, ["lo"]).where("hi >= _due")
    inside = F.when(F.col("lo") >= F.col("_due"), F.col("lo")).otherwise(F.array_min(F.filter("ts", lambda t: t >= F.col("_due"))))
    return d.groupBy(KEY).agg(F.min(inside).alias(out))


def phase_machine(frames: DataFrame, gate: str = "gate_ok", config: dict[str, int] | None = None, forced: bool = False
                  ) -> DataFrame:
    """Start and end of each phase per session as a four-row timeline (-1 where not reached).

    Gated placement ends on the first frame at least ``placement`` ms into an unbroken run of passing frames.
    Every later phase ends on the first frame at least its duration after its start.  The frames are read once, into chunk rows.
    """
    ms = durations(config)
    chunks = frame_chunks(frames, None if forced else gate)
    table = chunks.groupBy(KEY).agg(F.min("lo").alias("t0"), F.max("hi").alias("t_last"))
    if forced:
        due = table.select(KEY, (F.col("t0") + ms["placement"]).alias("_due"))
        table = table.join(first_at(chunks, due, "s1"), KEY, "left")
    else:
        table = table.join(gated_ready(chunks, ms["placement"]), KEY, "left")
    for i, name in ((2, "rest"), (3, "cold"), (4, "recovery")):
        due = table.select(KEY, (F.col(f"s{i - 1}") + ms[name]).alias("_due")).where("_due is not null")
        table = table.join(first_at(chunks, due, f"s{i}"), KEY, "left")
    ends = [F.col("s1"), F.col("s2"), F.col("s3"), F.when(F.col("s4").isNotNull(), F.col("t_last"))]
    starts = [F.col("t0"), F.col("s1"), F.col("s2"), F.col("s3")]
    none = F.lit(-1).cast("bigint")
    rows = F.array(*[F.struct(F.lit(i).alias("phase"), phase_name(F.lit(i)).alias("name"),
                              F.coalesce(s, none).alias("start_time_ms"), F.coalesce(e, none).alias("end_time_ms"))
                     for i, (s, e) in enumerate(zip(starts, ends))])
    return table.select(KEY, F.explode(rows).alias("r")).select(KEY, "r.*")
