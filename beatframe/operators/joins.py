"""Joins over time: as-of, nearest and interval joins without theta joins or all-pairs output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .chunks import IDX, KEY, _keys, attach, carry, floor_div

SECOND_MS, SECOND_NS = 1_000, 1_000_000_000


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], on: str = IDX, key=KEY,
                  inclusive: bool = True, chunk: int | None = None) -> DataFrame:
    """For each left row the last right row at or before it (before it with ``inclusive=False``)."""
    keys, cols = _keys(key), list(cols)
    side = 1 if inclusive else -1
    picked = F.struct(*[F.col(c) for c in cols])
    r = right.select(*keys, on, F.lit(0).alias("_side"), picked.alias("_hit"))
    l = left.select("*", F.lit(side).alias("_side"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"))
    both = l.unionByName(r, allowMissingColumns=True)
    out = carry(both, ["_hit"], keys, on, chunk, order=[F.col(on), F.col("_side")])
    return out.where(F.col("_side") == side).select(
        *left.columns, *[F.col("_hit")[c].alias(c) for c in cols])


def asof_each(left: DataFrame, right: DataFrame, cols: Sequence[str], on: str = IDX, key=KEY, chunk: int | None = None) -> DataFrame:
    """For each left row and each of ``cols`` the last value that isn't null on a right row at or before it, in one sort."""
    keys, cols = _keys(key), list(cols)
    r = right.select(*keys, on, F.lit(0).alias("_side"), *cols)
    l = left.select("*", F.lit(1).alias("_side"))
    out = carry(l.unionByName(r, allowMissingColumns=True), cols, keys, on, chunk, order=[F.col(on), F.col("_side")])
    return out.where("_side = 1").select(*left.columns, *cols)


def asof_nearest(left: DataFrame, right: DataFrame, on: str, cols: Sequence[str], key=KEY, tol: int | None = None,
                 first: Sequence[str] = (), chunk: int = 3_600 * SECOND_MS) -> DataFrame:
    """Nearest right row by ``|left.on - right.on|``; the earlier one wins a tie, ``first`` orders equal times.

    ``tol`` is exclusive.  Chunks span ``chunk`` units of ``on``, so a hot key is spread over time.  The rows of both sides are shuffled
    and sorted once: within a chunk the last hit and the next one are read in the same order, and one row per chunk carries the last
    hit of the chunks before and the first hit of the chunks behind.  A left row without a time gets no hit.
    """
    keys, cols = _keys(key), list(cols)
    order = list(first)
    r0 = right.where(F.col(on).isNotNull()).select(*keys, on, *order, *[c for c in cols if c not in (on, *order)])
    # equal times: keep the first row only, as the first minimum wins
    hit = F.struct(F.col(on).alias("_t"), *[F.col(c) for c in cols])
    one = F.min_by(hit, F.struct(*[F.col(c) for c in order])) if order else F.min(hit)
    r = r0.groupBy(*keys, on).agg(one.alias("_hit")).withColumn("_side", F.lit(0))
    l = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"))
    part = F.coalesce(floor_div(F.col(on), chunk), F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_c", part)
    # equal times are seen by the backward reading only, as hits are sorted before the left rows of their time
    names = ", ".join(f"`{k}`" for k in [*keys, "_c"])
    w = Window.partitionBy(*keys, "_c").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.expr(f"lead(_hit, 1) IGNORE NULLS OVER (PARTITION BY {names} ORDER BY `{on}`, _side)")
    local = both.select(*left.columns, "_side", "_c", F.last("_hit", ignorenulls=True).over(w).alias("_prev"), ahead.alias("_next"))
    chunks = left.withColumn("_c", part).select(*keys, "_c").distinct().unionByName(r.withColumn("_c", part).select(*keys, "_c", on, "_hit"), True)
    ends = chunks.groupBy(*keys, "_c").agg(F.min_by("_hit", on).alias("_first"), F.max_by("_hit", on).alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_c")
    behind = F.expr(f"lead(_first, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY _c)")
    ends = ends.select(*keys, "_c", behind.alias("_after"), F.last("_last", ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    out = local.where("_side = 1").join(ends, [*keys, "_c"]).withColumn("_prev", F.coalesce("_prev", "_before")).withColumn(
        "_next", F.coalesce("_next", "_after"))
    before, after = F.col(on) - F.col("_prev")["_t"], F.col("_next")["_t"] - F.col(on)
    use_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & (before <= after))
    out = out.withColumn("_best", F.when(use_prev, F.col("_prev")).otherwise(F.col("_next")))
    dist = F.abs(F.col(on) - F.col("_best")["_t"])
    ok = dist.isNotNull() if tol is None else F.coalesce(dist < tol, F.lit(False))
    return out.select(*left.columns, *[F.when(ok, F.col("_best")[c]).alias(c if c not in left.columns else f"{c}_right")
                                       for c in cols])


def interval_join(samples: DataFrame, intervals: DataFrame, on: str, start: str, end: str, bucket: int,
                  key=KEY, how: str = "inner") -> DataFrame:
    """Samples inside ``[start, end]``: an equi-join on (key, bucket), then the exact test.

    A sample lies in one bucket and an interval is copied to each bucket it touches, so no pair appears twice.
    """
    keys = _keys(key)
    span = F.sequence(floor_div(F.col(start), bucket), floor_div(F.col(end), bucket))
    i = intervals.where(F.col(end) >= F.col(start)).withColumn("_bucket", F.explode(span))
    s = samples.withColumn("_bucket", floor_div(F.col(on), bucket))
    hit = s.join(i, [*keys, "_bucket"]).where(F.col(on).between(F.col(start), F.col(end))).drop("_bucket")
    return hit


def assign_beat(frames: DataFrame, beats: DataFrame, on: str = IDX, key=KEY, chunk: int | None = None) -> DataFrame:
    """Beat that closes each frame: the first beat at or after it; frames after the last beat get null."""
    keys = _keys(key)
    rev = lambda d: d.withColumn("_rev", -F.col(on))
    b = beats.select(*keys, on, "beat_index")
    return asof_backward(rev(frames), rev(b).drop(on), ["beat_index"], "_rev", keys, True, chunk).drop("_rev")


def with_coefficients(rows: DataFrame, coefficients: DataFrame, on: Sequence[str] = ("series", "method"),
                      max_rows: int = 10_000) -> DataFrame:
    """Attach the small coefficient table; it is broadcast only after its row count was checked."""
    small = coefficients.limit(max_rows + 1).count() <= max_rows
    return rows.join(F.broadcast(coefficients) if small else coefficients, list(on))


def align(left: DataFrame, right: DataFrame, defaults: dict[str, object], on: Sequence[str] = (KEY, "beat_index")
          ) -> DataFrame:
    """Left outer join by position with a default for every missing column."""
    out = left.join(right.select(*on, *defaults), list(on), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def label_phase(rows: DataFrame, timeline: DataFrame, on: str = "t_ms", key=KEY) -> DataFrame:
    """Phase of each row: of the phases that hold it (end exclusive, last phase open) the one that started last.

    A timeline has one row per phase, so it is folded to one small array per key, which is copied for parts of the key's rows.
    """
    keys = _keys(key)
    spans = timeline.where(F.col("start_time_ms") >= 0).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start_time_ms", "end_time_ms", "phase")), asc=False).alias("_spans"))
    inside = lambda s: (s["start_time_ms"] <= F.col(on)) & (
        (s["end_time_ms"] < 0) | (F.col(on) < s["end_time_ms"]))
    return (attach(rows, spans, keys, [on], "left")
            .withColumn("phase", F.get(F.filter("_spans", inside), F.lit(0))["phase"]).drop("_spans"))


def last_per_key(df: DataFrame, cols: Sequence[str], idx: str = IDX, key=KEY) -> DataFrame:
    keys = _keys(key)
    return df.groupBy(*keys).agg(*[F.max_by(c, idx).alias(c) for c in cols])

