"""Causal smoothing of pressure series and session-baseline replays.

Everything is keyed by session and method and runs on the ordinal of valid rows, so a long session is split into
blocks (see ``ewma``); invalid rows never enter the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lets import settle
from ..functions.models import ALPHA_MAP, ALPHA_PP, M1_MAP, M1_PP, calibrate, linear_predict, linear_terms, literals, total
from ..functions.quality import finite_or, is_valid
from ..functions.scalars import dbp_of, map_of, normalize_reason, pp_of, sbp_of
from .chunks import KEY, attach, cut, ewma_many, running_sum
from .joins import with_coefficients
from .rolling import first_valid

POST = ("map_raw", "pp_raw", "map_smoothed", "pp_smoothed", "map_calibrated", "pp_calibrated", "sbp_smoothed",
        "dbp_smoothed", "sbp_calibrated", "dbp_calibrated")
SERIES = ("INITIAL_BASELINE", "RICH_BASELINE", "SHARED_D_BASELINE", "RICH_DYNAMIC")
METHODS = ("M1", "M2", "M3")


def _valid_ordinal(rows: DataFrame, valid: Column, keys: Sequence[str], order: str, beside: DataFrame | None = None) -> DataFrame:
    d = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    d = running_sum(d, {"_ord": F.col("_ok").cast("bigint")}, list(keys), order, beside=beside)
    return d.withColumn("_ord", F.col("_ord") - 1)


def smooth_pair(rows: DataFrame, keys: Sequence[str], map_col: str, pp_col: str, map_out: str, pp_out: str) -> DataFrame:
    """EWMA of a MAP and a PP column along ``_ord``."""
    return ewma_many(rows, {map_out: (map_col, ALPHA_MAP), pp_out: (pp_col, ALPHA_PP)}, list(keys), "_ord")


def postprocess(rows: DataFrame, method: str = "M1", keys: Sequence[str] = (KEY,), order: str = "beat_index",
                coef: Sequence[float] | None = None) -> DataFrame:
    """Add the postprocess columns to rows with sbp, dbp, output_valid, reject_reason.

    Rows that are not valid get zeros and ``postprocess_applied = 0``; the state is held over them.
    """
    keys = list(keys)
    d = cut(_valid_ordinal(cut(rows), is_valid("output_valid", "reject_reason", "sbp", "dbp"), keys, order))
    good = d.where("_ok").withColumn("map_raw", map_of("sbp", "dbp")).withColumn("pp_raw", pp_of("sbp", "dbp"))
    good = smooth_pair(good, keys, "map_raw", "pp_raw", "map_smoothed", "pp_smoothed")
    c = calibrate("map_smoothed", "pp_smoothed", method, coef)
    good = (good.withColumn("_c", c).withColumn("map_calibrated", F.col("_c.map")).withColumn("pp_calibrated", F.col("_c.pp"))
            .withColumn("sbp_smoothed", sbp_of("map_smoothed", "pp_smoothed"))
            .withColumn("dbp_smoothed", dbp_of("map_smoothed", "pp_smoothed"))
            .withColumn("sbp_calibrated", F.col("_c.sbp")).withColumn("dbp_calibrated", F.col("_c.dbp"))
            .withColumn("postprocess_applied", F.lit(1)).drop("_c"))
    bad = d.where("not _ok").select("*", *[F.lit(0.0).alias(c) for c in POST], F.lit(0).alias("postprocess_applied"))
    return good.unionByName(bad).drop("_ok", "_ord")


def postprocess_variants(beats: DataFrame, kinds: Sequence[str] = ("e_only", "e2", "local_a"), keep: Sequence[str] = ()
                         ) -> DataFrame:
    """The same replay for variant structs, one row per (beat, variant)."""
    long = F.explode(F.array(*[F.struct(
        F.lit(k).alias("variant"), F.col(k)["sbp"].alias("sbp"), F.col(k)["dbp"].alias("dbp"),
        F.col(k)["output_valid"].alias("output_valid"), F.col(k)["reject_reason"].alias("reject_reason")) for k in kinds]))
    rows = beats.select(KEY, "beat_index", *keep, long.alias("r")).select(KEY, "beat_index", *keep, "r.*")
    return postprocess(rows, "M2", (KEY, "variant"))


def feature_row(beats: DataFrame, columns: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """Named features of a beat as one map (missing and non-finite become 0) plus status per method."""
    pairs = [x for c in columns for x in (F.lit(c), finite_or(F.col(c).cast("double")))]
    status = [F.struct(F.lit(m).alias("method"), F.col(f"{m}_output_valid").alias("output_valid"),
                       normalize_reason(F.col(f"{m}_reject_reason")).alias("reject_reason")) for m in methods]
    return beats.select(KEY, "beat_index", F.create_map(*pairs).alias("features"), F.explode(F.array(*status)).alias("s")
                        ).select(KEY, "beat_index", "features", "s.*")


def _named(names: Column) -> Column:
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(F.col("features"), n), F.lit(0.0)))


def _status_ok() -> Column:
    return F.coalesce((F.col("output_valid") == 1) & (F.col("reject_reason") == "ok"), F.lit(False))


GROUP = [KEY, "series", "method"]


def baselines(rows: DataFrame, coef: DataFrame) -> DataFrame:
    """Summary of the first valid rows of each session, and the shrunk baseline it predicts.

    At most ``initial_baseline_beats`` rows per (session, method) are kept before anything is grouped.
    """
    most = int(coef.agg(F.max("initial_baseline_beats")).first()[0] or 0)
    picked = first_valid(rows, most, _status_ok(), key=[KEY, "method"])
    d = with_coefficients(picked, coef, ["method"]).where(F.col("rank_valid") <= F.col("initial_baseline_beats"))
    parts = F.concat(
        F.transform("summary_source_columns", lambda n, i: F.struct(F.lit("s").alias("use"), i.alias("pos"), n.alias("name"))),
        F.transform("feature_names", lambda n, i: F.struct(F.lit("a").alias("use"), i.alias("pos"), n.alias("name"))))
    long = d.select(*GROUP, "rank_valid", "features", F.explode(parts).alias("c")).select(
        *GROUP, "rank_valid", "c.use", "c.pos", F.coalesce(F.try_element_at("features", "c.name"), F.lit(0.0)).alias("x"))
    stats = long.groupBy(*GROUP, "use", "pos").agg(
        F.percentile("x", [0.5, 0.1, 0.9]).alias("p"), F.stddev_pop("x").alias("sd"),
        (F.max_by("x", "rank_valid") - F.min_by("x", "rank_valid")).alias("trend"), F.count("x").alias("n"))
    item = F.struct("pos", F.array(F.get("p", F.lit(0)), F.col("sd"), F.get("p", F.lit(1)), F.get("p", F.lit(2)),
                                   F.col("trend")).alias("v"))
    of = lambda u: F.array_sort(F.collect_list(F.when(F.col("use") == u, item)))
    vec = stats.groupBy(*GROUP).agg(of("s").alias("_s"), of("a").alias("_a"), F.max("n").alias("n"))
    vec = vec.join(coef, ["series", "method"])
    by_column = F.size("baseline_map") == F.size("summary_source_columns") * 5 + 1
    column_major = F.flatten(F.transform("_s", lambda x: x["v"]))
    stat_major = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(
        F.col("_s"), lambda x: F.get(x["v"], k))))
    vec = vec.withColumn("summary", F.when(by_column, column_major).otherwise(stat_major)).withColumn(
        "anchor", F.transform("_a", lambda x: F.get(x["v"], F.lit(0))))
    shrunk = lambda raw, pop: F.col(pop) + F.col("baseline_shrinkage") * (F.col(raw) - F.col(pop))
    return (vec.withColumn("baseline_map_terms", linear_terms("baseline_map", "summary"))
            .withColumn("baseline_pp_terms", linear_terms("baseline_pp", "summary"))
            .withColumn("baseline_map_raw", linear_predict("baseline_map", "summary"))
            .withColumn("baseline_pp_raw", linear_predict("baseline_pp", "summary"))
            .withColumn("baseline_map_value", shrunk("baseline_map_raw", "population_map_anchor"))
            .withColumn("baseline_pp_value", shrunk("baseline_pp_raw", "population_pp_anchor"))
            .drop("_s", "_a", "summary"))


def adaptive_baseline(rows: DataFrame, coef: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Baseline plus centred delta, smoothed; one row per (beat, method, series) that is valid.

    ``keep`` names the further columns to store and carry through the smoothing: features, terms and coefficients of every beat are far
    larger than its pressures (default: all).  ``empty_policy`` adds the rows that have no value.  Rows with ``dynamic_values`` get these smoothed
    in the same pass, and keep their ordinal ``_ord`` for ``rich_dynamic``.
    """
    rows = cut(rows)
    return _adaptive(rows, baselines(rows, coef), keep)


def _adaptive(rows: DataFrame, base: DataFrame, keep: Sequence[str] | None, dynamic_of: str | None = None) -> DataFrame:
    """``adaptive_baseline`` of stored rows with their ``baselines``; the dynamic values of one series only, if it is named."""
    d = _valid_ordinal(rows, _status_ok(), (KEY, "method"), "beat_index", beside=base).where("_ok")
    centred = F.zip_with(_named(F.col("feature_names")), F.col("anchor"), lambda x, a: x - a)
    d = d.withColumn("_x", centred)
    d = (d.withColumn("delta_map_terms", linear_terms("delta_map", "_x")).withColumn("delta_pp_terms", linear_terms("delta_pp", "_x"))
         .withColumn("delta_map_value", linear_predict("delta_map", "_x"))
         .withColumn("delta_pp_value", linear_predict("delta_pp", "_x"))
         .withColumn("map_raw", F.col("baseline_map_value") + F.col("delta_map_value"))
         .withColumn("pp_raw", F.col("baseline_pp_value") + F.col("delta_pp_value")).drop("_x"))
    if keep is not None:
        d = d.select(*GROUP, "beat_index", "_ok", "_ord", "map_raw", "pp_raw", *keep)
    if dynamic_of is not None:
        d = d.select(*[c for c in d.columns if c not in ("_dm", "_dp")], *[F.when(F.col("series") == dynamic_of, F.col(c)).alias(c) for c in ("_dm", "_dp")])
    d = cut(d)
    dynamic = "_dm" in d.columns
    d = ewma_many(d, {"map": ("map_raw", ALPHA_MAP), "pp": ("pp_raw", ALPHA_PP)} | (
        {"dynamic_map": ("_dm", ALPHA_MAP), "dynamic_pp": ("_dp", ALPHA_PP)} if dynamic else {}), GROUP, "_ord")
    return d.withColumn("sbp", sbp_of("map", "pp")).withColumn("dbp", dbp_of("map", "pp")).drop("_ok", *([] if dynamic else ["_ord"]))


def dynamic_prediction(method: Column, models: dict) -> tuple[Column, Column]:
    """Raw dynamic MAP and PP terms per method.

    The distortion method takes the timing model on its own features plus its residual.
    """
    def terms(which: int) -> Column:
        m1, m2, m3 = models["M1"], models["M2"], models["M3"]
        base = lambda names: _named(F.array(*[F.lit(n) for n in names]))
        m2_base = [n.replace("M1_", "M2_") for n in m1["features"]]
        key = ("map", "pp")[which]
        return (F.when(method == "M1", linear_terms(literals(m1[key]), base(m1["features"])))
                .when(method == "M2", F.concat(linear_terms(literals(m1[key]), base(m2_base)),
                                               linear_terms(literals(m2[f"residual_{key}"]), base(m2["features"]))))
                .otherwise(linear_terms(literals(m3[key]), base(m3["features"]))))
    return terms(0), terms(1)


def dynamic_values(rows: DataFrame, models: dict) -> DataFrame:
    """Raw dynamic MAP and PP of each row as two numbers, so that its features need not go on.

    The totals of ``dynamic_prediction`` in plain expressions, added in the same order: the names and coefficients are known here.
    """
    m1, m2, m3 = models["M1"], models["M2"], models["M3"]
    parts = {"M1": [("", m1["features"], m1)], "M2": [("", [n.replace("M1_", "M2_") for n in m1["features"]], m1), ("residual_", m2["features"], m2)],
             "M3": [("", m3["features"], m3)]}
    used = list(dict.fromkeys(n for of in parts.values() for _, names, _ in of for n in names))
    at = {n: f"_f{i}" for i, n in enumerate(used)}
    d = rows.select("*", *[F.coalesce(F.try_element_at(F.col("features"), F.lit(n)), F.lit(0.0)).alias(c) for n, c in at.items()])

    def value(method: str, axis: str) -> Column:
        out = F.lit(0.0)
        for prefix, names, model in parts[method]:
            for i, k in enumerate(model[f"{prefix}{axis}"]):
                if i == 0:
                    out = out + F.lit(float(k))
                elif i <= len(names):
                    out = out + F.coalesce(F.lit(float(k)) * F.col(at[names[i - 1]]), F.lit(0.0))
        return out
    by_method = lambda axis: F.when(F.col("method") == "M1", value("M1", axis)).when(F.col("method") == "M2", value("M2", axis)).otherwise(value("M3", axis))
    d = settle(d, *at.values()).select("*", by_method("map").alias("_dm"), by_method("pp").alias("_dp"))
    return settle(d.drop(*at.values()), "_dm", "_dp").select(*rows.columns, "_dm", "_dp")


def rich_dynamic(rich: DataFrame, models: dict, blend: dict | None = None, stored: bool = False) -> DataFrame:
    """Blend of the rich baseline with the dynamic model's change since its own anchor.

    Rows with ``dynamic_values`` are taken with these, and as ``adaptive_baseline`` numbered and smoothed them if it did; others need features and
    give the terms too.
    """
    blend = blend or {}
    k = max(1, int(blend.get("dynamic_anchor_beats", 30)))
    gain = lambda axis: _gain(blend, axis)
    keys = [KEY, "method"]
    d = rich
    if "_dm" not in rich.columns:
        mt, pt = dynamic_prediction(F.col("method"), models)
        d = rich.withColumn("dynamic_map_terms", mt).withColumn("dynamic_pp_terms", pt)
        d = d.withColumn("_dm", total("dynamic_map_terms")).withColumn("_dp", total("dynamic_pp_terms"))
    if not {"_ord", "dynamic_map", "dynamic_pp"} <= set(d.columns):
        d = cut(_valid_ordinal(d, F.lit(True), keys, "beat_index").drop("_ok"))
        d = smooth_pair(d, keys, "_dm", "_dp", "dynamic_map", "dynamic_pp")
    elif not stored:
        d = cut(d)  # the anchors read it before its rows are joined to them
    anchor = d.where(F.col("_ord") < k).groupBy(*keys).agg(
        *[F.median(c).alias(a) for c, a in (("_dm", "_am"), ("_dp", "_ap"), ("dynamic_map", "_sm"), ("dynamic_pp", "_sp"))])
    d = attach(d, anchor, keys, ["beat_index"])
    d = (d.withColumn("dynamic_gain_map", gain("MAP")).withColumn("dynamic_gain_pp", gain("PP"))
         .withColumnRenamed("map", "rich_map").withColumnRenamed("pp", "rich_pp")
         .withColumn("dynamic_delta_map", F.col("dynamic_map") - F.col("_sm"))
         .withColumn("dynamic_delta_pp", F.col("dynamic_pp") - F.col("_sp")))
    d = (d.withColumn("map", F.col("rich_map") + F.col("dynamic_gain_map") * F.col("dynamic_delta_map"))
         .withColumn("pp", F.col("rich_pp") + F.col("dynamic_gain_pp") * F.col("dynamic_delta_pp"))
         .withColumn("map_raw", F.col("map_raw") + F.col("dynamic_gain_map") * (F.col("_dm") - F.col("_am")))
         .withColumn("pp_raw", F.col("pp_raw") + F.col("dynamic_gain_pp") * (F.col("_dp") - F.col("_ap"))))
    return (d.withColumn("sbp", sbp_of("map", "pp")).withColumn("dbp", dbp_of("map", "pp"))
            .withColumn("series", F.lit("RICH_DYNAMIC")).drop("_dm", "_dp", "_ord", "_am", "_ap", "_sm", "_sp"))


def _gain(blend: dict, axis: str) -> Column:
    default = blend.get(f"dynamic_gain_{axis}", 0.25)
    by_method = blend.get(f"dynamic_gain_{axis}_by_method") or {}
    out = F.lit(float(default))
    for m, v in by_method.items():
        out = F.when(F.col("method") == m, F.lit(float(v))).otherwise(out)
    return out


VALUES = ("sbp", "dbp", "map", "pp", "map_raw", "pp_raw", "baseline_map_raw", "baseline_pp_raw", "baseline_map_value",
          "baseline_pp_value", "delta_map_value", "delta_pp_value", "rich_map", "rich_pp", "dynamic_map", "dynamic_pp",
          "dynamic_delta_map", "dynamic_delta_pp", "dynamic_gain_map", "dynamic_gain_pp")


def empty_policy(rows: DataFrame, results: DataFrame, coef: DataFrame | None, known: DataFrame | None = None) -> DataFrame:
    """All (beat, method, series) rows: values where a replay ran, zeros with a reason elsewhere.

    Without usable coefficients, or in a session without any valid row, everything is 'missing'.  ``known`` has the method, series and
    baseline_shrinkage and n of each session's results, where these are stored apart.  Rows and results meet once, by beat, and stay there;
    sbp and dbp of results are those of their map and pp.
    """
    values = [c for c in VALUES if c in results.columns] if coef is not None else []
    grid = rows.select(KEY, "beat_index", "method", "reject_reason").withColumn(
        "series", F.explode(F.array(*[F.lit(s) for s in SERIES])))
    if coef is None:
        return grid.select(KEY, "beat_index", "method", "series", *[F.lit(0.0).alias(v) for v in VALUES],
                           F.lit(0).alias("initial_baseline_beats"), F.lit(0.0).alias("baseline_shrinkage"),
                           F.lit(0).alias("output_valid"), F.lit("missing").alias("reject_reason"))
    ids = [KEY, "beat_index"]
    known = (results if known is None else known).groupBy(KEY, "method").agg(*[
        F.max(F.when(F.col("series") == x, F.struct("baseline_shrinkage", F.col("n").alias("initial_baseline_beats")))).alias(f"_k{i}") for i, x in enumerate(SERIES)])
    sent = [v for v in values if v not in ("sbp", "dbp") or not {"map", "pp"} <= set(values)]
    spot = F.coalesce(*[F.when(F.col("series") == x, i) for i, x in enumerate(SERIES)])
    ran = results.select(*ids, F.struct("method", spot.alias("spot"), *sent, F.lit(1).alias("output_valid")).alias("_r"))
    ran = ran.repartition(*ids).groupBy(*ids).agg(F.collect_list("_r").alias("_ran"))
    d = attach(rows.select(*ids, "method", "reject_reason"), known, [KEY, "method"], ["beat_index"], "left").join(ran, ids, "left")
    d = d.withColumn("_ran", F.filter("_ran", lambda x: x["method"] == F.col("method")))
    d = d.select(*ids, "method", "reject_reason", "_ran", F.posexplode(F.array(*[F.struct(F.lit(x).alias("series"), F.col(f"_k{i}").alias("k")) for i, x in enumerate(SERIES)])).alias("_i", "_s"))
    d = d.select(*ids, "method", "reject_reason", "_s.series", "_s.k.baseline_shrinkage", "_s.k.initial_baseline_beats",
                 F.explode_outer(F.filter("_ran", lambda x: x["spot"] == F.col("_i"))).alias("_r"))
    d = d.select(*[c for c in d.columns if c not in ("_r", "initial_baseline_beats")], *[F.col(f"_r.{c}").alias(c) for c in (*sent, "output_valid")],
                 F.when(F.col("_r").isNotNull(), F.col("initial_baseline_beats")).alias("initial_baseline_beats"))
    if len(sent) < len(values):
        d = d.withColumn("sbp", sbp_of("map", "pp")).withColumn("dbp", dbp_of("map", "pp"))
    reason = (F.when(F.col("output_valid") == 1, "ok").when(F.col("baseline_shrinkage").isNull(), "missing")
              .otherwise(F.col("reject_reason")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return d.select(KEY, "beat_index", "method", "series", *[zero(v) if v in values else F.lit(0.0).alias(v) for v in VALUES],
                    F.coalesce("initial_baseline_beats", F.lit(0)).cast("int").alias("initial_baseline_beats"), zero("baseline_shrinkage"),
                    F.coalesce("output_valid", F.lit(0)).alias("output_valid"), reason.alias("reject_reason"))


#: Numbers that the long form takes of each valid beat, beside the smoothed ones.
LONG = ("n", "baseline_shrinkage", "baseline_map_raw", "baseline_pp_raw", "baseline_map_value", "baseline_pp_value", "delta_map_value",
        "delta_pp_value")


def replay(rows: DataFrame, coef: DataFrame | None, models: dict | None = None, blend: dict | None = None,
           values: Sequence[str] = VALUES) -> DataFrame:
    """All four series for all methods in long form; of the pressures and their parts, ``values``."""
    if coef is None:
        return empty_policy(rows, rows, None)
    models = models or default_models()
    rows = cut(dynamic_values(rows, models))
    inner, rich_series = ["_ord", "_dm", "_dp", "dynamic_map", "dynamic_pp"], "RICH_BASELINE"
    is_rich, base = F.col("series") == rich_series, cut(baselines(rows, coef))
    adaptive = _adaptive(rows, base, [*[c for c in LONG if c in values], "_dm", "_dp"], rich_series)
    unread = [c for c in ("map_raw", "pp_raw") if c not in values]
    adaptive = cut(adaptive.select(*[F.lit(None).cast("double").alias(c) if c in unread else F.col(c) for c in adaptive.columns if c not in (*inner, "sbp", "dbp")],
                                   *[F.when(is_rich, F.col(c)).alias(c) for c in inner]))
    adaptive = adaptive.withColumn("sbp", sbp_of("map", "pp")).withColumn("dbp", dbp_of("map", "pp"))
    rich = rich_dynamic(adaptive.where(is_rich), models, blend, stored=True)
    known = base.select(KEY, "method", "series", "baseline_shrinkage", "n")
    known = known.unionByName(known.where(is_rich).withColumn("series", F.lit("RICH_DYNAMIC")))
    out = empty_policy(rows, adaptive.drop(*inner).unionByName(rich, allowMissingColumns=True), coef, known)
    return out.drop(*[v for v in VALUES if v not in values])


def wide(long: DataFrame, values: Sequence[str] = VALUES) -> DataFrame:
    """One row per beat, one column per method, series and value; the names are listed, so no scan finds them."""
    fields = [*values, "output_valid", "reject_reason"]
    of = [(m, x) for m in METHODS for x in SERIES]
    spot = F.coalesce(*[F.when((F.col("method") == m) & (F.col("series") == x), i) for i, (m, x) in enumerate(of)])
    rows = settle(long.select(KEY, "beat_index", spot.alias("_at"), *fields), "_at")
    return rows.groupBy(KEY, "beat_index").agg(*[F.max(F.when(F.col("_at") == i, F.col(v))).alias(f"{m}_{x}_{v}") for i, (m, x) in enumerate(of) for v in fields])


def default_models() -> dict:
    from ..functions import models as m
    return {"M1": {"features": ["M1_A_used", "M1_HR_used", "M1_V2P_relTTP_used", "M1_P2V_relTTP_used"],
                   "map": M1_MAP, "pp": M1_PP},
            "M2": {"features": ["M2_E_used"], "residual_map": m.M2_RESIDUAL_MAP, "residual_pp": m.M2_RESIDUAL_PP},
            "M3": {"features": ["M3_A_used", "M3_HR_used", "M3_Mean_used", "M3_sinPhi_used", "M3_cosPhi_used"],
                   "map": m.M3_MAP, "pp": m.M3_PP}}
