"""Scores are computed in short stages and only as far as they are read; with results of hand-made rows."""

from pyspark.sql import functions as F

from beatframe.functions import models as m
from beatframe.operators import replay as rp

def _feats():
    return {"A": F.col("a"), "HR": F.col("hr"), "V2P_relTTP": F.lit(-0.5), "P2V_relTTP": F.lit(-0.5), "E": F.lit(1.0)}


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_reason_makes_no_clamp_notes(spark):
    d = spark.createDataFrame([(3.0, 70.0), (9.0, 70.0), (9.0, 300.0)], "a double, hr double")
    p = m.predict(d, "M2", _feats(), "p")
    reasons = p.select("a", "hr", "p.reject_reason", "p.output_valid")
    assert "format_string" not in _plan(reasons)
    assert [r.reject_reason == "feature_support_violation" for r in reasons.collect()] == [False, False, True]
    assert p.where("hr = 300").first().p.feature_clamp_reason == "A:9.0000->5.0983|HR:300.0000->105.5232"


def test_variant_makes_no_clamp_notes(spark):
    d = spark.createDataFrame([(3.0, 70.0), (9.0, 300.0)], "a double, hr double")
    for kind in ("e_only", "e2", "local_a"):
        v = m.with_variant(d, kind, F.col("a"), F.col("hr"), F.lit(-0.5), F.lit(-0.5), F.lit(1.0))
        assert "format_string" not in _plan(v.select(f"{kind}.sbp", f"{kind}.reject_reason"))
        good, bad = [r[kind] for r in v.orderBy("a").collect()]
        assert good.feature_clamp_reason == "ok" and good.sbp_raw == good.sbp_constrained and abs(sum(good.sbp_terms) - good.sbp_base - good.sbp_correction) < 1e-9
        assert bad.reject_reason == "feature_support_violation" and bad.sbp == 0 and bad.feature_clamp_applied == 1


def test_rows_of_one_method(spark):
    d = spark.createDataFrame([("s", 1, 2.0, 1, "ok")], "session_id string, beat_index long, M1_A_used double, M1_output_valid int, M1_reject_reason string")
    assert [tuple(r) for r in rp.feature_row(d, ["M1_A_used"], ("M1",)).collect()] == [("s", 1, {"M1_A_used": 2.0}, "M1", 1, "ok")]


def test_adaptive_baseline_stores_what_is_kept(spark, monkeypatch):
    from catalog.model_queries import coefficient_fixture

    stored, cut = [], rp.cut
    monkeypatch.setattr(rp, "cut", lambda d: stored.append(d.columns) or cut(d))
    names = ["M1_A_used", "M1_HR_used", "M1_V2P_relTTP_used", "M1_P2V_relTTP_used"]
    d = spark.range(1, 41).select(F.lit("s").alias("session_id"), F.col("id").alias("beat_index"), *[(F.col("id") % 7 + i).cast("double").alias(c) for i, c in enumerate(names)],
                                  F.lit(1).alias("M1_output_valid"), F.when(F.col("id") % 5 == 0, "poor").otherwise("ok").alias("M1_reject_reason"))
    rows = rp.feature_row(d, names, ("M1",))
    coef = coefficient_fixture(spark).where("method = 'M1'")
    small = {tuple(r) for r in rp.adaptive_baseline(rows, coef, ["n"]).select("series", "beat_index", "n", "map_raw", "map", "pp").collect()}
    assert "features" not in stored[-1] and "delta_map_terms" not in stored[-1]
    whole = rp.adaptive_baseline(rows, coef)
    assert {tuple(r) for r in whole.select("series", "beat_index", "n", "map_raw", "map", "pp").collect()} == small and len(small) == 96
    rich = whole.where("series = 'RICH_BASELINE'")
    models = rp.default_models()
    a = rp.rich_dynamic(rich, models).select("beat_index", "map", "pp", "dynamic_map").collect()
    b = rp.rich_dynamic(rp.adaptive_baseline(rp.dynamic_values(rows, models), coef.where("series = 'RICH_BASELINE'"), ["_dm", "_dp"]), models)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b.select("beat_index", "map", "pp", "dynamic_map").collect()))


def test_zone_points_are_constants(spark):
    from beatframe.functions.scalars import in_zone_area

    d = spark.createDataFrame([(640.0, 0.0), (640.0, 1000.0), (0.0, 0.0)], "area double, cx double")
    z = d.select(in_zone_area("area", "cx", F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("z"))
    assert "COS(" not in _plan(z).upper() and [r.z for r in z.collect()] == [320.0, 0.0, 0.0]
