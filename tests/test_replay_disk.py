"""The replay moves each number once."""

from pyspark.sql import functions as F

from beatframe.operators import replay as rp


def beats(spark):
    d = spark.range(0, 160, 1, 4).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("session_id"), F.floor(F.col("id") / 2).alias("beat_index"))
    names = ["M1_A_used", "M1_HR_used", "M1_V2P_relTTP_used", "M1_P2V_relTTP_used", "M2_A_used", "M2_E_used", "M3_Mean_used"]
    d = d.select("*", *[(F.col("beat_index") * (i + 1) % 17 / 3.0).alias(n) for i, n in enumerate(names)])
    for i, m in enumerate(rp.METHODS):  # session s1 has no valid row of M3
        bad = (F.col("beat_index") % (3 + i) == 0) | ((F.col("session_id") == "s1") & F.lit(m == "M3"))
        d = d.withColumn(f"{m}_output_valid", F.when(bad, 0).otherwise(1)).withColumn(f"{m}_reject_reason", F.when(bad, "poor").otherwise("ok"))
    return rp.feature_row(d, names)


def coefficients(spark):
    rows = [(s, m, [f"{m}_A_used"], [f"{m}_A_used"], 10, 0.5, 95.0, 40.0, [90.0] + [0.1] * 5, [38.0] + [0.2] * 5, [0.1, 0.5], [0.0, 1.5])
            for s in rp.SERIES[:3] for m in rp.METHODS]
    return spark.createDataFrame(rows, "series string, method string, feature_names array<string>, summary_source_columns array<string>, initial_baseline_beats int, "
                                 "baseline_shrinkage double, population_map_anchor double, population_pp_anchor double, baseline_map array<double>, "
                                 "baseline_pp array<double>, delta_map array<double>, delta_pp array<double>")


def test_dynamic_values_are_the_totals_of_the_terms(spark):
    models = rp.default_models()
    d = rp.dynamic_values(beats(spark), models)
    mt, pt = rp.dynamic_prediction(F.col("method"), models)
    assert d.where(~rp.total(mt).eqNullSafe(F.col("_dm")) | ~rp.total(pt).eqNullSafe(F.col("_dp"))).count() == 0


def test_wide_replay_does_not_shuffle_the_long_rows_again(spark):
    """Every beat has all methods and series; the long rows are made where the wide ones are put together."""
    rows, coef, values = beats(spark).localCheckpoint(), coefficients(spark), ["sbp", "dbp", "map", "pp"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = rp.replay(rows, coef, values=values)
        wide = rp.wide(long, values)
        moves = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert moves(wide) == moves(long)
        got = {(r.session_id, r.beat_index, r.method, r.series): r for r in long.collect()}
        assert len(got) == 2 * 80 * 3 * 4 == long.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    a = {(r.session_id, r.beat_index, r.series): r for r in rp.adaptive_baseline(rows, coef).where("method = 'M2'").collect()}
    for (s, b, m, series), r in got.items():
        ok = b % (3 + rp.METHODS.index(m)) != 0 and not (s == "s1" and m == "M3")
        assert (r.output_valid, r.reject_reason) == ((1, "ok") if ok else (0, "missing" if s == "s1" and m == "M3" else "poor"))
        assert (r.initial_baseline_beats, r.baseline_shrinkage) == (10 if ok else 0, 0.0 if s == "s1" and m == "M3" else 0.5)
        if m == "M2" and series != "RICH_DYNAMIC" and ok:
            assert (r.map, r.pp, r.sbp, r.dbp) == tuple(a[s, b, series][c] for c in ("map", "pp", "sbp", "dbp"))
        assert ok or r.map == r.sbp == 0.0
    w = {(r.session_id, r.beat_index): r for r in wide.collect()}
    assert len(w) == 160 and all(w[s, b][f"{m}_{series}_{c}"] == r[c] for (s, b, m, series), r in got.items() for c in (*values, "output_valid", "reject_reason"))
