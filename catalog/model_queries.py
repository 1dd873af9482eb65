"""Models, postprocess and baseline replays on the feature rows."""

from pyspark.sql import functions as F

from beatframe.functions import models as m
from beatframe.operators import replay as rp
from beatframe.operators.aggregates import valid_counts
from .base import BF, BF0, REF, ROW, ROWS, feature_rows, query, r6, reference_bp

C = F.col


def feats(extra=()):
    d = {"A": C("A"), "HR": C("HR"), "V2P_relTTP": C("V2P"), "P2V_relTTP": C("P2V"), "E": C("E"), "Mean": C("A") + 1,
         "sinPhi": C("V2P") + 0.5, "cosPhi": C("P2V") + 0.4}
    return d


def cl(c, lo, hi):
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {c}))"


def lin(coefs, names):
    return " + ".join([f"{coefs[0]!r}::DOUBLE"] + [f"{c!r}::DOUBLE * {n}" for c, n in zip(coefs[1:], names)])


def used_sql(model, exprs):
    """CTE u: used features u0.., number of clamped ones nc."""
    mod = m.MODELS[model]
    used, moved = [], []
    for i, n in enumerate(mod.features):
        lo, hi = mod.supports[n]
        x = f"least({hi}::DOUBLE, {exprs[n]})" if lo is None else cl(exprs[n], lo, hi)
        used.append(f"{x} AS u{i}")
        moved.append(f"CAST(abs({x} - ({exprs[n]})) > 1e-9 AS INT)")
    return f"u AS (SELECT *, {', '.join(used)}, {' + '.join(moved)} AS nc FROM bf)"


EXPR = {"A": "A", "HR": "HR", "V2P_relTTP": "V2P", "P2V_relTTP": "P2V", "E": "E", "Mean": "(A + 1)", "sinPhi": "(V2P + 0.5)", "cosPhi": "(P2V + 0.4)"}
BPR = "CASE WHEN s < 60 OR s > 200 THEN 'sbp_out_of_range' WHEN d < 40 OR d > 150 THEN 'dbp_out_of_range' WHEN s <= d THEN 'sbp_not_above_dbp' WHEN s - d < 20 OR s - d > 100 THEN 'pulse_pressure_out_of_range' ELSE 'ok' END"
TIMING = "abs(V2P) + abs(P2V) < 0.80 OR abs(V2P) + abs(P2V) > 1.30"


def score_sql(model, id_cols, head):
    mod = m.MODELS[model]
    names = [f"u{i}" for i in range(len(mod.features))]
    lift = "s0" if mod.min_pp is None else "CASE WHEN s0 < d0 + 20 THEN d0 + 20 ELSE s0 END"
    stops = []
    if mod.uses_timing:
        stops.append(f"WHEN {TIMING} THEN 'rel_ttp_sum_out_of_range'")
    if mod.reject_on_clamps:
        stops.append("WHEN nc > 1 THEN 'feature_support_violation'")
    bp = BPR if mod.check_bp else "'ok'"
    return f"""{head}, {used_sql(model, EXPR)}, p AS (SELECT *, {lin(mod.map_coefs, names)} AS mp, {lin(mod.pp_coefs, names)} AS pp FROM u),
q AS (SELECT *, mp - pp / 3.0 AS d0, mp - pp / 3.0 + pp AS s0 FROM p), r AS (SELECT *, greatest(60.0, least(200.0, {lift})) AS s, greatest(40.0, least(150.0, d0)) AS d FROM q),
sc AS (SELECT *, CASE {' '.join(stops)} ELSE {bp} END AS reason, CASE {' '.join(stops).replace("THEN 'rel_ttp_sum_out_of_range'", 'THEN 0').replace("THEN 'feature_support_violation'", 'THEN 0')} ELSE 1 END AS ran FROM r)"""


for _model in ("M1", "M2", "M3"):
    @query({"M1": "m2_model_timing", "M2": "m3_model_distortion", "M3": "m4_model_harmonic"}[_model],
           score_sql(_model, ROWS, f"WITH {BF0}") + f""" SELECT {ROWS}, reason AS reject_reason, round(CASE WHEN ran = 1 THEN mp END, 6) AS map_raw, round(CASE WHEN ran = 1 THEN pp END, 6) AS pp_raw,
 round(CASE WHEN ran = 1 THEN s END, 6) AS sbp, round(CASE WHEN ran = 1 THEN d END, 6) AS dbp, CASE WHEN ran = 1 AND s0 < d0 + 20 THEN 1 ELSE 0 END AS constraint_applied,
 CASE WHEN ran = 1 AND (abs(s - s0) > 1e-9 OR abs(d - d0) > 1e-9) THEN 1 ELSE 0 END AS clamp_applied FROM sc""")
    def score(spark, sf, model=_model):
        d = m.predict(feature_rows(spark, sf, indexed=False), model, feats(), "m")
        return d.select(*ROW, "m.reject_reason", *[r6(f"m.{c}").alias(c) for c in ("map_raw", "pp_raw", "sbp", "dbp")], "m.constraint_applied", "m.clamp_applied")


@query("m1_linear_terms", f"WITH {BF0} SELECT {ROWS}, i, round(CASE i WHEN 0 THEN {m.M1_MAP[0]!r}::DOUBLE WHEN 1 THEN {m.M1_MAP[1]!r}::DOUBLE * A WHEN 2 THEN {m.M1_MAP[2]!r}::DOUBLE * HR ELSE 0 END, 6) AS term FROM bf, range(0, 5) t(i)")
def terms(spark, sf):
    d = feature_rows(spark, sf, indexed=False)
    return d.select(*ROW, F.posexplode(m.linear_terms(m.literals(m.M1_MAP), F.array("A", "HR"))).alias("i", "term")).select(*ROW, C("i").cast("bigint").alias("i"), r6("term").alias("term"))


VAR_COLS = ("sbp", "dbp", "sbp_raw", "dbp_raw", "sbp_base", "dbp_base", "sbp_correction", "dbp_correction", "stiffness_used")


def variant_sql(kind, head):
    S, D = m.sbp_coefs(m.M1_MAP, m.M1_PP), m.dbp_coefs(m.M1_MAP, m.M1_PP)
    sup = {**m.M2_SUPPORT, "E": (None, m.E_MAX)}
    parts = {"A": "A", "HR": "HR", "V2P_relTTP": "V2P", "P2V_relTTP": "P2V"}
    used = [f"{cl(x, *sup[n])} AS u{i}" for i, (n, x) in enumerate(parts.items())] + [f"least({m.E_MAX}::DOUBLE, E) AS ue"]
    moved = [f"CAST(abs({cl(x, *sup[n])} - {x}) > 1e-9 AS INT)" for n, x in parts.items()] + [f"CAST(E - {m.E_MAX}::DOUBLE > 1e-9 AS INT)"]
    extra = {"e_only": ["ue"], "e2": ["ue", "ue * ue"], "local_a": ["us", "ue"]}[kind]
    stiff = f", least({m.STIFFNESS_MAX}::DOUBLE, ue * sqrt(u0)) AS us, nc0 + CAST(ue * sqrt(u0) - {m.STIFFNESS_MAX}::DOUBLE > 1e-9 AS INT) AS nc" if kind == "local_a" else ", 0.0::DOUBLE AS us, nc0 AS nc"
    names = ["u0", "u1", "u2", "u3"]
    return f"""{head}, v0 AS (SELECT *, {', '.join(used)}, {' + '.join(moved)} AS nc0 FROM bf), v1 AS (SELECT *{stiff} FROM v0),
v2 AS (SELECT *, {lin(S, names)} AS sb, {lin(D, names)} AS db, {lin(m.VARIANT_SBP[kind], extra)} AS sc, {lin(m.VARIANT_DBP[kind], extra)} AS dc FROM v1),
v3 AS (SELECT *, CASE WHEN sb + sc < db + dc + 20 THEN db + dc + 20 ELSE sb + sc END AS s1, db + dc AS d1 FROM v2), v4 AS (SELECT *, greatest(60.0, least(200.0, s1)) AS s, greatest(40.0, least(150.0, d1)) AS d FROM v3),
v5 AS (SELECT *, CASE WHEN {TIMING} THEN 'rel_ttp_sum_out_of_range' WHEN nc > 1 THEN 'feature_support_violation' ELSE {BPR} END AS reason, CASE WHEN {TIMING} OR nc > 1 THEN 0 ELSE 1 END AS ran FROM v4)"""


_VSEL = """round(CASE WHEN reason = 'ok' THEN s ELSE 0 END, 6) AS sbp, round(CASE WHEN reason = 'ok' THEN d ELSE 0 END, 6) AS dbp, round(ran * s, 6) AS sbp_raw, round(ran * d, 6) AS dbp_raw,
 round(ran * sb, 6) AS sbp_base, round(ran * db, 6) AS dbp_base, round(ran * sc, 6) AS sbp_correction, round(ran * dc, 6) AS dbp_correction, round(ran * us, 6) AS stiffness_used"""
VARG = ("A", "HR", "V2P", "P2V", "E")
for _kind, _name in (("e_only", "m5_variant_e"), ("e2", "m6_variant_e2"), ("local_a", "m7_variant_local")):
    @query(_name, variant_sql(_kind, f"WITH {BF0}") + f" SELECT {ROWS}, reason AS reject_reason, {_VSEL} FROM v5")
    def variant(spark, sf, kind=_kind):
        d = m.with_variant(feature_rows(spark, sf, indexed=False), kind, *[C(a) for a in VARG], out="v")
        return d.select(*ROW, "v.reject_reason", *[r6(f"v.{c}").alias(c) for c in VAR_COLS])


@query("m8_constrain", f"""WITH {REF}, x AS (SELECT o_orderkey, sbp * 1.5::DOUBLE AS s, dbp + 60.0 AS d FROM ref), y AS (SELECT *, CASE WHEN s < d + 20 THEN d + 20 ELSE s END AS s1 FROM x)
SELECT o_orderkey, round(greatest(60, least(200, s1)), 6) AS sbp, round(greatest(40, least(150, d)), 6) AS dbp, CAST(s < d + 20 AS INT) AS constraint_applied,
 CAST(abs(greatest(60, least(200, s1)) - s) > 1e-9 OR abs(greatest(40, least(150, d)) - d) > 1e-9 AS INT) AS clamp_applied FROM y""")
def constrain(spark, sf):
    d = reference_bp(spark, sf).withColumn("c", m.constrain(C("sbp") * 1.5, C("dbp") + 60))
    return d.select("o_orderkey", r6("c.sbp").alias("sbp"), r6("c.dbp").alias("dbp"), "c.constraint_applied", "c.clamp_applied")


@query("m9_coefficient_algebra", f"WITH {BF0} SELECT {ROWS}, round(A + 2.0 / 3 * HR, 6) AS s0, round(HR + 2.0 / 3 * E, 6) AS s1, round(A - HR / 3, 6) AS d0, round(HR - E / 3, 6) AS d1 FROM bf")
def algebra(spark, sf):
    d = feature_rows(spark, sf, indexed=False)
    s, dd = m.to_sbp_coefs(F.array("A", "HR"), F.array("HR", "E")), m.to_dbp_coefs(F.array("A", "HR"), F.array("HR", "E"))
    return d.select(*ROW, *[r6(F.get(x, F.lit(i))).alias(f"{n}{i}") for n, x in (("s", s), ("d", dd)) for i in (0, 1)])


# ---------------------------------------------------------------- postprocess
def scored_rows(spark, sf, model="M1"):
    d = m.predict(feature_rows(spark, sf), model, feats(), "m")
    return d.select("session_id", "beat_index", F.coalesce("m.sbp", F.lit(0.0)).alias("sbp"), F.coalesce("m.dbp", F.lit(0.0)).alias("dbp"), "m.output_valid", "m.reject_reason")


def post_sql(src, keys, extra=""):
    """Recursive smoothing over valid rows of ``src`` (keys, beat_index, s, d, ok)."""
    k = ", ".join(keys)
    on = " AND ".join(f"f.{x} = c.{x}" for x in keys)
    return f"""vr AS MATERIALIZED (SELECT {k}, beat_index, (s + 2.0 * d) / 3.0 AS mr, s - d AS pr, row_number() OVER (PARTITION BY {k} ORDER BY beat_index) AS rk FROM {src} WHERE ok),
f AS (SELECT {k}, beat_index, rk, mr, pr, mr AS ms, pr AS ps FROM vr WHERE rk = 1 UNION ALL
SELECT {', '.join('c.' + x for x in keys)}, c.beat_index, c.rk, c.mr, c.pr, 0.3 * c.mr + 0.7 * f.ms, 0.5 * c.pr + 0.5 * f.ps FROM f JOIN vr c ON {on} AND c.rk = f.rk + 1)
SELECT {', '.join('a.' + x for x in keys)}, a.beat_index, round(coalesce(mr, 0), 5) AS map_raw, round(coalesce(ms, 0), 5) AS map_smoothed, round(coalesce(ps, 0), 5) AS pp_smoothed, round(coalesce(ms - ps / 3 + ps, 0), 5) AS sbp_smoothed,
 round(coalesce(ms - ps / 3, 0), 5) AS dbp_calibrated, CASE WHEN rk IS NULL THEN 0 ELSE 1 END AS postprocess_applied FROM {src} a LEFT JOIN f ON {' AND '.join(f'a.{x} = f.{x}' for x in keys)} AND a.beat_index = f.beat_index"""


POST_SEL = ["map_raw", "map_smoothed", "pp_smoothed", "sbp_smoothed", "dbp_calibrated"]


def r5(d, *cols):
    return d.select(*[F.round(c, 5).alias(c) if c in cols else C(c) for c in d.columns])


for _model in ("M1", "M2", "M3"):
    @query(f"r1_f3_postprocess_{_model.lower()}", score_sql(_model, "", f"WITH RECURSIVE {BF}") + ", src AS MATERIALIZED (SELECT session_id, beat_index, s, d, reason = 'ok' AS ok FROM sc), " + post_sql("src", ["session_id"]))
    def post(spark, sf, model=_model):
        d = rp.postprocess(scored_rows(spark, sf, model), model)
        return r5(d.select("session_id", "beat_index", *POST_SEL, "postprocess_applied"), *POST_SEL)


_union = " UNION ALL ".join(f"SELECT session_id, beat_index, '{k}' AS variant, s, d, reason = 'ok' AS ok FROM {k}_v" for k in ("e_only", "e2", "local_a"))


def _all_variants():
    parts = []
    for k in ("e_only", "e2", "local_a"):
        body = variant_sql(k, "X").split("X, ", 1)[1]
        for n in ("v0", "v1", "v2", "v3", "v4", "v5"):
            body = body.replace(f"{n} AS (", f"{k}_{n} AS (").replace(f"FROM {n})", f"FROM {k}_{n})")
        parts.append(body.replace(f"{k}_v5", f"{k}_v"))
    return ", ".join(parts)


@query("r2_postprocess_variants", f"WITH RECURSIVE {BF}, {_all_variants()}, src AS MATERIALIZED ({_union}), " + post_sql("src", ["session_id", "variant"]))
def post_variants(spark, sf):
    d = feature_rows(spark, sf)
    for k in ("e_only", "e2", "local_a"):
        # the fields that the replay reads, before the next branch: nothing else is computed or carried on
        d = m.with_variant(d, k, *[C(a) for a in VARG]).withColumn(k, F.struct(*[C(k)[f].alias(f) for f in ("sbp", "dbp", "output_valid", "reject_reason")]))
    out = rp.postprocess_variants(d)
    return r5(out.select("session_id", "variant", "beat_index", *POST_SEL, "postprocess_applied"), *POST_SEL)


@query("q9_a19_valid_counts", "WITH " + score_sql("M2", "", f"{BF}") + " SELECT session_id, count(*) FILTER (WHERE reason = 'ok') AS M2_valid FROM sc GROUP BY 1")
def counts(spark, sf):
    d = m.predict(feature_rows(spark, sf), "M2", feats(), "m")
    d = d.withColumn("M2", F.struct("m.sbp", "m.dbp", C("m.output_valid").alias("valid"), "m.reject_reason"))
    return valid_counts(d, ["M2"], ["session_id"])


# ---------------------------------------------------------------- baselines
FEATURE_COLS = ["M1_A_used", "M1_HR_used", "M1_V2P_relTTP_used", "M1_P2V_relTTP_used", "M2_A_used", "M2_HR_used", "M2_V2P_relTTP_used",
                "M2_P2V_relTTP_used", "M2_E_used", "M3_A_used", "M3_HR_used", "M3_Mean_used", "M3_sinPhi_used", "M3_cosPhi_used"]


def replay_rows(spark, sf, methods=rp.METHODS):
    """Rows of ``methods`` with the used features of these methods."""
    d = feature_rows(spark, sf)
    for k in methods:
        # flat before the next model: terms and notes that no one reads are not computed
        d = m.predict(d, k, feats())
        used = [F.get(C(k)["used"], F.lit(i)).alias(f"{k}_{n}_used") for i, n in enumerate(m.MODELS[k].features)]
        d = d.select(*[c for c in d.columns if c != k], *used, C(k)["output_valid"].alias(f"{k}_output_valid"), C(k)["reject_reason"].alias(f"{k}_reject_reason"))
    return rp.feature_row(d, [c for c in FEATURE_COLS if c[:2] in methods], methods)


# a small coefficient set for the shape that has no published values: two columns in each layout
COEF = [(s, k, [f"{k}_A_used", f"{k}_HR_used"], [f"{k}_A_used", f"{k}_HR_used"], 20 + i * 5, 0.5 + 0.1 * i, 95.0 + i, 40.0 + i,
         [90.0] + [0.1 * (j + 1) for j in range(n)], [38.0] + [0.05 * (j + 1) for j in range(n)], [0.1, 0.5, -0.02], [0.0, 1.5, 0.03])
        for i, (s, n) in enumerate((("INITIAL_BASELINE", 8), ("RICH_BASELINE", 10), ("SHARED_D_BASELINE", 8))) for k in ("M1", "M2", "M3")]
COEF_DDL = ("series string, method string, feature_names array<string>, summary_source_columns array<string>, initial_baseline_beats int, "
            "baseline_shrinkage double, population_map_anchor double, population_pp_anchor double, baseline_map array<double>, "
            "baseline_pp array<double>, delta_map array<double>, delta_pp array<double>")


def coefficient_fixture(spark):
    return spark.createDataFrame(COEF, COEF_DDL)


def _adaptive_sql(series, model):
    row = next(r for r in COEF if r[0] == series and r[1] == model)
    n, sh, pm, pp_, bm, bp, dm, dp = row[4], row[5], row[6], row[7], row[8], row[9], row[10], row[11]
    st = {"median": "median({c})", "std": "stddev_pop({c})", "p10": "quantile_cont({c}, 0.1)", "p90": "quantile_cont({c}, 0.9)", "trend": "max_by({c}, beat_index) - min_by({c}, beat_index)"}
    base = ["median", "std", "p10", "p90"]
    vec = [st[s].format(c=c) for c in ("u0", "u1") for s in (*base, "trend")] if len(bm) == 11 else [st[s].format(c=c) for s in base for c in ("u0", "u1")]
    f = lambda cs: " + ".join([f"{cs[0]!r}"] + [f"{c!r} * {v}" if " - " not in v else f"{c!r} * ({v})" for c, v in zip(cs[1:], vec)])
    head = score_sql(model, "", f"WITH RECURSIVE {BF}")
    return head + f""", iv AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY beat_index) AS rk FROM sc WHERE reason = 'ok'),
bl AS (SELECT session_id, count(*) AS n, {f(bm)} AS mraw, {f(bp)} AS praw, median(u0) AS a0, median(u1) AS a1 FROM iv WHERE rk <= {n} GROUP BY 1),
dl AS MATERIALIZED (SELECT iv.session_id, beat_index, rk, bl.n, mraw, {pm!r} + {sh!r} * (mraw - {pm!r}) + {dm[0]!r} + {dm[1]!r} * (u0 - a0) + {dm[2]!r} * (u1 - a1) AS mr,
 {pp_!r} + {sh!r} * (praw - {pp_!r}) + {dp[0]!r} + {dp[1]!r} * (u0 - a0) + {dp[2]!r} * (u1 - a1) AS pr FROM iv JOIN bl USING (session_id)),
f AS (SELECT session_id, beat_index, rk, n, mraw, mr, pr, mr AS ms, pr AS ps FROM dl WHERE rk = 1 UNION ALL
SELECT c.session_id, c.beat_index, c.rk, c.n, c.mraw, c.mr, c.pr, 0.3 * c.mr + 0.7 * f.ms, 0.5 * c.pr + 0.5 * f.ps FROM f JOIN dl c ON f.session_id = c.session_id AND c.rk = f.rk + 1)
SELECT session_id, beat_index, n, round(mraw, 5) AS baseline_map_raw, round(mr, 5) AS map_raw, round(pr, 5) AS pp_raw, round(ms, 5) AS map, round(ps, 5) AS pp FROM f"""


for _series, _model, _name in (("INITIAL_BASELINE", "M1", "r3_adaptive_initial"), ("RICH_BASELINE", "M3", "r3_adaptive_rich")):
    @query(_name, _adaptive_sql(_series, _model))
    def adaptive(spark, sf, series=_series, model=_model):
        rows = replay_rows(spark, sf, (model,))
        coef = coefficient_fixture(spark).where((C("series") == series) & (C("method") == model))
        d = rp.adaptive_baseline(rows, coef, ["n", "baseline_map_raw"])
        cols = ["baseline_map_raw", "map_raw", "pp_raw", "map", "pp"]
        return r5(d.select("session_id", "beat_index", "n", *cols), *cols)


@query("r4_r5_rich_dynamic")
def rich_dynamic(spark, sf):
    coef = coefficient_fixture(spark).where(C("series") == "RICH_BASELINE")
    rich = rp.adaptive_baseline(rp.dynamic_values(replay_rows(spark, sf), rp.default_models()), coef, ["_dm", "_dp"])
    d = rp.rich_dynamic(rich, rp.default_models(), {"dynamic_gain_MAP": 0.5, "dynamic_gain_PP_by_method": {"M2": 0.1}})
    cols = ["map_raw", "pp_raw", "map", "pp", "dynamic_map", "dynamic_pp"]
    return r5(d.select("session_id", "method", "beat_index", *cols), *cols)


@query("r6_empty_policy", score_sql("M1", "", f"WITH {BF}") + """ SELECT session_id, beat_index, s2.s AS series, 0 AS output_valid, 'missing' AS reject_reason, 0.0 AS map FROM sc, (SELECT unnest(['INITIAL_BASELINE', 'RICH_BASELINE', 'SHARED_D_BASELINE', 'RICH_DYNAMIC']) AS s) s2""")
def empty(spark, sf):
    return rp.replay(replay_rows(spark, sf, ("M1",)), None).select("session_id", "beat_index", "series", "output_valid", "reject_reason", "map")


@query("r7_r8_wide_replay")
def wide(spark, sf):
    values = ["sbp", "dbp", "map", "pp"]
    return rp.wide(rp.replay(replay_rows(spark, sf), coefficient_fixture(spark), values=values), values)


