"""Offline analyses over whole tables."""

from pyspark.sql import functions as F

from beatframe.operators import evaluate as ev
from .base import BF, IMU, LI, REF, feature_rows, imu_samples, line_frames, query, reference_bp, rounded, table
from .signal_queries import BEATW, RES, SMP, _line_beats

C = F.col


@query("d1_upslope", f"WITH {LI}, {BEATW}, {SMP}, m AS (SELECT session_id, beat_index, min(struct_pack(v := v, i := i)).i AS low FROM sm GROUP BY 1, 2), d AS (SELECT sm.*, low, (v - lag(v) OVER q) / ((t_ms - lag(t_ms) OVER q) / 1000.0::DOUBLE) AS g FROM sm JOIN m USING (session_id, beat_index) WINDOW q AS (PARTITION BY session_id, beat_index ORDER BY i)) SELECT session_id, beat_index, round(max(g) FILTER (WHERE i > low), 6) AS sys_upslope_max FROM d GROUP BY 1, 2")
def upslope(spark, sf):
    return rounded(ev.upslope(_line_beats(spark, sf)).select("session_id", "beat_index", "sys_upslope_max"), "sys_upslope_max")


@query("d2_windows20", f"WITH {BF} SELECT session_id, beat_index * 800 // 20000 AS \"window\", count(*) AS n, round(avg(A), 6) AS A, round(avg(E), 6) AS E FROM bf GROUP BY 1, 2")
def windows(spark, sf):
    d = feature_rows(spark, sf).withColumn("t_ms", C("beat_index") * 800)
    return rounded(ev.windows20(d, ["A", "E"]), "A", "E")


@query("d3_merge_reference", f"""WITH {BF}, {REF}, b AS (SELECT session_id, beat_index, 788918400000 + beat_index * 43200000 AS t FROM bf), r AS (SELECT session_id, t_ms, min(struct_pack(t := t_ms, s := sbp, d := dbp)) AS x FROM ref GROUP BY 1, 2),
p AS (SELECT b.*, r.x AS a FROM b ASOF LEFT JOIN r ON b.session_id = r.session_id AND b.t >= r.t_ms), q AS (SELECT p.*, r.x AS z FROM p ASOF LEFT JOIN r ON p.session_id = r.session_id AND p.t <= r.t_ms),
w AS (SELECT *, CASE WHEN a IS NOT NULL AND (z IS NULL OR t - a.t <= z.t - t) THEN a ELSE z END AS h FROM q)
SELECT session_id, beat_index, CASE WHEN abs(t - h.t) < 86400000 THEN h.s END AS ref_sbp, CASE WHEN abs(t - h.t) < 86400000 THEN h.d END AS ref_dbp FROM w""")
def merge(spark, sf):
    from beatframe.operators.joins import asof_nearest
    b = feature_rows(spark, sf).select("session_id", "beat_index", (788918400000 + C("beat_index") * 43200000).alias("t_ms"))
    r = reference_bp(spark, sf).withColumnsRenamed({"sbp": "ref_sbp", "dbp": "ref_dbp"})
    return asof_nearest(b, r, "t_ms", ["ref_sbp", "ref_dbp"], tol=86_400_000, chunk=90 * 86_400_000).select("session_id", "beat_index", "ref_sbp", "ref_dbp")


RIDGE = ["A", "HR", "E"]
TARGET = "40 + 2 * A - 0.1 * HR + E / 7 + 3 * abs(P2V)"


def _targets(spark, sf):
    return feature_rows(spark, sf).withColumn("ref", F.expr(TARGET))


@query("d4_ridge_loso")
def ridge(spark, sf):
    folds = ev.ridge_loso(_targets(spark, sf), RIDGE, "ref")
    return folds.select("subject", F.posexplode("coefs").alias("i", "coef")).select("subject", "i", F.round("coef", 5).alias("coef"))


PRED = "30 + 2.5 * A - 0.05 * HR"


@query("d5_bp_errors", f"""WITH {BF}, x AS (SELECT subject, {PRED} AS p, {TARGET} AS r FROM bf), m AS (SELECT *, avg(p) OVER (PARTITION BY subject) AS mp, avg(r) OVER (PARTITION BY subject) AS mr FROM x)
SELECT subject, count(*) AS n, round(abs(any_value(mp) - any_value(mr)), 6) AS level_error, round(avg(abs(p - mp - r + mr)), 6) AS centred_mae, round(sqrt(avg(power(p - mp - r + mr, 2))), 6) AS centred_rmse FROM m GROUP BY 1""")
def errors(spark, sf):
    return rounded(ev.bp_errors(_targets(spark, sf).withColumn("pred", F.expr(PRED))), "level_error", "centred_mae", "centred_rmse")


@query("d6_tracking", f"""WITH {BF}, x AS (SELECT subject, {PRED} AS p, {TARGET} AS r FROM bf), m AS (SELECT subject, p - avg(p) OVER (PARTITION BY subject) AS dx, r - avg(r) OVER (PARTITION BY subject) AS dy FROM x)
SELECT count(*) AS n, round(corr(dx, dy), 6) AS r, round(2 * covar_pop(dx, dy) / (var_pop(dx) + var_pop(dy) + power(avg(dx) - avg(dy), 2)), 6) AS ccc, round(avg(CASE WHEN sign(dx) = sign(dy) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement FROM m""")
def tracking(spark, sf):
    return rounded(ev.tracking(_targets(spark, sf).withColumn("pred", F.expr(PRED))), "r", "ccc", "sign_agreement")


for _mode, _cond in (("mad_both", "fx OR fr"), ("artifact_only", "fx AND NOT fr")):
    @query(f"d7_reject_{_mode}", f"""WITH {BF}, x AS (SELECT *, round({TARGET}, 6) AS r, power(A, 3) AS f FROM bf), m AS (SELECT session_id, median(f) AS mf, median(r) AS mr FROM x GROUP BY 1), d AS (SELECT x.*, abs(f - mf) AS df, abs(r - mr) AS dr FROM x JOIN m USING (session_id)),
s AS (SELECT session_id, median(df) AS sf, median(dr) AS sr FROM d GROUP BY 1), k AS (SELECT d.*, df > sf * (1.2 * 1.4826::DOUBLE) AS fx, dr > sr * (1.2 * 1.4826::DOUBLE) AS fr FROM d JOIN s USING (session_id)) SELECT session_id, beat_index FROM k WHERE NOT ({_cond})""")
    def reject(spark, sf, mode=_mode):
        d = feature_rows(spark, sf).withColumn("r", F.round(F.expr(TARGET), 6)).withColumn("f", F.pow("A", F.lit(3.0)))
        return ev.reject_outliers(d, "f", "r", mode, 1.2).select("session_id", "beat_index")


@query("d8_decimate", f"WITH {LI}, f AS (SELECT unnest([1, 2, 3, 4]) AS factor) SELECT session_id, factor, count(*) AS n, max(frame_idx // factor) AS last_idx, round(sum(green_raw), 6) AS total FROM li, f WHERE frame_idx % factor = 0 GROUP BY 1, 2")
def decimate(spark, sf):
    d = ev.decimate(line_frames(spark, sf))
    return rounded(d.groupBy("session_id", "factor").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last_idx"), F.sum("green_raw").alias("total")), "total")


@query("d9_envelope", f"""WITH {BF}, a AS (SELECT session_id, beat_index // 20 AS beat_index, max(A * A * A) - min(A * A * A) AS amp FROM bf GROUP BY 1, 2), t AS (SELECT session_id, max(amp) AS peak_amp, min(struct_pack(a := -amp, b := beat_index)).b AS map_beat FROM a GROUP BY 1),
g AS (SELECT a.session_id, min(a.beat_index) AS vanish_beat FROM a JOIN t USING (session_id) WHERE a.beat_index > map_beat AND amp < peak_amp * 0.6 GROUP BY 1) SELECT session_id, round(peak_amp, 6) AS peak_amp, map_beat, vanish_beat FROM t LEFT JOIN g USING (session_id)""")
def envelope(spark, sf):
    d = feature_rows(spark, sf).select("session_id", F.floor(C("beat_index") / 20).alias("beat_index"), (C("A") * C("A") * C("A")).alias("v"))
    return rounded(ev.envelope(d, 0.6), "peak_amp")


@query("d10_wave_break", f"""WITH {LI}, {BEATW}, {SMP}, {RES}, tm AS (SELECT session_id, j, avg(v) AS m FROM rp WHERE beat_index < 8 GROUP BY 1, 2)
SELECT rp.session_id, rp.beat_index, round(corr(rp.v, tm.m), 6) AS wave_corr FROM rp JOIN tm ON tm.session_id = rp.session_id AND tm.j = rp.j GROUP BY 1, 2""")
def wave_break(spark, sf):
    d = ev.wave_break(_line_beats(spark, sf), C("beat_index") < 8)
    return rounded(d.select("session_id", "beat_index", "wave_corr"), "wave_corr")


@query("d11_imu_rolling_sd", f"WITH {IMU} SELECT session_id, frame_idx, round(stddev_pop(CAST(accel_x AS DOUBLE)) OVER r, 5) AS accel_x_sd FROM imu WINDOW r AS (PARTITION BY session_id ORDER BY t_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW)")
def rolling_sd(spark, sf):
    d = ev.imu_rolling_sd(imu_samples(spark, sf), ["accel_x"])
    return d.select("session_id", "frame_idx", F.round("accel_x_sd", 5).alias("accel_x_sd"))


@query("d12_imu_on_frames", f"WITH {IMU}, fr AS (SELECT session_id, frame_idx, t_ns FROM imu WHERE frame_idx % 13 = 5), x AS (SELECT fr.frame_idx, imu.session_id, accel_x FROM imu ASOF JOIN fr ON imu.session_id = fr.session_id AND imu.t_ns <= fr.t_ns) SELECT session_id, frame_idx, count(*) AS n, round(avg(CAST(accel_x AS DOUBLE)), 6) AS accel_x FROM x GROUP BY 1, 2")
def on_frames(spark, sf):
    imu = imu_samples(spark, sf)
    return rounded(ev.imu_on_frames(imu, imu.where("frame_idx % 13 = 5").select("session_id", "t_ns", "frame_idx"), ["accel_x"]), "accel_x")


@query("d13_resonance", f"""WITH {IMU}, o AS (SELECT session_id, t_ns / 1e9::DOUBLE AS t, sqrt(CAST(accel_x AS DOUBLE) * accel_x + CAST(accel_y AS DOUBLE) * accel_y + CAST(accel_z AS DOUBLE) * accel_z) AS m FROM imu WHERE vib_state = 1),
a AS (SELECT session_id, avg(m) AS am, count(*) AS n FROM o GROUP BY 1), p AS (SELECT session_id, n, f, (power(sum((m - am) * cos(2 * pi() * f * t)), 2) + power(sum((m - am) * sin(2 * pi() * f * t)), 2)) / (n * n) AS pw
 FROM o JOIN a USING (session_id), (SELECT 20.0::DOUBLE + 5 * i AS f FROM range(30) r(i)) g GROUP BY 1, 2, 3)
SELECT session_id, n, f AS resonance_hz, round(pw, 6) AS power FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pw DESC, f) = 1""")
def resonance(spark, sf):
    return rounded(ev.resonance(imu_samples(spark, sf), [20.0 + 5 * i for i in range(30)]), "power")


@query("d14_off_window", f"WITH {IMU}, x AS (SELECT session_id, vib_state, CAST(accel_x AS DOUBLE) * accel_x + CAST(accel_y AS DOUBLE) * accel_y + CAST(accel_z AS DOUBLE) * accel_z AS m2 FROM imu), g AS (SELECT session_id, sqrt(avg(m2) FILTER (WHERE vib_state = 1)) AS a, sqrt(avg(m2) FILTER (WHERE vib_state = 0)) AS b FROM x GROUP BY 1) SELECT session_id, round(a, 6) AS on_rms, round(b, 6) AS off_rms, round(a / b, 6) AS snr FROM g")
def off(spark, sf):
    return rounded(ev.off_window(imu_samples(spark, sf)), "on_rms", "off_rms", "snr")


@query("d15_ingest", """WITH l AS (SELECT user_id AS session_id, CASE WHEN value <= 60 THEN 'Other' ELSE CASE event_type WHEN 'click' THEN 'Wave_Data' WHEN 'view' THEN 'Training_Data' ELSE 'IMU_Data' END END AS kind FROM events)
SELECT session_id, max(CASE WHEN kind = 'IMU_Data' THEN 1 ELSE 0 END) AS has_imu FROM l WHERE session_id % 4 <> 0 GROUP BY 1 HAVING bool_or(kind = 'Wave_Data') AND bool_or(kind = 'Training_Data')""")
def ingest(spark, sf):
    e = table(spark, sf, "events")
    listing = e.select(C("user_id").alias("session_id"), F.expr("CASE WHEN value <= 60 THEN 'Other' ELSE CASE event_type WHEN 'click' THEN 'Wave_Data' WHEN 'view' THEN 'Training_Data' ELSE 'IMU_Data' END END").alias("kind"))
    return ev.ingest(listing, e.where("user_id % 4 = 0").select(C("user_id").alias("session_id")).distinct())


@query("d16_paired_arms", f"""WITH {BF}, x AS (SELECT A AS p, A + E / 50 AS a, A * 1.02 AS f FROM bf), d AS (SELECT 'active-passive' AS pair, a - p AS d FROM x UNION ALL SELECT 'fused-passive', f - p FROM x UNION ALL SELECT 'fused-active', f - a FROM x)
SELECT pair, count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_stat FROM d GROUP BY 1""")
def arms(spark, sf):
    d = feature_rows(spark, sf, indexed=False).select(C("A").alias("passive"), (C("A") + C("E") / 50).alias("active"), (C("A") * 1.02).alias("fused"))
    return rounded(ev.paired_arms(d), "mean_diff", "sd").withColumn("t_stat", F.round("t_stat", 4))


@query("d17_union_sessions", "SELECT l_orderkey AS k, l_quantity AS q, CAST(NULL AS DOUBLE) AS price FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union(spark, sf):
    return ev.union_sessions([table(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), C("l_quantity").alias("q")),
                              table(spark, sf, "orders").select(C("o_orderkey").alias("k"), C("o_totalprice").alias("price"))])


@query("d18_imu_rate", f"WITH {IMU} SELECT session_id, count(*) AS n, round((max(t_ns) - min(t_ns)) / 1e9::DOUBLE, 6) AS span_s, round((count(*) - 1) / ((max(t_ns) - min(t_ns)) / 1e9::DOUBLE), 6) AS rate_hz FROM imu GROUP BY 1")
def rate(spark, sf):
    return rounded(ev.imu_rate(imu_samples(spark, sf)), "span_s", "rate_hz")
