"""Linear pressure models with full term attribution.  Column in, struct out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import quality as q
from .lets import settle
from .scalars import clamp, clamp_note, col, dbp_of, join_reasons, sbp_of, was_clamped

# Published coefficients (intercept first), feature supports and limits.
M1_MAP = (98.17933671736458, 0.00517585270648243, -0.0011788672226907752, 0.04921591953183601, -0.12096408757505715)
M1_PP = (36.93711538452443, 1.7028474361413386, -0.37065794721668943, 8.653490892925587, -33.7685987171883)
M2_RESIDUAL_MAP = (-0.0019547906819300243, 0.006434048607158859)
M2_RESIDUAL_PP = (0.43101704424653153, 1.8230015472167056)
M3_MAP = (98.11484641408586, 0.019010642113272858, -0.0011211410980227579, 0.014776920392505458,
          -0.025498238054972498, -0.05445725490886895)
M3_PP = (21.41909245667339, 5.991918366443132, -0.2912741893542163, 3.3541096069693386, -9.002646049541775,
         -11.165543654161441)
VARIANT_SBP = {"e_only": (-2.970573070691868, 5.014036508465492),
               "e2": (12.337313912062301, -5.598260424987691, 1.698612080360009),
               "local_a": (2.690652753209871, 2.537295192342401, -1.807192089982415)}
VARIANT_DBP = {"e_only": (6.5424392803210765, 2.9509714180132147),
               "e2": (15.665638744041587, -3.3737487606239798, 1.012339380220683),
               "local_a": (13.061043372954417, 2.632014752144330, -4.290118500197587)}
M1_SUPPORT = {"A": (0.838976, 9.636604), "HR": (59.436808, 108.624444), "V2P_relTTP": (-0.928772, -0.355472),
              "P2V_relTTP": (-0.859316, -0.272260)}
M2_SUPPORT = {"A": (1.396092, 5.098340), "HR": (49.652532, 105.523184), "V2P_relTTP": (-0.928772, -0.270672),
              "P2V_relTTP": (-0.859316, -0.272260)}
M3_SUPPORT = {"A": (1.407856, 5.120968), "HR": (49.652532, 104.529600), "Mean": (2.545452, 7.678100),
              "sinPhi": (-0.409478, 0.999557), "cosPhi": (-0.975257, 0.899444)}
E_MAX, STIFFNESS_MAX = 4.810248, 10.860692
SBP_LIMITS, DBP_LIMITS, MIN_PP = (60.0, 200.0), (40.0, 150.0), 20.0
ALPHA_MAP, ALPHA_PP = 0.30, 0.50
CALIBRATION = {m: (0.0, 1.0, 0.0, 1.0) for m in ("M1", "M2", "M3")}  # MAP a, b, PP a, b
PRESSURE_SBP, PRESSURE_DBP = (55.0, 0.5, 0.03), (40.0, 0.3, 0.02)

M2_MAP = (M1_MAP[0] + M2_RESIDUAL_MAP[0], *M1_MAP[1:], M2_RESIDUAL_MAP[1])
M2_PP = (M1_PP[0] + M2_RESIDUAL_PP[0], *M1_PP[1:], M2_RESIDUAL_PP[1])
LABELS = {
    "M1": ("intercept", "A", "HR", "V2P_relTTP", "P2V_relTTP"),
    "M2": ("intercept", "A", "HR", "V2P_relTTP", "P2V_relTTP", "E"),
    "M3": ("intercept", "A", "HR", "Mean", "sinPhi", "cosPhi"),
    "e_only": ("intercept", "A", "HR", "V2P_relTTP", "P2V_relTTP", "E"),
    "e2": ("intercept", "A", "HR", "V2P_relTTP", "P2V_relTTP", "E", "E2"),
    "local_a": ("intercept", "A_local", "HR", "V2P_relTTP", "P2V_relTTP", "Stiffness", "E"),
}


@dataclass(frozen=True)
class Model:
    """A registered linear MAP/PP model."""
    features: tuple[str, ...]
    supports: dict[str, tuple[float | None, float]]
    map_coefs: tuple[float, ...]
    pp_coefs: tuple[float, ...]
    min_pp: float | None = MIN_PP
    reject_on_clamps: bool = True
    uses_timing: bool = False
    check_bp: bool = True


MODELS: dict[str, Model] = {}


def register_model(name: str, features: Sequence[str], supports: dict, map_coefs: Sequence[float],
                   pp_coefs: Sequence[float], **options) -> Model:
    """Add a model; a support of (None, hi) limits from above only."""
    MODELS[name] = Model(tuple(features), dict(supports), tuple(map_coefs), tuple(pp_coefs), **options)
    return MODELS[name]


register_model("M1", LABELS["M1"][1:], M1_SUPPORT, M1_MAP, M1_PP, min_pp=None, reject_on_clamps=False,
               uses_timing=True, check_bp=False)
register_model("M2", LABELS["M2"][1:], {**M2_SUPPORT, "E": (None, E_MAX)}, M2_MAP, M2_PP, uses_timing=True)
register_model("M3", LABELS["M3"][1:], M3_SUPPORT, M3_MAP, M3_PP)


def literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linear_terms(coefs, features) -> Column:
    """intercept, c1*f1, c2*f2, ... ; the shorter of the two lists decides the usable length, rest 0."""
    coefs, features = col(coefs), col(features)
    return F.transform(coefs, lambda c, i: F.when(i == 0, c).otherwise(F.coalesce(c * F.get(features, i - 1),
                                                                                  F.lit(0.0))))


def total(terms) -> Column:
    return F.aggregate(col(terms), F.lit(0.0), lambda a, x: a + x)


def linear_predict(coefs, features) -> Column:
    return total(linear_terms(coefs, features))


def to_sbp_coefs(mean_c, pulse_c) -> Column:
    return F.zip_with(col(mean_c), col(pulse_c), lambda m, p: m + F.lit(2.0 / 3.0) * p)


def to_dbp_coefs(mean_c, pulse_c) -> Column:
    return F.zip_with(col(mean_c), col(pulse_c), lambda m, p: m - F.lit(1.0 / 3.0) * p)


def sbp_coefs(m: Sequence[float], p: Sequence[float]) -> tuple[float, ...]:
    return tuple(a + (2.0 / 3.0) * b for a, b in zip(m, p))


def dbp_coefs(m: Sequence[float], p: Sequence[float]) -> tuple[float, ...]:
    return tuple(a - (1.0 / 3.0) * b for a, b in zip(m, p))


def constrain(sbp, dbp, min_pp: float | None = MIN_PP) -> Column:
    """struct<sbp, dbp, constraint_applied, clamp_applied> after minimum pulse pressure and range limits."""
    sbp, dbp = col(sbp), col(dbp)
    narrow = sbp < dbp + MIN_PP
    lifted = sbp if min_pp is None else F.when(sbp < dbp + min_pp, dbp + min_pp).otherwise(sbp)
    s, d = clamp(lifted, *SBP_LIMITS), clamp(dbp, *DBP_LIMITS)
    moved = (F.abs(s - sbp) > 1e-9) | (F.abs(d - dbp) > 1e-9)
    return F.struct(s.alias("sbp"), d.alias("dbp"), narrow.cast("int").alias("constraint_applied"),
                    moved.cast("int").alias("clamp_applied"))


def calibrate(map_v, pp_v, method: str = "M1", coef: Sequence[float] | None = None) -> Column:
    a, b, c, d = coef or CALIBRATION[method]
    m, p = F.lit(a) + F.lit(b) * col(map_v), F.lit(c) + F.lit(d) * col(pp_v)
    return F.struct(m.alias("map"), p.alias("pp"), sbp_of(m, p).alias("sbp"), dbp_of(m, p).alias("dbp"))


def press_bp(hr, amp, sbp=PRESSURE_SBP, dbp=PRESSURE_DBP) -> Column:
    hr, amp = col(hr), col(amp)
    f = lambda c: F.lit(c[0]) + F.lit(c[1]) * hr + F.lit(c[2]) * amp
    return F.struct(f(sbp).alias("sbp"), f(dbp).alias("dbp"))


def _limited(value, bounds) -> Column:
    """The value within its support, as ``clamp_feature`` and ``clamp_feature_upper`` limit it."""
    lo, hi = bounds
    return F.least(col(value), F.lit(hi)) if lo is None else clamp(value, lo, hi)


def _clamp_stage(df: DataFrame, values: dict[str, Column], supports: dict, at: int = 0) -> DataFrame:
    """Columns ``_u<i>`` (used value) and ``_n<i>`` (moved) per feature from ``at`` on, and the values as ``_v<i>``."""
    of = list(enumerate(values.items(), at))
    d = df.select("*", *[col(v).alias(f"_v{i}") for i, (_, v) in of])
    d = d.select("*", *[_limited(f"_v{i}", supports[f]).alias(f"_u{i}") for i, (f, _) in of])
    d = d.select("*", *[F.coalesce(was_clamped(f"_v{i}", f"_u{i}"), F.lit(False)).alias(f"_n{i}") for i, _ in of])
    return settle(d, *[f"_u{i}" for i, _ in of], *[f"_n{i}" for i, _ in of])


def _notes(labels: Sequence[str]) -> Column:
    """The joined clamp notes; texts are made only where this is read."""
    return join_reasons(*[F.when(F.col(f"_n{i}"), clamp_note(f, f"_v{i}", f"_u{i}")) for i, f in enumerate(labels)])


def _too_many(n: int, most: int = 1) -> Column:
    """``support_reason`` of the joined notes, from the number of moved features."""
    moved = reduce(lambda x, y: x + y, [F.col(f"_n{i}").cast("int") for i in range(n)])
    return F.when(moved > most, "feature_support_violation").otherwise(q.OK)


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms)


def predict(df: DataFrame, model: str | Model, features: dict[str, Column], out: str | None = None) -> DataFrame:
    """Add one struct with used features, terms, raw and final pressures, flags and the reject reason.

    Value fields are null where the model stops before computing them.  Each stage is a projection of plain
    expressions in generated code, and nothing is computed twice; ``settle`` keeps the methods short enough to be compiled.
    """
    m = MODELS[model] if isinstance(model, str) else model
    out = out or (model if isinstance(model, str) else "prediction")
    n, c = len(m.map_coefs), F.col
    timing = q.relttp_reason(features["V2P_relTTP"], features["P2V_relTTP"]) if m.uses_timing else F.lit(q.OK)
    d = _clamp_stage(df.withColumn("_timing", timing), {f: features[f] for f in m.features}, m.supports)
    support = _too_many(n - 1) if m.reject_on_clamps else F.lit(q.OK)
    d = d.withColumn("_stop", F.when(c("_timing") != q.OK, c("_timing")).otherwise(support)).withColumn("_notes", _notes(m.features))
    for axis, coefs in (("map", m.map_coefs), ("pp", m.pp_coefs)):
        d = d.select("*", F.lit(float(coefs[0])).alias(f"_{axis}0"),
                     *[(F.lit(float(k)) * c(f"_u{i}")).alias(f"_{axis}{i + 1}") for i, k in enumerate(coefs[1:])])
        d = d.withColumn(f"_{axis}", reduce(lambda x, y: x + y, [c(f"_{axis}{i}") for i in range(n)]))
    d = d.withColumn("_d0", dbp_of("_map", "_pp")).withColumn("_s0", c("_d0") + c("_pp"))
    d = d.withColumn("_fin", constrain("_s0", "_d0", m.min_pp))
    checked = q.bp_reason("_fin.sbp", "_fin.dbp") if m.check_bp else F.lit(q.OK)
    d = settle(d.withColumn("_reason", F.when(c("_stop") != q.OK, c("_stop")).otherwise(checked)), "_stop", "_reason", "_fin")
    known, ran, notes = c("_timing") == q.OK, c("_stop") == q.OK, c("_notes") != ""
    value = lambda x, name: F.when(ran, x).alias(name)
    flag = lambda x, name: F.when(ran, x).otherwise(0).alias(name)
    result = F.struct(
        F.when(known, F.array(*[c(f"_u{i}") for i in range(n - 1)])).alias("used"),
        F.when(known & notes, c("_notes")).otherwise(q.OK).alias("feature_clamp_reason"),
        F.when(known, notes.cast("int")).otherwise(0).alias("feature_clamp_applied"),
        value(F.array(*[c(f"_map{i}") for i in range(n)]), "map_terms"),
        value(F.array(*[c(f"_pp{i}") for i in range(n)]), "pp_terms"), value(c("_map"), "map_raw"),
        value(c("_pp"), "pp_raw"), value(c("_s0"), "sbp_raw"), value(c("_d0"), "dbp_raw"),
        value(c("_fin.sbp"), "sbp"), value(c("_fin.dbp"), "dbp"),
        flag(c("_fin.constraint_applied"), "constraint_applied"), flag(c("_fin.clamp_applied"), "clamp_applied"),
        (c("_reason") == q.OK).cast("int").alias("output_valid"), c("_reason").alias("reject_reason"))
    return d.select(*[x for x in df.columns if x != out], result.alias(out))


def residual_parts(features: dict[str, Column]) -> Column:
    """Base pressures of the timing model and what the distortion residual adds to them."""
    base = linear_pressures(M1_MAP, M1_PP, F.array(*[features[n] for n in LABELS["M1"][1:]]))
    both = linear_pressures(M2_MAP, M2_PP, F.array(*[features[n] for n in LABELS["M2"][1:]]))
    return F.struct(base["sbp"].alias("sbp_base"), base["dbp"].alias("dbp_base"),
                    (both["sbp"] - base["sbp"]).alias("sbp_correction"),
                    (both["dbp"] - base["dbp"]).alias("dbp_correction"))


def linear_pressures(map_coefs, pp_coefs, features: Column) -> Column:
    m, p = linear_predict(literals(map_coefs), features), linear_predict(literals(pp_coefs), features)
    return F.struct(sbp_of(m, p).alias("sbp"), dbp_of(m, p).alias("dbp"), m.alias("map"), p.alias("pp"))


def with_variant(df: DataFrame, kind: str, amp, hr, v2p, p2v, e, out: str | None = None) -> DataFrame:
    """Add the struct of a comparison branch of the distortion model: 'e_only', 'e2', 'local_a'.

    Values are 0 where a branch stops early, as in the exported tables.  Stages are plain projections as in ``predict``.
    """
    c, out = F.col, out or kind
    timing = q.relttp_reason(v2p, p2v)
    parts = {"A": amp, "HR": hr, "V2P_relTTP": v2p, "P2V_relTTP": p2v, "E": e}
    d = _clamp_stage(df.withColumn("_timing", timing), parts, {**M2_SUPPORT, "E": (None, E_MAX)})
    if kind == "local_a":
        root = F.sqrt(F.greatest(c("_u0"), F.lit(0.0)))
        d = _clamp_stage(d, {"Stiffness": c("_u4") * root}, {"Stiffness": (None, STIFFNESS_MAX)}, len(parts))
        parts["Stiffness"] = None
    base_s, base_d = sbp_coefs(M1_MAP, M1_PP), dbp_coefs(M1_MAP, M1_PP)
    corr_s, corr_d = VARIANT_SBP[kind], VARIANT_DBP[kind]
    joint = lambda b, k: (b[0] + k[0], *b[1:], *k[1:])
    u, ee, stiff = [c(f"_u{i}") for i in range(4)], c("_u4"), c("_u5") if kind == "local_a" else F.lit(0.0)
    extra = [stiff, ee] if kind == "local_a" else [ee, ee * ee][: len(corr_s) - 1]
    terms = lambda k, x: [F.lit(float(k[0])), *[F.lit(float(a)) * v for a, v in zip(k[1:], x)]]
    d = d.withColumn("_stop", F.when(c("_timing") != q.OK, c("_timing")).otherwise(_too_many(len(parts)))).withColumn("_notes", _notes(list(parts)))
    d = d.select("*", _sum(terms(base_s, u)).alias("_sb"), _sum(terms(corr_s, extra)).alias("_sc"),
                 _sum(terms(base_d, u)).alias("_db"), _sum(terms(corr_d, extra)).alias("_dc"))
    d = d.select("*", (c("_sb") + c("_sc")).alias("_s0"), (c("_db") + c("_dc")).alias("_d1"))
    d = d.select("*", (c("_s0") < c("_d1") + MIN_PP).alias("_narrow"))
    d = d.select("*", F.when(c("_narrow"), c("_d1") + MIN_PP).otherwise(c("_s0")).alias("_s1"))
    d = d.select("*", clamp("_s1", *SBP_LIMITS).alias("_s2"), clamp("_d1", *DBP_LIMITS).alias("_d2"))
    d = settle(d.withColumn("_reason", F.when(c("_stop") == q.OK, q.bp_reason("_s2", "_d2")).otherwise(c("_stop"))), "_stop", "_reason", "_s2", "_d2")
    ran, ok, known, notes = c("_stop") == q.OK, c("_reason") == q.OK, c("_timing") == q.OK, c("_notes") != ""
    moved = ((F.abs(c("_s2") - c("_s1")) > 1e-9) | (F.abs(c("_d2") - c("_d1")) > 1e-9)).cast("int")
    blank = literals([0.0] * (5 + len(corr_s) - 1))
    z = lambda cond, x, name: F.when(cond, x).otherwise(F.lit(0.0)).alias(name)
    zi = lambda cond, x, name: F.when(cond, x).otherwise(0).alias(name)
    za = lambda x, name: F.when(ran, x).otherwise(blank).alias(name)
    result = F.struct(
        z(ok, c("_s2"), "sbp"), z(ok, c("_d2"), "dbp"), z(ran, c("_s2"), "sbp_raw"), z(ran, c("_d2"), "dbp_raw"),
        z(ran, c("_sb"), "sbp_base"), z(ran, c("_db"), "dbp_base"), z(ran, c("_sc"), "sbp_correction"),
        z(ran, c("_dc"), "dbp_correction"), z(ran, c("_s1"), "sbp_constrained"), z(ran, c("_d1"), "dbp_constrained"),
        z(ran, u[0], "a_used"), z(ran, ee, "e_used"), z(ran, stiff, "stiffness_used"),
        zi(ran, c("_narrow").cast("int"), "constraint_applied"), zi(ran, moved, "clamp_applied"),
        zi(known, notes.cast("int"), "feature_clamp_applied"), ok.cast("int").alias("output_valid"),
        F.when(known & notes, c("_notes")).otherwise(q.OK).alias("feature_clamp_reason"),
        c("_reason").alias("reject_reason"), za(literals(joint(base_s, corr_s)), "sbp_coefs"),
        za(literals(joint(base_d, corr_d)), "dbp_coefs"), za(F.array(*terms(joint(base_s, corr_s), [*u, *extra])), "sbp_terms"),
        za(F.array(*terms(joint(base_d, corr_d), [*u, *extra])), "dbp_terms"))
    return d.select(*[x for x in df.columns if x != out], result.alias(out))
