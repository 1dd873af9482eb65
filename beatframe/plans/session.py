"""From frames to scored beats and the wide training table.

Stages that several branches read (frame states, morphology, sine beats, scored rows) are stored once, so no branch
repeats the detection and a lost executor only repeats the stage it worked on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import models as m, quality as q
from ..functions.scalars import hr_from, wall_iso
from ..operators import beats as bt, detect as det, replay as rp
from ..operators.aggregates import CONTEXT, beat_clock, beat_context, on_run_rms
from ..operators.chunks import IDX, KEY, cut
from ..operators.conditioning import signal
from ..operators.joins import align, asof_each, assign_beat
from ..sources.tables import post_columns


#: Columns of conditioned frames that later stages read.
STATE = (KEY, IDX, "gidx", "t_ms", "iso", "phase", "ring", "green", "is_low", "is_high")


@dataclass(frozen=True)
class Session:
    """Stored stages of one run over a frame table."""
    states: DataFrame      # frames with conditioned value, interval and smoothed interval
    peaks: DataFrame       # accepted peaks of the frame path
    morph: DataFrame       # valley/peak morphology events
    sine: DataFrame        # completed beats of the sine path, per estimator


def analyse(frames: DataFrame, logic: str = "1") -> Session:
    gated = "iso" in frames.columns
    sig = det.gated_index(signal(frames, logic, keep_chunk=gated), "_chunk" if gated else None)
    sig = cut(sig.select(*[c for c in (*STATE, "is_cand", "t_peak") if c in sig.columns]))
    peaks = cut(det.accept_peaks(sig.where("is_cand and gidx is not null")))
    states = cut(det.frame_state(sig.drop("is_cand", "t_peak"), peaks))
    sine = bt.sine_beats(states, cut(bt.sine_peaks(states))).drop("samples", "peak_phase_ms", "phase_offset_ms")
    return Session(states, peaks, cut(det.morphology(states)), cut(sine))


def score_m1(s: Session) -> DataFrame:
    """Timing model at each beat, with the state from before the beat."""
    return timing_scored(det.with_morphology(s.peaks.where("valid"), s.morph)).select(
        KEY, IDX, "t_peak", "interval_ms", "ibi_ms", "bpm", "bpm_sd", "smoothed_before", "smoothed_ibi_ms", *det.MORPHOLOGY,
        "hr", "M1")


def timing_scored(rows: DataFrame) -> DataFrame:
    """``hr`` and ``M1`` of rows with smoothed_before, interval_ms and morphology."""
    hr = hr_from("smoothed_before", "interval_ms")
    feats = {"A": F.col("v2p_amp"), "HR": hr, "V2P_relTTP": F.col("v2p_rel"), "P2V_relTTP": F.col("p2v_rel")}
    return m.predict(rows.withColumn("hr", hr), "M1", feats)


def _with_reason(reason: Column, scored: Column) -> Column:
    """Score struct with the reason a beat stopped before scoring put in front."""
    stopped = reason != q.OK
    return scored.withField("output_valid", F.when(stopped, 0).otherwise(scored["output_valid"])).withField(
        "reject_reason", F.when(stopped, reason).otherwise(scored["reject_reason"])).withField(
        "used", F.when(~stopped, scored["used"])).withField("sbp", F.when(~stopped, scored["sbp"])).withField(
        "dbp", F.when(~stopped, scored["dbp"]))


def score_sine(s: Session, method: str) -> DataFrame:
    """Distortion (M2) or harmonic (M3) model at each completed sine beat."""
    path = "D" if method == "M2" else "M"
    return sine_scored(det.with_morphology(s.sine.where(F.col("path") == path), s.morph), method)


def sine_scored(rows: DataFrame, method: str) -> DataFrame:
    """``hr`` and the method's struct of judged sine beats with morphology."""
    d = rows.withColumn("hr", hr_from("smoothed", "beat_ibi_ms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if method == "M2":
        feats = {"A": F.col("v2p_amp"), "HR": zero("hr"), "V2P_relTTP": F.col("v2p_rel"), "P2V_relTTP": F.col("p2v_rel"),
                 "E": zero("e")}
    else:
        feats = {"A": zero("fit_m.amp"), "HR": zero("hr"), "Mean": zero("fit_m.mean"), "sinPhi": zero("fit_m.sin_phi"),
                 "cosPhi": zero("fit_m.cos_phi")}
    d = m.predict(d, method, feats, "_s")
    return d.withColumn(method, _with_reason(F.col("beat_reason"), F.col("_s"))).drop("_s")


def beat_rows(s: Session) -> DataFrame:
    """One row per change of the frame-level interval, and one for the first gated frame of each session."""
    gated = s.states.where("gidx is not null")
    keep = [c for c in (KEY, IDX, "gidx", "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm", "bpm_sd", "iso", "phase") if c in gated.columns]
    marks = det.dense_from(gated.where("is_beat or gidx = 0").select(*keep), "gidx")  # the interval changes on these frames only
    return det.beat_index(cut(det.new_beats(marks, order="_ord").drop("_ord")))  # read twice


def scored_beats(s: Session, slim: bool = False) -> DataFrame:
    """Beat rows with the latest result of each method as of their frame.

    What the methods read comes to the beat rows, all three in one sort, and is scored there, so no scores or terms are shuffled.
    With ``slim`` the rows of the sine methods hold of the wave only what the variants read.
    """
    beats = beat_rows(s)
    peak = s.peaks.where("valid").select(KEY, IDX, F.struct("smoothed_before", "interval_ms").alias("m1_in"))
    stats = F.struct(F.col("stats.range").alias("range")).alias("stats") if slim else F.col("stats")

    def read(method: str) -> Column:
        path, fit = ("D", "fit_d") if method == "M2" else ("M", "fit_m")
        cols = ["smoothed", "beat_ibi_ms", "beat_reason", *(["e"] if method == "M2" else []), *([] if slim and method == "M2" else [fit])]
        kept = [stats] if slim and method == "M2" else [] if slim else [stats, F.col("ratio")]
        return F.when(F.col("path") == path, F.struct(*[F.col(c) for c in cols], *kept)).alias(f"{method.lower()}_in")
    events = peak.unionByName(s.sine.select(KEY, IDX, read("M2"), read("M3")), allowMissingColumns=True)
    events = cut(det.with_morphology(events, s.morph))  # read twice
    morph = F.struct(*det.MORPHOLOGY)
    feeds = {"M1": "m1_in", "M2": "m2_in", "M3": "m3_in"}
    given = events.select(KEY, IDX, *feeds.values(), *[F.when(F.col(f"m{i}_in").isNotNull(), morph).alias(f"m{i}_morph") for i in (1, 2)])
    d = asof_each(beats, given, [*feeds.values(), "m1_morph", "m2_morph"])
    for method, feed in feeds.items():
        fields = [F.col(feed)[c].alias(c) for c in given.schema[feed].dataType.names]
        if method != "M3":
            fields += [F.col(f"{method.lower()}_morph")[c].alias(c) for c in det.MORPHOLOGY]
        x = d.select(*d.columns, *fields)
        x = timing_scored(x) if method == "M1" else sine_scored(x, method)
        row = F.struct("M1", "hr", "v2p_amp", "v2p_rel", "p2v_rel", "ai") if method == "M1" else slim_row(method) if slim else sine_row(method)
        d = x.select(*d.columns, F.when(F.col(feed).isNotNull(), row).alias(f"{method.lower()}_row"))
    return with_variants(d.drop(*feeds.values(), "m1_morph", "m2_morph"))


def slim_row(method: str) -> Column:
    return F.struct(method, "hr", "stats", "v2p_amp", "v2p_rel", "p2v_rel", "e") if method == "M2" else F.struct(method, "hr")


def sine_row(method: str) -> Column:
    """Result of a sine method as it is carried on to the beat rows after it."""
    extra = ["v2p_amp", "v2p_rel", "p2v_rel", "e"] if method == "M2" else []
    fit = F.col("fit_d" if method == "M2" else "fit_m").alias("fit")
    return F.struct(F.col(method), F.col("hr"), F.col("beat_ibi_ms"), F.col("stats"), F.col("ratio"), fit, *[F.col(c) for c in extra])


def with_variants(rows: DataFrame) -> DataFrame:
    """The three methods of beat rows with m1_row, m2_row and m3_row, and the comparison branches."""
    d = rows.select("*", F.col("m1_row.M1").alias("M1"), F.col("m2_row.M2").alias("M2"), F.col("m3_row.M3").alias("M3"))
    r = F.col("m2_row")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    local = z(r["stats"]["range"])
    for kind in ("e_only", "e2", "local_a"):
        amp = local if kind == "local_a" else z(r["v2p_amp"])
        d = m.with_variant(d, kind, amp, z(r["hr"]), z(r["v2p_rel"]), z(r["p2v_rel"]), z(r["e"]))
    return d


def _flat(method: str) -> list[Column]:
    """Used features, pressures, flags and all terms of one method as columns."""
    s, names = F.col(method), m.MODELS[method].features
    num = lambda c: F.coalesce(c, F.lit(0.0))
    out = [num(F.get(s["used"], F.lit(i))).alias(f"{method}_{n}_used") for i, n in enumerate(names)]
    for p in ("sbp", "dbp"):
        out += [num(s[p]).alias(f"{method}_{p.upper()}"), num(s[p]).alias(f"{method}_{p.upper()}_process"),
                num(s[p]).alias(f"{method}_{p.upper()}_raw")]
    for f in ("constraint_applied", "clamp_applied", "feature_clamp_applied", "output_valid"):
        out.append(F.coalesce(s[f], F.lit(0)).alias(f"{method}_{f}"))
    for f in ("feature_clamp_reason", "reject_reason"):
        out.append(F.coalesce(s[f], F.lit("missing")).alias(f"{method}_{f}"))
    mod = m.MODELS[method]
    coefs = {"MAP": mod.map_coefs, "PP": mod.pp_coefs, "SBP": m.sbp_coefs(mod.map_coefs, mod.pp_coefs),
             "DBP": m.dbp_coefs(mod.map_coefs, mod.pp_coefs)}
    for i, label in enumerate(m.LABELS[method]):
        mt, pt = num(F.get(s["map_terms"], F.lit(i))), num(F.get(s["pp_terms"], F.lit(i)))
        terms = {"MAP": mt, "PP": pt, "SBP": mt + F.lit(2.0 / 3.0) * pt, "DBP": mt - F.lit(1.0 / 3.0) * pt}
        out += [F.lit(coefs[a][i]).alias(f"{method}_{a}_coef_{label}") for a in coefs]
        out += [terms[a].alias(f"{method}_{a}_term_{label}") for a in terms]
    return out


def _variant_columns(kind: str) -> list[Column]:
    v = F.col(kind)
    scalars = ["sbp", "dbp", "sbp_raw", "dbp_raw", "sbp_base", "dbp_base", "sbp_correction", "dbp_correction", "a_used",
               "e_used", "stiffness_used", "constraint_applied", "clamp_applied", "feature_clamp_applied", "output_valid",
               "feature_clamp_reason", "reject_reason"]
    out = [v[c].alias(f"{kind}_{c}") for c in scalars]
    for i, label in enumerate(m.LABELS[kind]):
        out += [F.get(v[a], F.lit(i)).alias(f"{kind}_{a}_{label}") for a in ("sbp_coefs", "dbp_coefs", "sbp_terms", "dbp_terms")]
    return out


def training_table(frames: DataFrame, imu: DataFrame | None = None, coef: DataFrame | None = None, models: dict | None = None,
                   blend: dict | None = None, logic: str = "1", session: Session | None = None) -> DataFrame:
    """Widest output: session context, three methods with terms and postprocess, variants, baselines, beat context.

    Frames are read by the analysis and twice by the beat context, so they are stored first.
    """
    frames = cut(frames)
    s = session or analyse(frames, logic)
    scored = cut(scored_beats(s, slim=True).drop("m1_row", "m2_row", "m3_row"))
    table = training_rows(scored, coef, models, blend)
    present = [c for c in CONTEXT if c in frames.columns]
    marks = scored.select(KEY, IDX, "beat_index")
    ctx_cols = [KEY, IDX, *present, *[c for c in ("phase", "vib_state") if c in frames.columns]]
    ctx = beat_context(assign_beat(frames.select(*ctx_cols), marks), present)
    defaults = {c: 0.0 for c in ctx.columns if c.endswith("_median") or c == "vib_duty_in_beat"} | (
        {"phase": 0} if "phase" in ctx.columns else {})
    table = align(table, ctx, defaults)
    if imu is not None and "t_ns" in frames.columns:
        vib = on_run_rms(imu, beat_clock(scored.select(KEY, "beat_index", "t_ms"), frames))
        table = align(table, vib, {"imu_vib_rms_on_median": 0.0})
    return table


def training_rows(scored: DataFrame, coef: DataFrame | None = None, models: dict | None = None, blend: dict | None = None) -> DataFrame:
    """Flat rows of scored beats: three methods with terms and postprocess, variants, and baselines where coefficients are given."""
    head = [c for c in (KEY, "beat_index", IDX, "t_ms", "ibi_ms", "smoothed_ibi_ms", "bpm_sd", "iso") if c in scored.columns]
    flat = scored.select(*head, wall_iso("t_ms").alias("wall_time_iso"), *[c for k in ("M1", "M2", "M3") for c in _flat(k)],
                         *[c for k in ("e_only", "e2", "local_a") for c in _variant_columns(k)])
    table = flat
    for k in ("M1", "M2", "M3"):
        rows = flat.select(KEY, "beat_index", *[F.col(f"{k}_{c}").alias(n) for c, n in (
            ("SBP", "sbp"), ("DBP", "dbp"), ("output_valid", "output_valid"), ("reject_reason", "reject_reason"))])
        post = rp.postprocess(rows, k).select(KEY, "beat_index", *[F.col(c).alias(f"{k}_{c}") for c in (*rp.POST, "postprocess_applied")])
        table = table.join(post, [KEY, "beat_index"]).select("*", *[c.alias(f"{k}_{n}") for c, n in zip(
            post_columns(k), ("POST_map_a", "POST_map_b", "POST_pp_a", "POST_pp_b", "POST_alpha_map", "POST_alpha_pp"))])
    variants = rp.postprocess_variants(scored)
    kinds = ("e_only", "e2", "local_a")
    post = variants.groupBy(KEY, "beat_index").agg(*[
        F.max(F.when(F.col("variant") == k, F.col(c))).alias(f"{k}_{c}") for k in kinds for c in (*rp.POST, "postprocess_applied")])
    table = table.join(post, [KEY, "beat_index"])
    if coef is not None:
        names = [f"{k}_{n}_used" for k in ("M1", "M2", "M3") for n in m.MODELS[k].features]
        rows = rp.feature_row(flat, names)
        table = table.join(rp.wide(rp.replay(rows, coef, models, blend)), [KEY, "beat_index"])
    return table
