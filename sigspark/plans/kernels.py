"""Queries on operators that need a kernel; SQL cannot say them, so they are tested against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import coupling as cp, features as ft, filters as fl, kernels as kn, models as md, statistics as st, surrogates as su
from .registry import cells, pair_emb, query, rounded, sig_emb, sig_events
from .tables import _diffs

P = ["pair_id"]


@query(None)
def flt_bandpass(spark, d):
    return rounded(fl.filtered(sig_emb(spark, d), (4.0, 20.0), 64.0, chunk=32), "x")


@query(None)
def flt_lowpass(spark, d):
    return rounded(fl.filtered(sig_emb(spark, d), 8.0, 64.0, "lowpass"), "x")


@query(None)
def flt_resample_poly(spark, d):
    return rounded(fl.resampled_poly(sig_emb(spark, d), 64, 48), "x")


@query(None)
def flt_envelope(spark, d):
    return rounded(fl.enveloped(sig_emb(spark, d)), "envelope", "phase")


@query(None)
def flt_band_envelopes(spark, d):
    return rounded(fl.band_envelopes(sig_emb(spark, d), [("low", 4.0, 10.0), ("high", 10.0, 24.0)], 64.0, 6.0), "x")


@query(None)
def flt_respiration(spark, d):
    return rounded(fl.clean_respiration(sig_emb(spark, d), 4.0), "x")


@query(None)
def flt_peaks(spark, d):
    return fl.find_peaks(sig_emb(spark, d), 8, 0.5, 4)


@query(None)
def ent_lempel_ziv(spark, d):
    return rounded(kn.per_group(sig_emb(spark, d), ["series_id"], ["x"], kn.lempel_ziv, "lzc double"), "lzc")


@query(None)
def ent_svd(spark, d):
    return rounded(kn.svd_entropy(ft.svd_gram(sig_emb(spark, d)), ["series_id"]), "entropy")


@query(None)
def cpl_phi_id(spark, d):
    a = kn.phi_id(cp.gaussian_atoms_input(pair_emb(spark, d), 1), P)
    return rounded(a, *[c for c in a.columns if c != "pair_id"])


@query(None)
def surr_phase(spark, d):
    v = kn.phase_surrogates(pair_emb(spark, d), 19, P).groupBy("pair_id", "surrogate").agg(F.round(F.abs(F.corr("x", "y")), 9).alias("value"))
    return rounded(su.surrogate_test(v, P), "observed", "null_mean", "null_std", "p2_5", "p95", "p97_5", "p", "z")


@query(None)
def mdl_random_intercept(spark, d):
    """Event value on event order within the user, an intercept per user, one model per event type, FDR over them."""
    m = md.random_intercept(sig_events(spark, d), ["channel"], "series_id", "idx", "x")
    return rounded(st.bh_fdr(m, spread=False), "coefficient", "se", "z", "p", "var_subject", "var_residual", "p_fdr")


@query(None)
def mdl_gee(spark, d):
    e = sig_events(spark, d).withColumn("label", (F.col("idx") % 2).cast("int"))
    return rounded(md.gee_logistic(e, ["channel"], "series_id", "x", "label"), "coefficient", "robust_se", "z", "p", "correlation", "accuracy", "auc")


@query(None)
def stat_friedman_p(spark, d):
    return rounded(st.friedman(cells(spark, d), "subject", "condition", 5), "chi2", "p")


@query(None)
def stat_wilcoxon_p(spark, d):
    return rounded(st.holm(st.signed_rank(_diffs(spark, d), ["other"]), spread=False), "w", "p", "p_holm").select("other", "n", "w", "p", "p_holm")


@query(None)
def stat_paired_t_p(spark, d):
    return rounded(st.bh_fdr(st.t_one_sample(_diffs(spark, d), ["other"]), spread=False), "mean", "t", "p", "p_fdr")


@query(None)
def cpl_corr_p(spark, d):
    r = cp.correlation(pair_emb(spark, d))
    return rounded(st.bh_fdr(r.withColumn("p", special.t_p("t", (F.col("n") - 2).cast("double")))), "r", "t", "p", "p_fdr")
