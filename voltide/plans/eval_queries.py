"""Queries over benchmarks, predictions, calibration, reconstruction, sweeps and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.buckets import MATURITY, MONEYNESS, WINGS, maturity, moneyness, sql_bucket
from ..functions.normal import sql_cdf, sql_priced
from ..functions.rng import sql_normal, sql_uniform
from ..operators import abstain, audit, benchmark as B, calibrate, decide, diagnostics, explore, infer, metrics as M, noarb, predictions as P, reconstruct as R, spectrum, surface as S, sweep as W
from ..operators.stage import staged
from . import adapters as A
from .data_queries import _otm
from .registry import query

MAT, MON = sql_bucket("tau", MATURITY), sql_bucket("log_moneyness", MONEYNESS)
EVAL = ("select split, ", " from banded group by split")


def preds(s: SparkSession, d: str) -> DataFrame:
    return A.predictions(s, d)


def bands(s: SparkSession, d: str) -> DataFrame:
    return A.with_bands(A.predictions(s, d))


# ---- masks, noise, splits


@query("mask_random", f"select row_key, {sql_uniform('mask42')} < 4E-1 as observed from surface")
def _(s, d):
    return B.apply_mask(A.surface(s, d), "random", 0.4).select("row_key", "observed")


@query("mask_drop_maturity", "select row_key, not (tau < 30E0 / 365E0) as keep_short, not (tau > 1E0) as keep_long from surface")
def _(s, d):
    return A.surface(s, d).select("row_key", B.maturity_mask("short").alias("keep_short"), B.maturity_mask("long").alias("keep_long"))


@query("mask_maturity_slice", "select row_key, least(greatest(floor((tau - lo) / (hi - lo) * 10), 0), 9) <> floor(cast('0x' || substr(md5('slice|42'), 1, 8) as bigint) / 4294967296E0 * 10) as observed from surface, (select min(tau) as lo, max(tau) as hi from surface)")
def _(s, d):
    return B.apply_mask(A.surface(s, d), "random_slice").select("row_key", "observed")


@query("mask_drop_moneyness", "select row_key, not (abs(log_moneyness) > 3E-1) as wings, not (abs(log_moneyness) < 5E-2) as atm, not (log_moneyness < -3E-1) as left_wing, not (log_moneyness > 3E-1) as right_wing from surface")
def _(s, d):
    return A.surface(s, d).select("row_key", *(B.moneyness_mask(r).alias(r) for r in ("wings", "atm", "left_wing", "right_wing")))


SCORE = "exp(-5E-1 * pow(log_moneyness / 2E-1, 2E0)) * exp(-5E-1 * pow((tau * 365E0 - 60E0) / 90E0, 2E0))"


@query("mask_realistic", f"select row_key, {sql_uniform('mask42')} < least(greatest(score / mean * 4E-1, 2E-2), 1E0) as observed from (select row_key, {SCORE} as score, avg({SCORE}) over () as mean from surface)")
def _(s, d):
    return B.apply_mask(A.surface(s, d), "realistic", 0.4).select("row_key", "observed")


STRATEGY_SQL = {"drop_wings": "not (abs(log_moneyness) > 3E-1)", "drop_atm": "not (abs(log_moneyness) < 5E-2)", "drop_short_maturity": "not (tau < 30E0 / 365E0)", "drop_long_maturity": "not (tau > 1E0)", "random": f"{sql_uniform('mask42')} < 6E-1"}


@query("apply_mask", " union all ".join(f"select '{k}' as strategy, count(*) filter ({v}) as n_observed from surface" for k, v in STRATEGY_SQL.items()))
def _(s, d):
    out = None
    for k in STRATEGY_SQL:
        one = B.apply_mask(A.surface(s, d), k, 0.6).agg(F.lit(k).alias("strategy"), F.count_if("observed").alias("n_observed"))
        out = one if out is None else out.unionByName(one)
    return out


@query("mask_paired", "select row_key, first_value(observed) over (partition by date, round(log_moneyness, 10) + 0E0, round(tau, 10) + 0E0 order by row_key) as observed from predictions")
def _(s, d):
    return B.paired(preds(s, d)).select("row_key", "observed")


@query("noise_gaussian", f"select row_key, greatest(implied_volatility + 3E-2 * {sql_normal('noise42')}, 1E-4) as noisy from surface", "noisy")
def _(s, d):
    return A.surface(s, d).select("row_key", B.gaussian(F.col("implied_volatility"), 0.03).alias("noisy"))


HETERO = "(1E0 + 2E0 * abs(log_moneyness) / 3E-1) * (1E0 + 5E-1 / greatest(tau * 365E0, 1E0))"


@query("noise_heteroscedastic", f"select row_key, greatest(implied_volatility + 3E-2 * {HETERO} * {sql_normal('noise42')}, 1E-4) as noisy from surface", "noisy")
def _(s, d):
    return A.surface(s, d).select("row_key", B.heteroscedastic(F.col("implied_volatility"), 0.03).alias("noisy"))


@query("inject_noise", f"select row_key, iv_clean, case when observed then greatest(implied_volatility + 1E-2 * {sql_normal('noise42')}, 1E-4) else implied_volatility end as implied_volatility, 1E-2 as noise_sigma from predictions", "iv_clean implied_volatility noise_sigma")
def _(s, d):
    return B.inject_noise(preds(s, d), "low").select("row_key", "iv_clean", "implied_volatility", "noise_sigma")


@query("date_split_map", "select * from split_map")
def _(s, d):
    return B.date_split_map(A.surface(s, d))


@query("time_split", "select row_key, split from predictions")
def _(s, d):
    return B.time_split(A.surface(s, d), B.date_split_map(A.surface(s, d))).select("row_key", "split")


@query("join_split_map", "select case when year(date) > 1999 then 'test' else split end as split, count(*) as n from predictions group by 1")
def _(s, d):
    known = B.date_split_map(A.surface(s, d)).where("year(date) <= 1999")
    return B.time_split(A.surface(s, d), known).groupBy("split").agg(F.count("*").alias("n"))


@query("split_summary", "select split, count(distinct date) as n_dates, count(*) as n_rows, min(date) as min_date, max(date) as max_date from predictions group by 1")
def _(s, d):
    return B.split_summary(preds(s, d))


def _variant_rows(extra: str) -> str:
    out = []
    for v in B.VARIANTS:
        mask = {"random": f"{sql_uniform('mask42')} < {v.keep_frac!r}E0", "realistic": f"{sql_uniform('mask42')} < least(greatest(score / mean * {v.keep_frac!r}E0, 2E-2), 1E0)"}.get(v.strategy) or STRATEGY_SQL[v.strategy]
        sigma = B.NOISE[v.noise]
        noise = f"greatest(implied_volatility + {sigma!r}E0 * {HETERO if v.heteroscedastic else '1E0'} * {sql_normal('noise42')}, 1E-4)" if sigma else "implied_volatility"
        out.append(f"select '{v.name}' as variant, row_key, split, {mask} as observed, case when {mask} then {noise} else implied_volatility end as iv from scored")
    return f", scored as (select *, {SCORE} as score, avg({SCORE}) over () as mean from predictions), variants as ({' union all '.join(out)}) {extra}"


@query("build_benchmark", _variant_rows("select variant, count(*) filter (observed) as n_observed, avg(iv) as mean_iv from variants group by 1"), "mean_iv")
def _(s, d):
    return B.build_all(A.surface(s, d)).groupBy("variant").agg(F.count_if("observed").alias("n_observed"), F.avg("implied_volatility").alias("mean_iv"))


@query("benchmark_manifest", _variant_rows("select variant, count(*) as n_rows, count(*) filter (observed) as n_observed, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test from variants group by 1"))
def _(s, d):
    return B.manifest(B.build_all(A.surface(s, d)))


@query("benchmark_name", "select distinct 'spy_phase1_' || split || cast(cast(round_even(case when observed then 4E-1 else 2E-1 end * 100, 0) as int) as varchar) || '_noise' || case when observed then 'low' else '0' end || case when observed then '_hetero' else '' end as name from predictions")
def _(s, d):
    rows = preds(s, d).select("split", F.when(F.col("observed"), 0.4).otherwise(0.2).alias("keep"), F.when(F.col("observed"), "low").otherwise("none").alias("noise"), "observed")
    return rows.select(B.name_column("split", "keep", "noise", "observed").alias("name")).distinct()


# ---- predictions, joins


@query("split_filter", "select row_key from predictions where split = 'val'")
def _(s, d):
    return preds(s, d).where("split = 'val'").select("row_key")


@query("residual_target", "select row_key, iv_clean - iv_pred as residual, iv_clean as absolute from predictions", "residual absolute")
def _(s, d):
    both = P.residual_target(P.residual_target(preds(s, d), "iv_pred", out="residual"), "iv_pred", mode="absolute", out="absolute")
    return both.select("row_key", "residual", "absolute")


@query("prior_plus_residual", "select row_key, iv_pred + member_0 / 1E1 as hybrid from predictions", "hybrid")
def _(s, d):
    p = preds(s, d)
    residual = p.select("row_key", (F.col("member_0") / 10.0).alias("residual"))
    return explore.attach(p.select("row_key", "iv_pred"), residual).select("row_key", (F.col("iv_pred") + F.col("residual")).alias("hybrid"))


#: Predictions of which some are missing or infinite, as a broken model gives them.
BROKEN = "case when observed then iv_pred when volume = 0 then null when open_interest < 5 then cast('inf' as double) else iv_pred end"


@query("nonfinite_gate", f"select split, count(*) as n, count(*) filter (b is null or isinf(b)) as n_nonfinite, count(*) filter (b is null or isinf(b)) > 0 as blocked from (select split, {BROKEN} as b from predictions) group by 1")
def _(s, d):
    broken = F.when(F.col("observed"), F.col("iv_pred")).when(F.col("volume") == 0, None).when(F.col("open_interest") < 5, F.lit(float("inf"))).otherwise(F.col("iv_pred"))
    p = preds(s, d).withColumn("iv_pred", broken)
    each = [P.nonfinite_gate(p.where(F.col("split") == x), ["iv_pred"]).select(F.lit(x).alias("split"), "*") for x in ("train", "val", "test")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("confidence_inject", "select row_key, case when observed then lower else iv_pred end as lower, case when observed then upper else iv_pred end as upper, case when observed then confidence else 1E0 end as confidence_score from banded", "lower upper confidence_score")
def _(s, d):
    some = lambda c: F.when(F.col("observed"), F.col(c))
    p = bands(s, d).withColumns({"lower": some("lower"), "upper": some("upper"), "confidence_score": some("confidence")})
    return P.confidence_inject(p).select("row_key", "lower", "upper", "confidence_score")


@query("confidence_source", "select row_key, case when observed then -sigma else -abs_error end as confidence, case when observed then 'uncertainty' else 'oracle' end as source from banded", "confidence")
def _(s, d):
    p = bands(s, d).withColumn("uncertainty", F.when(F.col("observed"), F.col("uncertainty")))
    return P.confidence_source(p).select("row_key", "confidence", "source")


MEMBERS = [f"member_{k}" for k in range(5)]
MU = "(" + " + ".join(MEMBERS) + ") / 5E0"
STD = "sqrt((" + " + ".join(f"({m} - mu) * ({m} - mu)" for m in MEMBERS) + ") / 5E0)"
ENSEMBLE = f", ensemble as (select *, {STD} as disagreement_std from (select *, {MU} as mu from banded))"


@query("ensemble_reduce", f"{ENSEMBLE} select row_key, mu, disagreement_std from ensemble", "mu disagreement_std")
def _(s, d):
    return M.ensemble_reduce(preds(s, d), MEMBERS).select("row_key", "mu", "disagreement_std")


@query("ensemble_disagreement_stats", f"{ENSEMBLE} select min(disagreement_std) as lo, avg(disagreement_std) as mean, max(disagreement_std) as hi from ensemble", "lo mean hi")
def _(s, d):
    c = F.col("disagreement_std")
    return M.ensemble_reduce(preds(s, d), MEMBERS).agg(F.min(c).alias("lo"), F.avg(c).alias("mean"), F.max(c).alias("hi"))


def ensemble(s: SparkSession, d: str) -> DataFrame:
    return M.ensemble_reduce(bands(s, d), MEMBERS)


@query("join_ensemble", f"{ENSEMBLE} select split, count(*) as n, avg(disagreement_std) as mean from ensemble group by 1", "mean")
def _(s, d):
    e = M.ensemble_reduce(preds(s, d), MEMBERS).select("row_key", "disagreement_std")
    return explore.attach(preds(s, d).select("row_key", "split"), e).groupBy("split").agg(F.count("*").alias("n"), F.avg("disagreement_std").alias("mean"))


@query("union_splits", "select split, count(*) as n from predictions group by 1")
def _(s, d):
    p = preds(s, d)
    parts = [p.where(F.col("split") == x) for x in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


# ---- metrics

ERR = "avg(abs(iv_pred - iv_clean)) as mae, sqrt(avg((iv_pred - iv_clean) * (iv_pred - iv_clean))) as rmse, avg(abs(iv_pred - iv_clean) / greatest(abs(iv_clean), 1E-6)) * 1E2 as mape"


@query("error_metrics", f"select {ERR}, count(*) as n from predictions", "mae rmse mape")
def _(s, d):
    return M.error_metrics(preds(s, d))


@query("eval_overall_groups", f"select 'overall' as \"group\", {ERR}, count(*) as n from predictions union all select case when observed then 'observed' else 'unobserved' end, {ERR}, count(*) from predictions group by 1", "mae rmse mape")
def _(s, d):
    return M.overall_groups(preds(s, d))


def _spine_sql(axis: str, edges) -> str:
    return " union all ".join(f"select '{axis}' as axis, '{e[0]}' as bucket" for e in edges)


@query(
    "eval_marginals",
    f", found as (select 'maturity' as axis, {MAT} as bucket, {ERR}, count(*) as n from predictions group by 2 union all select 'moneyness', {MON}, {ERR}, count(*) from predictions group by 2) select p.axis, p.bucket, mae, rmse, mape, coalesce(n, 0) as n from ({_spine_sql('maturity', MATURITY)} union all {_spine_sql('moneyness', MONEYNESS)}) p left join found using (axis, bucket)",
    "mae rmse mape",
)
def _(s, d):
    return M.marginals(preds(s, d))


CELLS = "(select * from (" + " union all ".join(f"select '{a[0]}' as maturity" for a in MATURITY) + ") cross join (" + " union all ".join(f"select '{b[0]}' as moneyness" for b in MONEYNESS) + "))"


@query("eval_grid", f"select c.maturity, c.moneyness, rmse, coalesce(n, 0) as n from {CELLS} c left join (select {MAT} as maturity, {MON} as moneyness, {ERR}, count(*) as n from predictions group by 1, 2) using (maturity, moneyness)", "rmse")
def _(s, d):
    return M.grid(preds(s, d), "rmse")


@query("eval_grid_counts", f"select c.maturity, c.moneyness, coalesce(n, 0) as n from {CELLS} c left join (select {MAT} as maturity, {MON} as moneyness, count(*) as n from predictions group by 1, 2) using (maturity, moneyness)")
def _(s, d):
    return M.grid_counts(preds(s, d))


_WIDE = {"": "true", "_observed": "observed", "_unobserved": "not observed", **{f"_{e[0]}": f"{MAT} = '{e[0]}'" for e in MATURITY}, **{f"_{e[0]}": f"{MON} = '{e[0]}'" for e in MONEYNESS}}


@query("metrics_wide", "select " + ", ".join(f"avg(abs_error) filter ({c}) as mae{k}, sqrt(avg(abs_error * abs_error) filter ({c})) as rmse{k}" for k, c in _WIDE.items()) + " from banded", " ".join(f"mae{k} rmse{k}" for k in _WIDE))
def _(s, d):
    return M.metrics_wide(preds(s, d))


@query("baseline_table", f"select 'hash' as model, split, {ERR}, count(*) as n from predictions group by split union all select 'member', split, {ERR.replace('iv_pred', 'member_0')}, count(*) from predictions group by split", "mae rmse mape")
def _(s, d):
    p = preds(s, d)
    both = p.select(F.lit("hash").alias("model"), "split", "iv_pred", "iv_clean").unionByName(p.select(F.lit("member").alias("model"), "split", F.col("member_0").alias("iv_pred"), "iv_clean"))
    return M.error_metrics(both, ["model", "split"])


@query("mae_block", "select avg(abs(iv_pred - iv_clean)) as mae_vs_iv_clean, avg(abs(iv_pred - member_1)) as mae_vs_member_1 from predictions", "mae_vs_iv_clean mae_vs_member_1")
def _(s, d):
    return M.mae_block(preds(s, d), ["iv_clean", "member_1"])


@query("noise_sweep", f", v as (select 'noise_low' as variant, implied_volatility + 1E-2 * {sql_normal('noise42')} as x, iv_clean from predictions union all select 'noise_medium', implied_volatility + 3E-2 * {sql_normal('noise42')}, iv_clean from predictions union all select 'noise_high', implied_volatility + 5E-2 * {sql_normal('noise42')}, iv_clean from predictions) select variant, avg(abs(greatest(x, 1E-4) - iv_clean)) as mae, case when contains(variant, 'low') then 0 when contains(variant, 'medium') then 1 else 2 end as rank from v group by 1", "mae")
def _(s, d):
    out = None
    for k in ("low", "medium", "high"):
        one = preds(s, d).select(F.lit(f"noise_{k}").alias("variant"), B.gaussian(F.col("implied_volatility"), B.NOISE[k]).alias("x"), "iv_clean")
        out = one if out is None else out.unionByName(one)
    v = F.col("variant")
    return out.groupBy("variant").agg(F.avg(F.abs(F.col("x") - F.col("iv_clean"))).alias("mae")).withColumn("rank", F.when(v.contains("low"), 0).when(v.contains("medium"), 1).otherwise(2))


@query("interval_coverage", f"{EVAL[0]} avg(cast(iv_clean between lower and upper as int)) as coverage {EVAL[1]}", "coverage")
def _(s, d):
    return bands(s, d).groupBy("split").agg(M.coverage().alias("coverage"))


@query("interval_width", f"{EVAL[0]} avg(upper - lower) as mean_width {EVAL[1]}", "mean_width")
def _(s, d):
    return bands(s, d).groupBy("split").agg(M.width().alias("mean_width"))


RANKS = ", ranks as (select *, rank() over (partition by split order by abs_error) + (count(*) over (partition by split, abs_error) - 1) / 2E0 as ra, rank() over (partition by split order by uncertainty) + (count(*) over (partition by split, uncertainty) - 1) / 2E0 as rb from banded)"


@query("err_unc_corr", f"{RANKS} select split, corr(abs_error, uncertainty) as pearson, corr(ra, rb) as spearman, count(*) as n from ranks group by 1", "pearson spearman")
def _(s, d):
    return M.correlations(bands(s, d), by=("split",))


NLL = "avg(5E-1 * (ln(2E0 * pi()) + 2E0 * ln(greatest(sigma, 1E-12)) + pow((iv_clean - iv_pred) / greatest(sigma, 1E-12), 2E0)))"


@query("gaussian_nll", f"{EVAL[0]} {NLL} as nll {EVAL[1]}", "nll")
def _(s, d):
    return preds(s, d).groupBy("split").agg(M.gaussian_nll(F.col("iv_pred"), F.col("sigma"), F.col("iv_clean")).alias("nll"))


@query("gaussian_nll_masked", f"{EVAL[0]} avg(ln(greatest(sigma, 1E-6)) + 5E-1 * pow((iv_clean - iv_pred) / greatest(sigma, 1E-6), 2E0)) filter (observed) as nll {EVAL[1]}", "nll")
def _(s, d):
    return preds(s, d).groupBy("split").agg(M.gaussian_nll_masked(F.col("iv_pred"), F.col("sigma"), F.col("iv_clean"), F.col("observed")).alias("nll"))


@query("pinball_loss", f"{EVAL[0]} avg((greatest(5E-2 * (iv_clean - lower), (5E-2 - 1E0) * (iv_clean - lower)) + greatest(5E-1 * (iv_clean - iv_pred), (5E-1 - 1E0) * (iv_clean - iv_pred)) + greatest(95E-2 * (iv_clean - upper), (95E-2 - 1E0) * (iv_clean - upper))) / 3E0) as pinball {EVAL[1]}", "pinball")
def _(s, d):
    return bands(s, d).groupBy("split").agg(M.pinball(F.col("iv_clean"), [(0.05, F.col("lower")), (0.5, F.col("iv_pred")), (0.95, F.col("upper"))]).alias("pinball"))


@query("masked_losses", "select avg(abs_error * abs_error) filter (observed) as masked_mse, avg(abs_error) filter (observed) as masked_mae, 5E-1 * avg(abs_error * abs_error) filter (observed) + 5E-1 * avg(abs_error) filter (observed) as masked_mix from banded", "masked_mse masked_mae masked_mix", digits=9)
def _(s, d):
    return M.masked_losses(preds(s, d), F.col("observed"))


LEVELS = (0.5, 0.68, 0.8, 0.9, 0.95, 0.99)


@query("calibration_curve", " union all ".join(f"select split, {a!r}E0 as nominal_coverage, avg(cast(abs(iv_clean - iv_pred) <= {M.gaussian_z(a)!r}E0 * sigma as int)) as empirical_coverage, count(*) as n from banded group by 1" for a in LEVELS), "nominal_coverage empirical_coverage")
def _(s, d):
    return M.calibration_curve(preds(s, d), LEVELS, ["split"])


@query("metrics_row", f"{RANKS} select split, {ERR}, avg(cast(iv_clean between lower and upper as int)) as coverage, avg(upper - lower) as mean_width, {NLL} as nll, count(*) as n, corr(abs_error, uncertainty) as pearson, corr(ra, rb) as spearman from ranks group by 1", "mae rmse mape coverage mean_width nll pearson spearman")
def _(s, d):
    return M.metrics_row(bands(s, d))


@query("validation_errors", "select avg(abs_error * abs_error) filter (observed) as mse_observed, avg(abs_error) filter (observed) as mae_observed, avg(abs_error) filter (not observed) as mae_unobserved, count(*) filter (observed) as n_observed, count(*) filter (not observed) as n_unobserved from banded", "mse_observed mae_observed mae_unobserved")
def _(s, d):
    return P.validation_errors(bands(s, d))



for _how, _agg in (("mean", "avg(sigma)"), ("sum", "sum(sigma)"), ("max", "max(sigma)"), ("fraction", "avg(cast(observed as int))")):
    _value = "observed" if _how == "fraction" else "sigma"

    @query(f"region_bin_{_how}", f"select c.maturity, c.moneyness, {'coalesce(value, 0E0)' if _how == 'sum' else 'value'} as value, coalesce(n, 0) as n from {CELLS} c left join (select {MAT} as maturity, {MON} as moneyness, {_agg} as value, count(*) as n from predictions group by 1, 2) using (maturity, moneyness)", "value")
    def _(s, d, how=_how, value=_value):
        out = M.region_bin(preds(s, d), value, how)
        return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if how == "sum" else out


@query("region_pivot", "select maturity, " + ", ".join(f"max(v) filter (moneyness = '{e[0]}') as {e[0]}" for e in MONEYNESS) + f" from (select {MAT} as maturity, {MON} as moneyness, avg(sigma) as v from predictions group by 1, 2) group by 1", " ".join(e[0] for e in MONEYNESS))
def _(s, d):
    return M.region_pivot(M.region_bin(preds(s, d), "sigma"))


ZCOLS = ("log_moneyness", "tau")
ZSQL = f", st as (select {', '.join(f'avg({c}) as {c}_m, greatest(stddev_pop({c}), 1E-8) as {c}_s' for c in ZCOLS)} from predictions where split = 'train')"


@query("zscore_fit", f"{ZSQL} select log_moneyness_m as log_moneyness_mean, log_moneyness_s as log_moneyness_std, tau_m as tau_mean, tau_s as tau_std from st", "log_moneyness_mean log_moneyness_std tau_mean tau_std")
def _(s, d):
    return M.zscore_fit(preds(s, d), ZCOLS)


@query("zscore_apply", f"{ZSQL} select row_key, (log_moneyness - log_moneyness_m) / log_moneyness_s as log_moneyness_z, (tau - tau_m) / tau_s as tau_z from predictions, st", "log_moneyness_z tau_z")
def _(s, d):
    return M.zscore_apply(preds(s, d), M.zscore_fit(preds(s, d), ZCOLS), ZCOLS).select("row_key", "log_moneyness_z", "tau_z")


@query("max_abs_z", f"{ZSQL} select split, max(abs((log_moneyness - log_moneyness_m) / log_moneyness_s)) as log_moneyness_max_abs_z, max(abs((tau - tau_m) / tau_s)) as tau_max_abs_z from predictions, st group by 1", "log_moneyness_max_abs_z tau_max_abs_z")
def _(s, d):
    return M.max_abs_z(M.zscore_apply(preds(s, d), M.zscore_fit(preds(s, d), ZCOLS), ZCOLS), ZCOLS)


# ---- abstention

RANKED = ", known as (select *, row_number() over (partition by split order by confidence desc, row_key) as k, count(*) over (partition by split) as n, sum(abs_error) over (partition by split order by confidence desc, row_key rows unbounded preceding) as cum from banded)"
CURVE = RANKED + ", curve as (select split, k as n_retained, k / cast(n as double) as coverage, cum / k as retained_mae from known where k in (select cast(round_even(1E0 + i * (known.n - 1) / 19E0, 0) as bigint) from range(20) t(i)))"


@query("risk_coverage", f"{CURVE} select * from curve", "coverage retained_mae")
def _(s, d):
    return abstain.risk_coverage(bands(s, d), ["split"])


@query("risk_coverage_table", f"{CURVE} select 'hash' as model, * from curve", "coverage retained_mae")
def _(s, d):
    return abstain.risk_coverage(bands(s, d).withColumn("model", F.lit("hash")), ["model", "split"])


@query("aurc", f"{CURVE} select split, sum(part) as aurc from (select split, (coverage - lag(coverage) over w) * (retained_mae + lag(retained_mae) over w) / 2E0 as part from curve window w as (partition by split order by n_retained)) group by 1", "aurc")
def _(s, d):
    return abstain.aurc(abstain.risk_coverage(bands(s, d), ["split"]), ["split"])


@query("confidence_buckets", ", e as (select quantile_cont(confidence, [0E0, 1E-1, 2E-1, 3E-1, 4E-1, 5E-1, 6E-1, 7E-1, 8E-1, 9E-1, 1E0]) as q from banded), b as (select len(list_filter(q[2:10], lambda x: x <= confidence)) as bucket, abs_error, q from banded, e) select cast(bucket as int) as bucket, any_value(q[bucket + 1]) as conf_lo, any_value(q[bucket + 2]) as conf_hi, avg(abs_error) as mae, count(*) as n from b group by 1", "conf_lo conf_hi mae")
def _(s, d):
    return abstain.confidence_buckets(bands(s, d))


@query("high_conf_mae", f"{RANKED} select split, cum / k as high_conf_mae, k as n_kept from known where k = greatest(1, cast(round_even(8E-1 * n, 0) as bigint))", "high_conf_mae")
def _(s, d):
    return abstain.high_confidence_mae(bands(s, d), 0.8, ["split"])


@query("topk_confidence", "select row_key from banded order by confidence desc, row_key limit 25")
def _(s, d):
    return abstain.top_confidence(bands(s, d), 25).select("row_key")


# ---- no-arbitrage

CAL = """, cal as (select *, lag(w) over g - w as d from (select *, implied_volatility * implied_volatility * tau as w from surface) window g as (partition by date, log_moneyness order by tau, row_key)),
calv as (select *, coalesce(d > 1E-9, false) as v from cal)"""
PRICED = sql_priced("surface", "implied_volatility")
MONO = f""", mono as (select *, c - lag(c) over g as d from {PRICED} window g as (partition by date, tau order by log_moneyness, row_key)), monov as (select *, coalesce(d > 1E-9, false) as v from mono)"""
CONV = f""", conv as (select *, case when k1 = k0 or kk = k0 or k1 = kk then null else ((c1 - c) / (k1 - kk) - (c - c0) / (kk - k0)) / (5E-1 * (k1 - k0)) end as sec, c0 is not null and c1 is not null as e from
  (select *, lag(c) over g as c0, lead(c) over g as c1, lag(kk) over g as k0, lead(kk) over g as k1 from (select *, exp(log_moneyness) as kk from {PRICED}) window g as (partition by date, tau order by log_moneyness, row_key))),
convv as (select *, coalesce(sec < -1E-9, false) as v from conv)"""


@query("calendar_check", f"{CAL} select date, count(d) as n_eval, count(*) filter (v) as n_viol, sum(case when v then d else 0E0 end) as severity from calv group by 1", "severity")
def _(s, d):
    return noarb.calendar_check(A.surface(s, d)).groupBy("date").agg(F.count_if("calendar_eval").alias("n_eval"), F.count_if("calendar_violation").alias("n_viol"), F.sum("calendar_severity").alias("severity"))


@query("monotonicity_check", f"{MONO} select date, count(d) as n_eval, count(*) filter (v) as n_viol, sum(case when v then d else 0E0 end) as severity from monov group by 1", "severity")
def _(s, d):
    return noarb.monotonicity_check(A.surface(s, d)).groupBy("date").agg(F.count_if("monotonicity_eval").alias("n_eval"), F.count_if("monotonicity_violation").alias("n_viol"), F.sum("monotonicity_severity").alias("severity"))


@query("convexity_check", f"{CONV} select date, count(*) filter (e) as n_eval, count(*) filter (v) as n_viol from convv group by 1")
def _(s, d):
    return noarb.convexity_check(A.surface(s, d)).groupBy("date").agg(F.count_if("convexity_eval").alias("n_eval"), F.count_if("convexity_violation").alias("n_viol"))


POINTS = f"""{CAL}{MONO}{CONV}, pc as (select row_key, v or coalesce(lead(v) over (partition by date, log_moneyness order by tau, row_key), false) as a from calv),
pm as (select row_key, v or coalesce(lead(v) over (partition by date, tau order by log_moneyness, row_key), false) as b from monov),
px as (select row_key, v or coalesce(lag(v) over g, false) or coalesce(lead(v) over g, false) as c3 from convv window g as (partition by date, tau order by log_moneyness, row_key)),
flags as (select row_key, a as calendar_violation, b as monotonicity_violation, c3 as convexity_violation from pc join pm using (row_key) join px using (row_key))"""


@query("point_flags", f"{POINTS} select * from flags")
def _(s, d):
    return noarb.point_flags(A.surface(s, d)).select("row_key", *(f"{c}_violation" for c in noarb.CHECKS))


@query("no_arb_summary", f"{CAL}{MONO}{CONV} select a.date, a.n as calendar_n_eval, b.n as monotonicity_n_eval, c.n as convexity_n_eval, a.m + b.m + c.m as total_n_viol, (a.m + b.m + c.m) / nullif(cast(a.n + b.n + c.n as double), 0E0) as total_rate from (select date, count(d) as n, count(*) filter (v) as m from calv group by 1) a join (select date, count(d) as n, count(*) filter (v) as m from monov group by 1) b using (date) join (select date, count(*) filter (e) as n, count(*) filter (v) as m from convv group by 1) c using (date)", "total_rate")
def _(s, d):
    return noarb.summary(A.surface(s, d)).select("date", "calendar_n_eval", "monotonicity_n_eval", "convexity_n_eval", "total_n_viol", "total_rate")


@query("finite_group_sort", "select row_key, row_number() over (partition by date, tau order by log_moneyness, row_key) as place from surface where implied_volatility is not null")
def _(s, d):
    from pyspark.sql import Window

    return noarb._usable(A.surface(s, d), "implied_volatility").select("row_key", F.row_number().over(Window.partitionBy("date", "tau").orderBy("log_moneyness", "row_key")).alias("place"))


@query("black_call_price", f"select row_key, c from {PRICED}", "c", digits=8)
def _(s, d):
    return noarb.priced(A.surface(s, d), "implied_volatility").select("row_key", F.col("call_price").alias("c"))


@query("risk_flags", f"{POINTS}, j as (select f.*, date, sigma from flags f join predictions using (row_key)) select row_key, cast(calendar_violation as int) + cast(monotonicity_violation as int) + cast(convexity_violation as int) as struct_count, (cast(calendar_violation as int) + cast(monotonicity_violation as int) + cast(convexity_violation as int)) / 3E0 + sigma / max(sigma) over (partition by date) as risk_score, calendar_violation or monotonicity_violation or convexity_violation or sigma > 1E-2 as risk_flag from j", "risk_score")
def _(s, d):
    flags = noarb.point_flags(A.surface(s, d)).join(preds(s, d).select("row_key", "sigma"), "row_key")
    return noarb.risk_flags(flags, "sigma", 0.01).select("row_key", "struct_count", "risk_score", "risk_flag")


@query("region_table", f"{POINTS}, j as (select f.*, tau, log_moneyness, sigma, cast(calendar_violation as int) + cast(monotonicity_violation as int) + cast(convexity_violation as int) as k from flags f join predictions using (row_key)) select {MAT} as maturity, {MON} as moneyness, avg(k / 3E0) as risk, avg(sigma) as instability, avg(cast(k > 0 as int)) as flag_share, count(*) as n from j group by 1, 2", "risk instability flag_share")
def _(s, d):
    f = noarb.risk_flags(noarb.point_flags(A.surface(s, d)).join(preds(s, d).select("row_key", "sigma"), "row_key"))
    return f.groupBy(maturity().alias("maturity"), moneyness().alias("moneyness")).agg(F.avg("risk_score").alias("risk"), F.avg("sigma").alias("instability"), F.avg((F.col("struct_count") > 0).cast("double")).alias("flag_share"), F.count("*").alias("n"))


# ---- calibration and decisions

Z, Z80 = (repr(M.gaussian_z(a)) + "E0" for a in (0.9, 0.8))


@query("gaussian_band", f"select row_key, iv_pred - {Z} * sigma as lower, iv_pred + {Z} * sigma as upper from predictions", "lower upper")
def _(s, d):
    return calibrate.gaussian_band(preds(s, d)).select("row_key", "lower", "upper")


VAL = ", val as (select * from ensemble where split = 'val')"
TEMP = f", temp as (select least(greatest(r / {Z}, 1E-3), 1E3) as t from (select abs_error / sigma as r, row_number() over (order by abs_error / sigma) as k, count(*) over () as n from val) where k = greatest(ceil(9E-1 * n), 1))"


@query("fit_temperature", f"{ENSEMBLE}{VAL}{TEMP} select t as temperature, (select count(*) from val) as n_fit from temp", "temperature")
def _(s, d):
    return calibrate.fit_temperature(bands(s, d).where("split = 'val'"))


@query("fit_conformal", f"{ENSEMBLE}{VAL} select v as delta, n as n_fit from (select greatest(lower - iv_clean, iv_clean - upper) as v, row_number() over (order by greatest(lower - iv_clean, iv_clean - upper)) as k, count(*) over () as n from val) where k = ceil(least(1E0, ceil((n + 1E0) * 9E-1) / n) * (n - 1E0)) + 1", "delta")
def _(s, d):
    return calibrate.fit_conformal(bands(s, d).where("split = 'val'"))


SCALE = ", fitted as (select case when var_pop(disagreement_std) > 0 then greatest(0E0, covar_pop(disagreement_std, abs_error) / var_pop(disagreement_std)) else 0E0 end as slope, avg(abs_error) as e, avg(disagreement_std) as m from val), scaling as (select slope, e - slope * m as intercept from fitted)"


@query("fit_monotone_scaling", f"{ENSEMBLE}{VAL}{SCALE} select * from scaling", "slope intercept")
def _(s, d):
    return calibrate.fit_scaling(ensemble(s, d).where("split = 'val'"), "disagreement_std")


FUSED = f"{ENSEMBLE}{VAL}{TEMP}{SCALE}, fused as (select *, sqrt(pow(sigma * t, 2E0) + pow(greatest(0E0, slope * disagreement_std + intercept), 2E0)) as u from ensemble, temp, scaling)"


@query("fuse_uncertainty", f"{FUSED} select row_key, u from fused", "u")
def _(s, d):
    e = ensemble(s, d)
    p = calibrate.fit(e.where("split = 'val'"))
    return calibrate.apply(e, p).select("row_key", F.col("uncertainty").alias("u"))


CONF = ", med as (select quantile_cont(u, 5E-1) as centre from fused where split = 'val'), mad as (select greatest(quantile_cont(abs(u - centre), 5E-1) / 6745E-4, 1E-12) as scale, any_value(centre) as centre from fused, med where split = 'val')"


@query("fit_confidence", f"{FUSED}{CONF} select centre, scale from mad", "centre scale", digits=9)
def _(s, d):
    return calibrate.fit(ensemble(s, d).where("split = 'val'")).select("centre", "scale")


@query("calibrator_fit", f"{FUSED}{CONF} select t as temperature, slope, intercept, centre, scale, (select count(*) from val) as n_fit from temp, scaling, mad", "temperature slope intercept centre scale")
def _(s, d):
    return calibrate.fit(ensemble(s, d).where("split = 'val'")).select("temperature", "slope", "intercept", "centre", "scale", "n_fit")


APPLIED = f"{FUSED}{CONF}, applied as (select row_key, date, split, tau, log_moneyness, iv_pred, iv_clean, abs(iv_pred - iv_clean) as abs_error, iv_pred - {Z} * sigma * t as lower, iv_pred + {Z} * sigma * t as upper, u as uncertainty, 1E0 / (1E0 + exp((u - centre) / scale)) as confidence_score from fused, (select scale, centre from mad))"


@query("calibrator_apply", f"{APPLIED} select row_key, lower, upper, uncertainty, confidence_score from applied", "lower upper uncertainty confidence_score")
def _(s, d):
    return applied(s, d).select("row_key", "lower", "upper", "uncertainty", "confidence_score")


@query("calibrator_alpha", f"{APPLIED.replace(Z, Z80).replace('9E-1 * n', '8E-1 * n')} select row_key, lower, upper, uncertainty from applied", "lower upper uncertainty")
def _(s, d):
    e = ensemble(s, d)
    return calibrate.apply(e.drop("uncertainty"), calibrate.fit(e.where("split = 'val'"), alpha=0.8)).select("row_key", "lower", "upper", "uncertainty")


def applied(s: SparkSession, d: str) -> DataFrame:
    e = ensemble(s, d)
    return calibrate.apply(e.drop("uncertainty"), calibrate.fit(e.where("split = 'val'")))


@query("confidence_score", f"{APPLIED} select split, avg(confidence_score) as mean, min(confidence_score) as lo, max(confidence_score) as hi from applied group by 1", "mean lo hi")
def _(s, d):
    c = F.col("confidence_score")
    return applied(s, d).groupBy("split").agg(F.avg(c).alias("mean"), F.min(c).alias("lo"), F.max(c).alias("hi"))


@query("calibrator_roundtrip")
def _(s, d):
    from .data_queries import _scratch

    path = _scratch(s, "calibrator")
    p = calibrate.fit(ensemble(s, d).where("split = 'val'"))
    calibrate.save(p, path)
    return calibrate.load(s, path)


@query("calibration_report", f"{APPLIED}, rr as (select *, rank() over (order by abs_error) + (count(*) over (partition by abs_error) - 1) / 2E0 as ra, rank() over (order by uncertainty) + (count(*) over (partition by uncertainty) - 1) / 2E0 as rb from applied where split = 'test') select avg(cast(iv_clean between lower and upper as int)) as coverage, avg(upper - lower) as mean_width, count(*) as n_rows, corr(abs_error, uncertainty) as pearson, corr(ra, rb) as spearman, abs(avg(cast(iv_clean between lower and upper as int)) - 9E-1) <= 3E-2 as within_tolerance from rr", "coverage mean_width pearson spearman")
def _(s, d):
    return calibrate.report(applied(s, d).where("split = 'test'"))


DECIDED = f"{APPLIED}{POINTS.replace(chr(44) + ' cal as', ', cal as', 1)}, dj as (select a.*, calendar_violation or convexity_violation as forbidden, (upper - lower) / greatest(uncertainty, 1E-9) as rel from applied a join flags using (row_key)), decided as (select *, forbidden or confidence_score < 5E-1 or rel > 33E-1 as abstain_flag, case when forbidden then 'no_arb_violation' when confidence_score < 5E-1 then 'low_confidence' when rel > 33E-1 then 'wide_interval' else 'ok' end as decision_reason, least(greatest(6E-1 * least(greatest(confidence_score, 0E0), 1E0) + 3E-1 * (1E0 - least(greatest(rel / 33E-1, 0E0), 1E0)) + 1E-1 * case when forbidden then 0E0 else 1E0 end, 0E0), 1E0) as tradability_score from dj)"


def decided(s: SparkSession, d: str) -> DataFrame:
    flags = noarb.point_flags(A.surface(s, d)).drop("date", "log_moneyness", "tau")
    return decide.decide(applied(s, d).join(flags, "row_key"), decide.Decision(max_relative_width=3.3))


@query("decision_layer", f"{DECIDED} select row_key, abstain_flag, decision_reason, tradability_score from decided", "tradability_score")
def _(s, d):
    return decided(s, d).select("row_key", "abstain_flag", "decision_reason", "tradability_score")


@query("decision_parts", f"{DECIDED} select row_key, rel as relative_width, forbidden, confidence_score < 5E-1 as low_confidence from decided", "relative_width")
def _(s, d):
    return decided(s, d).select("row_key", "relative_width", "forbidden", "low_confidence")


@query("decision_counts", f"{DECIDED} select count(*) as n, count(*) filter (abstain_flag) as n_abstain, count(*) filter (forbidden) as n_no_arb, count(*) filter (confidence_score < 5E-1) as n_low_confidence, count(*) filter (rel > 33E-1) as n_wide_interval from decided")
def _(s, d):
    return decide.counts(decided(s, d))


@query("decision_eval", f"{DECIDED} select split, count(*) as n, avg(abs_error) as mae, avg(abs_error) filter (not abstain_flag) as mae_kept, avg(cast(abstain_flag as int)) as abstain_rate, avg(tradability_score) as tradability from decided group by 1", "mae mae_kept abstain_rate tradability")
def _(s, d):
    return decide.evaluate(decided(s, d))


@query("decision_full_fold", f"{APPLIED}, ff as (select a.*, p.member_0, row_number() over (order by confidence_score desc, a.row_key) as k, count(*) over () as n from applied a join predictions p using (row_key) where a.split = 'test') select count(*) as n, avg(abs_error) as mae_vs_iv_clean, avg(abs(ff.iv_pred - member_0)) as mae_vs_member, avg(cast(ff.iv_clean between lower and upper as int)) as coverage, avg(abs_error) filter (k <= greatest(1, cast(round_even(8E-1 * ff.n, 0) as bigint))) as high_conf_mae from ff", "mae_vs_iv_clean mae_vs_member coverage high_conf_mae")
def _(s, d):
    t = applied(s, d).where("split = 'test'").withColumn("abs_error", F.abs(F.col("iv_pred") - F.col("iv_clean")))
    t = staged(t.select("row_key", "abs_error", "iv_pred", "iv_clean", "member_0", "lower", "upper", "confidence_score"))  # four passes follow
    one = t.agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae_vs_iv_clean"), F.avg(F.abs(F.col("iv_pred") - F.col("member_0"))).alias("mae_vs_member"), M.coverage().alias("coverage"))
    return one.crossJoin(abstain.high_confidence_mae(t, 0.8, confidence="confidence_score").select("high_conf_mae"))


@query("region_tradability", f"{DECIDED} select c.maturity, c.moneyness, tradability, abstain_rate, coalesce(n, 0) as n from {CELLS} c left join (select {MAT} as maturity, {MON} as moneyness, avg(tradability_score) as tradability, avg(cast(abstain_flag as int)) as abstain_rate, count(*) as n from decided group by 1, 2) using (maturity, moneyness)", "tradability abstain_rate")
def _(s, d):
    return decide.region_tradability(decided(s, d))


# ---- audits

KEYED = ", keyed as (" + " union all ".join(["select date, type, implied_volatility, 'contract' as key_name, cast(expiration as varchar) || '|' || cast(strike as varchar) as key from surface"] + [f"select date, type, implied_volatility, 'coord{k}', cast(round(log_moneyness, {k}) + 0E0 as varchar) || '|' || cast(round(tau, {k}) + 0E0 as varchar) from surface" for k in (8, 10, 12)]) + "), groups as (select key_name, date, key, count(*) as size, max(implied_volatility) - min(implied_volatility) as iv_range, count(distinct type) = 2 as mixed from keyed group by 1, 2, 3)"


@query("duplicate_summary", f"{KEYED} select key_name, cast(sum(size) as bigint) as total_rows, cast(sum(size) filter (size >= 2) as bigint) as rows_in_dup_groups, count(*) filter (size >= 2) as n_dup_groups, count(*) filter (size = 2) as size_2, count(*) filter (size = 3) as size_3, count(*) filter (size >= 4) as size_4_plus, count(*) filter (size >= 2 and mixed) as n_mixed, count(*) filter (size >= 2 and not mixed) as n_same_type from groups group by 1")
def _(s, d):
    return audit.duplicate_summary(A.surface(s, d))


@query("duplicate_dispersion", f"{KEYED} select key_name, case when mixed then 'mixed' else 'same_type' end as kind, count(*) as n, avg(iv_range) as mean, quantile_cont(iv_range, 5E-1) as p50, quantile_cont(iv_range, 9E-1) as p90, quantile_cont(iv_range, 95E-2) as p95, quantile_cont(iv_range, 99E-2) as p99, max(iv_range) as max from groups where size >= 2 group by 1, 2", "mean p50 p90 p95 p99 max")
def _(s, d):
    return audit.duplicate_dispersion(A.surface(s, d))


KEYS = "round(log_moneyness, 10) + 0E0 as lm_key, round(tau, 10) + 0E0 as tau_key"
TWINS = f", twin_at as (select date, {KEYS}, avg(implied_volatility) filter (observed) as twin_iv, count(*) filter (observed) as n_twins, max(iv_clean) - min(iv_clean) as iv_range from predictions group by 1, 2, 3), twins as (select h.*, twin_iv, coalesce(n_twins, 0) as n_twins, iv_range, abs(twin_iv - iv_clean) as twin_error from (select *, {KEYS} from predictions where not observed) h left join twin_at using (date, lm_key, tau_key))"


@query("twin_join", f"{TWINS} select row_key, twin_iv, twin_error from twins", "twin_iv twin_error")
def _(s, d):
    return audit.twins(preds(s, d)).select("row_key", "twin_iv", "twin_error")


@query("iv_range_join", f"{TWINS} select row_key, iv_range from twins", "iv_range")
def _(s, d):
    return audit.twins(preds(s, d)).select("row_key", "iv_range")


WCELL = f"{sql_bucket('log_moneyness', WINGS, chr(39) + 'unknown' + chr(39))} || '/' || {sql_bucket('tau', MATURITY, chr(39) + 'unknown' + chr(39))}"


@query("leakage_table", f"{TWINS} select split, {WCELL} as cell, count(*) as n_hidden, count(*) filter (n_twins > 0) as n_with_twin, avg(twin_error) as twin_mae, avg(iv_range) as iv_range_mean, 10 as decimals from twins group by 1, 2", "twin_mae iv_range_mean", digits=9)
def _(s, d):
    return audit.leakage_table(preds(s, d))


LEAKS = " union all ".join(f"select split, {WCELL} as cell, {k} as decimals, count(*) as n_hidden, count(*) filter (n_twins > 0) as n_with_twin, avg(abs(twin_iv - iv_clean)) as twin_mae, avg(iv_range) as iv_range_mean from (select *, avg(implied_volatility) filter (observed) over g as twin_iv, count(*) filter (observed) over g as n_twins, max(iv_clean) over g - min(iv_clean) over g as iv_range from predictions window g as (partition by date, round(log_moneyness, {k}) + 0E0, round(tau, {k}) + 0E0)) where not observed group by 1, 2" for k in audit.DECIMALS)


@query("leakage_decimals", LEAKS, "twin_mae iv_range_mean", digits=9)
def _(s, d):
    return audit.leakage_table(preds(s, d), audit.DECIMALS)


NEAR = """, near as (select q.row_key, q.date, q.observed, q.iv_clean, min(sqrt((q.log_moneyness - o.log_moneyness) * (q.log_moneyness - o.log_moneyness) + (q.tau - o.tau) * (q.tau - o.tau))) as distance,
  arg_min(o.implied_volatility, (sqrt((q.log_moneyness - o.log_moneyness) * (q.log_moneyness - o.log_moneyness) + (q.tau - o.tau) * (q.tau - o.tau)), o.row_key)) as nearest_iv
  from predictions q join predictions o on q.date = o.date and o.observed group by 1, 2, 3, 4)"""


@query("nearest_observed", f"{NEAR} select row_key, distance, nearest_iv from near", "distance nearest_iv")
def _(s, d):
    return R.nearest_observed(preds(s, d)).select("row_key", "distance", "nearest_iv")


@query("density_table", f"{NEAR}, excl as (select q.row_key, min(case when round(q.log_moneyness, 10) = round(o.log_moneyness, 10) and round(q.tau, 10) = round(o.tau, 10) then null else sqrt((q.log_moneyness - o.log_moneyness) * (q.log_moneyness - o.log_moneyness) + (q.tau - o.tau) * (q.tau - o.tau)) end) as distance from predictions q join predictions o on q.date = o.date and o.observed where not q.observed group by 1), " + "u as (select 'naive' as mode, distance from near where not observed union all select 'dedup', distance from near where not observed union all select 'exclude_same_key', distance from excl) select mode, count(*) as n_hidden, avg(cast(coalesce(distance, 1E9) = 0 as int)) as zero_share, quantile_cont(distance, 25E-2) as q25, quantile_cont(distance, 5E-1) as q50, quantile_cont(distance, 75E-2) as q75 from u group by 1", "zero_share q25 q50 q75")
def _(s, d):
    return audit.density_table(preds(s, d))


@query("audit_strict", f"{KEYED} select s.key_name, n_dup, coalesce(p50, 0E0) as p50 from (select key_name, count(*) filter (size >= 2) as n_dup from groups group by 1) s left join (select key_name, quantile_cont(iv_range, 5E-1) as p50 from groups where size >= 2 and mixed group by 1) using (key_name)", "p50")
def _(s, d):
    return audit.strict(A.surface(s, d)).select("key_name", F.col("n_dup_groups").alias("n_dup"), F.coalesce("p50", F.lit(0.0)).alias("p50"))


@query("audit_benchmark", f"{TWINS} select split, count(*) as n_hidden, count(*) filter (n_twins > 0) as n_with_twin from twins group by 1")
def _(s, d):
    return audit.leakage_table(preds(s, d)).groupBy("split").agg(F.sum("n_hidden").alias("n_hidden"), F.sum("n_with_twin").alias("n_with_twin"))


@query("audit_gate", f"{KEYED}{TWINS}, dups as (select 1E2 * sum(size) filter (size >= 2 and key_name = 'contract') / sum(size) filter (key_name = 'contract') as contract_dup_pct, 1E2 * sum(size) filter (size >= 2 and key_name = 'coord10') / sum(size) filter (key_name = 'coord10') as coord10_dup_pct from groups), worst as (select max(p) as max_split_twin_pct from (select 1E2 * avg(cast(n_twins > 0 as int)) as p from twins group by split)) select *, case when contract_dup_pct <= 5E-1 and coord10_dup_pct <= 5E-1 and max_split_twin_pct <= 5E-1 then 'PASS' else 'FAIL' end as verdict from dups, worst", "contract_dup_pct coord10_dup_pct max_split_twin_pct")
def _(s, d):
    return audit.gate(preds(s, d))


# ---- reconstruction, sensitivity, sweeps

MEANREC = "case when count(*) filter (observed) over d = 0 then 2E-1 else avg(implied_volatility) filter (observed) over d end"


@query("reconstruct_mean", f"select row_key, {MEANREC} as iv_pred from predictions window d as (partition by date)", "iv_pred")
def _(s, d):
    return R.reconstruct_mean(preds(s, d)).select("row_key", "iv_pred")


@query("reconstruct_nearest", f"{NEAR}, mm as (select date, count(*) filter (observed) as n, coalesce(avg(implied_volatility) filter (observed), 2E-1) as mean from predictions group by 1) select p.row_key, least(greatest(case when n < 3 then mean else nearest_iv end, 1E-4), 1E1) as iv_pred from predictions p left join near using (row_key) join mm on mm.date = p.date", "iv_pred")
def _(s, d):
    return R.reconstruct_nearest(preds(s, d)).select("row_key", "iv_pred")


@query("reconstruct_rbf")
def _(s, d):
    return R.reconstruct_rbf(preds(s, d)).select("row_key", "iv_pred")


@query("add_prior_column")
def _(s, d):
    return R.add_prior(preds(s, d)).select("row_key", "rbf_pred", "residual")


@query("coordinate_regression")
def _(s, d):
    return R.coordinate_regression(preds(s, d)).select("row_key", "iv_pred")


@query("coordinate_regression_residual")
def _(s, d):
    """Errors on hidden rows by split: of the date's mean, and of the regressions of what it leaves."""
    out, rows = None, preds(s, d).select("row_key", "date", "log_moneyness", "tau", "observed", "implied_volatility", "iv_clean", "split")
    for name, mode, learner in (("absolute", "absolute", "ridge"), ("residual", "residual", "ridge"), ("residual_trees", "residual", "trees")):
        done = R.coordinate_regression(rows, "implied_volatility", mode=mode, learner=learner).where("not observed")
        one = M.error_metrics(done, ["split"]).select(F.lit(name).alias("model"), "split", "mae", "rmse", "n")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(M.error_metrics(R.reconstruct_mean(preds(s, d)).where("not observed"), ["split"]).select(F.lit("mean").alias("model"), "split", "mae", "rmse", "n"))


@query("query_unquoted", f", q as (select distinct date, 0E0 as log_moneyness, 5E-1 as tau, cast(date as varchar) || '|q' as row_key from surface) select q.row_key, q.date, least(greatest(arg_min(o.implied_volatility, (sqrt((0E0 - o.log_moneyness) * (0E0 - o.log_moneyness) + (5E-1 - o.tau) * (5E-1 - o.tau)), o.row_key)), 1E-4), 1E1) as iv_pred from q join predictions o on o.date = q.date and o.observed group by 1, 2 having count(*) >= 3", "iv_pred")
def _(s, d):
    p = preds(s, d)
    enough = p.groupBy("date").agg(F.count_if("observed").alias("n")).where("n >= 3").select("date")
    q = enough.select("date", F.lit(0.0).alias("log_moneyness"), F.lit(0.5).alias("tau"), F.concat(F.col("date").cast("string"), F.lit("|q")).alias("row_key"))
    return R.query_unquoted(p, q).select("row_key", "date", "iv_pred")


DRAWS = f", draws as (select p.*, draw, observed and row_number() over (partition by date, draw, observed order by (cast('0x' || substr(md5(concat(row_key, '|', cast(draw as varchar), '|draw7')), 1, 8) as bigint) / 4294967296E0), row_key) <= greatest(1, round_even(8E-1 * count(*) over (partition by date, draw, observed), 0)) as kept from predictions p, range(4) t(draw))"


@query("mask_resample", f"{DRAWS} select draw, date, count(*) filter (kept) as n_kept, min(row_key) filter (kept) as first_key from draws group by 1, 2")
def _(s, d):
    r = R.mask_resample(preds(s, d).select("row_key", "date", "observed"), 4, 0.8)
    return r.groupBy(F.col("draw").cast("bigint").alias("draw"), "date").agg(F.count_if("observed").alias("n_kept"), F.min(F.when(F.col("observed"), F.col("row_key"))).alias("first_key"))


SENS = f"{DRAWS}, dm as (select row_key, date, draw, case when count(*) filter (kept) over g = 0 then 2E-1 else avg(implied_volatility) filter (kept) over g end as pred from draws window g as (partition by date, draw)), sens as (select row_key, avg(pred) as mean_pred, stddev_pop(pred) as std_pred, count(pred) as n_finite from dm group by 1)"


@query("masking_sensitivity", f"{SENS} select * from sens", "mean_pred std_pred")
def _(s, d):
    return R.masking_sensitivity(preds(s, d), 4, 0.8, how="mean")


@query("instability_summary", f"{SENS} select avg(std_pred) as mean_std, quantile_cont(std_pred, 5E-1) as median_std, count(*) as n from sens", "mean_std median_std")
def _(s, d):
    return R.instability_summary(R.masking_sensitivity(preds(s, d), 4, 0.8, how="mean"))


DIST = "sqrt((q.log_moneyness - o.log_moneyness) * (q.log_moneyness - o.log_moneyness) + (q.tau - o.tau) * (q.tau - o.tau))"
#: Nearest kept point of each distinct coordinate in each draw.
NEARSENS = f"""{DRAWS}, osites as (select date, draw, log_moneyness, tau, min(row_key) as k, arg_min(implied_volatility, row_key) as iv from draws where kept group by 1, 2, 3, 4),
qsites as (select distinct date, draw, log_moneyness, tau from draws),
nsites as (select q.date, q.draw, q.log_moneyness, q.tau, arg_min(o.iv, ({DIST}, o.k)) as iv from qsites q join osites o on q.date = o.date and q.draw = o.draw group by 1, 2, 3, 4),
nmean as (select date, draw, count(*) filter (kept) as n, coalesce(avg(implied_volatility) filter (kept), 2E-1) as mean from draws group by 1, 2),
npred as (select p.row_key, p.draw, least(greatest(case when n < 3 then mean else coalesce(x.iv, mean) end, 1E-4), 1E1) as pred from draws p join nmean m on p.date = m.date and p.draw = m.draw
  left join nsites x on p.date = x.date and p.draw = x.draw and p.log_moneyness = x.log_moneyness and p.tau = x.tau),
nsens as (select row_key, avg(pred) as mean_pred, stddev_pop(pred) as std_pred, count(pred) as n_finite from npred group by 1)"""


@query("masking_sensitivity_nearest", f"{NEARSENS} select * from nsens", "mean_pred std_pred", digits=9)
def _(s, d):
    return R.masking_sensitivity(preds(s, d), 4, 0.8)


@query("instability_summary_nearest", f"{NEARSENS} select avg(std_pred) as mean_std, quantile_cont(std_pred, 5E-1) as median_std, count(*) as n from nsens", "mean_std median_std")
def _(s, d):
    return R.instability_summary(R.masking_sensitivity(preds(s, d), 4, 0.8))


def _greatest_of_surface(df: DataFrame, by) -> DataFrame:
    """A predictor as a user may write it: each surface's greatest observed value."""
    top = df.groupBy(*by).agg(F.max(F.when(F.col("observed"), F.col("implied_volatility"))).alias("iv_pred"))
    return df.join(top, list(by))


@query("predictor_hook", "select row_key, max(implied_volatility) filter (observed) over (partition by date) as iv_pred from predictions", "iv_pred")
def _(s, d):
    return R.predicted(preds(s, d), _greatest_of_surface).select("row_key", "iv_pred")


@query("masking_hook", "select draw, count(*) filter (observed and (open_interest + draw) % 3 <> 0) as n_kept, count(*) as n from predictions, range(3) t(draw) group by 1")
def _(s, d):
    hide = lambda copies: copies.withColumn("observed", (F.col("open_interest") + F.col("draw")) % 3 != 0)
    m = R.masked(preds(s, d), 3, masking=hide)
    return m.groupBy(F.col("draw").cast("bigint").alias("draw")).agg(F.count_if("observed").alias("n_kept"), F.count("*").alias("n"))


@query("flags_hook", "select case when open_interest < 5 then 'no_arb_violation' when confidence < 5E-1 then 'low_confidence' when (upper - lower) / greatest(uncertainty, 1E-9) > 4E0 then 'wide_interval' else 'ok' end as decision_reason, count(*) as n from banded group by 1")
def _(s, d):
    flags = lambda df: df.where("open_interest < 5").select("row_key", F.lit(True).alias("thin"))
    done = decide.decide(bands(s, d).withColumn("confidence_score", F.col("confidence")), decide.Decision(max_relative_width=4.0, forbid_flags=("thin",)), flags)
    return done.groupBy("decision_reason").agg(F.count("*").alias("n"))


SWEEP = f""", rungs as (select p.*, cast(i as int) as rung_index, x as intensity from predictions p, (select unnest([0, 1, 2, 3, 4]) as i, unnest([0E0, 2E-1, 4E-1, 6E-1, 8E-1]) as x)),
mats as (select *, row_number() over (partition by date, rung_index order by (cast('0x' || substr(md5(concat(cast(date as varchar), '|', cast(cast(round(tau * 365E0) as int) as varchar), '|maturity11')), 1, 8) as bigint) / 4294967296E0), tau) as r, round_even(intensity * count(*) over (partition by date, rung_index), 0) as n_drop from (select distinct date, rung_index, intensity, tau from rungs where observed)),
sorted as (select date, rung_index, abs(log_moneyness) as a, row_number() over (partition by date, rung_index order by abs(log_moneyness), row_key) - 1 as r, (count(*) over (partition by date, rung_index) - 1) * (1E0 - intensity) as pos from rungs where observed),
wings as (select date, rung_index, max(a) filter (r = floor(pos)) + (max(a) filter (r = ceil(pos)) - max(a) filter (r = floor(pos))) * any_value(pos - floor(pos)) as lim from sorted group by 1, 2),
kept as (select r.row_key, r.date, r.rung_index, intensity, observed, iv_clean, iv_pred, {sql_uniform('quotes11').replace('row_key', 'r.row_key')} < 1E0 - intensity as kq, coalesce(abs(log_moneyness) <= lim, false) as kw, m.tau is null as km
  from rungs r left join wings w on w.date = r.date and w.rung_index = r.rung_index left join (select date, rung_index, tau from mats where r <= n_drop) m on m.date = r.date and m.rung_index = r.rung_index and m.tau = r.tau),
swept as (select 'fewer_quotes' as regime, *, observed and kq as retained from kept union all select 'thin_wings', *, observed and kw from kept union all select 'missing_maturities', *, observed and km from kept union all select 'combined_quotes_wings', *, observed and kq and kw from kept)"""


def swept(s: SparkSession, d: str) -> DataFrame:
    return W.sweep(preds(s, d))


for _regime in W.REGIMES:

    @query(f"sweep_{_regime.replace('combined_quotes_wings', 'combined')}", f"{SWEEP} select rung_index, date, count(*) filter (retained) as n_retained from swept where regime = '{_regime}' group by 1, 2")
    def _(s, d, regime=_regime):
        return W.sweep(preds(s, d), regimes=[regime]).groupBy("rung_index", "date").agg(F.count_if("retained").alias("n_retained"))


@query("sweep_build", f"{SWEEP} select regime, rung_index, count(*) as n_rows, count(*) filter (not observed) as n_query from swept group by 1, 2")
def _(s, d):
    return swept(s, d).groupBy("regime", "rung_index").agg(F.count("*").alias("n_rows"), F.count_if("is_query_fixed").alias("n_query"))


@query("sweep_manifest", f"{SWEEP} select regime, rung_index, max(intensity) as intensity, count(*) filter (retained) as n_retained, count(*) filter (observed) as n_base, count(*) filter (retained) / cast(count(*) filter (observed) as double) as retained_fraction from swept group by 1, 2", "intensity retained_fraction")
def _(s, d):
    return W.manifest(swept(s, d))


@query("sink_long_sweep", f"{SWEEP} select regime, count(*) as n from swept group by 1")
def _(s, d):
    from ..sources import files
    from .data_queries import _scratch

    path = _scratch(s, "sweep")
    files.write_sweep(swept(s, d), path)
    return s.read.parquet(path).groupBy("regime").agg(F.count("*").alias("n"))


@query("sweep_reconstruct")
def _(s, d):
    return W.accumulate(W.reconstruct(swept(s, d), "rbf"))


@query("sweep_accumulate", f"{SWEEP} select regime, rung_index, avg(abs(iv_pred - iv_clean)) as mae, sqrt(avg(pow(iv_pred - iv_clean, 2E0))) as rmse, avg(abs(iv_pred - iv_clean)) filter (not observed) as mae_query, count(*) filter (retained) as n_retained, 0 as n_nonfinite, count(*) as n from swept group by 1, 2", "mae rmse mae_query")
def _(s, d):
    return W.accumulate(W.sweep(preds(s, d), carry=["iv_pred"])).withColumn("n_nonfinite", F.col("n_nonfinite").cast("int"))


MONO_SQL = f"""{SWEEP}, sm as (select regime, rung_index, iv_clean, coalesce(avg(implied_volatility) filter (retained) over (partition by regime, rung_index, date), 2E-1) as pred from (select s.*, p.implied_volatility from swept s join predictions p using (row_key))),
acc as (select regime, rung_index, avg(abs(pred - iv_clean)) as mae from sm group by 1, 2), st as (select *, mae - lag(mae) over (partition by regime order by rung_index) as step from acc)"""


@query("sweep_monotone", f"{MONO_SQL} select regime, coalesce(min(step) >= -1E-6, true) as monotone, arg_min(mae, rung_index) as dense_mae from st group by 1", "dense_mae")
def _(s, d):
    return W.monotone(W.accumulate(W.reconstruct(swept(s, d), "mean")))


@query("diagnose_date")
def _(s, d):
    p = R.reconstruct_nearest(preds(s, d))
    flags = noarb.point_flags(p, "iv_pred")
    sens = R.masking_sensitivity(preds(s, d), 3, 0.8)
    return noarb.risk_flags(flags.join(sens, "row_key"), "std_pred", 0.02).select("row_key", "date", "struct_count", "risk_score", "risk_flag", "std_pred")


@query("diagnostics_run", f"{CAL}{MONO}{CONV} select split, date, a.m + b.m + c.m as n_viol from (select date, count(*) filter (v) as m from calv group by 1) a join (select date, count(*) filter (v) as m from monov group by 1) b using (date) join (select date, count(*) filter (v) as m from convv group by 1) c using (date) join split_map using (date)")
def _(s, d):
    return noarb.summary(preds(s, d), by=("split", "date")).select("split", "date", F.col("total_n_viol").alias("n_viol"))


def _sql_rates(table: str, model: str) -> str:
    """Mean rate over dates of the calendar check and of the monotonicity check on a table (row_key, date, split, tau, log_moneyness, spot, implied_volatility)."""
    cal = CAL.replace("from surface", f"from {table}").replace("cal as", f"cal_{model} as", 1).replace("calv as", f"calv_{model} as").replace("from cal)", f"from cal_{model})")
    mono = MONO.replace("surface", table).replace("mono as", f"mono_{model} as", 1).replace("monov as", f"monov_{model} as").replace("from mono)", f"from mono_{model})")
    return cal + mono


MODELS_SQL = f"""{NEARSENS}{SENS.removeprefix(DRAWS)}, near1 as (select q.row_key, min({DIST}) as distance, arg_min(o.implied_volatility, ({DIST}, o.row_key)) as nearest_iv from predictions q join predictions o on q.date = o.date and o.observed group by 1),
m_mean as (select * replace ({MEANREC} as implied_volatility) from predictions window d as (partition by date)),
mm as (select date, count(*) filter (observed) as n, coalesce(avg(implied_volatility) filter (observed), 2E-1) as mean from predictions group by 1),
m_nearest as (select p.* replace (least(greatest(case when n < 3 then mean else nearest_iv end, 1E-4), 1E1) as implied_volatility) from predictions p left join near1 using (row_key) join mm on mm.date = p.date)
{_sql_rates('m_mean', 'mean')}{_sql_rates('m_nearest', 'nearest')}"""


def _sql_model(model: str, sens: str) -> str:
    rate = lambda t, name: f"select split, '{name}' as metric, avg(r) as v from (select split, date, count(*) filter (v) / nullif(cast(count(d) as double), 0E0) as r from {t}_{model} group by 1, 2) group by 1"
    return f"{rate('calv', 'calendar_rate')} union all {rate('monov', 'monotonicity_rate')} union all select split, 'instability', avg(std_pred) from {sens} join predictions using (row_key) group by 1"


@query("diagnostics_rollup", f"{MODELS_SQL} select a.split, a.metric, a.v as mean, b.v as nearest from ({_sql_model('mean', 'sens')}) a join ({_sql_model('nearest', 'nsens')}) b using (split, metric)", "mean nearest")
def _(s, d):
    done = diagnostics.rollup(preds(s, d), {"mean": "mean", "nearest": "nearest"}, draws=4)
    return done.where("metric <> 'convexity_rate'")


# ---- inference

DELTA = "abs(member_0 - iv_clean) - abs(iv_pred - iv_clean)"


def _boot(group: str, n_boot: int, rows: str) -> str:
    by = f"{group}, " if group else ""
    part = f"partition by {group}" if group else ""
    on = " and ".join(f"a.{c.strip()} = g.{c.strip()}" for c in group.split(",")) if group else "true"
    cols = "".join(f"g.{c.strip()}, " for c in group.split(",")) if group else ""
    return f""", bd as (select {by}date, sum(delta) as s, count(delta) as n from {rows} group by {by}date),
bs as (select *, row_number() over ({part} order by date) - 1 as slot, count(*) over ({part}) as g from bd),
bg as (select {by}max(g) as g, sum(s) / sum(n) as mean_delta from bs {'group by ' + group if group else ''}),
bp as (select {cols}b, i, g.g, mean_delta, floor(cast('0x' || substr(md5(cast(b as varchar) || '|' || cast(i as varchar) || '|boot0'), 1, 8) as bigint) / 4294967296E0 * g.g) as slot from bg g, range({n_boot}) t(b), range(1000) r(i) where i < g.g),
bm as (select {cols}g.b, any_value(g.g) as n_groups, any_value(g.mean_delta) as mean_delta, sum(a.s) / sum(a.n) as m from bp g join bs a on a.slot = g.slot and {on} group by {cols}g.b),
boot as (select {by}any_value(mean_delta) as mean_delta, quantile_cont(m, 25E-3) as ci_low, quantile_cont(m, 975E-3) as ci_high, any_value(n_groups) as n_groups, quantile_cont(m, 975E-3) < 0 as significant from bm {'group by ' + group if group else ''})"""


@query("bootstrap_delta_ci", ", rd as (select *, " + DELTA + " as delta from predictions)" + _boot("", 2000, "rd") + " select mean_delta, ci_low, ci_high, n_groups, significant from boot", "mean_delta ci_low ci_high")
def _(s, d):
    c = F.col
    return infer.bootstrap_delta(preds(s, d), F.abs(c("member_0") - c("iv_clean")) - F.abs(c("iv_pred") - c("iv_clean")))


TRAJ = SWEEP + ", tr as (select *, abs(case when retained then iv_clean + 9E-1 * (iv_pred - iv_clean) else iv_pred end - iv_clean) as eh, abs(iv_pred - iv_clean) as er from swept), rd as (select *, eh - er as delta from tr)" + _boot("regime, rung_index", 100, "rd") + ", tm as (select regime, rung_index, max(intensity) as intensity, avg(er) as rbf_mae, avg(eh) as hybrid_mae, avg(er) filter (not observed) as rq, avg(eh) filter (not observed) as hq, count(*) as n_rows from tr group by 1, 2), traj as (select tm.regime, tm.rung_index, intensity, rbf_mae, hybrid_mae, (rbf_mae - hybrid_mae) / rbf_mae * 1E2 as rel_edge_pct, (rq - hq) / rq * 1E2 as rel_edge_pct_query, n_rows, ci_low, ci_high, significant from tm join boot on tm.regime = boot.regime and tm.rung_index = boot.rung_index)"


def traj(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = W.sweep(preds(s, d), carry=["iv_pred"]).withColumn("rbf_pred", c("iv_pred"))
    t = t.withColumn("mu_hybrid", F.when(c("retained"), c("iv_clean") + 0.9 * (c("iv_pred") - c("iv_clean"))).otherwise(c("iv_pred")))
    return infer.trajectory(t, n_boot=100)


@query("sparsity_trajectory", f"{TRAJ} select regime, rung_index, intensity, rbf_mae, hybrid_mae, rel_edge_pct, rel_edge_pct_query, n_rows, ci_low, ci_high, significant from traj", "intensity rbf_mae hybrid_mae rel_edge_pct rel_edge_pct_query ci_low ci_high", digits=8)
def _(s, d):
    return traj(s, d).select("regime", "rung_index", "intensity", "rbf_mae", "hybrid_mae", "rel_edge_pct", "rel_edge_pct_query", "n_rows", "ci_low", "ci_high", "significant")


RUNGSQL = f"""{SWEEP.replace("select r.row_key, r.date,", "select r.row_key, r.date, r.log_moneyness, r.tau, r.implied_volatility,")}, ro as (select date, regime, rung_index, log_moneyness, tau, min(row_key) as k, arg_min(implied_volatility, row_key) as iv from swept where retained group by all),
rq as (select distinct date, regime, rung_index, log_moneyness, tau from swept),
rn as (select q.date, q.regime, q.rung_index, q.log_moneyness, q.tau, arg_min(o.iv, ({DIST}, o.k)) as iv from rq q join ro o on q.date = o.date and q.regime = o.regime and q.rung_index = o.rung_index group by all),
rm as (select date, regime, rung_index, count(*) filter (retained) as n, coalesce(avg(implied_volatility) filter (retained), 2E-1) as mean from swept group by all),
tr as (select s.regime, s.rung_index, s.date, s.intensity, s.observed, abs(m.mean - iv_clean) as er, abs(least(greatest(case when m.n < 3 then m.mean else coalesce(x.iv, m.mean) end, 1E-4), 1E1) - iv_clean) as eh
  from swept s join rm m on m.date = s.date and m.regime = s.regime and m.rung_index = s.rung_index left join rn x on x.date = s.date and x.regime = s.regime and x.rung_index = s.rung_index and x.log_moneyness = s.log_moneyness and x.tau = s.tau),
traj as (select regime, rung_index, avg(er) as base_mae, avg(eh) as model_mae, (avg(er) - avg(eh)) / avg(er) * 1E2 as rel_edge_pct, count(*) as n_rows from tr group by 1, 2)"""


@query("trajectory_reconstructed", f"{RUNGSQL} select * from traj", "base_mae model_mae rel_edge_pct")
def _(s, d):
    t = infer.trajectory(W.compared(swept(s, d), "nearest", "mean"), n_boot=100)
    return t.select("regime", "rung_index", F.col("rbf_mae").alias("base_mae"), F.col("hybrid_mae").alias("model_mae"), "rel_edge_pct", "n_rows")


PER = "per as (select regime, arg_min(rel_edge_pct, rung_index) as dense, arg_max(rel_edge_pct, rung_index) as sparse, arg_max(significant, rung_index) as sig, max(rel_edge_pct) as top from {t} group by 1)"
VERDICT = "select survives, retired, case when survives then 'true' when retired then 'false' else 'ambiguous' end as verdict from (select coalesce(bool_and(sparse - dense >= 1E0 and sig and sparse >= 5E0) filter (regime in ('thin_wings', 'combined_quotes_wings')), false) as survives, max(top) <= 2E0 as retired from per)"


@query("gate_adjudicate", f"{TRAJ}, {PER.format(t='traj')} {VERDICT}")
def _(s, d):
    return infer.adjudicate(traj(s, d))


@query("gate_resolve", f"{TRAJ}, fair as (select regime, rung_index, rel_edge_pct, significant from traj where rung_index > 0 union all select distinct regime, 0, 2E0, true from traj), {PER.format(t='fair')} {VERDICT}")
def _(s, d):
    return infer.resolve(traj(s, d), 2.0)


@query("trajectory_compare", f"{TRAJ} select a.regime, a.rung_index, a.rel_edge_pct as edge_a, b.rel_edge_pct as edge_b from traj a left join (select * from traj where rung_index > 1) b on a.regime = b.regime and a.rung_index = b.rung_index", "edge_a edge_b")
def _(s, d):
    t = traj(s, d)
    return infer.compare_trajectories(t, t.where("rung_index > 1"))


CMP = f", long as (select 'hash' as source, split, metric, value, n from (select split, {ERR}, count(*) as n from predictions group by 1) unpivot (value for metric in (mae, rmse, mape)) union all select 'member', split, metric, value, n from (select split, {ERR.replace('iv_pred', 'member_0')}, count(*) as n from predictions group by 1) unpivot (value for metric in (mae, rmse, mape)))"


def long(s: SparkSession, d: str) -> DataFrame:
    names = ("mae", "rmse", "mape")
    a = infer.comparison_long(M.error_metrics(preds(s, d), ["split"]), "point", "mean", "hash", names)
    return a.unionByName(infer.comparison_long(M.error_metrics(preds(s, d), ["split"], pred="member_0"), "point", "mean", "member", names))


@query("comparison_long", f"{CMP} select 'point' as family, 'mean' as head, split, metric, value, source, n from long", "value")
def _(s, d):
    return long(s, d)


@query("comparison_wide", f"{CMP} select 'mean' as head, a.split, a.metric, a.value as value_a, b.value as value_b, b.value - a.value as delta, b.value / a.value as ratio from long a join long b using (split, metric) where a.source = 'hash' and b.source = 'member'", "value_a value_b delta ratio")
def _(s, d):
    return infer.comparison_wide(long(s, d), "hash", "member")


# ---- spectra


def vectors(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "embeddings")


@query("effective_rank")
def _(s, d):
    return spectrum.effective_rank(vectors(s, d)).drop("spectrum")


@query("spectrum_trace", "select sum(v) as total_variance, count(*) as dim from (select i, var_pop(cast(embedding[i] as double)) as v from embeddings, range(1, 65) t(i) group by 1)", "total_variance", base=False)
def _(s, d):
    return spectrum.trace(vectors(s, d))


@query("pc_project")
def _(s, d):
    mean, v = spectrum.loadings(vectors(s, d))
    return spectrum.pc_project(vectors(s, d), mean, v[:, :8]).select("vec_id", "pcs")


@query("pc_reconstruct")
def _(s, d):
    mean, v = spectrum.loadings(vectors(s, d))
    p = spectrum.pc_reconstruct(spectrum.pc_project(vectors(s, d), mean, v), mean, v, 8)
    err = F.aggregate(F.zip_with("embedding", "reconstructed", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)
    return p.select("vec_id", err.alias("squared_error"))


@query("ablate_dim", "select cast(i - 1 as int) as dim, var_pop(cast(embedding[i] as double)) as loss from embeddings, range(1, 65) t(i) group by 1", "loss", base=False)
def _(s, d):
    return spectrum.ablate_dim(vectors(s, d)).select("dim", "loss")


@query("ablate_pc")
def _(s, d):
    return spectrum.ablate_pc(vectors(s, d))


# ---- streams


#: Rows of a landed file, where there are as many.
LANDED_ROWS = 1_000_000


def _files(rows: DataFrame, parts: str) -> int:
    """Files to land each part as: the same number for all, so that a stream takes whole parts, and each of them has rows."""
    least, most = rows.groupBy(parts).count().agg(F.min("count"), F.max("count")).first()
    return max(1, min(least or 1, (most or 1) // LANDED_ROWS))


@query("stream_chain_ingest", "select count(*) filter (event_id % 10 <> 0 and json_extract_string(props, '$.k') is not null) as n_rows, count(*) filter (event_id % 10 = 0) as n_rejects from events", base=False)
def _(s, d):
    from ..streaming.jobs import stream_chain_ingest
    from .data_queries import _scratch, events

    top = _scratch(s, "stream")
    events(s, d).where("body is not null").select("body").repartition(4).write.json(f"{top}/landing")
    stream_chain_ingest(s, f"{top}/landing", f"{top}/out", f"{top}/checkpoint", max_files=2)
    # a pull that is made again lands a part of its payloads twice
    again = events(s, d).where("body is not null and event_id % 10 <> 0 and event_id % 3 = 0").select("body")
    again.unionByName(again).repartition(2).write.mode("append").json(f"{top}/landing")
    stream_chain_ingest(s, f"{top}/landing", f"{top}/out", f"{top}/checkpoint", max_files=2)
    rows = s.read.parquet(f"{top}/out").where("contract_id is not null").agg(F.count("*").alias("n_rows"))
    return rows.crossJoin(s.read.parquet(f"{top}/out_rejects").agg(F.count("*").alias("n_rejects")))  # one row each


#: A twentieth of the rows comes when its date has been closed.
LATE = f"{sql_uniform('late')} < 5E-2 and date < (select max(date) from surface_all)"
LATE_OTM = _otm("").replace("spread_rows as (select *", f"spread_rows as (select * from (select *", 1).replace("as spread from surface)", f"as spread from surface) where not ({LATE.replace('surface_all', 'surface')}))", 1)


@query("stream_late_rows", f"{LATE_OTM} select 'emitted' as kind, date, count(*) as n from built where date < (select max(date) from surface) group by 2 union all select 'late', date, count(*) from surface where {LATE.replace('surface_all', 'surface')} group by 2", base=False)
def _(s, d):
    from ..functions.rng import key_uniform
    from ..streaming.jobs import stream_date_close
    from .data_queries import _scratch

    top = _scratch(s, "stream")
    q = A.surface(s, d)
    last = q.agg(F.max("date").alias("_last"))
    rows = q.crossJoin(F.broadcast(last)).withColumn("_late", (key_uniform("row_key", "late") < 0.05) & (F.col("date") < F.col("_last")))  # one row
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema)
    n = _files(rows, "_late")
    for late in (False, True):  # and the stream is started again in between
        rows.where(F.col("_late") == late).select(*q.columns).repartition(n).write.mode("append").parquet(f"{top}/landing")
        stream_date_close(s, f"{top}/landing", schema, f"{top}/out", f"{top}/checkpoint", max_files=n)
    count = lambda path, kind: s.read.parquet(path).groupBy("date").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "date", "n")
    return count(f"{top}/out", "emitted").unionByName(count(f"{top}/out_late", "late"))


@query("stream_date_close", _otm("select date, count(*) as n from built where date < (select max(date) from built) group by 1"), base=False)
def _(s, d):
    from ..streaming.jobs import stream_date_close
    from .data_queries import _scratch

    top = _scratch(s, "stream")
    q = A.surface(s, d)
    days = staged(q.select("date").distinct().select("date", F.ntile(6).over(Window.orderBy("date")).alias("part")))
    n = _files(q.join(F.broadcast(days), "date"), "part")
    for k in range(1, 7):  # files land one after another, as days do
        q.join(F.broadcast(days.where(F.col("part") == k).select("date")), "date").select(*q.columns).repartition(n).write.mode("append").parquet(f"{top}/landing")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema)
    stream_date_close(s, f"{top}/landing", schema, f"{top}/out", f"{top}/checkpoint", max_files=2 * n)
    return s.read.parquet(f"{top}/out").groupBy("date").agg(F.count("*").alias("n"))
