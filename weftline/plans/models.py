"""Queries of the regression, calibration and latent-share operators over the monthly panel and the coders' votes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.functions.maths import chi2_tail
from weftline.operators import latent
from weftline.operators import panel as p
from weftline.operators import regress as r
from weftline.plans.panels import _LAB, _PANEL, FIRST, _events, _panel
from weftline.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FIT_SCHEMA = "term string, beta double, se double, z double, p double, low double, high double"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _sample(spark, folder):
    """Monthly panel with lead outcome, lags, log counts and time, complete rows only."""
    wide = p.leads_and_lags(_panel(spark, folder), "actor_id", "month", "y", 1, 2).withColumns(
        {"log_events": F.log1p("n_events"), "time_years": (F.col("month") - FIRST) / 12.0, "deadly": (F.col("fatalities") > 0).cast("double")})
    return r.complete(wide, ["y_lead1", "y", "y_lag1", "y_lag2", "log_events"])


XS = ["y", "y_lag1", "y_lag2", "log_events", "time_years", "deadly"]
_DEMEANED = f"""{_PANEL}, l as (select actor_id, month, y, lead(y) over (partition by actor_id order by month) as nxt from bal), c as (select * from l where nxt is not null),
d as (select actor_id, month, y - avg(y) over (partition by actor_id) as x, nxt - avg(nxt) over (partition by actor_id) as z from c), b as (select sum(x * z) / sum(x * x) as beta, sum(x * x) as xx, count(*) as n from d),
s as (select actor_id, month, x * (z - beta * x) as s from d, b),
g as (select (select sum(s * s) from s) + 2 * (select sum((1 - k.lag / 4.0) * s.s * q.s) from s join (select unnest([1, 2, 3]) as lag) k on true join s q on q.actor_id = s.actor_id and q.month = s.month - k.lag) as meat)"""


@query(_DEMEANED + " select beta, sqrt(meat * (n / (n - 1.0)) / (xx * xx)) as se, n from b, g")
def ols_hac_univariate(spark, folder):
    lead = p.leads_and_lags(_panel(spark, folder), "actor_id", "month", "y", 1, 0).where("y_lead1 is not null").select("actor_id", "month", "y", "y_lead1")
    f = r.fit(r.demeaned(lead, ["actor_id"], ["y", "y_lead1"]), "y_lead1", ["y"], "actor_id", "month", lags=3, intercept=False)
    return spark.createDataFrame([(float(f.beta[0]), math.sqrt(f.cov[0, 0]), f.n)], "beta double, se double, n long")


@query()
def ols_hac_panel(spark, folder):
    f = r.fit(_sample(spark, folder), "y_lead1", XS, "actor_id", "month", 6, signals=["deadly", "log_events"])
    return spark.createDataFrame(f.rows(), FIT_SCHEMA)


@query()
def ols_diagnostics(spark, folder):
    s = _sample(spark, folder)
    f = r.fit(s, "y_lead1", XS, "actor_id", "month", 6, signals=["deadly", "log_events"])
    return spark.createDataFrame([(k, float(v)) for k, v in f.diagnostics.items()] + [("residual_ar1", r.residual_ar1(s, f, "y_lead1", "actor_id", "month"))] + [(f"vif_{k}", v) for k, v in r.vifs(f).items()], "name string, value double")


@query()
def bca_bcm(spark, folder):
    sample = r.complete(_sample(spark, folder), XS, ("n_events", 1))
    f = r.fit(sample, "y_lead1", XS, "actor_id", "month", 6)
    mean, square = sample.agg(F.avg("deadly"), F.avg(F.col("deadly") ** 2)).first()
    tp, fn, fp, tn = _paired_cells(spark, folder)
    c = r.corrected(f, "deadly", r.index_omega(mean, square, tp / (tp + fn), fp / (fp + tn)), r.count_kappa(sample, "n_events"))
    return spark.createDataFrame([(k, v) for k, v in c.items()], "estimator string, value double")


@query(f"""{_PANEL}, l as (select month, y as x, lead(y) over (partition by actor_id order by month) as z from bal), c as (select * from l where z is not null),
m as (select month, count(*) as n, sum(x) as sx, sum(z) as sz, sum(x * x) as sxx, sum(x * z) as sxz from c group by 1),
u as (select month, sum(n) over w as n, sum(sx) over w as sx, sum(sz) over w as sz, sum(sxx) over w as sxx, sum(sxz) over w as sxz from m window w as (order by month rows between unbounded preceding and 1 preceding)),
b as (select month, (n * sxz - sx * sz) / (n * sxx - sx * sx) as slope, sz / n - (n * sxz - sx * sz) / (n * sxx - sx * sx) * sx / n as cut from u where n >= 60)
select c.month, count(*) as n, sum((z - cut - slope * x) ** 2) as sse from c join b on b.month = c.month group by 1""")
def rolling_forecast(spark, folder):
    lead = p.leads_and_lags(_panel(spark, folder), "actor_id", "month", "y", 1, 0).where("y_lead1 is not null")
    return r.rolling_forecasts(lead, "y_lead1", ["y"], "month").drop("sae")


@query()
def forecast_uncertainty(spark, folder):
    s = _sample(spark, folder)
    a = r.rolling_forecasts(s, "y_lead1", XS, "month").withColumnsRenamed({"sse": "sse_full", "sae": "sae_full"})
    b = r.rolling_forecasts(s, "y_lead1", XS[:3], "month").select("month", F.col("sse").alias("sse_base"), F.col("sae").alias("sae_base"))
    per = a.join(b, "month").orderBy("month").toPandas()
    draws = latent.cluster_bootstrap(per.sse_full.to_numpy(), per.sse_base.to_numpy(), per.n.to_numpy(float), 1000, 8731)
    full, base = math.sqrt(per.sse_full.sum() / per.n.sum()), math.sqrt(per.sse_base.sum() / per.n.sum())
    return spark.createDataFrame([(full, base, full - base, float(np.quantile(draws, 0.025)), float(np.quantile(draws, 0.975)), float(per.sae_full.sum() / per.n.sum()), float(per.sae_base.sum() / per.n.sum()))],
                                 "rmse_full double, rmse_base double, difference double, low double, high double, mae_full double, mae_base double")


@query(f"""{_PANEL}, o as (select b.actor_id, b.month, b.y as x, q.h, v.y as z from bal b join (select unnest([-2, -1, 1, 2]) as h) q on true left join bal v on v.actor_id = b.actor_id and v.month = b.month + q.h),
full_rows as (select actor_id, month from o group by 1, 2 having count(z) = 4), s as (select o.* from o join full_rows f on f.actor_id = o.actor_id and f.month = o.month)
select h, regr_slope(z, x) as beta, count(*) as n from s group by 1""")
def lead_lag_profile(spark, folder):
    wide = p.at_offsets(_panel(spark, folder).select("actor_id", "month", "y"), "actor_id", "month", "y", (-2, -1, 1, 2))
    rows = r.lead_lag_table(wide, ["y"], {-2: "y_hm2", -1: "y_hm1", 1: "y_h1", 2: "y_h2"}, "y", "actor_id", "month", 6)
    return spark.createDataFrame([(h, b, n) for h, b, _, _, n in rows], "h int, beta double, n long")


@query()
def lead_lag_contrast(spark, folder):
    wide = p.at_offsets(_panel(spark, folder).select("actor_id", "month", "y"), "actor_id", "month", "y", (-2, -1, 1, 2))
    row = r.lead_lag_contrast(wide, ["y"], {-2: "y_hm2", -1: "y_hm1", 1: "y_h1", 2: "y_h2"}, "y", "actor_id", "month", 6)
    return spark.createDataFrame([row], "beta double, se double, p double, n long")


@query()
def regime_difference(spark, folder):
    per = _panel(spark, folder).groupBy("month").agg(F.avg("y").alias("y")).orderBy("month").toPandas()
    post = (per.month >= 2021 * 12 + 9).to_numpy()
    waves = (("plain", False, None), ("trend", True, None), ("trend and season", True, per.month.to_numpy(float)))
    rows = [(name, *r.two_group_difference(per.y.to_numpy(), post, 3, trend, months).values()) for name, trend, months in waves]
    return spark.createDataFrame([(n, float(d), float(se), float(pv), int(k)) for n, d, se, pv, k in rows], "model string, difference double, se double, p double, n long")


_NODES = ", ".join(f"({float(x)!r}, {math.log(w)!r}, {math.log(0.15 + 0.75 * x)!r}, {math.log1p(-(0.15 + 0.75 * x))!r})" for x, w in zip(*latent.nodes(32)))


@query(f"""with c as (select coder_1_id, count(*) as n, count(*) filter ({_LAB.format('any_fatalities_mentioned_coder_1')} = 'yes') as k from inter_annotator group by 1), v as (select * from (values {_NODES}) v(t, w, r, s)),
l as (select coder_1_id, n, k, t, w + k * r + (n - k) * s as v from c join v on true), m as (select *, max(v) over (partition by coder_1_id) as top from l)
select coder_1_id, n, k, sum(exp(v - top) * t) / sum(exp(v - top)) as theta from m group by 1, 2, 3""")
def theta_posterior_mean(spark, folder):
    c = table(spark, folder, "inter_annotator").groupBy("coder_1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(t.label_form(F.col("any_fatalities_mentioned_coder_1")) == "yes").alias("k"))
    return c.withColumn("theta", latent.theta_mean(F.col("k"), F.col("n"), 0.15, 0.9, 32))


def _counts(spark, folder) -> latent.Counts:
    """Units are countries: articles as trials, those that tell of an attack as hits, mean tone as outcome, mean scale as covariate."""
    a = table(spark, folder, "articles_raw").where(F.trim(F.coalesce("actiongeo_countrycode", F.lit(""))) != "")
    per = a.groupBy("actiongeo_countrycode").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.lower("text").contains("attack")).alias("n"), F.avg("avgtone").alias("y"), F.avg("goldsteinscale").alias("g"))
    d = per.where("y is not null and g is not null").orderBy("actiongeo_countrycode").toPandas()
    q = np.column_stack([(d.g - d.g.mean()) / max(d.g.std(), 1e-9), np.ones(len(d))])
    tp, fn, fp, tn = _paired_cells(spark, folder)
    return latent.Counts(d.c.to_numpy(float), d.n.to_numpy(float), d.y.to_numpy(float), q, tp + fn, tp, fp + tn, fp)


@query()
def joint_mle(spark, folder):
    c = _counts(spark, folder)
    plain, beta = latent.maximise(c), latent.maximise(c, True)
    lr = 2 * (beta["log_likelihood"] - plain["log_likelihood"])
    rows = [(name, f["gamma"], f["se"], f["log_likelihood"], f["aic"], f["least_eigenvalue"], f["converged"], lr, chi2_tail(lr, 2)) for name, f in (("uniform", plain), ("beta", beta))]
    return spark.createDataFrame(rows, "latent string, gamma double, se double, log_likelihood double, aic double, least_eigenvalue double, converged boolean, lr double, lr_p double")


@query()
def prior_sensitivity(spark, folder):
    """Posterior mean and spread of the signal's coefficient under three priors of the error's deviation."""
    c = _counts(spark, folder)
    parts = [latent.summarise(latent.sample_chains(spark, c, 2, 300, 300, sigma_prior=name)).where("parameter = 0").select(F.lit(name).alias("prior"), "mean", "sd", "low", "high", "r_hat") for name in latent.SIGMA_PRIORS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def joint_sampler(spark, folder):
    return latent.summarise(latent.sample_chains(spark, _counts(spark, folder), chains=4, draws=300, warmup=300))


def _paired_cells(spark, folder) -> tuple[int, int, int, int]:
    """(tp, fn, fp, tn) of the first coder's answer against the second one's, over articles that both coded."""
    forms = [t.label_form(F.col(f"any_fatalities_mentioned_coder_{n}")) for n in (1, 2)]
    pairs = table(spark, folder, "inter_annotator").distinct().select(*[f.alias(n) for f, n in zip(forms, "ab")]).where("a <> '' and b <> ''")
    a, b = F.col("a") == "yes", F.col("b") == "yes"
    return tuple(int(v) for v in pairs.agg(F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b), F.count_if(~a & ~b)).first())


@query()
def validation_bootstrap(spark, folder):
    """Paired labels resampled (their four cells suffice); per replicate the share of deadly events is recalibrated and the panel fitted and corrected again."""
    rates = latent.rate_bootstrap(*_paired_cells(spark, folder), 1000, 20260902)
    blocks = p.block_panel(_events(spark, folder), 2, "2026-01-01").withColumn("log_events", F.log1p("n_events"))
    wide = p.leads_and_lags(blocks, "actor_id", "period_index", "log_fatalities", 1, 1)
    draws = r.validation_draws(wide, "log_fatalities_lead1", "deadly_share", ["log_fatalities", "log_fatalities_lag1", "log_events"], "actor_id", "period_index", rates, 6, "n_events")
    return spark.createDataFrame(r.combined_errors(draws), "estimator string, n long, median double, validation_se double, hac_se double, combined_se double, combined_p double, low double, high double, unstable double")


_ANSWERS = ("yes", "no", "unclear")
_A, _B = _LAB.format("any_fatalities_mentioned_coder_1"), _LAB.format("any_fatalities_mentioned_coder_2")
_CELLS = ", ".join(f"count(*) filter (b = '{x}' and a = '{y}') / count(*) filter (b = '{x}' and a in ('yes', 'no', 'unclear')) as m{i}{j}" for i, x in enumerate(_ANSWERS) for j, y in enumerate(_ANSWERS))


def _minor(i: int, j: int) -> str:
    """Signed minor of the 3 x 3 matrix m without row i and column j, by cyclic indices."""
    r1, r2, c1, c2 = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
    return f"(m{r1}{c1} * m{r2}{c2} - m{r1}{c2} * m{r2}{c1})"


_DET = " + ".join(f"m0{j} * {_minor(0, j)}" for j in range(3))
_FIXED = ", ".join(f"greatest({' + '.join(f's{i} * {_minor(j, i)} / ({_DET})' for i in range(3))}, 0) as f{j}" for j in range(3))


@query(f"""with pairs as (select distinct * from inter_annotator), m as (select {_CELLS} from (select {_A} as a, {_B} as b from pairs) x),
c as (select coding_round, {', '.join(f"avg(case when {_A} = '{x}' then 1.0 else 0.0 end) as s{i}" for i, x in enumerate(_ANSWERS))} from inter_annotator group by 1), f as (select coding_round, {_FIXED} from c, m)
select coding_round, {', '.join(f'f{i} / nullif(f0 + f1 + f2, 0) as {x}_calibrated' for i, x in enumerate(_ANSWERS))} from f""")
def calibrated_multiclass(spark, folder):
    """Shares of the three answers per round, calibrated by the confusion matrix of the two coders (the second one stands for the truth)."""
    forms = [t.label_form(F.col(f"any_fatalities_mentioned_coder_{n}")).alias(c) for n, c in ((1, "a"), (2, "b"))]
    cells = {(x["b"], x["a"]): x["count"] for x in table(spark, folder, "inter_annotator").distinct().select(*forms).groupBy("b", "a").count().collect()}
    inverse = latent.confusion_inverse(np.array([[float(cells.get((x, y), 0)) for y in _ANSWERS] for x in _ANSWERS]))
    lab = t.label_form(F.col("any_fatalities_mentioned_coder_1"))
    c = table(spark, folder, "inter_annotator").groupBy("coding_round").agg(*[F.avg((lab == v).cast("double")).alias(v) for v in ("yes", "no", "unclear")])
    fixed = latent.calibrated_classes([F.col("yes"), F.col("no"), F.col("unclear")], inverse)
    return c.select("coding_round", *[x.alias(f"{n}_calibrated") for x, n in zip(fixed, ("yes", "no", "unclear"))])


@query()
def threshold_sweep(spark, folder):
    base = _sample(spark, folder)
    rows = []
    for least in (0, 1, 2, 4):
        s = r.complete(base, XS, ("n_events", least))
        f = r.fit(s, "y_lead1", XS, "actor_id", "month", 6)
        controls = r.fit(s, "y_lead1", XS[:-1], "actor_id", "month", 6)
        i = f.names.index("deadly") if "deadly" in f.names else None
        rows.append((least, f.n, float(f.beta[i]) if i is not None else None, math.sqrt(max(f.cov[i, i], 0)) if i is not None else None, (controls.sse - f.sse) / controls.sse))
    return spark.createDataFrame(rows, "least_events int, n long, beta double, se double, partial_r2 double")
