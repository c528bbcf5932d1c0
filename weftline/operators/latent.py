"""Latent-share models in NumPy: confusion calibration, quadrature likelihood, maximum likelihood, sampling, bootstrap.

Inputs are tables of counts per unit (coder, actor-period), small by design;
chains run as Spark tasks, one each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nodes(n: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def theta_mean(hits: Column, trials: Column, b0: float, b1: float, n: int = 64) -> Column:
    """Posterior mean of a share with a uniform prior, given hits among trials of a classifier with false and true positive rates b0, b1.

    One expression over fixed nodes; logs are taken relative to their largest so that long counts do not underflow.
    """
    x, w = nodes(n)
    rate = b0 + (b1 - b0) * x
    grid = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(math.log(ww)).alias("w"), F.lit(math.log(r)).alias("r"), F.lit(math.log1p(-r)).alias("s")) for t, ww, r in zip(x, w, rate)])
    logs = F.transform(grid, lambda g: F.struct(g["t"].alias("t"), (g["w"] + hits * g["r"] + (trials - hits) * g["s"]).alias("v")))
    top = F.array_max(F.transform(logs, lambda g: g["v"]))
    sums = F.aggregate(logs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, g: F.struct((acc["a"] + F.exp(g["v"] - top) * g["t"]).alias("a"), (acc["b"] + F.exp(g["v"] - top)).alias("b")))
    return sums["a"] / sums["b"]


def confusion_inverse(counts: np.ndarray) -> np.ndarray:
    """Inverse of the row-normalised confusion matrix (rows truth); raises if it has no full rank."""
    rates = counts / counts.sum(axis=1, keepdims=True)
    if np.linalg.matrix_rank(rates) < len(rates):
        raise ValueError("the confusion matrix is singular")
    return np.linalg.inv(rates)


def calibrated_classes(shares: list[Column], inverse: np.ndarray) -> list[Column]:
    """Shares of classes times the inverse confusion matrix, negative ones set to 0, summing to 1 (null if none is left)."""
    k = len(shares)
    raw = [F.greatest(sum((shares[i] * float(inverse[i, j]) for i in range(k)), F.lit(0.0)), F.lit(0.0)) for j in range(k)]
    total = sum(raw, F.lit(0.0))
    return [F.when(total > 0, r / total) for r in raw]


@dataclass
class Counts:
    """Units: trials, hits, outcome, covariates; and validation: positives, true positives, negatives, false positives."""

    trials: np.ndarray
    hits: np.ndarray
    y: np.ndarray
    q: np.ndarray
    positives: int
    true_positives: int
    negatives: int
    false_positives: int

    def __post_init__(self) -> None:
        if (self.hits > self.trials).any() or (self.hits < 0).any():
            raise ValueError("hits must lie between 0 and trials")
        if (self.trials != np.floor(self.trials)).any() or (self.hits != np.floor(self.hits)).any():
            raise ValueError("counts must be whole")


def _inverse_logit(v: float, most: float = 700.0) -> float:
    return 1 / (1 + math.exp(-min(max(v, -most), most)))


def _panels(c: Counts, b0: float, slope: float, off: np.ndarray, gamma: float, sigma: float, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends per unit of the part of (0, 1) that holds nearly all of its share's density: around the mode, which bisection finds, as wide as the curvature there asks for."""
    lo, hi = np.zeros(len(off)), np.ones(len(off))

    def parts(x: np.ndarray) -> tuple[np.ndarray, ...]:
        rate = np.clip(b0 + slope * x, 1e-12, 1 - 1e-12)
        return rate, np.maximum(x, 1e-300), np.maximum(1 - x, 1e-300)

    for _ in range(40):
        x = (lo + hi) / 2
        rate, left, right = parts(x)
        up = slope * (c.hits / rate - (c.trials - c.hits) / (1 - rate)) + gamma * (off - gamma * x) / sigma ** 2 + max(a - 1, 0) / left - max(b - 1, 0) / right > 0
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
    mode = (lo + hi) / 2
    rate, left, right = parts(mode)
    bend = slope ** 2 * (c.hits / rate ** 2 + (c.trials - c.hits) / (1 - rate) ** 2) + (gamma / sigma) ** 2 + max(a - 1, 0) / left ** 2 + max(b - 1, 0) / right ** 2
    wide = 10 / np.sqrt(np.maximum(bend, 1e-12)) + 40 / np.maximum(c.trials * slope, 1e-12)
    return np.clip(mode - wide, 0, 1), np.clip(mode + wide, 0, 1)


def log_likelihood(p: np.ndarray, c: Counts, beta_latent: bool = False, n: int = 64) -> float:
    """Log likelihood with the latent share integrated out, by n nodes around each unit's mode and n on either side of it, however many trials a unit has.

    p = [gamma, alpha.., log sigma, logit b0, logit((b1 - b0) / (1 - b0))] and, for a
    beta latent share, [logit mean, log concentration].
    """
    k = c.q.shape[1]
    gamma, alpha, sigma = p[0], p[1:1 + k], math.exp(min(max(p[1 + k], -20), 20))
    b0 = _inverse_logit(p[2 + k])
    slope = (1 - b0) * _inverse_logit(p[3 + k])
    b1 = b0 + slope
    a = b = 1.0
    if beta_latent:
        mean, size = _inverse_logit(p[4 + k], 30.0), math.exp(min(max(p[5 + k], -12), 12))
        a, b = mean * size, (1 - mean) * size
    part, weight = nodes(n)
    rest = c.y - c.q @ alpha
    low, high = _panels(c, b0, slope, rest, gamma, sigma, a, b)
    ends = np.stack([np.zeros_like(low), low, high, np.ones_like(low)], axis=1)
    wide = np.diff(ends, axis=1)
    x = (ends[:, :-1, None] + wide[:, :, None] * part).reshape(len(low), -1)
    with np.errstate(divide="ignore"):
        prior = np.log(wide[:, :, None] * weight).reshape(len(low), -1)
    rate = np.clip(b0 + slope * x, 1e-12, 1 - 1e-12)
    if beta_latent:
        left, right = np.maximum(x, 1e-300), np.maximum(1 - x, 1e-300)
        prior = prior + (a - 1) * np.log(left) + (b - 1) * np.log(right) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    each = prior + c.hits[:, None] * np.log(rate) + (c.trials - c.hits)[:, None] * np.log1p(-rate) - 0.5 * ((rest[:, None] - gamma * x) / sigma) ** 2 - math.log(sigma)
    top = each.max(1)
    total = float((top + np.log(np.exp(each - top[:, None]).sum(1))).sum())
    valid = lambda k_, n_, r: k_ * math.log(max(r, 1e-12)) + (n_ - k_) * math.log(max(1 - r, 1e-12))
    return total + valid(c.true_positives, c.positives, b1) + valid(c.false_positives, c.negatives, b0)


def _slope(f, p: np.ndarray, h: float = 1e-5) -> np.ndarray:
    return np.array([(f(p + e) - f(p - e)) / (2 * h) for e in np.eye(len(p)) * h])


def _bfgs(f, p: np.ndarray, size: float | None, rounds: int) -> tuple[np.ndarray, float, bool]:
    """(p, f, converged) at a minimum; the first direction is the slope times ``size``, or as long as moves no parameter by more than 1."""
    first = lambda g: np.eye(len(p)) * (size or min(0.01, 1 / max(float(np.abs(g).max()), 1e-12)))
    g = _slope(f, p)
    inverse, now = first(g), f(p)
    for _ in range(rounds):
        step = -inverse @ g
        if g @ step > 0:
            inverse = first(g)
            step = -inverse @ g
        part = 1.0
        while part > 1e-10 and not (new := f(p + part * step)) <= now + 1e-4 * part * (g @ step):
            part /= 2
        if part <= 1e-10:
            return p, now, bool(np.abs(g).max() < 1e-2)
        moved = part * step
        fresh = _slope(f, p + moved)
        dg = fresh - g
        p, g, gain, now = p + moved, fresh, now - new, new
        if (sy := moved @ dg) > 1e-12:
            e = np.eye(len(p)) - np.outer(moved, dg) / sy
            inverse = e @ inverse @ e.T + np.outer(moved, moved) / sy
        if gain < 1e-9 * (1 + abs(now)):
            return p, now, True
    return p, now, False


def maximise(c: Counts, beta_latent: bool = False, n: int = 64, rounds: int = 200) -> dict:
    """Maximum likelihood by BFGS with numeric slopes; errors from the Hessian, with its least eigenvalue as a check."""
    k = c.q.shape[1]
    tpr, fpr = (c.true_positives + 0.5) / (c.positives + 1), (c.false_positives + 0.5) / (c.negatives + 1)
    if tpr <= fpr:
        raise ValueError("the true positive rate must exceed the false positive rate")
    theta = np.clip((c.hits / np.maximum(c.trials, 1) - fpr) / (tpr - fpr), 0, 1)
    start = np.linalg.lstsq(np.column_stack([theta, c.q]), c.y, rcond=None)[0]
    res = c.y - np.column_stack([theta, c.q]) @ start
    logit = lambda v: math.log(v / (1 - v))
    p = np.array([*start, math.log(max(res.std(), 1e-3)), logit(fpr), logit(min(max((tpr - fpr) / (1 - fpr), 1e-4), 1 - 1e-4)), *([0.0, math.log(2)] if beta_latent else [])])
    f = lambda v: -log_likelihood(v, c, beta_latent, n)
    # Slopes grow with the counts: one search starts with short steps, the other with steps of 1 at most, and the better end is kept.
    p, now, converged = min((_bfgs(f, p, size, rounds) for size in (0.01, None)), key=lambda end: end[1])
    h = max(1e-4, (1e-16 * abs(now)) ** 0.25)  # wider where rounding would hide the curvature
    hessian = np.array([(_slope(f, p + e, h) - _slope(f, p - e, h)) / (2 * h) for e in np.eye(len(p)) * h])
    hessian = (hessian + hessian.T) / 2
    least = float(np.linalg.eigvalsh(hessian).min())
    spread = np.linalg.pinv(hessian)[0, 0]
    se = math.sqrt(spread) if spread > 0 else math.nan  # no error where the likelihood is flat in gamma
    return {"gamma": float(p[0]), "se": se, "log_likelihood": -float(now), "parameters": len(p), "least_eigenvalue": least, "converged": converged, "p": p, "aic": 2 * len(p) + 2 * float(now), "k": k, "hessian": hessian}


# Log prior densities of the error's standard deviation, by name, as functions of its log (with the change of variable).
SIGMA_PRIORS = {
    "gamma_1_10": lambda u: u - 10 * math.exp(u),
    "half_normal": lambda u: u - math.exp(2 * u) / 2,
    "gamma_2_2": lambda u: 2 * u - 2 * math.exp(u),
}


def chain(c: Counts, seed: int, draws: int, warmup: int, beta_latent: bool = False, sigma_prior: str = "half_normal") -> np.ndarray:
    """Draws of all parameters by adaptive random-walk Metropolis with weak normal priors, started at the maximum."""
    best = maximise(c, beta_latent)
    rng = np.random.default_rng(seed)
    # The first steps follow the curvature at the maximum, no direction wider than its prior.
    weak = np.array([0.01] * (1 + best["k"]) + [1.0] + [1 / 9] * (len(best["p"]) - 2 - best["k"]))
    bend, axes = np.linalg.eigh(best["hessian"] + np.diag(weak))
    cov = (axes / np.maximum(bend, weak.min())) @ axes.T
    p = best["p"] + 0.5 * rng.multivariate_normal(np.zeros(len(best["p"])), cov)
    prior = lambda v: -0.5 * float((v[0] / 10) ** 2 + ((v[1:1 + best["k"]] / 10) ** 2).sum() + (v[2 + best["k"]:] ** 2 / 9).sum()) + SIGMA_PRIORS[sigma_prior](min(v[1 + best["k"]], 20.0))
    now = log_likelihood(p, c, beta_latent) + prior(p)
    scale, out = 1.0, []
    for i in range(warmup + draws):
        new = p + scale * rng.multivariate_normal(np.zeros(len(p)), cov)
        there = log_likelihood(new, c, beta_latent) + prior(new)
        took = math.log(rng.random()) < there - now
        if took:
            p, now = new, there
        out.append(p.copy())
        if i < warmup:
            scale *= math.exp((took - 0.25) / math.sqrt(i + 1))
            if i >= 100 and i % 50 == 0:
                cov = np.cov(np.array(out[i // 2:]).T) + 1e-9 * np.eye(len(p))
    return np.array(out[warmup:])


def sample_chains(spark: SparkSession, c: Counts, chains: int = 4, draws: int = 500, warmup: int = 500, beta_latent: bool = False, sigma_prior: str = "half_normal") -> DataFrame:
    """(chain, draw, parameter, value): one Spark task per chain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = chain(c, 7_919 * (1 + int(pdf["chain"].iloc[0])), draws, warmup, beta_latent, sigma_prior)
        n, k = made.shape
        return pd.DataFrame({"chain": int(pdf["chain"].iloc[0]), "draw": np.repeat(np.arange(n), k), "parameter": np.tile(np.arange(k), n), "value": made.ravel()})

    return spark.range(chains).withColumnRenamed("id", "chain").repartition(chains, "chain").groupBy("chain").applyInPandas(run, "chain long, draw long, parameter long, value double")


def summarise(draws: DataFrame) -> DataFrame:
    """Per parameter: mean, sd, median, 95 % interval, share of draws beyond 0 (two-sided), split r-hat and effective draws from chain means."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    half = draws.withColumn("half", (F.col("draw") >= F.max("draw").over(Window.partitionBy("chain", "parameter")) / 2).cast("int"))
    parts = half.groupBy("parameter", "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n"))
    mix = parts.groupBy("parameter").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    total = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    shape = mix.select("parameter", F.sqrt(total / F.col("w")).alias("r_hat"), F.least(F.col("parts") * F.col("n"), F.col("parts") * F.try_divide(total, F.col("b"))).alias("n_eff"))
    main = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("above"))
    return main.join(shape, "parameter").select("parameter", "mean", "sd", F.col("q")[1].alias("median"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"), (2 * F.least("above", 1 - F.col("above"))).alias("tail"), "r_hat", "n_eff")


def rate_bootstrap(tp: int, fn: int, fp: int, tn: int, replicates: int, seed: int) -> np.ndarray:
    """(tpr, fpr) of each replicate by resampling the four cells; replicates without a class or with tpr <= fpr are null."""
    rng = np.random.default_rng(seed)
    n = tp + fn + fp + tn
    cells = rng.multinomial(n, np.array([tp, fn, fp, tn]) / n, size=replicates).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        tpr, fpr = cells[:, 0] / (cells[:, 0] + cells[:, 1]), cells[:, 2] / (cells[:, 2] + cells[:, 3])
    bad = ~(tpr > fpr)
    return np.column_stack([np.where(bad, np.nan, tpr), np.where(bad, np.nan, fpr)])


def cluster_bootstrap(sse_a: np.ndarray, sse_b: np.ndarray, n: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Difference of root mean squared errors of two models when whole periods are drawn again."""
    rng = np.random.default_rng(seed)
    picks = rng.multinomial(len(n), np.full(len(n), 1 / len(n)), size=replicates)
    return np.sqrt(picks @ sse_a / (picks @ n)) - np.sqrt(picks @ sse_b / (picks @ n))
