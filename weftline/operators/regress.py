"""Panel regression by aggregates: Gram matrices and score products in Spark, k x k solves on the driver.

What reaches the driver has the size of the design (k x k), of the lags, or of
the periods, never of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.maths import chi2_tail, two_sided_p


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    sse: float
    sst: float
    gram: np.ndarray
    diagnostics: dict[str, float] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return [(n, float(b), float(s), float(b / s) if s else math.nan, two_sided_p(b / s) if s else math.nan, float(b - 1.96 * s), float(b + 1.96 * s)) for n, b, s in zip(self.names, self.beta, se)]


def complete(df: DataFrame, columns: Sequence[str], least: tuple[str, int] | None = None) -> DataFrame:
    """Rows with all the columns given and finite, and with at least so many of a count."""
    ok = df if least is None else df.where(F.col(least[0]) >= least[1])
    for c in columns:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    return ok


def demeaned(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns less their mean per key (fixed effects)."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(means, list(keys))
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of columns and an intercept (last), from one aggregate."""
    cols = [F.col(c).cast("double") for c in columns] + [F.lit(1.0)]
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g, at = np.zeros((k, k)), iter(row)
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = next(at) or 0.0
    return g, int(round(g[-1, -1]))


def hac_meat(df: DataFrame, names: Sequence[str], intercept: bool, beta: np.ndarray, y: str, key: str, period: str, lags: int) -> np.ndarray:
    """Bartlett-weighted sums of score products within a key; pairs are exactly l periods apart, gaps are skipped."""
    xs = [F.col(c).cast("double") for c in names] + ([F.lit(1.0)] if intercept else [])
    e = F.col(y).cast("double") - sum((float(b) * x for b, x in zip(beta, xs)), F.lit(0.0))
    scores = df.select(F.col(key).alias("k"), F.col(period).cast("long").alias("t"), F.array(*[x * e for x in xs]).alias("s"))
    pairs = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select("k", (F.col("t") - F.col("lag")).alias("t"), "lag", "s").join(scores.withColumnRenamed("s", "p"), ["k", "t"])
    n = len(xs)
    cells = pairs.groupBy("lag").agg(*[F.sum(F.col("s")[i] * F.col("p")[j]) for i in range(n) for j in range(n)]).collect()
    meat = np.zeros((n, n))
    for row in cells:
        g = np.array(row[1:], float).reshape(n, n)
        meat += g if row[0] == 0 else (1 - row[0] / (lags + 1)) * (g + g.T)
    return meat


def fit(df: DataFrame, y: str, xs: Sequence[str], key: str, period: str, lags: int = 6, intercept: bool = True, signals: Sequence[str] = ()) -> Fit:
    """OLS with key-wise HAC errors; columns without variance are dropped. ``df`` must have no missing values in its columns."""
    g, n = gram(df, [*xs, y])
    k = len(xs)
    spread = np.diag(g)[:k] / max(n, 1) - (g[:k, -1] / max(n, 1)) ** 2
    kept = [i for i in range(k) if spread[i] > 1e-12] if intercept else list(range(k))
    at = kept + ([k + 1] if intercept else [])
    names = [xs[i] for i in kept]
    xx, xy, yy = g[np.ix_(at, at)], g[at, k], g[k, k]
    bread = np.linalg.pinv(xx)
    beta = bread @ xy
    sse = float(yy - beta @ xy)
    mean = g[k, -1] / max(n, 1)
    meat = hac_meat(df, names, intercept, beta, y, key, period, lags)
    p = len(at)
    cov = bread @ meat @ bread * (n / (n - p)) if n > p else np.full((p, p), np.nan)
    out = Fit(names + (["intercept"] if intercept else []), beta, cov, n, sse, float(yy - n * mean**2) if intercept else float(yy), xx)
    out.diagnostics = {"n": n, "r2": 1 - sse / out.sst if out.sst > 0 else math.nan, "rmse": math.sqrt(max(sse, 0) / n) if n else math.nan,
                       "condition": float(np.linalg.cond(xx)) if p else math.nan, "rank": int(np.linalg.matrix_rank(xx))}
    out.diagnostics["adjusted_r2"] = 1 - (1 - out.diagnostics["r2"]) * (n - 1) / (n - p) if n > p else math.nan
    tested = [i for i, c in enumerate(names) if c in signals]
    if tested:
        v = cov[np.ix_(tested, tested)]
        wald = float(beta[tested] @ np.linalg.pinv(v) @ beta[tested])
        out.diagnostics |= {"wald": wald, "wald_p": chi2_tail(wald, len(tested))}
    return out


def vifs(f: Fit) -> dict[str, float]:
    """Variance inflation of each regressor from blocks of the Gram matrix, without another scan."""
    k = len(f.names) - (f.names[-1] == "intercept")
    out = {}
    for i in range(k):
        rest = [j for j in range(len(f.names)) if j != i]
        sub, cross = f.gram[np.ix_(rest, rest)], f.gram[rest, i]
        unexplained = f.gram[i, i] - cross @ np.linalg.pinv(sub) @ cross
        centre = f.gram[i, i] - f.gram[i, -1] ** 2 / f.gram[-1, -1] if f.names[-1] == "intercept" else f.gram[i, i]
        out[f.names[i]] = float(centre / unexplained) if unexplained > 1e-12 else math.inf
    return out


def residual_ar1(df: DataFrame, f: Fit, y: str, key: str, period: str) -> float:
    """Mean over keys of the correlation of a fit's residuals with the residuals before them (keys of more than two pairs)."""
    e = F.col(y).cast("double") - sum((float(b) * (F.lit(1.0) if c == "intercept" else F.col(c).cast("double")) for c, b in zip(f.names, f.beta)), F.lit(0.0))
    pairs = df.select(key, e.alias("a"), F.lag(e).over(Window.partitionBy(key).orderBy(period)).alias("b")).where("b is not null")
    each = pairs.groupBy(key).agg(F.corr("a", "b").alias("ar1"), F.count(F.lit(1)).alias("n")).where("n > 2 and not isnan(ar1)")
    got = each.agg(F.avg("ar1")).first()[0]
    return math.nan if got is None else got


def corrected(f: Fit, signal: str, omega: float, kappa: float) -> dict[str, float]:
    """Additive (bca) and multiplicative (bcm) correction of one signal's coefficient for the variance ``omega`` of its error."""
    return corrected_classes(f, [signal], np.array([[omega]]), kappa)[signal]


def corrected_classes(f: Fit, signals: Sequence[str], omega: np.ndarray, kappa: float) -> dict[str, dict[str, float]]:
    """``corrected`` of several signals together, given the covariance ``omega`` of their errors."""
    n, at = f.n, [f.names.index(s) for s in signals]
    block = np.zeros_like(f.gram)
    block[np.ix_(at, at)] = omega
    a = kappa / math.sqrt(n) * np.linalg.pinv(f.gram / n) @ block
    eye = np.eye(len(f.beta))
    size = float(np.abs(np.linalg.eigvals(a)).max())
    bca = (eye + a) @ f.beta
    bcm = np.linalg.solve(eye - a, f.beta) if size < 1 and abs(np.linalg.det(eye - a)) > 1e-12 else np.full(len(f.beta), math.nan)
    return {s: {"naive": float(f.beta[i]), "bca": float(bca[i]), "bcm": float(bcm[i]), "se": float(math.sqrt(max(f.cov[i, i], 0))), "largest_eigenvalue": size} for s, i in zip(signals, at)}


def index_omega(mean_theta: float, mean_square: float, tpr: float, fpr: float) -> float:
    """Variance that classification adds to a calibrated share: raw variance of one article's corrected label less that of the share, floor 0."""
    gap = tpr - fpr
    raw = fpr + gap * mean_theta
    return max(0.0, (raw * (1 - 2 * fpr) + fpr**2) / gap**2 - mean_square)


def classes_omega(means: np.ndarray, squares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """``index_omega`` of several classes without the last: ``means`` of the calibrated shares, ``squares`` the means of their products,
    ``rates`` the row-normalised confusion matrix (rows truth); negative eigenvalues are set to 0. Of two classes it is ``index_omega``: the original workflow multiplies by the rates
    once more (M-10, M-11), which is no variance of the corrected label."""
    left = np.linalg.pinv(rates @ rates.T) @ rates
    full = (left @ np.diag(rates.T @ means) @ left.T - squares)[:-1, :-1]
    values, vectors = np.linalg.eigh((full + full.T) / 2)
    return vectors @ np.diag(np.maximum(values, 0)) @ vectors.T


def count_kappa(df: DataFrame, count: str) -> float:
    """Sum of 1 / count over rows, by the root of the rows."""
    row = df.agg(F.sum(1.0 / F.col(count)), F.count(F.lit(1))).first()
    return (row[0] or 0.0) / math.sqrt(row[1]) if row[1] else math.nan


def _fixed_shares(raw: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Calibrated shares, one row for each (tpr, fpr)."""
    return np.clip((raw[None] - rates[:, 1:]) / (rates[:, :1] - rates[:, 1:]), 0, 1)


def validation_draws(df: DataFrame, y: str, signal: str, controls: Sequence[str], key: str, period: str, rates: np.ndarray, lags: int, count: str) -> list[dict[str, float]]:
    """Per (tpr, fpr): ``corrected`` of the fit with ``signal``, a raw share, calibrated by these rates. Rates that are not finite give no draw.

    Sums of products of all replicates come from one pass, their HAC meats from a second one over each key's series.
    """
    rates = rates[np.isfinite(rates).all(1)]
    sample = complete(df, [y, signal, *controls], (count, 1)).select(key, F.col(period).cast("long").alias(period), *[F.col(c).cast("double").alias(c) for c in (signal, *controls, y)], count)
    g, n = gram(sample, [*controls, y])
    k = len(controls)
    keep = [i for i in range(k) if g[i, i] / max(n, 1) - (g[i, -1] / max(n, 1)) ** 2 > 1e-12]
    if not n or not len(rates):
        return []
    xs, at = [controls[i] for i in keep], [*keep, k + 1]
    p = len(at) + 1
    design = lambda pdf: np.column_stack([*[pdf[c].to_numpy(float) for c in xs], np.ones(len(pdf))])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(rates), p + 1))
        for pdf in batches:
            c = _fixed_shares(pdf[signal].to_numpy(float), rates)
            total += np.column_stack([(c * c).sum(1), c @ design(pdf), c @ pdf[y].to_numpy(float)])
        yield pd.DataFrame(total, columns=[f"s{i}" for i in range(p + 1)]).assign(r=np.arange(len(rates)))

    def added(parts: DataFrame, width: int) -> np.ndarray:
        rows = parts.groupBy("r").agg(*[F.sum(f"s{i}") for i in range(width)]).collect()
        return np.array([row[1:] for row in sorted(rows, key=lambda row: row[0])], float)

    schema = lambda width: ", ".join(f"s{i} double" for i in range(width)) + ", r long"
    s = added(sample.mapInPandas(sums, schema(p + 1)), p + 1)
    grams = np.empty((len(rates), p, p))
    grams[:, 0, 0], grams[:, 0, 1:], grams[:, 1:, 0], grams[:, 1:, 1:] = s[:, 0], s[:, 1:p], s[:, 1:p], g[np.ix_(at, at)]
    bread = np.linalg.pinv(grams)
    xy = np.column_stack([s[:, p], np.tile(g[at, k], (len(rates), 1))])
    betas = (bread @ xy[:, :, None])[:, :, 0]

    def meat(pdf: pd.DataFrame) -> pd.DataFrame:
        c, x, t = _fixed_shares(pdf[signal].to_numpy(float), rates), design(pdf), pdf[period].to_numpy()
        e = pdf[y].to_numpy(float) - c * betas[:, :1] - betas[:, 1:] @ x.T
        scores = np.zeros((len(rates), int(t.max() - t.min()) + 1, p))  # zero in gaps
        scores[:, t - t.min()] = np.concatenate([(c * e)[:, :, None], e[:, :, None] * x[None]], 2)
        total = scores.transpose(0, 2, 1) @ scores
        for lag in range(1, min(lags, scores.shape[1] - 1) + 1):
            m = scores[:, lag:].transpose(0, 2, 1) @ scores[:, :-lag]
            total += (1 - lag / (lags + 1)) * (m + m.transpose(0, 2, 1))
        return pd.DataFrame(total.reshape(len(rates), p * p), columns=[f"s{i}" for i in range(p * p)]).assign(r=np.arange(len(rates)))

    meats = added(sample.groupBy(key).applyInPandas(meat, schema(p * p)), p * p).reshape(-1, p, p)
    kappa, out = count_kappa(sample, count), []
    for r, (tpr, fpr) in enumerate(rates):
        mean, square = s[r, p - 1] / n, s[r, 0] / n
        if square - mean**2 <= 1e-12 or n <= p:
            continue
        sse = float(g[k, k] - betas[r] @ xy[r])
        f = Fit([signal, *xs, "intercept"], betas[r], bread[r] @ meats[r] @ bread[r] * (n / (n - p)), n, sse, float(g[k, k] - g[k, -1] ** 2 / n), grams[r])
        out.append(corrected(f, signal, index_omega(mean, square, tpr, fpr), kappa))
    return out


def combined_errors(draws: Sequence[dict[str, float]]) -> list[tuple]:
    """(estimator, n, median, validation_se, hac_se, combined_se, p, low, high, unstable): the error of validation joins the HAC error of the fit.

    An estimator with fewer than two draws has no figures; ``unstable`` is the share of draws whose correction has no multiplicative form.
    """
    out, unstable = [], float(np.mean([d["largest_eigenvalue"] >= 1 for d in draws])) if draws else math.nan
    for name, label in (("naive", "calibrated"), ("bca", "bca"), ("bcm", "bcm")):
        got = [(d[name], d["se"]) for d in draws if math.isfinite(d[name])]
        if len(got) < 2:
            out.append((label, len(got), *[math.nan] * 7, unstable))
            continue
        b, se = np.array(got).T
        point, spread, hac = float(np.median(b)), float(b.std(ddof=1)), float(np.median(se))
        both = math.hypot(hac, spread)
        out.append((label, len(b), point, spread, hac, both, two_sided_p(point / both) if both else math.nan, float(np.quantile(b, 0.025)), float(np.quantile(b, 0.975)), unstable))
    return out


def rolling_forecasts(df: DataFrame, y: str, xs: Sequence[str], period: str, least: int = 60) -> DataFrame:
    """(period, n, sse, sae), squared and absolute errors: each period predicted from strictly earlier rows. Gram matrices are summed per period; their running sums and solves are on the driver."""
    columns = [*xs, y]
    cols = [F.col(c).cast("double") for c in columns] + [F.lit(1.0)]
    k = len(cols)
    per = df.groupBy(F.col(period).alias("t")).agg(*[F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)]).collect()
    total, betas = np.zeros((k, k)), []
    at = [*range(len(xs)), k - 1]
    for row in sorted(per, key=lambda r: r[0]):
        if total[-1, -1] >= least:
            betas.append((row[0], [float(b) for b in np.linalg.pinv(total[np.ix_(at, at)]) @ total[at, len(xs)]]))
        total += np.array(row[1:], float).reshape(k, k)
    table = F.broadcast(df.sparkSession.createDataFrame(betas, "t long, b array<double>"))
    guess = sum((F.col("b")[i] * F.col(c) for i, c in enumerate(xs)), F.col("b")[len(xs)])
    return df.join(table, F.col(period) == F.col("t")).groupBy(F.col("t").alias(period)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y) - guess) ** 2).alias("sse"), F.sum(F.abs(F.col(y) - guess)).alias("sae"))


def lead_lag_table(df: DataFrame, xs: Sequence[str], outcomes: dict[int, str], signal: str, key: str, period: str, lags: int) -> list[tuple]:
    """(horizon, beta, se, p, n) of a signal on the outcome at each horizon over the same complete rows."""
    sample = complete(df, [*xs, *outcomes.values()])
    out = []
    for h, y in sorted(outcomes.items()):
        f = fit(sample, y, xs, key, period, lags)
        i = f.names.index(signal)
        se = math.sqrt(max(f.cov[i, i], 0))
        out.append((h, float(f.beta[i]), se, two_sided_p(f.beta[i] / se) if se else math.nan, f.n))
    return out


def lead_lag_contrast(df: DataFrame, xs: Sequence[str], outcomes: dict[int, str], signal: str, key: str, period: str, lags: int, horizon: int = 1) -> tuple[float, float, float, int]:
    """(beta, se, p, n) of a signal on the outcome ``horizon`` ahead less the one as far behind, over the rows of ``lead_lag_table``."""
    sample = complete(df, [*xs, *outcomes.values()]).withColumn("_contrast", F.col(outcomes[horizon]) - F.col(outcomes[-horizon]))
    return lead_lag_table(sample, xs, {0: "_contrast"}, signal, key, period, lags)[0][1:]


def two_group_difference(values: np.ndarray, post: np.ndarray, lags: int = 3, trend: bool = False, months: np.ndarray | None = None) -> dict[str, float]:
    """Difference of a single series' mean after a cut, with positional HAC errors (lag at most n - 1), optionally net of a linear trend and, given the ``months``, of a yearly wave."""
    n = len(values)
    x = np.column_stack([post.astype(float), np.ones(n), *([np.arange(n) / max(n - 1, 1)] if trend else []),
                         *([] if months is None else [np.sin(2 * math.pi * months / 12), np.cos(2 * math.pi * months / 12)])])
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ values
    s = x * (values - x @ beta)[:, None]
    meat, most = s.T @ s, min(lags, n - 1)
    for lag in range(1, most + 1):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / (most + 1)) * (g + g.T)
    cov = bread @ meat @ bread * (n / (n - x.shape[1])) if n > x.shape[1] else np.full((x.shape[1],) * 2, np.nan)
    se = math.sqrt(max(cov[0, 0], 0)) if np.isfinite(cov[0, 0]) else math.nan
    return {"difference": float(beta[0]), "se": se, "p": two_sided_p(beta[0] / se) if se else math.nan, "n": n}


def lagged_correlation(panel: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, ar1): first-order autocorrelation per key."""
    w = Window.partitionBy(key).orderBy(order)
    return panel.select(key, F.col(column).alias("a"), F.lag(column).over(w).alias("b")).groupBy(key).agg(F.corr("a", "b").alias("ar1"))
