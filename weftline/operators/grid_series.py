"""Irregular readings onto a regular grid.

``readings`` cleans event rows, ``period_sums`` adds them up per source and
month, and ``regular_series`` runs a Kalman smoother with a local linear trend
in continuous time over each source's reading months, evaluated at every month
between its first and last reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = "2018-01-01", "2025-12-31"

SERIES_SCHEMA = (
    "actor_id long, month_key string, n_readings long, reading double, is_missing boolean,"
    " level double, level_sd double, trend_per_month double"
)


def event_date(text: Column) -> Column:
    """The day a text notes, or null: ISO with or without time, eight digits, or day.month.year."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$", 1)
    flat = F.regexp_extract(t, r"^(\d{8})$", 1)
    dotted = F.regexp_extract(t, r"^(\d{1,2}\.\d{1,2}\.\d{4})$", 1)
    as_date = lambda c, form: F.to_date(F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(form)))
    return F.coalesce(as_date(iso, "yyyy-MM-dd"), as_date(flat, "yyyyMMdd"), as_date(dotted, "d.M.yyyy"))


def source_number(text: Column) -> Column:
    """An id written as number text (blanks around, ``.0`` behind) as long, else null."""
    return F.regexp_extract(F.trim(text.cast("string")), r"^0*(\d{1,18})(?:\.0*)?$", 1).try_cast("bigint")


def readings(events: DataFrame, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    """Usable readings (actor_id, day, best), one per event id.

    Of rows with the same id only the one with the latest ``loaded_at`` counts
    (rows without a load time lose; among equal load times the greatest row, so
    the choice does not depend on file order). Rows with a null id stand for
    themselves. A row is dropped if its actor, date or count is unusable: no
    number, no real date in ``first``..``last``, or a count that is null, NaN or
    negative. Other columns are ignored. An empty table gives no readings.
    """
    rows = events.select(
        "id",
        F.struct(
            F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"),
            source_number(F.col("side_a_new_id")).alias("actor_id"),
            event_date(F.col("date_start")).alias("day"),
            F.col("best").cast("double").alias("best"),
        ).alias("row"),
    )
    newest = rows.where("id is not null").groupBy("id").agg(F.max("row").alias("row"))
    alone = rows.where("id is null").select("id", "row")
    return newest.unionByName(alone).select("row.*").where(
        F.col("actor_id").isNotNull()
        & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        & (F.col("best") >= 0) & ~F.isnan("best") & (F.col("best") < float("inf"))
    ).select("actor_id", "day", "best")


def period_sums(clean: DataFrame) -> DataFrame:
    """Readings added up to (actor_id, month, total, n); partial sums before the shuffle keep a hot source small."""
    month = (F.year("day") * 12 + F.month("day") - 1).alias("month")
    return clean.groupBy("actor_id", month).agg(F.sum("best").alias("total"), F.count(F.lit(1)).alias("n"))


def _filter_pass(when: np.ndarray, y: np.ndarray, level_var: float, slope_var: float, noise: float):
    """Forward pass over reading times; returns filtered and predicted moments and the log likelihood."""
    n = len(when)
    means, covs, before, before_cov = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    mean, cov, likelihood = np.array([y[0], 0.0]), np.diag([noise + 1.0, 0.25]), 0.0
    for i in range(n):
        if i:
            gap = when[i] - when[i - 1]
            step = np.array([[1.0, gap], [0.0, 1.0]])
            drift = np.array([[level_var * gap + slope_var * gap**3 / 3, slope_var * gap**2 / 2], [slope_var * gap**2 / 2, slope_var * gap]])
            mean, cov = step @ mean, step @ cov @ step.T + drift
        before[i], before_cov[i] = mean, cov
        if not np.isnan(y[i]):
            spread = cov[0, 0] + noise
            gain, off = cov[:, 0] / spread, y[i] - mean[0]
            mean, cov = mean + gain * off, cov - np.outer(gain, cov[0])
            likelihood -= 0.5 * (np.log(spread) + off * off / spread) if i else 0.0
        means[i], covs[i] = mean, cov
    return means, covs, before, before_cov, likelihood


def smooth(when: np.ndarray, y: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, its standard deviation and slope at ``grid``, given readings ``y`` (on log scale) at times ``when``.

    The two drift variances are picked per source by likelihood from a small
    fixed grid of ratios to the noise, the noise from the readings' differences.
    """
    noise = max(float(np.median(np.diff(y) ** 2)) if len(y) > 1 else 1.0, 0.05)
    best = max(
        ((a * noise, b * noise) for a in (0.02, 0.2, 1.0) for b in (1e-5, 1e-3)),
        key=lambda v: _filter_pass(when, y, v[0], v[1], noise)[4],
    )
    at = np.full(len(grid), np.nan)
    at[np.searchsorted(grid, when)] = y
    means, covs, before, before_cov, _ = _filter_pass(grid, at, best[0], best[1], noise)
    for i in range(len(grid) - 2, -1, -1):
        gap = grid[i + 1] - grid[i]
        back = covs[i] @ np.array([[1.0, 0.0], [gap, 1.0]]) @ np.linalg.inv(before_cov[i + 1])
        means[i] = means[i] + back @ (means[i + 1] - before[i + 1])
        covs[i] = covs[i] + back @ (covs[i + 1] - before_cov[i + 1]) @ back.T
    return means[:, 0], np.sqrt(np.maximum(covs[:, 0, 0], 0.0)), means[:, 1]


def _one_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("month")
    months = pdf["month"].to_numpy()
    grid = np.arange(months[0], months[-1] + 1)
    level, sd, slope = smooth(months.astype(float), np.log1p(pdf["total"].to_numpy()), grid.astype(float))
    total = pd.Series(pdf["total"].to_numpy(), index=months).reindex(grid)
    n = pd.Series(pdf["n"].to_numpy(), index=months).reindex(grid).fillna(0).astype("int64")
    return pd.DataFrame({
        "actor_id": np.full(len(grid), pdf["actor_id"].iloc[0]),
        "month_key": [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in grid],
        "n_readings": n.to_numpy(), "reading": total.to_numpy(), "is_missing": total.isna().to_numpy(),
        "level": np.maximum(np.expm1(level), 0.0), "level_sd": sd, "trend_per_month": slope,
    })


def regular_series(events: DataFrame, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    """One row per source and month from its first to its last reading month.

    ``reading`` is the month's sum and null where ``is_missing``; ``level`` is the
    smoothed value on the count scale, ``level_sd`` its standard deviation on the
    log(1+x) scale, ``trend_per_month`` the slope there. A source with one reading
    month has one row; a source with none has no row. The smoother sees at most
    one row per month of ``first``..``last``, however many events a source has.
    """
    return period_sums(readings(events, first, last)).groupBy("actor_id").applyInPandas(_one_source, SERIES_SCHEMA)


def missing_months(series: DataFrame) -> DataFrame:
    """(actor_id, month_key) of the grid months that no reading fills."""
    return series.where("is_missing").select("actor_id", "month_key")
