"""All core queries with the SQL they are checked against.

Both sides of a checked query give doubles to six decimals, null for NaN, and
whole numbers as long where SQL counts in them, so that rows can be compared by
value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import acquire, actors, extras, models, panels, series, streams, study, texts

Query = Callable[[SparkSession, str], DataFrame]

# Double columns of the checked queries.
DOUBLES = {
    "country_week_panel": "mean_tone median_scale rebel_share", "url_candidates_ranked": "candidate_score", "failure_counts": "share", "scrape_summary": "success_rate", "match_sources": "share",
    "mention_sources": "total_tone", "text_clean_features": "boilerplate_ratio", "language_summary": "mean_chars share", "actor_summary": "share", "balanced_grid_panel": "fatalities deadly_share log_fatalities",
    "panel_lead_lag": "y y_lead1 y_lag1 y_lag2", "history_bins": "y_bin0 y_bin1", "offset_profile": "y y_hm2 y_hm1 y_h1 y_h2", "risk_set_fallback": "fatalities", "temporal_identity_join": "best",
    "representative_regions": "latitude longitude", "weighted_label_shares": "weight share_fatal share_weapon share_relevance_direct share_relevance_irrelevant", "kappa_multiclass": "agreement kappa",
    "confusion_and_metrics": "precision recall f1 accuracy kappa fpr", "calibrated_share": "raw_share calibrated_share wilson_low wilson_high", "fdr_bh": "p p_fdr", "spearman_by_actor": "spearman",
    "acf_by_actor": "acf", "regime_summary": "positive_share clear_share unresolved_share", "category_divergence": "js_distance max_change_pp",
    "sample_summary": "median_fatalities least most sd q025 q975 zero_share", "centered_mean": "smooth", "ols_hac_univariate": "beta se", "rolling_forecast": "sse", "lead_lag_profile": "beta",
    "near_duplicate_pairs": "similarity", "duplicate_pair_export": "similarity", "theta_posterior_mean": "theta", "ar1_by_actor": "ar1", "signal_correlation": "r", "joint_state_confusion": "row_share", "label_comparison": "share", "p5_readings": "total", "incremental_blocks": "total",
    "window_threshold_sweep": "raw_beta calibrated_beta partial_r2 bca_beta bcm_beta ten_point_effect", "fdr_families": "p p_fdr_within p_fdr_across", "calibrated_multiclass": "yes_calibrated no_calibrated unclear_calibrated",
}
# Columns that SQL counts as long.
LONGS = {
    "country_week_panel": "iso_week", "topk_mentions_per_event": "candidate_rank", "url_candidates_ranked": "candidate_rank", "domain_diverse_rank": "diverse_rank", "scrape_summary": "n_attempts",
    "text_clean_features": "text_len word_count sentence_count n_tokens", "actor_terms": "term_len", "rolling_forecast": "month", "language_detect": "n_chars",
}


def settled(f: Query, doubles: tuple[str, ...], longs: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = f(spark, folder)
        return df.withColumns({c: F.when(~F.isnan(c), F.round(c, 6) + 0.0) for c in doubles} | {c: F.col(c).cast("long") for c in longs})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def settled_sql(sql: str, doubles: tuple[str, ...], longs: tuple[str, ...]) -> str:
    parts = [f"case when isnan({c}) then null else round({c}, 6) + 0.0 end as {c}" for c in doubles] + [f"cast({c} as bigint) as {c}" for c in longs]
    return f"select * replace ({', '.join(parts)}) from ({sql}) as checked" if parts else sql


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (acquire, texts, actors, panels, models, series, extras, streams, study):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
for _name in ORACLE_SQL:
    _doubles, _longs = tuple(DOUBLES.get(_name, "").split()), tuple(LONGS.get(_name, "").split())
    if _doubles or _longs:
        QUERIES[_name] = settled(QUERIES[_name], _doubles, _longs)
        ORACLE_SQL[_name] = settled_sql(ORACLE_SQL[_name], _doubles, _longs)
