"""python -m weftline quick|full --data FOLDER --out FOLDER: write the panel and model tables of a data folder."""

from __future__ import annotations

import argparse
import time

from weftline.plans import catalogue
from weftline.session import local_session
from weftline.sources import writers

QUICK = ("country_week_panel", "balanced_grid_panel", "panel_lead_lag", "weighted_label_shares", "ols_hac_panel", "ols_diagnostics")
FULL = (*QUICK, "url_candidates_ranked", "strict_matches", "near_duplicate_classes", "p5_series", "rolling_forecast", "forecast_uncertainty", "threshold_sweep", "bca_bcm",
        "validation_bootstrap", "joint_mle", "joint_sampler", "lead_lag_profile", "regime_summary", "category_divergence")


def main() -> None:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("what", choices=("quick", "full"))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--cores", default="*")
    given = parser.parse_args()
    spark = local_session(given.cores)
    took = {}
    for name in QUICK if given.what == "quick" else FULL:
        began = time.time()
        catalogue.QUERIES[name](spark, given.data).write.mode("overwrite").parquet(f"{given.out}/{name}.parquet")
        took[name] = round(time.time() - began, 2)
    writers.run_notes(f"{given.out}/run.json", seconds=took, spark=spark.version, data=given.data)


if __name__ == "__main__":
    main()
