"""All profile tables of one panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weekcast.operators import audit as a
from weekcast.operators import charts as c
from weekcast.operators import panel as p
from weekcast.operators import seasonality as se
from weekcast.operators.features import feature_snapshot, trailing_mean
from weekcast.operators.segments import segment_series, segment_summary
from weekcast.operators.windows import rolling_windows
from weekcast.plans.build import build_panel
from weekcast.session import cut_lineage
from weekcast.sources.raw import Raw, head


def audit(raw: Raw, level: str = "category") -> dict[str, DataFrame]:
    """Profile tables by name. The panel and the per-series tables are written once."""
    panel = build_panel(raw, level)
    summary = cut_lineage(a.series_summary(panel))
    acf = cut_lineage(a.autocorrelations(panel))
    index = a.seasonal_index(panel)
    weekly = a.category_weekly(panel)
    tables = {
        "summary": summary,
        "dataset_profile": a.dataset_profile(summary, p.raw_counts(raw.sales, raw.items, raw.stores)),
        "data_dictionary": p.data_dictionary(panel),
        "aggregation_comparison": a.frequency_comparison(panel, p.daily_total(raw.sales)),
        "segment_summary": segment_summary(summary),
        "category_summary": a.category_summary(panel, summary, p.items_per_category(raw.items)),
        "category_correlation": a.correlation(weekly),
        "category_growth_correlation": a.correlation(a.log_growth(weekly)),
        "category_seasonal_index": index,
        "seasonality_summary": acf,
        "diagnostic_summary": a.diagnostic_summary(summary, acf),
        "stationarity_summary": se.stationarity(panel),
        "example_feature_snapshot": feature_snapshot(panel, segment_series(panel)),
        "target_histogram": c.target_histogram(panel),
        "summary_histograms": c.summary_histograms(summary),
        "acf_profile": c.acf_profile(acf),
        "seasonal_heatmap": c.seasonal_heatmap(index),
        "segment_counts": c.segment_counts(summary),
        "series_by_category": c.series_by_category(summary),
        "category_totals": c.category_totals(panel),
        "normalised_categories": c.normalised_categories(panel),
        "normalised_top_series": c.normalised_top_series(panel),
        "first_windows": c.first_windows(rolling_windows(panel)),
        "acf": se.acf(panel),
        "pacf": se.pacf(panel),
        "decomposition": se.decompose(panel),
        "trailing_mean": trailing_mean(panel),
        "sales_sample": head(raw.sales, ["item_id", "store_id", "date"], 10),
        "calendar_sample": head(raw.calendar, ["date"], 10),
        "price_sample": head(raw.prices, ["store_id", "item_id", "wm_yr_wk"], 10),
    }
    if level == "sku":
        tables |= {
            "sku_summary": a.sku_ranking(summary),
            "top_skus": c.top_skus(summary),
            "cumulative_share": c.cumulative_share(summary),
            "sku_concentration_summary": a.concentration(panel),
            "sku_share_stability_summary": a.share_stability(panel),
        }
    return tables
