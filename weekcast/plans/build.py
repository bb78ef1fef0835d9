"""Raw tables to a written, dense weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weekcast.operators.panel import attach_price, densify, top_series, weekly_price, weekly_sales
from weekcast.session import cut_lineage
from weekcast.sources.raw import Raw


def build_panel(
    raw: Raw, level: str = "category", series_limit: int | None = None, with_price: bool = True
) -> DataFrame:
    """The raw lines are read once for sales and once for prices; everything after works
    on the written panel."""
    panel = densify(cut_lineage(weekly_sales(raw.sales, raw.items, level)))
    if series_limit is not None:
        panel = top_series(panel, series_limit)
    if with_price:
        panel = attach_price(panel, weekly_price(raw.prices, raw.items, raw.calendar, level))
    return cut_lineage(panel)
