import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from weekcast.session import build_session

    session = build_session(
        "weekcast-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {series: [y0, y1, …]} on consecutive Mondays, or {series: {week_no: y}}."""
    import datetime

    first = datetime.date(2020, 1, 6)

    def build(series, category=None):
        rows = []
        for name, values in series.items():
            items = values.items() if isinstance(values, dict) else enumerate(values)
            for n, y in items:
                week = first + datetime.timedelta(weeks=n)
                rows.append((name, category or name, week, None if y is None else float(y)))
        return spark.createDataFrame(
            rows, "series_id string, category string, week_start date, sales_units double"
        )

    return build
