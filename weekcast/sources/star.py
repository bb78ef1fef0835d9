"""The raw tables taken from a star schema of order lines, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.columns import monday, plus_weeks
from weekcast.sources.raw import Raw

# Fixed value: the Saturday from which retail weeks are counted.
RETAIL_WEEK_ZERO = "1994-12-31"


def retail_week(date: str) -> F.Column:
    return F.floor(F.datediff(F.col(date), F.lit(RETAIL_WEEK_ZERO).cast("date")) / 7).cast("int")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_raw(spark: SparkSession, sf_dir: str, category: str = "p_type") -> Raw:
    """Item = part, store = supplier, units = quantity on the ship date."""
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_brand").alias("dept_id"),
        F.col(category).alias("cat_id"),
    )
    suppliers = _table(spark, sf_dir, "supplier").join(
        _table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    span = lines.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.select(
        F.posexplode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("n", "date")
    ).select(
        F.concat(F.lit("d_"), F.col("n") + 1).alias("d"),
        "date",
        retail_week("date").alias("wm_yr_wk"),
    )
    prices = lines.groupBy("store_id", "item_id", retail_week("date").alias("wm_yr_wk")).agg(
        F.avg("unit_price").alias("sell_price")
    )
    return Raw(
        sales=lines.drop("unit_price"),
        items=parts,
        stores=suppliers.select(
            F.col("s_suppkey").cast("string").alias("store_id"), F.col("n_name").alias("state_id")
        ),
        calendar=calendar,
        prices=prices,
    )


def star_wide(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """A wide daily extract of the first ``days`` days, zero-filled, with a row for every
    item and store that ever sells."""
    raw = star_raw(spark, sf_dir)
    names = [f"d_{n}" for n in range(1, days + 1)]
    first = raw.sales.agg(F.min("date")).scalar()
    day = F.datediff(F.col("date"), F.col("_first")) + 1
    return (
        raw.sales.withColumn("_first", first)
        .withColumn("d", F.concat(F.lit("d_"), day))
        .groupBy("item_id", "store_id")
        .agg(*[F.coalesce(F.sum(F.when(F.col("d") == n, F.col("units"))), F.lit(0)).alias(n) for n in names])
        .join(raw.items, "item_id")
        .join(raw.stores, "store_id")
        .select("item_id", "dept_id", "cat_id", "store_id", "state_id", *names)
    )


def star_wide_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide daily layout of the whole period at category grain, zero-filled."""
    raw = star_raw(spark, sf_dir)
    daily = raw.sales.groupBy("item_id", "date").agg(F.sum("units").alias("units")).join(raw.items, "item_id")
    daily = daily.groupBy("cat_id", "date").agg(F.sum("units").alias("units"))
    # One column, and one row here, per day of the calendar.
    names = [r["d"] for r in raw.calendar.orderBy("date").collect()]
    wide = daily.join(F.broadcast(raw.calendar), "date").groupBy("cat_id").pivot("d", names)
    return wide.agg(F.sum("units")).na.fill(0, names)


def star_scenarios(spark: SparkSession, sf_dir: str, future_weeks: int = 8) -> DataFrame:
    """A dense scenario panel: scenario = return flag, series = brand, category = type.

    A brand spans several types here, so the series is the brand within the type.
    """
    from weekcast.operators.panel import densify

    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("scenario_name"),
        monday(F.to_date("l_shipdate")).alias("week_start"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_discount") >= 0.05).cast("double").alias("promo"),
        F.col("l_discount").alias("discount"),
    )
    per_part = lines.groupBy("part", "scenario_name", "week_start").agg(
        F.sum("units").alias("units"),
        F.sum("price").alias("price"),
        F.max("promo").alias("promo"),
        F.max("discount").alias("discount"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), "p_brand", F.col("p_type").alias("category")
    )
    keys = ["scenario_name", "series_id", "category", "week_start"]
    weekly = (
        per_part.join(parts, "part")
        .withColumn("series_id", F.concat_ws("/", "p_brand", "category"))
        .groupBy(*keys)
        .agg(
            F.sum("units").alias("sales_units"),
            (F.sum("price") / F.sum("n")).alias("price"),
            F.max("promo").alias("promo_planned"),
            F.max("discount").alias("discount_depth"),
        )
    )
    dense = densify(
        weekly.select(
            *keys, "sales_units", "promo_planned", "discount_depth", F.col("price").alias("price")
        ),
        keys=("scenario_name", "series_id"),
        fill={"sales_units": 0.0, "promo_planned": 0.0, "discount_depth": 0.0, "price": None},
    )
    last = weekly.agg(F.max("week_start")).scalar()
    return dense.withColumn("_last", last).select(
        "scenario_name",
        "series_id",
        "category",
        "week_start",
        (F.col("week_start") <= plus_weeks("_last", -future_weeks)).alias("is_history"),
        "sales_units",
        "price",
        "promo_planned",
        "discount_depth",
        F.lit(True).alias("price_known_in_advance"),
        F.lit("sales_units").alias("target_name"),
    )
