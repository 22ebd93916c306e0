"""Delivery operators: enrichment (E8), filter (F3) and the logistics KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import date_in_range, guarded_ratio, whole_days

ALL = "All"
# The pipeline stages shown, in display order.
PIPELINE_STATUSES = ("Pending", "Shipped", "Delivered", "Failed")


def _as_ts(df: DataFrame, c: str):
    return F.to_timestamp_ntz(F.col(c)) if dict(df.dtypes).get(c) == "string" else F.col(c)


def enrich_deliveries(deliveries: DataFrame) -> DataFrame:
    """Calendar ``date`` of the order, whole ``delivery_time_days`` (null
    when not delivered, may be negative) and ``on_time`` (null date -> False)."""
    keep = [c for c in deliveries.columns if c not in ("date", "delivery_time_days", "on_time")]
    od = _as_ts(deliveries, "orderdate")
    ad = _as_ts(deliveries, "actualdeliverydate")
    pd_ = _as_ts(deliveries, "promiseddate")
    return deliveries.select(
        *keep,
        F.to_date(od).alias("date"),
        whole_days(od, ad).alias("delivery_time_days"),
        F.coalesce(ad <= pd_, F.lit(False)).alias("on_time"),
    )


def filter_deliveries(deliveries: DataFrame, start=None, end=None, partner: str = ALL) -> DataFrame:
    """inclusive date range on the order date and optional partner ('All' = any)."""
    out = deliveries.where(date_in_range("date", start, end))
    if partner is not None and partner != ALL:
        out = out.where(F.col("deliverypartner") == F.lit(partner))
    return out


def delivery_kpis(deliveries: DataFrame) -> DataFrame:
    """A10-A12 as one row: on-time % and failed % over *all* rows (undelivered
    counts as late), mean delivery days and mean cost (nulls skipped)."""
    agg = deliveries.agg(
        F.count(F.lit(1)).cast("bigint").alias("row_count"),
        F.count_if(F.col("on_time")).cast("bigint").alias("on_time_count"),
        F.count_if(F.col("status") == "Failed").cast("bigint").alias("failed_count"),
        F.sum("delivery_time_days").alias("days_sum"),
        F.count("delivery_time_days").alias("days_n"),
        F.sum("deliverycost").alias("cost_sum"),
        F.count("deliverycost").alias("cost_n"),
    )
    n = F.col("row_count")
    empty = n == 0
    return agg.select(
        "row_count",
        F.when(~empty, guarded_ratio("on_time_count", n, 100.0)).alias("on_time_rate"),
        F.when(~empty, guarded_ratio("failed_count", n, 100.0)).alias("failed_rate"),
        (F.col("days_sum").cast("double") / F.when(F.col("days_n") > 0, F.col("days_n").cast("double")))
        .alias("avg_delivery_days"),
        (F.col("cost_sum").cast("double") / F.when(F.col("cost_n") > 0, F.col("cost_n").cast("double")))
        .alias("avg_delivery_cost"),
    )


def delivery_pipeline(deliveries: DataFrame, statuses=PIPELINE_STATUSES) -> DataFrame:
    """One row per listed status, in list order, 0 when absent; other
    statuses are not shown; no deliveries at all -> no rows (no chart).
    One aggregate row, unpivoted - no join."""
    agg = deliveries.agg(F.count(F.lit(1)).alias("_rows"),
                         *[F.count_if(F.col("status") == s).cast("bigint").alias(f"_n{i}")
                           for i, s in enumerate(statuses)]).where(F.col("_rows") > 0)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("status"),
                              F.col(f"_n{i}").alias("orders")) for i, s in enumerate(statuses)])
    return agg.select(F.inline(rows))


def delivery_time_by_city(deliveries: DataFrame) -> DataFrame:
    """Mean delivery days per city; a city with nothing delivered keeps a null."""
    return (deliveries.where(F.col("city").isNotNull()).groupBy("city")
            .agg((F.sum("delivery_time_days").cast("double")
                  / F.when(F.count("delivery_time_days") > 0, F.count("delivery_time_days").cast("double")))
                 .alias("avg_delivery_days")))


def partner_on_time(deliveries: DataFrame) -> DataFrame:
    """On-time % per partner, ascending (partner breaks ties)."""
    return (deliveries.where(F.col("deliverypartner").isNotNull()).groupBy("deliverypartner")
            .agg(guarded_ratio(F.count_if(F.col("on_time")), F.count(F.lit(1)), 100.0).alias("on_time_rate"))
            .orderBy("on_time_rate", "deliverypartner"))


def partner_domain(deliveries: DataFrame) -> DataFrame:
    """sorted distinct delivery partners."""
    return (deliveries.select("deliverypartner").where(F.col("deliverypartner").isNotNull())
            .distinct().orderBy("deliverypartner"))
