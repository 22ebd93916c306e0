"""Sales operators: enrichment (E1-E5), filters (F1, F2, F7), KPIs (A1-A6),
trends and breakdowns (A7-A9), top-k (K1-K3) and the one-pass breakdowns.

Inputs are canonical ``sales`` frames (see ``sources.schemas``); outputs are
DataFrames. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import date_in_range, guarded_ratio, month_label, week_label

ALL = "All"
GRAINS = ("date", "week", "month")
BREAKDOWN_KEYS = ("date", "week", "month", "category", "channel", "productname", "city", "locationid")


def enrich_sales(sales: DataFrame) -> DataFrame:
    """E5: net sale, calendar date, week label and month label.

    A missing gross or discount *column* counts as 0; a null *value* keeps
    the net sale null.
    """
    cols = set(sales.columns)
    gross = F.col("grossvalue") if "grossvalue" in cols else F.lit(0)
    disc = F.col("discountvalue") if "discountvalue" in cols else F.lit(0)
    ts = F.col("timestamp")
    if dict(sales.dtypes).get("timestamp") == "string":
        ts = F.to_timestamp_ntz(ts)
    keep = [c for c in sales.columns if c not in ("netsale", "timestamp", "date", "week", "month")]
    return sales.select(
        *keep,
        ts.alias("timestamp"),
        (gross - disc).alias("netsale"),
        F.to_date(ts).alias("date"),
        week_label(ts).alias("week"),
        month_label(ts).alias("month"),
    )


def filter_sales(sales: DataFrame, start=None, end=None, channel: str = ALL) -> DataFrame:
    """F1 + F2: inclusive date range (null dates drop out) and optional channel.

    ``'All'`` keeps every channel, null included; a value keeps only equal rows.
    The range is also stated on the raw timestamp so it reaches the scan.
    """
    cond = date_in_range("date", start, end, ts_col="timestamp" if start or end else None)
    out = sales.where(cond)
    if channel is not None and channel != ALL:
        out = out.where(F.col("channel") == F.lit(channel))
    return out


def _money_sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,4)"))


def sales_kpis(sales: DataFrame) -> DataFrame:
    """A1-A5 as one row, plus ``row_count`` (F8: measures are null when 0).

    Three distinct counts would make Catalyst expand every line three times;
    instead lines are folded per order first (one exchange on ``orderid``,
    which the order-keyed join upstream usually already provides), then the
    order rows are summed once. A hot order is harmless: both stages are
    partial (map-side) aggregates.
    """
    return kpi_measures(sales_totals(sales))


def sales_totals(sales: DataFrame) -> DataFrame:
    """The one row behind A1-A5 and the last stage of A6 (distinct Completed orders)."""
    per_order = sales.groupBy("orderid").agg(
        F.sum("netsale").alias("rev"),
        F.sum("costofgoodssold").alias("cogs"),
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(F.col("orderstatus") == status, 1).otherwise(0)).alias(flag)
          for status, flag in (("Returned", "returned"), ("Completed", "completed"))],
    )
    return per_order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        _money_sum("rev").alias("rev"),
        _money_sum("cogs").alias("cogs"),
        F.count("orderid").cast("bigint").alias("total_orders"),
        *[F.coalesce(F.sum(F.when(F.col("orderid").isNotNull(), F.col(flag))), F.lit(0)).cast("bigint").alias(f"{flag}_orders")
          for flag in ("returned", "completed")],
    )


def kpi_measures(totals: DataFrame) -> DataFrame:
    """A1-A5 from one row of row_count, rev, cogs, total_orders and returned_orders."""
    rev = F.col("rev").cast("double")
    net = (F.col("rev") - F.col("cogs")).cast("double")
    orders = F.col("total_orders")
    measures = {
        "total_revenue": rev,
        "total_cogs": F.col("cogs").cast("double"),
        "net_profit": net,
        "gross_margin": guarded_ratio(net, rev, 100.0, zero_test=rev <= 0),
        "total_orders": orders,
        "aov": guarded_ratio(rev, orders, zero_test=orders <= 0),
        "returned_orders": F.col("returned_orders"),
        "return_rate": guarded_ratio(F.col("returned_orders"), orders, 100.0, zero_test=orders <= 0),
    }
    empty = F.col("row_count") == 0
    return totals.select(
        "row_count",
        *[F.when(~empty, v).alias(k) for k, v in measures.items()],
    )


def sales_funnel(sales: DataFrame, funnel: DataFrame) -> DataFrame:
    """Visits, Carts, Orders (whole funnel table, unfiltered) and Fulfilled
    (distinct Completed orders of ``sales``), each with its % of the first stage.

    No funnel rows, or no sales rows left by the filter (the dashboard then
    shows "No Data" everywhere) -> no result. ``Fulfilled`` is a scalar
    subquery, so the two one-row aggregates meet without a join.
    """
    fulfilled = (sales.where(F.col("orderstatus") == "Completed")
                 .agg(F.count_distinct("orderid").cast("bigint")).scalar())
    return funnel_stages(funnel, fulfilled, sales.select(F.lit(1)).exists())


def funnel_stages(funnel: DataFrame, fulfilled: Column, any_sales: Column) -> DataFrame:
    """A6 from the funnel table, the number of completed orders and whether there are sales."""
    f = funnel.agg(
        F.count(F.lit(1)).alias("weeks"),
        F.coalesce(F.sum("visits"), F.lit(0)).cast("bigint").alias("visits"),
        F.coalesce(F.sum("carts"), F.lit(0)).cast("bigint").alias("carts"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"),
    ).where((F.col("weeks") > 0) & any_sales)
    stages = F.array(
        F.struct(F.lit(1).alias("stage_order"), F.lit("Visits").alias("stage"), F.col("visits").alias("value")),
        F.struct(F.lit(2).alias("stage_order"), F.lit("Carts").alias("stage"), F.col("carts").alias("value")),
        F.struct(F.lit(3).alias("stage_order"), F.lit("Orders").alias("stage"), F.col("orders").alias("value")),
        F.struct(F.lit(4).alias("stage_order"), F.lit("Fulfilled").alias("stage"), fulfilled.alias("value")),
    )
    return (f.select("visits", F.inline(stages))
            .select("stage_order", "stage", "value",
                    guarded_ratio(F.col("value"), F.col("visits"), 100.0).alias("pct_of_first")))


def sales_trend(sales: DataFrame, grain: str = "date") -> DataFrame:
    """Net sales per period that occurs (no gap fill), in period order."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    return (sales.where(F.col(grain).isNotNull()).groupBy(grain)
            .agg(_money_sum("netsale").cast("double").alias("netsale"))
            .orderBy(grain))


def sales_by(sales: DataFrame, key: str) -> DataFrame:
    """Net sales per value of ``key``; a null key is not a group."""
    return (sales.where(F.col(key).isNotNull()).groupBy(key)
            .agg(_money_sum("netsale").cast("double").alias("netsale")))


def top_by_netsale(sales: DataFrame, key: str, n: int = 10) -> DataFrame:
    """K1-K3: the ``n`` keys with the highest net sales; ties -> lower key first.

    Plans as TakeOrderedAndProject: each partition keeps its own top ``n``.
    """
    return highest_netsales(sales_by(sales, key), key, n)


def sales_cells(sales: DataFrame, keys=BREAKDOWN_KEYS) -> DataFrame:
    """Net sales of every value of each key in one scan (GROUPING SETS): the keys, ``_by`` (the name of the key that
    a row is grouped by) and ``netsale``."""
    by = F.lit(None).cast("string")
    for k in keys:
        by = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(by)
    cols = [F.col(k) for k in keys]
    return sales.groupingSets([[c] for c in cols], *cols).agg(by.alias("_by"), _money_sum("netsale").cast("double").alias("netsale"))


def sales_by_of(cells: DataFrame, key: str) -> DataFrame:
    """:func:`sales_by` read from :func:`sales_cells`."""
    return cells.where((F.col("_by") == key) & F.col(key).isNotNull()).select(key, "netsale")


def highest_netsales(by_key: DataFrame, key: str, n: int = 10) -> DataFrame:
    return by_key.orderBy(F.col("netsale").desc(), F.col(key).asc()).limit(n)


def sales_breakdowns(sales: DataFrame, keys=BREAKDOWN_KEYS) -> DataFrame:
    """All one-key net-sales breakdowns in a single scan.

    Result: ``breakdown`` (key name), ``key`` (value as text), ``netsale``.
    Equal to running :func:`sales_by` / :func:`sales_trend` per key.
    """
    keys = [k for k in keys if k in sales.columns]
    value = F.lit(None).cast("string")
    for k in keys:
        value = F.when(F.col("_by") == k, F.col(k).cast("string")).otherwise(value)
    return (sales_cells(sales, keys).select(F.col("_by").alias("breakdown"), value.alias("key"), "netsale")
            .where(F.col("key").isNotNull()))


def channel_domain(sales: DataFrame, key: str = "channel") -> DataFrame:
    """sorted distinct non-null values of a filter column."""
    return sales.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def date_bounds(sales: DataFrame, date_col: str = "date") -> DataFrame:
    """the date picker bounds."""
    return sales.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))
