"""Marketing operators: attributed revenue per campaign (A21-A24, J2, J3),
totals (A25), per-campaign ratios (A26) and conversions by channel (A27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import guarded_ratio

PAIRS = "pairs"
ORDER = "order"


def order_amounts(sales: DataFrame, mode: str = PAIRS) -> DataFrame:
    """A21. ``pairs`` (the reference behaviour): distinct (order, net sale)
    pairs, so an order keeps one row per *different* line amount and equal
    amounts collapse - it under-counts multi-line orders. ``order``: one row
    per order with the order's summed net sale.

    Both group on a superset of ``orderid``, so an order-partitioned input
    needs no exchange here.
    """
    if mode == PAIRS:
        return sales.select("orderid", "netsale").distinct()
    if mode == ORDER:
        return sales.groupBy("orderid").agg(F.sum("netsale").alias("netsale"))
    raise ValueError(f"mode must be {PAIRS!r} or {ORDER!r}")


def campaign_performance(sales: DataFrame, campaigns: DataFrame, attribution: DataFrame,
                         mode: str = PAIRS) -> DataFrame:
    """Every campaign with attributed net sale (exact DECIMAL),
    conversions (distinct orders), ROAS and CPA; campaigns without
    attribution get zeros. Any empty input -> empty result.

    J2 matches attribution to the order amounts on a null-safe key (a null
    order matches a null order, as in the reference) and is many-to-many:
    every attribution row picks up every amount of its order. Only the sum
    of those amounts reaches the output, so the amounts are first folded to
    one total per order (null order = one group) and the join becomes
    many-to-one - no per-key pair explosion, even for a hot or null key.
    An attributed order with no sale still converts, adding 0.

    The order stands in a struct, so that null orders match in a plain join.
    Lines are folded per task before they move (to different pairs, or to one
    sum per order), so the lines of a hot or null order do not meet in one
    task; then one row a task and order, and one a task and campaign.
    """
    if mode not in (PAIRS, ORDER):
        raise ValueError(f"mode must be {PAIRS!r} or {ORDER!r}")
    lines = sales.select(F.struct("orderid").alias("_order"), "netsale")
    if mode == PAIRS:
        lines = lines.distinct()
    per_order = lines.groupBy("_order").agg(F.sum("netsale").alias("_amount"))
    attributed = attribution.where(F.col("campaignid").isNotNull()).select(F.struct("orderid").alias("_order"), "campaignid")
    per_pair = (attributed.join(per_order, "_order", "left").groupBy("_order", "campaignid")
                .agg(F.sum("_amount").alias("_amount")))
    perf = (per_pair.groupBy("campaignid")
            .agg(F.coalesce(F.sum("_amount"), F.lit(0).cast("decimal(38,4)")).alias("_net"),
                 F.count("_order.orderid").cast("bigint").alias("_conv")))
    out = campaigns.join(perf, "campaignid", "left")
    nonempty = sales.select(F.lit(1)).exists() & attribution.select(F.lit(1)).exists()
    net = F.coalesce(F.col("_net"), F.lit(0).cast("decimal(38,4)"))
    conv = F.coalesce(F.col("_conv"), F.lit(0).cast("bigint"))
    return out.where(nonempty).select(
        *[c for c in campaigns.columns],
        net.alias("netsale"),
        conv.alias("conversions"),
        guarded_ratio(net, F.col("totalcost")).alias("roas"),
        guarded_ratio(F.col("totalcost"), conv).alias("cpa"),
    )


def marketing_totals(perf: DataFrame) -> DataFrame:
    """Spend, revenue, overall ROAS (ratio of sums), conversions, CPA.
    No campaign rows (an input was empty) -> one row of nulls (F8)."""
    agg = perf.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum("totalcost"), F.lit(0).cast("decimal(38,2)")).alias("spend"),
        F.coalesce(F.sum("netsale"), F.lit(0).cast("decimal(38,4)")).alias("revenue"),
        F.coalesce(F.sum("conversions"), F.lit(0)).cast("bigint").alias("total_conversions"),
    )
    spend = F.col("spend").cast("double")
    revenue = F.col("revenue").cast("double")
    some = F.col("_rows") > 0
    return agg.select(
        F.when(some, spend).alias("total_spend"),
        F.when(some, revenue).alias("total_revenue"),
        F.when(some, guarded_ratio(revenue, spend, zero_test=spend <= 0)).alias("overall_roas"),
        F.when(some, F.col("total_conversions")).alias("total_conversions"),
        F.when(some, guarded_ratio(spend, F.col("total_conversions"), zero_test=F.col("total_conversions") <= 0))
        .alias("avg_cpa"),
    )


def campaign_ratios(perf: DataFrame) -> DataFrame:
    """ROAS and CPA per campaign with its channel."""
    return perf.select("campaignid", "campaignname", "channel", "roas", "cpa")


def conversions_by_channel(perf: DataFrame) -> DataFrame:
    """Summed conversions per channel (null channel is not a group)."""
    return (perf.where(F.col("channel").isNotNull()).groupBy("channel")
            .agg(F.sum("conversions").cast("bigint").alias("conversions")))
