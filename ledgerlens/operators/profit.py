"""Profit operators: line profit (E9-E12), KPIs (A28, A29), breakdowns
(A30-A32), margin top/bottom lists (K5, K6) and the rule list (A33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEAN_DIGITS = 6  # means of DOUBLE columns are rounded: summation order varies by plan

# Recommendation texts and the returns-loss share that fires rule 1.
RETURNS_SHARE = "0.1"
MSG_RETURNS = "High profit loss from returns detected. Investigate top returned products/categories."
MSG_CHANNEL = "Channel '{}' is unprofitable. Review marketing strategy."
MSG_PRODUCT = "'{}' has a high margin. Consider promoting it."
MSG_NONE = "No critical issues detected."
TOTAL = "all"


def _zero():
    return F.lit(0).cast("decimal(38,4)")


def profit_lines(sales: DataFrame) -> DataFrame:
    """``net_profit`` (exact), ``profit_margin`` % (0 when net sale is 0,
    null when net sale is null) and ``total_cost``."""
    net_profit = F.col("netsale") - F.col("costofgoodssold")
    margin = (F.when(F.col("netsale") == 0, F.lit(0.0))
              .otherwise(net_profit.cast("double") / F.col("netsale").cast("double") * F.lit(100.0)))
    return sales.select("*", net_profit.alias("net_profit"), margin.alias("profit_margin"),
                        F.col("costofgoodssold").alias("total_cost"))


def _mean(c: str):
    return F.round(F.avg(c), MEAN_DIGITS)


def _measures() -> list[Column]:
    ret = F.col("orderstatus") == "Returned"
    return [
        F.count(F.lit(1)).cast("bigint").alias("row_count"),
        F.sum("net_profit").alias("_np"),
        _mean("profit_margin").alias("profit_margin"),
        (F.coalesce(F.sum(F.when(ret, F.col("total_cost"))), _zero())
         + F.coalesce(F.sum(F.when(ret, F.col("netsale"))), _zero())).alias("_lost"),
    ]


def profit_cells(lines: DataFrame, keys=("channel", "productname")) -> DataFrame:
    """Measures of all lines and of every value of each key in one scan (grouping sets of one aggregate); ``_by``
    names the key of a row, ``all`` the total. The functions ``*_of`` below read their view from it."""
    by = F.lit(TOTAL)
    for k in keys:
        by = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(by)
    cols = [F.col(k) for k in keys]
    return lines.groupingSets([[], *[[c] for c in cols]], *cols).agg(by.alias("_by"), *_measures())


def profit_kpis(lines: DataFrame) -> DataFrame:
    """A28 + A29: total net profit, unweighted mean line margin, and the
    profit lost to returns = cost + net sale of Returned lines."""
    return _kpis(lines.agg(*_measures()))


def profit_kpis_of(cells: DataFrame) -> DataFrame:
    total = F.col("_by") == TOTAL
    return _kpis(cells.agg(F.coalesce(F.max(F.when(total, F.col("row_count"))), F.lit(0)).cast("bigint").alias("row_count"),
                           *[F.max(F.when(total, F.col(c))).alias(c) for c in ("_np", "profit_margin", "_lost")]))


def _kpis(total: DataFrame) -> DataFrame:
    some = F.col("row_count") > 0  # F8: no lines -> null measures
    return total.select("row_count", F.when(some, F.coalesce("_np", _zero()).cast("double")).alias("total_net_profit"),
                        F.col("profit_margin").alias("avg_profit_margin"),
                        F.when(some, F.col("_lost").cast("double")).alias("profit_lost_to_returns"))


def profit_by(lines: DataFrame, key: str) -> DataFrame:
    """Summed net profit per key (null key is not a group)."""
    return (lines.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.coalesce(F.sum("net_profit"), _zero()).cast("double").alias("net_profit")))


def profit_by_of(cells: DataFrame, key: str) -> DataFrame:
    return _of(cells, key).select(key, F.coalesce("_np", _zero()).cast("double").alias("net_profit"))


def _of(cells: DataFrame, key: str) -> DataFrame:
    return cells.where((F.col("_by") == key) & F.col(key).isNotNull())


def margin_by_product(lines: DataFrame) -> DataFrame:
    """Mean line margin per product."""
    return (lines.where(F.col("productname").isNotNull()).groupBy("productname")
            .agg(_mean("profit_margin").alias("profit_margin")))


def margin_by_product_of(cells: DataFrame) -> DataFrame:
    return _of(cells, "productname").select("productname", "profit_margin")


def top_margin_products(lines: DataFrame, n: int = 10) -> DataFrame:
    """K5: highest mean margin; lower product name wins a tie; no-margin products skipped."""
    return highest_margins(margin_by_product(lines), n)


def low_margin_products(lines: DataFrame, n: int = 10) -> DataFrame:
    """K6: lowest mean margin."""
    return lowest_margins(margin_by_product(lines), n)


def highest_margins(margins: DataFrame, n: int = 10) -> DataFrame:
    return (margins.where(F.col("profit_margin").isNotNull())
            .orderBy(F.col("profit_margin").desc(), F.col("productname")).limit(n))


def lowest_margins(margins: DataFrame, n: int = 10) -> DataFrame:
    return (margins.where(F.col("profit_margin").isNotNull())
            .orderBy(F.col("profit_margin").asc(), F.col("productname")).limit(n))


def recommendations(lines: DataFrame) -> DataFrame:
    """The rules that fire, in rule order; ``rule`` 0 when none does. No
    lines -> no rows (the dashboard says that there is not enough data).

    (1) total profit > 0 and returns loss > 10 % of it; (2) the first loss-
    making channel in *key order* (not the worst one); (3) the product with
    the highest mean margin. One scan: see :func:`profit_cells`, whose rows are folded to one.
    """
    return recommendations_of(profit_cells(lines))


def recommendations_of(cells: DataFrame) -> DataFrame:
    total, by_channel, by_product = (F.col("_by") == k for k in (TOTAL, "channel", "productname"))
    totals = cells.agg(
        F.max(F.when(total, F.col("row_count"))).alias("_rows"),
        F.max(F.when(total, F.col("_np"))).alias("_np"),
        F.max(F.when(total, F.col("_lost"))).alias("_lost"),
        F.min(F.when(by_channel & (F.col("_np") < 0), F.col("channel"))).alias("_channel"),
        F.min(F.when(by_product & F.col("productname").isNotNull() & F.col("profit_margin").isNotNull(),
                     F.struct((-F.col("profit_margin")).alias("m"), "productname"))).alias("_best"),
    ).where(F.col("_rows") > 0)
    channel, product = F.col("_channel"), F.col("_best.productname")
    r1 = (F.col("_np").isNotNull() & (F.col("_np") > 0)
          & (F.col("_lost") > F.col("_np") * F.lit(RETURNS_SHARE).cast("decimal(2,1)")))
    r2 = channel.isNotNull()
    r3 = product.isNotNull()
    fired = F.coalesce(r1, F.lit(False))
    none = ~(fired | r2 | r3)
    rules = F.array(
        F.struct(F.lit(1).alias("rule"), F.lit(MSG_RETURNS).alias("message"), fired.alias("fired")),
        F.struct(F.lit(2).alias("rule"),
                 F.format_string(MSG_CHANNEL.replace("{}", "%s"), channel).alias("message"), r2.alias("fired")),
        F.struct(F.lit(3).alias("rule"),
                 F.format_string(MSG_PRODUCT.replace("{}", "%s"), product).alias("message"), r3.alias("fired")),
        F.struct(F.lit(0).alias("rule"), F.lit(MSG_NONE).alias("message"), none.alias("fired")),
    )
    return totals.select(F.inline(rules)).where(F.col("fired")).select("rule", "message")
