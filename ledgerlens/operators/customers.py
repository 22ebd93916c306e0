"""Customer operators: RFM (A16), status rule (A17/A18), counts and
distribution (A19/A20), customer lists (K4, K7-K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import whole_days
from .ordering import POSITION, with_position

# Status labels and their day thresholds.
NEW = "New"
NEVER = "Never Purchased"
ACTIVE = "Active"
DORMANT = "Dormant (At-Risk)"
CHURN_RISK = "Churn Risk"
NEW_DAYS = 90
ACTIVE_DAYS = 90
DORMANT_DAYS = 180


def as_of_column(sales: DataFrame, as_of=None) -> Column:
    """Reference instant. Given -> that instant; default -> the latest sale
    plus one day, evaluated once as a scalar subquery (no collect, no join)."""
    if as_of is not None:
        return F.to_timestamp_ntz(F.lit(str(as_of)))
    return sales.agg(F.max("timestamp")).scalar() + F.expr("INTERVAL 1 DAY")


def order_rollup(sales: DataFrame) -> DataFrame:
    """Lines folded to one row per (customer, order); null customers dropped.

    Shared by RFM and churn features. When ``sales`` is already hash
    partitioned by ``orderid`` this needs no exchange (the clustering keys
    contain the partitioning key); the per-customer step then shuffles only
    one row per order, so a customer holding a third of all lines costs no
    more than its order count.
    """
    qty = F.sum("quantity") if "quantity" in sales.columns else F.lit(None).cast("bigint")
    return (sales.where(F.col("customerid").isNotNull())
            .groupBy("customerid", "orderid")
            .agg(F.max("timestamp").alias("last_ts"),
                 F.sum("netsale").alias("net"),
                 F.count("netsale").alias("net_n"),
                 qty.alias("qty")))


def rfm(sales: DataFrame, as_of=None) -> DataFrame:
    """Last purchase, frequency (distinct orders), monetary (sum of net
    sale, 0 if none), recency in whole days before ``as_of``."""
    now = as_of_column(sales, as_of)
    per_cust = order_rollup(sales).groupBy("customerid").agg(
        F.max("last_ts").alias("last_purchase_date"),
        F.count("orderid").cast("bigint").alias("frequency"),
        F.coalesce(F.sum("net"), F.lit(0).cast("decimal(38,4)")).alias("monetary"),
    )
    return per_cust.select(
        "customerid", "last_purchase_date", "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        whole_days(F.col("last_purchase_date"), now).alias("recency"),
    )


def status_rule(join_days: Column, recency: Column) -> Column:
    """A17, in the reference's order: ``New`` beats everything; a null join
    date simply fails that first test."""
    return (F.when(join_days <= NEW_DAYS, F.lit(NEW))
            .when(recency.isNull(), F.lit(NEVER))
            .when(recency <= ACTIVE_DAYS, F.lit(ACTIVE))
            .when(recency <= DORMANT_DAYS, F.lit(DORMANT))
            .otherwise(F.lit(CHURN_RISK)))


def customer_status(customers: DataFrame, sales: DataFrame, as_of=None) -> DataFrame:
    """A18 = A16 + customers LEFT JOIN rfm + A17. Empty customers or empty
    sales -> empty result (an uncorrelated EXISTS, planned as a scalar).

    With ``as_of`` the view is as of that instant: later sales and customers
    who joined later do not exist yet."""
    now = as_of_column(sales, as_of)
    if as_of is not None:
        sales = sales.where(F.col("timestamp") <= now)
    r = rfm(sales, as_of)
    joindate = F.col("joindate")
    if dict(customers.dtypes).get("joindate") == "string":
        joindate = F.to_timestamp_ntz(joindate)
    c = customers.withColumn("joindate", joindate)
    if as_of is not None:
        c = c.where(F.col("joindate").isNull() | (F.col("joindate") <= now))
    out = c.join(r, "customerid", "left").where(sales.select(F.lit(1)).exists())
    return out.withColumn("status", status_rule(whole_days(F.col("joindate"), now), F.col("recency")))


def status_counts(status_df: DataFrame) -> DataFrame:
    """Total rows and the per-status counts (absent status -> 0)."""
    return status_df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.count_if(F.col("status") == ACTIVE).cast("bigint").alias("active_customers"),
        F.count_if(F.col("status") == DORMANT).cast("bigint").alias("dormant_customers"),
        F.count_if(F.col("status") == CHURN_RISK).cast("bigint").alias("churn_risk_customers"),
        F.count_if(F.col("status") == NEW).cast("bigint").alias("new_customers"),
        F.count_if(F.col("status") == NEVER).cast("bigint").alias("never_purchased_customers"),
    )


def status_distribution(status_df: DataFrame) -> DataFrame:
    """Customers per status, most frequent first."""
    return (status_df.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
            .orderBy(F.col("customers").desc(), F.col("status")))


def top_customers(status_df: DataFrame, n: int = 20) -> DataFrame:
    """K4: highest monetary value first, nulls last, customer id breaks ties."""
    return (status_df.orderBy(F.col("monetary").desc_nulls_last(), F.col("customerid"))
            .limit(n).select("customerid", "city", "segment", "monetary", "frequency", "recency"))


def churn_risk_customers(status_df: DataFrame) -> DataFrame:
    """K7 (unsorted)."""
    return status_df.where(F.col("status") == CHURN_RISK).select(
        "customerid", "city", "segment", "recency", "last_purchase_date")


def new_customers(status_df: DataFrame) -> DataFrame:
    """K8 (unsorted)."""
    return status_df.where(F.col("status") == NEW).select("customerid", "city", "segment", "joindate")


def customers_by_value(status_df: DataFrame) -> DataFrame:
    """K9: every customer, highest monetary first (the full export order)."""
    return status_df.orderBy(F.col("monetary").desc_nulls_last(), F.col("customerid"))


def customers_ranked(status_df: DataFrame) -> DataFrame:
    """K9 with the gapless position of every customer in the export order."""
    return with_position(status_df, F.col("monetary").desc_nulls_last(), F.col("customerid"))


def customer_list(status_df: DataFrame, kind: str) -> DataFrame:
    """The export selector: ``top_value`` (all, sorted, with their position), ``churn_risk``, ``new``."""
    if kind == "top_value":
        return customers_ranked(status_df).orderBy(POSITION)
    if kind == "churn_risk":
        return status_df.where(F.col("status") == CHURN_RISK)
    if kind == "new":
        return status_df.where(F.col("status") == NEW)
    raise ValueError(f"unknown list {kind!r}")
