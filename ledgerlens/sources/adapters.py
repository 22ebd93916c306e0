"""Driver tables (TPC-H-like star schema + events) -> canonical commerce frames.

One mapping, used by every registered query and mirrored by the DuckDB oracle
(``ledgerlens.plans.oracle``). Keys keep their native BIGINT type so hash
partitioning on them survives the projection (a STRING cast would force a
second shuffle before every per-order aggregate).

Join order is written for scale: dimension joins that change the partitioning
key (part on ``partkey``, customer on ``custkey``) come first and the
``orderkey`` join comes last, so the result is hash-partitioned by order and
the per-order aggregates downstream reuse that exchange. Nation and region names
are looked up after the last of these joins, so that no shuffle carries them, and
supplier and customer are joined as bare key columns, whose size the planner
knows. There is no broadcast
hint: every join is left to the planner and AQE, whose broadcast conversion is
bounded by ``spark.sql.autoBroadcastJoinThreshold``.

Every join is a LEFT join from the line (or customer, or nation), on the
dimension's primary key: a line whose part, supplier, order, customer or nation
is missing stays, with null in the columns that come from there. So dropping a
dimension that a query does not read never changes its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (must match the oracle SQL).
RIVAL_BRANDS = ("Brand#1", "Brand#2")
JOIN_EPOCH = "1995-01-01"


class DriverTables:
    """Lazy access to the driver's parquet tables in one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _lines(t: DriverTables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def _parts(t: DriverTables) -> DataFrame:
    return t("part").select("p_partkey", "p_name", "p_type", "p_retailprice")


def _suppliers(t: DriverTables) -> DataFrame:
    return t("supplier").select("s_suppkey", "s_nationkey")


def _orders(t: DriverTables, with_city: bool) -> DataFrame:
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if with_city:
        cust = t("customer").select("c_custkey", "c_nationkey")
        orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "left").drop("c_custkey")
    return orders


def _customer_nation(rows: DataFrame, t: DriverTables) -> DataFrame:
    """Rows with ``c_nationkey`` get ``c_nation``."""
    nation = t("nation").select(F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("c_nation"))
    return rows.join(nation, F.col("c_nationkey") == F.col("_nation"), "left").drop("_nation")


def _supplier_nation(rows: DataFrame, t: DriverTables) -> DataFrame:
    """Rows with ``s_nationkey`` get ``s_nation`` and ``s_region``."""
    nation = t("nation").select(F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("s_nation"), F.col("n_regionkey").alias("_of"))
    region = t("region").select(F.col("r_regionkey").alias("_region"), F.col("r_name").alias("s_region"))
    named = rows.join(nation, F.col("s_nationkey") == F.col("_nation"), "left").drop("_nation")
    return named.join(region, F.col("_of") == F.col("_region"), "left").drop("_of", "_region")


def _sales_columns(with_part: bool, with_city: bool) -> list:
    gross = F.col("l_extendedprice").cast("decimal(12,2)")
    cols = [
        F.col("l_orderkey").alias("orderid"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("l_partkey").alias("productid"),
    ]
    if with_part:
        cols += [F.col("p_name").alias("productname"), F.col("p_type").alias("category")]
    cols += [
        F.col("l_quantity").cast("int").alias("quantity"),
        gross.cast("decimal(18,2)").alias("grossvalue"),
        (gross * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)").alias("discountvalue"),
    ]
    if with_part:
        cols.append((F.col("l_quantity").cast("decimal(6,0)") * F.col("p_retailprice").cast("decimal(10,2)"))
                    .cast("decimal(18,4)").alias("costofgoodssold"))
    cols.append(F.col("o_custkey").alias("customerid"))
    if with_city:
        cols.append(F.col("c_nation").alias("city"))
    cols += [
        F.col("l_suppkey").alias("locationid"),
        F.col("o_orderpriority").alias("channel"),
        F.when(F.col("l_returnflag") == "R", F.lit("Returned")).otherwise(F.lit("Completed")).alias("orderstatus"),
    ]
    return cols


def _delivery_columns(city: str = "city", with_orderid: bool = True) -> list:
    orderdate = F.to_date("o_orderdate")
    finished = F.col("l_linestatus") == "F"
    lead = (F.lit(1) + (F.col("l_partkey") + F.col("l_linenumber")) % 9).cast("int")
    cost_cents = (F.lit(1500) + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 1000).cast("decimal(12,0)")
    cols = [F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
            .alias("deliveryid")]
    if with_orderid:
        cols.append(F.col("l_orderkey").alias("orderid"))
    return cols + [
        orderdate.alias("orderdate"),
        F.date_add(orderdate, 5).alias("promiseddate"),
        F.when(finished, F.date_add(orderdate, lead)).alias("actualdeliverydate"),
        F.when(finished & (F.col("l_returnflag") == "R"), F.lit("Failed"))
        .when(finished, F.lit("Delivered"))
        .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.lit("Pending"))
        .otherwise(F.lit("Shipped")).alias("status"),
        F.col("s_region").alias("deliverypartner"),
        F.col("s_nation").alias(city),
        (cost_cents / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,2)").alias("deliverycost"),
    ]


def sales(t: DriverTables, with_part: bool = True, with_city: bool = True) -> DataFrame:
    """Order lines as the canonical ``sales`` table (without derived columns).

    ``with_part`` / ``with_city`` leave out the dimension joins a query does
    not need (the columns go, the rows stay the same).
    """
    li = _lines(t)
    if with_part:
        li = li.join(_parts(t), F.col("l_partkey") == F.col("p_partkey"), "left")
    j = li.join(_orders(t, with_city), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return (_customer_nation(j, t) if with_city else j).select(*_sales_columns(with_part, with_city))


def deliveries(t: DriverTables) -> DataFrame:
    """One delivery per order line: dates from the order, partner/city from the supplier."""
    li = _lines(t).join(_suppliers(t), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    orders = t("orders").select("o_orderkey", "o_orderdate")
    j = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return _supplier_nation(j, t).select(*_delivery_columns())


DELIVERY_CITY = "delivery_city"


def order_line_rows(t: DriverTables) -> DataFrame:
    """Order lines with their part, supplier, order and customer, as the tables have them: keys in place of nation names,
    no derived column. Rows that are still to be shuffled stay narrow; :func:`order_line_columns` derives the rest."""
    li = (_lines(t).join(_parts(t), F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
          .join(_suppliers(t), F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey"))
    return li.join(_orders(t, True), F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")


def order_line_columns(rows: DataFrame, t: DriverTables, *keep: str) -> DataFrame:
    """Every sales and delivery column of :func:`order_line_rows`; ``keep`` names columns of theirs that stay."""
    named = _supplier_nation(_customer_nation(rows, t), t)
    return named.select(*_sales_columns(True, True), *_delivery_columns(DELIVERY_CITY, with_orderid=False), *keep)


def order_lines(t: DriverTables) -> DataFrame:
    """Every sales column and every delivery column of an order line, from
    one join pipeline (lineitem x part x supplier, then x orders x customer).
    The delivery city is ``delivery_city`` (``city`` is the customer's).
    Equal to :func:`sales` and :func:`deliveries` side by side."""
    return order_line_columns(order_line_rows(t), t)


def customers(t: DriverTables) -> DataFrame:
    nation = t("nation").select("n_nationkey", "n_name")
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    offset = ((F.col("c_custkey") * 37) % 2400).cast("int")
    return c.select(
        F.col("c_custkey").alias("customerid"),
        F.date_add(F.to_date(F.lit(JOIN_EPOCH)), offset).cast("timestamp_ntz").alias("joindate"),
        F.col("n_name").alias("city"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("Gold"))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit("Silver"))
        .otherwise(F.lit("Bronze")).alias("segment"),
    )


def sales_funnel(t: DriverTables) -> DataFrame:
    """Weekly funnel counts (Monday weeks) from the event stream table."""
    ev = t("events").select("ts", "event_type")
    return (ev.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"))
            .agg(F.count_if(F.col("event_type") == "view").alias("visits"),
                 F.count_if(F.col("event_type") == "click").alias("carts"),
                 F.count_if(F.col("event_type") == "purchase").alias("orders")))


def marketing_campaigns(t: DriverTables) -> DataFrame:
    region = t("region").select("r_regionkey", "r_name")
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("campaignid"),
        F.col("n_name").alias("campaignname"),
        F.col("r_name").alias("channel"),
        F.to_date(F.lit("1995-01-01")).alias("startdate"),
        F.to_date(F.lit("2001-08-01")).alias("enddate"),
        (F.col("n_nationkey") * 10000).cast("decimal(18,2)").alias("totalcost"),
        ((F.col("n_nationkey") + 1) * 100000).cast("bigint").alias("impressions"),
        ((F.col("n_nationkey") + 1) * 2500).cast("bigint").alias("clicks"),
    )


def marketing_attribution(t: DriverTables) -> DataFrame:
    o = t("orders").select("o_orderkey")
    return o.select(F.col("o_orderkey").alias("orderid"), (F.col("o_orderkey") % 20).alias("campaignid"))


def competitors(t: DriverTables) -> DataFrame:
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return p.select(
        F.lit(None).cast("date").alias("date"),
        F.col("p_brand").alias("competitor"),
        F.col("p_partkey").alias("productid"),
        F.col("p_name").alias("productname"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        ((F.col("p_size") % 4) == 0).alias("onpromotion"),
    )


def predictions(t: DriverTables) -> DataFrame:
    """Deterministic stand-in for the churn score table (oracle-checkable)."""
    c = t("customer").select("c_custkey")
    return c.select(F.col("c_custkey").alias("customerid"),
                    (((F.col("c_custkey") * 7919) % 1000) / F.lit(1000.0)).cast("double").alias("churn_probability"))
