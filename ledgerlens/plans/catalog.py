"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL.

Each query reads the driver tables through ``sources.adapters`` and applies
one operator (or a small composition) with the default parameters of
SURVEY §7.4: whole period and ``'All'``. ``ORACLE`` holds the DuckDB
statement for every query whose result SQL can state, including the batch
and streaming ingest round-trips; the three that train a model have none
(row-count check only).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import churn as CH
from ..operators import competitors as CP
from ..operators import customers as C
from ..operators import delivery as D
from ..operators import marketing as M
from ..operators import profit as P
from ..operators import sales as S
from ..operators.rollup import KEYS as ROLLUP_KEYS
from ..session import unique_dir
from ..sources import adapters as A
from ..sources import ingest as ING
from ..sources import schemas as SCH
from ..streaming import file_ingest as FI
from . import oracle as O
from . import refresh as R
from . import workspace as W
from .rollup import SalesRollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _sales(spark, sf_dir, with_part=True, with_city=True, start=None, end=None):
    """Enriched sales from the materialised fact table (joins run once per
    input, see ``plans.workspace``). With materialisation switched off, the
    joins run lazily and only the dimensions the query reads are joined.
    ``start`` / ``end`` are the dates that the caller filters on anyway: only
    the months they touch are listed and read."""
    if W.materialize_enabled(spark):
        return W.sales_fact(spark, sf_dir, start, end)
    t = A.DriverTables(spark, sf_dir)
    return S.enrich_sales(A.sales(t, with_part=with_part, with_city=with_city))


def _out(df: DataFrame) -> DataFrame:
    """Driver-facing projection: DECIMAL as DOUBLE and DATE as a midnight
    TIMESTAMP, so every client library (row tuples, pandas, Arrow) renders
    both sides of the oracle comparison with the same Python types."""
    cols = []
    for c, t in df.dtypes:
        if t.startswith("decimal"):
            cols.append(F.col(c).cast("double").alias(c))
        elif t == "date":
            cols.append(F.col(c).cast("timestamp_ntz").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ----------------------------------------------------------------------------- sales


@query("sales_enriched", O.with_(O.SALES) + """
SELECT orderid, "timestamp", productid, productname, category, quantity,
       CAST(grossvalue AS DOUBLE) AS grossvalue, CAST(discountvalue AS DOUBLE) AS discountvalue,
       CAST(costofgoodssold AS DOUBLE) AS costofgoodssold, customerid, city, locationid, channel, orderstatus,
       CAST(netsale AS DOUBLE) AS netsale, CAST("date" AS TIMESTAMP) AS "date", week, "month"
FROM sales_e""")
def q_sales_enriched(spark, sf_dir):
    return _out(_sales(spark, sf_dir))


_KPI_SQL = """
SELECT COUNT(*) AS row_count,
       {rev} AS total_revenue,
       {cogs} AS total_cogs,
       CAST(COALESCE(SUM(netsale), 0) - COALESCE(SUM(costofgoodssold), 0) AS DOUBLE) AS net_profit,
       CASE WHEN {rev} <= 0 THEN CAST(0.0 AS DOUBLE)
            ELSE CAST(COALESCE(SUM(netsale), 0) - COALESCE(SUM(costofgoodssold), 0) AS DOUBLE) / {rev} * 100 END
         AS gross_margin,
       COUNT(DISTINCT orderid) AS total_orders,
       CASE WHEN COUNT(DISTINCT orderid) <= 0 THEN CAST(0.0 AS DOUBLE)
            ELSE {rev} / CAST(COUNT(DISTINCT orderid) AS DOUBLE) END AS aov,
       COUNT(DISTINCT CASE WHEN orderstatus = 'Returned' THEN orderid END) AS returned_orders,
       CASE WHEN COUNT(DISTINCT orderid) <= 0 THEN CAST(0.0 AS DOUBLE)
            ELSE CAST(COUNT(DISTINCT CASE WHEN orderstatus = 'Returned' THEN orderid END) AS DOUBLE)
                 / CAST(COUNT(DISTINCT orderid) AS DOUBLE) * 100 END AS return_rate
FROM sales_e WHERE {where}
""".replace("{rev}", O.msum("netsale")).replace("{cogs}", O.msum("costofgoodssold"))


@query("sales_kpis", O.with_(O.SALES) + _KPI_SQL.replace("{where}", '"date" IS NOT NULL'))
def q_sales_kpis(spark, sf_dir):
    return S.sales_kpis(S.filter_sales(_sales(spark, sf_dir, with_city=False)))


@query("sales_kpis_channel", O.with_(O.SALES) + _KPI_SQL.replace(
    "{where}", "\"date\" BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND channel = '1-URGENT'"))
def q_sales_kpis_channel(spark, sf_dir):
    s = _sales(spark, sf_dir, with_city=False, start="1997-01-01", end="1997-12-31")
    return S.sales_kpis(S.filter_sales(s, "1997-01-01", "1997-12-31", "1-URGENT"))


def _trend_sql(grain: str) -> str:
    g = f'"{grain}"'
    out = f'CAST({g} AS TIMESTAMP) AS {g}' if grain == "date" else g
    return O.with_(O.SALES) + f"""
SELECT {out}, {O.msum('netsale')} AS netsale FROM sales_e WHERE {g} IS NOT NULL GROUP BY {g}"""


SALES_KPI_STYLES = {"total_revenue": "amount", "gross_margin": "percent", "net_profit": "amount",
                    "total_orders": "count", "aov": "amount", "return_rate": "percent"}


@query("sales_kpis_text", O.with_(O.SALES) + f"""
, k AS ({_KPI_SQL.replace("{where}", '"date" IS NOT NULL')})
SELECT row_count,
       COALESCE(format('{{:,.2f}} SAR', total_revenue), '-') AS total_revenue_text,
       COALESCE(format('{{:.2f}}%', gross_margin), '-') AS gross_margin_text,
       COALESCE(format('{{:,.2f}} SAR', net_profit), '-') AS net_profit_text,
       COALESCE(format('{{:,}}', total_orders), '-') AS total_orders_text,
       COALESCE(format('{{:,.2f}} SAR', aov), '-') AS aov_text,
       COALESCE(format('{{:.2f}}%', return_rate), '-') AS return_rate_text
FROM k""")
def q_sales_kpis_text(spark, sf_dir):
    k = S.sales_kpis(S.filter_sales(_sales(spark, sf_dir, with_city=False)))
    return X.with_kpi_text(k, SALES_KPI_STYLES).select(
        "row_count", *[f"{c}_text" for c in SALES_KPI_STYLES])


@query("sales_funnel", O.with_(O.SALES, O.FUNNEL) + f"""
, f AS (SELECT COUNT(*) AS weeks, CAST(COALESCE(SUM(visits), 0) AS BIGINT) AS visits,
              CAST(COALESCE(SUM(carts), 0) AS BIGINT) AS carts, CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders
       FROM funnel),
ful AS (SELECT COUNT(DISTINCT orderid) AS n FROM sales_e WHERE "date" IS NOT NULL AND orderstatus = 'Completed'),
st AS (
  SELECT 1 AS stage_order, 'Visits' AS stage, visits AS value, visits AS first FROM f WHERE weeks > 0
  UNION ALL SELECT 2, 'Carts', carts, visits FROM f WHERE weeks > 0
  UNION ALL SELECT 3, 'Orders', orders, visits FROM f WHERE weeks > 0
  UNION ALL SELECT 4, 'Fulfilled', (SELECT n FROM ful), visits FROM f WHERE weeks > 0)
SELECT stage_order, stage, value, {O.ratio('value', 'first', '100')} AS pct_of_first FROM st""")
def q_sales_funnel(spark, sf_dir):
    t = A.DriverTables(spark, sf_dir)
    s = S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False))
    return S.sales_funnel(s, A.sales_funnel(t))


@query("sales_trend_day", _trend_sql("date"))
def q_sales_trend_day(spark, sf_dir):
    return _out(S.sales_trend(S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False)), "date"))


@query("sales_trend_week", _trend_sql("week"))
def q_sales_trend_week(spark, sf_dir):
    return S.sales_trend(S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False)), "week")


@query("sales_trend_month", _trend_sql("month"))
def q_sales_trend_month(spark, sf_dir):
    return S.sales_trend(S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False)), "month")


def _by_sql(key: str, top: int | None = None) -> str:
    tail = f" ORDER BY netsale DESC, {key} ASC LIMIT {top}" if top else ""
    return O.with_(O.SALES) + f"""
SELECT {key}, {O.msum('netsale')} AS netsale FROM sales_e
WHERE "date" IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}{tail}"""


@query("sales_by_category", _by_sql("category"))
def q_sales_by_category(spark, sf_dir):
    return S.sales_by(S.filter_sales(_sales(spark, sf_dir, with_city=False)), "category")


@query("sales_by_channel", _by_sql("channel"))
def q_sales_by_channel(spark, sf_dir):
    return S.sales_by(S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False)), "channel")


@query("top_products", _by_sql("productname", 10))
def q_top_products(spark, sf_dir):
    return S.top_by_netsale(S.filter_sales(_sales(spark, sf_dir, with_city=False)), "productname", 10)


@query("top_cities", _by_sql("city", 10))
def q_top_cities(spark, sf_dir):
    return S.top_by_netsale(S.filter_sales(_sales(spark, sf_dir, with_part=False)), "city", 10)


@query("top_branches", _by_sql("locationid", 10))
def q_top_branches(spark, sf_dir):
    return S.top_by_netsale(S.filter_sales(_sales(spark, sf_dir, with_part=False, with_city=False)),
                            "locationid", 10)


@query("sales_breakdowns", O.with_(O.SALES) + "\n UNION ALL \n".join(
    f"""SELECT '{k}' AS breakdown, CAST("{k}" AS VARCHAR) AS key, {O.msum('netsale')} AS netsale
FROM sales_e WHERE "date" IS NOT NULL AND "{k}" IS NOT NULL GROUP BY "{k}\""""
    for k in S.BREAKDOWN_KEYS))
def q_sales_breakdowns(spark, sf_dir):
    return S.sales_breakdowns(S.filter_sales(_sales(spark, sf_dir)))


# -- the same views of a period from the roll-up (day cells, spanning orders, month sums)

_PERIOD = ("1995-03-10", "1997-08-20")
_IN_PERIOD = f"\"date\" BETWEEN DATE '{_PERIOD[0]}' AND DATE '{_PERIOD[1]}'"


def _rollup(spark, sf_dir) -> SalesRollup:
    return SalesRollup(W.Workspace.of(spark, sf_dir))


@query("rollup_kpis", O.with_(O.SALES) + _KPI_SQL.replace("{where}", _IN_PERIOD))
def q_rollup_kpis(spark, sf_dir):
    return _rollup(spark, sf_dir).kpis(*_PERIOD)


@query("rollup_kpis_channel", O.with_(O.SALES) + _KPI_SQL.replace("{where}", f"{_IN_PERIOD} AND channel = '1-URGENT'"))
def q_rollup_kpis_channel(spark, sf_dir):
    return _rollup(spark, sf_dir).kpis(*_PERIOD, "1-URGENT")


@query("rollup_funnel", ORACLE["sales_funnel"].replace('"date" IS NOT NULL', _IN_PERIOD))
def q_rollup_funnel(spark, sf_dir):
    return _rollup(spark, sf_dir).funnel(A.sales_funnel(A.DriverTables(spark, sf_dir)), *_PERIOD)


@query("rollup_trend_week", _trend_sql("week").replace("WHERE", f"WHERE {_IN_PERIOD} AND"))
def q_rollup_trend_week(spark, sf_dir):
    return _rollup(spark, sf_dir).trend("week", *_PERIOD)


@query("rollup_breakdowns", O.with_(O.SALES) + "\n UNION ALL \n".join(
    f"""SELECT '{k}' AS breakdown, CAST("{k}" AS VARCHAR) AS key, {O.msum('netsale')} AS netsale
FROM sales_e WHERE {_IN_PERIOD} AND "{k}" IS NOT NULL GROUP BY "{k}\"""" for k in (*ROLLUP_KEYS, "channel")))
def q_rollup_breakdowns(spark, sf_dir):
    return _rollup(spark, sf_dir).breakdowns(*_PERIOD)


@query("rollup_top_products", _by_sql("productname", 10).replace('"date" IS NOT NULL', f"{_IN_PERIOD} AND channel = '1-URGENT'"))
def q_rollup_top_products(spark, sf_dir):
    return _rollup(spark, sf_dir).top("productname", 10, *_PERIOD, "1-URGENT")


@query("sales_filter_domain", O.with_(O.SALES) + """
SELECT DISTINCT channel FROM sales_e WHERE channel IS NOT NULL""")
def q_sales_filter_domain(spark, sf_dir):
    return S.channel_domain(_sales(spark, sf_dir, with_part=False, with_city=False))


@query("sales_date_bounds", O.with_(O.SALES) + """
SELECT CAST(MIN("date") AS TIMESTAMP) AS min_date, CAST(MAX("date") AS TIMESTAMP) AS max_date FROM sales_e""")
def q_sales_date_bounds(spark, sf_dir):
    return _out(S.date_bounds(_sales(spark, sf_dir, with_part=False, with_city=False)))


# ----------------------------------------------------------------------------- delivery

def _deliveries(spark, sf_dir, start=None, end=None):
    if W.materialize_enabled(spark):
        return W.deliveries_fact(spark, sf_dir, start, end)
    return D.enrich_deliveries(A.deliveries(A.DriverTables(spark, sf_dir)))


@query("delivery_enriched", O.with_(O.DELIVERIES) + """
SELECT deliveryid, orderid, CAST(orderdate AS TIMESTAMP) AS orderdate,
       CAST(promiseddate AS TIMESTAMP) AS promiseddate, CAST(actualdeliverydate AS TIMESTAMP) AS actualdeliverydate,
       status, deliverypartner, city, CAST(deliverycost AS DOUBLE) AS deliverycost,
       CAST("date" AS TIMESTAMP) AS "date", delivery_time_days, on_time
FROM deliveries_e""")
def q_delivery_enriched(spark, sf_dir):
    return _out(_deliveries(spark, sf_dir))


_DKPI_SQL = O.with_(O.DELIVERIES) + """
SELECT COUNT(*) AS row_count,
       CASE WHEN COUNT(*) = 0 THEN CAST(0.0 AS DOUBLE)
            ELSE CAST(COUNT(*) FILTER (WHERE on_time) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 END AS on_time_rate,
       CASE WHEN COUNT(*) = 0 THEN CAST(0.0 AS DOUBLE)
            ELSE CAST(COUNT(*) FILTER (WHERE status = 'Failed') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 END
         AS failed_rate,
       CAST(SUM(delivery_time_days) AS DOUBLE) / CAST(NULLIF(COUNT(delivery_time_days), 0) AS DOUBLE)
         AS avg_delivery_days,
       CAST(SUM(deliverycost) AS DOUBLE) / CAST(NULLIF(COUNT(deliverycost), 0) AS DOUBLE) AS avg_delivery_cost
FROM deliveries_e WHERE {where}"""


@query("delivery_kpis", _DKPI_SQL.replace("{where}", '"date" IS NOT NULL'))
def q_delivery_kpis(spark, sf_dir):
    return D.delivery_kpis(D.filter_deliveries(_deliveries(spark, sf_dir)))


@query("delivery_kpis_partner", _DKPI_SQL.replace(
    "{where}", "\"date\" BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND deliverypartner = 'EUROPE'"))
def q_delivery_kpis_partner(spark, sf_dir):
    return D.delivery_kpis(D.filter_deliveries(
        _deliveries(spark, sf_dir, "1997-01-01", "1997-12-31"), "1997-01-01", "1997-12-31", "EUROPE"))


@query("delivery_pipeline", O.with_(O.DELIVERIES) + "\n UNION ALL \n".join(
    f"""SELECT {i + 1} AS position, '{s}' AS status,
       COUNT(*) FILTER (WHERE status = '{s}') AS orders FROM deliveries_e WHERE "date" IS NOT NULL"""
    for i, s in enumerate(D.PIPELINE_STATUSES)))
def q_delivery_pipeline(spark, sf_dir):
    return D.delivery_pipeline(D.filter_deliveries(_deliveries(spark, sf_dir)))


@query("delivery_time_by_city", O.with_(O.DELIVERIES) + """
SELECT city, CAST(SUM(delivery_time_days) AS DOUBLE) / CAST(NULLIF(COUNT(delivery_time_days), 0) AS DOUBLE)
         AS avg_delivery_days
FROM deliveries_e WHERE "date" IS NOT NULL AND city IS NOT NULL GROUP BY city""")
def q_delivery_time_by_city(spark, sf_dir):
    return D.delivery_time_by_city(D.filter_deliveries(_deliveries(spark, sf_dir)))


@query("partner_on_time", O.with_(O.DELIVERIES) + """
SELECT deliverypartner,
       CAST(COUNT(*) FILTER (WHERE on_time) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS on_time_rate
FROM deliveries_e WHERE "date" IS NOT NULL AND deliverypartner IS NOT NULL GROUP BY deliverypartner""")
def q_partner_on_time(spark, sf_dir):
    return D.partner_on_time(D.filter_deliveries(_deliveries(spark, sf_dir)))


@query("delivery_partner_domain", O.with_(O.DELIVERIES) + """
SELECT DISTINCT deliverypartner FROM deliveries_e WHERE deliverypartner IS NOT NULL""")
def q_delivery_partner_domain(spark, sf_dir):
    return D.partner_domain(_deliveries(spark, sf_dir))


# ----------------------------------------------------------------------------- customers

EARLY_AS_OF = "1995-07-01"


def _rfm_sql(sales_where: str = "TRUE", as_of: str | None = None) -> str:
    asof = (f"SELECT TIMESTAMP '{as_of} 00:00:00' AS t" if as_of
            else 'SELECT MAX("timestamp") + INTERVAL 1 DAY AS t FROM sales_e')
    return f"""
, as_of_t AS ({asof}),
rfm AS (
  SELECT customerid, MAX("timestamp") AS last_purchase_date, COUNT(DISTINCT orderid) AS frequency,
         {O.msum('netsale')} AS monetary,
         CAST(floor(date_diff('second', MAX("timestamp"), (SELECT t FROM as_of_t)) / 86400) AS BIGINT) AS recency
  FROM sales_e WHERE customerid IS NOT NULL AND {sales_where} GROUP BY customerid)"""


def _status_sql(sales_where: str = "TRUE", as_of: str | None = None, cust_where: str = "TRUE") -> str:
    return O.with_(O.SALES, O.CUSTOMERS) + _rfm_sql(sales_where, as_of) + f""",
status AS (
  SELECT c.customerid, c.joindate, c.city, c.segment, r.last_purchase_date, r.frequency, r.monetary, r.recency,
         CASE WHEN floor(date_diff('second', c.joindate, a.t) / 86400) <= 90 THEN 'New'
              WHEN r.recency IS NULL THEN 'Never Purchased'
              WHEN r.recency <= 90 THEN 'Active'
              WHEN r.recency <= 180 THEN 'Dormant (At-Risk)'
              ELSE 'Churn Risk' END AS status
  FROM customers c LEFT JOIN rfm r ON c.customerid = r.customerid CROSS JOIN as_of_t a
  WHERE {cust_where})
"""


def _customers(spark, sf_dir):
    return A.customers(A.DriverTables(spark, sf_dir))


def _status(spark, sf_dir):
    sales = _sales(spark, sf_dir, with_part=False, with_city=False)
    return C.customer_status(_customers(spark, sf_dir), sales)


@query("rfm", O.with_(O.SALES) + _rfm_sql() + """
SELECT * FROM rfm""")
def q_rfm(spark, sf_dir):
    return C.rfm(_sales(spark, sf_dir, with_part=False, with_city=False))


@query("customer_status", _status_sql() + "SELECT * FROM status")
def q_customer_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query("customer_status_early", _status_sql(
    f"\"timestamp\" <= TIMESTAMP '{EARLY_AS_OF} 00:00:00'", EARLY_AS_OF, f"(c.joindate IS NULL OR c.joindate <= TIMESTAMP '{EARLY_AS_OF} 00:00:00')")
    + "SELECT * FROM status")
def q_customer_status_early(spark, sf_dir):
    sales = _sales(spark, sf_dir, with_part=False, with_city=False, end=EARLY_AS_OF)
    return C.customer_status(_customers(spark, sf_dir), sales, as_of=EARLY_AS_OF)


@query("customer_status_counts", _status_sql() + """
SELECT COUNT(*) AS total_customers,
       COUNT(*) FILTER (WHERE status = 'Active') AS active_customers,
       COUNT(*) FILTER (WHERE status = 'Dormant (At-Risk)') AS dormant_customers,
       COUNT(*) FILTER (WHERE status = 'Churn Risk') AS churn_risk_customers,
       COUNT(*) FILTER (WHERE status = 'New') AS new_customers,
       COUNT(*) FILTER (WHERE status = 'Never Purchased') AS never_purchased_customers
FROM status""")
def q_customer_status_counts(spark, sf_dir):
    return C.status_counts(_status(spark, sf_dir))


@query("customer_status_dist", _status_sql() + """
SELECT status, COUNT(*) AS customers FROM status GROUP BY status""")
def q_customer_status_dist(spark, sf_dir):
    return C.status_distribution(_status(spark, sf_dir))


@query("top_customers", _status_sql() + """
SELECT customerid, city, segment, monetary, frequency, recency FROM status
ORDER BY monetary DESC NULLS LAST, customerid LIMIT 20""")
def q_top_customers(spark, sf_dir):
    return C.top_customers(_status(spark, sf_dir), 20)


@query("churn_risk_customers", _status_sql() + """
SELECT customerid, city, segment, recency, last_purchase_date FROM status WHERE status = 'Churn Risk'""")
def q_churn_risk_customers(spark, sf_dir):
    return C.churn_risk_customers(_status(spark, sf_dir))


@query("new_customers", _status_sql() + """
SELECT customerid, city, segment, joindate FROM status WHERE status = 'New'""")
def q_new_customers(spark, sf_dir):
    return C.new_customers(_status(spark, sf_dir))


@query("customers_by_value", _status_sql() + """
SELECT * FROM status ORDER BY monetary DESC NULLS LAST, customerid""")
def q_customers_by_value(spark, sf_dir):
    return C.customers_by_value(_status(spark, sf_dir))


@query("customers_ranked", _status_sql() + """
SELECT *, row_number() OVER (ORDER BY monetary DESC NULLS LAST, customerid) AS position FROM status""")
def q_customers_ranked(spark, sf_dir):
    """The whole export order, as positions."""
    return C.customers_ranked(_status(spark, sf_dir))


# ----------------------------------------------------------------------------- marketing

def _perf_sql(mode: str) -> str:
    if mode == "pairs":
        amounts = "SELECT DISTINCT orderid, netsale FROM sales_e"
    else:
        amounts = "SELECT orderid, SUM(netsale) AS netsale FROM sales_e GROUP BY orderid"
    return O.with_(O.SALES, O.CAMPAIGNS) + f"""
, amounts AS ({amounts}),
att AS (SELECT a.orderid, a.campaignid, p.netsale FROM attribution a
        LEFT JOIN amounts p ON a.orderid IS NOT DISTINCT FROM p.orderid),
perf0 AS (SELECT campaignid, COALESCE(SUM(netsale), 0) AS net, COUNT(DISTINCT orderid) AS conv
          FROM att WHERE campaignid IS NOT NULL GROUP BY campaignid),
perf AS (
  SELECT c.campaignid, c.campaignname, c.channel, c.startdate, c.enddate, c.totalcost, c.impressions, c.clicks,
         COALESCE(p.net, 0) AS netsale, COALESCE(p.conv, 0) AS conversions,
         {O.ratio('COALESCE(p.net, 0)', 'c.totalcost')} AS roas,
         {O.ratio('c.totalcost', 'COALESCE(p.conv, 0)')} AS cpa
  FROM campaigns c LEFT JOIN perf0 p ON c.campaignid = p.campaignid)
"""


_PERF_OUT = """SELECT campaignid, campaignname, channel, CAST(startdate AS TIMESTAMP) AS startdate,
       CAST(enddate AS TIMESTAMP) AS enddate, CAST(totalcost AS DOUBLE) AS totalcost,
       impressions, clicks, CAST(netsale AS DOUBLE) AS netsale, conversions, roas, cpa FROM perf"""


def _perf(spark, sf_dir, mode="pairs"):
    t = A.DriverTables(spark, sf_dir)
    sales = _sales(spark, sf_dir, with_part=False, with_city=False)
    return M.campaign_performance(sales, A.marketing_campaigns(t), A.marketing_attribution(t), mode)


@query("campaign_performance", _perf_sql("pairs") + _PERF_OUT)
def q_campaign_performance(spark, sf_dir):
    return _out(_perf(spark, sf_dir))


@query("campaign_performance_by_order", _perf_sql("order") + _PERF_OUT)
def q_campaign_performance_by_order(spark, sf_dir):
    return _out(_perf(spark, sf_dir, "order"))


@query("marketing_totals", _perf_sql("pairs") + f"""
SELECT {O.msum('totalcost')} AS total_spend, {O.msum('netsale')} AS total_revenue,
       CASE WHEN {O.msum('totalcost')} <= 0 THEN CAST(0.0 AS DOUBLE)
            ELSE {O.msum('netsale')} / {O.msum('totalcost')} END AS overall_roas,
       CAST(COALESCE(SUM(conversions), 0) AS BIGINT) AS total_conversions,
       CASE WHEN COALESCE(SUM(conversions), 0) <= 0 THEN CAST(0.0 AS DOUBLE)
            ELSE {O.msum('totalcost')} / CAST(COALESCE(SUM(conversions), 0) AS DOUBLE) END AS avg_cpa
FROM perf""")
def q_marketing_totals(spark, sf_dir):
    return M.marketing_totals(_perf(spark, sf_dir))


@query("campaign_ratios", _perf_sql("pairs") + """
SELECT campaignid, campaignname, channel, roas, cpa FROM perf""")
def q_campaign_ratios(spark, sf_dir):
    return M.campaign_ratios(_perf(spark, sf_dir))


@query("conversions_by_channel", _perf_sql("pairs") + """
SELECT channel, CAST(SUM(conversions) AS BIGINT) AS conversions FROM perf WHERE channel IS NOT NULL GROUP BY channel""")
def q_conversions_by_channel(spark, sf_dir):
    return M.conversions_by_channel(_perf(spark, sf_dir))


# ----------------------------------------------------------------------------- profit

_LINES = """
, lines AS (
  SELECT *, netsale - costofgoodssold AS net_profit,
         CASE WHEN netsale = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE CAST(netsale - costofgoodssold AS DOUBLE) / CAST(netsale AS DOUBLE) * 100.0 END AS profit_margin,
         costofgoodssold AS total_cost
  FROM sales_e)
"""


def _lines(spark, sf_dir, with_city=False):
    return P.profit_lines(_sales(spark, sf_dir, with_city=with_city))


@query("profit_lines", O.with_(O.SALES) + _LINES + """
SELECT orderid, "timestamp", productid, productname, category, quantity,
       CAST(grossvalue AS DOUBLE) AS grossvalue, CAST(discountvalue AS DOUBLE) AS discountvalue,
       CAST(costofgoodssold AS DOUBLE) AS costofgoodssold, customerid, city, locationid, channel, orderstatus,
       CAST(netsale AS DOUBLE) AS netsale, CAST("date" AS TIMESTAMP) AS "date", week, "month",
       CAST(net_profit AS DOUBLE) AS net_profit, profit_margin, CAST(total_cost AS DOUBLE) AS total_cost
FROM lines""")
def q_profit_lines(spark, sf_dir):
    return _out(_lines(spark, sf_dir, with_city=True))


@query("profit_kpis", O.with_(O.SALES) + _LINES + f"""
SELECT COUNT(*) AS row_count, {O.msum('net_profit')} AS total_net_profit,
       round(AVG(profit_margin), 6) AS avg_profit_margin,
       CAST(COALESCE(SUM(total_cost) FILTER (WHERE orderstatus = 'Returned'), 0)
            + COALESCE(SUM(netsale) FILTER (WHERE orderstatus = 'Returned'), 0) AS DOUBLE) AS profit_lost_to_returns
FROM lines""")
def q_profit_kpis(spark, sf_dir):
    return P.profit_kpis(_lines(spark, sf_dir))


@query("profit_by_channel", O.with_(O.SALES) + _LINES + f"""
SELECT channel, {O.msum('net_profit')} AS net_profit FROM lines WHERE channel IS NOT NULL GROUP BY channel""")
def q_profit_by_channel(spark, sf_dir):
    return P.profit_by(_lines(spark, sf_dir), "channel")


@query("profit_by_category", O.with_(O.SALES) + _LINES + f"""
SELECT category, {O.msum('net_profit')} AS net_profit FROM lines WHERE category IS NOT NULL GROUP BY category""")
def q_profit_by_category(spark, sf_dir):
    return P.profit_by(_lines(spark, sf_dir), "category")


_MARGIN = """
, pm AS (SELECT productname, round(AVG(profit_margin), 6) AS profit_margin FROM lines
         WHERE productname IS NOT NULL GROUP BY productname)
"""


@query("margin_by_product", O.with_(O.SALES) + _LINES + _MARGIN + "SELECT * FROM pm")
def q_margin_by_product(spark, sf_dir):
    return P.margin_by_product(_lines(spark, sf_dir))


@query("top_margin_products", O.with_(O.SALES) + _LINES + _MARGIN + """
SELECT * FROM pm WHERE profit_margin IS NOT NULL ORDER BY profit_margin DESC, productname LIMIT 10""")
def q_top_margin_products(spark, sf_dir):
    return P.top_margin_products(_lines(spark, sf_dir), 10)


@query("low_margin_products", O.with_(O.SALES) + _LINES + _MARGIN + """
SELECT * FROM pm WHERE profit_margin IS NOT NULL ORDER BY profit_margin ASC, productname LIMIT 10""")
def q_low_margin_products(spark, sf_dir):
    return P.low_margin_products(_lines(spark, sf_dir), 10)


@query("recommendations", O.with_(O.SALES) + _LINES + _MARGIN + """
, tot AS (SELECT SUM(net_profit) AS np,
                 COALESCE(SUM(total_cost) FILTER (WHERE orderstatus = 'Returned'), 0)
                 + COALESCE(SUM(netsale) FILTER (WHERE orderstatus = 'Returned'), 0) AS lost FROM lines),
ch AS (SELECT MIN(channel) AS c FROM (SELECT channel, SUM(net_profit) AS np FROM lines
       WHERE channel IS NOT NULL GROUP BY channel) WHERE np < 0),
best AS (SELECT productname AS p FROM pm WHERE profit_margin IS NOT NULL
         ORDER BY profit_margin DESC, productname LIMIT 1),
r AS (
  SELECT 1 AS rule, 'High profit loss from returns detected. Investigate top returned products/categories.' AS message
  FROM tot WHERE np > 0 AND lost > np * 0.1
  UNION ALL SELECT 2, 'Channel ''' || c || ''' is unprofitable. Review marketing strategy.' FROM ch WHERE c IS NOT NULL
  UNION ALL SELECT 3, '''' || p || ''' has a high margin. Consider promoting it.' FROM best)
SELECT * FROM r
UNION ALL SELECT 0, 'No critical issues detected.' WHERE NOT EXISTS (SELECT 1 FROM r)""")
def q_recommendations(spark, sf_dir):
    return P.recommendations(_lines(spark, sf_dir))


# ----------------------------------------------------------------------------- competitors

def _ours(spark, sf_dir):
    return _sales(spark, sf_dir, with_city=False)


def _competitors(spark, sf_dir):
    return A.competitors(A.DriverTables(spark, sf_dir))


_PRICE = O.with_(O.SALES, O.COMPETITORS) + f"""
, ours AS (SELECT productname, CAST(SUM(grossvalue) AS DOUBLE) / CAST(NULLIF(SUM(quantity), 0) AS DOUBLE) AS our_price
           FROM sales_e WHERE productname IS NOT NULL GROUP BY productname),
theirs AS (SELECT productname, CAST(SUM(price) AS DOUBLE) / CAST(NULLIF(COUNT(price), 0) AS DOUBLE)
             AS avg_competitor_price
           FROM competitors WHERE productname IS NOT NULL GROUP BY productname),
cmp AS (SELECT o.productname, o.our_price, t.avg_competitor_price,
               o.our_price - t.avg_competitor_price AS price_difference
        FROM ours o JOIN theirs t ON o.productname = t.productname)
"""


@query("price_comparison", _PRICE + "SELECT * FROM cmp")
def q_price_comparison(spark, sf_dir):
    return CP.price_comparison(_ours(spark, sf_dir), _competitors(spark, sf_dir))


@query("price_position", _PRICE + """
SELECT COUNT(*) FILTER (WHERE price_difference < 0) AS products_cheaper,
       COUNT(*) FILTER (WHERE price_difference > 0) AS products_pricier,
       MAX(our_price) AS max_our_price FROM cmp""")
def q_price_position(spark, sf_dir):
    return CP.price_position(CP.price_comparison(_ours(spark, sf_dir), _competitors(spark, sf_dir)))


@query("promo_rate", O.with_(O.COMPETITORS) + """
SELECT CASE WHEN COUNT(*) = 0 THEN NULL
            ELSE CAST(COUNT(*) FILTER (WHERE onpromotion) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 END
         AS promo_rate FROM competitors""")
def q_promo_rate(spark, sf_dir):
    return CP.promo_rate(_competitors(spark, sf_dir))


@query("promo_by_competitor", O.with_(O.COMPETITORS) + """
SELECT competitor,
       CAST(COUNT(*) FILTER (WHERE onpromotion) AS DOUBLE) / CAST(COUNT(onpromotion) AS DOUBLE) * 100 AS promo_rate
FROM competitors WHERE competitor IS NOT NULL GROUP BY competitor""")
def q_promo_by_competitor(spark, sf_dir):
    return CP.promo_by_competitor(_competitors(spark, sf_dir))


def _overlap_sql(a: str, b: str) -> str:
    return O.with_(O.SALES, O.COMPETITORS) + f"""
, o AS (SELECT DISTINCT productname FROM sales_e WHERE productname IS NOT NULL),
ra AS (SELECT DISTINCT productname FROM competitors WHERE competitor = '{a}' AND productname IS NOT NULL),
rb AS (SELECT DISTINCT productname FROM competitors WHERE competitor = '{b}' AND productname IS NOT NULL),
u AS (SELECT productname FROM o UNION SELECT productname FROM ra UNION SELECT productname FROM rb),
f AS (SELECT u.productname,
             u.productname IN (SELECT productname FROM o) AS io,
             u.productname IN (SELECT productname FROM ra) AS ia,
             u.productname IN (SELECT productname FROM rb) AS ib FROM u),
reg AS (
  SELECT 1 AS position, 'Ours Only' AS region, COUNT(*) FILTER (WHERE io AND NOT ia AND NOT ib) AS products FROM f
  UNION ALL SELECT 2, '{a} Only', COUNT(*) FILTER (WHERE ia AND NOT io AND NOT ib) FROM f
  UNION ALL SELECT 3, '{b} Only', COUNT(*) FILTER (WHERE ib AND NOT io AND NOT ia) FROM f
  UNION ALL SELECT 4, 'Ours & {a}', COUNT(*) FILTER (WHERE io AND ia AND NOT ib) FROM f
  UNION ALL SELECT 5, 'Ours & {b}', COUNT(*) FILTER (WHERE io AND ib AND NOT ia) FROM f
  UNION ALL SELECT 6, '{a} & {b}', COUNT(*) FILTER (WHERE ia AND ib AND NOT io) FROM f
  UNION ALL SELECT 7, 'All Three', COUNT(*) FILTER (WHERE io AND ia AND ib) FROM f)
SELECT * FROM reg"""


@query("assortment_overlap", _overlap_sql(*A.RIVAL_BRANDS))
def q_assortment_overlap(spark, sf_dir):
    return CP.assortment_overlap(_ours(spark, sf_dir), _competitors(spark, sf_dir), *A.RIVAL_BRANDS)


# ----------------------------------------------------------------------------- churn

def _features(spark, sf_dir):
    return CH.churn_features(_sales(spark, sf_dir, with_part=False, with_city=False), _customers(spark, sf_dir))


_FEATURES_SQL = O.with_(O.SALES, O.CUSTOMERS) + f"""
, snap AS (SELECT MAX("timestamp") + INTERVAL 1 DAY AS t FROM sales_e),
pc AS (SELECT customerid, MAX("timestamp") AS last_ts, COUNT(DISTINCT orderid) AS frequency,
              COALESCE(SUM(netsale), 0) AS money, SUM(netsale) AS net, COUNT(netsale) AS net_n,
              COALESCE(SUM(quantity), 0) AS qty
       FROM sales_e WHERE customerid IS NOT NULL GROUP BY customerid),
f AS (SELECT pc.customerid,
             CAST(floor(date_diff('second', pc.last_ts, s.t) / 86400) AS BIGINT) AS recency,
             pc.frequency, CAST(pc.money AS DOUBLE) AS monetary_value,
             CAST(pc.net AS DOUBLE) / CAST(NULLIF(pc.net_n, 0) AS DOUBLE) AS avg_basket_value,
             CAST(pc.qty AS BIGINT) AS total_quantity,
             CAST(floor(date_diff('second', c.joindate, s.t) / 86400) AS BIGINT) AS tenure_days,
             CASE WHEN c.segment = 'Silver' THEN 1 ELSE 0 END AS segment_silver,
             CASE WHEN c.segment = 'Gold' THEN 1 ELSE 0 END AS segment_gold
      FROM pc JOIN customers c ON pc.customerid = c.customerid CROSS JOIN snap s)
SELECT *, CASE WHEN recency > {CH.CHURN_DAYS} THEN 1 ELSE 0 END AS churn FROM f"""


@query("churn_features", _FEATURES_SQL)
def q_churn_features(spark, sf_dir):
    return _features(spark, sf_dir)


def _split_sql(rest: str) -> str:
    """The features with the part that the split gives them, then ``rest``."""
    return _FEATURES_SQL.replace("\nSELECT *, CASE", ",\nlabelled AS (SELECT *, CASE") + f"""),
parts AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY
    CAST('0x' || substr(md5(CAST(customerid AS VARCHAR) || '|{CH.SEED}|' || CAST(churn AS VARCHAR)), 1, {CH.HASH_DIGITS}) AS BIGINT), customerid)
  <= (count(*) OVER (PARTITION BY churn) * {CH.TRAIN_SHARE} + 5) // 10 AS training FROM labelled)
""" + rest


@query("churn_split_counts", _split_sql("""
SELECT churn, CASE WHEN training THEN 'train' ELSE 'test' END AS part, COUNT(*) AS customers FROM parts GROUP BY ALL"""))
def q_churn_split_counts(spark, sf_dir):
    return CH.split_counts(CH.checkpointed(_features(spark, sf_dir)))


@query("churn_class_weights", _split_sql("""
SELECT churn, CAST((SELECT COUNT(*) FROM parts WHERE training) AS DOUBLE) / (2.0 * COUNT(*)) AS class_weight
FROM parts WHERE training GROUP BY churn"""))
def q_churn_class_weights(spark, sf_dir):
    return CH.class_weights(CH.split_train_test(CH.checkpointed(_features(spark, sf_dir)))[0])


@query("churn_scaler_stats", _split_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(AVG(CAST(COALESCE({c}, 0) AS DOUBLE)), 4) AS mean, "
    f"round(stddev_pop(CAST(COALESCE({c}, 0) AS DOUBLE)), 4) AS std FROM parts WHERE training" for c in CH.FEATURES)))
def q_churn_scaler_stats(spark, sf_dir):
    """The scaler of the trained model."""
    return CH.scaler_stats(_trained(spark, sf_dir)[0], spark)


@query("churn_support", _split_sql("""
SELECT churn AS label, COUNT(*) AS support FROM parts WHERE NOT training GROUP BY churn"""))
def q_churn_support(spark, sf_dir):
    """The labels of the test set, as the evaluation of a trained model counts them."""
    model, _, test = _trained(spark, sf_dir)
    return CH.evaluation(CH.score(model, test)).where("support > 0").select("label", "support")


def _scored_sql(rest: str, steps: int = 40) -> str:
    """The test of the solver: Newton's method as a recursive query, each step with its own elimination of the normal
    equations, then ``rest`` over ``scored`` (all customers) and ``tested`` (those that were not trained on)."""
    k = len(CH.FEATURES) + 1
    x = ", ".join(["1.0::DOUBLE", *[f"(COALESCE({c}, 0)::DOUBLE - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in CH.FEATURES]])
    stats = ", ".join(f"AVG(COALESCE({c}, 0)::DOUBLE) AS m_{c}, stddev_pop(COALESCE({c}, 0)::DOUBLE) AS s_{c}" for c in CH.FEATURES)
    rows = []
    for i in range(1, k + 1):
        cells = [f"SUM(w * p * (1 - p) * x[{i}] * x[{j}])" + (" + 1.0" if i == j else "") for j in range(1, k + 1)]
        rows.append(f"[{', '.join(cells)}, SUM(w * (p - y) * x[{i}]) + theta[{i}]]")
    solved = f"""SELECT step, theta, [{", ".join(rows)}] AS m
      FROM (SELECT step, theta, x, y, w, 1 / (1 + exp(-list_dot_product(x, theta))) AS p FROM newton, tr WHERE step < {steps}) GROUP BY step, theta"""
    for j in range(1, k + 1):
        solved = f"""SELECT step, theta, list_transform(m, lambda line, i: CASE WHEN i = {j} THEN list_transform(line, lambda v: v / m[{j}][{j}])
        ELSE list_transform(line, lambda v, c: v - line[{j}] * m[{j}][c] / m[{j}][{j}]) END) AS m FROM ({solved})"""
    sql = _split_sql(f""", st AS (SELECT {stats}, COUNT(*) AS n, COUNT(*) FILTER (churn = 1) AS n1 FROM parts WHERE training),
xs AS MATERIALIZED (SELECT customerid, churn, training, [{x}] AS x, churn::DOUBLE AS y, n / (2.0 * CASE WHEN churn = 1 THEN n1 ELSE n - n1 END) AS w FROM parts, st),
tr AS MATERIALIZED (SELECT x, y, w FROM xs WHERE training),
newton AS (SELECT 0 AS step, [{", ".join(["0.0::DOUBLE"] * k)}] AS theta
  UNION ALL SELECT step + 1, list_transform(theta, lambda t, i: t - m[i][{k + 1}]) FROM ({solved})),
scored AS MATERIALIZED (SELECT customerid, churn, training, 1 / (1 + exp(-list_dot_product(x, theta))) AS churn_probability
  FROM xs, (SELECT theta FROM newton WHERE step = {steps})),
tested AS (SELECT churn, CAST(churn_probability > 0.5 AS INTEGER) AS prediction FROM scored WHERE NOT training)
""" + rest)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_MODELS: dict = {}


def _trained(spark, sf_dir):
    """Model, features, test set and published store; trained once for the inputs as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, W.signature(W.input_state(spark, sf_dir, W.LINE_INPUTS)))
    if key not in _MODELS:
        feats = CH.checkpointed(_features(spark, sf_dir))
        train, test = CH.split_train_test(feats)
        _MODELS[key] = (CH.fit_churn_model(train), feats, test)
    return _MODELS[key]


def _published(spark, sf_dir) -> ING.TableStore:
    """P10: a store with the trained model's scores."""
    model, feats, _ = _trained(spark, sf_dir)
    store = ING.TableStore(spark, unique_dir(spark, "churn-store"))
    CH.publish_scores(store, model, feats)
    return store


@query("churn_confusion", _scored_sql("""
SELECT label, prediction, (SELECT COUNT(*) FROM tested t WHERE t.churn = a.label AND t.prediction = b.prediction) AS count
FROM (SELECT unnest([0, 1]) AS label) a, (SELECT unnest([0, 1]) AS prediction) b"""))
def q_churn_confusion(spark, sf_dir):
    model, _, test = _trained(spark, sf_dir)
    return CH.confusion(CH.score(model, test))


@query("churn_evaluation", _scored_sql("""
, c AS (SELECT unnest([0, 1]) AS label),
e AS (SELECT label, COUNT(*) FILTER (churn = label AND prediction = label)::DOUBLE AS tp, COUNT(*) FILTER (churn <> label AND prediction = label)::DOUBLE AS fp,
  COUNT(*) FILTER (churn = label AND prediction <> label)::DOUBLE AS fn, COUNT(*) FILTER (churn = prediction)::DOUBLE / COUNT(*) AS accuracy FROM c, tested GROUP BY label),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM e)
SELECT accuracy, label, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
  CAST(tp + fn AS BIGINT) AS support FROM r"""))
def q_churn_evaluation(spark, sf_dir):
    model, _, test = _trained(spark, sf_dir)
    return CH.evaluation(CH.score(model, test))


@query("churn_scores", _scored_sql("SELECT customerid, round(churn_probability, 6) AS churn_probability FROM scored"))
def q_churn_scores(spark, sf_dir):
    model, feats, _ = _trained(spark, sf_dir)
    return CH.score(model, feats).select("customerid", F.round("churn_probability", 6).alias("churn_probability"))


@query("churn_published_scores", _scored_sql("SELECT CAST(customerid AS VARCHAR) AS customerid, round(churn_probability, 6) AS churn_probability FROM scored"))
def q_churn_published_scores(spark, sf_dir):
    """Model and scores published in one snapshot, a second round of scoring over the same features, and the
    scores loaded from the store."""
    store = _published(spark, sf_dir)
    CH.rescore(store, _trained(spark, sf_dir)[1])
    return ING.load_predictions(store).withColumn("churn_probability", F.round("churn_probability", 6))


@query("churn_risk_bands", _scored_sql("""
SELECT 1 AS position, 'High' AS band, COUNT(*) FILTER (churn_probability > 0.7) AS customers FROM scored
UNION ALL SELECT 2, 'Medium', COUNT(*) FILTER (churn_probability > 0.4 AND churn_probability <= 0.7) FROM scored
UNION ALL SELECT 3, 'Low', COUNT(*) FILTER (churn_probability <= 0.4) FROM scored"""))
def q_churn_risk_bands(spark, sf_dir):
    """P11 over the published scores of the trained model."""
    return CH.risk_bands(ING.load_predictions(_published(spark, sf_dir)))


@query("churn_risk_histogram", _scored_sql(f"""
, n AS (SELECT CAST(LEAST(GREATEST(floor(churn_probability * {CH.HIST_BINS}.0), 0), {CH.HIST_BINS - 1}) AS INTEGER) AS bin, COUNT(*) AS customers FROM scored GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bin, CAST(r.i AS DOUBLE) / {CH.HIST_BINS}.0 AS bin_start, CAST(r.i + 1 AS DOUBLE) / {CH.HIST_BINS}.0 AS bin_end,
  COALESCE(n.customers, 0) AS customers FROM range({CH.HIST_BINS}) r(i) LEFT JOIN n ON n.bin = r.i"""))
def q_churn_risk_histogram(spark, sf_dir):
    """P12 over the published scores of the trained model."""
    return CH.risk_histogram(ING.load_predictions(_published(spark, sf_dir)))


@query("churn_high_risk", _scored_sql("""
SELECT CAST(customerid AS VARCHAR) AS customerid, round(churn_probability, 6) AS churn_probability FROM scored WHERE churn_probability > 0.7"""))
def q_churn_high_risk(spark, sf_dir):
    """K10 over the published scores of the trained model."""
    out = CH.high_risk_customers(ING.load_predictions(_published(spark, sf_dir)))
    return out.withColumn("churn_probability", F.round("churn_probability", 6))


def _predictions(spark, sf_dir):
    return A.predictions(A.DriverTables(spark, sf_dir))


@query("risk_bands", O.with_(O.PREDICTIONS) + """
SELECT 1 AS position, 'High' AS band, COUNT(*) FILTER (WHERE churn_probability > 0.7) AS customers FROM predictions
UNION ALL SELECT 2, 'Medium', COUNT(*) FILTER (WHERE churn_probability > 0.4 AND churn_probability <= 0.7)
  FROM predictions
UNION ALL SELECT 3, 'Low', COUNT(*) FILTER (WHERE churn_probability <= 0.4) FROM predictions""")
def q_risk_bands(spark, sf_dir):
    return CH.risk_bands(_predictions(spark, sf_dir))


@query("risk_histogram", O.with_(O.PREDICTIONS) + f"""
, b AS (SELECT CAST(LEAST(GREATEST(floor(churn_probability * {CH.HIST_BINS}.0), 0), {CH.HIST_BINS - 1}) AS INTEGER)
          AS bin FROM predictions WHERE churn_probability IS NOT NULL),
n AS (SELECT bin, COUNT(*) AS customers FROM b GROUP BY bin)
SELECT CAST(r.i AS INTEGER) AS bin, CAST(r.i AS DOUBLE) / {CH.HIST_BINS}.0 AS bin_start,
       CAST(r.i + 1 AS DOUBLE) / {CH.HIST_BINS}.0 AS bin_end, COALESCE(n.customers, 0) AS customers
FROM range({CH.HIST_BINS}) r(i) LEFT JOIN n ON n.bin = r.i""")
def q_risk_histogram(spark, sf_dir):
    return CH.risk_histogram(_predictions(spark, sf_dir))


@query("high_risk_customers", O.with_(O.PREDICTIONS) + """
SELECT customerid, churn_probability FROM predictions WHERE churn_probability > 0.7""")
def q_high_risk_customers(spark, sf_dir):
    return CH.high_risk_customers(_predictions(spark, sf_dir))


# ----------------------------------------------------------------------------- KPI text (E14), empty ranges (F8)

#: DuckDB formats of the KPI styles.
_SQL_STYLES = {"amount": "{:,.2f} SAR", "percent": "{:.2f}%", "multiple": "{:.2f}x", "days": "{:.2f} Days", "count": "{:,}"}

TAB_STYLES = {
    "delivery_kpis": {"on_time_rate": "percent", "avg_delivery_days": "days", "failed_rate": "percent", "avg_delivery_cost": "amount"},
    "customer_status_counts": {"total_customers": "count", "active_customers": "count", "dormant_customers": "count",
                               "churn_risk_customers": "count", "new_customers": "count"},
    "marketing_totals": {"total_spend": "amount", "total_revenue": "amount", "overall_roas": "multiple", "avg_cpa": "amount"},
    "profit_kpis": {"total_net_profit": "amount", "avg_profit_margin": "percent", "profit_lost_to_returns": "amount"},
    "risk_bands": {"customers": "count"},
}


def _register_text(name: str, styles: dict) -> None:
    texts = ", ".join(f"COALESCE(format('{_SQL_STYLES[kind]}', {c}), '-') AS {c}_text" for c, kind in styles.items())
    extra = ["band"] if name == "risk_bands" else []

    @query(f"{name}_text", f"SELECT {', '.join([*extra, texts])} FROM ({ORACLE[name]}) k")
    def q_text(spark, sf_dir):
        return X.with_kpi_text(QUERIES[name](spark, sf_dir), styles).select(*extra, *[f"{c}_text" for c in styles])


for _name, _styles in TAB_STYLES.items():
    _register_text(_name, _styles)


_KPI_MEASURES = ("total_revenue", "total_cogs", "net_profit", "gross_margin", "total_orders", "aov", "returned_orders", "return_rate")


@query("sales_kpis_no_data", O.with_(O.SALES) + f"""
, k AS ({_KPI_SQL.replace("{where}", "date BETWEEN DATE '1900-01-01' AND DATE '1900-12-31'")})
SELECT row_count, {", ".join(f"CASE WHEN row_count > 0 THEN {c} END AS {c}" for c in _KPI_MEASURES)} FROM k""")
def q_sales_kpis_no_data(spark, sf_dir):
    """F8: a range without sales gives row_count 0 and null measures."""
    return S.sales_kpis(S.filter_sales(_sales(spark, sf_dir, with_city=False, start="1900-01-01", end="1900-12-31"), "1900-01-01", "1900-12-31"))


# ----------------------------------------------------------------------------- ingest and streaming

def _masters(spark, sf_dir) -> dict[str, DataFrame]:
    t = A.DriverTables(spark, sf_dir)
    # a quote and a comma in every third name, so that the files have quoted fields
    return {
        "sales": A.sales(t),
        "deliveries": A.deliveries(t),
        "customers": A.customers(t),
        "sales_funnel": A.sales_funnel(t),
        "marketing_campaigns": A.marketing_campaigns(t),
        "marketing_attribution": A.marketing_attribution(t),
        "competitors": A.competitors(t).withColumn("productname", F.when(
            F.col("productid") % 3 == 0, F.concat(F.lit('"'), "productname", F.lit('", big'))).otherwise(F.col("productname"))),
    }


def _rebuilt(spark, sf_dir, *names: str) -> ING.TableStore:
    """Some tables written as reference-style master CSV files and rebuilt from them."""
    root = unique_dir(spark, "ingest")
    masters = _masters(spark, sf_dir)
    for name in names:
        spec = SCH.spec_for(name)
        ING.write_csv(ING.rename_headers(masters[name], spec), f"{root}/masters/{spec.master_file}", packed=True)
    store = ING.TableStore(spark, f"{root}/tables")
    ING.bootstrap(store, f"{root}/masters", {n: SCH.spec_for(n) for n in names})
    return store


_INGESTED_SALES_SQL = O.with_(O.SALES) + """
SELECT CAST(orderid AS VARCHAR) AS orderid, CAST(productid AS VARCHAR) AS productid, productname, category,
       quantity, CAST(grossvalue AS DOUBLE) AS grossvalue, CAST(discountvalue AS DOUBLE) AS discountvalue,
       CAST(costofgoodssold AS DOUBLE) AS costofgoodssold, CAST(customerid AS VARCHAR) AS customerid, city,
       CAST(locationid AS VARCHAR) AS locationid, channel, orderstatus, "timestamp",
       CAST(netsale AS DOUBLE) AS netsale, CAST("date" AS TIMESTAMP) AS "date", week, "month"
FROM sales_e"""


def _ingested(df: DataFrame) -> DataFrame:
    """An ingested sales table as the driver sees it: bookkeeping columns
    dropped, derived columns recomputed, driver-facing types."""
    return _out(S.enrich_sales(df.drop("_source_file", "_batch_id")))


@query("ingest_roundtrip", _INGESTED_SALES_SQL)
def q_ingest_roundtrip(spark, sf_dir):
    """Table -> master CSV -> full rebuild -> safe load.
    Ids come back as text (the declared CSV types); every value must survive."""
    return _ingested(ING.load_table_safely(_rebuilt(spark, sf_dir, "sales"), "sales"))


def _columns_sql(spec: SCH.TableSpec) -> str:
    """The canonical columns of a table as the driver sees them after ingest."""
    out = []
    for c, kind in spec.types.items():
        as_kind = {"string": "VARCHAR", "date": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT", "int": "INTEGER",
                   "boolean": "BOOLEAN"}.get(kind, "DOUBLE")
        out.append(f'CAST("{c}" AS {as_kind}) AS "{c}"')
    return ", ".join(out)


def _register_ingest(name: str, ctes: list[str], source: str) -> None:
    @query(f"ingest_{name}", O.with_(*ctes) + f"SELECT {_columns_sql(SCH.spec_for(name))} FROM {source}")
    def q_ingest(spark, sf_dir):
        return _out(ING.load_table_safely(_rebuilt(spark, sf_dir, name), name).select(*SCH.spec_for(name).types))


for _name, _ctes, _source in (
        ("deliveries", [O.DELIVERIES], "deliveries"), ("customers", [O.CUSTOMERS], "customers"), ("sales_funnel", [O.FUNNEL], "funnel"),
        ("marketing_campaigns", [O.CAMPAIGNS], "campaigns"), ("marketing_attribution", [O.CAMPAIGNS], "attribution"),
        ("competitors", [O.COMPETITORS], """(SELECT NULL AS "date", competitor, productid, price, onpromotion,
          CASE WHEN productid % 3 = 0 THEN '"' || productname || '", big' ELSE productname END AS productname FROM competitors)""")):
    _register_ingest(_name, _ctes, _source)


_INGEST_TABLES = ("sales", "deliveries", "customers", "sales_funnel", "marketing_campaigns", "marketing_attribution", "competitors")


@query("refresh_counts", O.with_(O.SALES, O.DELIVERIES, O.CUSTOMERS, O.FUNNEL, O.CAMPAIGNS, O.COMPETITORS) + "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {source}" for name, source in zip(
        _INGEST_TABLES, ("sales_e", "deliveries", "customers", "funnel", "campaigns", "attribution", "competitors"))))
def q_refresh_counts(spark, sf_dir):
    """Rows of every ingested table after a rebuild of all of them in one snapshot."""
    frames = ING.refresh_all(_rebuilt(spark, sf_dir, *_INGEST_TABLES))
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).cast("bigint").alias("row_count")) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counts)


@query("ingest_inferred", """
SELECT CAST(c_custkey AS VARCHAR) AS customerid, CAST(c_nationkey AS BIGINT) AS points, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance,
  c_acctbal > 0 AS solvent, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'n' || c_custkey END AS code, c_name AS note,
  CAST(NULL AS DOUBLE) AS nothing FROM customer""")
def q_ingest_inferred(spark, sf_dir):
    """A customer master file with columns that no spec names; they come back under the types of their values."""
    root, spec = unique_dir(spark, "inferred"), SCH.spec_for("customers")
    key = F.col("c_custkey")
    more = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select(
        key.alias(spec.aliases["customerid"][0]), F.col("c_nationkey").alias("points"), F.when(key % 7 != 0, F.col("c_acctbal")).alias("balance"),
        (F.col("c_acctbal") > 0).alias("solvent"), F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit("n"), key)).alias("code"),
        F.col("c_name").alias("note"), F.lit(None).cast("string").alias("nothing"))
    ING.write_csv(more, f"{root}/masters/{spec.master_file}")
    store = ING.TableStore(spark, f"{root}/tables")
    ING.bootstrap(store, f"{root}/masters", {"customers": spec})
    return ING.load_table_safely(store, "customers")


@query("predictions_stored", O.with_(O.PREDICTIONS) + """
SELECT CAST(customerid AS VARCHAR) AS customerid, churn_probability FROM predictions""")
def q_predictions_stored(spark, sf_dir):
    """The score table, written and loaded again."""
    store = ING.TableStore(spark, unique_dir(spark, "scores"))
    store.write(_predictions(spark, sf_dir).withColumn("customerid", F.col("customerid").cast("string")), SCH.PREDICTIONS_TABLE, "overwrite")
    return ING.load_predictions(store)


_EXPORTS = ("top_value", "churn_risk", "new")


_EXPORT_TYPES = {"customerid": "string", "city": "string", "segment": "string", "status": "string", "frequency": "bigint", "monetary": "double",
                 "recency": "bigint", "joindate": "string", "position": "bigint", "churn_probability": "double"}


@query("customer_exports", "SELECT * FROM (" + _status_sql() + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY monetary DESC NULLS LAST, customerid) AS position FROM status),
x AS (SELECT 'top_value' AS list, * FROM ranked
  UNION ALL SELECT 'churn_risk', * REPLACE (NULL AS position) FROM ranked WHERE status = 'Churn Risk'
  UNION ALL SELECT 'new', * REPLACE (NULL AS position) FROM ranked WHERE status = 'New')
SELECT list, CAST(customerid AS VARCHAR) AS customerid, city, segment, status, CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS DOUBLE) AS monetary,
  recency, strftime(joindate, '%Y-%m-%d %H:%M:%S') AS joindate, position, CAST(NULL AS DOUBLE) AS churn_probability FROM x)
UNION ALL SELECT * FROM (""" + _scored_sql("""
SELECT 'high_risk' AS list, CAST(customerid AS VARCHAR) AS customerid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(churn_probability, 6)
FROM scored WHERE churn_probability > 0.7""") + ")")
def q_customer_exports(spark, sf_dir):
    """The three customer lists and the high-risk list (from the published scores), exported as CSV and read back
    with all their columns; the first list's order is its position."""
    root, status = unique_dir(spark, "exports"), _status(spark, sf_dir)
    lists = {k: C.customer_list(status, k) for k in _EXPORTS}
    lists["high_risk"] = CH.high_risk_customers(ING.load_predictions(_published(spark, sf_dir)))
    out = []
    for name, df in lists.items():
        path = ING.export_csv(df, root, name, day="2025-01-01")
        if path:
            back = ING.align_to(ING.read_csv(spark, path), list(_EXPORT_TYPES))
            out.append(back.select(F.lit(name).alias("list"), *[F.col(c).cast(t).alias(c) for c, t in _EXPORT_TYPES.items()]))
    empty = spark.createDataFrame([], "list string, " + ", ".join(f"{c} {t}" for c, t in _EXPORT_TYPES.items()))
    return reduce(DataFrame.unionByName, out, empty).withColumn("churn_probability", F.round("churn_probability", 6))


@query("stream_ingest", _INGESTED_SALES_SQL)
def q_stream_ingest(spark, sf_dir):
    """Order lines dropped as several ``sales_*.csv`` files, ingested by the
    file stream (availableNow), then read back from the table."""
    root = unique_dir(spark, "stream")
    staging = f"{root}/staging"
    incoming = f"{root}/incoming"
    sales = A.sales(A.DriverTables(spark, sf_dir))
    ING.write_csv(ING.rename_headers(sales, SCH.REGISTRY["sales"]), staging)
    FI.publish_parts(spark, staging, incoming, "sales_part")
    store = ING.TableStore(spark, f"{root}/tables")
    FI.run_once(spark, incoming, store, f"{root}/archive")
    return _ingested(ING.load_table_safely(store, "sales"))


#: Key, label and measure of every ingested table, for the mixed stream.
_STREAMED = {"sales": ("orderid", "channel", "grossvalue"), "deliveries": ("deliveryid", "status", "deliverycost"),
             "customers": ("customerid", "segment", None), "sales_funnel": ("week", None, "visits"),
             "marketing_campaigns": ("campaignid", "channel", "totalcost"), "marketing_attribution": ("orderid", "campaignid", None),
             "competitors": ("productid", "competitor", "price")}
_STREAM_SOURCES = {"sales": "sales_e", "sales_funnel": "funnel", "marketing_campaigns": "campaigns", "marketing_attribution": "attribution"}


def _streamed_sql() -> str:
    def one(name: str) -> str:
        key, label, measure = _STREAMED[name]
        return (f"SELECT '{name}' AS table_name, CAST({key} AS VARCHAR) AS key, {f'CAST({label} AS VARCHAR)' if label else 'NULL'} AS label, "
                f"{f'CAST({measure} AS DOUBLE)' if measure else 'NULL'} AS measure FROM {_STREAM_SOURCES.get(name, name)}")
    return O.with_(O.SALES, O.DELIVERIES, O.CUSTOMERS, O.FUNNEL, O.CAMPAIGNS, O.COMPETITORS) + "\nUNION ALL ".join(map(one, _STREAMED))


@query("stream_all_tables", _streamed_sql())
def q_stream_all_tables(spark, sf_dir):
    """Files of all seven tables lie mixed in the incoming folder; one run of the stream stores each where its
    name says. Every row is read back."""
    root, masters = unique_dir(spark, "stream-all"), _masters(spark, sf_dir)
    for name in _INGEST_TABLES:
        spec = SCH.spec_for(name)
        ING.write_csv(ING.rename_headers(masters[name], spec), f"{root}/staging/{name}", packed=True)
        FI.publish_parts(spark, f"{root}/staging/{name}", f"{root}/incoming", f"{spec.file_prefix}drop")
    store = ING.TableStore(spark, f"{root}/tables")
    FI.run_once(spark, f"{root}/incoming", store, f"{root}/archive")
    out = []
    for name, (key, label, measure) in _STREAMED.items():
        df = ING.load_table_safely(store, name)
        out.append(df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"),
                             (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
                             (F.col(measure) if measure else F.lit(None)).cast("double").alias("measure")))
    return reduce(DataFrame.unionByName, out)


@query("refresh_incremental", _INGESTED_SALES_SQL)
def q_refresh_incremental(spark, sf_dir):
    """The sales up to the last day are rebuilt from a master file and derived by month; the last day's file comes
    by the stream, and a second refresh rewrites its month only. The derived table is the whole of the sales."""
    root, sales = unique_dir(spark, "refresh"), A.sales(A.DriverTables(spark, sf_dir))
    spec = SCH.spec_for("sales")
    last = F.to_date(spec.aliases["timestamp"][0]) == sales.agg(F.max(F.col("timestamp").cast("date"))).scalar()
    ING.write_csv_split(ING.rename_headers(sales, spec).withColumn("_last", last), "_last",
                        {False: f"{root}/masters/{spec.master_file}", True: f"{root}/staging"}, f"{root}/split")
    store = ING.TableStore(spark, f"{root}/tables")
    ING.bootstrap(store, f"{root}/masters", {"sales": spec})
    R.refresh(store)
    FI.publish_parts(spark, f"{root}/staging", f"{root}/incoming", "sales_day")
    FI.run_once(spark, f"{root}/incoming", store, f"{root}/archive")
    R.refresh(store)
    return _out(R.months(store, "sales_months"))
