"""Independent DuckDB SQL for every SQL-expressible registered query.

The driver registers the raw parquet tables as views; each statement below
re-derives the canonical frames from them (the same mapping as
``sources.adapters``) and then states the operator the plain SQL way
(``COUNT(DISTINCT ..)`` instead of our per-order pre-aggregation, separate
GROUP BYs instead of grouping sets), so a match checks the Spark plan rather
than repeating it.

Output rules shared with the Spark side: money is summed as DECIMAL and cast
to DOUBLE at the end; ratios divide DOUBLEs; means of DOUBLE columns are
rounded to 6 places; counts are BIGINT.
"""

from __future__ import annotations

SALES = """
sales AS (
  SELECT l.l_orderkey AS orderid,
         o.o_orderdate AS "timestamp",
         l.l_partkey AS productid,
         p.p_name AS productname,
         p.p_type AS category,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS grossvalue,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))
           AS discountvalue,
         CAST(CAST(l.l_quantity AS DECIMAL(6,0)) * CAST(p.p_retailprice AS DECIMAL(10,2)) AS DECIMAL(18,4))
           AS costofgoodssold,
         o.o_custkey AS customerid,
         n.n_name AS city,
         l.l_suppkey AS locationid,
         o.o_orderpriority AS channel,
         CASE WHEN l.l_returnflag = 'R' THEN 'Returned' ELSE 'Completed' END AS orderstatus
  FROM lineitem l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
sales_e AS (
  SELECT *,
         grossvalue - discountvalue AS netsale,
         CAST("timestamp" AS DATE) AS "date",
         strftime(date_trunc('week', "timestamp"), '%Y-%m-%d') || '/' ||
           strftime(date_trunc('week', "timestamp") + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
         strftime("timestamp", '%Y-%m') AS "month"
  FROM sales
)"""

DELIVERIES = """
deliveries AS (
  SELECT concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR)) AS deliveryid,
         l.l_orderkey AS orderid,
         CAST(o.o_orderdate AS DATE) AS orderdate,
         CAST(o.o_orderdate AS DATE) + 5 AS promiseddate,
         CASE WHEN l.l_linestatus = 'F'
              THEN CAST(o.o_orderdate AS DATE) + CAST(1 + (l.l_partkey + l.l_linenumber) % 9 AS INTEGER) END
           AS actualdeliverydate,
         CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'R' THEN 'Failed'
              WHEN l.l_linestatus = 'F' THEN 'Delivered'
              WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'N' THEN 'Pending'
              ELSE 'Shipped' END AS status,
         r.r_name AS deliverypartner,
         n.n_name AS city,
         CAST(CAST(1500 + (l.l_suppkey * 7 + l.l_linenumber) % 1000 AS DECIMAL(12,0)) / 100 AS DECIMAL(10,2))
           AS deliverycost
  FROM lineitem l
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
),
deliveries_e AS (
  SELECT *,
         orderdate AS "date",
         date_diff('day', orderdate, actualdeliverydate) AS delivery_time_days,
         COALESCE(actualdeliverydate <= promiseddate, FALSE) AS on_time
  FROM deliveries
)"""

CUSTOMERS = """
customers AS (
  SELECT c.c_custkey AS customerid,
         CAST(DATE '1995-01-01' + CAST((c.c_custkey * 37) % 2400 AS INTEGER) AS TIMESTAMP) AS joindate,
         n.n_name AS city,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Gold' WHEN 'BUILDING' THEN 'Silver' ELSE 'Bronze' END
           AS segment
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

FUNNEL = """
funnel AS (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week,
         COUNT(*) FILTER (WHERE event_type = 'view') AS visits,
         COUNT(*) FILTER (WHERE event_type = 'click') AS carts,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS orders
  FROM events GROUP BY 1
)"""

CAMPAIGNS = """
campaigns AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS campaignid, n.n_name AS campaignname, r.r_name AS channel,
         DATE '1995-01-01' AS startdate, DATE '2001-08-01' AS enddate,
         CAST(n.n_nationkey * 10000 AS DECIMAL(18,2)) AS totalcost,
         CAST((n.n_nationkey + 1) * 100000 AS BIGINT) AS impressions,
         CAST((n.n_nationkey + 1) * 2500 AS BIGINT) AS clicks
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
attribution AS (
  SELECT o_orderkey AS orderid, o_orderkey % 20 AS campaignid FROM orders
)"""

COMPETITORS = """
competitors AS (
  SELECT p_brand AS competitor, p_partkey AS productid, p_name AS productname,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, (p_size % 4) = 0 AS onpromotion
  FROM part
)"""

PREDICTIONS = """
predictions AS (
  SELECT c_custkey AS customerid, CAST(((c_custkey * 7919) % 1000) / 1000.0 AS DOUBLE) AS churn_probability
  FROM customer
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def msum(x: str) -> str:
    """Money sum: DECIMAL, 0 when there is nothing to add, DOUBLE out."""
    return f"CAST(COALESCE(SUM({x}), 0) AS DOUBLE)"


def ratio(num: str, den: str, scale: str = "", zero: str = "= 0") -> str:
    mul = f" * {scale}" if scale else ""
    return f"CASE WHEN {den} {zero} THEN CAST(0.0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE){mul} END"
