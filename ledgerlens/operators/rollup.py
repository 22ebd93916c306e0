"""Sales views from a roll-up instead of the order lines.

Three tables, each far smaller than the lines:

- *day cells*: one row per (day, channel) with line count, net sales, cost, and the number of orders whose lines all
  lie in this one cell (``orders``), of these the returned and the completed ones;
- *spanning orders*: one row per (order, day, channel) of every other order, that is one with lines in two cells or more;
- *month keys*: net sales per (month, channel, value) of each breakdown key.

Distinct orders of any range of days and any channel stay exact: an order of one cell is counted in its cell alone, so
cells add up, and the orders that do not are listed and counted anew. Net sales are DECIMAL and add up exactly. Only a
breakdown by key needs lines, those of the days at the two ends of a range that do not fill a month.

Defined cases: lines without a date are in no range, as in F1; a null order id counts in sums, not in orders; a null
channel is a cell of its own, left out by a channel filter; a null key is not a group; no lines give empty tables.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sales as S

KEYS = ("category", "productname", "city", "locationid")
MONTH = "fact_month"


def _month(column: str = "date") -> Column:
    return (F.year(column) * 100 + F.month(column)).cast("int")


def order_cells(sales: DataFrame) -> DataFrame:
    """One row per (order, day, channel), with the number of such rows of the order (``_cells``)."""
    status = F.col("orderstatus")
    folded = (sales.where(F.col("date").isNotNull() & F.col("orderid").isNotNull()).groupBy("orderid", "date", "channel")
              .agg(F.coalesce(F.max((status == "Returned").cast("int")), F.lit(0)).alias("returned"),
                   F.coalesce(F.max((status == "Completed").cast("int")), F.lit(0)).alias("completed")))
    return folded.withColumn("_cells", F.count(F.lit(1)).over(Window.partitionBy("orderid")))


def spanning_orders(cells: DataFrame) -> DataFrame:
    """The orders of :func:`order_cells` with two cells or more."""
    return cells.where(F.col("_cells") > 1).drop("_cells").withColumn(MONTH, _month())


def day_cells(sales: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per (day, channel); ``cells`` are the :func:`order_cells` of the same lines."""
    sums = (sales.where(F.col("date").isNotNull()).groupBy("date", "week", "month", "channel")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("netsale").alias("netsale"), F.sum("costofgoodssold").alias("cogs")))
    own = (cells.where(F.col("_cells") == 1).groupBy("date", "channel")
           .agg(F.count(F.lit(1)).alias("orders"), F.sum("returned").alias("returned"), F.sum("completed").alias("completed")))
    both = sums.unionByName(own, allowMissingColumns=True).groupBy("date", "channel")
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in ("rows", "orders", "returned", "completed")]
    return both.agg(*[F.max(c).alias(c) for c in ("week", "month", "netsale", "cogs")], *counts)


def month_keys(sales: DataFrame, keys=KEYS) -> DataFrame:
    """Net sales per (month, channel, value) of every key, in one scan: ``breakdown`` names the key, whose column holds
    the value; the other keys are null."""
    base = sales.where(F.col("date").isNotNull()).withColumn(MONTH, _month())
    every = [F.col(c) for c in (MONTH, "channel", *keys)]
    sets = base.groupingSets([[F.col(MONTH), F.col("channel"), F.col(k)] for k in keys], *every).agg(
        F.grouping_id().alias("_gid"), F.sum("netsale").alias("netsale"))
    full = (1 << len(keys)) - 1
    name, known = F.lit(None).cast("string"), F.lit(False)
    for i, k in enumerate(keys):
        hit = F.col("_gid") == full - (1 << (len(keys) - 1 - i))
        name, known = F.when(hit, F.lit(k)).otherwise(name), known | (hit & F.col(k).isNotNull())
    return sets.where(known).select(MONTH, "channel", *keys, "netsale", name.alias("breakdown"))


def _chosen(df: DataFrame, start, end, channel: str) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(str(end)).cast("date"))
    if start is not None and MONTH in df.columns:
        df = df.where(F.col(MONTH) >= _number(_day(start)))
    if end is not None and MONTH in df.columns:
        df = df.where(F.col(MONTH) <= _number(_day(end)))
    return df if channel is None or channel == S.ALL else df.where(F.col("channel") == channel)


def _totals(cells: DataFrame, spanning: DataFrame, start, end, channel: str) -> DataFrame:
    """One row: row_count, rev, cogs, total_orders, returned_orders, completed_orders."""
    days = _chosen(cells, start, end, channel).select("rows", "netsale", "cogs", "orders", "returned", "completed")
    listed = (_chosen(spanning, start, end, channel).groupBy("orderid")
              .agg(F.max("returned").alias("returned"), F.max("completed").alias("completed"))
              .select(F.lit(1).alias("orders"), "returned", "completed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    money = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,4)"))
    return days.unionByName(listed, allowMissingColumns=True).agg(
        total("rows").alias("row_count"), money("netsale").alias("rev"), money("cogs").alias("cogs"),
        total("orders").alias("total_orders"), total("returned").alias("returned_orders"), total("completed").alias("completed_orders"))


def kpis(cells: DataFrame, spanning: DataFrame, start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """A1-A5; equal to :func:`sales.sales_kpis` over the filtered lines."""
    return S.kpi_measures(_totals(cells, spanning, start, end, channel))


def funnel(cells: DataFrame, spanning: DataFrame, funnel_table: DataFrame, start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """A6; equal to :func:`sales.sales_funnel` over the filtered lines."""
    done = _totals(cells, spanning, start, end, channel).select("completed_orders").scalar()
    return S.funnel_stages(funnel_table, done, _chosen(cells, start, end, channel).select(F.lit(1)).exists())


def trend(cells: DataFrame, grain: str = "date", start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """A7."""
    return S.sales_trend(_chosen(cells, start, end, channel), grain)


def by_channel(cells: DataFrame, start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """A9."""
    return S.sales_by(_chosen(cells, start, end, channel), "channel")


def _day(value) -> dt.date:
    return value if type(value) is dt.date else dt.date.fromisoformat(str(value)[:10])


def _number(day: dt.date) -> int:
    return day.year * 100 + day.month


def split_range(start=None, end=None) -> tuple[tuple[int | None, int | None], list[tuple[dt.date, dt.date]]]:
    """The whole months of an inclusive range, as (first, last) month numbers (None: open; first > last: none), and the
    ranges of days left at its ends, two at most."""
    first, last, edges = None, None, []
    begin, until = (None if d is None else _day(d) for d in (start, end))
    month_end = lambda d: d.replace(day=calendar.monthrange(d.year, d.month)[1])
    if begin and until and _number(begin) == _number(until) and (begin.day > 1 or until != month_end(until)):
        return (1, 0), [(begin, until)] if begin <= until else []
    if begin:
        after = month_end(begin) + dt.timedelta(days=1)
        first = _number(begin if begin.day == 1 else after)
        if begin.day > 1 and (until is None or begin <= until):
            edges.append((begin, month_end(begin)))
    if until:
        before = until.replace(day=1) - dt.timedelta(days=1)
        last = _number(until if until == month_end(until) else before)
        if until != month_end(until) and (begin is None or begin <= until):
            edges.append((until.replace(day=1), until))
    return (first, last), edges


def by_key(keys: DataFrame, edge_lines: DataFrame | None, key: str, start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """A8 / A9 for one of the roll-up's keys: whole months from ``keys``, the days left from ``edge_lines``."""
    (first, last), _ = split_range(start, end)
    whole = keys.where(F.col("breakdown") == key)
    if first is not None:
        whole = whole.where(F.col(MONTH) >= first)
    if last is not None:
        whole = whole.where(F.col(MONTH) <= last)
    chosen = channel is not None and channel != S.ALL
    parts = (whole.where(F.col("channel") == channel) if chosen else whole).groupBy(key).agg(F.sum("netsale").alias("netsale"))
    if edge_lines is not None:
        lines = edge_lines.where(F.col("channel") == channel) if chosen else edge_lines
        parts = parts.unionByName(lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("netsale").alias("netsale")))
    return S.sales_by(parts, key)


def top(keys: DataFrame, edge_lines: DataFrame | None, key: str, n: int = 10, start=None, end=None, channel: str = S.ALL) -> DataFrame:
    """K1-K3; ties go to the lower key."""
    return by_key(keys, edge_lines, key, start, end, channel).orderBy(F.col("netsale").desc(), F.col(key).asc()).limit(n)
