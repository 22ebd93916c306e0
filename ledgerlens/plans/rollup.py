"""The sales roll-up of a workspace: built once from the fact table, read by every view of a period.

It stands beside the build of the fact table that it was made from, so a new fact table gets a new roll-up, and
``Workspace.vacuum`` takes both. The day cells are written last; their ``_SUCCESS`` commits the three tables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators import sales as S
from .workspace import Workspace, committed


class SalesRollup:
    """Sales views of one workspace; ranges are inclusive days, ``None`` is open."""

    def __init__(self, workspace: Workspace):
        self.workspace = workspace
        self.spark = workspace.spark
        self._known: tuple[str, str] | None = None  # fact path, roll-up path
        self._frames: dict[str, DataFrame] = {}  # scans by path: a roll-up never changes, its files are listed once

    def path(self) -> str:
        fact = self.workspace.path()
        if self._known is None or self._known[0] != fact:
            base = f"{fact}-rollup"
            self._known = (fact, committed(self.spark, base, "cells/_SUCCESS") or self._build(f"{base}/{uuid.uuid4().hex}"))
        return self._known[1]

    def _build(self, path: str) -> str:
        lines = self.workspace.sales()
        # a value of a key stands in few rows of a month; one file a (key, month) at most per task of the exchange
        (R.month_keys(lines).hint("rebalance", "breakdown", R.MONTH)
         .write.partitionBy("breakdown", R.MONTH).parquet(f"{path}/keys"))
        orders = R.order_cells(lines)
        R.spanning_orders(orders).write.parquet(f"{path}/spanning")
        R.day_cells(lines, orders).hint("rebalance").sortWithinPartitions("date").write.parquet(f"{path}/cells")
        return path

    def _table(self, name: str) -> DataFrame:
        path = f"{self.path()}/{name}"
        if path in self._frames:
            return self._frames[path]
        lines = self.workspace.sales()
        # the schema follows from the lines, so an empty table can be read, too, and no job looks for it
        schema = {"keys": lambda: R.month_keys(lines), "spanning": lambda: R.spanning_orders(R.order_cells(lines)),
                  "cells": lambda: R.day_cells(lines, R.order_cells(lines))}[name]().schema
        return self._frames.setdefault(path, self.spark.read.schema(schema).parquet(path))

    @property
    def cells(self) -> DataFrame:
        return self._table("cells")

    @property
    def spanning(self) -> DataFrame:
        return self._table("spanning")

    @property
    def keys(self) -> DataFrame:
        return self._table("keys")

    def edge_lines(self, start=None, end=None) -> DataFrame | None:
        """Lines of the days that do not fill a month: of two months at most."""
        parts = [S.filter_sales(self.workspace.sales(a, b), a.isoformat(), b.isoformat()) for a, b in R.split_range(start, end)[1]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def kpis(self, start=None, end=None, channel: str = S.ALL) -> DataFrame:
        return R.kpis(self.cells, self.spanning, start, end, channel)

    def funnel(self, funnel: DataFrame, start=None, end=None, channel: str = S.ALL) -> DataFrame:
        return R.funnel(self.cells, self.spanning, funnel, start, end, channel)

    def trend(self, grain: str = "date", start=None, end=None, channel: str = S.ALL) -> DataFrame:
        return R.trend(self.cells, grain, start, end, channel)

    def by(self, key: str, start=None, end=None, channel: str = S.ALL) -> DataFrame:
        if key == "channel":
            return R.by_channel(self.cells, start, end, channel)
        return R.by_key(self.keys, self.edge_lines(start, end), key, start, end, channel)

    def top(self, key: str, n: int = 10, start=None, end=None, channel: str = S.ALL) -> DataFrame:
        return R.top(self.keys, self.edge_lines(start, end), key, n, start, end, channel)

    def breakdowns(self, start=None, end=None, channel: str = S.ALL) -> DataFrame:
        """Every key's breakdown as (breakdown, key, netsale), the key as text."""
        parts = [self.by(k, start, end, channel).select(F.lit(k).alias("breakdown"), F.col(k).cast("string").alias("key"), "netsale")
                 for k in (*R.KEYS, "channel")]
        return reduce(DataFrame.unionByName, parts)

    def sales_tab(self, funnel: DataFrame, start=None, end=None, channel: str = S.ALL, grain: str = "date") -> dict[str, DataFrame]:
        """The views of ``tabs.sales_tab``; the order lines are read for the ends of the range alone."""
        chosen = (start, end, channel)
        return {
            "kpis": self.kpis(*chosen),
            "funnel": self.funnel(funnel, *chosen),
            "trend": self.trend(grain, *chosen),
            "by_category": self.by("category", *chosen),
            "top_products": self.top("productname", 10, *chosen),
            "by_channel": self.by("channel", *chosen),
            "top_cities": self.top("city", 10, *chosen),
            "top_branches": self.top("locationid", 10, *chosen),
        }
