"""Derived tables that follow their source, month by month.

The enriched sales (E1-E5) and deliveries (E6-E8) of an ingest store are kept as derived tables, one folder a month. A
refresh reads only the source folders that were published since the last one, derives their rows, and rewrites only
the months that these rows fall into: old rows of the month and new ones together, so that a month stays in the
layout of the fact table (an order's lines in one file). The new month folders and the version of the source that
they cover are published in one snapshot; untouched months keep their folders.

A source that was replaced (a full rebuild), or whose covered and new rows were merged into one folder, is derived
anew. Rows without a date form a month of their own, which every date range leaves out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import sales as S
from ..sources import ingest as I
from ..sources.snapshots import Conflict, Folder, file_system
from . import workspace as W

BOOKKEEPING = ("_source_file", "_batch_id")


@dataclass(frozen=True)
class Derived:
    source: str
    name: str
    derive: Callable[[DataFrame], DataFrame]
    date: str


TABLES = (Derived("sales", "sales_months", S.enrich_sales, "timestamp"),
          Derived("deliveries", "deliveries_months", D.enrich_deliveries, "orderdate"))


def _month_of(folder: Folder) -> int:
    return int(folder.path.rpartition("=")[2])


def refresh(store: I.TableStore) -> dict[str, list[int]]:
    """Bring every derived table up to its source; returns the months that were written, by derived table."""
    for attempt in range(I.RETRIES):
        change = store.snapshots.change()
        written = {d.name: _follow(store, change, d) for d in TABLES if d.source in change.base.tables}
        try:
            if any(months is not None for months in written.values()):
                change.publish()
            return {name: months or [] for name, months in written.items()}
        except Conflict:
            if attempt == I.RETRIES - 1:
                raise
    raise AssertionError


def _follow(store: I.TableStore, change, d: Derived) -> list[int] | None:
    """Stages the months that new rows touch; None if there is nothing new."""
    source, now = change.base.tables[d.source], change.base.tables.get(d.name)
    since, upto = min(f.first for f in source.folders), max(f.last for f in source.folders)
    kept: list[Folder] = []
    fresh = list(source.folders)
    if now is not None and now.covers is not None:
        began, held = now.covers
        if (began, held) == (since, upto):
            return None
        if began == since and not any(f.first <= held < f.last for f in source.folders):
            kept, fresh = list(now.folders), [f for f in source.folders if f.first > held]
    new = store.snapshots.frame(source, fresh).drop(*BOOKKEEPING)
    rows = d.derive(new)
    months, old = [], []
    if kept:
        named = F.coalesce(W.month_of(d.date), F.lit(W.NO_MONTH)).alias("m")
        touched = {r["m"] for r in rows.select(named).distinct().collect()}  # one row a month
        old = [f for f in kept if _month_of(f) in touched]
        kept = [f for f in kept if _month_of(f) not in touched]
    folder, size = change.folder(d.name), _bytes(store, [f.path for f in fresh])
    if old:
        lines = W.laid_out(store.snapshots.frame(now, old).unionByName(rows), size, d.date)
    elif dict(new.dtypes).get(d.date) == dict(rows.dtypes)[d.date]:  # no derived column is shuffled
        lines = W.laid_out(new, size, d.date, derive=d.derive)
    else:
        lines = W.laid_out(rows, size, d.date)
    W.write_lines(lines, f"{store.snapshots.root}/{folder}")
    fs, p = file_system(store.spark, f"{store.snapshots.root}/{folder}/{W.MONTH}=*")
    for st in fs.globStatus(p) or ():
        months.append(Folder(f"{folder}/{st.getPath().getName()}", 0, since, upto))
    change.put_folders(d.name, rows.schema, [*kept, *months], (since, upto))
    return sorted(map(_month_of, months))


def _bytes(store: I.TableStore, folders: list[str]) -> int:
    total = 0
    for folder in folders:
        fs, p = file_system(store.spark, f"{store.snapshots.root}/{folder}")
        total += sum(int(st.getLen()) for st in fs.globStatus(p) if st.isFile()) if "*" in folder else int(fs.getContentSummary(p).getLength())
    return total


def months(store: I.TableStore, name: str, start=None, end=None) -> DataFrame:
    """A derived table; with dates, only the months that they touch are opened."""
    table = store.snapshots.manifest().tables[name]
    first = W.month_number(start) if start is not None else None
    last = W.month_number(end) if end is not None else None
    ranged = first is not None or last is not None
    folders = [f for f in table.folders if not ranged or (
        _month_of(f) != W.NO_MONTH and (first is None or _month_of(f) >= first) and (last is None or _month_of(f) <= last))]
    return store.snapshots.frame(table, folders)
