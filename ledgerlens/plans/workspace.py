"""Derived fact table, built once per input and shared by every query.

The order-line joins (lineitem x part x supplier x nation x region, then x orders x customer x nation) run once in
one pipeline. The enriched sales and delivery columns of every line are written as one Parquet table to the
cluster's shared checkpoint folder, and every query scans that table (``sales()`` and ``deliveries()`` are column
projections of it) instead of re-running the joins.

- Layout: one directory per order month (``fact_month`` = yyyymm), and inside a month rows are dealt by a hash of
  the order. A date range lists and opens only its months' files. All lines of an order stand in one file, so
  per-order aggregates fold them before the shuffle. The write is a rebalancing exchange on (month, order hash):
  Spark splits a month or order that holds a large share of the rows and merges small ones.
- Commit: each build writes to a directory of its own; Spark's committer adds ``_SUCCESS`` last. A reader takes the
  first committed build of its signature, so no rename is needed, a half-written table is never seen, and of two
  builds that race both are valid.
- Freshness: the location holds a signature of the inputs and of the deriving code. It is checked on every access
  (a few metadata calls), so a changed input is never answered from an old table.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import delivery as D
from ..operators import sales as S
from ..session import shared_dir
from ..sources import adapters as A

LINE_INPUTS = ("lineitem", "orders", "part", "customer", "supplier", "nation", "region")
DELIVERY_COLUMNS = ["deliveryid", "orderid", "orderdate", "promiseddate", "actualdeliverydate", "status",
                    "deliverypartner", "city", "deliverycost", "date", "delivery_time_days", "on_time"]
MONTH = "fact_month"
NO_MONTH = 0  # of lines without a date
ROWS_PER_FILE = 8_000_000  # hard cap on rows in one output file
BYTES_PER_BUCKET = 256 * 1024 * 1024  # input bytes for each order-hash bucket of a month
MATERIALIZE_CONF = "spark.ledgerlens.materialize"

_LOCK = threading.Lock()  # guards the dictionary only, never a build
_CACHE: dict[tuple, "Workspace"] = {}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def code_version() -> str:
    """Hash of the source of every module that shapes the fact table."""
    h = hashlib.sha1()
    for mod in (A, S, D, X):
        h.update(inspect.getsource(mod).encode())
    return h.hexdigest()[:12]


def input_state(spark: SparkSession, sf_dir: str, names) -> list[tuple[str, int, int, int]]:
    """(table, modification time, bytes, files) of every input: two metadata calls a table, however many files."""
    out = []
    for name in sorted(names):
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        size = fs.getContentSummary(p)
        out.append((name, int(fs.getFileStatus(p).getModificationTime()), int(size.getLength()), int(size.getFileCount())))
    return out


def signature(state) -> str:
    return hashlib.sha1(f"{code_version()}|{state}".encode()).hexdigest()[:16]


def committed(spark: SparkSession, base: str, marker: str = "_SUCCESS") -> str | None:
    """The first committed build below ``base``; ``marker`` is what its last write leaves."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return None
    builds = sorted(f"{base}/{st.getPath().getName()}" for st in fs.listStatus(p))
    return next((b for b in builds if fs.exists(_fs(spark, f"{b}/{marker}")[1])), None)


def month_of(column: str) -> Column:
    return (F.year(column) * 100 + F.month(column)).cast("int")


def laid_out(lines: DataFrame, input_bytes: int, date: str = "timestamp", order: str = "orderid",
             derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Order lines dealt and sorted for the layout above. ``derive`` makes the stored columns after the exchange and the
    sort, which so move no derived column; it keeps ``MONTH`` and the order of the rows."""
    per_month = max(1, -(-input_bytes // (BYTES_PER_BUCKET * 64)))
    out = lines.withColumn(MONTH, F.coalesce(month_of(date), F.lit(NO_MONTH))).withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(per_month)))
    return derive(out.hint("rebalance", MONTH, "_bucket").sortWithinPartitions(MONTH, order).drop("_bucket"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes order lines that are :func:`laid_out`."""
    lines.write.partitionBy(MONTH).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def month_number(day) -> int:
    y, m = str(day).split("-")[:2]
    return int(y) * 100 + int(m)


class Workspace:
    """Materialised order lines for one source directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.tables = A.DriverTables(spark, self.sf_dir)
        self._building = threading.Lock()
        self._known: tuple[str, str] | None = None  # signature, path
        self._sales_cols: list[str] | None = None
        self._frame: tuple[str, DataFrame] | None = None  # path, scan

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Workspace":
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        with _LOCK:
            return _CACHE.setdefault(key, cls(spark, sf_dir))

    def base(self) -> str:
        """Folder of this input's builds, by signature."""
        name = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:12]
        return shared_dir(self.spark, "ledgerlens", "facts", f"lines-{name}")

    def path(self, fresh: bool = False) -> str:
        """Where the table for the inputs as they are now stands; built if need be."""
        state = input_state(self.spark, self.sf_dir, LINE_INPUTS)
        sig = signature(state)
        with self._building:
            if fresh or self._known is None or self._known[0] != sig:
                found = None if fresh else committed(self.spark, f"{self.base()}/{sig}")
                if found is None:
                    found = f"{self.base()}/{sig}/{uuid.uuid4().hex}"
                    write_lines(self._derived(sum(size for _, _, size, _ in state)), found)
                self._known = (sig, found)
            return self._known[1]

    def _derived(self, input_bytes: int) -> DataFrame:
        def derive(rows: DataFrame) -> DataFrame:
            return D.enrich_deliveries(S.enrich_sales(A.order_line_columns(rows, self.tables, MONTH)))

        return laid_out(A.order_line_rows(self.tables), input_bytes, "o_orderdate", "l_orderkey", derive)

    def lines(self, start=None, end=None) -> DataFrame:
        """The wide order-line fact; with dates, only the months they touch."""
        path = self.path()
        if self._frame is None or self._frame[0] != path:  # a build never changes: its schema and files are looked up once
            self._frame = (path, self.spark.read.parquet(path))
        lines = self._frame[1]
        if start is not None:
            lines = lines.where(F.col(MONTH) >= month_number(start))
        if end is not None:
            lines = lines.where((F.col(MONTH) <= month_number(end)) & (F.col(MONTH) != NO_MONTH))
        return lines

    def sales(self, start=None, end=None) -> DataFrame:
        """Enriched order lines (E5) with every canonical column."""
        return self.lines(start, end).select(*self._sales_columns())

    def deliveries(self, start=None, end=None) -> DataFrame:
        """Enriched deliveries."""
        lines = self.lines(start, end)
        return lines.select(*[lines[A.DELIVERY_CITY].alias("city") if c == "city" else lines[c] for c in DELIVERY_COLUMNS])

    def _sales_columns(self) -> list[str]:
        """Column order of the enriched canonical sales frame (plan only, no job)."""
        if self._sales_cols is None:
            self._sales_cols = S.enrich_sales(A.sales(self.tables)).columns
        return self._sales_cols

    def build(self, fresh: bool = False) -> None:
        """Builds the table now; ``fresh`` also if there is one for the same input."""
        self.path(fresh)

    def vacuum(self) -> int:
        """Deletes the builds of older signatures; call it when nothing reads them. Returns how many."""
        keep, gone = self.path().rsplit("/", 2)[1], 0
        fs, p = _fs(self.spark, self.base())
        for st in fs.listStatus(p):
            if st.getPath().getName() != keep:
                fs.delete(st.getPath(), True)
                gone += 1
        return gone


def materialize_enabled(spark: SparkSession) -> bool:
    """``spark.ledgerlens.materialize`` (default true): false makes queries run
    the joins lazily instead of writing the fact table first - the better
    choice for a single query over a huge input. The answers are the same."""
    return spark.conf.get(MATERIALIZE_CONF, "true").lower() != "false"


def sales_fact(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    return Workspace.of(spark, sf_dir).sales(start, end)


def deliveries_fact(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    return Workspace.of(spark, sf_dir).deliveries(start, end)
