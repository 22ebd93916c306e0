"""Batch ingest and sinks: CSV scan (S1), header normalisation (S2), typing (S3), derived net sale (S4), full
rebuild (S5), routing (S6), per-file append (S7), table access (S9-S12) and CSV export (S13, S14).

CSV files are read with every column as STRING and bound *by header name*: a user schema handed to the CSV reader
binds by position and would silently swap reordered columns. Types are applied afterwards. Every row carries what
is wrong with it in ``PROBLEM`` (too many fields, a value that its type cannot hold exactly); strict readers raise
on it, the stream rejects just the file it came from.
"""

from __future__ import annotations

import datetime as _dt
import logging
import posixpath
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as SC
from .snapshots import Conflict, Snapshots

log = logging.getLogger(__name__)

# The text tokens that count as a missing value in an input
# file (the pandas CSV reader's default set), besides the empty string.
NULL_TOKENS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

TIMESTAMP_OUT_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: A quote inside a quoted field is doubled, in files read and written.
QUOTES = {"quote": '"', "escape": '"'}
PROBLEM = "_problem"
#: Endings of the files that are ingested, plain and packed.
CSV_ENDINGS = (".csv", ".csv.gz")
PACKED_ROWS = 1_000_000
#: Times that a change starts again because another writer published first.
RETRIES = 5
_RAW = "_raw_record"


# ----------------------------------------------------------------------------- S1-S4

def read_csv(spark: SparkSession, path, null_tokens=NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """Header CSV, every column STRING, missing-value tokens -> null. Short rows are filled with nulls; a row
    with more fields than the header raises when it is read."""
    return _raise_problems(_scan(spark, path, null_tokens, multi_line))


def _scan(spark: SparkSession, path, null_tokens=NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """The CSV columns and ``PROBLEM``."""
    reader = spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", multiLine=multi_line, **QUOTES)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW]])
    # without pruning in the parser, else it does not see that a row is too long when few columns are asked for
    df = reader.options(columnNameOfCorruptRecord=_RAW, enforceSchema=True, columnPruning=False).schema(schema).csv(path)
    # the reader keeps the raw text of short and of long rows; only the long ones lose fields
    separators = F.regexp_count(F.regexp_replace(F.col(_RAW), F.lit('"(?:[^"]|"")*"'), F.lit("")), F.lit(","))
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(*null_tokens), F.col(f"`{c}`")).alias(c) for c in names],
        # the reader refuses to be asked for the raw text alone, so the message holds a column, too
        F.when(separators >= len(names), F.concat(F.lit("row with more fields than the header: "), F.coalesce(F.col(f"`{names[0]}`"), F.lit("")))).alias(PROBLEM))


def open_quotes(spark: SparkSession, paths) -> DataFrame:
    """(path) of the files in which some line has an odd number of quotes, that is a quoted line break."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), "value")
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1).select("path").distinct()


def _raise_problems(df: DataFrame) -> DataFrame:
    problem = F.col(PROBLEM)
    return df.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))).drop(PROBLEM)


def source_headers(columns: list[str]) -> list[str]:
    """Header names as written in the file.

    Spark's CSV reader renames headers that collide case-insensitively by
    appending their position (``City``, ``CITY`` -> ``City0``, ``CITY1``);
    this undoes that rename so alias matching sees the file's names.
    """
    bare = [c.removesuffix(str(i)) or c for i, c in enumerate(columns)]
    cut = [b.lower() for b, c in zip(bare, columns, strict=True) if b != c]
    return [b if b != c and cut.count(b.lower()) > 1 else c for b, c in zip(bare, columns, strict=True)]


def header_mapping(columns: list[str], spec: SC.TableSpec) -> dict[str, str]:
    """S2 as a plain mapping ``{column -> canonical name}``. Every column is looked up in the table's header index;
    of the columns that claim one canonical name, the best-ranked header wins, of equal headers the last."""
    claims: dict[str, tuple[int, int, str]] = {}
    for position, (column, header) in enumerate(zip(columns, source_headers(columns), strict=True)):
        known = spec.headers.get(header.lower())
        if known:
            canonical, rank = known
            claims[canonical] = min(claims.get(canonical, (rank, 1, "")), (rank, -position, column))
    return {column: canonical for canonical, (_, _, column) in claims.items()}


def normalize_headers(df: DataFrame, spec: SC.TableSpec) -> DataFrame:
    """Rename known headers to canonical names; others pass through."""
    mapping = header_mapping(df.columns, spec)
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def _exact_kind(kind: str) -> bool:
    return kind in ("int", "bigint") or kind.startswith("decimal")


def _parsed(c: Column, kind: str) -> Column:
    """The first cast of a text: to its kind, or for exact numbers to a number that holds every digit."""
    if kind == "timestamp_ntz":
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    if kind == "date":
        return F.try_to_timestamp(c).cast("date")
    return c.try_cast("decimal(38,12)" if _exact_kind(kind) else kind)


def typed_columns(df: DataFrame, spec: SC.TableSpec) -> DataFrame:
    """S3: canonical text columns as their declared types; a value that its type cannot hold exactly becomes null and is
    named in ``PROBLEM``. Other columns are left as they are.

    Texts are cast once, in a projection of their own; the next one compares the casts with the texts."""
    types, kinds = {**spec.types, **spec.extra_types}, dict(df.dtypes)
    casts = {c: types[c] for c in df.columns if kinds[c] == "string" and types.get(c, "string") != "string" and c != PROBLEM}
    step = df.select("*", *[_parsed(F.col(f"`{c}`"), k).alias(f"_cast_{c}") for c, k in casts.items()])
    step = step.select("*", *[F.col(f"_cast_{c}").try_cast(k).alias(f"_value_{c}") for c, k in casts.items() if _exact_kind(k)])
    values, misfits = {}, [F.col(PROBLEM)] if PROBLEM in df.columns else []
    for c, kind in casts.items():
        cast = F.col(f"_cast_{c}")
        if _exact_kind(kind):
            value = F.col(f"_value_{c}")
            values[c] = F.when(value.cast("decimal(38,12)") == cast, value)
            misfit = cast.isNull() | value.isNull() | (value.cast("decimal(38,12)") != cast)
        else:
            values[c], misfit = cast, cast.isNull()
        misfits.append(F.when(F.col(f"`{c}`").isNotNull() & misfit, F.concat(F.lit(f"{c} is not {kind}: "), F.col(f"`{c}`"))))
    out = [values[c].alias(c) if c in values else F.col(f"`{c}`") for c in df.columns if c != PROBLEM]
    return step.select(*out, (F.coalesce(*misfits) if misfits else F.lit(None).cast("string")).alias(PROBLEM))


# The words that the reference's CSV reader takes as truth values in a column without any other.
TRUTH = {"true": ["True", "TRUE", "true"], "false": ["False", "FALSE", "false"]}


def inferred_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Types of text columns that no spec names: the narrowest of ``boolean``, ``bigint``, ``double`` and ``string``
    that holds every value. All columns are judged in one pass: each row adds four flags a column to one aggregate.

    bigint lies below double; truth values and numbers together are text; a column without any value is double, as
    the reference's reader has it. A whole number that needs more than 64 bits makes the column double."""
    if not columns:
        return {}
    flags = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        there, plain = v.isNotNull(), F.btrim(v)
        whole = plain.rlike("^[+-]?[0-9]+$") & plain.try_cast("bigint").isNotNull()
        number = plain.try_cast("double").isNotNull() & plain.rlike("[0-9]|^[+-]?(inf|infinity)$")
        flags += [F.bool_or(there).alias(f"any{i}"), F.bool_and(F.when(there, v.isin(*TRUTH["true"], *TRUTH["false"]))).alias(f"truth{i}"),
                  F.bool_and(F.when(there, whole)).alias(f"whole{i}"), F.bool_and(F.when(there, number)).alias(f"number{i}")]
    seen = df.agg(*flags).first()
    return {c: "double" if not seen[f"any{i}"] else "boolean" if seen[f"truth{i}"] else "bigint" if seen[f"whole{i}"]
            else "double" if seen[f"number{i}"] else "string" for i, c in enumerate(columns)}


def with_inferred_types(df: DataFrame, spec: SC.TableSpec) -> DataFrame:
    """Columns that the table's spec does not name get the type that their values have."""
    named = {**spec.types, **spec.extra_types}
    unknown = [c for c, kind in df.dtypes if kind == "string" and c not in named and c != PROBLEM]
    types = inferred_types(df, unknown)

    def typed(c: str) -> Column:
        v = F.col(f"`{c}`")
        if types[c] == "boolean":
            return F.when(v.isNotNull(), v.isin(*TRUTH["true"])).alias(c)
        return F.btrim(v).try_cast(types[c]).alias(c) if types[c] != "string" else v

    return df.select(*[typed(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def coerce_types(df: DataFrame, spec: SC.TableSpec, strict: bool = True) -> DataFrame:
    """S3. ``strict`` (the default) raises on a value that does not fit; otherwise it becomes null."""
    typed = typed_columns(df, spec)
    return _raise_problems(typed) if strict else typed.drop(PROBLEM)


def derive_netsale(df: DataFrame) -> DataFrame:
    """``netsale = grossvalue - discountvalue`` when both columns exist."""
    if {"grossvalue", "discountvalue"} <= set(df.columns):
        return df.withColumn("netsale", F.col("grossvalue") - F.col("discountvalue"))
    return df


def parse_files(spark: SparkSession, path, spec: SC.TableSpec, multi_line: bool = False) -> DataFrame:
    """S1 -> S2 -> S3 -> S4 for files that share a header, with ``PROBLEM`` per row."""
    return derive_netsale(typed_columns(normalize_headers(_scan(spark, path, multi_line=multi_line), spec), spec))


def as_stored(spec: SC.TableSpec, types: dict[str, str]) -> SC.TableSpec:
    """The spec with the columns that a stored table has besides, under their stored types."""
    more = {c: t for c, t in types.items() if c not in spec.types and c not in spec.extra_types}
    return replace(spec, extra_types={**spec.extra_types, **more})


def load_file(spark: SparkSession, path, spec: SC.TableSpec, strict: bool = True, infer: bool = True) -> DataFrame:
    """S1 -> S2 -> S3 -> S4 for one file, directory or list of same-header files. ``infer`` looks at columns that the
    spec does not name, in one more pass over the file if there are any; without it they stay text.

    Files are read line by line, in parts. Where the table's ``multi_line`` is None, just the files with a quoted
    line break are read whole, one task each; False refuses such files, True reads every file whole."""
    if spec.multi_line is not True:
        broken = {r["path"] for r in open_quotes(spark, path).collect()}  # names of files that cannot be split
        if broken and spec.multi_line is False:
            raise ValueError(f"quoted line break in {path}; {spec.name} is read line by line")
    whole = spec.multi_line is True or bool(broken)
    if whole and spec.multi_line is None:
        every = {r["path"] for r in spark.read.text(path).select(F.input_file_name().alias("path")).distinct().collect()}
        if every - broken:
            parsed = [parse_files(spark, sorted(names), spec, multi_line=m) for names, m in ((every - broken, False), (broken, True))]
            parsed = parsed[0].unionByName(parsed[1], allowMissingColumns=True)
        else:
            parsed = parse_files(spark, path, spec, multi_line=True)
    else:
        parsed = parse_files(spark, path, spec, multi_line=whole)
    if infer:
        parsed = with_inferred_types(parsed, spec)
    return _raise_problems(parsed) if strict else parsed.drop(PROBLEM)


# ----------------------------------------------------------------------------- S6

def route_file(filename: str, registry=None) -> str | None:
    """Table for a file name: first registry entry whose prefix starts
    the lower-cased base name; ``None`` when nothing matches."""
    base = posixpath.basename(filename.rstrip("/")).lower()
    return next((name for name, spec in (registry or SC.INGESTED).items() if base.startswith(spec.file_prefix)), None)


# ----------------------------------------------------------------------------- table access

class TableStore:
    """Named tables in one folder of a shared filesystem, published in whole snapshots, or in the session catalog
    when ``root`` is ``None`` (there each write stands alone, and the file stream cannot use it)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.snapshots = Snapshots(spark, root) if root else None

    def exists(self, name: str) -> bool:
        """S9. What cannot be looked up does not exist for the caller, nor does what was staged but not published."""
        try:
            return self.spark.catalog.tableExists(name) if self.snapshots is None else self.snapshots.exists(name)
        except Exception:  # noqa: BLE001
            log.exception("looking up %s", name)
            return False

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name) if self.snapshots is None else self.snapshots.read(name)

    def write(self, df: DataFrame, name: str, mode: str) -> None:
        """One table changes in a step of its own; mode ``append`` or ``overwrite``."""
        if self.snapshots is None:
            df.write.mode(mode).saveAsTable(name)
        else:
            self.together({name: df}, mode)

    def together(self, frames: dict[str, DataFrame], mode: str) -> None:
        """Some tables change in one step: all of them or, if any fails, none. (In the catalog: one by one.)"""
        if self.snapshots is None:
            for name, df in frames.items():
                df.write.mode(mode).saveAsTable(name)
            return
        for attempt in range(RETRIES):
            change = self.snapshots.change()
            for name, df in frames.items():
                (change.append if mode == "append" else change.replace)(name, df)
            try:
                change.publish()
                return
            except Conflict:
                if attempt == RETRIES - 1:
                    raise


@dataclass(frozen=True)
class Loaded:
    """A frame that can always be used, and how it came about: stored, missing, unregistered or unreadable."""

    frame: DataFrame
    status: str


def load(store: TableStore, name: str) -> Loaded:
    """A lazy scan of a stored table with lower-case columns; whatever stands in its way, an empty frame
    of the declared schema and the reason. Never raises."""
    frame, status = None, "unregistered"
    if SC.spec_for(name):
        status = "missing"
        if store.exists(name):
            try:
                stored = store.read(name)
                frame, status = stored.toDF(*map(str.lower, stored.columns)), "stored"
            except Exception:  # noqa: BLE001
                log.exception("reading %s", name)
                status = "unreadable"
    if status != "stored":
        log.warning("table %s is %s", name, status)
    return Loaded(SC.empty_frame(store.spark, name) if frame is None else frame, status)


def load_table_safely(store: TableStore, name: str) -> DataFrame:
    """S10."""
    return load(store, name).frame


def refresh_all(store: TableStore) -> dict[str, DataFrame]:
    """Every ingested table, lazily."""
    return {name: load(store, name).frame for name in SC.INGESTED}


def load_predictions(store: TableStore) -> DataFrame:
    """The churn score table if present, else empty."""
    return load(store, SC.PREDICTIONS_TABLE).frame


# ----------------------------------------------------------------------------- S5, S7

def bootstrap(store: TableStore, source_dir: str, registry=None, strict: bool = True) -> dict[str, bool]:
    """Rebuild every table from its master file (overwrite), in one step: readers see the old tables until all
    new ones are published together. A missing master file is logged and skipped; any other failure aborts and leaves
    every table as it was. Returns which tables were written."""
    masters = {name: f"{source_dir.rstrip('/')}/{spec.master_file}" for name, spec in (registry or SC.INGESTED).items()}
    there = {name: _path_exists(store.spark, path) for name, path in masters.items()}
    for name, path in masters.items():
        if not there[name]:
            log.error("no master file %s; table %s is left alone", path, name)
    store.together({name: load_file(store.spark, path, SC.spec_for(name), strict) for name, path in masters.items() if there[name]}, "overwrite")
    return there


def schema_problem(incoming: list[str], target: list[str] | None) -> str | None:
    """S7 schema rule: a column the target table lacks rejects the file;
    target columns the file lacks become null."""
    known = None if target is None else {c.lower() for c in target}
    extra = [] if known is None else [c for c in incoming if c.lower() not in known]
    return f"unknown columns {extra}" if extra else None


def align_to(df: DataFrame, target_cols: list[str], target_types: dict | None = None) -> DataFrame:
    """Order/complete ``df`` to the target's columns; missing ones are null."""
    have, types = {c.lower(): c for c in df.columns}, target_types or {}
    return df.select(*[F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have
                       else F.lit(None).cast(types.get(c, "string")).alias(c) for c in target_cols])


def target_layout(store: TableStore, spec: SC.TableSpec) -> tuple[list[str], dict]:
    """Columns and types a file is appended under: the stored table's if it
    exists, else the declared schema."""
    types = dict(store.read(spec.name).dtypes) if store.exists(spec.name) else {**spec.types, **spec.extra_types}
    return list(types), types


def append_file(store: TableStore, path: str, strict: bool = True) -> bool:
    """Route, load and append one file. ``False`` (never an exception)
    when the name matches no table, the columns do not fit, or loading fails.
    No de-duplication: the same rows sent twice are stored twice."""
    try:
        spec = SC.spec_for(route_file(path) or "")
        if spec is None:
            raise ValueError("no table for this file name")
        cols, types = target_layout(store, spec)
        df = load_file(store.spark, path, as_stored(spec, types), strict, infer=False)
        problem = schema_problem(df.columns, cols)
        if problem:
            raise ValueError(problem)
        store.write(align_to(df, cols, types), spec.name, "append")
    except Exception:  # noqa: BLE001
        log.exception("%s is not appended", path)
        return False
    return True


# ----------------------------------------------------------------------------- S13, S14

def write_csv(df: DataFrame, path: str, mode: str = "overwrite", packed: bool = False) -> None:
    """Header CSV (the same sink S13 uses); timestamps as ``yyyy-MM-dd HH:mm:ss``, quotes doubled. ``packed`` files are
    ``.csv.gz`` of ``PACKED_ROWS`` rows at most, as such a file is read by one task."""
    _csv_writer(df, packed).mode(mode).csv(path)


def _csv_writer(df: DataFrame, packed: bool):
    writer = df.write.options(header=True, timestampNTZFormat=TIMESTAMP_OUT_FORMAT, timestampFormat=TIMESTAMP_OUT_FORMAT, **QUOTES)
    return writer.options(compression="gzip", maxRecordsPerFile=PACKED_ROWS) if packed else writer


def write_csv_split(df: DataFrame, flag: str, paths: dict[bool, str], scratch: str) -> None:
    """Packed CSV directories of the rows where the boolean ``flag`` is false and where it is true (none of those where
    it is null), all in one pass over the frame; ``flag`` is not written."""
    _csv_writer(df, True).partitionBy(flag).csv(scratch)
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    for value, path in paths.items():
        part = f"{scratch}/{flag}={str(value).lower()}"
        if not _path_exists(df.sparkSession, part):
            write_csv(df.where(F.lit(False)).drop(flag), path, packed=True)
            continue
        target = hadoop.Path(path)
        fs = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        if not fs.rename(hadoop.Path(part), target):
            raise OSError(f"{part} cannot be moved to {path}")


def export_csv(df: DataFrame, directory: str, stem: str, day: str | None = None) -> str | None:
    """Export a list as ``<stem>_<yyyy-MM-dd>.csv`` (a CSV directory);
    an empty result writes nothing and returns ``None``."""
    if df.isEmpty():
        return None
    out = f"{directory.rstrip('/')}/{stem}_{day or _dt.date.today().isoformat()}.csv"
    write_csv(df, out)
    return out


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def rename_headers(df: DataFrame, spec: SC.TableSpec) -> DataFrame:
    """Canonical -> first alias (the file header a producer would write)."""
    return df.select(*[F.col(c).alias(spec.aliases[c][0]) if c in spec.aliases else F.col(c) for c in df.columns])
