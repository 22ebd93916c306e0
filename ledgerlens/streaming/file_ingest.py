"""Incremental file ingest with Structured Streaming.

The stream carries file *metadata* only (``binaryFile`` source, ``content`` pruned), so the streaming schema is fixed
even though CSV headers vary. A micro-batch tells that files have arrived; it then takes every file that lies in the
incoming folder and is not in the ledger, so a name that is dropped again with new content is a new file:

1. a file is known by (path, length, modification time); known ones are skipped;
2. the name gives the table (S6); files of one table that share a header line are read together and bound by name;
3. the rows of a group are checked first, in one job that lists the files with a bad row; those are rejected and
   the rest is staged, so one bad file never holds back another;
4. the rows of all groups, the ledger rows of their files and the reject log are published in one snapshot
   (``sources.snapshots``): after a crash at any point either all of a batch is there or nothing, and a file counts as
   stored exactly if its rows are;
5. files are archived under a free name after that; a file that is stored but still lies there is only archived.

The ledger (``_ingested_files``) is bucketed by path and merged as it grows, so a batch opens the buckets of its own
files only, and the number of ledger files does not follow the number of batches. A file
dropped again under a known name is new if its length or time is.
A rejected file stays where it is and is tried again when its content changes. Two ingests of one store do not disturb
each other: the one that publishes second starts its batch again from the ledger as it is then.
"""

from __future__ import annotations

import logging
import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unique_dir
from ..sources import ingest as I
from ..sources import schemas as SC
from ..sources.snapshots import Conflict, file_system

log = logging.getLogger(__name__)

REJECTED = "_rejected_files"
LEDGER = "_ingested_files"
LEDGER_SCHEMA = "path string, length bigint, modified bigint, status string, batch_id bigint"
BOOKKEEPING = ("_source_file", "_batch_id")
FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _path(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def read_headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line of every file, in one job; a file without a line is not in the result."""
    lines = spark.read.option("wholetext", False).text(paths).select(
        F.input_file_name().alias("path"), "value", F.input_file_block_start().alias("at"))
    first = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "n").alias("header"))
    return {_plain(r["path"]): r["header"].removeprefix("﻿") for r in first.collect()}


def _plain(path: str) -> str:
    """One spelling of a path: input_file_name() percent-encodes and writes ``file:///``."""
    from urllib.parse import unquote

    scheme, colon, rest = unquote(path).partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon and scheme == "file" else (f"file:/{path.lstrip('/')}" if path.startswith("/") else unquote(path))


def incoming_files(spark: SparkSession, incoming_dir: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every CSV file, plain or packed, that lies in the folder."""
    fs, p = file_system(spark, incoming_dir)
    if not fs.exists(p):
        return []
    return sorted((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())) for st in fs.listStatus(p)
                  if st.isFile() and st.getPath().getName().endswith(I.CSV_ENDINGS))


def _state(spark: SparkSession, path: str) -> tuple[str, int, int]:
    fs, p = file_system(spark, path)
    st = fs.getFileStatus(p)
    return st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())


def _split_name(name: str) -> tuple[str, str]:
    """Stem and ending; ``.csv.gz`` is one ending."""
    end = next((e for e in I.CSV_ENDINGS if name.endswith(e)), posixpath.splitext(name)[1])
    return name.removesuffix(end), end


def archive_file(spark: SparkSession, src: str, archive_dir: str, modified: int) -> bool:
    """Moves a file into the archive; if its name is taken there, the modification time is added to it."""
    fs, p = file_system(spark, src)
    folder = _path(spark)(archive_dir)
    fs.mkdirs(folder)
    target, n = _path(spark)(folder, p.getName()), 0
    while fs.exists(target):
        stem, end = _split_name(p.getName())
        target, n = _path(spark)(folder, f"{stem}-{modified}{f'-{n}' if n else ''}{end}"), n + 1
    return bool(fs.rename(p, target))


def ledger_statuses(store: I.TableStore, files: Iterable[tuple[str, int, int]]) -> dict[tuple[str, int, int], str]:
    """What the ledger says of some files: ``stored`` or ``rejected``."""
    files = list(files)
    if not files or not store.exists(LEDGER):
        return {}
    asked = store.spark.createDataFrame(files, "path string, length bigint, modified bigint")
    known = store.snapshots.read(LEDGER, keys=[f[0] for f in files])
    rows = known.join(asked, ["path", "length", "modified"], "left_semi").collect()  # one a file
    return {(r["path"], r["length"], r["modified"]): r["status"] for r in rows}


def _bad_files(parsed: DataFrame, strict: bool) -> dict[str, str]:
    """Files with a row that does not fit, and why (one aggregate over the group)."""
    bad = {}
    if strict:
        rows = parsed.where(F.col(I.PROBLEM).isNotNull()).groupBy(F.input_file_name().alias("path")).agg(F.min(I.PROBLEM).alias("why")).collect()
        bad |= {_plain(r["path"]): r["why"] for r in rows}
    return bad


def process_batch(store: I.TableStore, archive_dir: str, files: list, batch_id: int, strict: bool = True) -> dict:
    """Ingest some files, given by path or by (path, length, modification time). Returns
    ``{'appended': [...], 'rejected': [...]}`` (paths)."""
    if store.snapshots is None:
        raise ValueError("the file stream needs a table store in a folder")
    spark = store.spark
    files = sorted(_state(spark, f) if isinstance(f, str) else f for f in files)
    for attempt in range(I.RETRIES):
        try:
            stored, rejects = _publish_batch(store, files, batch_id, strict)
            break
        except Conflict:
            if attempt == I.RETRIES - 1:
                raise
    moved = []
    for path, _, modified in stored:
        try:
            if archive_file(spark, path, archive_dir, modified):
                moved.append(path)
        except Exception:  # noqa: BLE001 - the ledger keeps it from being appended again
            log.exception("archive move failed for %s", path)
    return {"appended": moved, "rejected": [f[0] for f, _ in rejects]}


def _groups(spark: SparkSession, spec: SC.TableSpec, group: list) -> list[tuple[list, bool]]:
    """Files that can be split, and files with a quoted line break, which are read whole (True)."""
    if spec.multi_line:
        return [(group, True)]
    broken = {_plain(r["path"]) for r in I.open_quotes(spark, [f[0] for f in group]).collect()}
    parts = [([f for f in group if _plain(f[0]) not in broken], False), ([f for f in group if _plain(f[0]) in broken], True)]
    return [(fs, whole) for fs, whole in parts if fs]


def _publish_batch(store: I.TableStore, files: list, batch_id: int, strict: bool) -> tuple[list, list]:
    """(files whose rows are stored, rejected files with the reason) after one published change."""
    spark = store.spark
    change = store.snapshots.change()
    known = ledger_statuses(store, files)
    stored = [f for f in files if known.get(f) == "stored"]  # not yet archived
    todo = [f for f in files if f not in known]
    rejects: list[tuple[tuple[str, int, int], str]] = []
    groups: dict[tuple[str, str], list[tuple[str, int, int]]] = {}
    headers = read_headers(spark, [f[0] for f in todo if I.route_file(f[0])]) if any(I.route_file(f[0]) for f in todo) else {}
    for f in todo:
        table, header = I.route_file(f[0]), headers.get(_plain(f[0]))
        if table is None or not header:
            rejects.append((f, "unrecognised file prefix" if table is None else "empty file"))
        else:
            groups.setdefault((table, header), []).append(f)
    fresh = []
    for (table, _), group in groups.items():
        spec, before = SC.spec_for(table), change.tables.get(table)
        done = []
        try:
            for part, whole in _groups(spark, spec, group):
                if whole and spec.multi_line is False:
                    rejects += [(f, "quoted line break") for f in part]
                    continue
                cols, types = _layout(store, change, spec)
                typed = I.as_stored(spec, types)
                parsed = I.parse_files(spark, [f[0] for f in part], typed, multi_line=whole)
                plain_cols = [c for c in cols if c not in BOOKKEEPING]
                problem = I.schema_problem([c for c in parsed.columns if c != I.PROBLEM], plain_cols)
                bad = dict.fromkeys((_plain(f[0]) for f in part), problem) if problem else _bad_files(parsed, strict)
                rejects += [(f, bad[_plain(f[0])]) for f in part if _plain(f[0]) in bad]
                good = [f for f in part if _plain(f[0]) not in bad]
                if good:
                    rows = I.parse_files(spark, [f[0] for f in good], typed, multi_line=whole).drop(I.PROBLEM)
                    if BOOKKEEPING[0] in cols:
                        plain = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/*", "file:/")
                        rows = rows.withColumn(BOOKKEEPING[0], plain).withColumn(BOOKKEEPING[1], F.lit(batch_id).cast("bigint"))
                    change.append(table, I.align_to(rows, cols, types))
                    done += good
        except Exception as e:  # noqa: BLE001 - a bad group must not stop the others
            log.exception("append failed for %s", group)
            change.tables.pop(table, None) if before is None else change.tables.update({table: before})
            refused = {f for f, _ in rejects}
            rejects += [(f, f"append failed: {type(e).__name__}") for f in group if f not in refused]
            done = []
        fresh += done
    # a group that failed to be written is tried again, so it is not in the ledger
    settled = [(*f, "stored", batch_id) for f in fresh] + [(*f, "rejected", batch_id) for f, why in rejects if not why.startswith("append failed")]
    if settled:
        change.append(LEDGER, spark.createDataFrame(settled, LEDGER_SCHEMA).coalesce(1), key="path")
    if rejects:
        rows = [(f[0], why, batch_id) for f, why in rejects]
        frame = spark.createDataFrame(rows, "path string, reason string, batch_id bigint").withColumn("logged_at", F.current_timestamp())
        change.append(REJECTED, frame.coalesce(1))
    if settled or rejects:
        change.publish()
    return stored + fresh, rejects


def _layout(store: I.TableStore, change, spec: SC.TableSpec) -> tuple[list[str], dict]:
    """Columns and types that a file is appended under; a table that the stream makes has the bookkeeping columns."""
    staged = change.tables.get(spec.name)
    if staged is not None:
        types = {f.name: f.dataType.simpleString() for f in staged.struct}
        return list(types), types
    cols, types = I.target_layout(store, spec)
    return ([*cols, *BOOKKEEPING], {**types, BOOKKEEPING[0]: "string", BOOKKEEPING[1]: "bigint"}) if not store.exists(spec.name) else (cols, types)


def publish_parts(spark: SparkSession, staging_dir: str, incoming_dir: str, stem: str) -> list[str]:
    """Move the ``part-*.csv`` (or packed ``part-*.csv.gz``) files of a Spark CSV
    write into ``incoming_dir`` as ``<stem>_<n>.csv`` (``.csv.gz``; rename only,
    the number of files is the number of written ones)."""
    fs, p = file_system(spark, staging_dir)
    dest = _path(spark)(incoming_dir)
    fs.mkdirs(dest)
    out = []
    parts = sorted(st.getPath().toString() for st in fs.listStatus(p)
                   if st.getPath().getName().startswith("part-") and st.getPath().getName().endswith(I.CSV_ENDINGS))
    for i, src in enumerate(parts):
        target = _path(spark)(dest, f"{stem}_{i:05d}{_split_name(src)[1]}")
        fs.rename(_path(spark)(src), target)
        out.append(target.toString())
    return out


def file_stream(spark: SparkSession, incoming_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming frame of new ``*.csv`` and ``*.csv.gz`` files under ``incoming_dir`` (metadata)."""
    return (spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
            .option("pathGlobFilter", "*.{csv,csv.gz}")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(incoming_dir)
            .select("path"))


def start_file_ingest(spark: SparkSession, incoming_dir: str, store: I.TableStore, archive_dir: str,
                      checkpoint: str | None = None, available_now: bool = False,
                      interval: str = "1 minute", max_files_per_trigger: int = 1000, strict: bool = True):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes what is there and stops (batch-style
    runs, tests); otherwise it polls every ``interval``. Pass a stable
    ``checkpoint`` path in the shared folder for a long-running ingest. Which
    files are done is kept in the ledger, not in the checkpoint, so either
    kind of start ingests each file once.
    """
    checkpoint = checkpoint or unique_dir(spark, "ingest-checkpoint")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        files = incoming_files(spark, incoming_dir)
        for first in range(0, len(files), max_files_per_trigger):
            res = process_batch(store, archive_dir, files[first : first + max_files_per_trigger], batch_id, strict)
            log.info("batch %s: appended %d, rejected %d", batch_id, len(res["appended"]), len(res["rejected"]))

    writer = (file_stream(spark, incoming_dir, max_files_per_trigger).writeStream
              .foreachBatch(on_batch).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def run_once(spark: SparkSession, incoming_dir: str, store: I.TableStore, archive_dir: str,
             checkpoint: str | None = None, strict: bool = True) -> None:
    """Process every file currently in ``incoming_dir`` and return."""
    q = start_file_ingest(spark, incoming_dir, store, archive_dir, checkpoint, available_now=True, strict=strict)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
