"""Line dedup over levelled sorted runs of line hashes.

A run is a table (128-bit line hash, number of documents that hold the line), bucketed and sorted by the hash.
Documents arrive in batches. A batch's lines are folded to one row a line, merge-anti-joined with the runs on
the sorted buckets to leave out lines that are already known to be over the limit, and written as a run of
level 0. When a level holds ``fanout`` runs, they are merged into one run of the next level and their files go. All
runs share one bucketing, so a join with a run shuffles only the batch.

:func:`drop_frequent_lines` feeds a whole table through the runs, in more batches than the fan-out at any size, so
that levels are built, and then removes, from every document, the lines found in at least ``min_docs`` documents.
Texts are split once: the hashes of every line, with its place, are written by batch, and all later steps but the
last read those. Lines are shuffled as hashes; texts move once, to meet the positions that they lose. Counts are
folded per task first, so the most common line costs one row a task.

Defined cases: null or empty text is one empty line, which is never dropped at ``min_key`` 1 or more; every row
is a document, also a repeated one; an empty table gives an empty result; other columns pass through unchanged; texts
are split whole, however long. Ties do not arise: a line is counted, not ranked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unique_dir
from . import common as C

MIN_DOCS = 10
MIN_KEY = 1
FANOUT = 4
BATCHES = 6
HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return C.ascii_lower(C.stripped(line))


class LineRuns:
    """Levelled runs of line hashes with document counts; ``levels[i]`` lists the run tables of level i."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of ``lines`` whose hash is in no run."""
        for run in self.runs():
            lines = lines.join(self.spark.table(run), HASH, "left_anti")
        return lines

    def add(self, docs: DataFrame) -> None:
        """Count the lines of a batch of (_h1, _h2) rows, one row a line and document, as a new run."""
        batch = docs.groupBy(*HASH).agg(F.count(F.lit(1)).alias("_docs"))
        for run in self.runs():
            batch = batch.join(self.spark.table(run).where(F.col("_docs") >= self.min_docs), HASH, "left_anti")
        self.levels[0].append(self._written(batch))
        self._compact()

    def frequent(self) -> DataFrame:
        """Hashes found in at least ``min_docs`` documents of all batches."""
        return self._merged(self.runs()).where(F.col("_docs") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        """Delete all runs; nothing may read them any more."""
        self._drop(self.runs())
        self.levels = [[]]

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            C.discard(self.spark, self._paths.pop(run))

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._written(self._merged(runs)))
                self._drop(runs)
                self.levels[level] = []

    def _merged(self, runs: list[str]) -> DataFrame:
        """Sum of the counts. The runs are joined bucket by bucket, which needs no shuffle."""
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).withColumnRenamed("_docs", "_more")
            merged = merged.join(other, HASH, "full_outer").select(
                *HASH, (F.coalesce("_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("_docs"))
        return merged

    def _written(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = unique_dir(self.spark, "line-run")
        (run.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", self._paths[name]).saveAsTable(name))
        return name


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]


#: In place of a batch: rows with the places of lines.
PLACES = -1


def _line_hashes(docs: DataFrame, min_key: int, batches: int) -> DataFrame:
    """Line hashes of every document, in one pass: each different line once, in the document's batch, and every line
    with the text's digest and its place, in the batch ``PLACES``."""
    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("_batch"), C.digest(C.whole_text()).alias("_digest"),
                        F.transform(F.split(C.whole_text(), "\n"), line_key).alias("_keys"))
    long = lambda key: F.char_length(key) >= min_key
    once = F.transform(F.filter(F.array_distinct("_keys"), long), lambda k: F.struct(F.lit(None).cast("int").alias("at"), k.alias("key")))
    places = F.filter(F.transform("_keys", lambda k, i: F.struct(i.alias("at"), k.alias("key"))), lambda x: long(x["key"]))
    lines = texts.select("_batch", "_digest", F.explode(F.concat(once, places)).alias("_x"))
    at, key = F.col("_x.at"), F.col("_x.key")
    return lines.select(F.when(at.isNull(), F.col("_batch")).otherwise(F.lit(PLACES)).alias("_batch"),
                        F.when(at.isNotNull(), F.col("_digest")).alias("_digest"), at.alias("_at"), *_hashes(key))


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, batches: int = BATCHES,
                        fanout: int = FANOUT) -> DataFrame:
    """Rows of ``_doc`` (the document, with the text left after dropping), _n_lines (before dropping) and _n_dropped."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    hashes, path = C.saved_at(_line_hashes(docs, min_key, batches), "line-hashes", by="_batch")
    for b in range(batches):
        runs.add(hashes.where(F.col("_batch") == b).select(*HASH))
    frequent = C.saved(runs.frequent(), "frequent-lines")
    runs.close()
    # written, so that the join below has plain shuffles on both sides and Spark can split a text with many copies
    found = C.saved(hashes.where(F.col("_batch") == PLACES).join(frequent, HASH, "left_semi")
                    .groupBy("_digest").agg(F.collect_set("_at").alias("_lost")), "lost-lines")
    C.discard(spark, path)
    rows = docs.select(C.as_struct(docs), C.digest(C.whole_text()).alias("_digest"), F.split(C.whole_text(), "\n").alias("_lines"))
    joined = rows.join(found, "_digest", "left").withColumn("_lost", F.coalesce("_lost", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost"), lambda i: F.get("_lines", i))
    return joined.select(F.col("_doc").withField("text", F.array_join(kept, "\n")).alias("_doc"), F.size("_lines").cast("bigint").alias("_n_lines"),
                         F.size("_lost").cast("bigint").alias("_n_dropped"))
