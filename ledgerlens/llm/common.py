"""Helpers shared by the operators: table access, scratch tables, text columns, byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unique_dir

#: White space of every contract: blank and the control characters 9 to 13.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back (cuts the lineage)."""
    return saved_at(df, label)[0]


def saved_at(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """As :func:`saved`, with the folder, for tables that their writer discards; ``by`` gives each value of a column
    files of its own."""
    spark = df.sparkSession
    path = unique_dir(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def as_struct(docs: DataFrame) -> Column:
    """All columns of a row as ``_doc``, so that no helper column can clash with one of them; ``_doc.*`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` equals that on pure ASCII and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def digest(c: Column) -> Column:
    """16-byte identity of a text."""
    return F.unhex(F.md5(c))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text of an Arrow string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


# -- 64-bit hashing of byte ranges (vectorised, wraps modulo 2**64) ---------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n+1 powers of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power, so that any range's hash is a difference."""
    forward, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * forward[:-1], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end): equal bytes give equal hashes wherever they stand."""
    _, back = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items (fewer items than k: none)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + items[j : j + n]
    return mix(out)
