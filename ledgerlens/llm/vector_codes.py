"""Vector code compression: product codebooks by exact integer rounds, with norm-of-sum bounds before rescans.

Components become integers, vectors are cut into equal consecutive parts, and each part position gets a codebook of
``entries`` entries. A round assigns every part to its nearest entry and moves each entry to the floored mean of its
parts. All distances, sums and means are exact integers, so results do not depend on partitioning.

Bounds: a part carries its entry, an upper bound on the distance to it, a lower bound on the distance to every other
entry, and for each bound the round in which it was exact (its stamp). All codebooks so far are kept. In round t a
bound of stamp s is moved by the net displacement ``|C_t[e] - C_s[e]|`` - the norm of the sum of the moves since s -
and not by the sum of the norms that running bounds would gather, which is never smaller. If the upper bound stays
below the lower one, nothing is computed; otherwise the distance to the own entry is made exact (stamp t), and only
if that is not enough all entries are scanned. Bounds are rounded outwards and compared strictly, so a tie always
reaches the scan, which takes the lower index.

Spark: vectors and bounds are one table in the shared folder, rewritten once a round; the table before it is deleted.
Sums are kept by the driver, parts x entries x width numbers whatever the number of rows, and each round adds only
what moved: every task folds its moved parts to one row a codebook cell. The codebooks, of the same size, go to the
tasks with the closure.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; null ids order last and
repeated ids by their vectors; with fewer kept rows than ``entries`` the codebooks are as short; vectors of length 0
get code 0 and error 0; an empty table gives an empty result; extra columns are ignored. Ties in distance go to the
lower index. Kept vectors of different lengths, of a length that ``parts`` does not divide, or with components whose
errors could not be told in 64 bits (over 2**30 / sqrt(length) after scaling) raise a ValueError in the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components held as 64-bit numbers at a time in a task.
BLOCK = 1 << 20

_STATE = "x array<int>, codes binary, was binary, stamps binary, bounds binary, error bigint"


def _bad(message: str) -> ValueError:
    return ValueError(f"vectors cannot be coded: {message}")


def integers(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, x) of the rows that are kept, x as integers."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                            F.col(vector).cast("array<double>").alias("v"))
    kept = source.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(scale))
            lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            if len(flat) and np.abs(flat).max() > 2.0**30 / np.sqrt(max(1, lengths.max())):
                raise _bad("a component is too large for errors of 64 bits")
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), x], ["id", "label", "x"])

    types = dict(source.dtypes)
    return kept.mapInArrow(scaled, f"id {types['id']}, label {types['label']}, x array<int>")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _fixed(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the entries of a codebook."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


class Moves:
    """Net displacements of every entry between each earlier codebook and the newest one, rounded outwards."""

    def __init__(self, books: list[np.ndarray]):
        now = books[-1].astype(np.float64)
        net = np.stack([np.sqrt(((now - b) ** 2).sum(axis=2)) for b in books])  # stamp, part, entry
        self.own = net * (1 + 1e-12)
        first = net.argmax(axis=2)
        rest = net.copy()
        np.put_along_axis(rest, first[..., None], -1.0, axis=2)
        self._first, self._most, self._next = first, net.max(axis=2), rest.max(axis=2)

    def others(self, stamp: np.ndarray, part: int, entry: np.ndarray) -> np.ndarray:
        """The largest displacement of any entry but the own one."""
        most = np.where(self._first[stamp, part] == entry, self._next[stamp, part], self._most[stamp, part])
        return np.maximum(most, 0) * (1 + 1e-12)


def assign_part(x: np.ndarray, part: int, books: list[np.ndarray], moves: Moves, code: np.ndarray, stamps: np.ndarray,
                bounds: np.ndarray) -> tuple[int, int]:
    """Newest assignment of one part position; changes code, stamps and bounds in place.

    Returns how many own distances were made exact and how many parts were scanned."""
    now, book = len(books) - 1, books[-1][part]

    def open_rows(rows: np.ndarray) -> np.ndarray:
        up = bounds[rows, 0] + moves.own[stamps[rows, 0], part, code[rows]]
        low = bounds[rows, 1] - moves.others(stamps[rows, 1], part, code[rows])
        return rows[~(up * (1 + 1e-6) + 1e-6 < low * (1 - 1e-6))]

    rows = open_rows(np.arange(len(x)))
    own = ((x[rows] - book[code[rows]]) ** 2).sum(axis=1)
    bounds[rows, 0], stamps[rows, 0] = np.sqrt(own), now
    scan = open_rows(rows)
    if len(scan):
        d = squared(x[scan], book)
        best = d.argmin(axis=1)  # the first of equal ones
        code[scan] = best
        bounds[scan, 0] = np.sqrt(np.take_along_axis(d, best[:, None], 1)[:, 0])
        np.put_along_axis(d, best[:, None], np.iinfo(np.int64).max, 1)
        bounds[scan, 1] = np.sqrt(d.min(axis=1)) if d.shape[1] > 1 else np.inf
        stamps[scan] = now
    return len(rows), len(scan)


def assigned(state: DataFrame, books: list[np.ndarray], first: bool) -> DataFrame:
    """The state after the newest assignment; ``was`` holds the codes before it, ``error`` the exact squared error."""
    parts, _, width = books[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(books)
        for batch in _blocks(batches, parts * width):
            n = batch.num_rows
            x = _matrix(batch.column("x"), parts * width).reshape(n, parts, width)
            if first:
                code, stamps = np.zeros((n, parts), np.uint8), np.zeros((n, parts, 2), np.uint8)
                bounds = np.zeros((n, parts, 2), "<f4")
                bounds[..., 0] = np.inf
            else:
                code, stamps = _fixed(batch.column("codes"), "u1", parts).copy(), _fixed(batch.column("stamps"), "u1", parts, 2).copy()
                bounds = _fixed(batch.column("bounds"), "<f4", parts, 2).copy()
            was = code.copy()
            error = np.zeros(n, np.int64)
            for p in range(parts):
                own, stamp, bound = code[:, p].astype(np.int64), stamps[:, p].astype(np.int64), bounds[:, p].astype(np.float64)
                assign_part(x[:, p], p, books, moves, own, stamp, bound)
                code[:, p], stamps[:, p], bounds[:, p] = own, stamp, bound
                error += ((x[:, p] - books[-1][p][own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("x"), _binary(code), _binary(was), _binary(stamps),
                 _binary(bounds), pa.array(error)], ["id", "label", "x", "codes", "was", "stamps", "bounds", "error"])

    types = dict(state.dtypes)
    return state.select(*(c for c in ("id", "label", "x", "codes", "stamps", "bounds") if c in types)).mapInArrow(
        run, f"id {types['id']}, label {types['label']}, {_STATE}")


def _changes(state: DataFrame, shape: tuple[int, int, int], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the last assignment changes in every entry's sum and count."""
    parts, entries, width = shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in _blocks(batches, parts * width):
            x = _matrix(batch.column("x"), parts * width).reshape(batch.num_rows, parts, width)
            code, was = (_fixed(batch.column(c), "u1", parts) for c in ("codes", "was"))
            row = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], axis=2)
            for p in range(parts):
                moved = np.full(len(code), True) if first else code[:, p] != was[:, p]
                np.add.at(total[p], code[moved, p], row[moved, p])
                if not first:
                    np.subtract.at(total[p], was[moved, p], row[moved, p])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "total"])

    moved = state if first else state.where(F.col("codes") != F.col("was"))
    cells = moved.select("x", "codes", "was").mapInArrow(fold, "at bigint, total bigint").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in cells.collect():  # parts x entries x (width + 1) numbers at most
        total[r["at"]] = r["total"]
    total = total.reshape(parts, entries, width + 1)
    return total[..., :width], total[..., width]


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, codes, error) of the kept vectors, and the codebooks of all rounds (parts, entries, width)."""
    if not 1 <= entries <= 256 or not 0 <= rounds <= 255:
        raise ValueError("1 to 256 entries and at most 255 rounds fit in the codes")
    spark = vectors.sparkSession
    state, path = C.saved_at(integers(vectors, id_col, vector, label, scale), "vectors")
    lengths = state.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if lengths["low"] != lengths["high"] or (lengths["low"] or 0) % parts:
        raise _bad(f"lengths from {lengths['low']} to {lengths['high']} for {parts} parts")
    seeds = [r["x"] for r in state.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    width = (lengths["low"] or 0) // parts
    seed = np.array(seeds, np.int64).reshape(len(seeds), parts, width)
    books = [np.ascontiguousarray(seed.transpose(1, 0, 2))]
    if not seeds:
        return state.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("bigint").alias("error")), books
    sums, counts = np.zeros(books[0].shape, np.int64), np.zeros(books[0].shape[:2], np.int64)
    for t in range(rounds + 1):
        after, at = C.saved_at(assigned(state, books, t == 0), f"vector-codes-{t}")
        C.discard(spark, path)
        state, path = after, at
        if t < rounds:
            more, n = _changes(state, books[0].shape, t == 0)
            sums, counts = sums + more, counts + n
            means = sums // np.maximum(counts, 1)[..., None]
            books.append(np.where(counts[..., None] > 0, means, books[-1]))
    return state.select("id", "label", "codes", "error"), books


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, as comma-joined decimals."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over equal labels, null labels together."""
    sums = C.saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
