"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: hash = 2 * hash + gear[byte], so the low ``WINDOW`` bytes decide it.
A chunk ends where the top ``BITS`` bits of the hash are zero and at least ``SMALLEST`` bytes are held, or at
``LARGEST`` bytes. Cuts depend on content alone, so chunks resist shifts from insertions and agree again soon
after a difference. Chunks are named by a 128-bit digest; of equal chunks, the one in the document with the
smallest doc_id (then the smallest offset) stays and the others are removed. Chunks below ``SMALLEST`` bytes (a
text's last one only) stay.

The chunk list is written once to the shared folder. Its digests are folded to (digest, first place) with
partial sums per task, so a passage in a third of all documents costs one row a task; only digests found twice
are joined back, in a sort-merge join that Spark can split where a digest is hot.

Defined cases: null text counts as empty; rows with a null doc_id come after all others; rows of one doc_id
are one document, so a chunk that stays in one of them stays at the same offset of the others; ties go to the
smaller offset; an empty table gives an empty result; extra columns are ignored; a very long text is cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SMALLEST, LARGEST, BITS, WINDOW = 32, 256, 5, 32
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, by doubling: the sum over 2w bytes is that over w, plus that over the
    w before, shifted."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    marks = (np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1).tolist()
    ends, last = [], 0
    for m in marks:
        while m - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if m - last >= SMALLEST:
            last = m
            ends.append(m)
    while n - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, "text"):
            row, at, size, name = [], [], [], []
            for r, data in enumerate(C.text_bytes(part.column("text"))):
                last = 0
                for end in chunk_ends(data):
                    if end - last >= SMALLEST:
                        row.append(r)
                        at.append(last)
                        size.append(end - last)
                        name.append(hashlib.blake2b(data[last:end], digest_size=16).digest())
                    last = end
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("_order").take(take), part.column("_text").take(take), pa.array(at, pa.int32()),
                 pa.array(size, pa.int32()), pa.array(name, pa.binary())],
                names=["_order", "_text", "_at", "_size", "_name"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for data, spans in zip(C.text_bytes(batch.column("text")), batch.column("_spans").to_pylist(), strict=True):
            out, last = [], 0
            for span in sorted(spans or (), key=lambda s: s["_at"]):
                out.append(data[last : span["_at"]])
                last = span["_at"] + span["_size"]
            out.append(data[last:])
            kept.append(b"".join(out))
            removed.append(sum(s["_size"] for s in spans or ()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()),
                                          pa.array(removed, pa.int64()), batch.column("_spans"), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``kept`` holds the bytes that stay, ``spans`` what was removed."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text",
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("_order"),
                       F.xxhash64(C.whole_text()).alias("_text"))
    chunks = C.saved(rows.select("_order", "_text", "text").mapInArrow(
        _digests, "_order bigint, _text bigint, _at int, _size int, _name binary"), "chunks")
    first = (chunks.groupBy("_name").agg(F.min(F.struct("_order", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").select("_name", "_first"))
    lost = C.saved(chunks.join(first, "_name").where(F.col("_first") != F.struct("_order", "_at"))
            .groupBy("_order", "_text").agg(F.collect_set(F.struct("_at", "_size")).alias("_spans")), "lost-chunks")
    return rows.join(lost, ["_order", "_text"], "left").select("doc_id", "text", "_spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<_at:int,_size:int>>, kept binary")
