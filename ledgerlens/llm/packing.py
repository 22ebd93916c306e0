"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

:func:`token_pieces` encodes every whole text, appends an end id and cuts the ids into pieces of at most
``size``; all but a document's last piece are full. The pieces are written to a table in the shared folder, so
that every later step reads the same rows. :func:`place` gives each piece a sequence and an offset: a full piece
is a sequence of its own; the others are dealt into randomised groups of about ``group_rows`` and packed there by
first-fit decreasing. The tree holds the largest free capacity below each node, so the first bin that fits is
found in log2(bins) steps. Only (piece, length) rows reach the groups. :func:`sequences` joins the ids.

Groups come from a hash of the piece number, not of the document, so repeated rows and hot keys spread evenly.
Padding is below 1 % of a group, as the many short pieces fill what the long ones leave.

Defined cases: null text counts as empty (one piece that holds the end id); null and repeated doc_id and
repeated rows are kept, each row packed once; very long texts are cut; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE = 1024
GROUP_ROWS = 4096

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


class TournamentTree:
    """Free capacities of the bins as leaves; every inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.node = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with room for ``need``, whose capacity is lowered; there must be one."""
        node, i, leaves = self.node, 1, self.leaves
        while i < leaves:
            i *= 2
            if node[i] < need:
                i += 1
        bin_ = i - leaves
        node[i] -= need
        while i > 1:
            i //= 2
            best = max(node[2 * i], node[2 * i + 1])
            if node[i] == best:
                break
            node[i] = best
        return bin_


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item."""
    tree, used = TournamentTree(len(lengths), size), np.zeros(len(lengths), np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        bins[i] = b = tree.first_fit(need)
        offsets[i] = used[b]
        used[b] += need
    return bins, offsets


def token_pieces(docs: DataFrame, encoder: Callable, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """(piece, doc_id, start, length, doc_tokens, ids), written to the shared folder. ``encoder`` returns, in the
    task, an object whose ``encode(text)`` gives little-endian 16-bit ids; ``ids`` are 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(np.frombuffer(encode(text or ""), "<u2").astype("<u4"), np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    out += [(doc, s, min(size, n - s), n, ids[s : s + size].tobytes()) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)
    return C.saved(rows.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def place(pieces: DataFrame, size: int = SIZE, group_rows: int = GROUP_ROWS, seed: int = 0) -> DataFrame:
    """(piece, sequence_id, offset). Even sequence ids are single full pieces, odd ones are packed."""
    full = pieces.where(F.col("length") == size).select(
        "piece", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < size).select("piece", "length")
    groups = max(1, -(-rest.count() // group_rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        # a bin is named after its first piece, which no other bin holds
        first = group["piece"].to_numpy()[offsets == 0][np.argsort(bins[offsets == 0])]
        return pd.DataFrame({"piece": group["piece"], "sequence_id": first[bins] * 2 + 1, "offset": offsets})

    packed = (rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "piece"), F.lit(groups)))
              .groupBy("_group").applyInPandas(lambda g: pack(g[["piece", "length"]]),
                                               "piece bigint, sequence_id bigint, offset bigint"))
    return full.unionByName(packed)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """Every piece with its ids and its place in a sequence."""
    return pieces.join(placed, "piece")


def padded_length(used: int, size: int = SIZE) -> int:
    """Stored length of a sequence: ``size``, unless what it holds is a power of two."""
    return used if used and used & (used - 1) == 0 else size
