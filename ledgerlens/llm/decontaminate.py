"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Every k-gram of
words (``GRAM``) is hashed; of every ``WINDOW - GRAM + 1`` consecutive hashes the smallest is kept (the last of
equal ones) as a fingerprint. Two texts that share ``WINDOW`` words therefore share a fingerprint at the same
place of the shared words. The fingerprints of documents and benchmark are joined, and each hit is extended to
both sides along its diagonal, word by word; a run of ``WINDOW`` or more equal words is contamination. Items of
fewer words are matched whole: for each such length in the benchmark every document gram of that length is a
fingerprint.

The benchmark is a stated query set. It is cut into blocks of at most ``BLOCK_WORDS`` words (long items in
pieces that overlap by a window less one word, so no window is lost), each small enough to broadcast, and all
documents meet one block after the other; no fingerprint of a document leaves its task, and nothing
is ever shuffled, however many blocks there are: a row passes through one search a block. A hot passage costs its own length in
each document that holds it.

Defined cases: null text and text without words: no words, not contaminated; benchmark items without words,
null or repeated item ids: an item without words never matches, equal item_ids count once and a null item_id
counts hits but names no item; repeated documents each get their row; empty tables give an empty result or no
hits; extra columns pass through :func:`hits`; a very long text is searched whole, in a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common as C

WINDOW = 10
GRAM = 6
BLOCK_WORDS = 2_000_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the number of its words."""
    data = _LOWERED[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)] if texts else np.zeros(0, np.uint8)
    inside = _WORD_BYTE[data]
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0) if texts else np.zeros(0, np.int64)
    return C.range_hashes(C.prefix_sums(data), starts, ends), counts


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) of every ``width`` consecutive hashes."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    last_smallest = width - 1 - view[:, ::-1].argmin(axis=1)
    picked = last_smallest + np.arange(len(view))
    return picked[np.diff(picked, prepend=-1) != 0]


class Block:
    """Fingerprints of some items, ready to be searched. ``items``: (item_id, word hashes)."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int, gram: int):
        self.items, self.window, self.gram = items, window, gram
        self.short = sorted({len(w) for _, w in items if 0 < len(w) < window})
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (_, words) in enumerate(items):
            size = gram if len(words) >= window else len(words)
            if not size:
                continue
            grams = C.gram_hashes(words, size)
            places = winnow(grams, window - gram + 1) if len(words) >= window else [0]
            for p in places:
                found.setdefault(int(grams[p]), []).append((i, int(p), size))
        self.found = found
        self.hashes = np.array(sorted(found), np.uint64)

    def candidates(self, grams: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document place, item, item place, gram size) of the fingerprints that both sides hold."""
        keys = grams[places]
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        for p, key in zip(places[self.hashes[at] == keys].tolist(), keys[self.hashes[at] == keys].tolist(), strict=True):
            for item, q, size in self.found[key]:
                yield p, item, q, size

    def spans(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans of a document inside occurrences of windows, and the items that have one."""
        spans, items, done = [], set(), set()
        if not len(self.hashes):
            return spans, items
        searched = [(self.gram, winnow(C.gram_hashes(words, self.gram), self.window - self.gram + 1))] if len(words) >= self.window else []
        searched += [(n, np.arange(len(words) - n + 1)) for n in self.short if n <= len(words)]
        for size, places in searched:
            if not len(places):
                continue
            for p, item, q, gram in self.candidates(C.gram_hashes(words, size), places):
                if gram != size:
                    continue
                target = self.items[item][1]
                shift, need = p - q, min(self.window, len(target))
                if (item, shift, size) in done:
                    continue
                done.add((item, shift, size))
                first, last = max(0, shift), min(len(words), shift + len(target))
                equal = np.concatenate([[False], words[first:last] == target[first - shift : last - shift], [False]])
                edges = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
                for a, b in edges.tolist():
                    if b - a >= need:
                        spans.append((first + a, first + b))
                        items.add(item)
        return spans, items


def blocks(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, cut; only one block at a time is held by the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words, _ = word_hashes([(row["text"] or "").encode()])
        step = block_words - window + 1
        for start in range(0, max(1, len(words) - window + 1), step):
            piece = words[start : start + block_words]
            if held and size + len(piece) > block_words:
                yield Block(held, window, gram)
                held, size = [], 0
            held.append((row["item_id"], piece))
            size += len(piece)
    if held:
        yield Block(held, window, gram)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with _n_words, _spans (sorted, disjoint word spans inside window occurrences) and _items; columns of
    these names that ``docs`` has are replaced."""
    if window < gram:
        raise ValueError("a window holds at least one gram")
    context, found, first = docs.sparkSession.sparkContext, docs, True
    for block in blocks(benchmark, window, gram, block_words):
        found, first = _searched(found, context.broadcast(block), first), False
    return _searched(docs, None, True) if first else found


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _searched(docs: DataFrame, held, first: bool) -> DataFrame:
    """Adds one block's hits to the rows; of every row all columns pass through the task."""
    plain = [f for f in docs.schema.fields if f.name not in ("_n_words", "_spans", "_items")]
    span = StructType([StructField("first", LongType()), StructField("last", LongType())])
    schema = StructType([*plain, StructField("_n_words", LongType()), StructField("_spans", ArrayType(span)),
                         StructField("_items", ArrayType(StringType()))])
    names = [f.name for f in plain]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value if held else None
        for batch in batches:
            for part in C.slices(batch, "text"):
                words, counts = word_hashes(C.text_bytes(part.column("text")))
                spans, items, at = [], [], 0
                old = [[]] * len(counts) if first else [[(s["first"], s["last"]) for s in x] for x in part.column("_spans").to_pylist()]
                named = [[]] * len(counts) if first else part.column("_items").to_pylist()
                for n, before, names_before in zip(counts.tolist(), old, named, strict=True):
                    more, which = block.spans(words[at : at + n]) if block and n else ([], set())
                    at += n
                    spans.append([{"first": a, "last": b} for a, b in union([*before, *more])])
                    ids = {block.items[i][0] for i in which} if which else set()
                    items.append(sorted({*names_before, *(str(i) for i in ids if i is not None)}))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(spans, _SPAN),
                     pa.array(items, pa.list_(pa.string()))], names=[*names, "_n_words", "_spans", "_items"])

    return docs.mapInArrow(search, schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(spans):
    """Words inside the spans, as a column expression."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"])
