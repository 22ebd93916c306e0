"""Exact substring dedup by prefix-free parsing.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller doc_id.

1. Parse. A rolling hash runs over ``GRAM``-byte strings; in every ``SPAN``-byte window the smallest hash (first
   of equal ones) is the trigger. Windows in a row with one trigger make a phrase: the bytes that they cover. The
   choice depends on the window's bytes alone, so equal windows have equal triggers at the same place, and every
   window belongs to one phrase.
2. Dictionary. A phrase is named by hashes of its trigger and its bytes. Each task folds its phrases to one entry
   with the first document; entries meet by trigger. A phrase that an earlier document holds is removed whole.
   This settles the inside of every repeated passage, of any length, without looking at its windows.
3. Suffix order. Where one trigger has several phrases - at the ends of passages - the different phrases
   themselves are fetched, and their suffixes, as far as a window reaches, are sorted into one array; neighbours
   that agree in ``SPAN`` bytes are the same window, whose first document is the smallest in the run.
4. The answers meet the texts again and the covered bytes are cut out.

Texts are stored once, as segments of about ``SEGMENT`` bytes in a table that is bucketed by segment number; the
answers are joined to the buckets, so texts are never shuffled. A passage in a third of all documents is one
dictionary entry a segment. A text longer than a segment is parsed in pieces that overlap by a window, and only such
texts move once more, to meet the spans of their pieces. Every step works on bounded pieces: hashes of a segment are
taken ``BLOCK`` bytes at a time; a task holds one trigger bucket, of which there are as many as the bytes ask for; the
suffixes of a bucket are sorted in parts of about ``WINDOWS``, dealt by the hash of the window. Where a trigger has
over ``HOT`` phrases - a common line has other neighbours in every document - the windows are dealt anew by trigger
and the bytes around it that all windows with the trigger at about the same place share.

Defined cases: null text counts as empty; rows with a null doc_id come after all others and do not count against
each other, nor do rows of equal doc_id; an empty table gives an empty result; a text longer than a segment is a
segment of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import unique_dir
from . import common as C

SPAN = 50
GRAM = 20
SEGMENT = 4 << 20
BLOCK = 256 << 10  # windows that are hashed at a time
BUCKET_BYTES = 16 << 20  # bytes of text for each bucket of triggers
WINDOWS = 1 << 20  # windows that are sorted at a time
HOT = 4096  # phrases of a trigger that one bucket takes
PLACES = 8  # places of the trigger in a window that stay together if it has more
LAST = (1 << 63) - 1

_ENTRY = np.dtype([("name", "<u8"), ("more", "<u2")])  # a phrase's name and 16 further bits of its trigger
_LOW48 = np.uint64((1 << 48) - 1)


@dataclass
class Parse:
    """Phrases of a segment: windows first..last (starts) of document ``doc`` with the trigger at ``at``."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    trigger: np.ndarray
    name: np.ndarray
    more: np.ndarray


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM, block: int | None = None) -> Parse:
    """Parses the documents [start, end) of a segment's bytes, ``block`` windows at a time; a block begins where a phrase does."""
    windows, block = max(len(data) - span + 1, 0), block or BLOCK
    inside = np.zeros(windows, bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= span:
            inside[a : b - span + 1] = True
    found, begin = [], 0
    while begin < windows:
        end = min(begin + block, windows)
        part = _block(data[begin : end + span - 1], inside[begin:end], span, gram)
        first, last = part[0], part[1]
        upto = end
        if len(first) and end < windows and last[-1] == end - begin - 1:  # may go on behind the block, which is longer than any phrase
            upto = begin + int(first[-1])
            part = [x[:-1] for x in part]
        found.append([*(x + begin for x in part[:3]), *part[3:]])
        begin = upto
    none = np.zeros(0, np.int64)
    first, last, at, trigger, phrase = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    name = (phrase & _LOW48) | ((trigger & np.uint64(0xFFFF)) << np.uint64(48))
    return Parse(first, last, at, np.searchsorted(starts, first, side="right") - 1, trigger, name,
                 ((trigger >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16))


def _block(data: np.ndarray, inside: np.ndarray, span: int, gram: int) -> list[np.ndarray]:
    """First and last window, place of the trigger, trigger and hash of every phrase; ``inside`` says which windows count."""
    sums = C.prefix_sums(data)
    places = np.arange(len(data) - gram + 1)
    grams = C.range_hashes(sums, places, places + gram)
    low, width, want = grams, 1, span - gram + 1
    while width < want:  # smallest hash of every window
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # a phrase ends where the smallest hash changes or where its place, the first of equal ones, leaves the window
    cut = np.ones(len(low) + 1, bool)
    cut[1:-1] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside)
    at, open_ = first.copy(), np.arange(len(first))
    smallest = low[first]
    while len(open_):  # at most as many steps as a window has places
        open_ = open_[grams[at[open_]] != smallest[open_]]
        at[open_] += 1
    phrase = C.mix(C.range_hashes(sums, first, last + span) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [first, last, at, grams[at], phrase]


def _bucket(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _first_holders(p: Parse, order: np.ndarray) -> np.ndarray:
    """Of the phrases with equal names, the place of one in the segment's first document that holds it."""
    by = np.lexsort((order[p.doc], p.name))
    names = p.name[by]
    return by[np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))] if len(by) else by


# -- segments -----------------------------------------------------------------------------------

_SEGMENT = "segment bigint, orders binary, sizes binary, data binary, digest string, offset bigint"


def _segments(segment: int):
    """Short texts side by side in segments; a text over a segment in pieces of its own that overlap by a window, so
    that each of its windows lies in one piece. Pieces carry the text's digest and their place."""

    def row(number: int, held: list[bytes], orders: list[int], digest: str | None = None, offset: int | None = None) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in held], "<i8")
        columns = [np.array(orders, "<i8").tobytes(), sizes.tobytes(), b"".join(held)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in columns),
                                           pa.array([digest], pa.string()), pa.array([offset], pa.int64())],
                                          names=["segment", "orders", "sizes", "data", "digest", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, orders, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for order, text in zip(batch.column("_order").to_pylist(), C.text_bytes(batch.column("text")), strict=True):
                if len(text) > segment:
                    digest = hashlib.md5(text).hexdigest()
                    for offset in range(0, len(text) - SPAN + 1, segment):
                        yield row(number, [text[offset : offset + segment + SPAN - 1]], [order], digest, offset)
                        number += 1
                    continue
                if held and size + len(text) > segment:
                    yield row(number, held, orders)
                    number, held, orders, size = number + 1, [], [], 0
                held.append(text)
                orders.append(order)
                size += len(text)
        if held:
            yield row(number, held, orders)

    return run


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, segment, data, starts, ends, orders) of every segment in a batch."""
    for i in range(batch.num_rows):
        sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i8")
        ends = np.cumsum(sizes)
        yield (i, batch.column("segment")[i].as_py(), np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), ends - sizes, ends,
               np.frombuffer(batch.column("orders")[i].as_buffer(), "<i8"))


def _rows(segments: list[int], buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())],
                                      names=["segment", "bucket", "payload"])


# -- dictionary ---------------------------------------------------------------------------------

def _entries(buckets: int):
    """One row per segment and trigger bucket: documents (order, entries) and their dictionary entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, segment, data, starts, ends, orders in _opened(batch):
                p = parse(data, starts, ends)
                one = _first_holders(p, orders)
                if not len(one):  # texts shorter than a window only
                    continue
                where = _bucket(p.trigger[one], buckets)
                by = np.lexsort((orders[p.doc[one]], where))
                one, where = one[by], where[by]
                entries = np.empty(len(one), _ENTRY)
                entries["name"], entries["more"] = p.name[one], p.more[one]
                order = orders[p.doc[one]]
                found, begin = np.unique(where, return_index=True)
                run = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (order[1:] != order[:-1])]))
                docs, counts = order[run].astype("<i8"), np.diff(run, append=len(one)).astype("<u4")
                payloads, ends_ = [], [*begin[1:].tolist(), len(one)]
                for a, b, c, d in zip(begin.tolist(), ends_, np.searchsorted(run, begin).tolist(), np.searchsorted(run, ends_).tolist(), strict=True):
                    payloads.append(np.uint32(d - c).tobytes() + docs[c:d].tobytes() + counts[c:d].tobytes() + entries[a:b].tobytes())
                yield _rows([segment] * len(found), found.tolist(), payloads)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[pa.Buffer]]:
    """Segments and payloads of a bucket; payloads are not copied."""
    segments, payloads = [], []
    for b in batches:
        segments += b.column("segment").to_pylist()
        payloads += [x.as_buffer() for x in b.column("payload")]
    return segments, payloads


def _by_source(source: np.ndarray, sources: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of every source that occurs."""
    by, begin = np.argsort(source, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(source, minlength=sources))]).tolist()
    return ((k, by[begin[k] : begin[k + 1]]) for k in range(sources) if begin[k] < begin[k + 1])


def _answers(most: int):
    """Per segment: names of phrases that an earlier document holds, of phrases to be fetched, and of such whose trigger is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, payloads = _gathered(batches)
        if not segments:
            return
        names, more, orders, source = [], [], [], []
        for k, payload in enumerate(payloads):
            n = int(np.frombuffer(payload, "<u4", 1)[0])
            docs, counts = np.frombuffer(payload, "<i8", n, 4), np.frombuffer(payload, "<u4", n, 4 + 8 * n)
            entries = np.frombuffer(payload, _ENTRY, -1, 4 + 12 * n)
            names.append(entries["name"])
            more.append(entries["more"])
            orders.append(np.repeat(docs, counts))
            source.append(np.full(len(entries), k, np.int32))
        name, order, source = np.concatenate(names), np.concatenate(orders), np.concatenate(source)
        trigger = (name >> np.uint64(48)).astype(np.uint32) | (np.concatenate(more).astype(np.uint32) << np.uint32(16))
        del names, more, orders, payloads
        _, which, seen = np.unique(trigger, return_inverse=True, return_counts=True)
        several = np.flatnonzero(seen[which] > 1)  # all others are alone with their trigger
        if not len(several):
            return
        name, order, source, which = name[several], order[several], source[several], which[several]
        by = np.lexsort((order, name, which))
        name, order, source, which = name[by], order[by], source[by], which[by]
        new_trigger = np.concatenate([[True], which[1:] != which[:-1]])
        new_phrase = new_trigger | np.concatenate([[True], name[1:] != name[:-1]])
        phrase, group = np.cumsum(new_phrase) - 1, np.cumsum(new_trigger) - 1
        first = order[new_phrase]  # sorted by order inside a phrase
        of_group = group[new_phrase]
        begin = np.flatnonzero(new_trigger[new_phrase])
        lowest, highest = np.minimum.reduceat(first, begin), np.maximum.reduceat(first, begin)
        repeated = order > first[phrase]
        fetch = ~repeated & (lowest < highest)[of_group][phrase]
        hot = (np.diff(begin, append=len(first)) > most)[of_group][phrase]
        asked = np.flatnonzero(repeated | fetch)
        out = []
        for k, own in _by_source(source[asked], len(segments)):
            own = asked[own]
            lists = [name[own[x]].astype("<u8").tobytes() for x in (repeated[own], fetch[own] & ~hot[own], fetch[own] & hot[own])]
            out.append((segments[k], np.array([len(x) // 8 for x in lists], "<u4").tobytes() + b"".join(lists)))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["segment", "payload"])

    return run


def _read_answers(payloads: list[bytes] | None) -> list[np.ndarray]:
    """Names of repeated phrases, of phrases to be fetched, and of such whose trigger is hot."""
    lists: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(3)]
    for x in payloads or ():
        at = 12
        for n, names in zip(np.frombuffer(x, "<u4", 3).tolist(), lists, strict=True):
            names.append(np.frombuffer(x, "<u8", n, at))
            at += 8 * n
    return [np.concatenate(names) for names in lists]


# -- suffix order of the phrases that share a trigger ---------------------------------------------

def _around(data: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hash of the bytes that every window with its trigger ``low`` to ``high`` bytes behind its start holds."""
    out = np.zeros(len(at), np.uint64)
    for j in range(-low, SPAN - high):
        out = out * np.uint64(0x9E3779B97F4A7C15) + data[at + j]
    return C.mix(out)


def _dealt(p: Parse, data: np.ndarray, one: np.ndarray, fetch: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """(bucket, phrase, first window, last window) of what is fetched: phrases by trigger; those of hot triggers by place
    of the trigger, so that equal windows meet all the same."""
    cold, warm = one[np.isin(p.name[one], fetch)], one[np.isin(p.name[one], hot)]
    parts = [(_bucket(p.trigger[cold], buckets), cold, p.first[cold], p.last[cold])]
    for low in range(0, SPAN - GRAM + 1, PLACES) if len(warm) else ():
        high = min(low + PLACES - 1, SPAN - GRAM)
        first, last = np.maximum(p.first[warm], p.at[warm] - high), np.minimum(p.last[warm], p.at[warm] - low)
        some = first <= last
        parts.append((_bucket(_around(data, p.at[warm[some]], low, high), buckets), warm[some], first[some], last[some]))
    where, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(where, kind="stable")
    return where[by], *(x[by] for x in rest)


def _phrases(buckets: int):
    """One row per segment and bucket: the fetched phrases or their parts (names, orders, lengths, first windows, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("answers").to_pylist()
            for i, segment, data, starts, ends, orders in _opened(batch):
                _, fetch, hot = _read_answers(asked[i])
                if not len(fetch) + len(hot):
                    continue
                p = parse(data, starts, ends)
                where, own, first, last = _dealt(p, data, _first_holders(p, orders), fetch, hot, buckets)
                sizes, shift = last + SPAN - first, first - p.first[own]
                begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])).tolist()
                for a, b in zip(begin, [*begin[1:], len(where)], strict=True):
                    size = sizes[a:b]
                    raw = data[np.repeat(first[a:b] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    yield _rows([segment], [int(where[a])], [np.uint32(b - a).tobytes() + p.name[own[a:b]].astype("<u8").tobytes()
                                                            + orders[p.doc[own[a:b]]].astype("<i8").tobytes() + size.astype("<u2").tobytes()
                                                            + shift[a:b].astype("<u1").tobytes() + raw.tobytes()])

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, compared as far as ``span`` bytes, and where a new string begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = []
    for first in range(0, span, 8):
        key = np.zeros(len(starts), np.uint64)
        for j in range(first, first + 8):
            key = (key << np.uint64(8)) | (padded[starts + j].astype(np.uint64) if j < span else np.uint64(0))
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


def _parts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """A part for every window of the phrases, by the hash of its bytes."""
    out, step = [], max(1, BLOCK // SPAN)
    for a in range(0, len(size), step):
        own, windows = size[a : a + step], size[a : a + step] - SPAN + 1
        sums = C.prefix_sums(data[begin[a] : begin[a] + own.sum()])
        places = np.arange(windows.sum()) + np.repeat(np.cumsum(own) - own - np.cumsum(windows) + windows, windows)
        out.append((C.range_hashes(sums, places, places + SPAN) % np.uint64(parts)).astype(np.uint16))
    return np.concatenate(out)


def shared(data: np.ndarray, size: np.ndarray, order: np.ndarray, most: int | None = None) -> np.ndarray:
    """A bit for each window of the phrases, which stand side by side, that a phrase of smaller order holds. About
    ``most`` windows are sorted at a time: equal ones are in the same part."""
    begin, upto = np.cumsum(size) - size, np.cumsum(size - SPAN + 1)
    total = int(upto[-1])
    parts = min(-(-total // (most or WINDOWS)), 1 << 16)
    part = _parts(data, begin, size, parts) if parts > 1 else np.zeros(total, np.uint16)
    bits = np.zeros(len(size), np.uint64)
    for k in range(parts):
        window = np.flatnonzero(part == k)
        if not len(window):
            continue
        phrase = np.searchsorted(upto, window, side="right")
        inner = window - (upto - size + SPAN - 1)[phrase]
        by, new = suffix_order(data, begin[phrase] + inner)
        sorted_ = order[phrase[by]]
        hit = by[np.minimum.reduceat(sorted_, np.flatnonzero(new))[np.cumsum(new) - 1] < sorted_]
        np.bitwise_or.at(bits, phrase[hit], np.uint64(1) << inner[hit].astype(np.uint64))
    return bits


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: phrases with windows that an earlier document holds, as (name, bit per window)."""
    segments, payloads = _gathered(batches)
    if not segments:
        return
    names, orders, sizes, shifts, raw, source = [], [], [], [], [], []
    for k, payload in enumerate(payloads):
        n = int(np.frombuffer(payload, "<u4", 1)[0])
        names.append(np.frombuffer(payload, "<u8", n, 4))
        orders.append(np.frombuffer(payload, "<i8", n, 4 + 8 * n))
        sizes.append(np.frombuffer(payload, "<u2", n, 4 + 16 * n).astype(np.int64))
        shifts.append(np.frombuffer(payload, "<u1", n, 4 + 18 * n))
        raw.append(np.frombuffer(payload, np.uint8, -1, 4 + 19 * n))
        source.append(np.full(n, k, np.int32))
    name, order, size, shift, source, data = (np.concatenate(x) for x in (names, orders, sizes, shifts, source, raw))
    del names, orders, sizes, shifts, raw, payloads
    bits = shared(data, size, order) << shift.astype(np.uint64)
    hit = np.flatnonzero(bits)
    out = [(segments[k], np.stack([name[hit[own]], bits[hit[own]]]).astype("<u8").tobytes()) for k, own in _by_source(source[hit], len(segments))]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["segment", "payload"])


# -- cutting ------------------------------------------------------------------------------------

_OUT = "doc_id bigint, n_bytes bigint, spans array<struct<first:bigint,last:bigint>>, kept binary, digest string"
_SPAN_LIST = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        answers, windows = batch.column("answers").to_pylist(), batch.column("windows").to_pylist()
        digests, offsets = batch.column("digest").to_pylist(), batch.column("offset").to_pylist()
        for i, _, data, starts, ends, orders in _opened(batch):
            repeated, _, _ = _read_answers(answers[i])
            pairs = [np.frombuffer(x, "<u8").reshape(2, -1) for x in windows[i] or ()]
            p = parse(data, starts, ends)
            one = _first_holders(p, orders)
            by = one[np.argsort(p.name[one])]
            held = by[np.searchsorted(p.name[by], p.name)] if len(by) else by
            own_order = orders[p.doc]
            whole = (own_order > orders[p.doc[held]]) | np.isin(p.name, repeated)
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, p.first[whole], 1)
            np.add.at(depth, p.last[whole] + SPAN, -1)
            if pairs:
                names, bits = np.concatenate(pairs, axis=1)
                names, which = np.unique(names, return_inverse=True)  # parts of a phrase come one by one
                parts, bits = bits, np.zeros(len(names), np.uint64)
                np.bitwise_or.at(bits, which, parts)
                at = np.minimum(np.searchsorted(names, p.name), len(names) - 1)
                some = np.flatnonzero(~whole & (names[at] == p.name))
                for j in range(SPAN - GRAM + 1):
                    hit = p.first[some[(bits[at[some]] >> np.uint64(j)) & np.uint64(1) == 1]] + j
                    np.add.at(depth, hit, 1)
                    np.add.at(depth, hit + SPAN, -1)
            gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
            spans, kept = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = gone[a:b]
                if digests[i] is not None:  # a piece: its place in the text, which is cut when all pieces are known
                    edges = _edges(own) + offsets[i]
                    spans.append([{"first": x, "last": y} for x, y in edges.tolist()])
                    kept.append(None)
                elif own.any():
                    edges = _edges(own)
                    spans.append([{"first": x, "last": y} for x, y in edges.tolist()])
                    kept.append(data[a:b][~own].tobytes())
                else:
                    spans.append([])
                    kept.append(data[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if o == LAST else o for o in orders.tolist()], pa.int64()), pa.array(ends - starts, pa.int64()),
                 pa.array(spans, _SPAN_LIST), pa.array(kept, pa.binary()), pa.array([digests[i]] * len(orders), pa.string())],
                names=["doc_id", "n_bytes", "spans", "kept", "digest"])


def _edges(gone: np.ndarray) -> np.ndarray:
    """(first, last) of every run of removed bytes."""
    return np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def _cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts against the spans of all their pieces, one text at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(C.text_bytes(batch.column("text").slice(i, 1))[0], np.uint8)
            gone = np.zeros(len(data), bool)
            for piece in batch.column("pieces")[i].as_py() or ():
                for x in piece:
                    gone[x["first"] : x["last"]] = True
            spans = [{"first": x, "last": y} for x, y in _edges(gone).tolist()]
            order = batch.column("_order")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if order == LAST else order], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([spans], _SPAN_LIST),
                 pa.array([data[~gone].tobytes()], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame, buckets: int | None = None, segment: int = SEGMENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed byte spans and the bytes that stay of every document."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"), "text")
    name = f"text_segments_{uuid.uuid4().hex}"
    (texts.mapInArrow(_segments(segment), _SEGMENT).write.bucketBy(buckets, "segment").option("path", unique_dir(spark, "segments"))
     .option("compression", "zstd").saveAsTable(name))
    segments = spark.table(name)
    stored = segments.agg(F.sum(F.octet_length("data")).alias("n"), F.count("digest").alias("pieces")).first()
    buckets = max(buckets, -(-(stored["n"] or 0) // BUCKET_BYTES))
    rows, answer = "segment bigint, bucket int, payload binary", "segment bigint, payload binary"

    def by_segment(answers: DataFrame, column: str) -> DataFrame:
        return answers.groupBy("segment").agg(F.collect_list("payload").alias(column)).hint("shuffle_hash")

    found = C.saved(segments.mapInArrow(_entries(buckets), rows).repartitionById(buckets, "bucket").mapInArrow(_answers(hot), answer), "phrase-answers")
    asked = segments.join(by_segment(found, "answers"), "segment")
    windows = C.saved(asked.mapInArrow(_phrases(buckets), rows).repartitionById(buckets, "bucket").mapInArrow(_shared_windows, answer), "window-answers")
    out = segments.join(by_segment(found, "answers"), "segment", "left").join(by_segment(windows, "windows"), "segment", "left").mapInArrow(_cut, _OUT)
    spark.sql(f"DROP TABLE {name}")
    if not stored["pieces"]:
        return out.drop("digest")
    # texts longer than a segment: the spans of their pieces meet the text itself
    out = C.saved(out, "cut-segments")
    pieces = (out.where(F.col("digest").isNotNull()).select(F.coalesce("doc_id", F.lit(LAST)).alias("_order"), "digest", "spans").distinct()
              .groupBy("_order", "digest").agg(F.collect_list("spans").alias("pieces")))
    long = texts.where(F.octet_length("text") > segment).withColumn("digest", F.md5(F.col("text").cast("binary")))
    whole = long.join(pieces, ["_order", "digest"], "left").select("_order", "text", "pieces").mapInArrow(_cut_long, _OUT.removesuffix(", digest string"))
    return out.where(F.col("digest").isNull()).drop("digest").unionByName(whole)
