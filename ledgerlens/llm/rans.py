"""Token ids in a binary format: static range asymmetric numeral system (rANS).

Texts are range-partitioned by doc_id, encoded by the tokenizer in ascending order and cut into segments of
about ``SEGMENT`` ids, one file each. The blocks of a segment share one frequency table; a block holds up to
``BLOCK`` ids, dealt in turn to ``LANES`` interleaved coders, and can be decoded alone: the segment's directory
is its checkpoint list (byte place, number of ids and words, place of its first id, CRC-32), and each block
starts with the lanes' states. Files are written by Spark's own committed writer, so a lost executor leaves no
half segment, and are read back as binary files on any file system.

Layout (little-endian): magic, length of the JSON header, header (part, segment, docs, ids, directory), symbols
(u16), their frequencies (u32, sum 2**SCALE), doc ids (i64), null flags (u8), lengths (u32), blocks (states u64,
words u32). A line feed that the writer adds after the last block is not part of the format.

Defined cases: null text counts as empty; rows with a null doc_id come first; rows of equal doc_id follow in the
order of their text's hash; an empty table gives no file and an empty result; very long texts may span blocks;
extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import unique_dir
from . import common as C

MAGIC = b"IDSEG1\n\0"
SCALE, LANES, BLOCK, SEGMENT = 18, 2048, 1 << 19, 1 << 22
LOW = np.uint64(1 << 31)
_WORD, _K = np.uint64(32), np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to the sum 2**SCALE, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    share = counts[symbols]
    total = 1 << SCALE
    scaled = np.maximum(1, share * (total - len(symbols)) // max(1, share.sum()) + 1)
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return symbols.astype("<u2"), scaled.astype("<u4")


class Table:
    """Frequency table of a segment, ready for coding."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols = symbols
        self.freq = freqs.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.limit = ((LOW >> _K) << _WORD) * self.freq
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.uint32), freqs)
        self.index = np.zeros(1 << 16, np.uint32)
        self.index[symbols] = np.arange(len(symbols), dtype=np.uint32)


def encode_block(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Final states and words of one block. The lanes run from the last row of ids to the first; a step's words
    stand in lane order, and the steps in the order of decoding."""
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    which = table.index[ids]
    for end in range(-(-len(ids) // LANES), 0, -1):
        s = which[(end - 1) * LANES : end * LANES]
        y = x[: len(s)]
        f = table.freq[s]
        full = y >= table.limit[s]
        words.append((y[full]).astype("<u4"))
        y[full] >>= _WORD
        q = y // f
        y[:] = (q << _K) + (y - q * f) + table.start[s]
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")


def decode_block(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    x, out, at = states.astype(np.uint64), np.zeros(n, "<u2"), 0
    words = words.astype(np.uint64)
    for first in range(0, n, LANES):
        y = x[: min(LANES, n - first)]
        slot = y & _MASK
        s = table.slot[slot]
        out[first : first + len(y)] = table.symbols[s]
        y[:] = table.freq[s] * (y >> _K) + slot - table.start[s]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << _WORD) | words[at : at + len(low)]
        at += len(low)
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block does not end in the coder's first state")
    return out


def write_segment(part: int, segment: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file. ``ids``: the 16-bit ids of each document."""
    flat = np.frombuffer(b"".join(ids), "<u2")
    symbols, freqs = frequencies(flat)
    table = Table(symbols, freqs)
    directory, blocks, place = [], [], 0
    for first in range(0, len(flat), BLOCK):
        piece = flat[first : first + BLOCK]
        states, words = encode_block(piece, table)
        data = states.astype("<u8").tobytes() + words.tobytes()
        directory.append([place, len(piece), len(words), first, zlib.crc32(piece.tobytes())])
        blocks.append(data)
        place += len(data)
    header = json.dumps({"part": part, "segment": segment, "docs": len(doc_ids), "ids": len(flat), "lanes": LANES,
                         "scale": SCALE, "symbols": len(symbols), "blocks": directory}).encode()
    lengths = np.array([len(x) // 2 for x in ids], "<u4")
    return b"".join([MAGIC, np.uint32(len(header)).tobytes(), header, symbols.tobytes(), freqs.tobytes(),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
                     lengths.tobytes(), *blocks])


def read_segment(data: bytes) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    """Header, doc ids, lengths and all ids, each block checked against its checksum."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an id segment")
    at = len(MAGIC) + 4
    end = at + int(np.frombuffer(data, "<u4", 1, at - 4)[0])
    header = json.loads(data[at:end])

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal end
        out = np.frombuffer(data, kind, n, end)
        end += out.nbytes
        return out

    n = header["docs"]
    table = Table(take("<u2", header["symbols"]), take("<u4", header["symbols"]))
    doc_ids, null, lengths = take("<i8", n), take("u1", n), take("<u4", n)
    out = np.zeros(header["ids"], "<u2")
    for place, count, words, first, crc in header["blocks"]:
        states = np.frombuffer(data, "<u8", header["lanes"], end + place)
        ids = decode_block(count, states, np.frombuffer(data, "<u4", words, end + place + states.nbytes), table)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"checksum of the block at {place}")
        out[first : first + count] = ids
    return header, [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, out


def write_ids(docs: DataFrame, encoder: Callable, end_id: int, path: str) -> None:
    """Encode every whole text, append ``end_id`` and write the segments below ``path``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder().encode, np.array([end_id], "<u2").tobytes()
        part, segment, docs_, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs_.append(doc)
                ids.append(encode(text or "") + end)
                held += len(ids[-1]) // 2
                if held >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([write_segment(part, segment, docs_, ids)], pa.binary())], names=["value"])
                    segment, docs_, ids, held = segment + 1, [], [], 0
        if docs_:
            yield pa.RecordBatch.from_arrays([pa.array([write_segment(part, segment, docs_, ids)], pa.binary())], names=["value"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    # a string column may hold any bytes; the text writer puts them out as they are
    (ordered.select("doc_id", "text").mapInArrow(segments, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``ids`` are 32-bit."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                header, doc_ids, lengths, ids = read_segment(data)
                ends = np.cumsum(lengths.astype(np.int64))
                starts, wide, n = ends - lengths, ids.astype("<u4"), len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)),
                     pa.array([wide[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                     pa.array([header["part"]] * n, pa.int32()), pa.array([header["segment"]] * n, pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids", "part", "segment"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary, part int, segment int")


def with_starts(decoded: DataFrame) -> DataFrame:
    """Turns starts within a segment into starts within the whole corpus. Only one row a segment is ordered."""
    sizes = decoded.groupBy("part", "segment").agg(F.sum("n_tokens").alias("_n"))
    order = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "segment", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return decoded.join(before, ["part", "segment"]).withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def scratch(spark: SparkSession) -> str:
    return unique_dir(spark, "id-segments")
