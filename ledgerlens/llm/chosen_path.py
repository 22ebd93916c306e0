"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (words between white space, A-Z lower-cased; a shorter text is
one shingle). Equal sets are one node from the start. Every set is embedded as ``COORDINATES`` minhash tokens.
A run starts with all sets in one bucket and splits it on sampled tokens: each (coordinate, value) is a path
with probability 1 / (similarity * coordinates), the same for all sets of a bucket, so a pair of the wanted
similarity follows at least one common path in the mean. Buckets of at most ``LEAF`` sets are compared in full on
their tokens. In a larger bucket every set is compared with one pivot: what is near it is linked to it, what is
very near leaves the bucket (its own neighbours are near the pivot, too), and the rest is split further. Runs are
repeated until the chance to miss a pair is below 1 - ``recall``: first as many as two splits need, then more for
the sets that were split more often, until every set has had the runs that its own deepest bucket needs.

The candidate links (a forest per bucket, never all pairs) join sets to candidate groups; inside a group every
pair is checked exactly on the whole shingle sets. Groups of any size are dealt into tiles, and pairs of tiles are
checked in tasks of bounded size, which emit a link count per set and a forest of the true links, not the pairs.

Defined cases: null text and text without words is never similar to anything (its class is itself); null doc_id
is allowed, a class is named after its smallest doc_id (null if all are null); repeated rows are copies; copies
count as links of each other; an empty table gives an empty result; extra columns are ignored; all shingles of a very
long text count.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8, as a fraction for exact comparison
RECALL = 0.9999
COORDINATES = 64
LEAF = 1024
#: Equal tokens: for a candidate in a leaf, for a link to a pivot, and for leaving the bucket after that.
LEAF_LINK, PIVOT_LINK, PIVOT_LEAVE = 38, 28, 45
TILE_SETS, TILE_BYTES = 1024, 4 << 20
LAST = (1 << 63) - 1

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data = _LOWERED[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)] if texts else np.zeros(0, np.uint8)
    edges = np.diff((~_SPACE[data]).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = C.range_hashes(C.prefix_sums(data), starts, ends)
    limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])) if texts else np.zeros(0, np.int64)
    out, at = [], 0
    for end in limits.tolist():
        out.append(np.unique(C.gram_hashes(words[at:end], min(SHINGLE, end - at))) if end > at else np.zeros(0, np.uint64))
        at = end
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash tokens, one row a (non-empty) set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.int32)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
    return out


def runs_needed(recall: float, depth: int = 2) -> int:
    """Runs until a pair of the wanted similarity, split ``depth`` times, meets with probability ``recall``. The
    common paths of such a pair form a branching process with one child in the mean."""
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(miss - 1)
    return math.ceil(math.log(1 - recall) / math.log(miss))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, "text"):
            sets = shingle_sets(C.text_bytes(part.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            tokens = sketches([sets[i] for i in full])
            take = pa.array(full, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("_order").take(take), part.column("_digest").take(take),
                 pa.array([hashlib.md5(sets[i].tobytes()).digest() for i in full], pa.binary()),
                 pa.array([len(sets[i]) for i in full], pa.int32()),
                 pa.ListArray.from_arrays(np.arange(0, (len(full) + 1) * COORDINATES, COORDINATES, dtype=np.int32), tokens.ravel())],
                names=["_order", "_digest", "_set", "_size", "_sketch"])


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric relation; earlier members stand first."""
    label, out = np.arange(len(adjacent)), []
    for i in range(len(adjacent)):
        others = np.flatnonzero(adjacent[i, i + 1 :]) + i + 1
        others = others[label[others] != label[i]]
        if len(others):
            roots, first = np.unique(label[others], return_index=True)
            out += [(i, j) for j in others[first].tolist()]
            label[np.isin(label, roots)] = label[i]
    return out


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for group in batch.column("_group"):
            ids = group.values.field("id").to_numpy()
            tokens = group.values.field("_sketch").flatten().to_numpy().reshape(len(ids), COORDINATES)
            order = np.argsort(ids)
            ids, tokens = ids[order], tokens[order]
            near = np.zeros((len(ids), len(ids)), bool)
            for first in range(0, len(ids), 64):
                part = tokens[first : first + 64, None, :] == tokens[None, first:, :]
                near[first : first + 64, first:] = part.sum(axis=2) >= LEAF_LINK
            for a, b in _forest(near):
                u.append(ids[b])
                v.append(ids[a])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _equal_tokens(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def _children(rows: DataFrame) -> DataFrame:
    """The next level: (node, id) for every path that a set follows out of its bucket."""
    share = round((1 << 20) * SIMILARITY[1] / (SIMILARITY[0] * COORDINATES))
    paths = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.when(
        F.pmod(F.xxhash64("node", i), F.lit(1 << 20)) < share, F.xxhash64("node", i, F.get("_sketch", i))))
    return rows.select(F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("node"), "id")


def _roots(sets: DataFrame, first: int, runs: int, seed: int) -> DataFrame:
    """The first split of the runs from ``first`` to ``runs``. A root's paths are the same for all sets, so they are drawn here."""
    draw = random.Random(f"{seed} {first}" if first else seed)
    share = SIMILARITY[1] / (SIMILARITY[0] * COORDINATES)
    chosen = [(r, i) for r in range(first, runs) for i in range(COORDINATES) if draw.random() < share]
    paths = [F.xxhash64(F.lit(r), F.lit(i), F.get("_sketch", F.lit(i))) for r, i in chosen]
    return sets.select(F.explode(F.array(*paths)).alias("node"), "id")


def _with_pivots(large: DataFrame, sketch: DataFrame) -> DataFrame:
    """Rows of large buckets with their own sketch and their pivot's. The smallest id is the pivot, so a group of copies
    has the same one in most buckets of all runs: a bucket's rows are dealt to as many salts as it holds leaves, and the
    pivot stands once at each salt of its largest bucket, so no task gets a whole bucket."""
    salts = F.ceil(F.col("_n") / LEAF).cast("int")
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64("node", "id"), salts).cast("int"))
    pivots = (large.groupBy(F.col("_pivot").alias("id")).agg(F.max(salts).alias("_salts")).join(sketch, "id")
              .select(F.col("id").alias("_pivot"), F.col("_sketch").alias("_pivot_sketch"),
                      F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")))
    return dealt.join(sketch, "id").join(pivots, ["_pivot", "_salt"]).drop("_salt")


def _split(sketch: DataFrame, rows: DataFrame, leaf: int, leaves: list, links: list) -> list[DataFrame]:
    """Splits the buckets of ``rows`` down to leaves; adds to ``leaves`` and ``links``. Gives the ids that were split
    a third time, a fourth time and so on."""
    deep: list[DataFrame] = []
    splits = 1
    while True:
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_pivot")).where("_n > 1")
        met = C.saved(rows.join(sizes, "node"), "buckets")
        # the same few sets meet in many runs; they are compared once
        leaves.append(met.where(F.col("_n") <= leaf).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("_ids")).select("_ids"))
        large = met.where(F.col("_n") > leaf)
        if large.isEmpty():
            return deep
        near = C.saved(_with_pivots(large, sketch).withColumn("_same", _equal_tokens("_sketch", "_pivot_sketch"))
                       .drop("_pivot_sketch").where(F.col("id") != F.col("_pivot")), "near-pivots")
        links.append(near.where(F.col("_same") >= PIVOT_LINK).select(F.col("id").alias("u"), F.col("_pivot").alias("v")).distinct())
        rest = near.where(F.col("_same") < PIVOT_LEAVE)
        rows, splits = _children(rest), splits + 1
        if splits > 2:
            deep.append(rest.select("id").distinct())


def candidate_links(sets: DataFrame, recall: float = RECALL, leaf: int | None = None, seed: int = 1) -> DataFrame:
    """(u, v) links between sets (id, _sketch) that may be similar; only a forest of each bucket."""
    leaf, leaves, links = leaf or LEAF, [], []
    sketch = sets.select("id", "_sketch")
    part, done, runs = sketch, 0, runs_needed(recall)
    deep: list[DataFrame] = []  # at k: ids that were split k + 3 times or more, in any run so far
    while True:
        found = _split(sketch, _roots(part, done, runs, seed), leaf, leaves, links)
        deep = [reduce(DataFrame.unionByName, both) for both in
                ([ids for level in (deep, found) for ids in level[k : k + 1]] for k in range(max(len(deep), len(found))))]
        done = runs
        # a pair's buckets are no deeper than those of either set, so both sets of a pair that lacks runs are in all further runs
        lacking = [k for k in range(len(deep)) if runs_needed(recall, k + 3) > done]
        if not lacking:
            break
        part = C.saved(sketch.join(deep[lacking[0]].distinct(), "id", "left_semi"), "deep-sets")
        if part.isEmpty():
            break
        runs = runs_needed(recall, len(deep) + 2)
    groups = reduce(DataFrame.unionByName, leaves).distinct().select(F.xxhash64("_ids").alias("_leaf"), F.explode("_ids").alias("id"))
    compared = (groups.join(sketch, "id").groupBy("_leaf").agg(F.collect_list(F.struct("id", "_sketch")).alias("_group"))
                .select("_group").mapInArrow(_leaf_links, "u bigint, v bigint"))
    return reduce(DataFrame.unionByName, links, compared).distinct()


def exact_links(sets: list[np.ndarray], tile: np.ndarray, across: bool) -> np.ndarray:
    """Which sets are similar, as a symmetric matrix; with ``across`` only pairs of different tiles."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[which] > 1
    owner, columns = owner[shared], np.unique(which[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    width = 4096
    for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [first, first + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], columns[a:b] - first] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    similar = SIMILARITY[1] * common >= SIMILARITY[0] * union
    np.fill_diagonal(similar, False)
    if across:
        similar &= tile[:, None] != tile[None, :]
    return similar


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, others, counts = [], [], []
        for a, b, group in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b", "_group")), strict=True):
            if a != b and len({g["_tile"] for g in group}) < 2:
                continue  # the other tile is empty
            group.sort(key=lambda g: g["id"])
            sets = shingle_sets([(g["text"] or "").encode() for g in group])
            similar = exact_links(sets, np.array([g["_tile"] for g in group]), a != b)
            linked = similar @ np.array([g["_copies"] for g in group])
            for i in np.flatnonzero(linked):
                ids.append(group[i]["id"])
                others.append(None)
                counts.append(int(linked[i]))
            for i, j in _forest(similar):
                ids.append(group[j]["id"])
                others.append(group[i]["id"])
                counts.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())],
                                         names=["id", "other", "n"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"), C.digest(C.whole_text()).alias("_digest"),
                       F.col("text"))


def similar(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(_order, _digest, _first, n_links) for every different (doc_id, text) with words; ``_first`` is the struct
    (_order, _digest) of its class's first document. ``_order`` is the doc_id, or the largest bigint for null."""
    keyed = _keyed(docs)
    members = C.saved(keyed.mapInArrow(_sketched, "_order bigint, _digest binary, _set binary, _size int, _sketch array<int>"), "sketches")
    sets = members.groupBy("_set").agg(F.min(F.struct("_order", "_digest")).alias("_first"), F.count(F.lit(1)).alias("_copies"),
                                       F.first("_sketch").alias("_sketch"), F.first("_size").alias("_size"))
    sets = C.saved(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    groups = C.saved(connected(candidate_links(sets, recall)), "candidate-groups")
    # whole texts of the candidates: one row a set
    wanted = sets.join(groups, "id").select("id", "component", "_copies", F.col("_first._order").alias("_order"), F.col("_first._digest").alias("_digest"))
    texts = keyed.join(wanted, ["_order", "_digest"]).dropDuplicates(["id"])
    sizes = (sets.join(groups, "id").groupBy("component")
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_size").cast("bigint") * 8).alias("_bytes")))
    tiles = sizes.select("component", F.greatest(F.ceil(F.col("_n") / TILE_SETS), F.ceil(F.col("_bytes") / TILE_BYTES)).cast("int").alias("_tiles"))
    dealt = texts.join(tiles, "component").withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    dealt = dealt.select("component", "id", "_copies", "text", "_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_with"))
    checked = C.saved(dealt.groupBy("component", F.least("_tile", "_with").alias("_a"), F.greatest("_tile", "_with").alias("_b"))
                      .agg(F.collect_list(F.struct("id", "_copies", "_tile", "text")).alias("_group")).select("_a", "_b", "_group")
                      .mapInArrow(_verified, "id bigint, other bigint, n bigint"), "links")
    linked = checked.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("_linked"))
    classes = connected(checked.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")))
    heads = classes.join(sets.select("id", "_first"), "id").groupBy("component").agg(F.min("_first").alias("_head"))
    named = classes.join(heads, "component").select("id", "_head")
    judged = (sets.select("id", "_set", "_first", "_copies").join(linked, "id", "left").join(named, "id", "left")
              .select("_set", F.coalesce("_head", "_first").alias("_first"),
                      (F.coalesce("_linked", F.lit(0)) + F.col("_copies") - 1).cast("bigint").alias("n_links")))
    return members.select("_order", "_digest", "_set").join(judged, "_set").drop("_set")


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class) and n_links (documents, copies
    included, whose similarity to it is 0.8 or more)."""
    found = similar(docs, recall).dropDuplicates(["_order", "_digest"])
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"), C.digest(C.whole_text()).alias("_digest"))
    named = own.join(found, ["_order", "_digest"], "left")
    head = F.when(F.col("_first").isNull(), F.col("doc_id").cast("bigint")).otherwise(F.nullif(F.col("_first._order"), F.lit(LAST)))
    return named.select("doc_id", head.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``docs`` without all but one document of every class (the one with the smallest doc_id, then text digest;
    of repeated rows any one). Of documents without words one of every group of equal texts stays (null and empty
    differ here), also the one with the smallest doc_id; other such documents stay."""
    found = similar(docs, recall).withColumn("_stays", F.col("_first") == F.struct("_order", "_digest"))
    found = found.groupBy("_order", "_digest").agg(F.max("_stays").alias("_stays"))
    own = docs.select(C.as_struct(docs), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"), C.digest(C.whole_text()).alias("_digest"))
    judged = own.join(found, ["_order", "_digest"], "left")
    kept = judged.where("_stays").dropDuplicates(["_order", "_digest"])
    # folded per task first, as one such text may stand in very many documents
    wordless = (judged.where("_stays IS NULL").groupBy("_digest", F.col("_doc.text").isNull().alias("_null"))
                .agg(F.min_by("_doc", "_order").alias("_doc")))
    return kept.select("_doc").unionByName(wordless.select("_doc")).select("_doc.*")
