"""Spelling variant grouping by reduced-alphabet generation.

Words are maximal runs of letters, counted over all documents. Two words are near if they differ by exactly one
inserted, deleted or replaced letter. To find near words, letters are hashed to a few symbols, so that many words share a
reduced word; the full one-edit neighbourhood of every reduced word (itself, all deletions, replacements and
insertions over the symbols) is generated as rolling hashes and joined with the reduced vocabulary, and the original
words of the pairs that meet are compared letter by letter. One edit of a word is at most one edit of its reduced
word, so no near pair is missed; a chance meeting of hashes only costs a comparison.

The neighbourhood has about ``2 * length * symbols`` members however large the vocabulary. What could grow is a
reduced word that very many words share. Such words (more than ``max_shared`` words) leave the join of that level, as
generators and as targets, and generate again over a finer alphabet, whose symbols each lie in one of the
coarser; the last level has one symbol a letter, where no two words are alike. Every pair is found: at the first
level where neither word is crowded, from the one that was crowded before. So no key of the join holds more than
``max_shared`` words, and nothing is capped.

Spark: counts are partial aggregates of words, so a word that makes up a third of the corpus is one row a task.
Neighbours are made in Arrow batches from distinct reduced words and shuffled as two 64-bit hashes each, so a long
word is not copied to its neighbours; words are joined to those that meet. All else are joins and aggregates. Forms are followed by pointer jumping; a form has at least ``min_ratio`` times the
occurrences, so chains have at most log10 of the largest count steps.

Defined cases: null or empty text has no words; a null id counts as an empty one in the planted-deletion rule of
:func:`noisy_words`; repeated rows count each time; an empty table gives an empty result; extra columns are ignored; a
text is read whole and a word of any length is handled (its neighbours come in blocks). Ties: of near words with equal
counts the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 7, 2, 10
#: Symbols by level: the first divides the second, so that a symbol of one level lies in one of the level before, and
#: the last has a symbol for every letter. Few symbols make few neighbours, many make few words with one reduced word.
SYMBOLS = (5, 40, 256)
MAX_SHARED = 32
#: Neighbours made at a time in a task.
BLOCK = 1 << 19


def noisy_words(docs: DataFrame, min_length: int = MIN_LENGTH, divisor: int = 31) -> DataFrame:
    """One row ``word`` an occurrence: runs of letters, A-Z lower-cased; where ``divisor`` divides the CRC-32 h of
    ``<doc_id>:<run>``, the run loses its letter h % length. Results shorter than ``min_length`` are left out."""
    runs = F.regexp_extract_all(C.whole_text(), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    # a document's equal runs have one fate, so they are folded first
    found = found.select("_id", C.ascii_lower(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_id", "_run").cast("binary"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % divisor == 0, cut).otherwise(F.col("_run"))
    return found.withColumn("_h", h).select(word.alias("word")).where(F.char_length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# -- reduced words and their neighbourhoods, as hashes -----------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _symbol_values(symbols: int) -> np.ndarray:
    return C.mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def reduce(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words one after the other, and each word's length.

    A letter's symbol is its code point times an odd number modulo 256, modulo ``symbols``: with 256 every letter
    up to U+00FF has its own."""
    joined = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return joined.astype(np.int64) * 181 % 256 % symbols, np.array([len(w) for w in words], np.int64)


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def reduced_keys(symbol: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """A 64-bit hash of each reduced word."""
    values = _symbol_values(symbols)[symbol]
    out = np.zeros(len(lengths), np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        grid = values[starts[rows, None] + np.arange(n)]
        out[rows] = C.mix((grid * _powers(n)[:n]).sum(axis=1, dtype=np.uint64) + np.uint64(n))
    return out


def neighbour_keys(word: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For equally long words, given as rows of symbols: (row, hash) of the full one-edit neighbourhood, by blocks of
    edited places. A neighbour may come more than once."""
    rows, n = word.shape
    p, value = _powers(n + 1), _symbol_values(symbols)
    own = value[word]
    left = np.zeros((rows, n + 1), np.uint64)  # sums of the letters before each place
    np.cumsum(own * p[:n], axis=1, out=left[:, 1:])
    whole = left[:, -1:]
    right = whole - left  # of those from each place on
    at = np.arange(rows)
    yield at, C.mix(whole[:, 0] + np.uint64(n))
    step = max(1, BLOCK // max(1, rows * symbols))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    for a in range(0, n + 1, step):
        b = min(a + step, n + 1)
        more = left[:, a:b, None] + value * p[a:b, None] + (right[:, a:b] * _BASE)[..., None]  # inserted before the place
        yield np.repeat(at, (b - a) * symbols), C.mix(more.reshape(-1) + np.uint64(n + 1))
        b = min(b, n)
        if a < b:
            less = left[:, a:b] + right[:, a + 1 : b + 1] * inverse
            yield np.repeat(at, b - a), C.mix(less.reshape(-1) + np.uint64(n - 1))
            other = (whole - own[:, a:b] * p[a:b])[..., None] + value * p[a:b, None]
            changed = np.arange(symbols) != word[:, a:b, None]
            yield np.repeat(at, (b - a) * symbols).reshape(changed.shape)[changed], C.mix(other[changed] + np.uint64(n))


def reduced(vocab: DataFrame, symbols: int) -> DataFrame:
    """(key, reduced, word) of every word: its reduced word and the hash of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "word"):
                words = part.column(0).to_pylist()
                symbol, lengths = reduce(words, symbols)
                ends = np.cumsum(lengths)
                flat = symbol.astype(np.uint8).tobytes()
                short = pa.array([flat[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(reduced_keys(symbol, lengths, symbols).view(np.int64)), short, part.column(0)],
                                                 ["key", "reduced", "word"])

    return vocab.select("word").mapInArrow(run, "key bigint, reduced binary, word string")


def neighbours(shared: DataFrame, symbols: int, half: bool) -> DataFrame:
    """(key, own) for every neighbour of every reduced word: its hash and that of the reduced word itself. With ``half`` only neighbours whose hash is at or above the own one: of two reduced words
    that generate each other, one is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column("reduced").to_pylist()
            lengths = np.array([len(w) for w in short], np.int64)
            own = batch.column("key").to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                of_length = np.flatnonzero(lengths == n)
                most = max(1, BLOCK // max(1, n * symbols * 2))
                for s in range(0, len(of_length), most):
                    rows = of_length[s : s + most]
                    symbol = np.frombuffer(b"".join(short[i] for i in rows), np.uint8).reshape(len(rows), n)
                    for at, key in neighbour_keys(symbol.astype(np.int64), symbols):
                        key = key.view(np.int64)
                        if half:
                            up = key >= own[rows[at]]
                            at, key = at[up], key[up]
                        # a neighbour that comes again is left out where it is quick to see: pairs are distinct later
                        order = np.lexsort((key, at))
                        at, key = at[order], key[order]
                        new = np.ones(len(key), bool)
                        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
                        yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(own[rows[at[new]]])], ["key", "own"])

    return shared.select("key", "reduced").mapInArrow(run, "key bigint, own bigint")


def _near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(vocab: DataFrame, symbols: tuple[int, ...] = SYMBOLS, max_shared: int = MAX_SHARED) -> DataFrame:
    """(a, b) of all near words with a < b, each pair once."""
    found, active = None, None
    # a number of partitions of its own, as each small group makes a hundred rows
    deal = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level, k in enumerate(symbols):
        last = level == len(symbols) - 1
        keyed = reduced(vocab, k)
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
        if not last:
            crowded = C.saved(counts.where(F.col("shared") > max_shared).select("key"), "crowded")
            free = keyed.join(crowded, "key", "left_anti")
        else:
            free = keyed
        groups = C.saved(free.repartition(deal, "key").groupBy("key", "reduced").agg(F.collect_list("word").alias("words")), "reduced-words")
        sources = groups
        if active is not None:
            sources = C.saved(free.join(active, "word", "left_semi").groupBy("key", "reduced").agg(F.collect_list("word").alias("words")), "reduced-words")
        # never broadcast: the planner takes the neighbours to be as few as their sources
        met = (neighbours(sources, k, half=active is None).hint("merge").join(groups.select("key", F.col("words").alias("others")), "key")
               .select("own", "others").join(sources.select(F.col("key").alias("own"), "words"), "own"))
        pairs = (met.select(F.explode("words").alias("a"), "others").select("a", F.explode("others").alias("b"))
                 .where((F.col("a") != F.col("b")) & _near(F.col("a"), F.col("b")))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        active = C.saved(keyed.join(crowded, "key", "left_semi").select("word"), "crowded-words")
        if active.isEmpty():
            break
    return found.distinct()


def group(vocab: DataFrame, min_ratio: int = MIN_RATIO, symbols: tuple[int, ...] = SYMBOLS, max_shared: int = MAX_SHARED) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word of a (word, n) vocabulary.

    A word's form is its near word of largest n if that n is at least ``min_ratio`` times its own; its root is the
    last of its forms' forms, or itself."""
    vocab = C.saved(vocab.select("word", "n"), "vocabulary")
    pairs = C.saved(near_pairs(vocab, symbols, max_shared), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("_n")), "b")
    best = named.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("b").alias("word"))).alias("best"))
    out = vocab.join(best.withColumnRenamed("a", "word"), "word", "left")
    has = -F.col("best.less") >= min_ratio * F.col("n")
    out = C.saved(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.word")).alias("form"),
                             F.when(has, -F.col("best.less")).alias("form_n")), "word-forms")
    roots = _roots(out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return (out.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): every link followed to its end; each step doubles the links that are followed."""
    now = C.saved(links, "roots")
    while True:
        ends = now.select(F.col("word").alias("_at"), F.col("root").alias("_end"))
        after = C.saved(now.join(ends, F.col("root") == F.col("_at"), "left")
                        .select("word", F.coalesce("_end", "root").alias("root"), F.col("_end").isNotNull().alias("_moved")), "roots")
        moved = not after.where("_moved").isEmpty()
        now = after.drop("_moved")
        if not moved:
            return now
