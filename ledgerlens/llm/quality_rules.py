"""Quality rules: cross-document line frequency per host, on top of per-document base rules.

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and hashed. Per host, a line is counted by
the documents that hold it; every row is a document, so copies count. A line in more than ``max_docs`` documents of
its host is removed from every one of them but the keeper, the document with the smallest doc_id, so that a passage
never vanishes altogether. A document whose removed lines leave less than ``min_left`` of its words is depleted and
rejected. The limit is a number of documents, so a verdict depends on the lines' counts alone and not on how large the host is.

Everything is a DataFrame expression. :func:`assess` shuffles only line hashes and counts, never texts; :func:`keep`
moves each text once, to meet its verdict and the positions of the lines that it loses. Counts are
pre-aggregated per task, and equal texts of a host are one row with their number of copies, so a line, text or host
that holds a third of all rows arrives as one row a task.

Defined cases: null text counts as empty (no words: rejected by the base rule); null host is a host of its own; a null
doc_id counts as larger than any other; rows that repeat the keeper's doc_id and text keep the line as well; repeated
rows are judged alike and each gets its row; an empty table gives an empty result; extra columns are ignored by
:func:`assess` and passed through unchanged by :func:`keep`; texts are read whole, however long. Ties: a keeper is
unique but for rows of one doc_id; a document at exactly ``min_left`` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MIN_LEFT = 0.3

SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{C.WS_CLASS}+"), lambda w: w != "")


def _has_word(line: Column) -> Column:
    return C.stripped(line) != ""


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _host(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(column).cast("string")), F.lit("none"))


def _keys(docs: DataFrame, host: str) -> DataFrame:
    """Whole text, host key and text digest of every document."""
    return docs.select("doc_id", C.whole_text().alias("_text"), _host(host).alias("_host"), C.digest(C.whole_text()).alias("_digest"))


def base_measures(keyed: DataFrame) -> DataFrame:
    """The per-document measures. The steps are separate projections, so that arrays that a lambda looks into
    are computed once per document."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), _has_word)
    step = keyed.select("doc_id", "_host", "_digest",
                        (F.char_length(text) - _without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
                        _without(text, C.WS).cast("bigint").alias("word_chars"),
                        lines.alias("_lines"), words(text).alias("_words"))
    n = F.size("_words")
    grams = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"),
                           i.alias("at"))))
    step = step.select("doc_id", "_host", "_digest", "n_symbols", "word_chars",
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                       n.cast("bigint").alias("n_words"), F.sort_array(grams).alias("_grams"))
    # a window is repeated if its neighbour in hash order has the same hash
    twice = F.filter("_grams", lambda g, i: (F.get("_grams", i - 1)["h"].eqNullSafe(g["h"])
                                             | F.get("_grams", i + 1)["h"].eqNullSafe(g["h"])))
    step = step.withColumn("_at", F.sort_array(F.transform(twice, lambda g: g["at"]))).drop("_grams")
    # words under the union of three-word windows: each start adds its distance to the next start, three at most
    gaps = F.zip_with(F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))),
                      F.slice("_at", F.lit(1), F.greatest(F.size("_at") - 1, F.lit(0))),
                      lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(F.size("_at") > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_at")


def _lines(keyed: DataFrame) -> DataFrame:
    """The lines with words, by position."""
    return keyed.select("doc_id", "_host", "_digest", F.posexplode(F.split("_text", "\n")).alias("_at", "_line")).where(_has_word(F.col("_line")))


def _line_key() -> Column:
    return F.xxhash64(C.ascii_lower(C.stripped(F.col("_line")))).alias("_key")


def line_words(keyed: DataFrame) -> DataFrame:
    """(host, text, line hash, words of that line in the text, times it stands there, copies of the text, smallest
    doc_id of them): one row a different line of a different text."""
    lines = _lines(keyed).select("doc_id", "_host", "_digest", "_at", F.size(words(F.col("_line"))).alias("_n"), _line_key())
    # every copy of a text brings the same positions
    return lines.groupBy("_host", "_digest", "_key").agg(
        F.max("_n").alias("_n"), F.count_distinct("_at").alias("_times"), F.count(F.lit(1)).alias("_all"), F.min("doc_id").alias("_first")).select(
        "_host", "_digest", "_key", "_n", "_times", F.expr("_all div _times").alias("_copies"), "_first")


def common_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line hash, doc_id of the keeper) of the lines above the limit."""
    counted = lines.groupBy("_host", "_key").agg(F.sum("_copies").alias("_docs"), F.min("_first").alias("_keeper"))
    return counted.where(F.col("_docs") > max_docs).select("_host", "_key", "_keeper")


def assess(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, n_words, the base measures, n_removed_words, base_failed, kept.

    Filter a written copy, as :func:`keep` does: the optimizer would push a filter below the measures."""
    keyed = _keys(docs, host)
    return _assessed(keyed, _hits(keyed, max_docs), min_left)


def _assessed(keyed: DataFrame, hits: DataFrame, min_left: float) -> DataFrame:
    # words that the common lines take from each (host, text), and those that its first document keeps; texts that
    # lose none have no row
    n = F.col("_n") * F.col("_times")
    verdicts = hits.groupBy("_host", "_digest").agg(F.sum(n).alias("_removed"), F.sum(F.when(F.col("_keeps"), n)).alias("_own"), F.min("_first").alias("_first"))
    out = base_measures(keyed).join(verdicts, ["_host", "_digest"], "left")
    own = F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.coalesce("_own", F.lit(0))).otherwise(0)
    removed = (F.coalesce("_removed", F.lit(0)) - own).cast("bigint")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - removed) < min_left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      removed.alias("n_removed_words"), failed.alias("base_failed"),
                      (~failed & ~depleted).alias("kept"), "_host", "_digest")


def _hits(keyed: DataFrame, max_docs: int) -> DataFrame:
    """(host, text, line hash, words, times, first document, whether that keeps the line) of the common lines in every text."""
    lines = C.saved(line_words(keyed), "line-words")
    found = lines.join(common_lines(lines, max_docs), ["_host", "_key"])
    return found.select("_host", "_digest", "_key", "_n", "_times", "_first", F.col("_first").eqNullSafe(F.col("_keeper")).alias("_keeps"))


def _lost(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """(host, text, first document, positions of the common lines, those of them that the first document keeps)."""
    lines = _lines(keyed).select("_host", "_digest", "_at", _line_key()).join(
        hits.select("_host", "_digest", "_key", "_keeps", "_first"), ["_host", "_digest", "_key"])
    return lines.groupBy("_host", "_digest").agg(
        F.collect_set("_at").alias("_lost"), F.collect_set(F.when(F.col("_keeps"), F.col("_at"))).alias("_own"), F.min("_first").alias("_first"))


def keep(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that the rules keep, with all their columns; ``text`` goes without the lines above the limit,
    except in the document that keeps them. The other lines stay as they are, also those without words; a null text
    would stay null."""
    keyed = _keys(docs, host)
    hits = C.saved(_hits(keyed, max_docs), "common-lines")
    # written first: a filter on the verdict would be pushed through the measures and repeat their expressions; the
    # verdicts of a text's copies differ at most between its first document and the others
    kept = C.saved(_assessed(keyed, hits, min_left).select("_host", "_digest", "doc_id", "kept"), "verdicts").where("kept")
    verdict = kept.groupBy("_host", "_digest").agg(F.max("doc_id").alias("_most"), F.max(F.col("doc_id").isNull()).alias("_null"))
    # written, so that the join with the texts has plain shuffles on both sides and Spark can split a text with many copies
    judged = C.saved(verdict.join(_lost(keyed, hits), ["_host", "_digest"], "left"), "kept-texts")
    rows = docs.select(C.as_struct(docs), _host(host).alias("_host"), C.digest(C.whole_text()).alias("_digest"))
    # of a text that is not kept in all documents, only the first document is: that with the smallest doc_id
    id_ = F.col("_doc.doc_id")
    joined = rows.join(judged, ["_host", "_digest"]).where(F.when(id_.isNull(), F.col("_null")).otherwise(id_ <= F.col("_most")))
    lost = F.when(id_.eqNullSafe(F.col("_first")), F.array_except("_lost", "_own")).otherwise(F.col("_lost"))
    joined = joined.withColumn("_lines", F.when(F.col("_lost").isNotNull(), F.split("_doc.text", "\n"))).withColumn("_gone", lost)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    text = F.when(F.col("_lost").isNull(), F.col("_doc.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")
