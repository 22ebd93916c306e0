"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of ``documents``.

1. quality rules: documents that the rules reject go, and lines in more documents of their host than the limit go from
   all of the others but one (native expressions only);
2. line dedup: lines found in at least ten documents go, the rest of the text stays; documents without text go on;
3. near duplicates: of every class of documents with a shingle similarity of 0.8 or more, the one with the
   smallest doc_id stays, and one of equal texts without words;
4. decontamination: documents that hold ten words in a row (or a whole shorter item) of the benchmark go;
5. packing: the token ids of what is left, cut and packed into sequences of 1024.

Defined cases are those of the operators: null text counts as empty, repeated rows are judged alike in stages 1,
2, 4 and 5 and only one of them stays in stage 3, an empty table gives an empty result, and columns that
``documents`` does not have pass through the first four stages. Texts of any length are worked on whole. Ties: where one
of several documents stays, it is that with the smallest doc_id, in stages 1 and 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import chosen_path, decontaminate, line_runs, packing, quality_rules
from ledgerlens.llm import common as C
from ledgerlens.llm.queries import _byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(quality_rules.keep(docs))


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the new text."""
    if "n_chars" not in docs.columns:
        return docs
    doc = F.col("_doc").withField("n_chars", F.char_length("_doc.text").cast(docs.schema["n_chars"].dataType))
    return docs.select(C.as_struct(docs)).select(doc.alias("_doc")).select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_runs.drop_frequent_lines(docs).select("_doc.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs.select(C.as_struct(docs), "text"), C.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_spans") == 0).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.token_pieces(docs, _byte_bpe)
    digests = pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.sequences(digests, packing.place(pieces)).drop("piece")


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]

#: The last stage needs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
