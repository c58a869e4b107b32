"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. A driver that runs STAGES itself writes each result as Parquet and rereads it as the next
one's docs; `run` does the same in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontam, line_dedup, minhash, packing, quality
from latticework.llm.common import drop_written, table, written
from latticework.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Rows are judged one by one by text, language and source, so they may share a doc_id or have none.
    Null and empty texts go. Null languages and sources are groups of their own.
    """
    return quality.quality_filter(docs)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share but for their first occurrence; n_chars follows the text.

    Null texts stay null (with null n_chars), and a text may become empty. A null source is one site.
    """
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near copies, with all rows that share its doc_id.

    Texts without words and rows without a doc_id are copies of nothing and stay.
    """
    return minhash.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget, judged by their text whatever their doc_id.

    Null and empty texts stay; null and empty items match nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is one piece, its end token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", boilerplate_lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed_sequences),
]

#: Three stages (estimates, near copies, packing) are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
