"""The training-data pipeline over `documents`: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of
documents. What a stage decides takes effect on all rows that the stages before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm import neardup, packing, pii, quality, substring
from emberlog.llm.common import free_name, quoted, written
from emberlog.llm.queries import BYTE_BPE, tokenizer_path


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*map(quoted, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A row without doc_id goes too: no decision can name it."""
    verdicts = quality.judge(docs)
    kept = verdicts.groupBy("doc_id").agg(F.min(F.col("kept").cast("int")).alias("kept")).where("kept = 1")
    return _chosen(docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Wordless documents are groups of their own and stay. Of rows that share a doc_id one stays, the one with
    the smallest text (null after all others); a repeated row stays once. Rows without doc_id go. An empty table stays empty.
    """
    found = _chosen(docs, neardup.classes(docs).where("doc_id = component_id"))
    nth = free_name(docs, "nth")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    return found.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*map(quoted, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand earlier go; n_chars follows the text.

    Null text stays null, with no n_chars; rows that share a doc_id count as one document; rows without doc_id stay as they are.
    """
    return _retold(docs, substring.deduplicated(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; n_chars follows the text.

    Null text stays null, with no n_chars; every row is masked by its own spans, whatever its doc_id.
    """
    return _retold(docs, pii.masked(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and the sequences that hold them.

    Null or empty text: the end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.packed_documents(docs, tokenizer_path(BYTE_BPE), end_id=0)


def _retold(docs: DataFrame, changed: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["n_chars"]
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(*map(quoted, docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: The stages' estimates, searches and plans have no SQL form; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
