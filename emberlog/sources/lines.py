"""Text artifacts as numbered lines. Lines end at LF only; a CR before it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, line_no, line), line_no from 1 in each file.

    Large files are read in splits; each split's rows are counted first, so numbering needs no sort
    and no single task: a line's number is its place in the split plus the lines of the splits before.
    """
    rows = spark.read.text(paths, lineSep="\n").select(
        F.regexp_replace("value", "\\r\\z", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id")
    )
    splits = rows.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.join(splits, ["file", "block"])
    return numbered.select("file", "block", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def from_texts(texts: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """(file, block, line_no, line) of texts that are rows."""
    from emberlog.functions.text import split_lines

    return texts.select(F.col(file).alias("file"), F.posexplode(split_lines(F.col(text)))).select("file", F.lit(0).cast("bigint").alias("block"), (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line"))
