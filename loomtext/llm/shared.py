"""Small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.scratch import Scratch, shared_folder

__all__ = ["Scratch", "fill_missing", "rows_at_once", "shared_folder", "table", "word_count"]

#: ASCII white space, which separates words: space and tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs started inside hand at most n rows at once to a Python worker, so that whole texts of any length fit into its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_count(text: Column) -> Column:
    """Words of a text (null: 0) as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_missing(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the named columns, cast to the given types; columns it lacks are null."""
    have = set(df.columns)
    return df.select([(F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
