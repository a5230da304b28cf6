"""A corpus pipeline: quality, near copies, repeated passages, mixing, tokens; every stage is written and read again.

All stages take documents(doc_id, text, source, ...). Columns of any other name are kept by all stages but the last, also such that an operator uses inside.
An empty table gives an empty one in every stage. Rows that are equal in all columns are rows like any other until the near-copy stage, which keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, mixing, quality, simhash, spans
from loomtext.llm.shared import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and blank texts go; very long ones are read whole; equal texts share their fate; a null doc_id or source makes no difference. Without labels no document counts as toxic.
    """
    return quality.kept(docs, labels=table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Rows without doc_id come last in their group, and of rows that share an id that with the smallest text hash stays; null and blank texts are copies of each other.
    """
    return simhash.survivors(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that stand in an earlier place; n_chars follows the text.

    A null text stays null; a text that is gone whole stays as an empty one. Earlier is the smaller doc_id (null last), then the text's hash, then the place in the text.
    """
    rest = spans.remove_repeats(docs)
    sized = [F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return rest.select(*sized)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; null and empty texts have size 0 and come as often as their hash says; rows without id are drawn one by one.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and digest, and the digest of the text decoded from them, of every document and repetition.

    A null text has no ids, like an empty one; a null doc_id stays null.
    """
    return bpe.digest(docs, bpe.vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: No SQL: classifier, fingerprints and tokenizer cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {}
