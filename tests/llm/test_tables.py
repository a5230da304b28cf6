"""Queries on the smallest tables: held-out accuracy, oracles, and the pipeline's stages."""

from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_quality_on_labels(spark):
    from loomtext.llm import queries

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op10_quality(spark, SF).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    right = [(r["quality"] >= 0.5) == (r["label"] == 1) for r in rows]
    assert sum(right) >= 0.95 * len(right)
    assert all(r["keep"] for r in rows if r["label"] == 1 and not r["toxic"])


def test_url_oracle(spark):
    from loomtext.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    found = queries.op4_url_filter(spark, SF)
    wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES['op4_url_filter']})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    from loomtext.llm.shared import Scratch

    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == counts[4]
    assert spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IS NULL").count() == 0
