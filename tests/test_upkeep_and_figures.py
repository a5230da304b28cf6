"""Digests of ranges, places in a sorted column and sweeps, against plain comparisons."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from loomtext.operators import evaluate, grounding, sync
from loomtext.operators.fusion import select_diverse, weighted_rrf


def test_evidence_is_taken_from_all_results(spark):
    """A note with 300 results, two of which fit, does not hide what ranks after them; half of its paths are written with backslashes."""
    rows = [(1, i, 0.5, "d/a.md" if i % 2 else "d\\a.md", f"text {i}", 1, []) for i in range(1, 301)] + [(1, 301 + i, 0.1, f"b{i}.md", "other", 1, []) for i in range(250)]
    results = spark.createDataFrame(rows, "query_id int, rank int, score double, file_path string, content string, start_line int, heading_path array<string>")
    got = grounding.grounding_sources(results, 100000).orderBy("source_no").collect()
    assert [r["rank"] for r in got] == [1, 2, *range(301, 551)]
    few = grounding.grounding_sources(results, 400).orderBy("source_no").collect()
    assert [r["rank"] for r in few] == [1, 2, 301, 302][: len(few)] and 2 < len(few) < 6


def test_digests_find_every_difference(spark):
    g = random.Random(4)
    schema = "file_path string, a int, b string, c array<string>"
    rows = [(f"n{i}.md", g.choice([None, 1, 2]), g.choice([None, "", "x"]), g.choice([None, [], ["", None]])) for i in range(300)]
    rows += rows[:20] + [(None, 1, "x", None)]
    other = [r for i, r in enumerate(rows) if i not in (3, 200, 305)]  # 305 stands twice
    # a null and an empty text in each other's place, a null for a number, rows without a path
    other = [("n50.md", r[1], "" if r[2] is None else None, r[3]) if r[0] == "n50.md" else ("n60.md", None if r[1] else 1, *r[2:]) if r[0] == "n60.md" else r for r in other] + [(None, 2, "x", None), rows[7]]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    got = sorted(map(str, sync.differences_by_digest(a, b.select("c", "b", "a", "file_path")).collect()))
    assert got == sorted(map(str, sync.differences(a, b).collect())) and len(got) > 6
    assert sync.differences_by_digest(a, a.repartition(7)).count() == 0
    empty = a.where("false")
    assert sync.differences_by_digest(empty, empty).count() == 0 and sync.differences_by_digest(a, empty).count() == len(rows)
    kept = (sync.digests(a), sync.digests(b))
    assert sync.unlike_ranges(*kept).count() <= 7
    assert sorted(map(str, sync.differences_by_digest(a, b, stored=kept).collect())) == sorted(map(str, sync.differences(a, b).collect()))


def test_places_in_a_sorted_column(spark):
    g = random.Random(5)
    values = [g.choice([g.uniform(-5, 5), 0.0, -0.0, 1.5, 1e300, -1e-300]) for _ in range(999)] + [1.5] * 500 + [None] * 9
    places = {f"p{k}": (lambda n, k=k: F.floor((n - 1) * k / 100)) for k in (0, 1, 25, 50, 95, 100)}
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = evaluate.order_statistics(frame, "v", places).first()
    known = sorted(v for v in values if v is not None)
    assert got.asDict() == {f"p{k}": known[math.floor((len(known) - 1) * k / 100)] for k in (0, 1, 25, 50, 95, 100)}
    assert math.isnan(evaluate.order_statistics(frame.unionAll(spark.createDataFrame([(float("nan"),)], "v double")), "v", places).first()["p100"])
    for none in (frame.where("v IS NULL"), frame.where("false")):
        assert evaluate.order_statistics(none, "v", places).first().asDict() == dict.fromkeys(places)


def test_sweep_in_one_pass_is_a_sweep_width_by_width(spark):
    g = random.Random(6)
    hits = [(q, c, f"f{k}#0", f"f{k}", r + 1) for q in range(6) for c in ("body", "vector") for r, k in enumerate(g.sample(range(40), 25))]
    hits = spark.createDataFrame(hits, "query_id int, channel string, key string, file_path string, rank int")
    cases = [(f"case-{q}", [f"f{g.randrange(40)}" for _ in range(3)] if q else [], [], ["gone"]) for q in range(7)]
    cases = spark.createDataFrame(cases, "case_id string, expected_paths array<string>, acceptable_paths array<string>, forbidden_paths array<string>")
    widths, files, single = (3, 10, 25, 60), hits.select("key", "file_path").distinct(), None
    for w in widths:
        ranking = select_diverse(weighted_rrf(hits.where(F.col("rank") <= w), {"body": 1.5}), files, 200)
        part = evaluate.case_metrics(cases, ranking.select(F.concat(F.lit("case-"), "query_id").alias("case_id"), "file_path", "rank")).withColumn("width", F.lit(w))
        single = part if single is None else single.unionByName(part)
    once = evaluate.sweep_channels(hits, cases, (*widths, 10), {"body": 1.5})
    assert sorted(once.collect()) == sorted(evaluate.sweep(single).collect()) and once.where("chosen").count() == 1
