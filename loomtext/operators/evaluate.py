"""Search quality: checks of relevance cases, metrics, the regression gate, sweeps and coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.scope import benchmark_path, coverage_path
from loomtext.operators.fusion import select_diverse, weighted_rrf
from loomtext.sources.scratch import Scratch

#: The intents a case may have.
INTENTS = ("exact", "known-item", "topic", "timeline", "value", "korean-morphology")
LISTS = ("expected_paths", "acceptable_paths", "forbidden_paths")
PATHS = 200


def validate_cases(cases: DataFrame) -> DataFrame:
    """case_id, problem: a row for every broken rule.

    cases: schema_version, vault, case_id, query, intent, the three lists, top_k.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    empty = [F.coalesce(F.size(c), F.lit(0)) <= 0 for c in LISTS]
    problems = [
        F.when(~F.col("schema_version").eqNullSafe(1), "schema_version: must be 1"),
        F.when(blank("vault"), "vault: missing"),
        F.when(~F.coalesce(F.col("case_id").rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"), F.lit(False)), "id: not in kebab case"),
        F.when(F.col("copies") > 1, "id: duplicate"),
        F.when(blank("query"), "query: missing"),
        F.when(~F.coalesce(F.col("intent").isin(*INTENTS), F.lit(False)), "intent: unknown"),
        F.when(empty[0] & empty[1] & empty[2], "paths: all lists are empty"),
        F.when(~F.coalesce(F.col("top_k").between(1, 200), F.lit(False)), "top_k: out of range"),
    ]
    counted = cases.join(cases.groupBy("case_id").agg(F.count("*").alias("copies")), "case_id", "left")
    return counted.select("case_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def validate_queries(queries: DataFrame) -> DataFrame:
    """queries with reason: null where query, match_mode and intent are valid."""
    blank = F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", "") == ""
    reason = F.when(blank, "query: blank").when(~F.coalesce(F.col("match_mode"), F.lit("any")).isin("any", "all", "phrase"), "match_mode: unknown").when(F.col("intent").isNotNull() & ~F.col("intent").isin(*INTENTS), "intent: unknown")
    return queries.withColumn("reason", reason)


def _listed(results: DataFrame) -> DataFrame:
    """case_id, paths: result paths in order of rank, at most PATHS of them."""
    w = Window.partitionBy("case_id").orderBy("rank")
    few = results.withColumn("n", F.row_number().over(w)).where(F.col("n") <= PATHS)
    return few.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", benchmark_path(F.col("file_path")).alias("p")))), lambda x: x["p"]).alias("paths"))


def _found(paths: Column, wanted: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(paths, 1, k), wanted))


def recall_at(paths: Column, expected: Column, k: int) -> Column:
    """Share of the expected paths among the first k results; 0 if none is expected."""
    return F.when(F.size(expected) > 0, _found(paths, expected, k) / F.size(expected)).otherwise(0.0)


def mrr_at(paths: Column, expected: Column, k: int = 10) -> Column:
    first = F.array_min(F.filter(F.transform(F.slice(paths, 1, k), lambda p, i: F.when(F.array_contains(expected, p), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def forbidden_at(paths: Column, forbidden: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(paths, 1, k), lambda p: F.array_contains(forbidden, p)))


def case_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row a case; results(case_id, file_path, rank), a case without results included."""
    none = F.array().cast("array<string>")
    lists = [F.array_distinct(F.transform(F.coalesce(F.col(c), none), benchmark_path)).alias(c.removesuffix("_paths")) for c in LISTS]
    own = [c for c in ("latency_ms", "channels") if c in cases.columns]
    rows = cases.select("case_id", *lists, *own).join(_listed(results), "case_id", "left").withColumn("paths", F.coalesce("paths", none))
    p, e, a, f = F.col("paths"), F.col("expected"), F.col("acceptable"), F.col("forbidden")
    return rows.select(
        "case_id",
        (F.size(e) > 0).alias("has_expected"),
        (F.size(a) > 0).alias("has_acceptable"),
        *[recall_at(p, e, k).alias(f"recall_{k}") for k in (20, 40)],
        mrr_at(p, e).alias("mrr_10"),
        ((F.size(e) > 0) & (_found(p, e, 40) > 0)).alias("success"),
        ((F.size(e) > 0) & (_found(p, e, 40) == F.size(e))).alias("complete"),
        (_found(p, a, 40) > 0).alias("acceptable_hit"),
        *[forbidden_at(p, f, k).alias(f"forbidden_{k}") for k in (20, 40)],
        F.size(F.array_distinct(F.slice(p, 1, 20))).alias("unique_paths_20"),
        *own,
    )


def order_statistics(rows: DataFrame, column: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: for each name the number at a place (from 0) of a sorted column, null if there is none; places are made of the count of numbers.

    Equal numbers are counted first, then dealt to ranges; sums of the ranges show in which one a place lies, and that range alone is sorted. Null takes no
    part; NaN is the largest.
    """
    scratch = Scratch(rows.sparkSession, "selection")
    counts = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    scratch.cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    sums = scratch.read("counts").groupBy("part").agg(F.sum("n").alias("size"))  # a row a range
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = sums.select("part", "size", F.coalesce(before, F.lit(0)).alias("start"), total.alias("total"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("total")).cast("long").alias("place")) for name, place in places.items()])
    asked = ranges.select("part", "start", "size", F.explode(wanted).alias("w")).select("part", "start", "size", "w.*").where("place >= start AND place < start + size")
    reached = F.col("start") + F.sum("n").over(Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = scratch.read("counts").join(F.broadcast(asked), "part").withColumn("reached", reached).where("reached > place")  # a row a place
    return found.agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """One row: means over cases with expected paths, sums of forbidden ones, median and 95th percentile of latency."""
    has = F.col("has_expected")

    def mean(c: Column, where: Column) -> Column:
        return F.round(F.avg(F.when(where, c.cast("double"))), 6)

    sums = [
        F.count("*").alias("cases"),
        F.count_if(has).alias("cases_with_expected"),
        *[mean(F.col(c), has).alias(c) for c in ("recall_20", "recall_40", "mrr_10", "success", "complete")],
        mean(F.col("acceptable_hit"), F.col("has_acceptable")).alias("acceptable_hit"),
        F.round(F.avg("unique_paths_20"), 6).alias("unique_paths_20"),
        *[F.sum(f"forbidden_{k}").alias(f"forbidden_{k}") for k in (20, 40)],
    ]
    if "latency_ms" not in metrics.columns:
        return metrics.agg(*sums)
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.floor((n - 1) * 0.95)}
    times = order_statistics(metrics, "latency_ms", places).select(F.round((F.col("low") + F.col("high")) / 2, 3).alias("p50_ms"), F.round("p95", 3).alias("p95_ms"))
    return metrics.agg(*sums).join(F.broadcast(times))  # single rows


def baseline_gate(current: DataFrame, baseline: DataFrame, current_cases: DataFrame, baseline_cases: DataFrame) -> DataFrame:
    """failure: a row for everything that got worse. The first two are rows of aggregate_metrics, the others of case_metrics."""
    c, b = current.alias("c"), baseline.alias("b")
    checks = [
        F.when(F.col("c.recall_40") < F.col("b.recall_40"), "recall@40 dropped"),
        *[F.when(F.col(f"c.forbidden_{k}") > F.col(f"b.forbidden_{k}"), f"forbidden@{k} rose") for k in (20, 40)],
        F.when(F.col("c.p95_ms") > 1.25 * F.col("b.p95_ms"), "p95 above 1.25 times the baseline") if "p95_ms" in current.columns and "p95_ms" in baseline.columns else F.lit(None).cast("string"),
    ]
    overall = c.join(F.broadcast(b)).select(F.explode(F.array_compact(F.array(*checks))).alias("failure"))  # single rows
    now = current_cases.select("case_id", F.col("complete").alias("now"))
    lost = baseline_cases.where("complete").select("case_id").join(now, "case_id", "left").where(~F.coalesce("now", F.lit(False)))
    return overall.unionByName(lost.select(F.concat(F.lit("complete case lost: "), "case_id").alias("failure")))


def sweep(metrics_by_width: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """width, recall_40, mrr_10, forbidden_40, passes, chosen of rows (width, case metrics): the least width whose recall is the best."""
    rows = metrics_by_width.groupBy("width").agg(*[F.round(F.avg(F.when(F.col("has_expected"), F.col(c))), 6).alias(c) for c in ("recall_40", "mrr_10")], F.sum("forbidden_40").alias("forbidden_40"))
    best = rows.agg(F.max("recall_40").alias("top"), F.min("forbidden_40").alias("least"))
    judged = rows.join(F.broadcast(best)).withColumn("passes", (F.col("recall_40") >= F.col("top") - tolerance) & (F.col("forbidden_40") <= F.col("least")))  # a single row
    first = judged.where("passes").agg(F.min("width").alias("first"))
    return judged.join(F.broadcast(first)).select("width", "recall_40", "mrr_10", "forbidden_40", "passes", (F.col("width") == F.col("first")).alias("chosen"))  # a single row


def sweep_channels(hits: DataFrame, cases: DataFrame, widths: tuple[int, ...], weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """sweep() of rankings that are fused from channel hits(query_id, channel, key, file_path, rank) cut at each width.

    Channels are searched once, at the largest width, and fused once: a hit goes to every width that reaches it, and (width, query) takes the place of the
    query, so the number of shuffles does not depend on the number of widths.
    """
    widths_at = F.array(*[F.lit(w) for w in sorted(set(widths))])
    cut = hits.where(F.col("rank") <= max(widths)).withColumn("width", F.explode(F.filter(widths_at, lambda w: w >= F.col("rank"))))
    fused = weighted_rrf(cut.withColumn("query_id", F.struct("width", "query_id")), weights or {}, k)
    ranking = select_diverse(fused, hits.select("key", "file_path").distinct(), 200)
    ranking = ranking.select(F.struct(F.col("query_id.width").alias("width"), F.concat(F.lit("case-"), F.col("query_id.query_id").cast("string")).alias("case_id")).alias("case_id"), "file_path", "rank")
    asked = cases.withColumn("width", F.explode(widths_at)).withColumn("case_id", F.struct("width", "case_id"))
    return sweep(case_metrics(asked, ranking).withColumn("width", F.col("case_id.width")))


def coverage_compare(*sets: DataFrame) -> DataFrame:
    """file_path, in_a, in_b, ...: which of the path sets (file_path) hold each path."""
    names = [chr(ord("a") + i) for i in range(len(sets))]
    union = None
    for name, df in zip(names, sets, strict=True):
        part = df.select(coverage_path(F.col("file_path")).alias("file_path"), F.lit(name).alias("side"))
        union = part if union is None else union.unionByName(part)
    return union.where("file_path <> ''").groupBy("file_path").agg(*[F.bool_or(F.col("side") == n).alias(f"in_{n}") for n in names])


def coverage_counts(compared: DataFrame) -> DataFrame:
    """One row: sizes of the union, of the part in all sets, and of what is only in one."""
    flags = [c for c in compared.columns if c.startswith("in_")]
    total = sum((F.col(c).cast("int") for c in flags[1:]), F.col(flags[0]).cast("int"))
    return compared.agg(F.count("*").alias("in_any"), F.count_if(total == len(flags)).alias("in_all"), *[F.count_if(F.col(c) & (total == 1)).alias(f"only_{c[3:]}") for c in flags])
