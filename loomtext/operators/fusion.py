"""Fusing channel rankings: representatives, weighted reciprocal ranks, diversity, explanations.

After the channels' top-k all tables hold at most a few hundred rows a query; windows are by query, never over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = ["query_id", "channel", "key", "rank"]


def unique_files(results: DataFrame) -> DataFrame:
    """A ranking (query_id, file_path, rank) with each file at its best place, re-ranked."""
    first = results.groupBy("query_id", "file_path").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "file_path")
    return first.withColumn("rank", F.row_number().over(w))


def file_to_chunk(file_hits: DataFrame, body: DataFrame, headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, file_path, key, rank: the chunk that stands for each matched file.

    file_hits(query_id, file_path, rank); body and headings are (query_id, key, rank); chunks(key, file_path, chunk_index). The
    best chunk in the body ranking, else in the heading ranking, else the file's first; files without chunks are left out.
    """
    seen = body.select("query_id", "key", F.struct(F.lit(0), F.col("rank")).alias("place")).unionByName(headings.select("query_id", "key", F.struct(F.lit(1), F.col("rank")).alias("place")))
    own = chunks.select("key", "file_path")
    best = seen.join(own, "key").groupBy("query_id", "file_path").agg(F.min_by("key", "place").alias("best"))
    first = chunks.groupBy("file_path").agg(F.min_by("key", F.struct("chunk_index", "key")).alias("first"))
    rows = file_hits.select("query_id", "file_path", "rank").join(first, "file_path").join(best, ["query_id", "file_path"], "left")
    w = Window.partitionBy("query_id").orderBy("rank", "file_path")
    return rows.select("query_id", "file_path", F.coalesce("best", "first").alias("key"), F.row_number().over(w).alias("rank"))


def coalesce_to_representative(vector_hits: DataFrame, representatives: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector hits (query_id, key, rank) of a file with a representative move onto it; later hits on one chunk are dropped."""
    moved = vector_hits.join(chunks.select("key", "file_path"), "key").join(representatives.select("query_id", "file_path", F.col("key").alias("to")), ["query_id", "file_path"], "left")
    once = moved.groupBy("query_id", F.coalesce("to", "key").alias("key")).agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))


def contributions(hits: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """query_id, channel, key, rank, part: each channel's hits once, in dense ranks, with weight / (k + rank)."""
    first = hits.groupBy("query_id", "channel", "key").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id", "channel").orderBy("rank", "key")
    weight: Column = F.lit(1.0)
    for channel, x in weights.items():
        weight = F.when(F.col("channel") == channel, F.lit(float(x))).otherwise(weight)
    return first.withColumn("rank", F.row_number().over(w)).withColumn("part", weight / (k + F.col("rank"))).where("part > 0")


def weighted_rrf(hits: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """query_id, key, score, channels, rank: sums of contributions, best first, equal ones in order of key."""
    fused = contributions(hits, weights, k).groupBy("query_id", "key").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.asc("key"))
    return fused.withColumn("rank", F.row_number().over(w))


def select_diverse(ranked: DataFrame, chunks: DataFrame, top_k: int, cap: int = 1) -> DataFrame:
    """The first top_k hits with at most cap of a file; hits whose chunk is gone are skipped."""
    rows = ranked.join(chunks.select("key", "file_path"), "key")
    of_file = Window.partitionBy("query_id", "file_path").orderBy("rank")
    few = rows.withColumn("of_file", F.row_number().over(of_file)).where(F.col("of_file") <= cap).drop("of_file")
    w = Window.partitionBy("query_id").orderBy("rank")
    return few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


CHANNELS = ("body", "heading", "file", "vector")


def explain(selected: DataFrame, parts: DataFrame) -> DataFrame:
    """selected with, for each channel, its rank (or -1) and contribution (to 6 places), and the channels' names."""
    wide = parts.groupBy("query_id", "key").agg(
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("rank"))), F.lit(-1)).alias(f"{c}_rank") for c in CHANNELS],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round("part", 6).alias("part"))))).alias("rrf_contributions"),
    )
    names = F.flatten(F.transform("channels", lambda c: F.when(c == "file", F.array(c, F.lit("title"))).otherwise(F.array(c))))
    return selected.join(wide, ["query_id", "key"], "left").withColumn("channels", names)


def pool_diagnostics(fused: DataFrame, selected: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, candidate_pool_size, requested_top_k, returned_count, pool_warning for every query."""
    pool = fused.groupBy("query_id").agg(F.count_distinct("key").alias("pool"))
    back = selected.groupBy("query_id").agg(F.count("*").alias("back"))
    rows = queries.select("query_id").join(pool, "query_id", "left").join(back, "query_id", "left")
    size = F.coalesce("pool", F.lit(0))
    return rows.select("query_id", size.alias("candidate_pool_size"), F.lit(top_k).alias("requested_top_k"), F.coalesce("back", F.lit(0)).alias("returned_count"), (size < top_k).alias("pool_warning"))
