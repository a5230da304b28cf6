"""One-hop expansion: the sources of wiki notes among a query's first results join its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results that stay where they are, wiki notes looked at, sources added.
PRESERVED, WIKI_NOTES, SOURCES = 30, 5, 5
#: Fixed value: questions about courses of events, common patterns and links.
RELATION = r"(?:전체\s*(?:경과|이력|전말|연결)|공통\s*패턴|(?:사례|사안|문서|이슈|업체|인물|담당자).{0,12}연결)"


def expands(query: Column, intent: Column, top_k: Column, direct: Column) -> Column:
    """Whether a query with direct results is expanded."""
    asks = F.when(intent.isNotNull(), intent == "timeline").otherwise(F.coalesce(query.rlike(RELATION), F.lit(False)))
    return (direct > 0) & ~((direct >= top_k) & (top_k <= PRESERVED)) & asks


def gate(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, top_k, direct, expand of queries(query_id, query, intent, top_k)."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("direct"))
    rows = queries.join(counts, "query_id", "left").withColumn("direct", F.coalesce("direct", F.lit(0)))
    return rows.select("query_id", "top_k", "direct", expands(F.col("query"), F.col("intent"), F.col("top_k"), F.col("direct")).alias("expand"))


def expand(results: DataFrame, edges: DataFrame, chunks: DataFrame, gated: DataFrame, wiki_folders: tuple[str, ...]) -> DataFrame:
    """results(query_id, file_path, key, rank, score) with linked sources inserted after the preserved head, cut at top_k.

    Added rows have expanded, linked_from, the first chunk of their file, and a score just below the head's least.
    """
    direct = results.withColumns({"expanded": F.lit(False), "linked_from": F.lit(None).cast("string")})
    if not wiki_folders:
        return direct
    wiki = F.lit(False)
    for folder in wiki_folders:
        wiki |= F.col("file_path").startswith(folder.rstrip("/") + "/")
    chosen = gated.where("expand").select("query_id", "top_k", "direct")
    head = results.where(F.col("rank") <= PRESERVED).join(chosen, "query_id")
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    notes = head.where(wiki).withColumn("n", F.row_number().over(by_rank)).where(F.col("n") <= WIKI_NOTES).select("query_id", "n", F.col("file_path").alias("wiki_path"))
    linked = notes.join(edges, "wiki_path").select("query_id", F.col("source_path").alias("file_path"), F.struct("n", "pos", "wiki_path").alias("at"))
    linked = linked.join(results.select("query_id", "file_path"), ["query_id", "file_path"], "left_anti")
    linked = linked.groupBy("query_id", "file_path").agg(F.min("at").alias("at"))
    linked = linked.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("n") <= SOURCES)
    # only now is it asked whether a source is indexed
    first = chunks.groupBy("file_path").agg(F.min_by("key", F.struct("chunk_index", "key")).alias("key"))
    linked = linked.join(first, "file_path").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n")))
    added = linked.groupBy("query_id").agg(F.count("*").alias("added"))
    ends = head.groupBy("query_id").agg(F.count("*").alias("kept"), F.min("score").alias("least"), F.max("top_k").alias("top_k"))
    moved = direct.join(added, "query_id", "left").withColumn("rank", F.when(F.col("rank") > PRESERVED, F.col("rank") + F.coalesce("added", F.lit(0))).otherwise(F.col("rank")))
    new = linked.join(ends, "query_id").withColumn("rank", (F.col("kept") + F.col("place")).cast("int"))
    new = new.select("query_id", "file_path", "key", "rank", F.round(F.col("least") - F.col("rank") / 1e6, 6).alias("score"), F.lit(True).alias("expanded"), F.col("at.wiki_path").alias("linked_from"))
    both = moved.select(*new.columns).unionByName(new)
    # a query that gets sources is cut at its own top_k
    limit = added.join(gated.select("query_id", "top_k"), "query_id").select("query_id", F.col("top_k").alias("limit"))
    return both.join(limit, "query_id", "left").where(F.col("limit").isNull() | (F.col("rank") <= F.col("limit"))).drop("limit")
