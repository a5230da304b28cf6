"""Hybrid search of a table of queries, in one pass over the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.config import Config
from loomtext.functions.text import Analyzer, chunk_key, query_tokens
from loomtext.operators import expansion, fusion, lexical, vectors
from loomtext.plans.build import body_rows, heading_rows
from loomtext.sources.scratch import Scratch


def stored(tables: dict[str, DataFrame], channel: str) -> lexical.Lexicon:
    """A channel's lexicon in an index with postings; rows that later runs have replaced are left out."""
    own = lambda name: tables[name].where(F.col("channel") == channel).drop("channel")
    stats = own("stats").first()
    weights = tuple(lexical.FIELD_WEIGHTS.values()) if channel == "file" else (1.0,)
    return lexical.Lexicon(own("postings"), own("terms"), stats["n_rows"] if stats else 0, stats["avg_terms"] if stats else 0.0, own("dead") if "dead" in tables else None, weights)


def channel_hits(tables: dict[str, DataFrame], queries: DataFrame, config: Config, mode: str = "any", encoder: vectors.EncoderFactory | None = None, analyzer: Analyzer | None = None) -> DataFrame:
    """query_id, channel, key, rank: body, heading, file and vector rankings, the latter moved onto the files' representatives.

    Each channel's ranking is written once, as several rankings read it. An analyzer has to be that of the index; it also reads the queries.
    """
    scratch = Scratch(queries.sparkSession, "search")
    k, back = config.bm25_top_k, config.prefix_fallback
    asked = scratch.cut(queries.select("query_id", "query"), "queries")
    if analyzer is not None:
        asked = scratch.cut(asked.withColumn("query", F.array_join(query_tokens(F.col("query"), analyzer), " ")), "analyzed")
    places = tables["chunks"].select(chunk_key(F.col("file_path"), F.col("chunk_index")).alias("key"), "file_path", "chunk_index")

    def channel(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """A channel's ranking, from stored postings if there are any; queries without a hit are asked once more with their last token as a prefix."""
        own = stored(tables, name) if "postings" in tables else rows()
        return scratch.cut(lexical.bm25(asked, own, k, mode, back), f"{name}-hits")

    body = channel("body", lambda: body_rows(tables["chunks"], analyzer))
    headings = channel("heading", lambda: heading_rows(tables["chunks"], analyzer))
    found = vectors.embed_queries(asked, encoder or vectors.hash_encoder(config.vector_dim), config.query_prefix)
    own = tables["vectors"].select(chunk_key(F.col("file_path"), F.col("chunk_index")).alias("key"), "embedding")
    near = scratch.cut(vectors.nearest(found, own, config.vector_top_k).select("query_id", "key", "rank"), "vectors")
    named = [body.select("query_id", F.lit("body").alias("channel"), "key", "rank"), headings.select("query_id", F.lit("heading"), "key", "rank")]
    if config.title_rrf_weight > 0:
        files = channel("file", lambda: lexical.file_rows(tables["file_fields"])).select("query_id", F.col("key").alias("file_path"), "rank")
        stand = scratch.cut(fusion.file_to_chunk(files, body, headings, places), "files")
        near = fusion.coalesce_to_representative(near, stand, places)
        named.append(stand.select("query_id", F.lit("file"), "key", "rank"))
    named.append(near.select("query_id", F.lit("vector"), "key", "rank"))
    hits = named[0]
    for other in named[1:]:
        hits = hits.union(other)
    return scratch.cut(hits, "hits")


def hybrid_search(tables: dict[str, DataFrame], queries: DataFrame, config: Config, edges: DataFrame | None = None, mode: str = "any", encoder: vectors.EncoderFactory | None = None, analyzer: Analyzer | None = None) -> DataFrame:
    """query_id, rank, file_path, key, score, channels, the channels' ranks and contributions, expanded, linked_from, content, ...

    queries: query_id, query, and for expansion intent and top_k.
    """
    keyed = tables["chunks"].withColumn("key", chunk_key(F.col("file_path"), F.col("chunk_index")))
    hits = channel_hits(tables, queries, config, mode, encoder, analyzer)
    weights = {"file": config.title_rrf_weight}
    scratch = Scratch(queries.sparkSession, "fusion")
    fused = fusion.weighted_rrf(hits, weights, config.rrf_k)
    chosen = scratch.cut(fusion.select_diverse(fused, keyed.select("key", "file_path"), config.final_top_k, config.max_chunks_per_file), "chosen")
    results = chosen.select("query_id", "file_path", "key", "rank", "score")
    if edges is not None:
        gated = expansion.gate(queries, results)
        results = expansion.expand(results, edges, keyed.select("key", "file_path", "chunk_index"), gated, config.wiki_folders)
    else:
        results = results.withColumns({"expanded": F.lit(False), "linked_from": F.lit(None).cast("string")})
    told = fusion.explain(chosen.select("query_id", "key", "channels"), fusion.contributions(hits, weights, config.rrf_k))
    wide = results.join(told, ["query_id", "key"], "left").withColumn("channels", F.when(F.col("expanded"), F.array(F.lit("wiki_sources"))).otherwise(F.col("channels")))
    # the texts of the chunks come last, for the rows that are left
    return wide.join(keyed.select("key", "content", "heading_path", "start_line"), "key")
