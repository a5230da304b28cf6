"""The registered queries of the search library, over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.config import Config
from loomtext.functions import scope, text
from loomtext.operators import chunking, evaluate, expansion, frontmatter, fusion, grounding, history, index, inverted, lexical, scan, sync, vectors
from loomtext.plans import build, search
from loomtext.plans.views import table, view
from loomtext.sources import notes as sources
from loomtext.sources import watch
from loomtext.sources.scratch import Scratch, shared_folder
from loomtext.streaming import bursts
from loomtext.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = Config()
INCLUDE, EXCLUDE = ("notes/**", "5_Wiki/**"), ("notes/s3/**", "**/doc_1?.md")
DIM = 16


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the plain documents, with headings [source, lang]."""
    docs = view(spark, sf, "plain")
    own = docs.select("file_path", F.array("source", "lang").alias("own"))
    rows = chunking.chunk(docs).join(own, "file_path").withColumn("heading_path", F.col("own")).drop("own")
    return Scratch(spark, "chunks").cut(rows.repartition(_tasks(spark), "file_path", "chunk_index"), "chunks")


def _spread(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as they lie, or dealt anew if few tasks would have all rows."""
    return docs if docs.select(F.spark_partition_id()).distinct().count() >= _tasks(spark) else docs.repartition(_tasks(spark), "doc_id")


def _tasks(spark: SparkSession) -> int:
    """Partitions that keep all cores busy also with tables that would fit into one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _heading_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical rows of the chunks' headings, without the chunks' texts."""
    docs = _spread(spark, view(spark, sf, "plain"))
    own = view(spark, sf, "plain").select("file_path", F.array("source", "lang").alias("heading_path"))
    return build.heading_rows(chunking.chunk(docs).select("file_path", "chunk_index").join(own, "file_path"))


def _rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Lexical rows as a table, as searches read them several times."""
    return Scratch(spark, "rows").cut(df, "rows")


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", text.chunk_key(F.col("file_path"), F.col("chunk_index")))


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Paths, texts, fields


@query
def normalize_paths(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat(F.lit("\\a//"), F.when(F.col("doc_id") % 5 == 0, "../").otherwise("./"), F.col("file_path"), F.lit("/"))
    return view(spark, sf, "plain").select("doc_id", scope.normalize_path(odd).alias("path"), scope.coverage_path(F.concat(F.lit(" ./"), "file_path")).alias("coverage_path"))


@query
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "plain").where(scope.in_scope(F.col("file_path"), INCLUDE, EXCLUDE)).select("file_path")


@query
def preview_scope(spark: SparkSession, sf: str) -> DataFrame:
    return scope.preview_scope(view(spark, sf, "plain"), INCLUDE, EXCLUDE)


@query
def strip_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    body = text.strip_frontmatter(F.col("text"))
    return view(spark, sf, "notes").select("file_path", F.length(body).cast("long").alias("n_chars"), text.content_hash(body).alias("body_hash"))


@query
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.chunk(view(spark, sf, "plain"))
    return rows.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("n_chars"), text.content_hash(F.col("content")).alias("content_hash"))


@query
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.chunk(view(spark, sf, "notes"), "markdown-v2")
    return rows.select("file_path", "chunk_index", "content", F.array_join("heading_path", " > ").alias("headings"), "start_line", "end_line", "lexical_only")


@query
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    made = text.embedding_text(text.stem(F.col("file_path")), F.col("heading_path"), F.col("content"))
    return _chunks(spark, sf).select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.length(made).cast("long").alias("n_chars"), text.content_hash(made).alias("text_hash"))


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), text.content_hash(F.array_join(tokens, " ")).alias("tokens_hash"))


@query
def path_fields(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("file_path")
    return view(spark, sf, "plain").select("file_path", F.array_join(text.basename_tokens(path), " ").alias("basename"), F.array_join(text.directory_tokens(path), " ").alias("directory"), F.array_join(text.heading_tokens(F.array("source", "lang")), " ").alias("headings"))


@query
def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    return frontmatter.parse(view(spark, sf, "notes")).select("file_path", F.array_join("aliases", " ").alias("aliases"), F.col("properties"), F.array_join("sources", " ").alias("sources"), "bad")


@query
def file_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = frontmatter.file_fields(view(spark, sf, "notes"))
    return rows.select("file_path", *[F.array_join(c, " ").alias(c) for c in rows.columns if c != "file_path"])


@query
def source_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = frontmatter.source_edges(view(spark, sf, "notes"), CONFIG.include, CONFIG.exclude)
    return rows.select("wiki_path", F.col("pos").cast("long").alias("pos"), "source_path")


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("file_hash"))


# Lexical search


@query
def postings(spark: SparkSession, sf: str) -> DataFrame:
    posted = lexical.postings(build.body_rows(_chunks(spark, sf)))
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(build.body_rows(_chunks(spark, sf))).select("n_rows", "total_terms", F.round("avg_terms", 6).alias("avg_terms"))


def _bm25(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    rows = build.body_rows(chunking.chunk(_spread(spark, view(spark, sf, "plain"))))
    return _out(lexical.bm25(view(spark, sf, "queries"), rows, CONFIG.bm25_top_k, mode))


@query
def bm25_body(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, "any")


@query
def bm25_match_all(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, "all")


@query
def bm25_match_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, "phrase")


@query
def bm25_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _out(lexical.bm25(view(spark, sf, "file_queries"), _heading_rows(spark, sf), CONFIG.bm25_top_k))


@query
def bm25_files(spark: SparkSession, sf: str) -> DataFrame:
    return _out(lexical.bm25(view(spark, sf, "file_queries"), _rows(spark, lexical.file_rows(frontmatter.file_fields(view(spark, sf, "notes")))), CONFIG.bm25_top_k))


@query
def bm25_prefix_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without a hit as they are: a term with a sign of its own, and the start of a source's name."""
    asked = view(spark, sf, "queries").select("query_id", F.concat(F.lit("zzqx"), F.col("query_id").cast("string"), F.lit(" sr")).alias("query"))
    return _out(lexical.bm25(asked, _heading_rows(spark, sf), CONFIG.bm25_top_k, prefix_fallback=True))


# Vectors


@query
def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("passage: "), "text").alias("text"))
    rows = vectors.hash_vectors(texts, "doc_id", "text", DIM)
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e4, 0).cast("long").cast("string")), ",").alias("vector"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("key"), "embedding")


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _out(vectors.nearest(*_sides(spark, sf), CONFIG.vector_top_k, exclude_self=True))


@query
def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same search through cells."""
    asked, own = _sides(spark, sf)
    scratch = Scratch(spark, "cells")
    return _out(vectors.nearest_in_cells(asked, vectors.in_cells(own, scratch), scratch, CONFIG.vector_top_k, exclude_self=True)[0])


@query
def vector_topk_uneven(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of two lengths, some with an entry that is null or no number: only equal lengths are compared."""
    cut = F.when(F.col("key") % 7 == 0, F.slice("embedding", 1, 32)).when(F.col("key") % 11 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float"))))
    odd = cut.when(F.col("key") % 13 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    own = _sides(spark, sf)[1].select("key", odd.alias("embedding"))
    return _out(vectors.nearest(own.where("key % 20 = 0").withColumnRenamed("key", "query_id"), own, CONFIG.vector_top_k, exclude_self=True))


@query
def embedding_parity(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").select("vec_id", "embedding")
    rough = own.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("embedding"))
    return vectors.parity(own, rough, "vec_id").select("n", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("min_cosine", 6).alias("min_cosine"))


# Fusion, on hits that the tables give


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "hits").withColumn("key", F.concat("file_path", F.lit("#000000")))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "plain").where("doc_id % 11 <> 0")
    return docs.select("file_path", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("chunk_index")).withColumn("key", text.chunk_key(F.col("file_path"), F.col("chunk_index")))


def _channel(hits: DataFrame, name: str) -> DataFrame:
    return hits.where(F.col("channel") == name)


WEIGHTS = {"file": 1.5}


@query
def file_to_chunk(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    second = _channel(hits, "heading").withColumn("key", F.concat("file_path", F.lit("#000001")))
    return fusion.file_to_chunk(_channel(hits, "file"), _channel(hits, "body").where("rank <= 3"), second.where("rank <= 5"), _places(spark, sf)).select("query_id", "file_path", "key", F.col("rank").cast("long").alias("rank"))


@query
def coalesce_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    stand = _channel(hits, "file").select("query_id", "file_path", F.concat("file_path", F.lit("#000001")).alias("key"))
    both = _channel(hits, "vector").select("query_id", F.explode(F.array("key", F.concat("file_path", F.lit("#000001")))).alias("key"), "rank")
    return fusion.coalesce_to_representative(both, stand, _places(spark, sf)).select("query_id", "key", F.col("rank").cast("long").alias("rank"))


@query
def weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    rows = fusion.weighted_rrf(_hits(spark, sf), WEIGHTS)
    return rows.select("query_id", "key", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"), F.col("rank").cast("long").alias("rank"))


@query
def select_diverse(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    two = hits.unionByName(hits.withColumn("key", F.concat("file_path", F.lit("#000001"))).withColumn("rank", F.col("rank") + 1))
    rows = fusion.select_diverse(fusion.weighted_rrf(two, WEIGHTS), _places(spark, sf), 10)
    return rows.select("query_id", "file_path", "key", F.col("rank").cast("long").alias("rank"))


@query
def explain_results(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    told = fusion.explain(fusion.weighted_rrf(hits, WEIGHTS), fusion.contributions(hits, WEIGHTS))
    return told.select("query_id", "key", F.array_join("channels", ",").alias("channels"), *[F.col(f"{c}_rank").cast("long").alias(f"{c}_rank") for c in fusion.CHANNELS], F.round(F.aggregate(F.map_values("rrf_contributions"), F.lit(0.0), lambda a, x: a + x), 4).alias("contributions"))


@query
def pool_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.weighted_rrf(_hits(spark, sf), WEIGHTS)
    rows = fusion.pool_diagnostics(fused, fused.where("rank <= 20"), view(spark, sf, "queries"), 25)
    return rows.select("query_id", *[F.col(c).cast("long").alias(c) for c in rows.columns[1:4]], "pool_warning")


@query
def unique_files(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.unique_files(_hits(spark, sf).select("query_id", "file_path", "rank")).select("query_id", "file_path", F.col("rank").cast("long").alias("rank"))


def _direct(spark: SparkSession, sf: str) -> DataFrame:
    rows = fusion.select_diverse(fusion.weighted_rrf(_hits(spark, sf), WEIGHTS), _places(spark, sf), 40)
    return rows.select("query_id", "file_path", "key", "rank", F.round("score", 6).alias("score"))


@query
def expansion_gate(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.gate(view(spark, sf, "queries"), _direct(spark, sf)).select("query_id", F.col("direct").cast("long").alias("direct"), "expand")


@query
def expand_sources(spark: SparkSession, sf: str) -> DataFrame:
    direct, places = _direct(spark, sf), _places(spark, sf)
    edges = frontmatter.source_edges(view(spark, sf, "notes"), CONFIG.include, CONFIG.exclude)
    rows = expansion.expand(direct, edges, places, expansion.gate(view(spark, sf, "queries"), direct), CONFIG.wiki_folders)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "file_path", "score", "expanded", "linked_from")


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "notes")
    scratch = Scratch(spark, "index")
    tables = build.note_tables(docs, Config(chunker="markdown-v2"))
    tables |= {name: scratch.cut(tables[name], name) for name in ("file_fields", "vectors")}
    edges = scratch.cut(frontmatter.source_edges(docs, CONFIG.include, CONFIG.exclude), "edges")
    rows = search.hybrid_search(tables, view(spark, sf, "queries"), CONFIG, edges)
    return rows.select("query_id", "rank", "file_path", "key", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"), "expanded", "linked_from", "start_line")


@query
def grep_notes(spark: SparkSession, sf: str) -> DataFrame:
    return scan.grep_notes(view(spark, sf, "plain"), "Licensed under").select("file_path", F.col("line_no").cast("long").alias("line_no"), "line")


@query
def read_notes(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "notes")
    wanted = docs.select(F.when(F.col("modified_ns") % 7000 == 0, F.concat(F.lit("../"), "file_path")).when(F.col("modified_ns") % 11000 == 0, "none.md").otherwise(F.col("file_path")).alias("path"))
    rows = scan.read_notes(wanted.distinct(), docs, INCLUDE, ("notes/s3/**",))
    return rows.select("path", "status", F.length("content").cast("long").alias("n_chars"), "heading")


# Evidence and answers


@query
def grounding_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "answer_sources").withColumn("heading_path", F.array(F.lit("h")))
    return grounding.grounding_sources(rows.withColumn("file_path", F.regexp_replace("file_path", r"\d+\.md", "x.md")), 6000).select("query_id", "source_no", "source_id", "file_path", F.length("content").alias("n_chars"), "rank")


@query
def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "answer_sources").withColumn("heading_path", F.array().cast("array<string>"))
    asked = view(spark, sf, "answers").select("query_id", F.col("answer").alias("query"))
    made = grounding.prompt_rows(asked, rows)
    return made.select("query_id", F.length("prompt").cast("long").alias("n_chars"), text.content_hash(F.col("prompt")).alias("prompt_hash"))


@query
def normalize_citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = grounding.normalize_citations(view(spark, sf, "answers"), view(spark, sf, "answer_sources"))
    return rows.select("query_id", text.content_hash(F.col("answer")).alias("answer_hash"), F.array_join("used", ",").alias("used"), "warning")


@query
def citations(spark: SparkSession, sf: str) -> DataFrame:
    known = view(spark, sf, "answer_sources").withColumn("heading_path", F.array().cast("array<string>"))
    rows = grounding.citations(grounding.normalize_citations(view(spark, sf, "answers"), known), known)
    return rows.select("query_id", F.col("citation_no").cast("long").alias("citation_no"), "source_id", "file_path")


@query
def extract_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = grounding.extract_tool_calls(view(spark, sf, "turns"))
    args = F.array_join(F.transform(F.map_entries("args"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("turn_id", F.col("call_no").cast("long").alias("call_no"), "name", F.length(args).cast("long").alias("n_chars"), text.content_hash(args).alias("args_hash"))


@query
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "answer_sources").select("query_id", F.col("source_no").alias("item_no"), F.when(F.col("source_no") % 2 == 0, "read").otherwise("search").alias("kind"), "content")
    rows = grounding.evidence_budget(items, 5000)
    return rows.select("query_id", F.col("item_no").cast("long").alias("item_no"), "kind", F.length("content").cast("long").alias("n_chars"))


@query
def answer_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    known = view(spark, sf, "answer_sources").withColumn("heading_path", F.array().cast("array<string>"))
    rows = grounding.answer_diagnostics(grounding.normalize_citations(view(spark, sf, "answers"), known), known)
    return rows.select("query_id", "status", "grounded", F.col("retrieved_count").cast("long").alias("retrieved_count"), F.col("answer_chars").cast("long").alias("answer_chars"), "citation_warning")


@query
def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), "turn", "role", F.col("text").alias("content"))
    first = turns.where("turn = 0").select("request_id", F.col("content").alias("query"), (F.col("request_id") % 15).cast("int").alias("top_k"), (F.col("request_id") % 5 * 9000).cast("int").alias("max_context_chars"))
    return grounding.validate_requests(first, turns)


@query
def to_note_markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = grounding.to_note_markdown(view(spark, sf, "answers"), view(spark, sf, "answer_sources"))
    return rows.select("query_id", "markdown", F.aggregate(F.map_values("cited_files"), F.lit(0), lambda a, x: a + x).alias("n_cited"))


# Evaluation


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    gold = view(spark, sf, "gold").groupBy("query_id").agg(F.array_sort(F.collect_set("file_path")).alias("expected_paths"))
    hits = _hits(spark, sf).where("channel = 'body'").groupBy("query_id").agg(F.min_by("file_path", "rank").alias("bad"))
    rows = view(spark, sf, "queries").join(gold, "query_id", "left").join(hits, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("case-"), F.col("query_id").cast("string")).alias("case_id"), F.lit(1).alias("schema_version"), F.when(F.col("query_id") % 9 != 0, "v").alias("vault"), "query", "intent",
        F.coalesce("expected_paths", none).alias("expected_paths"), none.alias("acceptable_paths"), F.when(F.col("bad").isNotNull(), F.array("bad")).otherwise(none).alias("forbidden_paths"), (F.col("query_id") * 10).cast("int").alias("top_k"), (F.col("query_id") * 7 % 50 + 10.0).alias("latency_ms"),
    )


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Results in which the expected paths stand behind two hits."""
    gold = view(spark, sf, "gold").select("query_id", "file_path", (F.lit(100) + F.col("doc_id")).alias("place"))
    hits = _hits(spark, sf).where("channel = 'body' AND rank <= 2").select("query_id", "file_path", F.col("rank").alias("place"))
    rows = hits.unionByName(gold).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return rows.select(F.concat(F.lit("case-"), F.col("query_id").cast("string")).alias("case_id"), "file_path", "rank")


@query
def validate_cases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.validate_cases(_cases(spark, sf))


@query
def validate_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "queries").select("query_id", F.when(F.col("query_id") % 5 == 0, " \n").otherwise(F.col("query")).alias("query"), F.when(F.col("query_id") % 3 == 0, "some").alias("match_mode"), F.when(F.col("query_id") % 4 == 0, "odd").otherwise(F.col("intent")).alias("intent"))
    return evaluate.validate_queries(rows).select("query_id", "reason")


@query
def case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.case_metrics(_cases(spark, sf), _ranked(spark, sf))
    return rows.select("case_id", "has_expected", *[F.round(c, 6).alias(c) for c in ("recall_20", "recall_40", "mrr_10")], "success", "complete", *[F.col(c).cast("long").alias(c) for c in ("forbidden_20", "forbidden_40", "unique_paths_20")])


@query
def aggregate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.aggregate_metrics(evaluate.case_metrics(_cases(spark, sf), _ranked(spark, sf)))
    return rows.select("cases", "cases_with_expected", "recall_20", "recall_40", "mrr_10", "success", "complete", "unique_paths_20", "forbidden_20", "forbidden_40", "p50_ms", "p95_ms")


@query
def baseline_gate(spark: SparkSession, sf: str) -> DataFrame:
    cases, ranked = _cases(spark, sf), _ranked(spark, sf)
    before = evaluate.case_metrics(cases, ranked)
    now = evaluate.case_metrics(cases.withColumn("latency_ms", F.col("latency_ms") * 2), ranked.where("rank <> 3"))
    return evaluate.baseline_gate(evaluate.aggregate_metrics(now), evaluate.aggregate_metrics(before), now, before)


@query
def sweep_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Channels cut at several widths and fused again: the least width that finds as much as any."""
    gold = view(spark, sf, "gold").select("query_id", F.lit("vector").alias("channel"), "file_path", (F.col("doc_id") * 7 % 50 + 1).alias("rank"))
    hits = _hits(spark, sf).select("query_id", "channel", "file_path", "rank").unionByName(gold).withColumn("key", F.concat("file_path", F.lit("#000000")))
    return evaluate.sweep_channels(hits, _cases(spark, sf), (5, 20, 40, 80), WEIGHTS).select(F.col("width").cast("long").alias("width"), "recall_40", "mrr_10", F.col("forbidden_40").cast("long").alias("forbidden_40"), "passes", "chosen")


@query
def coverage_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "plain")
    return evaluate.coverage_compare(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0"))


@query
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.coverage_counts(coverage_compare(spark, sf))


# Upkeep


@query
def reconcile_fast(spark: SparkSession, sf: str) -> DataFrame:
    return sync.reconcile(view(spark, sf, "plain"), view(spark, sf, "state"), "fast")


@query
def reconcile_strict(spark: SparkSession, sf: str) -> DataFrame:
    return sync.reconcile(view(spark, sf, "plain"), view(spark, sf, "state"), "strict")


@query
def apply_stat_updates(spark: SparkSession, sf: str) -> DataFrame:
    notes, state = view(spark, sf, "plain"), view(spark, sf, "state")
    rows = sync.apply_stat_updates(state, notes, sync.reconcile(notes, state, "strict"))
    return rows.select("file_path", "file_hash", F.col("file_size").cast("long").alias("file_size"), F.col("modified_ns").cast("long").alias("modified_ns"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.renames(view(spark, sf, "file_events")).select("path", "op")


@query
def rename_events(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.renames(view(spark, sf, "file_events")).select("event_id", "path", "op")


@query
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    return sync.route_paths(_requests(spark, sf), view(spark, sf, "plain"), INCLUDE, EXCLUDE)


def _edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes before and after an edit, and the routed changes: some texts lengthened, some notes gone."""
    old = view(spark, sf, "plain").select("doc_id", "file_path", "text", "file_size", "modified_ns")
    new = old.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" and an added sentence at the end."))).otherwise(F.col("text")))
    touched = old.where("doc_id % 9 = 0 OR doc_id % 4 = 0").select(F.col("file_path").alias("path"), F.lit("changed").alias("op"))
    return old, new, sync.route_paths(touched, new, CONFIG.include, CONFIG.exclude)


@query
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new, routed = _edited(spark, sf)
    before = build.note_tables(old, CONFIG)
    after = sync.apply_changes(before, routed, new, lambda n: build.note_tables(n, CONFIG))
    return sync.change_summary(routed, before["chunks"], after["chunks"])


@query
def incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """Of each table the rows after a sync, and how many of them a rebuild lacks or has besides: none. Of blocks the postings."""
    old, new, routed = _edited(spark, sf)
    made = lambda n: build.build_index(n, CONFIG)
    after, full, scratch, out = sync.apply_changes(made(old), routed, new, made), made(new), Scratch(spark, "sides"), None
    for name in sorted(full):
        one, other = (scratch.cut(_of_chunks(name, side[name]).drop("part"), f"{name}-{kind}") for kind, side in (("after", after), ("full", full)))
        key = next(c for c in ("file_path", "key", "term", "channel") if c in one.columns)
        differ = sync.differences_by_digest(one, other, key).agg(F.count("*").alias("n_different"))
        part = scratch.read(f"{name}-after").agg(F.count("*").alias("n_rows")).join(F.broadcast(differ)).select(F.lit(name).alias("table_name"), "n_rows", "n_different")  # single rows
        out = part if out is None else out.unionByName(part)
    return out


@query
def digest_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Notes before and after an edit, found by digests of ranges of paths: rows that are gone and rows that are new; some stand twice."""
    old = view(spark, sf, "plain").select("file_path", "text", "lang", "modified_ns")
    some = F.col("modified_ns") % 17000 == 0
    new = old.where("modified_ns % 23000 <> 0").withColumn("text", F.when(some, F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("modified_ns") % 19000 != 0, F.col("lang")))
    rows = sync.differences_by_digest(new.unionByName(old.where("modified_ns % 29000 = 0")), old)
    return rows.select("file_path", text.content_hash(F.col("text")).alias("text_hash"), "lang", "side")


@query
def order_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the lower kind, 95th percentile, first and last of all lines' prices, without sorting them in one task."""
    places = {"lower_median": lambda n: F.floor((n - 1) / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "least": lambda n: F.lit(0), "most": lambda n: n - 1}
    return evaluate.order_statistics(table(spark, sf, "lineitem"), "l_extendedprice", places)


@query
def encoder_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the nearest files of a rough encoder are those of a fine one, for each query."""
    asked, own = _sides(spark, sf)
    rough = lambda df: df.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 1).cast("float")))
    name = F.concat(F.lit("v/"), (F.col("key") % 500).cast("string"), F.lit(".md")).alias("file_path")
    one, other = (vectors.nearest(a, b, 20, exclude_self=True).select("query_id", name, "rank") for a, b in ((asked, own), (rough(asked), rough(own))))
    return vectors.file_overlap(one, other, 10).withColumn("overlap", F.round("overlap", 6))


@query
def upsert_state(spark: SparkSession, sf: str) -> DataFrame:
    state = view(spark, sf, "state").select("file_path", "file_hash", F.col("modified_ns").cast("long").alias("modified_ns"))
    fresh = view(spark, sf, "plain").where("doc_id % 3 = 0").select("file_path", F.lit("fresh").alias("file_hash"), F.when(F.col("doc_id") % 2 == 0, F.col("modified_ns") - 5).otherwise(F.col("modified_ns")).cast("long").alias("modified_ns"))
    return sync.upsert(state, fresh, "modified_ns")


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.renames(view(spark, sf, "file_events")).select(F.col("path").alias("file_path"), "op", F.col("ts").alias("queued_at"))


@query
def pending_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sync.pending_batches(_pending(spark, sf), view(spark, sf, "plain"), INCLUDE, EXCLUDE, 40)


@query
def recovery_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sync.recovery_plan(_pending(spark, sf))


@query
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return index.index_counts(chunks, build.file_state(view(spark, sf, "plain"), chunks))


@query
def integrity_problems(spark: SparkSession, sf: str) -> DataFrame:
    """An index in which fields, states, vectors and counts of some notes are lacking or wrong."""
    docs = view(spark, sf, "plain")
    chunks = _chunks(spark, sf)
    more = F.when(F.col("modified_ns") % 7000 == 0, F.col("chunk_count") + 1).otherwise(F.col("chunk_count"))
    state = build.file_state(docs, chunks).where("modified_ns % 5000 <> 0").withColumn("chunk_count", more)
    zero = F.lit(0.0)
    made = chunks.where("chunk_index % 4 <> 3").select("file_path", "chunk_index", F.when(F.col("chunk_index") % 5 == 0, F.array(zero, zero)).otherwise(F.array(zero)).alias("embedding"))
    return index.integrity_problems(chunks, docs.where("doc_id % 6 <> 0").select("file_path"), state, made, 1)


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("index_id"), "source", "lang", "doc_id")
    wanted = docs.select("index_id", F.explode(F.create_map(F.lit("engine"), F.col("lang"), F.lit("chunk_chars"), F.lit("400"), F.lit("scope_config_hash"), F.col("source"))))
    found = docs.select("index_id", F.explode(F.create_map(F.lit("engine"), F.lit("en"), F.lit("chunk_chars"), F.when(F.col("doc_id") % 6 == 0, "300").otherwise("400"), F.lit("scope_config_hash"), F.lit("src1"))))
    return found, wanted


@query
def manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    return index.manifest_problems(*_manifests(spark, sf))


@query
def recovery_action(spark: SparkSession, sf: str) -> DataFrame:
    found, wanted = _manifests(spark, sf)
    return index.recovery_action(wanted, index.manifest_problems(found, wanted, check_scope=False))


@query
def build_index(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table of an index of the notes."""
    tables = build.build_index(view(spark, sf, "notes"), Config(chunker="markdown-v2"))
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def _own_channels(name: str, df: DataFrame) -> DataFrame:
    """Of lexical tables what is about chunks."""
    return df.where("channel <> 'file'") if name in ("postings", "terms", "stats") else df


def _of_chunks(name: str, df: DataFrame) -> DataFrame:
    """Of lexical tables what is about chunks; of blocks the postings."""
    own = _own_channels(name, df)
    return inverted.postings(own, "channel") if name == "postings" else own


def _counted(name: str, df: DataFrame) -> DataFrame:
    """n_rows, of blocks the number of their postings, which they know."""
    rows = F.count("*") if name != "postings" else F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n").cast("long"))), F.lit(0))
    return _own_channels(name, df).agg(rows.alias("n_rows"))


@query
def build_index_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the plain documents, in chunks of paragraphs, read back from the generation that was written."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    sources.write_index(build.build_index(view(spark, sf, "plain"), CONFIG), root, "g1")
    tables = sources.read_index(spark, root, *sources.generations(spark, root))
    out = None
    for name, df in sorted(tables.items()):
        part = _counted(name, df).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


# Conversations


@query
def history_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "sessions")
    folder = F.when(F.col("conv_id") % 4 == 0, "../x").when(F.col("conv_id") % 4 == 1, "/A//b/").otherwise("C\\d")
    return rows.select("conv_id", history.history_title(F.col("title")).alias("title"), history.history_file_name(F.col("title"), F.col("created")).alias("file_name"), history.normalize_folder(folder).alias("folder"))


@query
def upsert_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "sessions")
    twice = rows.withColumn("saved_at", F.lit(1)).unionByName(rows.where("conv_id % 2 = 0").withColumn("saved_at", F.lit(2)))
    return history.upsert_sessions(twice).select("file_name", "conv_id", F.col("saved_at").cast("long").alias("saved_at"))


@query
def list_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.list_history(view(spark, sf, "sessions"), table(spark, sf, "conversations")).select("conv_id", "n_messages")


@query
def prune_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "sessions").withColumn("file_name", history.history_file_name(F.col("title"), F.col("created")))
    return history.prune_history(rows, 10).select("folder", "file_name")


@query
def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.recent_window(table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), 3)
    return rows.select("conv_id", "turn", F.array_join(F.transform("context", lambda m: m["role"]), ",").alias("roles"), F.aggregate("context", F.lit(0), lambda a, m: a + F.length(m["content"])).cast("long").alias("n_chars"))


@query
def plan_note_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "sessions")
    name = F.concat(F.lit("Plan "), (F.col("conv_id") % 6).cast("string"))
    drafts = rows.select(F.col("conv_id").alias("draft_id"), name.alias("title"), F.col("title").alias("text"), F.lit("2026-01-01").alias("created"))
    taken = rows.where("conv_id % 10 < 3").select(F.concat(F.lit("Notes/"), name, F.when(F.col("conv_id") % 10 == 0, "").otherwise(F.concat(F.lit(" "), (F.col("conv_id") % 40).cast("string"))), F.lit(".md")).alias("path"))
    return history.plan_note_paths(drafts, taken).select("draft_id", "path", "status")


@query
def history_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as notes and read again: 0 differences for each."""
    turns = table(spark, sf, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    rows = turns.select("conv_id", F.lit("t: \"x\"").alias("title"), F.lit("2026-01-01T00:00:00Z").alias("created"), *[F.lit(c).alias(c) for c in ("provider", "model", "effort")], F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    rows = rows.withColumn("citations", F.array(F.struct(F.lit("S1").alias("id"), F.lit("a b.md").alias("file_path"), F.lit(3).alias("start_line"), F.array(F.lit("h")).alias("heading_path"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))))
    back = history.parse_history_notes(history.write_history_notes(rows)).select("conv_id", F.col("messages").alias("back"), F.col("title").alias("t"))
    return rows.join(back, "conv_id", "left").select("conv_id", F.size("messages").cast("long").alias("n_messages"), (F.to_json("messages").eqNullSafe(F.to_json("back")) & F.col("title").eqNullSafe(F.col("t"))).alias("same"))


@query
def render_digest(spark: SparkSession, sf: str) -> DataFrame:
    results = _direct(spark, sf).join(view(spark, sf, "plain").select("file_path", "text", "lang"), "file_path").select("query_id", "rank", "file_path", F.array("lang").alias("heading_path"), F.col("text").alias("content"))
    rows = sources.render_digest(view(spark, sf, "queries"), results.where("rank <= 5"), "2026-01-01")
    return rows.select("query_id", F.length("digest").cast("long").alias("n_chars"), text.content_hash(F.col("digest")).alias("digest_hash"))


# Streams


@query
def coalesce_events(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.coalesce_events(view(spark, sf, "file_events")).select("path", "op")


@query
def debounce_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = streaming.debounced(view(spark, sf, "file_events"), "30 minutes")
    return rows.groupBy("path").agg(F.count("*").alias("bursts"), F.sum("n").alias("events"), F.max("n").alias("largest"))


@query
def debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same bursts from a stream of the events that is stopped after two of its four files and goes on from its checkpoint; an event a year on closes the last ones."""
    folder = f"{shared_folder(spark)}/bursts-{uuid.uuid4().hex}"
    parts = _event_parts(spark, sf)
    end = parts.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(4).alias("part"))
    for which in ((0, 1), (2, 3, 4)):
        _add_parts(parts.select(*end.columns).unionByName(end), folder, *which)
        out = bursts.debounced_stream(_event_stream(spark, folder), "30 minutes", "1 minute").writeStream.format("parquet").option("path", f"{folder}/bursts")
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(bursts.OUT).parquet(f"{folder}/bursts").where("NOT late")
    return rows.groupBy("path").agg(F.count("*").alias("bursts"), F.sum("n").alias("events"), F.max("n").alias("largest"))


@query
def watch_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written as files and watched as a stream: all at first, then what an edit changed, added and took away."""
    folder = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    docs = view(spark, sf, "plain").select("doc_id", "file_path", "text", "modified_ns")
    edited = docs.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" and more"))).withColumn("modified_ns", F.col("modified_ns") + 1000000)
    added = docs.where("doc_id % 9 = 0").withColumn("file_path", F.concat(F.lit("added/"), "doc_id", F.lit(".md")))
    seen: list[int] = []

    def apply(batch: DataFrame, batch_id: int) -> None:
        seen.append(batch_id)
        batch.withColumn("look", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")

    steps = ((docs, "false"), (edited.unionByName(added), "doc_id % 7 = 0 AND doc_id % 4 <> 0"))
    for written, gone in steps:
        watch.write_notes(written, f"{folder}/notes")
        watch.delete_notes(docs.where(gone), f"{folder}/notes")
        streaming.stream_sync(watch.watched(spark, f"{folder}/notes", f"{folder}/snapshots", 2), apply, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(*[f"{folder}/seen/batch={k}" for k in seen]).select("look", "path", "op")


@query
def flush_batches(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.flush_batches(streaming.coalesce_events(view(spark, sf, "file_events")), 50).select("path", "op", F.col("batch_no").cast("long").alias("batch_no"))


def _event_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The events in four parts in order of time."""
    return Scratch(spark, "events").cut(table(spark, sf, "events").repartitionByRange(4, "ts").withColumn("part", F.spark_partition_id()), "parts")


def _add_parts(parts: DataFrame, folder: str, *which: int) -> None:
    """Parts as files of a stream, which takes them in the order in which they were written."""
    for k in which:
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/events")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The files written so far as a stream, one a micro-batch."""
    schema = spark.read.parquet(f"{folder}/events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    typed = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("modify")
    old = F.concat(F.lit("notes/s"), (F.col("user_id") % 20).cast("string"), F.lit("/doc_"), F.col("user_id").cast("string"), F.lit(".md"))
    return typed.select("event_id", "ts", F.when(kind == "rename", F.concat(F.lit("renamed/doc_"), F.col("user_id").cast("string"), F.lit(".md"))).otherwise(old).alias("file_path"), old.alias("old_path"), kind.alias("op"))


@query
def stream_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, applied to a table of paths in micro-batches; the same as coalescing the whole table."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    _add_parts(_event_parts(spark, sf), folder, 0, 1, 2, 3)
    streaming.stream_sync(_event_stream(spark, folder), apply, f"{folder}/checkpoint").awaitTermination()
    applied = spark.read.parquet(f"{folder}/state")
    return applied.groupBy("path").agg(F.max_by("op", F.struct("ts", "batch_id")).alias("op"))


@query
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same stream applied to an index, one batch of each four being refused once: what is left of the notes, and their chunks."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    notes = lambda: view(spark, sf, "plain").select("file_path", "text", "file_size", "modified_ns")
    turns = iter(range(1000))
    keeper = streaming.IndexSync(spark, f"{folder}/index", notes, lambda n: build.note_tables(n, CONFIG), CONFIG, 50, 1 << 30, lambda f: f.where(F.pmod("batch_no", F.lit(4)) == next(turns) % 4))
    keeper.start()
    _add_parts(_event_parts(spark, sf), folder, 0, 1, 2, 3)
    streaming.stream_sync(_event_stream(spark, folder), keeper.apply, f"{folder}/checkpoint").awaitTermination()
    last = max(int(g) for g in sources.generations(spark, keeper.root))
    keeper.rejected = None
    keeper.apply(streaming.coalesce_events(view(spark, sf, "file_events").where("false")), last + 1)  # what was put back
    tables = keeper.tables()
    counts = tables["chunks"].groupBy("file_path").agg(F.count("*").alias("n_chunks"))
    return tables["file_state"].join(counts, "file_path", "left").select("file_path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
