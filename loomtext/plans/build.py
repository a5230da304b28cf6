"""Building an index, and building parts of it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.config import Config
from loomtext.functions.scope import in_scope
from loomtext.functions.text import Analyzer, chunk_key, content_hash, heading_tokens, tokenize
from loomtext.operators import chunking, frontmatter, index, inverted, lexical, vectors
from loomtext.operators.inverted import averaged
from loomtext.sources.notes import by_path
from loomtext.sources.scratch import Scratch


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", chunk_key(F.col("file_path"), F.col("chunk_index")))


def body_rows(chunks: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    return lexical.rows_of(_keyed(chunks), "key", tokenize(F.col("content"), analyzer))


def heading_rows(chunks: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    return lexical.rows_of(_keyed(chunks), "key", heading_tokens(F.col("heading_path"), analyzer))


def file_state(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, file_hash, chunk_count, file_size, modified_ns."""
    counts = chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
    rows = notes.select("file_path", content_hash(F.col("text")).alias("file_hash"), "file_size", "modified_ns").join(counts, "file_path", "left")
    return rows.select("file_path", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "file_size", "modified_ns")


def note_tables(notes: DataFrame, config: Config, encoder: vectors.EncoderFactory | None = None, analyzer: Analyzer | None = None) -> dict[str, DataFrame]:
    """chunks, file_fields, file_state and vectors of the notes in scope: what a note gives depends on that note alone.

    Chunks, in order of path, and fields are written once to the shared folder, as other tables read them.
    """
    inside = notes.where(in_scope(F.col("file_path"), config.include, config.exclude))
    scratch = Scratch(notes.sparkSession, "notes")
    chunks = scratch.cut(by_path(chunking.chunk(inside, config.chunker, config.chunk_chars, config.overlap_chars)), "chunks")
    encoder = encoder or vectors.hash_encoder(config.vector_dim)
    return {
        "chunks": chunks,
        "file_fields": scratch.cut(frontmatter.file_fields(inside, analyzer=analyzer), "fields"),
        "file_state": file_state(inside, chunks),
        "vectors": vectors.embed_chunks(chunks, encoder, config.passage_prefix),
    }


def derived_tables(chunks: DataFrame, fields: DataFrame, analyzer: Analyzer | None = None) -> dict[str, DataFrame]:
    """postings in blocks, terms and stats of the body, heading and file rows, with their channel. Each channel's blocks are written once to the shared folder."""
    scratch, out = Scratch(chunks.sparkSession, "derived"), {}
    for name, rows in (("body", body_rows(chunks, analyzer)), ("heading", heading_rows(chunks, analyzer)), ("file", lexical.file_rows(fields))):
        found = scratch.cut(inverted.bucketed(inverted.blocks(rows)), name)
        heads = scratch.read(name).where("term IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "n_rows"), ("total", "total_terms"))])
        channel = F.lit(name).alias("channel")
        own = {"postings": found.select(*[c for c in found.columns if c != "bucket"], channel, "bucket"), "terms": inverted.vocabulary(scratch.read(name)).select("*", channel), "stats": averaged(heads.select("*", channel))}
        out = {table: out[table].unionByName(df) if out else df for table, df in own.items()}
    return out


def build_index(notes: DataFrame, config: Config, index_id: str = "index", encoder: vectors.EncoderFactory | None = None, analyzer: Analyzer | None = None, model: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables of an index of notes(file_path, text, file_size, modified_ns). model says what the encoder is, for the manifest."""
    tables = note_tables(notes, config, encoder, analyzer)
    counts = index.index_counts(tables["chunks"], tables["file_state"])
    return tables | derived_tables(tables["chunks"], tables["file_fields"], analyzer) | {"manifest": index.build_manifest(notes.sparkSession, index_id, config, counts, model)}


def rebuild_vectors(tables: dict[str, DataFrame], config: Config, problems: DataFrame, encoder: vectors.EncoderFactory | None = None) -> dict[str, DataFrame]:
    """The index with vectors encoded again from its stored texts; refused if a problem is about its structure."""
    levels = index.recovery_action(problems.select("index_id").distinct(), problems)
    if not levels.where("action = 'rebuild_all'").isEmpty():
        raise ValueError("the index has to be built again as a whole")
    return tables | {"vectors": vectors.embed_chunks(tables["chunks"], encoder or vectors.hash_encoder(config.vector_dim), config.passage_prefix)}


def rebuild_lexical(tables: dict[str, DataFrame], notes: DataFrame, analyzer: Analyzer | None = None) -> dict[str, DataFrame]:
    """The index with fields, postings and statistics derived again; chunks and vectors stay as they are."""
    kept = notes.join(tables["file_state"].select("file_path"), "file_path", "left_semi")
    fields = Scratch(notes.sparkSession, "lexical").cut(frontmatter.file_fields(kept, analyzer=analyzer), "fields")
    return tables | derived_tables(tables["chunks"], fields, analyzer) | {"file_fields": fields}
