"""The driver tables as notes, queries, cases, states and hits: portable SQL, the same text for Spark and for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = "CASE WHEN doc_id % 10 = 0 THEN concat('5_Wiki/issues/topic_', CAST(doc_id AS STRING), '.md') ELSE concat('notes/s', CAST(doc_id % 20 AS STRING), '/doc_', CAST(doc_id AS STRING), '.md') END"

VIEWS = {
    "plain": f"SELECT doc_id, {PATH} AS file_path, text, source, lang, length(text) AS file_size, doc_id * 1000 AS modified_ns FROM documents",
    "notes": f"""
SELECT doc_id, {PATH} AS file_path,
  concat('---', chr(10), 'aliases: [', source, '-', CAST(doc_id AS STRING), ']', chr(10), 'tags: [', lang, ', ', source, ']', chr(10), 'owner:', chr(10), '  team: ', source, chr(10),
    CASE WHEN doc_id % 10 = 0 THEN concat('sources: [notes/s', CAST((doc_id+1) % 20 AS STRING), '/doc_', CAST(doc_id+1 AS STRING), '.md, notes/s', CAST((doc_id+2) % 20 AS STRING), '/doc_', CAST(doc_id+2 AS STRING), '.md]', chr(10)) ELSE '' END,
    '---', chr(10), '# ', source, chr(10), chr(10), '## ', lang, ' #', source, chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10)))) AS text,
  length(text) AS file_size, doc_id * 1000 AS modified_ns, source, lang
FROM documents""",
    "queries": "SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'timeline' ELSE 'topic' END AS intent, 40 AS top_k FROM benchmark",
    "file_queries": "SELECT doc_id AS query_id, concat(source, ' ', lang, ' doc ', CAST(doc_id AS STRING)) AS query FROM documents WHERE doc_id % 20 = 0",
    # hits of four channels: a few documents for each benchmark item, in an order of their own for each channel
    "hits": f"""
SELECT query_id, channel, file_path, row_number() OVER (PARTITION BY query_id, channel ORDER BY (doc_id * step) % 1009, doc_id) AS rank
FROM (SELECT b.item_id AS query_id, doc_id, {PATH} AS file_path FROM documents d JOIN benchmark b ON d.doc_id % 97 = (b.item_id * 17) % 97) x
CROSS JOIN (SELECT 'body' AS channel, 7 AS step UNION ALL SELECT 'heading', 11 UNION ALL SELECT 'file', 13 UNION ALL SELECT 'vector', 17) c
WHERE (doc_id + step) % 3 <> 0""",
    "gold": f"SELECT b.item_id AS query_id, d.doc_id, {PATH} AS file_path FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    # what was indexed before: some notes lacking, some with another hash or time, some gone since
    "state": f"""
SELECT file_path, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE sha2(text, 256) END AS file_hash, CAST(1 AS INT) AS chunk_count, file_size, CASE WHEN doc_id % 13 = 0 THEN modified_ns - 1 ELSE modified_ns END AS modified_ns
FROM (SELECT doc_id, {PATH} AS file_path, text, length(text) AS file_size, doc_id * 1000 AS modified_ns FROM documents) p WHERE doc_id % 7 <> 0
UNION ALL SELECT concat('gone_', CAST(doc_id AS STRING), '.md'), 'none', CAST(1 AS INT), length(text), doc_id * 1000 FROM documents WHERE doc_id % 17 = 0""",
    "file_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_type = 'purchase' THEN concat('renamed/doc_', CAST(user_id AS STRING), '.md') ELSE concat('notes/s', CAST(user_id % 20 AS STRING), '/doc_', CAST(user_id AS STRING), '.md') END AS file_path,
  concat('notes/s', CAST(user_id % 20 AS STRING), '/doc_', CAST(user_id AS STRING), '.md') AS old_path,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS op FROM events""",
    "sessions": "SELECT conv_id, text AS title, CAST('2026-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(conv_id % 5000 AS INT) AS created, concat('F', CAST(conv_id % 3 AS STRING)) AS folder FROM conversations WHERE turn = 0",
    # answers that cite sources, known and unknown ones
    "answers": "SELECT conv_id AS query_id, concat(text, ' [S', CAST(conv_id % 5 + 1 AS STRING), '] and [S', CAST(conv_id % 7 + 1 AS STRING), '], again [S', CAST(conv_id % 5 + 1 AS STRING), '].') AS answer FROM conversations WHERE turn = 1",
    "answer_sources": f"""
SELECT x.conv_id AS query_id, CAST(doc_id % 4 + 1 AS INT) AS source_no, concat('S', CAST(doc_id % 4 + 1 AS STRING)) AS source_id, file_path, text AS content, CAST(1 AS INT) AS start_line, CAST(doc_id % 4 + 1 AS INT) AS rank, CAST(1.0 / (doc_id % 4 + 1) AS DOUBLE) AS score
FROM (SELECT doc_id, floor(doc_id / 4) AS block, {PATH} AS file_path, text FROM documents) d JOIN (SELECT DISTINCT conv_id FROM conversations) x ON d.block = x.conv_id""",
    "turns": "SELECT conv_id * 1000 + turn AS turn_id, concat('TOOL: search(query=\"', replace(replace(text, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), '\")', CASE WHEN turn % 2 = 1 THEN 'TOOL: read(file=\"notes/a.md\", part=\"2\")' ELSE '' END, ' ', role) AS text FROM conversations",
}
TABLES = ("documents", "benchmark", "events", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are bound to this query alone."""
    if name == "gold":
        return _gold(view(spark, sf_dir, "plain"), table(spark, sf_dir, "benchmark"))
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql}
    for t in used:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(sql, **used)


def _gold(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The view gold without comparing all documents with all passages: a passage's longest word that is not at its ends is a whole word of any text
    that holds it, so pairs meet by that word. Passages of less than three words, few by nature, are looked for in every text."""
    words = F.split("text", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = passages.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), longest.alias("anchor"))
    near = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("anchor")).join(asked.where("anchor IS NOT NULL"), "anchor").select("doc_id", "query_id", "passage")
    found = docs.join(near, "doc_id").unionByName(docs.join(asked.where("anchor IS NULL").select("query_id", "passage"), F.col("text").contains(F.col("passage"))))
    return found.where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id", "file_path")


def cte(*names: str) -> str:
    """The views as the head of a DuckDB query."""
    duck = {n: VIEWS[n].replace("sha2(text, 256)", "sha256(text)").replace("AS STRING", "AS VARCHAR").replace("floor(doc_id / 4)", "doc_id // 4") for n in names}
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in duck.items())
