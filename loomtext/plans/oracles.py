"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from loomtext.config import Config
from loomtext.operators.index import described
from loomtext.plans.views import cte

ORACLES: dict[str, str] = {}


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t)), lambda t: length(t) > 1)"


def terms(x: str) -> str:
    return f"list_filter(flatten(list_transform({tokens(x)}, lambda t: string_split(t, '_'))), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


STEM = "regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')"
FOLDER = "regexp_replace(regexp_extract(file_path, '^(.*/)?'), '/$', '')"


def chunks_of(rel: str, name: str = "chunks") -> str:
    """The chunks of a relation with file_path, text, source and lang, each text being one paragraph."""
    return f""", {name}_bare AS (SELECT *, {strip("text")} AS t FROM {rel}),
{name}_cut AS (SELECT file_path, source, lang, t, length(t) AS n, unnest(range(CASE WHEN length(t) <= 400 THEN 1 ELSE CAST(ceil((length(t) - 60) / 340.0) AS BIGINT) END)) AS i FROM {name}_bare WHERE length(t) >= 10),
{name}_parts AS (SELECT file_path, source, lang, i, CASE WHEN n <= 400 THEN t ELSE {strip("substr(t, i * 340 + 1, 400)")} END AS content FROM {name}_cut),
{name} AS (SELECT file_path, source, lang, content, row_number() OVER (PARTITION BY file_path ORDER BY i) - 1 AS chunk_index FROM {name}_parts WHERE length(content) >= 10)"""


CHUNKS = cte("plain") + chunks_of("plain") + ", keyed AS (SELECT *, concat(file_path, '#', lpad(CAST(chunk_index AS VARCHAR), 6, '0')) AS key FROM chunks)"
BODY = f", rows AS (SELECT key, {terms('content')} AS terms FROM keyed)"


def view_only(name: str) -> str:
    """A view without the word WITH, to follow other ones."""
    return ", " + cte(name).removeprefix("WITH ")


def bm25(queries: str, mode: str = "any") -> str:
    """The end of a query over rows(key, terms) and queries(query_id, query)."""
    unit = f"SELECT query_id, len(u) AS n_units, unnest(u) AS parts, generate_subscripts(u, 1) AS unit FROM (SELECT query_id, {'[' + terms('query') + ']' if mode == 'phrase' else 'list_transform(' + terms('query') + ', lambda t: [t])'} AS u FROM {queries})"
    return f""", units AS ({unit}),
stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS average FROM rows),
found AS (SELECT query_id, unit, n_units, key, len(terms) AS d, len(list_filter(range(1, len(terms) + 1), lambda i: terms[i:i + len(parts) - 1] = parts)) AS f
  FROM units JOIN rows ON list_contains(terms, parts[1])),
hit AS (SELECT * FROM found WHERE f > 0),
df AS (SELECT query_id, unit, count(*) AS df FROM hit GROUP BY ALL),
part AS (SELECT h.*, greatest(ln((n - df + 0.5) / (df + 0.5)), CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE 0 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average)) AS s FROM hit h JOIN df USING (query_id, unit), stats),
scored AS (SELECT query_id, key, sum(s) AS score FROM part GROUP BY query_id, key {"HAVING count(DISTINCT unit) = max(n_units)" if mode == "all" else ""}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM scored)
SELECT query_id, key, round(score, 6) AS score, rank FROM ranked WHERE rank <= 80"""


ODD = "concat('\\a//', CASE WHEN doc_id % 5 = 0 THEN '../' ELSE './' END, file_path, '/')"
ORACLES["normalize_paths"] = cte("plain") + " SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN concat('a/', file_path) END AS path, file_path AS coverage_path FROM plain"
SCOPE = "(file_path LIKE 'notes/%' OR file_path LIKE '5\\_Wiki/%' ESCAPE '\\') AND NOT file_path LIKE 'notes/s3/%' AND NOT regexp_matches(file_path, '^(.*/)?doc\\_1.\\.md$')".replace("\\_1", "_1")
ORACLES["scope_filter"] = cte("plain") + f" SELECT file_path FROM plain WHERE {SCOPE}"
ORACLES["preview_scope"] = cte("plain") + f", s AS (SELECT file_path FROM plain WHERE {SCOPE}) SELECT file_path, (SELECT count(*) FROM s) AS n_files FROM s ORDER BY file_path LIMIT 30"
ORACLES["strip_frontmatter"] = cte("notes") + ", b AS (SELECT file_path, substr(text, strpos(text, concat(chr(10), '---', chr(10))) + 5) AS b FROM notes), c AS (SELECT file_path, regexp_replace(b, '^\\n*', '') AS b FROM b) SELECT file_path, length(b) AS n_chars, sha256(b) AS body_hash FROM b".replace(", c AS (SELECT file_path, regexp_replace(b, '^\\n*', '') AS b FROM b)", "")
ORACLES["chunk_paragraphs"] = CHUNKS + " SELECT file_path, chunk_index, length(content) AS n_chars, sha256(content) AS content_hash FROM chunks"
EMBEDDED = f"concat({STEM}, ' > ', source, ' > ', lang, chr(10), chr(10), content)"
ORACLES["embedding_text"] = CHUNKS + f" SELECT file_path, chunk_index, length({EMBEDDED}) AS n_chars, sha256({EMBEDDED}) AS text_hash FROM chunks"
ORACLES["tokenize"] = f"SELECT doc_id, len({tokens('text')}) AS n_tokens, sha256(array_to_string({tokens('text')}, ' ')) AS tokens_hash FROM documents"
ORACLES["path_fields"] = cte("plain") + f" SELECT file_path, array_to_string({tokens(f'translate({STEM}, {chr(39)}_-{chr(39)}, {chr(39)}  {chr(39)})')}, ' ') AS basename, array_to_string({tokens(f'translate({FOLDER}, {chr(39)}/_-{chr(39)}, {chr(39)}   {chr(39)})')}, ' ') AS directory, array_to_string({tokens('concat(source, chr(32), lang)')}, ' ') AS headings FROM plain"
SOURCES = "CASE WHEN doc_id % 10 = 0 THEN concat('notes/s', (doc_id + 1) % 20, '/doc_', doc_id + 1, '.md notes/s', (doc_id + 2) % 20, '/doc_', doc_id + 2, '.md') ELSE '' END"
ORACLES["frontmatter_fields"] = cte("notes") + f" SELECT file_path, concat(source, '-', doc_id) AS aliases, concat('aliases ', source, '-', doc_id, ' tags ', lang, ' ', source, ' owner team ', source, CASE WHEN doc_id % 10 = 0 THEN concat(' sources ', {SOURCES}) ELSE '' END) AS properties, {SOURCES} AS sources, false AS bad FROM notes"
EDGES = "e AS (SELECT a.file_path AS wiki_path, b.file_path AS source_path, b.doc_id FROM plain a JOIN plain b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2) WHERE a.doc_id % 10 = 0), edges AS (SELECT wiki_path, row_number() OVER (PARTITION BY wiki_path ORDER BY doc_id) - 1 AS pos, source_path FROM e)"
ORACLES["source_edges"] = cte("plain") + f", {EDGES} SELECT * FROM edges"
ORACLES["content_hash"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"
ORACLES["postings"] = CHUNKS + BODY + ", posted AS (SELECT term, key, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM rows) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM posted GROUP BY term"
ORACLES["corpus_stats"] = CHUNKS + BODY + " SELECT count(*) AS n_rows, CAST(sum(len(terms)) AS BIGINT) AS total_terms, round(sum(len(terms)) / count(*), 6) AS avg_terms FROM rows"
for name, mode in (("bm25_body", "any"), ("bm25_match_all", "all"), ("bm25_match_phrase", "phrase")):
    ORACLES[name] = CHUNKS + view_only("queries") + BODY + bm25("queries", mode)
ORACLES["bm25_headings"] = CHUNKS + view_only("file_queries") + f", rows AS (SELECT key, {terms('concat(source, chr(32), lang)')} AS terms FROM keyed)" + bm25("file_queries")
ORACLES["hash_vectors"] = """
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(concat('passage: ', text)), '\\s+'), lambda x: x <> '')) AS token FROM documents),
b AS (SELECT doc_id, CAST(concat('0x', substr(sha256(token), 3, 2), substr(sha256(token), 1, 2)) AS INT) % 16 AS bucket, count(*) AS n FROM t GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY doc_id)
SELECT d.doc_id, string_agg(CAST(CAST(round(CAST(CAST(coalesce(n / norm, 0) AS FLOAT) AS DOUBLE) * 1e4) AS BIGINT) AS VARCHAR), ',' ORDER BY g.i) AS vector
FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS i) g LEFT JOIN b ON b.doc_id = d.doc_id AND b.bucket = g.i LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLES["vector_topk"] = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS key, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM s) SELECT query_id, key, round(score, 6) AS score, rank FROM r WHERE rank <= 80"""
ORACLES["vector_topk_cells"] = ORACLES["vector_topk"]
ORACLES["vector_topk_uneven"] = """
WITH o AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST(embedding[1:32] AS DOUBLE[]) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 <> 0 AND vec_id % 13 <> 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS key, list_cosine_similarity(q.v, x.v) AS score FROM o q JOIN o x ON len(q.v) = len(x.v) AND x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM s) SELECT query_id, key, round(score, 6) AS score, rank FROM r WHERE rank <= 80"""
ORACLES["embedding_parity"] = "WITH c AS (SELECT list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2))) AS c FROM embeddings) SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine FROM c"

# Fusion
PLACES = ", places AS (SELECT file_path, concat(file_path, '#00000', i) AS key, i AS chunk_index FROM plain, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 11 <> 0)"
FUSED = """, part AS (SELECT query_id, channel, key, rank, CASE channel WHEN 'file' THEN 1.5 ELSE 1.0 END / (60 + rank) AS part FROM (SELECT query_id, channel, key, row_number() OVER (PARTITION BY query_id, channel ORDER BY min(rank), key) AS rank FROM given GROUP BY query_id, channel, key)),
sums AS (SELECT query_id, key, sum(part) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM part GROUP BY query_id, key),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM sums)"""
GIVEN = cte("hits", "plain") + ", given AS (SELECT query_id, channel, concat(file_path, '#000000') AS key, rank FROM hits)"
DIVERSE = """, own AS (SELECT f.*, p.file_path, row_number() OVER (PARTITION BY query_id, p.file_path ORDER BY rank) AS of_file FROM fused f JOIN places p USING (key)),
diverse AS (SELECT query_id, file_path, key, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM own WHERE of_file = 1)"""
ORACLES["weighted_rrf"] = GIVEN + FUSED + " SELECT query_id, key, round(score, 6) AS score, channels, rank FROM fused"
ORACLES["unique_files"] = cte("hits") + " SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file_path) AS rank FROM hits GROUP BY query_id, file_path"
ORACLES["select_diverse"] = cte("hits", "plain") + ", given AS (SELECT query_id, channel, concat(file_path, '#00000', i) AS key, rank + i AS rank FROM hits, (SELECT unnest([0, 1]) AS i))" + PLACES + FUSED + DIVERSE + " SELECT query_id, file_path, key, rank FROM diverse WHERE rank <= 10"
ORACLES["explain_results"] = GIVEN + FUSED + ", w AS (SELECT query_id, key, " + ", ".join(f"coalesce(max(rank) FILTER (channel = '{c}'), -1) AS {c}_rank" for c in ("body", "heading", "file", "vector")) + ", round(sum(round(part, 6)), 4) AS contributions FROM part GROUP BY query_id, key) SELECT query_id, key, replace(channels, 'file', 'file,title') AS channels, body_rank, heading_rank, file_rank, vector_rank, contributions FROM w JOIN fused USING (query_id, key)"
ORACLES["pool_diagnostics"] = GIVEN + view_only("queries") + FUSED + ", n AS (SELECT query_id, count(*) AS pool FROM fused GROUP BY query_id) SELECT query_id, coalesce(pool, 0) AS candidate_pool_size, 25 AS requested_top_k, least(coalesce(pool, 0), 20) AS returned_count, coalesce(pool, 0) < 25 AS pool_warning FROM queries LEFT JOIN n USING (query_id)"
ORACLES["file_to_chunk"] = cte("hits", "plain") + PLACES + """, seen AS (SELECT query_id, concat(file_path, '#000000') AS key, rank AS place FROM hits WHERE channel = 'body' AND rank <= 3 UNION ALL SELECT query_id, concat(file_path, '#000001'), 1e9 + rank FROM hits WHERE channel = 'heading' AND rank <= 5),
best AS (SELECT query_id, file_path, min_by(key, place) AS best FROM seen JOIN places USING (key) GROUP BY ALL),
firsts AS (SELECT file_path, min(key) AS first FROM places GROUP BY ALL)
SELECT h.query_id, file_path, coalesce(best, first) AS key, row_number() OVER (PARTITION BY h.query_id ORDER BY rank, file_path) AS rank FROM hits h JOIN firsts USING (file_path) LEFT JOIN best b USING (query_id, file_path) WHERE channel = 'file'"""
ORACLES["coalesce_hits"] = cte("hits", "plain") + PLACES + """, v AS (SELECT query_id, concat(file_path, '#00000', i) AS key, rank FROM hits, (SELECT unnest([0, 1]) AS i) WHERE channel = 'vector'),
m AS (SELECT v.query_id, coalesce(concat(f.file_path, '#000001'), v.key) AS key, v.rank FROM (SELECT v.*, file_path FROM v JOIN places USING (key)) v LEFT JOIN (SELECT * FROM hits WHERE channel = 'file') f ON f.query_id = v.query_id AND f.file_path = v.file_path)
SELECT query_id, CASE WHEN key = '#000001' THEN NULL ELSE key END AS key, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), key) AS rank FROM m GROUP BY query_id, key""".replace("coalesce(concat(f.file_path, '#000001'), v.key)", "CASE WHEN f.file_path IS NULL THEN v.key ELSE concat(f.file_path, '#000001') END").replace("CASE WHEN key = '#000001' THEN NULL ELSE key END AS key", "key")
DIRECT = GIVEN + view_only("queries") + PLACES + FUSED + DIVERSE + ", direct AS (SELECT query_id, file_path, rank, round(score, 6) AS score FROM diverse WHERE rank <= 40), n AS (SELECT query_id, count(*) AS direct FROM direct GROUP BY query_id), gated AS (SELECT query_id, top_k, coalesce(direct, 0) AS direct, coalesce(direct, 0) > 0 AND NOT (direct >= top_k AND top_k <= 30) AND intent = 'timeline' AS expand FROM queries LEFT JOIN n USING (query_id))"
ORACLES["expansion_gate"] = DIRECT + " SELECT query_id, direct, expand FROM gated"
ORACLES["expand_sources"] = DIRECT + f", {EDGES}" + """, head AS (SELECT d.* FROM direct d JOIN gated g USING (query_id) WHERE expand AND rank <= 30),
wiki AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM head WHERE starts_with(file_path, '5_Wiki/')),
linked AS (SELECT query_id, source_path, min(n * 100 + pos) AS at_, arg_min(w.file_path, n * 100 + pos) AS linked_from FROM wiki w JOIN edges ON wiki_path = w.file_path WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.query_id = w.query_id AND d.file_path = source_path) GROUP BY ALL),
five AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_) AS n FROM linked),
added AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM five WHERE n <= 5 AND source_path IN (SELECT file_path FROM places)),
ends AS (SELECT query_id, count(*) AS kept, min(score) AS least FROM head GROUP BY query_id),
k AS (SELECT query_id, count(*) AS n FROM added GROUP BY query_id),
merged AS (SELECT d.query_id, CASE WHEN rank > 30 THEN rank + coalesce(k.n, 0) ELSE rank END AS rank, file_path, score, false AS expanded, NULL AS linked_from, k.n FROM direct d LEFT JOIN k USING (query_id)
  UNION ALL SELECT query_id, kept + place, source_path, round(least - (kept + place) / 1e6, 6), true, linked_from, 1 FROM added JOIN ends USING (query_id))
SELECT query_id, rank, file_path, score, expanded, linked_from FROM merged JOIN queries USING (query_id) WHERE n IS NULL OR rank <= top_k"""

# Reading
ORACLES["grep_notes"] = cte("plain") + ", l AS (SELECT file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM plain WHERE file_path IN (SELECT file_path FROM plain WHERE file_path LIKE '%/%.md' ORDER BY file_path LIMIT 2000)), m AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS n FROM l WHERE contains(line, 'Licensed under')) SELECT file_path, line_no, substr(trim(line), 1, 300) AS line FROM m WHERE n <= 10 ORDER BY file_path, line_no LIMIT 100"
ORACLES["read_notes"] = cte("notes") + """, w AS (SELECT DISTINCT CASE WHEN modified_ns % 7000 = 0 THEN concat('../', file_path) WHEN modified_ns % 11000 = 0 THEN 'none.md' ELSE file_path END AS path FROM notes),
s AS (SELECT path, CASE WHEN path LIKE '../%' THEN 'invalid_path' WHEN path LIKE 'notes/s3/%' THEN 'excluded' WHEN path = 'none.md' THEN 'out_of_scope' ELSE 'ok' END AS status, source, substr(text, 1, 40000) AS c FROM w LEFT JOIN notes ON file_path = path)
SELECT path, status, CASE WHEN status = 'ok' THEN length(c) END AS n_chars, CASE WHEN status = 'ok' THEN source END AS heading FROM s"""

# Answers
CITED = """, c AS (SELECT query_id, [concat('S', query_id % 5 + 1), concat('S', query_id % 7 + 1)] AS ids, answer FROM answers),
known AS (SELECT query_id, list(DISTINCT source_id) AS known FROM answer_sources GROUP BY query_id),
u AS (SELECT query_id, answer, list_filter(CASE WHEN ids[1] = ids[2] THEN ids[1:1] ELSE ids END, lambda x: list_contains(coalesce(known, []), x)) AS used FROM c LEFT JOIN known USING (query_id)),
clean AS (SELECT query_id, used, """ + strip("regexp_replace(answer, CASE WHEN len(used) = 0 THEN '\\[S\\d+\\]' ELSE concat('\\[S(?:', array_to_string(list_filter(range(1, 10), lambda i: NOT list_contains(used, concat('S', i))), '|'), ')\\]') END, '', 'g')") + " AS answer FROM u)"
ORACLES["normalize_citations"] = cte("answers", "answer_sources") + CITED + " SELECT query_id, sha256(answer) AS answer_hash, array_to_string(used, ',') AS used, CASE WHEN len(used) = 0 THEN 'ANSWER_HAS_NO_VALID_CITATIONS' END AS warning FROM clean"
ORACLES["citations"] = cte("answers", "answer_sources") + CITED + ", x AS (SELECT query_id, unnest(used) AS source_id, generate_subscripts(used, 1) AS citation_no FROM u) SELECT query_id, citation_no, source_id, file_path FROM x JOIN answer_sources USING (query_id, source_id)"
ORACLES["answer_diagnostics"] = cte("answers", "answer_sources") + CITED + ", n AS (SELECT query_id, count(*) AS n FROM answer_sources GROUP BY query_id) SELECT query_id, CASE WHEN length(answer) = 0 THEN 'empty' WHEN length(answer) > 32000 THEN 'too_long' ELSE 'ok' END AS status, len(used) > 0 AS grounded, coalesce(n, 0) AS retrieved_count, length(answer) AS answer_chars, CASE WHEN len(used) = 0 THEN 'ANSWER_HAS_NO_VALID_CITATIONS' END AS citation_warning FROM clean LEFT JOIN n USING (query_id)"
ORACLES["extract_tool_calls"] = "SELECT conv_id * 1000 + turn AS turn_id, 1 AS call_no, 'search' AS name, length(text) + 6 AS n_chars, sha256(concat('query=', text)) AS args_hash FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 2, 'read', 22, sha256('file=notes/a.md;part=2') FROM conversations WHERE turn % 2 = 1"
ORACLES["prompt_rows"] = cte("answers", "answer_sources") + """, b AS (SELECT query_id, string_agg(concat('<source id="', source_id, '">', chr(10), 'path: ', file_path, chr(10), 'line: 1', chr(10), 'heading: (no heading)', chr(10), 'snippet:', chr(10), content, chr(10), '</source>'), concat(chr(10), chr(10)) ORDER BY source_no) AS b FROM answer_sources GROUP BY query_id),
p AS (SELECT query_id, concat('질문:', chr(10), answer, chr(10), chr(10), '볼트 근거:', chr(10), coalesce(b, '')) AS p FROM answers LEFT JOIN b USING (query_id)) SELECT query_id, length(p) AS n_chars, sha256(p) AS prompt_hash FROM p"""
ORACLES["validate_requests"] = """
WITH f AS (SELECT conv_id, text, conv_id % 15 AS k, conv_id % 5 * 9000 AS c FROM conversations WHERE turn = 0),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS request_id, 'query: empty' AS problem FROM f WHERE trim(text) = '' UNION SELECT conv_id, 'query: too long' FROM f WHERE length(text) > 8000
UNION SELECT conv_id, 'top_k: out of range' FROM f WHERE k NOT BETWEEN 1 AND 12 UNION SELECT conv_id, 'max_context_chars: out of range' FROM f WHERE c NOT BETWEEN 8000 AND 32000
UNION SELECT conv_id, 'messages: unknown role' FROM t WHERE role NOT IN ('user', 'assistant') UNION SELECT conv_id, 'messages: roles do not alternate' FROM t WHERE CASE WHEN n = 1 THEN role <> 'user' ELSE role = before END
UNION SELECT conv_id, 'messages: too long' FROM t WHERE length(text) > 8000 UNION SELECT conv_id, 'messages: too many' FROM m WHERE n > 8 UNION SELECT conv_id, 'messages: incomplete turn' FROM m WHERE n % 2 = 1"""

# Evaluation
RANKED = ", r0 AS (SELECT query_id, file_path, rank AS place FROM hits WHERE channel = 'body' AND rank <= 2 UNION ALL SELECT query_id, file_path, 100 + doc_id FROM gold), ranked AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM r0)"


def metrics(kept: str = "true", name: str = "metrics") -> str:
    return f""", {name}_r AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked WHERE {kept}),
{name}_e AS (SELECT DISTINCT query_id, file_path FROM gold), {name}_f AS (SELECT query_id, min_by(file_path, rank) AS bad FROM hits WHERE channel = 'body' GROUP BY query_id),
{name} AS (SELECT query_id, concat('case-', query_id) AS case_id, (SELECT count(*) FROM {name}_e e WHERE e.query_id = q.query_id) AS wanted,
  (SELECT count(DISTINCT r.file_path) FROM {name}_r r JOIN {name}_e e USING (query_id, file_path) WHERE r.query_id = q.query_id AND rank <= 20) AS got_20,
  (SELECT count(DISTINCT r.file_path) FROM {name}_r r JOIN {name}_e e USING (query_id, file_path) WHERE r.query_id = q.query_id AND rank <= 40) AS got_40,
  coalesce((SELECT 1.0 / min(rank) FROM {name}_r r JOIN {name}_e e USING (query_id, file_path) WHERE r.query_id = q.query_id AND rank <= 10), 0) AS mrr_10,
  (SELECT count(*) FROM {name}_r r JOIN {name}_f f ON f.query_id = r.query_id AND f.bad = r.file_path WHERE r.query_id = q.query_id AND rank <= 20) AS forbidden_20,
  (SELECT count(*) FROM {name}_r r JOIN {name}_f f ON f.query_id = r.query_id AND f.bad = r.file_path WHERE r.query_id = q.query_id AND rank <= 40) AS forbidden_40,
  (SELECT count(DISTINCT file_path) FROM {name}_r r WHERE r.query_id = q.query_id AND rank <= 20) AS unique_paths_20, query_id * 7 % 50 + 10.0 AS latency_ms FROM queries q)"""


EVAL = cte("queries", "gold", "hits") + RANKED
ORACLES["case_metrics"] = EVAL + metrics() + " SELECT case_id, wanted > 0 AS has_expected, round(CASE WHEN wanted > 0 THEN got_20 / wanted ELSE 0 END, 6) AS recall_20, round(CASE WHEN wanted > 0 THEN got_40 / wanted ELSE 0 END, 6) AS recall_40, round(mrr_10, 6) AS mrr_10, got_40 > 0 AS success, wanted > 0 AND got_40 = wanted AS complete, forbidden_20, forbidden_40, unique_paths_20 FROM metrics"


def overall(name: str) -> str:
    return f"SELECT count(*) AS cases, count(*) FILTER (wanted > 0) AS cases_with_expected, round(avg(got_20 / wanted) FILTER (wanted > 0), 6) AS recall_20, round(avg(got_40 / wanted) FILTER (wanted > 0), 6) AS recall_40, round(avg(mrr_10) FILTER (wanted > 0), 6) AS mrr_10, round(avg(CASE WHEN got_40 > 0 THEN 1.0 ELSE 0.0 END) FILTER (wanted > 0), 6) AS success, round(avg(CASE WHEN got_40 = wanted THEN 1.0 ELSE 0.0 END) FILTER (wanted > 0), 6) AS complete, round(avg(unique_paths_20), 6) AS unique_paths_20, CAST(sum(forbidden_20) AS BIGINT) AS forbidden_20, CAST(sum(forbidden_40) AS BIGINT) AS forbidden_40, round(CAST(median(latency_ms) AS DOUBLE), 3) AS p50_ms, round(CAST(list_sort(list(latency_ms))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS DOUBLE), 3) AS p95_ms FROM {name}"


ORACLES["aggregate_metrics"] = EVAL + metrics() + " " + overall("metrics")
ORACLES["baseline_gate"] = EVAL + metrics() + metrics("rank <> 3", "worse") + f", b AS ({overall('metrics')}), n AS ({overall('worse')}) SELECT 'recall@40 dropped' AS failure FROM n, b WHERE n.recall_40 < b.recall_40 UNION ALL SELECT 'forbidden@20 rose' FROM n, b WHERE n.forbidden_20 > b.forbidden_20 UNION ALL SELECT 'forbidden@40 rose' FROM n, b WHERE n.forbidden_40 > b.forbidden_40 UNION ALL SELECT 'p95 above 1.25 times the baseline' FROM n, b WHERE n.p95_ms * 2 > 1.25 * b.p95_ms UNION ALL SELECT concat('complete case lost: ', m.case_id) FROM metrics m JOIN worse w USING (query_id) WHERE m.wanted > 0 AND m.got_40 = m.wanted AND w.got_40 < w.wanted"
ORACLES["validate_queries"] = "SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'query: blank' WHEN item_id % 3 = 0 THEN 'match_mode: unknown' WHEN item_id % 4 = 0 THEN 'intent: unknown' END AS reason FROM benchmark"
ORACLES["validate_cases"] = cte("queries", "gold", "hits") + " SELECT concat('case-', query_id) AS case_id, 'vault: missing' AS problem FROM queries WHERE query_id % 9 = 0 UNION ALL SELECT concat('case-', query_id), 'top_k: out of range' FROM queries WHERE query_id * 10 NOT BETWEEN 1 AND 200 UNION ALL SELECT concat('case-', query_id), 'paths: all lists are empty' FROM queries WHERE query_id NOT IN (SELECT query_id FROM gold) AND query_id NOT IN (SELECT query_id FROM hits WHERE channel = 'body')"
COVER = cte("plain") + ", c AS (SELECT file_path, doc_id % 2 = 0 AS in_a, doc_id % 3 = 0 AS in_b, doc_id % 5 = 0 AS in_c FROM plain WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0)"
ORACLES["coverage_compare"] = COVER + " SELECT * FROM c"
ORACLES["coverage_counts"] = COVER + " SELECT count(*) AS in_any, count(*) FILTER (in_a AND in_b AND in_c) AS in_all, count(*) FILTER (in_a AND NOT in_b AND NOT in_c) AS only_a, count(*) FILTER (in_b AND NOT in_a AND NOT in_c) AS only_b, count(*) FILTER (in_c AND NOT in_a AND NOT in_b) AS only_c FROM c"

# Upkeep


def changes(mode: str) -> str:
    fast = "WHEN n.file_size = s.file_size AND n.modified_ns = s.modified_ns THEN 'unchanged'" if mode == "fast" else ""
    return f"SELECT coalesce(n.file_path, s.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'deleted' WHEN s.file_path IS NULL THEN 'new' {fast} WHEN s.file_hash <> sha256(n.text) THEN 'changed' WHEN n.file_size = s.file_size AND n.modified_ns = s.modified_ns THEN 'unchanged' ELSE 'stat_only' END AS change FROM plain n FULL JOIN state s ON n.file_path = s.file_path"


for mode in ("fast", "strict"):
    ORACLES[f"reconcile_{mode}"] = cte("plain", "state") + " " + changes(mode)
ORACLES["apply_stat_updates"] = cte("plain", "state") + f", c AS ({changes('strict')}) SELECT s.file_path, s.file_hash, CASE WHEN change = 'stat_only' THEN n.file_size ELSE s.file_size END AS file_size, CASE WHEN change = 'stat_only' THEN n.modified_ns ELSE s.modified_ns END AS modified_ns FROM state s LEFT JOIN c USING (file_path) LEFT JOIN plain n USING (file_path)"
SINGLE = ", single AS (SELECT event_id, ts, old_path AS path, 'deleted' AS op FROM file_events WHERE op = 'rename' UNION ALL SELECT event_id, ts, file_path, CASE WHEN op = 'delete' THEN 'deleted' ELSE 'changed' END FROM file_events)"
ORACLES["rename_events"] = cte("file_events") + SINGLE + " SELECT event_id, path, op FROM single"
ORACLES["route_paths"] = cte("file_events", "plain") + SINGLE + f", p AS (SELECT file_path, {SCOPE} AS inside FROM plain) SELECT path AS file_path, CASE WHEN bool_or(op = 'deleted' OR p.file_path IS NULL OR NOT inside) THEN 'deleted' ELSE 'changed' END AS op FROM single LEFT JOIN p ON p.file_path = path GROUP BY path"
ORACLES["pending_batches"] = cte("file_events", "plain") + SINGLE + f", p AS (SELECT file_path FROM plain WHERE {SCOPE}), l AS (SELECT path, max(ts) AS ts FROM single GROUP BY path) SELECT path AS file_path, CASE WHEN p.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS operation, (row_number() OVER (ORDER BY ts, path) - 1) // 40 AS batch_no FROM l LEFT JOIN p ON p.file_path = path"
ORACLES["recovery_plan"] = cte("file_events") + SINGLE + " SELECT count(DISTINCT path) AS n_pending, CASE WHEN count(DISTINCT path) > 1000 THEN 'strict_reconcile' ELSE 'drain' END AS plan FROM single"
ORACLES["upsert_state"] = cte("plain", "state") + " SELECT coalesce(s.file_path, f.file_path) AS file_path, CASE WHEN s.file_path IS NULL OR f.ns >= s.modified_ns THEN 'fresh' ELSE s.file_hash END AS file_hash, CASE WHEN s.file_path IS NULL OR f.ns >= s.modified_ns THEN f.ns ELSE s.modified_ns END AS modified_ns FROM state s FULL JOIN (SELECT file_path, CASE WHEN doc_id % 2 = 0 THEN modified_ns - 5 ELSE modified_ns END AS ns FROM plain WHERE doc_id % 3 = 0) f ON f.file_path = s.file_path"
ORACLES["index_counts"] = CHUNKS + " SELECT (SELECT count(*) FROM plain) AS files, count(*) AS chunks, count(*) AS vector_chunks FROM chunks"
WANTED = "(SELECT doc_id, 'engine' AS key, lang AS wanted, 'en' AS found FROM documents UNION ALL SELECT doc_id, 'chunk_chars', '400', CASE WHEN doc_id % 6 = 0 THEN '300' ELSE '400' END FROM documents UNION ALL SELECT doc_id, 'scope_config_hash', source, 'src1' FROM documents)"
ORACLES["manifest_problems"] = f"SELECT CAST(doc_id AS VARCHAR) AS index_id, key, concat(key, ': expected ', wanted, ', found ', found) AS problem FROM {WANTED} WHERE wanted <> found"
ORACLES["recovery_action"] = "SELECT CAST(doc_id AS VARCHAR) AS index_id, CASE WHEN doc_id % 6 = 0 THEN 'rebuild_all' WHEN lang <> 'en' THEN 'rebuild_vectors' ELSE 'none' END AS action FROM documents"
EDITED = cte("plain") + ", edited AS (SELECT doc_id, file_path, source, lang, CASE WHEN doc_id % 4 = 0 THEN concat(text, ' and an added sentence at the end.') ELSE text END AS text FROM plain WHERE doc_id % 9 <> 0)" + chunks_of("plain", "old") + chunks_of("edited", "new")
ORACLES["apply_changes"] = EDITED + """ SELECT (SELECT count(*) FROM plain WHERE doc_id % 4 = 0 AND doc_id % 9 <> 0) AS changed, (SELECT count(*) FROM plain WHERE doc_id % 9 = 0) AS deleted,
(SELECT count(*) FROM old JOIN plain USING (file_path) WHERE doc_id % 4 = 0 OR doc_id % 9 = 0) AS removed_chunks, (SELECT count(*) FROM new JOIN edited USING (file_path) WHERE doc_id % 4 = 0) AS added_chunks"""
ORACLES["incremental_equals_full"] = EDITED + f""", posted AS (SELECT DISTINCT file_path, chunk_index, unnest({terms("content")}) AS term FROM new)
SELECT table_name, CAST(CASE WHEN table_name IN ('chunks', 'vectors') THEN (SELECT count(*) FROM new) WHEN table_name = 'postings' THEN (SELECT count(*) FROM posted) WHEN table_name = 'terms' THEN (SELECT count(DISTINCT term) FROM posted)
WHEN table_name = 'stats' THEN 2 WHEN table_name = 'manifest' THEN {len(described(Config())) + 3} ELSE (SELECT count(*) FROM edited) END AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different
FROM (SELECT unnest(['chunks', 'file_fields', 'file_state', 'manifest', 'postings', 'stats', 'terms', 'vectors']) AS table_name)"""
ORACLES["build_index_paragraphs"] = CHUNKS + BODY + f""", posted AS (SELECT DISTINCT key, unnest(terms) AS term FROM rows)
SELECT table_name, CASE table_name WHEN 'manifest' THEN {len(described(Config())) + 3} WHEN 'terms' THEN (SELECT count(DISTINCT term) FROM posted) WHEN 'stats' THEN 2 WHEN 'postings' THEN (SELECT count(*) FROM posted) WHEN 'file_fields' THEN (SELECT count(*) FROM plain) WHEN 'file_state' THEN (SELECT count(*) FROM plain) ELSE (SELECT count(*) FROM chunks) END AS n_rows
FROM (SELECT unnest(['chunks', 'file_fields', 'file_state', 'manifest', 'postings', 'stats', 'terms', 'vectors']) AS table_name)"""
ORACLES["integrity_problems"] = CHUNKS + """, found AS (SELECT 'fields: missing' AS kind FROM plain WHERE doc_id % 5 <> 0 AND doc_id % 6 = 0 UNION ALL SELECT 'fields: orphan' FROM plain WHERE doc_id % 5 = 0 AND doc_id % 6 <> 0
UNION ALL SELECT 'vectors: missing' FROM chunks WHERE chunk_index % 4 = 3 UNION ALL SELECT 'state: chunk_count' FROM plain WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT 'vectors: dim' FROM chunks WHERE chunk_index % 4 <> 3 AND chunk_index % 5 = 0)
SELECT kind, count(*) AS n FROM found GROUP BY kind"""

# Conversations
TITLE = "substr(trim(regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')[1:10], ' '), '[\\\\/:*?\"<>|#^\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 60)"
NAMED = f", named AS (SELECT *, CASE WHEN {TITLE} = '' THEN '대화' ELSE {TITLE} END AS safe FROM sessions), filed AS (SELECT *, concat(safe, '@', strftime(created, '%Y-%m-%d_%H-%M-%S'), '-000.md') AS file_name FROM named)"
ORACLES["history_titles"] = cte("sessions") + NAMED + " SELECT conv_id, safe AS title, file_name, CASE conv_id % 4 WHEN 0 THEN 'AI-Chats' WHEN 1 THEN 'A/b' ELSE 'C/d' END AS folder FROM filed"
ORACLES["upsert_sessions"] = cte("sessions") + NAMED + " SELECT file_name, conv_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS saved_at FROM filed"
ORACLES["list_history"] = cte("sessions") + " SELECT s.conv_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = s.conv_id) AS n_messages FROM sessions s"
ORACLES["prune_history"] = cte("sessions") + NAMED + ", n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY created DESC, file_name DESC) AS n FROM filed) SELECT folder, file_name FROM n WHERE n > 10"
ORACLES["recent_window"] = "SELECT conv_id, turn, coalesce(roles, '') AS roles, coalesce(n_chars, 0) AS n_chars FROM (SELECT conv_id, turn, role, array_to_string(list(role) OVER w, ',') AS roles, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE role = 'user'"
ORACLES["history_round_trip"] = "SELECT conv_id, count(*) AS n_messages, true AS same FROM conversations WHERE role <> 'system' GROUP BY conv_id"

# Streams
LAST = ", last AS (SELECT path, arg_max(op, (ts, event_id, op)) AS op FROM single WHERE lower(path) LIKE '%.md' GROUP BY path)"
for name in ("coalesce_events", "stream_sync"):
    ORACLES[name] = cte("file_events") + SINGLE + LAST + " SELECT path, op FROM last"
ORACLES["debounce_events"] = ORACLES["debounce_stream"] = cte("file_events") + SINGLE + ", g AS (SELECT path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM single), s AS (SELECT path, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), b AS (SELECT path, s, count(*) AS n FROM s GROUP BY ALL) SELECT path, count(*) AS bursts, CAST(sum(n) AS BIGINT) AS events, max(n) AS largest FROM b GROUP BY path"
ORACLES["watch_notes"] = cte("plain") + """ SELECT CAST(0 AS BIGINT) AS look, file_path AS path, 'changed' AS op FROM plain UNION ALL SELECT 1, file_path, 'changed' FROM plain WHERE doc_id % 4 = 0
UNION ALL SELECT 1, concat('added/', doc_id, '.md'), 'changed' FROM plain WHERE doc_id % 9 = 0 UNION ALL SELECT 1, file_path, 'deleted' FROM plain WHERE doc_id % 7 = 0 AND doc_id % 4 <> 0"""
ORACLES["flush_batches"] = cte("file_events") + SINGLE + LAST + " SELECT path, op, (row_number() OVER (ORDER BY op, substr(sha256(path), 1, 2), path) - 1) // 50 AS batch_no FROM last"
ORACLES["stream_index"] = cte("plain", "file_events") + chunks_of("plain") + SINGLE + LAST + ", n AS (SELECT file_path, count(*) AS n FROM chunks GROUP BY file_path) SELECT file_path, coalesce(n, 0) AS n_chunks FROM plain LEFT JOIN n USING (file_path) WHERE file_path NOT IN (SELECT path FROM last WHERE op = 'deleted')"

# Fields of files
TAGS = "list_concat([lang, source], regexp_extract_all(concat(chr(10), '## ', lang, ' #', source, chr(10), replace(t, chr(10), concat(chr(10), chr(10)))), '(?:^|[^\\p{L}\\p{N}_/])#([^\\s#]+)', 1))"
ORDERED = "list_filter(tags, lambda x, i: list_position(list_transform(tags, lambda y: lower(y)), lower(x)) = i)"
FIELDS = cte("notes") + f""", tagged AS (SELECT n.doc_id, n.file_path, n.source, n.lang, {TAGS} AS tags FROM notes n JOIN (SELECT doc_id AS d, text AS t FROM documents) ON d = n.doc_id),
fields AS (SELECT file_path, {tokens(f"translate({STEM}, '_-', '  ')")} AS basename_tokens, {tokens(f"translate({FOLDER}, '/_-', '   ')")} AS directory_tokens, {tokens("concat(source, '-', doc_id)")} AS alias_tokens, {tokens(f"array_to_string({ORDERED}, ' ')")} AS tag_tokens,
  {tokens(f"concat('aliases ', source, '-', doc_id, ' tags ', lang, ' ', source, ' owner team ', source, CASE WHEN doc_id % 10 = 0 THEN concat(' sources ', {SOURCES}) ELSE '' END)")} AS property_tokens FROM tagged)"""
ORACLES["file_fields"] = FIELDS + " SELECT file_path, " + ", ".join(f"array_to_string({c}_tokens, ' ') AS {c}_tokens" for c in ("basename", "directory", "alias", "tag", "property")) + " FROM fields"
CUT = "list_filter(flatten(list_transform({}_tokens, lambda t: string_split(t, '_'))), lambda t: t <> '')"
SCORE = "greatest(ln((n - df + 0.5) / (df + 0.5)), CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE 0 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average))"
BEST = " , ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM scored) SELECT query_id, key, round(score, 6) AS score, rank FROM ranked WHERE rank <= 80"
ORACLES["bm25_files"] = FIELDS + view_only("file_queries") + ", occ AS (" + " UNION ALL ".join(f"SELECT file_path AS key, unnest({CUT.format(c)}) AS term, {w} AS w FROM fields" for c, w in (("basename", 10), ("directory", 7), ("alias", 8), ("tag", 3), ("property", 2))) + f"""),
tf AS (SELECT key, term, sum(w) AS f FROM occ GROUP BY ALL), lengths AS (SELECT key, count(*) AS d FROM occ GROUP BY key), stats AS (SELECT (SELECT count(*) FROM fields) AS n, (SELECT count(*) FROM occ) / (SELECT count(*) FROM fields) AS average),
units AS (SELECT query_id, unnest({terms("query")}) AS term FROM file_queries), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, key, sum({SCORE}) AS score FROM units JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (key), stats GROUP BY query_id, key)""" + BEST
ORACLES["bm25_prefix_fallback"] = CHUNKS + view_only("queries") + f""", rows AS (SELECT key, {terms("concat(source, ' ', lang)")} AS terms FROM keyed), stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS average FROM rows),
hit AS (SELECT key, len(terms) AS d, len(list_filter(terms, lambda t: starts_with(t, 'sr'))) AS f FROM rows), df AS (SELECT count(*) AS df FROM hit WHERE f > 0),
scored AS (SELECT query_id, key, {SCORE} AS score FROM queries, hit, df, stats WHERE f > 0)""" + BEST

# Evidence, step by step
ORACLES["grounding_sources"] = cte("answer_sources").replace("WITH ", "WITH RECURSIVE ", 1) + f""", shown AS (SELECT query_id, rank, regexp_replace(file_path, '\\d+\\.md', 'x.md') AS file_path, substr({strip("content")}, 1, 3000) AS content FROM answer_sources WHERE {strip("content")} <> ''),
listed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM shown),
fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, 0 AS k, CAST([] AS VARCHAR[]) AS files, 0 AS size, false AS stopped, false AS taken, CAST(NULL AS VARCHAR) AS file_path, 0 AS n_chars, 0 AS rank FROM listed
  UNION ALL SELECT query_id, n, k + CAST(takes AS INT), CASE WHEN takes THEN list_append(files, path) ELSE files END, CASE WHEN takes THEN start + least(chars, room) ELSE size END, stopped OR (NOT skip AND room <= 0), takes, path, CAST(least(chars, room) AS INT), r
  FROM (SELECT *, NOT skip AND room > 0 AS takes FROM (SELECT *, stopped OR len(list_filter(files, lambda x: x = path)) >= 2 AS skip, 6000 - start AS room FROM (
    SELECT f.query_id, l.n, f.k, f.files, f.size, f.stopped, l.file_path AS path, l.rank AS r, CAST(length(l.content) AS INT) AS chars,
      CAST(f.size + CASE WHEN f.size > 0 THEN 2 ELSE 0 END + length(concat('<source id="S', f.k + 1, '">', chr(10), 'path: ', l.file_path, chr(10), 'line: 1', chr(10), 'heading: h', chr(10), 'snippet:', chr(10), chr(10), '</source>')) AS INT) AS start
    FROM fold f JOIN listed l ON l.query_id = f.query_id AND l.n = f.n + 1))))
SELECT query_id, k AS source_no, concat('S', k) AS source_id, file_path, n_chars, rank FROM fold WHERE taken"""
ORACLES["evidence_budget"] = cte("answer_sources").replace("WITH ", "WITH RECURSIVE ", 1) + """, listed AS (SELECT query_id, source_no AS item_no, CASE WHEN source_no % 2 = 0 THEN 'read' ELSE 'search' END AS kind, CAST(least(length(content), CASE WHEN source_no % 2 = 0 THEN 40000 ELSE 3000 END) AS INT) AS chars, row_number() OVER (PARTITION BY query_id ORDER BY source_no) AS n FROM answer_sources),
fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, 0 AS size, false AS taken, 0 AS item_no, '' AS kind, 0 AS n_chars FROM listed
  UNION ALL SELECT f.query_id, l.n, CASE WHEN f.size + l.chars <= 5000 THEN f.size + l.chars ELSE f.size END, f.size + l.chars <= 5000, l.item_no, l.kind, l.chars FROM fold f JOIN listed l ON l.query_id = f.query_id AND l.n = f.n + 1)
SELECT query_id, item_no, kind, n_chars FROM fold WHERE taken"""


def swept(width: int) -> str:
    given = "given AS (SELECT query_id, channel, concat(file_path, '#000000') AS key, rank FROM (SELECT query_id, channel, file_path, rank FROM hits UNION ALL SELECT query_id, 'vector', file_path, doc_id * 7 % 50 + 1 FROM gold) WHERE rank <= " + f"{width})"
    ranking = ", ranked AS (SELECT query_id, replace(key, '#000000', '') AS file_path, rank FROM fused WHERE rank <= 200)"
    return f"(WITH {given}{FUSED}{ranking}{metrics()} SELECT {width} AS width, round(avg(got_40 / wanted) FILTER (wanted > 0), 6) AS recall_40, round(avg(mrr_10) FILTER (wanted > 0), 6) AS mrr_10, CAST(sum(forbidden_40) AS BIGINT) AS forbidden_40 FROM metrics)"


ORACLES["sweep_widths"] = cte("queries", "gold", "hits") + ", sweep AS (" + " UNION ALL ".join(f"SELECT * FROM {swept(w)}" for w in (5, 20, 40, 80)) + "), judged AS (SELECT *, recall_40 >= (SELECT max(recall_40) FROM sweep) AND forbidden_40 <= (SELECT min(forbidden_40) FROM sweep) AS passes FROM sweep) SELECT *, coalesce(width = (SELECT min(width) FROM judged WHERE passes), NULL) AS chosen FROM judged"
FREE = ", drafts AS (SELECT conv_id, conv_id % 6 AS k, row_number() OVER (PARTITION BY conv_id % 6 ORDER BY conv_id) AS n FROM sessions), taken AS (SELECT DISTINCT conv_id % 6 AS k, CASE WHEN conv_id % 10 = 0 THEN 0 ELSE conv_id % 40 END AS no FROM sessions WHERE conv_id % 10 < 3), free AS (SELECT k, no, row_number() OVER (PARTITION BY k ORDER BY no) AS n FROM (SELECT unnest(range(6)) AS k) CROSS JOIN (SELECT unnest(range(1001)) AS no) ANTI JOIN taken USING (k, no))"
ORACLES["plan_note_paths"] = cte("sessions") + FREE + " SELECT conv_id AS draft_id, CASE WHEN no IS NOT NULL THEN concat('Notes/Plan ', k, CASE WHEN no = 0 THEN '' ELSE concat(' ', no) END, '.md') END AS path, CASE WHEN no IS NULL THEN 'no_free_path' ELSE 'ok' END AS status FROM drafts LEFT JOIN free USING (k, n)"


def collapsed(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


ORACLES["render_digest"] = DIRECT + f""", lines AS (SELECT query_id, rank, concat('- [[', regexp_replace(file_path, '\\.md$', ''), '#', lang, '|', {STEM}, ' › ', lang, ']]', chr(10), '  ', CASE WHEN length(t) > 240 THEN concat(substr(t, 1, 240), '…') ELSE t END) AS line FROM (SELECT d.query_id, d.rank, p.file_path, p.lang, {collapsed("p.text")} AS t FROM direct d JOIN plain p USING (file_path) WHERE rank <= 5)),
listing AS (SELECT query_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS body FROM lines GROUP BY query_id),
digests AS (SELECT query_id, concat('# ', {collapsed("query")}, chr(10), chr(10), '2026-01-01 · ', coalesce(n, 0), ' results', chr(10), chr(10), coalesce(body, 'No results.')) AS d FROM queries LEFT JOIN listing USING (query_id))
SELECT query_id, length(d) AS n_chars, sha256(d) AS digest_hash FROM digests"""


def near_files(entry: str) -> str:
    """The files of the first 10 hits among the nearest by entries of a kind."""
    rows = f"SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST({entry} AS DOUBLE)) AS v FROM embeddings"
    scores = f"SELECT q.vec_id AS query_id, k.vec_id AS key, round(list_cosine_similarity(q.v, k.v), 12) AS s FROM ({rows}) q JOIN ({rows}) k ON q.vec_id % 20 = 0 AND q.vec_id <> k.vec_id"
    return f"SELECT DISTINCT query_id, key % 500 AS file FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM ({scores})) WHERE rank <= 10"


ORACLES["encoder_overlap"] = f"WITH a AS ({near_files('x')}), b AS ({near_files('CAST(round(x, 1) AS FLOAT)')}) SELECT query_id, round(count(b.file) / count(*), 6) AS overlap FROM a LEFT JOIN b USING (query_id, file) GROUP BY query_id"
ORACLES["digest_differences"] = cte("plain") + """, o AS (SELECT file_path, text, lang, modified_ns FROM plain),
n AS (SELECT file_path, CASE WHEN modified_ns % 17000 = 0 THEN concat(text, '.') ELSE text END AS text, CASE WHEN modified_ns % 19000 <> 0 THEN lang END AS lang, modified_ns FROM o WHERE modified_ns % 23000 <> 0 UNION ALL SELECT * FROM o WHERE modified_ns % 29000 = 0)
SELECT file_path, sha256(text) AS text_hash, lang, 'missing' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT file_path, sha256(text), lang, 'extra' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)"""
ORACLES["order_statistics"] = "WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS place, count(*) OVER () AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) SELECT max(v) FILTER (place = (n - 1) // 2) AS lower_median, max(v) FILTER (place = floor((n - 1) * 0.95)) AS p95, min(v) AS least, max(v) AS most FROM s"
