"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import audit, bpe, chat, licenses, mixing, neighbours, packing, quality, simhash, sketch, spans, urls, whitening
from loomtext.llm.shared import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.vocabulary())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report="spans")
    return found.select("doc_id", "text", F.col("spans.removed").alias("span_removed"), F.col("spans.words").alias("span_words_removed"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.tiktoken"))


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_edited(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("\\### Assistant: </turn> ok"))
    return chat.read_back(chat.format_conversations(turns.union(trial)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", simhash.hexed(found["fp"]).alias("fingerprint"), "component_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.Index(vectors).search(vectors.where("vec_id % 20 = 0"), k=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), labels=table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality_verdict.*")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.Whitener(table(spark, sf_dir, "embeddings"), k=32).whitened()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_pack_tokens": op5_pack_tokens,
    "op6_scaled_sketch": op6_scaled_sketch,
    "op7_chat_format": op7_chat_format,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms(terms: tuple[str, ...]) -> str:
    """SQL for the number of different terms in u that stand between signs."""
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS INT)" for t in terms)


def _rules() -> str:
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    return "\n".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{h}{p}'" for _, h, p in ordered)


_VERDICTS = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)

ORACLES: dict[str, str] = {
    "op4_url_filter": f"""
WITH cut AS (
  SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE {_rules()} END AS rule FROM hosts),
termed AS (
  SELECT *, CASE WHEN {_terms(urls.STRICT)} > 0 OR {_terms(urls.SOFT)} >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS by_terms FROM ruled)
SELECT page_id, host, path, rule, CASE {_VERDICTS} ELSE by_terms END AS verdict, by_terms FROM termed
""",
    "op11_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
fails AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM words),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT filter_order, CAST(s.step AS INTEGER) AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1 : s.step - 1]), 0) AS before
  FROM orders CROSS JOIN range(1, 6) AS s(step)),
counted AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells CROSS JOIN (SELECT filter_order, step, CAST(bit AS INTEGER) AS bit, CAST(before AS INTEGER) AS before FROM steps) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
""",
}
