"""Evidence for answers: bounded sources, citations, tool calls, checks of requests.

The budgets are sequential, so a query's results (a few hundred at most) are folded in order by a higher-order function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a source, of the sources of a file, and of requests and answers.
SOURCE_CHARS, SOURCES_PER_FILE = 3000, 2
QUERY_CHARS, TOP_K, CONTEXT, MESSAGES, ANSWER_CHARS = 8000, (1, 12, 8), (8000, 32000, 24000), 8, 32000
#: Fewer characters than the markup of any source has.
LEAST_BLOCK = 40
EVIDENCE_CHARS, EVIDENCE_KINDS = 100_000, {"search": 3000, "read": 40_000, "grep": 300}
TOOL_CALLS = 6
NO_CITATION = "ANSWER_HAS_NO_VALID_CITATIONS"

SOURCE = "struct<source_id:string,file_path:string,start_line:int,heading_path:array<string>,content:string,rank:int,score:double>"


def _block(s: Column) -> Column:
    heading = F.array_join(s["heading_path"], " > ")
    return F.concat(
        F.lit('<source id="'), s["source_id"], F.lit('">\npath: '), s["file_path"], F.lit("\nline: "), s["start_line"].cast("string"),
        F.lit("\nheading: "), F.when(heading == "", "(no heading)").otherwise(heading), F.lit("\nsnippet:\n"), s["content"], F.lit("\n</source>"),
    )


def grounding_sources(results: DataFrame, max_chars: int = 24000) -> DataFrame:
    """query_id, source_no and the fields of each source that fits: at most two of a file, the last one cut to what is left.

    results: query_id, rank, score, file_path, content, start_line, heading_path.
    """
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    row = F.struct(
        F.coalesce("rank", F.lit(0)).alias("at"), (-F.coalesce("score", F.lit(0.0))).alias("down"),
        F.regexp_replace("file_path", r"\\", "/").alias("file_path"), F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1))).cast("int").alias("start_line"),
        F.filter(F.coalesce("heading_path", F.array().cast("array<string>")), lambda x: x != "").alias("heading_path"), F.substring(text, 1, SOURCE_CHARS).alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    usable = results.where((F.coalesce("file_path", F.lit("")) != "") & (F.coalesce(text, F.lit("")) != ""))
    usable = usable.select("query_id", row.alias("row"))
    # a third row of a file is never taken, and each source uses up some room, so what is left out here could not be taken
    of_file = Window.partitionBy("query_id", "row.file_path").orderBy("row")
    usable = usable.withColumn("of_file", F.row_number().over(of_file)).where(F.col("of_file") <= SOURCES_PER_FILE)
    best = Window.partitionBy("query_id").orderBy("row")
    usable = usable.withColumn("at", F.row_number().over(best)).where(F.col("at") <= max_chars // LEAST_BLOCK + 1)
    listed = usable.groupBy("query_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    start = F.struct(F.array().cast(f"array<{SOURCE}>").alias("taken"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def source(acc: Column, x: Column, content: Column) -> Column:
        n = F.size(acc["taken"]) + 1
        rank = F.when(x["at"] > 0, x["at"]).otherwise(n)
        return F.struct(F.concat(F.lit("S"), n.cast("string")).alias("source_id"), x["file_path"].alias("file_path"), x["start_line"].alias("start_line"), x["heading_path"].alias("heading_path"), content.alias("content"), rank.cast("int").alias("rank"), x["score"].alias("score"))

    def step(acc: Column, x: Column) -> Column:
        of_file = F.size(F.filter(acc["taken"], lambda s: s["file_path"] == x["file_path"]))
        before = acc["size"] + F.when(acc["size"] > 0, 2).otherwise(0)
        empty = F.length(_block(source(acc, x, F.lit(""))))
        room = F.lit(max_chars) - before - empty
        content = F.when(F.length(x["content"]) <= room, x["content"]).otherwise(x["content"].substr(F.lit(1), F.greatest(room, F.lit(0))))
        taken = F.struct(F.concat(acc["taken"], F.array(source(acc, x, content))).alias("taken"), (before + empty + F.length(content)).alias("size"), F.lit(False).alias("full"))
        stop = F.struct(acc["taken"].alias("taken"), acc["size"].alias("size"), F.lit(True).alias("full"))
        return F.when(acc["full"] | (of_file >= SOURCES_PER_FILE), acc).when(room <= 0, stop).otherwise(taken)

    folded = listed.select("query_id", F.aggregate("rows", start, step, lambda acc: acc["taken"]).alias("s"))
    return folded.select("query_id", F.posexplode("s").alias("at", "s")).select("query_id", (F.col("at") + 1).alias("source_no"), "s.*")


def source_block(sources: DataFrame) -> DataFrame:
    """sources with their rendered block."""
    return sources.withColumn("block", _block(F.struct("source_id", "file_path", "start_line", "heading_path", "content")))


def prompt_rows(queries: DataFrame, sources: DataFrame, question: str = "질문", evidence: str = "볼트 근거") -> DataFrame:
    """query_id, prompt: the question, and the blocks of its sources in order."""
    blocks = source_block(sources).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_no", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    rows = queries.join(blocks, "query_id", "left")
    return rows.select("query_id", F.concat(F.lit(f"{question}:\n"), "query", F.lit(f"\n\n{evidence}:\n"), F.coalesce(text, F.lit(""))).alias("prompt"))


def normalize_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, answer without unknown [S#], used (ids in order of first use), warning if none."""
    known = sources.groupBy("query_id").agg(F.collect_set("source_id").alias("known"))
    rows = answers.join(known, "query_id", "left")
    known_ids = F.coalesce("known", F.array().cast("array<string>"))
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(S\d+)\]"), 1), lambda x: x)
    unknown = F.array_except(cited, known_ids)
    text = F.aggregate(unknown, F.col("answer"), lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    used = F.array_intersect(F.array_distinct(cited), known_ids)
    return rows.select("query_id", text.alias("answer"), used.alias("used"), F.when(F.size(used) == 0, NO_CITATION).alias("warning"))


def citations(normalized: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, citation_no and the source of each citation used."""
    used = normalized.select("query_id", F.posexplode("used").alias("at", "source_id"))
    return used.join(sources, ["query_id", "source_id"]).select("query_id", (F.col("at") + 1).alias("citation_no"), "source_id", "file_path", "start_line", "heading_path", "rank", "score")


CALL = r"(?i)TOOL:\s*([a-z_]+)\s*\(((?:[^()]|\([^()]*\))*)\)"


def extract_tool_calls(turns: DataFrame, most: int = TOOL_CALLS) -> DataFrame:
    """turn_id, call_no, name, args (map): the calls of each turn's text, in a fence or one after another, up to most."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    inner = F.regexp_extract(text, r"(?s)\A```(?:[a-zA-Z]*)\s*\n?(.*?)```\s*\z", 1)
    body = F.when(text.rlike(r"(?s)\A```(?:[a-zA-Z]*)\s*\n?(.*?)```\s*\z"), inner).otherwise(text)
    calls = F.slice(F.arrays_zip(F.regexp_extract_all(body, F.lit(CALL), 1).alias("name"), F.regexp_extract_all(body, F.lit(CALL), 2).alias("args")), 1, most)
    rows = turns.select("turn_id", F.posexplode(calls).alias("at", "call"))
    pattern = r'(\w+)="((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all("call.args", F.lit(pattern), i) for i in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    # a key given twice keeps its last value
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(plain, i).alias("value"), i.alias("i"))), lambda e: ~F.exists(F.transform(keys, lambda k, j: F.struct(k.alias("k"), j.alias("j"))), lambda o: (o["k"] == e["key"]) & (o["j"] > e["i"])))
    args = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    return rows.select("turn_id", (F.col("at") + 1).alias("call_no"), F.lower("call.name").alias("name"), args.alias("args"))


def strip_tool_calls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CALL, ""), r"^\s+|\s+$", "")


def evidence_budget(items: DataFrame, max_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """query_id, item_no, kind, content of items(query_id, item_no, kind, content) that fit; one too long is skipped, not the end."""
    limit: Column = F.lit(EVIDENCE_KINDS["search"])
    for kind, n in EVIDENCE_KINDS.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    row = F.struct("item_no", "kind", F.expr("content").substr(F.lit(1), limit).alias("content"))
    listed = items.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.filter("rows", lambda x: F.lit(False)).alias("taken"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["size"] + F.length(x["content"])
        return F.when(size > min(EVIDENCE_CHARS, max_chars), acc).otherwise(F.struct(F.concat(acc["taken"], F.array(x)).alias("taken"), size.alias("size")))

    return listed.select("query_id", F.explode(F.aggregate("rows", start, step, lambda acc: acc["taken"])).alias("x")).select("query_id", "x.*")


def answer_diagnostics(normalized: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, status (ok, empty, too_long), grounded, retrieved_count, context_chars, answer_chars, citation_warning."""
    context = source_block(sources).groupBy("query_id").agg(F.count("*").alias("n"), (F.sum(F.length("block")) + 2 * (F.count("*") - 1)).alias("chars"))
    rows = normalized.join(context, "query_id", "left")
    n = F.length("answer")
    status = F.when(n == 0, "empty").when(n > ANSWER_CHARS, "too_long").otherwise("ok")
    return rows.select("query_id", status.alias("status"), (F.size("used") > 0).alias("grounded"), F.coalesce("n", F.lit(0)).alias("retrieved_count"), F.coalesce("chars", F.lit(0)).alias("context_chars"), n.alias("answer_chars"), F.col("warning").alias("citation_warning"))


def validate_requests(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """request_id, problem: a row for every broken rule.

    requests(request_id, query, top_k, max_context_chars); messages(request_id, turn, role, content). Null numbers take their defaults.
    """
    q, k, c = F.length(F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", "")), F.coalesce("top_k", F.lit(TOP_K[2])), F.coalesce("max_context_chars", F.lit(CONTEXT[2]))
    own = F.array_compact(F.array(F.when(q == 0, "query: empty"), F.when(F.length("query") > QUERY_CHARS, "query: too long"), F.when(~k.between(*TOP_K[:2]), "top_k: out of range"), F.when(~c.between(*CONTEXT[:2]), "max_context_chars: out of range")))
    of_request = requests.select("request_id", F.explode(own).alias("problem"))
    w = Window.partitionBy("request_id").orderBy("turn")
    placed = messages.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("role").over(w))
    wrong_turn = F.when(F.col("n") == 1, F.col("role") != "user").otherwise(F.col("role") == F.col("before"))
    of_turn = F.array_compact(F.array(F.when(~F.col("role").isin("user", "assistant"), "messages: unknown role"), F.when(wrong_turn, "messages: roles do not alternate"), F.when(F.length("content") > QUERY_CHARS, "messages: too long")))
    counts = messages.groupBy("request_id").agg(F.count("*").alias("n"))
    of_count = counts.select("request_id", F.explode(F.array_compact(F.array(F.when(F.col("n") > MESSAGES, "messages: too many"), F.when(F.col("n") % 2 == 1, "messages: incomplete turn")))).alias("problem"))
    return of_request.unionByName(placed.select("request_id", F.explode(of_turn).alias("problem"))).unionByName(of_count).distinct()


CITED = re.compile(r"\[(S\d+)\]")
#: Code blocks, code spans and links that exist already: nothing is replaced in them.
PROTECTED = re.compile(r"(```.*?```|`[^`\n]+`|\[\[[^\]]+\]\]|\[(?:[^\[\]]|\[[^\]]*\])*\]\([^)]+\))", re.DOTALL)
#: Characters that would end or bend a link.
IN_LINKS = str.maketrans({c: f"%{ord(c):02X}" for c in "%#[]|^"})


def _target(path: str) -> str:
    return re.sub(r"(?i)\.md$", "", path).translate(IN_LINKS)


def _circled(n: int) -> str:
    return chr(0x2460 + n - 1) if n <= 20 else str(n)


def note_markdown(answer: str, paths: dict[str, str]) -> tuple[str, dict[str, int]]:
    """(text in which each known [S#] links its file under the file's number, how often each file is cited)."""
    numbers: dict[str, int] = {}
    counts: dict[str, int] = {}

    def link(m: re.Match) -> str:
        path = paths.get(m[1])
        if path is None:
            return m[0]
        n = numbers.setdefault(path, len(numbers) + 1)
        counts[path] = counts.get(path, 0) + 1
        return f"[[{_target(path)}|{_circled(n)}]]"

    text = "".join(part if i % 2 else CITED.sub(link, part) for i, part in enumerate(PROTECTED.split(answer)))
    if numbers:
        text += "\n\n## 근거\n" + "\n".join(f"- {_circled(n)} [[{_target(p)}]]" for p, n in numbers.items())
    return text, counts


def to_note_markdown(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """query_id, markdown, cited_files (map of path to citations) of answers(query_id, answer) and cited(query_id, source_id, file_path)."""
    known = cited.groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("source_id", "file_path"))).alias("paths"))
    rows = answers.join(known, "query_id", "left")

    @F.pandas_udf("markdown string, cited_files map<string,int>")
    def made(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note_markdown(t or "", dict(p) if p is not None else {}) for t, p in zip(texts, paths, strict=True)], columns=["markdown", "cited_files"])

    return rows.select("query_id", made("answer", "paths").alias("m")).select("query_id", "m.*")
