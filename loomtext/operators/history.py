"""Stored conversations: titles, file names, upserts, pruning, and notes that hold them."""

from __future__ import annotations

import json
import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.grounding import note_markdown
from loomtext.sources.scratch import Scratch

DEFAULT_FOLDER = "AI-Chats"
DEFAULT_TITLE = "대화"
MARKER = "search_history: 1"


def history_title(query: Column) -> Column:
    """The first ten words, without characters that file names or links cannot hold, at most 60 characters."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda x: x != "")
    raw = F.array_join(F.slice(words, 1, 10), " ")
    safe = F.trim(F.regexp_replace(F.regexp_replace(raw, r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " "))
    return F.substring(F.when(safe == "", DEFAULT_TITLE).otherwise(safe), 1, 60)


def history_file_name(query: Column, created: Column) -> Column:
    return F.concat(history_title(query), F.lit("@"), F.date_format(created, "yyyy-MM-dd_HH-mm-ss-SSS"), F.lit(".md"))


def normalize_folder(folder: Column, default: str = DEFAULT_FOLDER) -> Column:
    """A folder inside the corpus; root-like and escaping ones give the default."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(folder, F.lit(""))), r"^[/\\]+|[/\\]+$", ""), r"\\", "/")
    bad = clean.isin("", ".", "..") | clean.startswith("../") | clean.contains("/../")
    return F.when(bad, default).otherwise(F.regexp_replace(clean, "/{2,}", "/"))


def upsert_sessions(sessions: DataFrame, order: str = "saved_at") -> DataFrame:
    """One row a file name (title and time of creation), the one saved last."""
    named = sessions.withColumn("file_name", history_file_name(F.col("title"), F.col("created")))
    last = named.groupBy("file_name").agg(F.max_by(F.struct(*named.columns), order).alias("row"))
    return last.select("row.*")


def list_history(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, title, created, n_messages, newest first; sessions without messages count 0."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    return sessions.join(counts, "conv_id", "left").select("conv_id", "title", "created", F.coalesce("n", F.lit(0)).alias("n_messages")).orderBy(F.desc("created"), "conv_id")


def prune_history(sessions: DataFrame, most: int) -> DataFrame:
    """The rows (folder, file_name, created) beyond the newest of each folder; most = 0 keeps all."""
    if most <= 0:
        return sessions.where("false")
    w = Window.partitionBy("folder").orderBy(F.desc("created"), F.desc("file_name"))
    return sessions.withColumn("n", F.row_number().over(w)).where(F.col("n") > most).drop("n")


def recent_window(messages: DataFrame, most: int = 8) -> DataFrame:
    """conv_id, turn, context: for each user turn the messages before it, the last most of them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    rows = messages.select("conv_id", "turn", "role", F.collect_list(F.struct("role", "content")).over(w).alias("context"))
    return rows.where("role = 'user'").select("conv_id", "turn", "context")


def plan_note_paths(drafts: DataFrame, existing: DataFrame, folder: str = "Notes", most: int = 1000) -> DataFrame:
    """draft_id, path, body, status of drafts(draft_id, title, text, created): titles from a leading heading, paths that nothing has.

    A title's drafts take the first free ones of T.md, T 1.md, ... T {most}.md in order of draft_id; no path in existing(path) and none of another draft is
    taken. Where titles differ but paths clash ("T 1" and the second "T"), the draft with the least id keeps the path, and the others look again in the next
    round; each round settles at least the first draft that waits. A draft for which nothing is left has no path and status no_free_path. Of a title no more
    than most + 1 drafts can have a path, so no more are ever sorted, however many there are.
    """
    text = F.regexp_replace("text", r"\A\s+", "")
    heading = F.regexp_extract(text, r"\A#\s+([^\n]+?)\s*(?:\n|\z)", 1)
    body = F.when(heading != "", F.regexp_replace(text, r"\A#\s+[^\n]*\n?\s*", "")).otherwise(F.col("text"))
    stamped = F.when(body.startswith("---\n"), body).otherwise(F.concat(F.lit("---\ncreated: "), F.col("created").cast("string"), F.lit("\n---\n\n"), body))
    scratch = Scratch(drafts.sparkSession, "paths")
    rows = drafts.select("draft_id", history_title(F.when(heading != "", heading).otherwise(F.col("title"))).alias("name"), stamped.alias("body"))
    rows = scratch.cut(rows, "drafts")
    by_title = F.row_number().over(Window.partitionBy("name").orderBy("draft_id"))
    able = scratch.cut(rows.select("draft_id", "name", by_title.alias("turn")).where(F.col("turn") <= most + 1).select("draft_id", "name"), "able")
    used = scratch.cut(existing.select("path").distinct(), "used-0")
    settled, k, waiting = None, 0, able
    while True:
        # a path is number 0 of its own title, and number n of another one if it ends so
        stem = F.regexp_extract("path", rf"\A{re.escape(folder)}/(?s:(.+))\.md\z", 1)
        tail = F.regexp_extract(stem, r"\A(?s:(.+)) ([1-9][0-9]{0,8})\z", 2)
        numbers = F.array(F.struct(stem.alias("name"), F.lit(0).alias("no")), F.when(tail != "", F.struct(F.regexp_extract(stem, r"\A(?s:(.+)) [0-9]+\z", 1).alias("name"), tail.cast("int").alias("no"))))
        own = used.where(stem != "").select(F.explode(F.array_compact(numbers)).alias("e")).select("e.*").where(F.col("no") <= most)
        taken = own.join(able.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.collect_set("no").alias("taken"))  # most + 1 numbers
        counts = waiting.groupBy("name").agg(F.count("*").cast("int").alias("n")).join(taken, "name", "left")
        none = F.coalesce("taken", F.array().cast("array<int>"))
        free = F.array_except(F.sequence(F.lit(0), F.least(F.lit(most), F.col("n") - 1 + F.size(none))), none)
        free = counts.select("name", F.posexplode(free).alias("at", "no")).select("name", (F.col("at") + 1).alias("turn"), "no")
        path = F.concat(F.lit(f"{folder}/"), "name", F.when(F.col("no") == 0, "").otherwise(F.concat(F.lit(" "), F.col("no").cast("string"))), F.lit(".md"))
        offered = waiting.withColumn("turn", by_title).join(free, ["name", "turn"], "left").select("draft_id", "name", F.when(F.col("no").isNotNull(), path).alias("path"))
        offered = scratch.cut(offered, f"offered-{k}")
        # from the first draft on that loses its path to another title, the later ones of its title wait: they may move up
        first = scratch.read(f"offered-{k}").where("path IS NOT NULL").groupBy("path").agg(F.min("draft_id").alias("winner"))
        lost = scratch.read(f"offered-{k}").join(first, "path").where("draft_id <> winner").groupBy("name").agg(F.min("draft_id").alias("stop"))
        placed = scratch.cut(offered.join(lost, "name", "left").withColumn("got", F.col("stop").isNull() | (F.col("draft_id") < F.col("stop"))), f"placed-{k}")
        got = placed.where("got").select("draft_id", "path")
        settled = got if settled is None else settled.unionByName(got)
        waiting = scratch.read(f"placed-{k}").where("NOT got").select("draft_id", "name")
        if waiting.isEmpty():
            break
        used, k = used.unionByName(scratch.read(f"placed-{k}").where("got AND path IS NOT NULL").select("path")), k + 1
    return rows.join(settled, "draft_id", "left").select("draft_id", "path", "body", F.when(F.col("path").isNull(), "no_free_path").otherwise("ok").alias("status"))


# Notes that hold a conversation

SESSION = "title string, created string, provider string, model string, effort string, messages array<struct<role:string,content:string>>, citations array<struct<id:string,file_path:string,start_line:int,heading_path:array<string>,rank:int,score:double>>"


def _quoted(x: str | None) -> str:
    return json.dumps(x or "", ensure_ascii=False)


def _block(text: str) -> str:
    return "|-\n" + "\n".join("      " + line for line in text.split("\n"))


def build_note(title: str, created: str, provider: str, model: str, effort: str, messages: list[dict], cited: list[dict]) -> str:
    lines = ["---", MARKER, f"title: {_quoted(title)}", f"provider: {_quoted(provider)}", f"model: {_quoted(model)}", f"effort: {_quoted(effort)}", f"created: {_quoted(created)}", "messages:"]
    for m in messages:
        lines += [f"  - role: {m['role']}", f"    content: {_block(m['content'] or '')}"]
    lines.append("citations:")
    for c in cited:
        lines += [f"  - id: {c['id']}", f"    file: {_quoted(c['file_path'])}", f"    line: {c['start_line']}", f"    headings: {_quoted(json.dumps(list(c['heading_path']), ensure_ascii=False))}", f"    rank: {c['rank']}", f"    score: {c['score']}"]
    paths = {c["id"]: c["file_path"] for c in cited}
    body = "\n\n".join(f"## Q\n{m['content']}" if m["role"] == "user" else f"## A\n{note_markdown(m['content'] or '', paths)[0]}" for m in messages)
    return "\n".join([*lines, "---", ""]) + f"\n{body}\n"


def _value(raw: str) -> str:
    try:
        found = json.loads(raw)
        return found if isinstance(found, str) else raw
    except ValueError:
        return raw


FRONT = re.compile(r"---\n(.*?)\n---(?:\n|\Z)", re.DOTALL)
MARKED = re.compile(rf"^{re.escape(MARKER)}\s*$", re.MULTILINE)
#: A key with its value and what is indented below it: at the top, and in an item of a list.
SECTION = re.compile(r"^([A-Za-z]+):(?: (.*))?((?:\n .*)*)", re.MULTILINE)
FIELD = re.compile(r"^(?: {4})?([a-z]+):(?: (.*))?((?:\n {6}.*)*)", re.MULTILINE)
NUMBERS = {"line": ("start_line", int), "rank": ("rank", int), "score": ("score", float)}


def _number(raw: str, kind: type):
    try:
        return kind(float(raw))
    except ValueError:
        return None


def _strings(raw: str) -> list[str]:
    try:
        return [str(x) for x in json.loads(_value(raw))]
    except (ValueError, TypeError):
        return []


def _items(below: str) -> list[dict[str, str]]:
    """The fields of each item of a list; a text in a block is what stands below its field."""
    out = []
    for item in re.split(r"(?:\A|\n) {2}- ", below.removeprefix("\n"))[1:]:
        fields = FIELD.findall(item)
        out.append({key: "\n".join(x[6:] for x in block.split("\n")[1:]) if value in ("|", "|-") else value for key, value, block in fields})
    return out


def parse_note(text: str | None) -> tuple | None:
    """A row of SESSION; None for a text without the marker. The front matter is taken apart by its indentation: sections, items, fields, blocks."""
    front = FRONT.match(text or "")
    if not front or not MARKED.search(front[1]):
        return None
    values, below = {}, {}
    for key, value, rest in SECTION.findall(front[1]):
        values.setdefault(key, _value(value))
        below.setdefault(key, rest)
    messages = [{"role": m["role"], "content": m.get("content", "")} for m in _items(below.get("messages", "")) if m.get("role") in ("user", "assistant")]
    cited = []
    for c in _items(below.get("citations", "")):
        row = {"id": c.get("id"), "file_path": _value(c["file"]) if "file" in c else None, "heading_path": _strings(c.get("headings", ""))}
        cited.append(row | {name: _number(c.get(key, ""), kind) for key, (name, kind) in NUMBERS.items()})
    return (values.get("title") or DEFAULT_TITLE, *(values.get(k) or "" for k in ("created", "provider", "model", "effort")), messages, cited)


def write_history_notes(sessions: DataFrame) -> DataFrame:
    """conv_id, note of sessions(conv_id, title, created, provider, model, effort, messages, citations)."""

    @F.pandas_udf("string")
    def built(rows: pd.DataFrame) -> pd.Series:
        def items(x) -> list[dict]:
            return [] if x is None else [dict(i) if isinstance(i, dict) else i.asDict(recursive=True) for i in x]

        return pd.Series([build_note(r.title, r.created, r.provider, r.model, r.effort, items(r.messages), items(r.citations)) for r in rows.itertuples(index=False)])

    return sessions.select("conv_id", built(F.struct("title", "created", "provider", "model", "effort", "messages", "citations")).alias("note"))


def parse_history_notes(notes: DataFrame) -> DataFrame:
    """conv_id and the fields of SESSION of notes(conv_id, note) with the marker; others are dropped."""

    @F.pandas_udf(f"marked boolean, {SESSION}")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        none = (None, None, None, None, None, None, None)
        found = [parse_note(t) for t in texts]
        return pd.DataFrame([(f is not None, *(f or none)) for f in found], columns=["marked", "title", "created", "provider", "model", "effort", "messages", "citations"])

    return notes.select("conv_id", parsed("note").alias("s")).where("s.marked").select("conv_id", "s.*").drop("marked")
