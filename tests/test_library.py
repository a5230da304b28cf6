"""Facts of single operators, on small literal tables."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from loomtext.config import Config
from loomtext.functions import scope, text
from loomtext.operators import chunking, evaluate, expansion, frontmatter, fusion, grounding, history, index, lexical, scan, sync, vectors
from loomtext.plans import build, search
from loomtext.sources import notes as sources
from loomtext.streaming import events as streaming


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_paths(spark):
    assert one(spark, "\\a//b/./c/", scope.normalize_path) == "a/b/c"
    assert one(spark, "a/../b", scope.normalize_path) is None
    assert one(spark, "", scope.normalize_path) is None
    for path, pattern, fits in (("a.md", "**/*.md", True), ("x/a.md", "**/*.md", True), ("x/y/a.md", "x/**", True), ("xy/a.md", "x/**", False), ("x", "x/**", True), ("a.txt", "*.md", False), ("a1.md", "a[0-9].md", True)):
        assert one(spark, path, lambda c, p=pattern: scope.glob_match(c, p)) is fits, (path, pattern)
    assert one(spark, "a.md", lambda c: scope.raw_fnmatch(c, "**/*.md")) is False
    assert one(spark, "Notes/A.MD", lambda c: scope.in_scope(c, ["**/*.md", "Notes/**"], [])) is True


def test_text(spark):
    assert one(spark, "---\na: 1\n---\nbody", text.strip_frontmatter) == "body"
    assert one(spark, "전기차 충전_시설 a É1x", text.tokenize) == ["전기차", "충전_시설", "é1x"]
    assert one(spark, "!?", text.query_tokens) == ["!?"]
    assert one(spark, "x/y-z/a_b.c.md", text.stem) == "a_b.c"
    assert one(spark, "x/y-z/a_b.md", text.directory_tokens) == []
    assert one(spark, "one/two-three/a.md", text.directory_tokens) == ["one", "two", "three"]


def test_paragraph_chunks():
    assert chunking.paragraph_texts("short", 100, 10) == []
    assert chunking.paragraph_texts("a" * 250, 100, 20) == ["a" * 100, "a" * 100, "a" * 90]
    text = "\n\n".join(["first " * 5, "second " * 5, "third " * 12])
    chunks = chunking.paragraph_texts(text, 90, 40)
    assert chunks[0].startswith("first") and "second" in chunks[0] and chunks[1].startswith("second")
    found = list(chunking.located("\n\n".join(["aaaaaaaaaaaa", "bbbbbbbbbbbb"]), ["aaaaaaaaaaaa", "bbbbbbbbbbbb"]))
    assert [(c.first, c.last) for c in found] == [(1, 1), (3, 3)]


def test_markdown_chunks():
    note = "﻿---\na: 1\n---\n# Alpha\n\nfirst paragraph\n\n## Beta\n\n~~~python\n# no heading\n~~~\n\n## Delta\n\n> [!WARNING]\n> one\n> two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    chunks = chunking.markdown_chunks(note, "t", 400, 0)
    assert [c.headings for c in chunks] == [("Alpha",), ("Alpha", "Beta"), ("Alpha", "Delta")]
    assert "# no heading" in chunks[1].content and "[!WARNING]" in chunks[2].content and "| 1 | 2 |" in chunks[2].content
    assert chunks[0].first == 6
    assert chunking.markdown_chunks("", "stem", 400, 60) == [chunking.Chunk("stem", (), 1, 1, True)]
    code = "```py\n" + "\n".join(f"line {i}" for i in range(20)) + "\n```"
    pieces = [c.content for c in chunking.markdown_chunks(code, "t", 50, 0)]
    assert len(pieces) > 1 and all(p.startswith("```py\n") and p.endswith("\n```") and len(p) <= 100 for p in pieces)
    table = "| h | i |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(20))
    pieces = [c.content for c in chunking.markdown_chunks(table, "t", 50, 0)]
    assert len(pieces) > 1 and all(p.startswith("| h | i |\n|---|---|") and len(p) <= 100 for p in pieces)
    assert [len(c.content) for c in chunking.markdown_chunks("x" * 124, "t", 50, 0)] == [50, 50, 24]


def test_chunk_limits(spark):
    notes = spark.createDataFrame([("a/b.md", "para one is here\n\n" * 40), ("c.md", None)], "file_path string, text string")
    for chunker in ("paragraph-v1", "markdown-v2"):
        rows = chunking.chunk(notes, chunker, 100, 20).collect()
        assert all(len(r["content"]) <= 110 for r in rows)
    assert [r["lexical_only"] for r in chunking.chunk(notes, "markdown-v2").collect() if r["file_path"] == "c.md"] == [True]


def test_frontmatter(spark):
    note = "---\nAliases: [One, one, Two]\nTags: '#x'\nproject:\n  owner: kim\n  members: [a, 3, 2020-01-01]\ncssclass: wide\nsources: [n/a.md, ../b.md, n/a.md, 4, n/missing.md]\n---\ntext #tag and a#no\n"
    notes = spark.createDataFrame([("w.md", note), ("n/a.md", "x"), ("bad.md", "---\na: [\n---\nbody #t"), ("none.md", None), ("deep.md", "\ufeff---\r\na: {b: {c: {d: {e: {f: 1}, g: 2}}}}\r\nx: &k [1]\r\ny: *k\r\n...\r\n#T #t")], "file_path string, text string")
    found = {r["file_path"]: r for r in frontmatter.parse(notes).collect()}
    row = found["w.md"]
    assert row["aliases"] == ["One", "Two"] and row["tags"] == ["x", "tag"] and not row["bad"]
    assert "project owner kim members a 3" in row["properties"] and "wide" not in row["properties"] and "2020" not in row["properties"]
    assert found["bad.md"]["bad"] and found["bad.md"]["tags"] == ["t"] and found["none.md"]["properties"] == ""
    assert found["deep.md"]["properties"] == "a b c d e g 2 x 1 y" and found["deep.md"]["tags"] == ["T"]
    many = frontmatter.parse(spark.createDataFrame([("m.md", "---\ntags: [" + ", ".join(f"t{i}" for i in range(300)) + "]\naliases: ['" + "a" * 5000 + "', '" + "b" * 1999 + "']\n---\n")], "file_path string, text string")).first()
    assert len(many["tags"]) == 256 and [len(a) for a in many["aliases"]] == [2000, 1999]
    assert [tuple(r) for r in frontmatter.source_edges(notes, ("**/*.md",), ()).collect()] == [("w.md", 0, "n/a.md")]


ROWS = [("1", ["alpha", "beta", "beta"]), ("2", ["alpha", "only"]), ("3", ["beta", "alpha", "gamma"]), ("4", []), ("5", ["gamma", "delta"]), ("6", ["epsilon", "zeta"]), ("7", ["eta", "theta", "alphabet"]), ("8", ["iota"])]


@pytest.mark.parametrize(("query", "mode", "match"), [("alpha beta", "any", "alpha OR beta"), ("beta beta gamma", "any", "beta OR beta OR gamma"), ("alpha beta", "all", "alpha AND beta"), ("alpha beta", "phrase", '"alpha beta"')])
def test_bm25_is_that_of_sqlite(spark, query, mode, match):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(tokens, tokenize='ascii')")
    db.executemany("INSERT INTO f(rowid, tokens) VALUES (?, ?)", [(int(k), " ".join(t)) for k, t in ROWS])
    wanted = {str(k): round(-s, 6) for k, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    rows = spark.createDataFrame([(k, t, len(t)) for k, t in ROWS], "key string, terms array<string>, n_terms int")
    found = lexical.bm25(spark.createDataFrame([(1, query)], "query_id int, query string"), rows, 10, mode).collect()
    assert {r["key"]: round(r["score"], 6) for r in found} == wanted


def test_prefix_fallback_and_fields(spark):
    rows = spark.createDataFrame([(k, t, len(t)) for k, t in ROWS], "key string, terms array<string>, n_terms int")
    asked = spark.createDataFrame([(1, "none alph"), (2, "gamma")], "query_id int, query string")
    found = lexical.bm25(asked, rows, 10, prefix_fallback=True).collect()
    assert {(r["query_id"], r["key"]) for r in found} == {(1, k) for k in "1237"} | {(2, "3"), (2, "5")}
    fields = spark.createDataFrame([("a.md", ["x1"], [], [], [], ["zz"]), ("b.md", ["zz"], [], [], [], ["x1"]), ("c.md", ["cc"], [], [], [], [])], "file_path string, basename_tokens array<string>, directory_tokens array<string>, alias_tokens array<string>, tag_tokens array<string>, property_tokens array<string>")
    best = lexical.bm25_files(spark.createDataFrame([(1, "x1 zz")], "query_id int, query string"), fields, 5, "all").collect()
    assert {r["key"] for r in best} == {"a.md", "b.md"}
    best = lexical.bm25_files(spark.createDataFrame([(1, "x1")], "query_id int, query string"), fields, 5).collect()
    assert [r["key"] for r in sorted(best, key=lambda r: r["rank"])] == ["a.md", "b.md"]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "body", k, i) for i, k in enumerate(("3", "1", "2"), 1)] + [(1, "vector", "3", 1), (1, "vector", "2", 2), (1, "vector", "3", 3)], "query_id int, channel string, key string, rank int")
    fused = fusion.weighted_rrf(hits, {}).orderBy("rank").collect()
    assert [r["key"] for r in fused] == ["3", "2", "1"] and abs(fused[0]["score"] - 2 / 61) < 1e-12
    chunks = spark.createDataFrame([("1", "a.md", 0), ("2", "a.md", 1), ("3", "b.md", 0)], "key string, file_path string, chunk_index int")
    assert [r["key"] for r in fusion.select_diverse(fusion.weighted_rrf(hits, {}), chunks, 5).orderBy("rank").collect()] == ["3", "2"]
    files = spark.createDataFrame([(1, "a.md", 1), (1, "none.md", 2), (1, "b.md", 3)], "query_id int, file_path string, rank int")
    body = hits.where("channel = 'body'").select("query_id", "key", "rank")
    stand = fusion.file_to_chunk(files, body, body.where("false"), chunks).orderBy("rank").collect()
    assert [(r["file_path"], r["key"], r["rank"]) for r in stand] == [("a.md", "1", 1), ("b.md", "3", 2)]
    told = {r["key"]: r for r in fusion.explain(fusion.weighted_rrf(hits, {}), fusion.contributions(hits, {})).collect()}
    assert told["1"]["vector_rank"] == -1 and told["3"]["body_rank"] == 1


def test_expansion(spark):
    queries = spark.createDataFrame([(1, "q", "timeline", 40), (2, "q", "topic", 40)], "query_id int, query string, intent string, top_k int")
    results = spark.createDataFrame([(q, f, f, i, 1.0 - i / 100) for q in (1, 2) for i, f in enumerate(("5_Wiki/w.md", "b.md"), 1)], "query_id int, file_path string, key string, rank int, score double")
    edges = spark.createDataFrame([("5_Wiki/w.md", i, f) for i, f in enumerate(("b.md", "c.md", "gone.md", "d.md"))], "wiki_path string, pos int, source_path string")
    chunks = spark.createDataFrame([(f, f, 0) for f in ("5_Wiki/w.md", "b.md", "c.md", "d.md")], "key string, file_path string, chunk_index int")
    rows = expansion.expand(results, edges, chunks, expansion.gate(queries, results), ("5_Wiki",)).orderBy("query_id", "rank").collect()
    assert [(r["file_path"], r["expanded"]) for r in rows if r["query_id"] == 1] == [("5_Wiki/w.md", False), ("b.md", False), ("c.md", True), ("d.md", True)]
    assert len([r for r in rows if r["query_id"] == 2]) == 2
    assert rows[2]["score"] == round(0.98 - 3e-6, 6)


def test_sync(spark):
    notes = spark.createDataFrame([("a.md", "x", 1, 1), ("b.md", "y", 2, 2), ("c.md", "z", 1, 1), ("n.md", "n", 1, 1)], "file_path string, text string, file_size long, modified_ns long")
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    state = spark.createDataFrame([("a.md", h("x"), 1, 1, 1), ("b.md", h("y"), 1, 1, 1), ("c.md", h("q"), 1, 1, 1), ("d.md", "", 1, 1, 1)], "file_path string, file_hash string, chunk_count int, file_size long, modified_ns long")
    fast = {r["file_path"]: r["change"] for r in sync.reconcile(notes, state, "fast").collect()}
    strict = {r["file_path"]: r["change"] for r in sync.reconcile(notes, state, "strict").collect()}
    assert fast == {"a.md": "unchanged", "b.md": "stat_only", "c.md": "unchanged", "d.md": "deleted", "n.md": "new"}
    assert strict == fast | {"c.md": "changed"}
    pending = spark.createDataFrame([(f"p{i:04d}.md", "changed", "2026-01-01 00:00:00") for i in range(1001)], "file_path string, operation string, queued_at string").withColumn("queued_at", F.to_timestamp("queued_at"))
    batches = sync.pending_batches(pending, notes, ("**/*.md",), ()).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in batches] == [400, 400, 201]
    assert sync.recovery_plan(pending).first()["plan"] == "strict_reconcile"


def test_index_and_manifest(spark, tmp_path):
    notes = spark.createDataFrame([("notes/a.md", "# T\n\nsome paragraph here", 10, 1), ("notes/b.md", "", 0, 1)], "file_path string, text string, file_size long, modified_ns long")
    config = Config(chunker="markdown-v2", include=("notes/**",))
    tables = build.build_index(notes, config)
    sources.write_index(tables, str(tmp_path), "g1")
    back = sources.read_index(spark, str(tmp_path), "g1")
    assert set(back) == set(tables) == set(sources.TABLES) - {"requeued"} and sources.generations(spark, str(tmp_path)) == ["g1"]
    assert tuple(index.index_counts(back["chunks"], back["file_state"]).first()) == (2, 2, 1)
    assert index.integrity_problems(back["chunks"], back["file_fields"], back["file_state"], back["vectors"], config.vector_dim).count() == 0
    bad = index.integrity_problems(back["chunks"], back["file_fields"].limit(1), back["file_state"], back["vectors"], 3)
    assert {r["kind"] for r in bad.collect()} == {"fields: missing", "vectors: dim"}
    other = back["manifest"].withColumn("value", F.when(F.col("key") == "embedding_dimension", "9").otherwise(F.col("value")))
    problems = index.manifest_problems(other, back["manifest"])
    assert [r["problem"] for r in problems.collect()] == ["embedding_dimension: expected 64, found 9"]
    assert index.recovery_action(other, problems).first()["action"] == "rebuild_vectors"
    assert build.rebuild_vectors(back, config, problems)["vectors"].count() == 1
    again = build.rebuild_lexical(back, notes)
    assert sync.differences(again["postings"], back["postings"]).count() == 0 and sync.differences(again["file_fields"], back["file_fields"]).count() == 0
    assert sync.differences(build.rebuild_vectors(back, config, problems)["vectors"], back["vectors"]).count() == 0


def test_hybrid_search(spark):
    notes = spark.createDataFrame([(f"notes/n{i}.md", f"# Topic{i}\n\nwords about apples{i} and pears, a shared paragraph.", 10, 1) for i in range(12)], "file_path string, text string, file_size long, modified_ns long")
    tables = build.note_tables(notes, Config(chunker="markdown-v2"))
    queries = spark.createDataFrame([(1, "apples3 pears", "topic", 5)], "query_id int, query string, intent string, top_k int")
    rows = search.hybrid_search(tables, queries, Config(final_top_k=5)).orderBy("rank").collect()
    assert len(rows) == 5 and rows[0]["file_path"] == "notes/n3.md" and {"body", "vector"} <= set(rows[0]["channels"])


def test_scan(spark):
    notes = spark.createDataFrame([("Notes/a.md", "x\nfind me\nno"), ("Notes/b.md", "find me too"), ("root.md", "find me"), ("skip/c.md", "find me")], "file_path string, text string")
    rows = scan.grep_notes(notes, "find\\s+me", ("**/*.md",), ("skip/*",)).collect()
    assert [(r["file_path"], r["line_no"]) for r in rows] == [("Notes/a.md", 2), ("Notes/b.md", 1)]
    asked = spark.createDataFrame([("Notes/a.md",), ("../x.md",), ("/etc",), ("skip/c.md",), ("Notes/z.md",), ("other.txt",)], "path string")
    status = {r["path"]: r["status"] for r in scan.read_notes(asked, notes, ("**/*.md",), ("skip/*",)).collect()}
    assert status == {"Notes/a.md": "ok", "../x.md": "invalid_path", "/etc": "invalid_path", "skip/c.md": "excluded", "Notes/z.md": "not_found", "other.txt": "out_of_scope"}


def test_grounding(spark):
    results = spark.createDataFrame([(1, i, 1.0, "a.md" if i < 4 else "b.md", "c" * 100, 1, ["h"]) for i in range(1, 6)], "query_id int, rank int, score double, file_path string, content string, start_line int, heading_path array<string>")
    rows = grounding.grounding_sources(results).orderBy("source_no").collect()
    assert [(r["source_id"], r["file_path"], r["rank"]) for r in rows] == [("S1", "a.md", 1), ("S2", "a.md", 2), ("S3", "b.md", 4), ("S4", "b.md", 5)]
    block = len(grounding.source_block(grounding.grounding_sources(results)).orderBy("source_no").first()["block"])
    cut = grounding.grounding_sources(results, 2 * block - 30).orderBy("source_no").collect()
    assert [len(r["content"]) for r in cut] == [100, 68]
    known = spark.createDataFrame([(1, 1, "S1", "a.md")], "query_id int, source_no int, source_id string, file_path string")
    r = grounding.normalize_citations(spark.createDataFrame([(1, "x [S1] y [S9] [S1] "), (2, "none")], "query_id int, answer string"), known).orderBy("query_id").collect()
    assert r[0]["answer"] == "x [S1] y  [S1]" and r[0]["used"] == ["S1"] and r[1]["warning"] == grounding.NO_CITATION


def test_tool_calls(spark):
    turns = spark.createDataFrame([(1, '```\nTOOL: search(query="a \\"b\\" (c)")TOOL: read(file="x.md")\n```'), (2, "an answer")], "turn_id int, text string")
    rows = grounding.extract_tool_calls(turns).orderBy("call_no").collect()
    assert [(r["name"], r["args"]) for r in rows] == [("search", {"query": 'a "b" (c)'}), ("read", {"file": "x.md"})]


def test_note_markdown():
    text, counts = grounding.note_markdown("See [S1] and [S2], `[S1]`, [[S1]] again [S1] [S9]", {"S1": "a/b#1.md", "S2": "c.md"})
    assert text == "See [[a/b%231|①]] and [[c|②]], `[S1]`, [[S1]] again [[a/b%231|①]] [S9]\n\n## 근거\n- ① [[a/b%231]]\n- ② [[c]]"
    assert counts == {"a/b#1.md": 2, "c.md": 1}


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["x", "y"], [], ["f"], 10.0), ("b", [], ["z"], [], 20.0)], "case_id string, expected_paths array<string>, acceptable_paths array<string>, forbidden_paths array<string>, latency_ms double")
    results = spark.createDataFrame([("a", "f", 1), ("a", "x", 2), ("a", "x", 3), ("b", "z", 1)], "case_id string, file_path string, rank int")
    rows = {r["case_id"]: r for r in evaluate.case_metrics(cases, results).collect()}
    assert rows["a"]["recall_40"] == 0.5 and rows["a"]["mrr_10"] == 0.5 and rows["a"]["forbidden_20"] == 1 and not rows["a"]["complete"]
    total = evaluate.aggregate_metrics(evaluate.case_metrics(cases, results)).first()
    assert total["cases_with_expected"] == 1 and total["acceptable_hit"] == 1.0 and total["p50_ms"] == 15.0 and total["p95_ms"] == 10.0


def test_sources(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "sub" / "n.md").write_bytes(b"ok \xff")
    (tmp_path / "v" / "x.txt").write_text("no")
    (tmp_path / "v" / ".git").mkdir()
    (tmp_path / "v" / ".git" / "g.md").write_text("no")
    rows = sources.scan_notes(spark, str(tmp_path / "v")).collect()
    assert [(r["file_path"], r["text"], r["file_size"]) for r in rows] == [("sub/n.md", "ok �", 4)]
    (tmp_path / "cases.json").write_text('{"schema_version": 1, "vault": "v", "cases": [{"id": "a-b", "query": "q", "intent": "topic", "expected_paths": ["x.md"], "acceptable_paths": [], "forbidden_paths": []}]}')
    cases = sources.load_cases(spark, str(tmp_path / "cases.json"))
    assert cases.first()["top_k"] == 40 and evaluate.validate_cases(cases).count() == 0
    (tmp_path / "hits.json").write_text('{"results": [{"file_path": "a"}, {"file_path": "b"}]}')
    assert [r["file_path"] for r in sources.load_hits(spark, str(tmp_path / "hits.json"), 1).collect()] == ["a"]
    (tmp_path / "list.txt").write_text("a.md\n\nb.md\n")
    assert sources.load_path_list(spark, str(tmp_path / "list.txt")).count() == 2


def test_history(spark):
    rows = spark.createDataFrame([(1, " What: is / this? ")], "id int, q string").select(history.history_title(F.col("q")).alias("t")).first()
    assert rows["t"] == "What is this"
    note = history.build_note("T", "c", "p", "m", "e", [{"role": "user", "content": "a\n\nb"}, {"role": "assistant", "content": "see [S1]"}], [{"id": "S1", "file_path": "a.md", "start_line": 2, "heading_path": ["x"], "rank": 1, "score": 0.5}])
    back = history.parse_note(note)
    assert back[0] == "T" and back[5][0]["content"] == "a\n\nb" and back[6][0]["heading_path"] == ["x"]
    assert history.parse_note("---\ntitle: x\n---\n") is None
    drafts = spark.createDataFrame([(1, "T", "# Own\nbody", "d"), (2, "T", "text", "d"), (3, "T", "text", "d")], "draft_id int, title string, text string, created string")
    taken = spark.createDataFrame([("Notes/T.md",)], "path string")
    assert {r["draft_id"]: r["path"] for r in history.plan_note_paths(drafts, taken).collect()} == {1: "Notes/Own.md", 2: "Notes/T 1.md", 3: "Notes/T 2.md"}


def test_note_paths(spark):
    import random

    plan = lambda drafts, taken, most=1000: {r["draft_id"]: r["path"] for r in history.plan_note_paths(spark.createDataFrame([(i, t, "text", "d") for i, t in drafts], "draft_id int, title string, text string, created string"), spark.createDataFrame([(f"Notes/{p}.md",) for p in taken], "path string"), most=most).collect()}
    assert plan([(1, "T"), (2, "T"), (3, "T 1")], []) == {1: "Notes/T.md", 2: "Notes/T 1.md", 3: "Notes/T 1 1.md"}
    assert plan([(1, "U 1"), (2, "V 01")], ["U 1", "V"]) == {1: "Notes/U 1 1.md", 2: "Notes/V 01.md"}
    assert plan([(1, "T 1"), (2, "T"), (3, "T")], []) == {1: "Notes/T 1.md", 2: "Notes/T.md", 3: "Notes/T 2.md"}
    assert plan([(i, "T") for i in range(6)], ["T 1"], 3) == {0: "Notes/T.md", 1: "Notes/T 2.md", 2: "Notes/T 3.md", 3: None, 4: None, 5: None}
    r = random.Random(7)
    titles, taken = ["A", "A 1", "A 2", "A 1 1", "B", "B 3"], ["A 1", "A 3", "B", "B 1"]
    drafts = [(i, r.choice(titles)) for i in range(40)]
    found = plan(drafts, taken)
    assert len(set(found.values())) == 40 and not set(found.values()) & {f"Notes/{p}.md" for p in taken}
    for i, t in drafts:  # no path before its own is free in the end
        own = found[i].removeprefix("Notes/").removesuffix(".md")
        n = int(own[len(t) :] or 0)
        assert own == t + (f" {n}" if n else "") and all(f"Notes/{t}{f' {k}' if k else ''}.md" in {*found.values(), *(f"Notes/{p}.md" for p in taken)} for k in range(n))


def test_nearest_is_brute_force(spark):
    import numpy as np

    g = np.random.default_rng(3)
    x = np.round(g.standard_normal((300, 8)), 1).astype(np.float32)
    x[50:90] = x[7]
    x[0] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)] + [(999, None)], "key int, embedding array<float>")
    asked = rows.where("key % 10 = 0").withColumnRenamed("key", "query_id")
    old = vectors.SCORES
    unit = x.astype(np.float64) / np.where((n := np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)) > 0, n, 1)
    for own in (False, True):
        got = {}
        for r in vectors.nearest(asked, rows, 15, exclude_self=own).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["key"])
        for q in range(0, 300, 10):
            s = np.round(unit @ unit[q], 12)
            assert got[q] == [int(i) for i in np.lexsort((np.arange(300), -s)) if not own or i != q][:15], q
    vectors.SCORES = 64
    (row, column), score = vectors.best(unit[:9], unit, 5)
    vectors.SCORES = old
    assert [column[row == i].tolist() for i in range(9)] == [np.lexsort((np.arange(300), -np.round(unit @ unit[i], 12)))[:5].tolist() for i in range(9)]


def test_streams(spark):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00", "a.md", None, "modify"), (2, "2026-01-01 00:00:01", "a.md", None, "delete"), (3, "2026-01-01 00:00:09", "b.md", "c.md", "rename"), (4, "2026-01-01 00:00:09", "x.txt", None, "create")], "event_id int, ts string, file_path string, old_path string, op string").withColumn("ts", F.to_timestamp("ts"))
    assert {(r["path"], r["op"]) for r in streaming.coalesce_events(rows).collect()} == {("a.md", "deleted"), ("b.md", "changed"), ("c.md", "deleted")}
    assert {(r["path"], r["n"]) for r in streaming.debounced(rows).collect()} == {("a.md", 2), ("b.md", 1), ("c.md", 1)}
    batches = {r["path"]: r["batch_no"] for r in streaming.flush_batches(streaming.coalesce_events(rows), 2).collect()}
    assert batches["b.md"] == 0 and sorted(batches.values()) == [0, 0, 1]


def test_index_sync(spark, tmp_path):
    """Batches are put back when refused, made again after a failure, and give what a rebuild gives; many paths are reconciled."""
    names = [f"n{i}.md" for i in range(12)]
    now = {p: f"the text of note {p} as it was first" for p in names}
    notes = lambda: spark.createDataFrame([(p, t, len(t), 1) for p, t in now.items()], "file_path string, text string, file_size int, modified_ns long")
    config, calls = Config(), []
    fail = {"left": 1}

    def made(rows):
        calls.append(1)
        if len(calls) > 1 and fail["left"]:
            fail["left"] -= 1
            raise RuntimeError("no encoder")
        return build.note_tables(rows, config)

    sync_ = streaming.IndexSync(spark, str(tmp_path / "index"), notes, made, config, 2)
    sync_.start()
    schema = "event_id int, ts timestamp, file_path string, old_path string, op string"

    def put(*events):
        spark.createDataFrame(events, "event_id int, ts string, file_path string, old_path string, op string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
        streaming.stream_sync(stream, sync_.apply, str(tmp_path / "checkpoint")).awaitTermination()

    def same():
        full = build.note_tables(notes(), config)
        for name in ("chunks", "file_fields", "file_state", "vectors"):
            assert sync.differences(sync_.tables()[name], full[name]).count() == 0, name

    at = "2026-01-01 00:00:0"
    now["n0.md"], now["new.md"] = "another text of the first note", "a note that was not there"
    del now["n1.md"]
    put((1, at + "1", "n0.md", None, "modify"), (2, at + "2", "new.md", None, "create"), (3, at + "3", "n1.md", None, "delete"))
    with pytest.raises(Exception, match="no encoder"):
        run()
    assert sources.generations(spark, sync_.root) == ["-1"] and sync_.tables()["file_state"].count() == 12
    run()  # the checkpoint replays the batch
    assert sorted(sources.generations(spark, sync_.root)) == ["-1", "0"]
    same()
    sync_.rejected = lambda flushed: flushed.where("batch_no = 0")
    now["n2.md"], now["n3.md"], now["n4.md"] = ("changed once more " + x for x in "abc")
    put((4, at + "4", "n2.md", None, "modify"), (5, at + "5", "n3.md", None, "modify"), (6, at + "6", "n4.md", None, "modify"))
    run()
    back = {r["path"] for r in sync_.tables()["requeued"].collect()}
    assert len(back) == 2 and back < {"n2.md", "n3.md", "n4.md"}
    sync_.rejected = None
    del now["n2.md"]
    put((7, at + "7", "n2.md", None, "delete"))
    run()
    assert sync_.tables()["requeued"].count() == 0
    same()
    sync_.drain_limit = 2
    for p in ("n5.md", "n6.md", "n7.md"):
        now[p] += " and more"
    del now["n8.md"]
    put((8, at + "8", "n5.md", None, "modify"), (9, at + "8", "n6.md", None, "modify"), (10, at + "9", "n7.md", None, "modify"))
    run()  # too many to drain: what no event told is found too
    same()
    sync_.apply(streaming.coalesce_events(spark.createDataFrame([], schema)), 3)
    assert len(sources.generations(spark, sync_.root)) == 5


def test_reports(spark, tmp_path):
    cases = spark.createDataFrame([("a", ["x"], [], [], 10.0)], "case_id string, expected_paths array<string>, acceptable_paths array<string>, forbidden_paths array<string>, latency_ms double")
    rows = evaluate.case_metrics(cases, spark.createDataFrame([("a", "x", 1)], "case_id string, file_path string, rank int"))
    sources.write_report(evaluate.aggregate_metrics(rows), rows, str(tmp_path / "report"))
    metrics, back = sources.read_report(spark, str(tmp_path / "report"))
    assert metrics.first()["recall_40"] == 1.0 and back.first()["case_id"] == "a" and back.first()["complete"]
    (tmp_path / "one.json").write_text('{"metrics": {"recall_40": 0.5}, "cases": [{"case_id": "a", "complete": false}, {"case_id": "b", "complete": true}]}')
    metrics, back = sources.read_report(spark, str(tmp_path / "one.json"))
    assert metrics.first()["recall_40"] == 0.5 and back.count() == 2


def test_analyzer_reaches_index_and_queries(spark):
    analyzer = lambda c: F.transform(F.filter(F.split(F.lower(c), r"\W+"), lambda x: F.length(x) > 3), lambda x: F.substring(x, 1, 4))
    notes = spark.createDataFrame([("a.md", "# Running\n\nthe runners went home quickly", 1, 1), ("b.md", "# Other\n\nsomething else is written", 1, 1)], "file_path string, text string, file_size int, modified_ns long")
    config = Config(chunker="markdown-v2")
    tables = build.build_index(notes, config, analyzer=analyzer)
    assert {"runn", "quic"} <= {r["term"] for r in tables["postings"].collect()}
    asked = spark.createDataFrame([(1, "runnable"), (2, "somewhere")], "query_id int, query string")
    hits = search.channel_hits(tables, asked, config, analyzer=analyzer).where("channel = 'body'").collect()
    assert {(r["query_id"], r["key"].split("#")[0]) for r in hits} == {(1, "a.md"), (2, "b.md")}


def test_config_is_clamped():
    found = Config(chunk_chars=3, overlap_chars=500, bm25_top_k=0, vector_top_k=-1, final_top_k=0, rrf_k=0, title_rrf_weight=-1.0, max_chunks_per_file=0, vector_dim=0).clamped()
    assert (found.chunk_chars, found.overlap_chars, found.bm25_top_k, found.vector_top_k, found.final_top_k, found.rrf_k, found.title_rrf_weight, found.max_chunks_per_file, found.vector_dim) == (100, 99, 1, 1, 1, 1, 0.0, 1, 1)
    assert Config().clamped() == Config()


def test_vectors(spark):
    import numpy as np

    texts = spark.createDataFrame([(1, "a b a"), (2, "")], "query_id int, query string")
    own = {r["query_id"]: r["embedding"] for r in vectors.hash_vectors(texts.withColumn("query", F.concat(F.lit("query: "), "query")), "query_id", "query", 16).collect()}
    other = {r["query_id"]: r["embedding"] for r in vectors.embed_queries(texts, vectors.hash_encoder(16)).collect()}
    assert all(np.allclose(own[k], other[k], atol=1e-6) for k in own)
    pooled = vectors.mean_pool_normalize(np.ones((1, 2, 4), np.float32), np.array([[1, 0]]))
    assert np.allclose(pooled, 0.5)
