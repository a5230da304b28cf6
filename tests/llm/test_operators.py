"""Each operator against a brute-force version, and its corner cases: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import bpe, chat, mixing, neighbours, packing, quality, simhash, sketch, spans, urls
from loomtext.llm.links import components
from loomtext.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, count string, hash string"
WORDS = "the of and alpha beta gamma delta one two three house tree river stone light".split()


def docs(spark, rows):
    """rows of (doc_id, text, source); two more columns have names that operators may use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", "h") for i, t, s in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


# 1 mixing


def filled(sizes, weights, total, cap):
    """Water-filling by repeated clamping, on a dict of sizes."""
    out, free = {}, set(sizes)
    while free:
        share = {s: (total - sum(out.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 60)), r.choice(["a", "b", "c", "d", "é", None])) for i in range(400)] + [(1000 + i, prose(i, 30), "z") for i in range(3)]
    rows += [(5000, None, "a"), (5001, "  \n", "only blank"), (None, prose(1, 5), "a"), (7, prose(7, 9), "b")]
    found = mixing.taken(docs(spark, rows)).collect()
    again = mixing.taken(docs(spark, list(reversed(rows)))).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for row in found:
        assert abs(row["target"] - want[row["source"]]) < 1e-6 and row["source_size"] == sizes[row["source"]]
        assert row["taken"] <= 2 * row["size"] and (row["size"] == 0 or row["taken"] % row["size"] == 0)
    for s in sizes:
        got = sum(x["taken"] for x in found if x["source"] == s)
        assert abs(got - want[s]) <= 60, s
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows[:1]).columns
    assert mixed.where("text IS NOT NULL").count() == sum(x["copies"] for x in found if x["doc_id"] != 5000)
    assert mixing.taken(docs(spark, [])).count() == 0
    assert mixing.taken(docs(spark, [(1, None, None)])).first()["target"] == 0.0


def drawn_once_more(own, left):
    """Hashes of own (hash, size) taken by going through them one by one: up to the cut, one sweep of smaller ones, two single ones."""
    def through(rows, gap):
        got = []
        for h, n in rows:
            if n > gap:
                return got, gap, (h, n)
            got.append(h)
            gap -= n
        return got, gap, None

    own = sorted((h, n) for h, n in own if n)
    first, gap, over = through(own, left)
    beyond = [(h, n) for h, n in own[len(first) :] if n <= gap]
    more, least, _ = through(beyond, gap)
    last = max(more, default=-(1 << 63))
    for _ in range(2):
        fit = max(((n, h) for h, n in beyond if h not in more and n <= least and h > last), default=None)
        if fit:
            more.append(fit[1])
            least -= fit[0]
    return {*first, over[0]} if over and over[1] - gap < least else {*first, *more}


def test_mixing_fills_the_gap_at_a_long_document(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.choice([3, 5, 8, 40, 900])), s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 150)]
    rows += [(1, prose(1, 70), "d"), (2, prose(2, 71), "d")]
    for seed in (1, 2):
        sizes, draws = mixing.plan(docs(spark, rows), seed=seed, budget=0.3)
        left = {x["source"]: x["target"] - x["mix_whole"] * x["source_size"] for x in draws.collect()}
        own = sizes.join(draws, "source").withColumn("copies", mixing.repetitions() - F.col("mix_whole")).collect()
        for s in "abcd":
            want = drawn_once_more([(x["mix_hash"], x["size"]) for x in own if x["source"] == s], left[s])
            assert {x["mix_hash"] for x in own if x["source"] == s and x["copies"]} == want, (seed, s)
    found = mixing.taken(docs(spark, rows), seed=2, budget=0.3).collect()
    assert all(x["taken"] <= 2 * x["size"] for x in found)
    assert mixing.mix(docs(spark, rows), seed=2, budget=0.3).count() == sum(x["copies"] for x in found)


def test_mixing_rows_without_ids_and_repeats(spark):
    rows = [(None, prose(i, 10), "a") for i in range(400)] + [(5, "the very same text of eight words here", "b")] * 600 + [(i, prose(i, 10), "c") for i in range(600)]
    odd = docs(spark, rows).withColumn("mix_row", F.lit(1)).withColumn("mix_hash", F.lit("x"))
    found = mixing.taken(odd).collect()
    for s in "abc":
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10 and all(r["taken"] <= 2 * r["size"] for r in own), s
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(docs(spark, rows).drop("doc_id", "source")).columns == ["text", "lang", "n_chars", "count", "hash"]


# 2 BPE


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def test_bpe(spark, library):
    r = random.Random(1)
    letters = " \n\t  abcXY'stre12²Ⅷ#$é漢字　 \x85\x1c 🙂½_-.,!ſ×ª"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 900 + " <|endoftext|> d<|endoftext|>", " " * 200, "the " * 2000, "\n \n x "]
    enc = bpe.encoder(bpe.vocabulary())
    mine = list(enc.encode_each(texts))
    for text, ids, other in zip(texts, mine, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == other.ids and enc.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    rows = [(i, t, "s") for i, t in enumerate(texts[-8:])] + [(99, None, "s"), (99, None, "s"), (None, "x", None)]
    found = bpe.digest(docs(spark, rows), bpe.vocabulary()).collect()
    assert len(found) == len(rows)
    for row in found:
        text = next(t for i, t, _ in rows if i == row["doc_id"]) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(docs(spark, rows[:3]), bpe.vocabulary())
    assert {x["doc_id"]: x["text"] for x in bpe.decode(encoded, bpe.vocabulary()).collect()} == {i: t for i, t, _ in rows[:3]}
    assert bpe.digest(docs(spark, []), bpe.vocabulary()).count() == 0


# 3 spans


def left_over(rows, least, min_words):
    """Texts without later repeats, from dicts of spans."""
    cut = {i: spans.sentences(t or "") for i, t in rows}
    first = {}
    places = []
    for i in sorted(cut):
        for at in range(len(cut[i])):
            end, n = at, 0
            while end < len(cut[i]) and (end - at < least or n < min_words):
                n += len(cut[i][end].split())
                end += 1
            if end - at >= least and n >= min_words and cut[i][at].split():
                key = tuple(tuple(s.lower().split()) for s in cut[i][at:end] if s.split())
                first.setdefault(key, (i, at))
                places.append((key, i, at, end))
    gone = {(i, k) for key, i, at, end in places if first[key] != (i, at) for k in range(at, end)}
    return {i: "".join(s for k, s in enumerate(cut[i]) if (i, k) not in gone) for i in cut}


def test_spans(spark):
    passage = "This is a passage of many words. It stands in more than one place of the tables, word for word. And it ends here with a last sentence!"
    rows = [(i, f"{prose(i, 12)} start {i}. {passage} {prose(i + 50, 9)}.\nLast line {i}", "s") for i in range(1, 6)]
    rows += [(10, passage + " " + passage, "s"), (11, "Short. Line.", "s"), (12, "Short. Line.", "s"), (13, "", "s"), (14, prose(9, 400), "s")]
    found = {r["doc_id"]: r for r in spans.remove_repeats(docs(spark, rows), report="count").collect()}
    assert {i: r["text"] for i, r in found.items()} == left_over([(i, t) for i, t, _ in rows], spans.SENTENCES, spans.MIN_WORDS)
    assert passage in found[1]["text"] and "It stands in more" not in found[2]["text"] and found[11]["count"]["removed"] == 0 and found[2]["count"]["words"] > 15
    odd = spans.remove_repeats(docs(spark, [(1, None, None), (None, passage, "s"), (3, passage, "s"), (3, passage, "s")])).collect()
    assert [r["text"] for r in odd if r["doc_id"] is None] == [""] and all(r["text"] == passage for r in odd if r["doc_id"] == 3)
    assert spans.remove_repeats(docs(spark, [])).count() == 0
    clash = docs(spark, rows).withColumns({c: F.lit(7) for c in ("span_row", "span_text", "cover", "span_removed", "span_rest", "id_1")})
    kept = spans.remove_repeats(clash)
    assert kept.columns == clash.columns and {r["span_removed"] for r in kept.collect()} == {7}
    assert spans.remove_repeats(clash, report="cover").first()["cover"]["removed"] is not None
    for text in ("a. b", "x.\n\ny! \"z\" ...", "no end", "\n\n", "1.5 is a number. e.g. this"):
        assert "".join(spans.sentences(text)) == text


# 4 URLs


def test_urls(spark):
    cases = [
        ("https://Example.COM/en/7x?q", "example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://a.b.com/en/8", "a.b.com", "/en/8", "com/en/", "block"),
        ("http://x.example.net/de/81#f", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://y.net/de/8", "y.net", "/de/8", "net/de/", "allow"),
        ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("ftp://my-casino.info", "my-casino.info", "", None, "block"),
        ("http://casinoville.info/", "casinoville.info", "/", None, "allow"),
        ("http://a.info/free/win", "a.info", "/free/win", None, "block"),
        ("http://a.info/free/free", "a.info", "/free/free", None, "allow"),
        ("xxx", "", "", None, "block"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    found = urls.judge(pages).collect()
    assert len(found) == 2 * len(cases)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:], r
    assert urls.judge(pages.where("false")).count() == 0


def test_url_vocabulary(spark):
    terms = spark.createDataFrame([("Wette", 0.4, "de"), ("bet", 0.4, "en"), ("bet", 0.3, None), ("gratis", 0.6, None), ("", 1.0, None), (None, 1.0, None), ("x", None, None), ("pokies", 1.0, None)], "term string, weight double, locale string")
    assert urls.vocabulary(terms, ("de",)) == (("bet", 0.3), ("gratis", 0.6), ("pokies", 1.0), ("wette", 0.4))
    weights = urls.vocabulary(terms)
    pages = spark.createDataFrame([(0, "http://a/wette"), (1, "http://a/wette-gratis"), (2, "http://a/bet/wette"), (3, "http://a/pokies"), (4, "http://a/gratis.gratis")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, weights).collect()} == {0: "allow", 1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert urls.judge(pages, ()).where("verdict = 'block'").count() == 0


# 5 packing


def test_packing(spark):
    r = random.Random(5)
    lengths = [r.randrange(1, 65) for _ in range(300)] + [64, 64, 1]
    rows = packing.best_fit_decreasing(lengths, 64)
    # the same by looking at every open row
    free, plain = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = min((f for f in free if f >= lengths[i]), default=None)
        if fit is None:
            free.append(64 - lengths[i])
        else:
            free[free.index(fit)] = fit - lengths[i]
        plain.append(i)
    assert sorted(i for row in rows for i in row) == sorted(plain) and sorted(64 - sum(lengths[i] for i in row) for row in rows) == sorted(free)
    path = bpe.vocabulary("byte_bpe_50k.tiktoken")
    table = [(i, prose(i, n), "s") for i, n in enumerate((3, 900, 40, 1, 2000, 17))] + [(50, None, "s"), (51, "", "s"), (None, "lone words", "s"), (3, prose(3, 1), "s"), (52, "x<|endoftext|>y", "s")]
    packed = packing.pack(docs(spark, table), path, capacity=256, window=3000).collect()
    vocabulary = packing.vocabulary(path)
    pieces = {}
    for row in packed:
        ids, at, cu = np.frombuffer(row["input_ids"], "<u2"), np.frombuffer(row["position_ids"], "<u2"), row["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == len(ids) == row["n_tokens"] <= 256
        for a, b, d, o in zip(cu, cu[1:], row["doc_ids"], row["offsets"], strict=False):
            assert list(at[a:b]) == list(range(b - a))
            pieces.setdefault(d, []).append((o, ids[a:b].tolist()))
    texts = {d: vocabulary.decode([x for _, p in sorted(ps) for x in p]) for d, ps in pieces.items() if d != 3}
    assert texts == {i: t for i, t, _ in table if t and i != 3} and len(pieces[3]) == 2
    assert len({(r["shard"], r["row"]) for r in packed}) == len(packed) and packing.pack(docs(spark, []), path).count() == 0
    assert len(packing.padded(b"\x01\x00", "<u2", 4, 9)) == 4


def test_packing_of_long_gaps(spark):
    path = bpe.vocabulary("byte_bpe_50k.tiktoken")
    enc = packing.vocabulary(path)
    for text in ("a" + " " * 5000 + "b c", " " * 3000, "\n" * 2000 + "x", "x \u3000" * 900 + " end " + "\t" * 1500 + "\n", "\x1c" * 2000 + " y"):
        assert packing.encoded(text, path).tolist() == enc.encode(text, disallowed_special=())
    long = " " * 2_000_000
    packed = packing.pack(docs(spark, [(1, long, "s"), (2, "a" + long + "b", "s")]), path).collect()
    back = {}
    for row in packed:
        ids, cu = np.frombuffer(row["input_ids"], "<u2"), row["cu_seqlens"]
        for a, b, d, o in zip(cu, cu[1:], row["doc_ids"], row["offsets"], strict=False):
            back.setdefault(d, []).append((o, ids[a:b]))
    assert {d: enc.decode(np.concatenate([x for _, x in sorted(ps, key=lambda p: p[0])]).tolist()) for d, ps in back.items()} == {1: long, 2: "a" + long + "b"}


# 6 sketches


def true_sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketch_estimates():
    hasher, below = sketch.Hasher(5), sketch.threshold(sketch.FRACTION)
    a, b = prose(1, 3000), prose(2, 3000)
    for x, y in ((a, a + " " + b), (a, a[: len(a) // 2]), (a, b), ("one two", "one two"), ("", ""), ("", a), ("a b c d e f", "a b c d e g")):
        s, t = sketch.sketch(x, hasher, below), sketch.sketch(y, hasher, below)
        u, v = true_sets(x), true_sets(y)
        assert abs(sketch.likeness(s, t) - (len(u & v) / len(u | v) if u | v else 1.0)) < 0.12
        assert abs(sketch.containment(s, t) - (len(u & v) / len(u) if u else float(not v))) < 0.12
        merged = sketch.merge(s, t, below)
        whole = sketch.Sketch(np.unique(np.concatenate([hasher.shingles(x.encode()), hasher.shingles(y.encode())])), below)
        assert merged.hashes.tolist() == whole.hashes[: len(merged.hashes)].tolist() and len(merged.hashes) >= min(len(whole.hashes), int(np.searchsorted(whole.hashes, np.uint64(below))))


def test_sketch_error_on_both_sides_of_least():
    """Mean errors of likeness below and above the length at which the fraction alone keeps LEAST hashes, with LEAST and without."""
    hasher, below = sketch.Hasher(5), sketch.threshold(sketch.FRACTION)
    error = {}
    for n in (60, 300, 500, 600, 2000):
        for least in (0, sketch.LEAST):
            found = []
            for seed in range(30):
                words = prose(seed, n).split()
                other = words[: n * 3 // 4] + prose(seed + 99, n // 4).split()
                x, y = (sketch.sketch(" ".join(w), hasher, below, least) for w in (words, other))
                u, v = true_sets(" ".join(words)), true_sets(" ".join(other))
                found.append(abs(sketch.likeness(x, y) - len(u & v) / len(u | v)))
            error[n, least] = np.mean(found)
    assert all(e < 0.1 for (n, least), e in error.items() if least) and error[60, 0] > error[60, sketch.LEAST] and abs(error[2000, 0] - error[2000, sketch.LEAST]) < 1e-9


def test_sketch_ranges(spark):
    """Rows without id and an id of a third of all rows are dealt to many ranges, each row with one following."""
    rows = [(None, f"n{i}", "s") for i in range(300)] + [(50, f"h{i}", "s") for i in range(300)] + [(i, f"t{i}", "s") for i in range(100, 400)] + [(7, "same", "s")] * 3
    dealt = sketch.with_next(docs(spark, rows), 64)
    sizes = {r["part"]: r["n"] for r in dealt.where("NOT guest").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 60
    assert sketch.compare_edited(docs(spark, rows)).count() == len(rows)


def test_sketch_query(spark):
    texts = [(5, prose(5, 300), "s"), (1, prose(1, 40), "s"), (9, None, "s"), (3, "Ab cd", "s"), (7, "aB Cd", "s"), (20, "x", "s"), (21, "", "s"), (30, prose(5, 300), "s"), (-4, "é" * 5000, "s")]
    found = sketch.compare_edited(docs(spark, texts)).collect()
    order = sorted(texts)
    assert len(found) == len(texts)
    rows = {r["doc_id"]: r for r in found}
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + u[:n]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        x, y = true_sets(t), true_sets(edited)
        assert abs(rows[i]["near_edited"] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
        z = true_sets(u)
        assert abs(rows[i]["near_next"] - (len(x & z) / len(x | z) if x | z else 1.0)) < 0.25
    assert rows[5]["fingerprint"] == rows[30]["fingerprint"] and rows[3]["fingerprint"] == rows[7]["fingerprint"]
    assert sketch.compare_edited(docs(spark, [(1, "alone here", "s")])).first()["near_next"] == 1.0
    assert sketch.compare_edited(docs(spark, [])).count() == 0
    assert sketch.compare_edited(docs(spark, [(None, "a", "s"), (2, "b", "s"), (2, "b", "s")])).count() == 3
    assert sketch.fingerprints(docs(spark, texts)).count() == len(texts)


# 7 chat


def test_chat(spark):
    control = "\\### Assistant: </turn> ok <|end|> <\\|turn|> <\\\\|x <|image:0|>"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "assistant", "two"), (2, 1, "assistant", None), (2, 0, None, "x" * 50000), (None, 0, "user", "q"), (3, None, "sys<|content|>tem", "a"), (3, None, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    formatted = chat.format_conversations(table)
    found = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = found[conv]
        assert got["n_turns"] == len(own) and got["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for text in (control, "<|", "<\\\\\\|", "<<|", "", "\\"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "s3://a.png", None), ("text", "and", None, None), ("audio", None, "b.wav", 12), (None, "tail", None, None), ("scan", None, "c", None)]
    table = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", None, parts[:3])], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    row = chat.format_conversations(table).first()
    assert row["formatted"].startswith("<|turn|>user<|content|>see <\\|<|image:0|>and<|audio:1|>tail<|scan:2|><|end|>")
    assert [(a["turn"], a["type"], a["number"], a["uri"], a["tokens"]) for a in row["attachments"]] == [(0, "image", 0, "s3://a.png", 576), (0, "audio", 1, "b.wav", 12), (0, "scan", 2, "c", 0), (1, "image", 3, "s3://a.png", 576)]
    assert row["n_tokens_expanded"] == 1164
    assert [chat.unescape(row["formatted"][x["start"] : x["end"]]) for x in row["loss"]] == ["see <|", "and"]


# 8 SimHash


def slow_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints, distance):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_simhash(spark):
    rows = [(i, prose(i, 30), "s") for i in range(40)] + [(100 + i, prose(i, 30).upper(), "s") for i in range(5)]
    rows += [(200 + i, prose(1, 400) + f" end{i}", "s") for i in range(20)] + [(300, None, "s"), (301, " \n", "s"), (302, "one two", "s"), (303, "ONE two", "s"), (None, prose(3, 30), "s"), (7, prose(7, 30), "s"), (None, "no id at all", None)]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = {(i, t): slow_fingerprint(t, 4) for i, t, _ in rows}
    groups = slow_components(set(prints.values()), 4)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    wanted = sorted(str((i, prints[i, t], least.get(groups[prints[i, t]]))) for i, t, _ in rows)
    assert wanted == sorted(str((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in found)
    kept = simhash.survivors(docs(spark, rows), shingle=4)
    assert sorted(x["doc_id"] for x in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(least.values())) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_survivors_of_repeated_and_missing_ids(spark):
    a, b = prose(1, 40), prose(2, 40)
    keep = lambda rows: sorted(((r["doc_id"], r["text"]) for r in simhash.survivors(docs(spark, [(i, t, "s") for i, t in rows])).collect()), key=str)
    assert keep([(1, a), (1, b)]) == sorted([(1, a), (1, b)], key=str)
    assert keep([(1, a), (None, a), (None, b)]) == sorted([(1, a), (None, b)], key=str)
    assert keep([(None, a), (None, a), (None, b), (None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert keep([(3, a), (2, a), (2, a), (5, None), (4, None)]) == sorted([(2, a), (4, None)], key=str)


def test_pivot_table(spark):
    """No near pair is discarded, and nearly all far ones are; more blocks give the same components."""
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(300)]
    pairs = [(simhash.signed(x), simhash.signed(y)) for x in prints for y in (r.choice(prints), x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))]
    found = simhash.discards(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "x long, y long")).first()
    assert found["pairs"] - found["near"] >= found["by_all"] >= 0.99 * (found["pairs"] - found["near"]) and found["near"] >= 290
    table = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long").distinct()
    six, eight = (sorted(map(tuple, simhash.link(table, Scratch(spark, "t"), 4, n).collect())) for n in (6, 8))
    assert six == eight and len(six) >= 590


def test_simhash_links(spark):
    """Dense clusters, chains and far pairs, over many random fingerprints."""
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(150)}
    for seed in list(prints)[:12]:
        x = seed
        for _ in range(12):
            for _ in range(r.choice((1, 2, 4, 5))):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {x["node"]: x["root"] for x in simhash.link(table, Scratch(spark, "t")).collect()}
    mine, wanted = {}, {}
    for p in prints:
        mine.setdefault(got.get(simhash.signed(p), simhash.signed(p)), set()).add(p)
    for p, root in slow_components(prints, 4).items():
        wanted.setdefault(root, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    table = spark.createDataFrame(edges * 2 + [(None, 5)], "u long, v long")
    got = {x["node"]: x["root"] for x in components(table, Scratch(spark, "t"), "c").collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: x for n, x in root.items() if n != 300}
    assert components(table.where("false"), Scratch(spark, "t"), "c").count() == 0


# 9 neighbours


def test_neighbours(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(700)] + [(700 + i, [float(v) for v in x[40]], 0) for i in range(30)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (920, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [1.0], 0), (None, [1.0] * 16, 0), (940, [float("inf")] + [0.0] * 15, 0), (5, [float(v) for v in x[5]], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    found = neighbours.Index(table).search(table.where("vec_id % 20 = 0")).collect()
    rows.append((904, [1.0] + [0.0] * 15, 0))  # a shorter vector ends in zeros
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    hits = total = 0
    for q in sorted({r["query_id"] for r in found}):
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        s = m @ m[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(abs(r["score"] - s[ids.tolist().index(r["vec_id"])]) < 1e-12 for r in got)
        hits += len({r["vec_id"] for r in got} & {ids[i] for i in order})
        total += 20
    assert {r["query_id"] for r in found} == {int(i) for i in ids if i % 20 == 0} and hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.Index(few).search(few.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert neighbours.Index(few.where("false")).search(few).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.0, 0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.Index(mixed).search(mixed.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (3, 0.5), (2, 0.0)]
    short = neighbours.Index(mixed.where("vec_id BETWEEN 1 AND 2")).search(mixed.where("vec_id IN (0, 3)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in short] == [(0, 1, 1.0), (0, 2, 0.0), (3, 1, 0.5), (3, 2, 0.0)]


def test_recall_on_random_vectors(spark):
    """Vectors without any structure in 64 dimensions: the worst case. Queries that are rows, and others."""
    g = np.random.default_rng(5)
    x = g.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    new = g.standard_normal((60, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(6000)], "vec_id long, embedding array<float>")
    index = neighbours.Index(rows)
    asked = spark.createDataFrame([(10_000 + i, new[i].tolist()) for i in range(60)], "vec_id long, embedding array<float>").unionAll(rows.where("vec_id % 20 = 0"))
    hits, met, n = 0, 0, 0
    for q, r in index.search(asked).toPandas().groupby("query_id"):
        s = x.astype(np.float64) @ (x[q] if q < 6000 else new[q - 10_000]).astype(np.float64)
        if q < 6000:
            s[q] = -9
        hits, met, n = hits + len(set(np.argsort(-s)[:20]) & set(r["vec_id"])), met + r["met"].iloc[0], n + 1
    assert n == 360 and hits / (20 * n) >= 0.9 and met / n < 0.5 * 6000


# 10 quality


def test_label_model():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.8
    accuracy = (0.95, 0.9, 0.8, 0.7, 0.6)
    seen = ["".join("-" if r.random() < 0.2 else "g" if (r.random() < a) == t else "b" for a in accuracy) for t in truth]
    patterns, at, counts = np.unique(seen, return_inverse=True, return_counts=True)
    posterior, rates = quality.fit_labels(patterns.tolist(), counts.astype(float))
    assert ((posterior[at] > 0.5) == truth).mean() > 0.93
    assert np.allclose(rates[:, 1, 1], accuracy, atol=0.06)
    assert quality.fit_labels([], np.zeros(0))[0].shape == (0,)


def test_label_model_is_the_plain_one():
    """The same posteriors as expectation-maximisation written as loops over documents."""
    r = random.Random(9)
    docs_ = ["".join(r.choice("gggb-" if i % 4 else "bbg--") for _ in range(5)) for i in range(120)]
    patterns = sorted(set(docs_))
    found, _ = quality.fit_labels(patterns, np.array([docs_.count(p) for p in patterns], float), 25)
    post = {p: (0.2 / p.count("b") if "b" in p else 0.9 if "g" in p else 0.5) for p in patterns}
    for _ in range(25):
        rate = {}
        for k in range(5):
            for c in (0, 1):
                cast = {v: 0.5 + sum((post[d] if c else 1 - post[d]) for d in docs_ if d[k] == v) for v in "bg"}
                rate[k, c] = {v: n / sum(cast.values()) for v, n in cast.items()}
        prior = (sum(post[d] for d in docs_) + 1) / (len(docs_) + 2)
        weigh = lambda p, c: (prior if c else 1 - prior) * float(np.prod([rate[k, c][v] for k, v in enumerate(p) if v != "-"]))  # noqa: B023, E731
        new = {p: weigh(p, 1) / (weigh(p, 0) + weigh(p, 1)) for p in patterns}
        if max(abs(new[p] - post[p]) for p in patterns) < 1e-9:
            break
        post = new
    assert np.allclose(found, [post[p] for p in patterns], atol=1e-6)


def test_quality(spark):
    r = random.Random(6)
    good = [(i, ". ".join(prose(100 * i + k, 12).capitalize() for k in range(r.randrange(2, 9))) + ".", "s") for i in range(150)]
    bad = [(500 + i, " ".join(w + r.choice(["###", "%%%"]) for w in prose(i, 80).split()), "s") for i in range(25)] + [(600 + i, ("spam " * 90) + prose(i, 9), "s") for i in range(25)]
    odd = [(700, None, "s"), (701, " \n ", None), (702, good[0][1] + " You idiot.", "s"), (None, good[1][1], "s"), (0, good[0][1], "s"), (703, good[2][1] * 300, "s")]
    rows = {}
    for x in quality.judge(docs(spark, good + bad + odd)).collect():
        rows.setdefault(x["doc_id"], x["quality_verdict"])
    assert sum(rows[i]["keep"] for i, _, _ in good) >= 0.98 * len(good) and sum(not rows[i]["keep"] for i, _, _ in bad) >= 0.95 * len(bad)
    assert not rows[700]["keep"] and not rows[701]["keep"] and rows[None]["keep"] and rows[703]["keep"] and rows[702]["insults"] == 1
    assert rows[700]["quality"] == 0.0
    kept = quality.kept(docs(spark, good + bad + odd))
    assert kept.columns == docs(spark, good[:1]).columns and kept.where("doc_id = 700").count() == 0
    assert quality.judge(docs(spark, [])).count() == 0
