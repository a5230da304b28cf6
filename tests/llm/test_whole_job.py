"""Cases that an operator once left out."""

from __future__ import annotations

import random
from itertools import combinations

from loomtext.llm import neighbours, quality, simhash, spans
from loomtext.llm.sketch import Hasher

DOCS = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return [f"word{r.randrange(5000)}" for _ in range(n)]


def edited(words, *places):
    return [f"edit{i}" if i in places else w for i, w in enumerate(words)]


def test_edited_copies_are_near_copies(spark):
    rows, alike = [], []
    for k in range(12):
        words = prose(k, 150 + 20 * k)
        n = len(words)
        near, far = edited(words, *range(20, n - 20, n // 3)), edited(words, *range(5, n - 5, 8))
        rows += [(10 * k + i, " ".join(w)) for i, w in enumerate((words, near, far))]
        alike.append(simhash.likeness(rows[-3][1], rows[-2][1], Hasher(5)))
        assert alike[-1] >= 0.8 > simhash.likeness(rows[-3][1], rows[-1][1], Hasher(5))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS)
    by_bits = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, 4).collect()}
    assert any(by_bits[10 * k + 1] != 10 * k for k in range(12))
    assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == sorted([10 * k + i for k in range(12) for i in (0, 2)] + [900])


def test_edits_in_different_places_make_no_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of one text that are alike to few others: those that are linked are found, and the pairs looked at don't grow with the group's square."""
    r = random.Random(5)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(120)], []
    for k in range(150):
        words = list(base)
        for at in r.sample(range(120), 6):
            words[at] = f"x{k}y{at}"
        rows.append((10 * k, " ".join(words), "s"))
        if k % 10 == 0:  # a partner with one edit more
            words[r.randrange(120)] = "z"
            rows.append((10 * k + 1, " ".join(words), "s"))
    looked_at, inner = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: looked_at.append(pairs.distinct().count()) or inner(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs).collect()}
    parent = {i: i for i, _, _ in rows}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t, _ in rows}
    prints = {i: simhash.fingerprint(t, 5) for i, t, _ in rows}
    for a, b in combinations(parent, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= simhash.LIKE * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert of == {i: top(i) for i in parent}
    assert looked_at[-1] <= 4 * len(rows), looked_at


def test_beams_are_not_listed_row_by_row_at_each_hop(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    listed, explode = [], neighbours.F.explode
    monkeypatch.setattr(neighbours.F, "explode", lambda c: listed.append(c) or explode(c))
    found = neighbours.Index(vectors, rounds=1).search(vectors.where("vec_id % 50 = 0"), k=5).collect()
    assert len(found) == 15 and not any(isinstance(c, str) and c == "ids" for c in listed)
    of = {x["vec_id"]: x["embedding"] for x in vectors.collect()}
    for q in (0, 50, 100):
        best = sorted((i for i in of if i != q), key=lambda i: (-sum(x * y for x, y in zip(of[q], of[i], strict=True)), i))[:5]
        assert [x["vec_id"] for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == q] == best


def test_passages_without_sentence_ends_are_found(spark):
    passage = " ".join(prose(99, 60))
    rows = [(i, " ".join([*prose(100 + i, 10 + 7 * i), passage, *prose(200 + i, 33 - 3 * i)])) for i in range(8)]
    twins = " ".join(prose(300, 400))
    found = {r["doc_id"]: r["text"] or "" for r in spans.remove_repeats(spark.createDataFrame([*rows, (20, twins), (21, twins + " end")], DOCS)).collect()}
    windows = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in ((i, t.split()) for i, t in found.items())}
    assert found[0] == rows[0][1] and found[20] == twins and len(found[21].split()) < 30
    assert all(not windows[i] & windows[k] for i in windows for k in windows if i < k)
    assert all("".join(spans.sentences(t)) == t for t in (passage, " a  b \n", "\n", "", "x " * 50, " " + passage + ". \x1c" + passage))


def test_toxic_words_of_any_language_are_learnt(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        words = [w + r.choice(("", "s", "en")) for w in prose(400 + i, 80)]
        if i % 3 == 0:
            for k in r.sample(range(80), 4):
                words[k] = r.choice(("achlich", "réeuxe", "boment")) + r.choice("abcdefg") * 2
        rows.append((i, " ".join(words) + "."))
    docs = spark.createDataFrame([*rows, (None, "no id"), (900, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["quality_verdict"] for r in quality.judge(docs, labels=labels).collect()}
    held = {i: found[i]["toxic"] >= quality.TOXIC for i in range(200, 300)}
    assert sum(held[i] for i in held if i % 3 == 0) >= 30 and sum(held[i] for i in held if i % 3) <= 2
    assert not any(found[i]["keep"] for i in held if held[i]) and not any(v["insults"] for v in found.values())
    assert {r["toxic"] for r in quality.judge(docs).select("quality_verdict.toxic").collect()} == {0.0}


def test_pipeline_against_brute_force(spark, monkeypatch):
    """Every stage on a small table: each stage's output is what a plain loop over its own input gives."""
    import hashlib

    import tokenizers

    import corpus_pipeline
    from loomtext.llm import bpe, quality, simhash
    from loomtext.llm.sketch import Hasher

    from test_operators import filled, left_over, prose, slow_fingerprint, true_sets

    passage = "One passage of many words that stands in several places. It is copied from one text to the next, word for word. So it has to go!"
    text = lambda i, n=60: ". ".join(prose(50 * i + k, 12).capitalize() for k in range(n // 12)) + "."
    rows = [(i, text(i), "en", "abc"[i % 3]) for i in range(30)]
    rows += [(100 + i, text(i), "en", "b") for i in range(5)]  # exact copies
    rows += [(200 + i, text(i, 240), "en", "a") for i in range(4)] + [(210 + i, text(i, 240) + " One more word.", "en", "c") for i in range(4)]  # near copies
    rows += [(300 + i, text(70 + i) + " " + passage + " " + text(80 + i), "en", None) for i in range(4)]
    rows += [(400 + i, "### $$$ @@@ " * 30, "en", "a") for i in range(3)] + [(500, None, "en", "a"), (None, text(90), "en", "b"), (None, text(91), "en", "b")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), 7) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_row int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")

    kept = stages["quality"](spark, docs, "").collect()
    model = quality.fit(docs)
    for i, t, _, _ in rows:
        p = quality.profile(t, Hasher(1))
        at, values = quality.hashed(p) if len(p.words) else ([], [])
        good = len(p.words) > 0 and 1 / (1 + 2.718281828459045 ** -(sum(float(model.weights[a]) * v for a, v in zip(at, values, strict=True)) + model.bias)) >= quality.KEEP
        assert good == any(r["doc_id"] == i and r["text"] == t for r in kept), i
    assert not any(r["doc_id"] in (400, 401, 402, 500) for r in kept) and len(kept) >= 45

    now = spark.createDataFrame(kept, docs.schema)
    alone = stages["near_copies"](spark, now, "").collect()
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints, sets = [slow_fingerprint(r["text"], 5) for r in kept], [true_sets(r["text"]) for r in kept]
    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= simhash.LIKE * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for a, r in enumerate(kept):
        groups.setdefault(find(a), []).append(r)
    firsts = [min((r for r in g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert sorted(map(key, alone)) == sorted(map(key, firsts)) and len(alone) < len(kept)

    now = spark.createDataFrame(alone, docs.schema)
    rest = stages["passages"](spark, now, "")
    assert rest.columns == columns
    rest = rest.collect()
    order = [(k, r["text"]) for k, r in enumerate(sorted(alone, key=key))]
    wanted = left_over(order, 2, 15)
    assert sorted(r["text"] for r in rest if r["doc_id"] is not None) == sorted(wanted[k] for k, r in enumerate(sorted(alone, key=key)) if r["doc_id"] is not None)
    assert all(r["n_chars"] == len(r["text"]) and r["mix_row"] == 7 for r in rest) and sum(passage in r["text"] for r in rest) == 1

    now = spark.createDataFrame(rest, docs.schema)
    mixed = stages["mix"](spark, now, "").collect()
    sizes = {}
    for r in rest:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    targets = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        taken = sum(len(r["text"].split()) for r in mixed if r["source"] == s)
        assert abs(taken - targets[s]) <= max(len(r["text"].split()) for r in rest if r["source"] == s), s
    assert {key(r) for r in mixed} <= {key(r) for r in rest}

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    ends = stages["tokens"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    plain = sorted((r["doc_id"] or -1, library.encode(r["text"], add_special_tokens=False).ids, r["text"]) for r in mixed)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in ends) == [(i, ids) for i, ids, _ in plain]
    assert sorted(r["decoded_sha256"] for r in ends) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, _, t in plain)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name
