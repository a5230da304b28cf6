"""Filter audit, license scan and whitening against brute force, and their corner cases."""

from __future__ import annotations

import math
import os
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from loomtext.llm import audit, licenses, whitening

DOCS = "doc_id long, text string, source string, mask int, part string, bit int, words string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """rows of (doc_id, text, source); the other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, s, 1, "p", 2, "w") for i, t, s in rows], DOCS)


# 11 audit


def audited(rows, good, toxic):
    """The report, by applying each order's filters one after the other."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = {
        "A": lambda i, t: len(words(t)) < 50,
        "B": lambda i, t: 100 * len(set(words(t))) < 65 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda i, t: i is not None and any(j is not None and j < i and u == t for j, u, _ in rows),
    }
    out, removed = {}, {}
    for part in {s for _, _, s in rows}:
        own = [(i, {f for f in fails if fails[f](i, t)}) for i, t, s in rows if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                all_fail = sum(f in x for _, x in own)
                out[part, order, step] = (len(left), len(gone), all_fail - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                removed[part, f] = removed.get((part, f), 0) + len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def reported(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit_against_brute_force(spark):
    r = random.Random(1)
    pool = [" ".join(r.choice("abcdefgh") + r.choice(["", "X", "#", "y", "ä"]) + str(r.randrange(60)) for _ in range(r.choice([10, 49, 50, 90]))) for _ in range(12)]
    rows = [(i, r.choice(pool), r.choice(["s", "t", None, ""])) for i in range(60)]
    rows += [(None, pool[0], "s"), (None, pool[0], "s"), (5, pool[1], "t"), (5, pool[1], "t"), (5, pool[2], "t"), (70, None, "s"), (71, "", None), (72, " \n\t", "s"), (73, "w" + " word" * 60_000, "long")]
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 0), (999, 1, 1), (6, None, None)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(docs(spark, rows), labelled)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert reported(found) == audited(rows, good, toxic)


def test_audit_relations_and_corner_cases(spark):
    rows = [(1, "a " * 60, "s"), (2, "a " * 60, "s"), (3, " ".join(map(str, range(60))), "s"), (4, "# x", "s")]
    found = audit.Audit(docs(spark, rows))
    assert sorted(r["doc_id"] for r in found.survivors("BE").collect()) == [3, 4]
    assert [r["doc_id"] for r in found.removed("B", "A").collect()] == [4]
    assert found.removed("B", "E").count() == 0 and found.removed("", "E").count() == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs(spark, []), none).count() == 0
    bare = audit.audit(spark.createDataFrame([("x",), (None,)], "text string"), none)
    assert {r["part"] for r in bare.collect()} == {""} and bare.where("filter_order = 'ABCDE' AND step = 1").first()["removed"] == 2
    with pytest.raises(ValueError):
        audit.Audit(docs(spark, rows), {c: audit.text_filters()["A"] for c in "FGHIJKL"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_audit_oracle(spark):
    from loomtext.llm import queries

    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = queries.op11_filter_audit(spark, SF)
    wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES['op11_filter_audit']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


# 12 licenses


def phrased(text):
    """n_words, n_base, first_word, last_word and base_labels, by comparing words at every place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(k, label) for k in range(len(words)) for phrase, label in licenses.PHRASES if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def resolved(found, rules):
    """What stays, by comparing every detection with all that are stronger."""
    out = []
    for d in sorted(found, key=lambda d: (rules[d.rule].priority, d.start - d.end, d.start, d.rule)):
        if not any(k.start <= d.start and d.end <= k.end or d.start <= k.start and k.end <= d.end for k in out):
            out.append(d)
    return sorted(out)


TEXTS = [
    None,
    "",
    " \n",
    "Released under the MIT License.",
    "UNDER-THE\n * mit_license; under the mit licenses; under the ämit license",
    "Licensed under the Apache License, Version 2.0. Apache License version 2 apache license version 21",
    "cc by nc cc by nc-by-nc CC-BY-NC-SA 4.0",
    "KK under the mit Kicense \x00under\x7fthe\x01mit[license]",
    "GNU Lesser General Public License version 2.1, or the GPL",
    "word " * 50_000 + "under the mit license " * 30_000,
]


def test_licenses_against_brute_force(spark):
    r = random.Random(2)
    pieces = "under the mit license apache version 2 0 cc by nc sa 4 gnu general public lesser gpl , \n licensed x".split(" ")
    texts = TEXTS + [" ".join(r.choice(pieces) for _ in range(200)) for _ in range(30)]
    rows = licenses.scan(docs(spark, list(enumerate(texts, 0)) and [(i, t, "s") for i, t in enumerate(texts)]), details=True).collect()
    assert len(rows) == len(texts)
    some = licenses.rules()
    scanner = licenses.Scanner(some)
    for row in rows:
        text = texts[row["doc_id"]]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == phrased(text)
        labels = row["labels"].split(",") if row["labels"] else []
        assert labels == sorted(set(labels)) and set(row["base_labels"].split(",")) - {""} <= set(labels)
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(labels)
        if len(text or "") < 10_000:
            words = licenses.folded((text or "").encode())[1]
            # without the automaton every rule is tried
            plain = sorted(licenses.Found(*m.span(), i) for i, rule in enumerate(some) for m in re.finditer(f"(?<![^ ])(?:{rule.pattern})(?![^ ])", words))
            assert scanner.detect(words) == plain
            stay = resolved(plain, some)
            assert scanner.resolve(plain) == stay
            assert [(d["label"], d["first_word"]) for d in row["detections"] if d["kept"]] == [(some[d.rule].label, words.count(" ", 0, d.start)) for d in stay]
            weights = {}
            for rule in [some[d.rule] for d in stay] + [some[d.rule] for d in plain if d.rule < len(licenses.PHRASES)]:
                weights[rule.label] = max(weights.get(rule.label, 0), rule.weight)
            assert row["score"] == pytest.approx(1 - math.prod(1 - w for w in weights.values()))


def test_license_labels(spark):
    wanted = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc,cc-by-nc-4",
        "See https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa-3",
        "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software": "mit",
        "All Rights Reserved": "all-rights-reserved",
        "a sweeping statement on public licensing of dogs": "",
    }
    found = licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(wanted)]))
    assert [r["labels"] for r in found.orderBy("doc_id").collect()] == list(wanted.values())
    assert len(licenses.rules()) > 300
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.scan(spark.createDataFrame([(1,)], "x long")).first()["n_words"] == 0
    own = licenses.Rule("house", "our house licen[cs]e", ("our house licen",), 1, 0.9)
    assert licenses.scan(docs(spark, [(1, "Our House Licence", "s")]), more=[own]).first()["labels"] == "house"


# 13 whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, x int")


def spectrum(rows):
    """n, sums and the sorted eigenvectors of the covariance, by a plain decomposition."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (x - 1_000_000) - (sums - 1_000_000 * n) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return x, n, sums, centred, values[order], columns[:, order]


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(3)
    data = (r.standard_normal((300, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [None] + [1.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    fitted = whitening.Whitener(vectors(spark, rows + bad), k=5)
    x, n, sums, centred, values, columns = spectrum(data)
    found = {(o["vec_id"], o["component"]): o for o in fitted.whitened().collect()}
    assert len(found) == 300 * 5
    flip = np.sign((fitted.components.vectors * columns[:, :5]).sum(axis=0))
    white = centred @ columns[:, :5] * flip / np.sqrt(values[:5])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    for (i, c), o in found.items():
        assert o["n"] == n and o["deviation"] == deviation[i]
        assert o["whitened"] == pytest.approx(white[i, c - 1], rel=1e-9, abs=1e-9)
        assert o["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert o["identity_error"] < 1e-9


def test_whitening_stops_when_converged(spark):
    r = np.random.default_rng(4)
    data = (r.standard_normal((200, 40)) * np.array([400.0 * 0.5**i for i in range(40)])).astype(np.float32)
    fitted = whitening.Whitener(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]), k=3)
    *_, values, columns = spectrum(data)
    assert fitted.components.steps < 40
    assert fitted.components.variances == pytest.approx(values[:3], rel=1e-10)
    assert np.abs((fitted.components.vectors * columns[:, :3]).sum(axis=0)) == pytest.approx([1, 1, 1], abs=1e-12)


def test_whitening_corner_cases(spark):
    def shape(rows, **options):
        out = whitening.Whitener(vectors(spark, rows), **options).whitened().collect()
        return len(out), {o["component"] for o in out}

    assert shape([]) == (0, set())
    assert shape([(1, None), (2, [])]) == (0, set())
    assert shape([(1, [0.1, 0.2])]) == (0, set())
    assert shape([(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.1, 0.2])]) == (0, set())
    # three rows in four dimensions: two directions; ids repeat and lack
    rows = [(1, [1.0, 0.0, 0.0, 2.0]), (1, [0.0, 1.0, 0.0, 2.0]), (None, [0.0, 0.0, 1.0, 2.0])]
    out = whitening.Whitener(vectors(spark, rows)).whitened().collect()
    assert len(out) == 6 and sum(o["vec_id"] is None for o in out) == 2
    assert all(o["identity_error"] < 1e-9 for o in out) and sum({o["component"]: o["explained"] for o in out}.values()) == pytest.approx(1)
    big = whitening.Whitener(vectors(spark, [(1, [1e6, 0.0]), (2, [-1e6, 1.0])]))
    assert {o["deviation"] for o in big.whitened().collect()} == {(2 * 64_000_000) ** 2 + 64**2}
    with pytest.raises(Exception):
        whitening.Whitener(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0])])).whitened().collect()
    assert whitening.Whitener(spark.createDataFrame([(1,)], "vec_id long")).whitened().count() == 0
