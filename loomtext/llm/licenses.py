"""License scan: ordered signature rules gated by keywords; overlapping detections are resolved by priority and containment.

A text is read as its words: ASCII letters lower-cased, runs of ASCII letters and digits and all other signs beyond ASCII, one blank between them; so case, line ends,
comment marks and punctuation make no difference, and a place is a word's number. Rules are regular expressions over that form which begin and end
at words and have a label, a priority (smaller is stronger), a weight and keywords, literals one of which stands in each of their matches. One automaton
of all keywords tells which rules can match at all, so most texts meet none.

Each rule is tried over the whole text. Detections whose intervals hold one another are a conflict, which the stronger priority wins, then the longer one,
then the one that begins first, then the rule that comes first; so "gnu lesser general public license version 2 1" is not the GPL too, and a tag beats the name around it. Detections that only
overlap partly, or touch, stay all. Runs of overlapping detections are resolved each on its own, so a text with a hundred thousand of them costs no more than its length.

The score is 1 minus the product of (1 - weight) over the different labels that stay, 0 without any.

Corner cases: a null text is an empty one, which has no words; texts of any length are read whole, in small batches. Repeated rows give repeated rows, an empty table an
empty one. Columns other than doc_id and text are ignored, missing ones count as null. Labels are sorted by code point, each once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import fill_missing


class Rule(NamedTuple):
    """keywords: literals one of which stands in each match."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


class Found(NamedTuple):
    """A detection, by places in the text's words."""

    start: int
    end: int
    rule: int


#: Phrases whose every place is counted, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Names of licenses as words: label, pattern of the name. The version belongs to the label.
NAMES = (
    ("mit", "mit (?:expat )?licen[cs]e|expat licen[cs]e|mit x11 licen[cs]e"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?|mit 0"),
    ("apache-1", "apache (?:software )?licen[cs]e(?: version)? 1 0"),
    ("apache-1.1", "apache (?:software )?licen[cs]e(?: version)? 1 1"),
    ("apache-2", "apache (?:software )?licen[cs]e(?: version)? v?2(?: 0)?|asl 2(?: 0)?|apache 2(?: 0)? licen[cs]e"),
    ("gpl-1", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?1(?: 0)?|gpl ?v?1"),
    ("gpl-2", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?2(?: 0)?|gpl ?v?2"),
    ("gpl-3", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?3(?: 0)?|gpl ?v?3"),
    ("lgpl-2", "(?:gnu )?(?:library|lesser) general public licen[cs]e(?: version| v)? v?2(?: 0)?|lgpl ?v?2"),
    ("lgpl-2.1", "(?:gnu )?(?:library|lesser) general public licen[cs]e(?: version| v)? v?2 1|lgpl ?v?2 1"),
    ("lgpl-3", "(?:gnu )?(?:library|lesser) general public licen[cs]e(?: version| v)? v?3(?: 0)?|lgpl ?v?3"),
    ("agpl-1", "affero general public licen[cs]e(?: version| v)? v?1(?: 0)?|agpl ?v?1"),
    ("agpl-3", "(?:gnu )?affero general public licen[cs]e(?: version| v)? v?3(?: 0)?|agpl ?v?3"),
    ("gfdl-1.1", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 1|gfdl ?v?1 1"),
    ("gfdl-1.2", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2|gfdl ?v?1 2"),
    ("gfdl-1.3", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3|gfdl ?v?1 3"),
    ("bsd-0", "zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?|free public licen[cs]e 1 0 0"),
    ("bsd-2-clause", "(?:bsd )?(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|(?:simplified|freebsd) bsd licen[cs]e|freebsd licen[cs]e"),
    ("bsd-3-clause", "(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:modified|revised|new) bsd licen[cs]e"),
    ("bsd-4-clause", "(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e"),
    ("isc", "isc licen[cs]e|internet systems consortium licen[cs]e"),
    ("mpl-1", "mozilla public licen[cs]e(?: version| v)? 1 0|mpl ?v?1 0"),
    ("mpl-1.1", "mozilla public licen[cs]e(?: version| v)? 1 1|mpl ?v?1 1"),
    ("mpl-2", "mozilla public licen[cs]e(?: version| v)? v?2(?: 0)?|mpl ?v?2(?: 0)?"),
    ("epl-1", "eclipse public licen[cs]e(?: version| v)? v?1(?: 0)?|epl ?v?1(?: 0)?"),
    ("epl-2", "eclipse public licen[cs]e(?: version| v)? v?2(?: 0)?|epl ?v?2(?: 0)?"),
    ("edl-1", "eclipse distribution licen[cs]e(?: version| v)? v?1(?: 0)?"),
    ("cddl-1", "common development and distribution licen[cs]e(?: version| v)? 1 0|cddl ?v?1 0"),
    ("cddl-1.1", "common development and distribution licen[cs]e(?: version| v)? 1 1|cddl ?v?1 1"),
    ("cpl-1", "common public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("ipl-1", "ibm public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("eupl-1.1", "european union public licen[cs]e(?: version| v)? 1 1|eupl ?v?1 1"),
    ("eupl-1.2", "european union public licen[cs]e(?: version| v)? 1 2|eupl ?v?1 2"),
    ("cecill-1", "cecill(?: licen[cs]e)?(?: version| v)? 1(?: 0)?"),
    ("cecill-2", "cecill(?: licen[cs]e)?(?: version| v)? 2 0"),
    ("cecill-2.1", "cecill(?: licen[cs]e)?(?: version| v)? 2 1"),
    ("cecill-b", "cecill b"),
    ("cecill-c", "cecill c"),
    ("artistic-1", "artistic licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("bsl-1", "boost software licen[cs]e(?: version| v)? 1(?: 0)?|boost licen[cs]e"),
    ("busl-1.1", "business source licen[cs]e(?: version| v)? 1 1"),
    ("zlib", "zlib (?:libpng )?licen[cs]e|zlib libpng"),
    ("libpng", "libpng licen[cs]e"),
    ("unlicense", "the unlicense|unlicense org"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e|wtfpl"),
    ("cc0-1", "cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?"),
    ("ofl-1.1", "sil open font licen[cs]e(?: version| v)?(?: 1 1)?|ofl 1 1"),
    ("odbl-1", "open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)?|odbl(?: 1 0)?"),
    ("odc-by-1", "open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?|odc by(?: 1 0)?"),
    ("pddl-1", "public domain dedication and licen[cs]e|pddl(?: 1 0)?"),
    ("psf-2", "python software foundation licen[cs]e(?: version| v)?(?: 2)?|psf licen[cs]e"),
    ("php-3.01", "php licen[cs]e(?: version| v)?(?: 3 01)?"),
    ("ruby", "ruby licen[cs]e"),
    ("perl", "(?:under )?(?:the )?same terms as perl(?: itself)?"),
    ("postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl licen[cs]e"),
    ("ssleay", "ssleay licen[cs]e"),
    ("curl", "curl licen[cs]e"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e|ncsa open source licen[cs]e"),
    ("ms-pl", "microsoft public licen[cs]e|ms pl"),
    ("ms-rl", "microsoft reciprocal licen[cs]e|ms rl"),
    ("afl-3", "academic free licen[cs]e(?: version| v)?(?: 3 0)?"),
    ("osl-3", "open software licen[cs]e(?: version| v)?(?: 3 0)?"),
    ("cpal-1", "common public attribution licen[cs]e"),
    ("apsl-2", "apple public source licen[cs]e(?: version| v)?(?: 2 0)?"),
    ("sspl-1", "server side public licen[cs]e(?: version| v)?(?: 1)?"),
    ("elastic-2", "elastic licen[cs]e(?: version| v)?(?: 2 0)?"),
    ("upl-1", "universal permissive licen[cs]e(?: version| v)?(?: 1 0)?"),
    ("blueoak-1", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("mulan-2", "mulan psl(?: v?2)?|mulan permissive software licen[cs]e(?: v?2)?"),
    ("vim", "vim licen[cs]e"),
    ("w3c", "w3c (?:software (?:notice and )?)?licen[cs]e"),
    ("x11", "x11 licen[cs]e|x consortium licen[cs]e"),
    ("hpnd", "historical permission notice and disclaimer"),
    ("json", "json licen[cs]e"),
    ("beerware", "beer ?ware licen[cs]e"),
    ("sleepycat", "sleepycat licen[cs]e"),
    ("zope-2.1", "zope public licen[cs]e(?: version| v)?(?: 2 1)?"),
    ("qpl-1", "q public licen[cs]e(?: version| v)?(?: 1 0)?"),
    ("lppl-1.3", "latex project public licen[cs]e(?: version| v)?(?: 1 3[ac]?)?"),
    ("naumen", "naumen public licen[cs]e"),
    ("nasa-1.3", "nasa open source agreement(?: 1 3)?"),
    ("openrail", "(?:creativeml )?openrail(?: [ms]{1,2})?(?: licen[cs]e)?|creativeml open rail(?: [ms]{1,2})?(?: licen[cs]e)?"),
    ("llama-2", "llama 2 community licen[cs]e(?: agreement)?"),
    ("llama-3", "llama 3 (?:[0-9] )?community licen[cs]e(?: agreement)?"),
    ("polyform-nc", "polyform noncommercial licen[cs]e(?: 1 0 0)?"),
    ("hippocratic-3", "hippocratic licen[cs]e(?: version| v)?(?: 3 0)?"),
    ("ogl-uk-3", "open government licen[cs]e(?: version| v)?(?: 3 0)?"),
    ("etalab-2", "licence ouverte(?: version| v)?(?: 2 0)?|etalab 2 0"),
    ("dl-de-by-2", "datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?"),
    ("cdla-permissive-2", "community data licen[cs]e agreement permissive(?: version| v)?(?: [12] 0)?"),
    ("cdla-sharing-1", "community data licen[cs]e agreement sharing(?: version| v)?(?: 1 0)?"),
)

#: Sentences of license texts: label, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("apache-2", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsl-1", "boost software licen[cs]e version 1 0 august 17th 2003"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e(?: v)? 2 0"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("public-domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain|this work is in the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential|confidential and proprietary|unauthorized copying of this file"),
)

#: Families whose version is not said, or that only hint: label, pattern.
FAMILIES = (
    ("apache", "apache licen[cs]ed?"),
    ("gpl", "(?:gnu )?general public licen[cs]e|gnu gpl|gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e|gnu agpl|agpl"),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e|gfdl"),
    ("bsd", "bsd (?:style )?licen[cs]e[ds]?"),
    ("mpl", "mozilla public licen[cs]e"),
    ("epl", "eclipse public licen[cs]e"),
    ("cddl", "common development and distribution licen[cs]e|cddl"),
    ("eupl", "european union public licen[cs]e|eupl"),
    ("artistic", "artistic licen[cs]e"),
    ("cecill", "cecill"),
    ("creative-commons", "creative commons(?: licen[cs]e)?"),
)

#: Creative Commons: terms beside BY, their words, and versions; all combinations make rules.
CC_TERMS = {"nc": "noncommercial|non commercial|nc", "nd": "noderivatives|noderivs|no derivatives|no derivs|nd", "sa": "sharealike|share alike|sa"}
CC_KINDS = ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: What says that a name is a grant: it makes the name's rule surer.
GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistribute it|use|used|free) (?:[^ ]+ ){0,3}?(?:under|by) (?:the )?(?:terms of )?(?:the )?"
#: Priorities, the strongest first, with their weights.
TAG, TEXT, GRANTED, NAMED, FAMILY = (1, 0.99), (2, 0.95), (3, 0.97), (4, 0.8), (5, 0.5)


def keywords(pattern: str) -> tuple[str, ...]:
    """For each alternative of a pattern the longest literal that stands in all of its matches."""
    flat, depth = [], 0
    for sign in pattern:  # alternatives within groups are not alternatives of the pattern
        depth += (sign == "(") - (sign == ")")
        flat.append("\n" if sign == "|" and not depth else sign)
    out = []
    for text in "".join(flat).split("\n"):
        text = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?", "\n", text)
        while (less := re.sub(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[^}]*\})*\??", "\n", text)) != text:
            text = less
        out.append(max(re.split(r"\n|.\?", text), key=len))
    return tuple(out)


def _rule(label: str, pattern: str, rank: tuple[int, float], grant: bool = False) -> Rule:
    """A rule for a pattern, or for the pattern after the words of a grant, which has the same keywords."""
    return Rule(label, f"{GRANT}(?:{pattern})" if grant else pattern, keywords(pattern), *rank)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: phrases, sentences, tags, grants and names, families."""
    out = [_rule(label, phrase, NAMED) for phrase, label in PHRASES]
    out += [_rule(label, pattern, TEXT) for label, pattern in SENTENCES]
    for label, pattern in NAMES:
        tag = " ".join(re.split("[-.]", label))
        out.append(_rule(label, f"spdx licen[cs]e identifier {tag}(?: 0)?(?: only| or later)?", TAG))
        out.append(_rule(label, pattern, GRANTED, grant=True))
        out.append(_rule(label, pattern, NAMED))
    for kind in CC_KINDS:
        label, short = "-".join(("cc", "by", *kind)), " ".join(("cc", "by", *kind))
        long = "creative commons attribution" + "".join(f" (?:{CC_TERMS[k]})" for k in kind)
        more = "(?: (?:international|unported|generic|licen[cs]e))*"
        for version in (None, *CC_VERSIONS):
            name, end = (label, "") if version is None else (f"{label}-{version.removesuffix(' 0').replace(' ', '.')}", f" {version}")
            if version:
                out.append(_rule(name, f"spdx licen[cs]e identifier {short}{end}", TAG))
                out.append(_rule(name, f"creativecommons org licen[cs]es {short.removeprefix('cc ')}{end}", TAG))
            out.append(_rule(name, f"{short}{end}|{long}{end}{more}", GRANTED, grant=True))
            out.append(_rule(name, f"{short}{end}|{long}{end}{more}", NAMED))
    out += [_rule(label, pattern, FAMILY) for label, pattern in FAMILIES]
    return tuple(out)


#: Bytes to their lower case, and what separates words to a blank; signs beyond ASCII are bytes from 128 on.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Scanner:
    """Rules made ready in a worker: one automaton of their keywords, and their expressions, compiled when first needed."""

    def __init__(self, some: Sequence[Rule]):
        self.rules = tuple(some)
        self.compiled: dict[int, re.Pattern] = {}
        by: dict[str, set[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule.keywords:
                by.setdefault(word, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for word, which in by.items():
            self.automaton.add_word(word, which)
        self.automaton.make_automaton()

    def detect(self, words: str) -> list[Found]:
        """Every place of every rule in a text's words, by start."""
        possible: set[int] = set()
        for which in {id(which): which for _, which in self.automaton.iter(words)}.values() if len(self.automaton) else ():
            possible |= which
        out = []
        for i in sorted(possible):
            if i not in self.compiled:
                self.compiled[i] = re.compile(f"(?<![^ ])(?:{self.rules[i].pattern})(?![^ ])")
            out += [Found(*m.span(), i) for m in self.compiled[i].finditer(words)]
        return sorted(out)

    def resolve(self, found: list[Found]) -> list[Found]:
        """What stays of detections sorted by start."""
        out, at = [], 0
        while at < len(found):
            upto, end = at + 1, found[at].end
            while upto < len(found) and found[upto].start < end:
                end = max(end, found[upto].end)
                upto += 1
            out += self._strongest(found[at:upto]) if upto > at + 1 else found[at:upto]
            at = upto
        return out

    def _strongest(self, run: list[Found]) -> list[Found]:
        """The same of one run of overlapping detections."""
        kept: list[Found] = []
        longest = max(d.end - d.start for d in run)
        for d in sorted(run, key=lambda d: (self.rules[d.rule].priority, d.start - d.end, d.start, d.rule)):
            near = kept[bisect_left(kept, d.start - longest, key=lambda k: k.start) : bisect_right(kept, d.end, key=lambda k: k.start)]
            if not any(k.start <= d.start and d.end <= k.end or d.start <= k.start and k.end <= d.end for k in near):
                insort(kept, d)
        return kept


@lru_cache(maxsize=4)
def _scanner(some: tuple[Rule, ...]) -> Scanner:
    return Scanner(some)


def folded(text: bytes | None) -> tuple[int, str]:
    """The number of words and the words of a text in UTF-8, one sign a byte."""
    words = (text or b"").translate(FOLD).split()
    return len(words), b" ".join(words).decode("latin-1")


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
DETECTION = "label string, first_word long, n_words long, priority int, weight double, kept boolean"


def scan(docs: DataFrame, more: Sequence[Rule] = (), details: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    more: rules of one's own, after the others. details: also detections, all that were found in order of place, with those that gave way (kept: false).
    """
    some = (*rules(), *more)
    base = {i: label for i, (_, label) in enumerate(PHRASES)}  # the phrases are the first rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(some)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                n, words = folded(text.as_py())
                found = scanner.detect(words)
                stay = scanner.resolve(found)
                places = [d for d in found if d.rule in base]
                starts = [words.count(" ", 0, d.start) for d in places[:1] + places[-1:]] or [None]
                own = {base[d.rule] for d in places}
                weights = {base[d.rule]: scanner.rules[d.rule].weight for d in places}
                for d in stay:
                    rule = scanner.rules[d.rule]
                    weights[rule.label] = max(weights.get(rule.label, 0.0), rule.weight)
                score = 1 - math.prod(1 - w for w in weights.values())
                row = (n, len(places), starts[0], starts[-1], ",".join(sorted(own)), ",".join(sorted(weights)), score)
                if details:
                    kept, at, before, rows = set(stay), 0, 0, []
                    for d in found:
                        before, at = before + words.count(" ", at, d.start), d.start
                        rule = scanner.rules[d.rule]
                        rows.append({"label": rule.label, "first_word": before, "n_words": words.count(" ", d.start, d.end) + 1, "priority": rule.priority, "weight": rule.weight, "kept": d in kept})
                    row += (rows,)
                out.append(row)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = RESULT + (f", detections array<struct<{DETECTION.replace(' ', ': ').replace(',:', ',')}>>" if details else "")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *(["detections"] if details else [])]
    found_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64()), ("kept", pa.bool_())]))
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), *([found_type] if details else [])]
    rows = fill_missing(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)
