"""URL filter: a weighted vocabulary found by Aho-Corasick, beneath rules for hosts and paths.

One automaton holds all terms with their weights. A term counts once, where neither neighbour in the URL is a letter or digit; a URL is rejected when
the weights of the different terms in it reach LIMIT. A strict term has that weight alone, a soft one half of it (or any other part), so that two
soft ones reject. The vocabulary is a table (term, weight, locale) that vocabulary() reads; without one, the small one below holds. It is sent to the tasks and
may have MOST_TERMS terms. A rule (host, path) fits its host and all
subdomains if the URL's path starts with the rule's; the longest fitting rule decides, and only without one the vocabulary.

Corner cases: a null URL, an empty one and one without "://" have an empty host and path and fit no rule; the last two are
still searched for terms, a null is allowed. Ports and user names are part of the host as written. Repeated rows give repeated
rows, an empty table an empty one; other columns are ignored. Equally long rules: the one given first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import fill_missing

#: The vocabulary.
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "poker", "porn", "porno", "sex", "spam", "torrent", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "crack", "deal", "discount", "farm", "free", "loan", "lottery", "pills", "prize", "promo", "track", "win")
SOFT_HITS = 2
#: Weight from which a URL is rejected, and terms a vocabulary may have, at most.
LIMIT, MOST_TERMS = 1.0, 500_000
WEIGHTS = tuple((t, LIMIT) for t in STRICT) + tuple((t, LIMIT / SOFT_HITS) for t in SOFT)
#: The rules of the query, (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def vocabulary(terms: DataFrame, locales: tuple[str, ...] | None = None) -> tuple[tuple[str, float], ...]:
    """The terms of a table (term, weight, and if given locale: null fits all), lower-cased, each with its greatest weight, in order.

    Null and empty terms and weights that are null or not above 0 are left out. More than MOST_TERMS terms are refused, as every task holds them.
    """
    rows = fill_missing(terms, term="string", weight="double", locale="string").where("term <> '' AND weight > 0")
    if locales is not None:
        rows = rows.where(F.col("locale").isNull() | F.col("locale").isin(*locales))
    found = rows.groupBy(F.translate("term", ascii_uppercase, ascii_lowercase).alias("term")).agg(F.max("weight").alias("weight"))
    got = found.limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms")
    return tuple(sorted((r["term"], r["weight"]) for r in got))


@lru_cache(maxsize=4)
def _automaton(weights: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for term, weight in weights:
        auto.add_word(term, (term, weight))
    auto.make_automaton()
    return auto


def weight_of(url: str, auto: ahocorasick.Automaton) -> float:
    """The sum of the weights of the different terms in a URL."""
    low, seen = url.translate(UPPER), {}
    for end, (term, weight) in auto.iter(low) if len(auto) else ():
        start = end - len(term) + 1
        if not ((start and low[start - 1].isalnum()) or low[end + 1 : end + 2].isalnum()):
            seen[term] = weight
    return sum(seen.values())


def judge(pages: DataFrame, weights: tuple[tuple[str, float], ...] = WEIGHTS, limit: float = LIMIT, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, by_terms (what the vocabulary alone says) of every row."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(tuple(weights))
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                m = URL.match(url or "")
                host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
                by_terms = "block" if url and weight_of(url, auto) >= limit - 1e-9 else "allow"
                fit = next((r for r in ordered if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
                out.append((host, path, fit and fit[1] + fit[2], fit[0] if fit else by_terms, by_terms))
            columns = [pa.array(list(c), pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict", "by_terms"])

    return fill_missing(pages, page_id="long", url="string").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, by_terms string")
