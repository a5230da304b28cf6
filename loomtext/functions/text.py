"""Text of notes as columns: bodies, tokens, embedding texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Gives the tokens of a text column as an array column, for instance a pandas UDF around a morphological analyzer.
Analyzer = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Without white space at either end (trim() knows blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block between two lines of three dashes."""
    return F.regexp_replace(text, r"(?s)\A---\s*\r?\n.*?\r?\n---\s*(?:\r?\n|\z)", "")


def tokenize(text: Column, analyzer: Analyzer | None = None) -> Column:
    """Lower-cased words of two or more characters; an analyzer's tokens where it gives any."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1)
    plain = F.filter(F.transform(words, F.lower), lambda x: F.length(x) > 1)
    if analyzer is None:
        return plain
    own = analyzer(text)
    return F.when(F.size(own) > 0, own).otherwise(plain)


def query_tokens(query: Column, analyzer: Analyzer | None = None) -> Column:
    """Tokens of a query; of one without any, its blank-separated parts in lower case."""
    tokens = tokenize(query, analyzer)
    parts = F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != "")
    return F.when(F.size(tokens) > 0, tokens).otherwise(parts)


def lexical_terms(tokens: Column) -> Column:
    """The terms that lexical rows are filed under: tokens cut at underscores."""
    return F.filter(F.flatten(F.transform(tokens, lambda x: F.split(x, "_"))), lambda x: x != "")


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")


def spaced(text: Column) -> Column:
    return F.translate(text, "_-", "  ")


def basename_tokens(path: Column, analyzer: Analyzer | None = None) -> Column:
    return tokenize(spaced(stem(path)), analyzer)


def directory_tokens(path: Column, analyzer: Analyzer | None = None) -> Column:
    return tokenize(spaced(F.translate(folder(path), "/", " ")), analyzer)


def heading_tokens(heading_path: Column, analyzer: Analyzer | None = None) -> Column:
    return tokenize(F.array_join(heading_path, " "), analyzer)


def embedding_text(title: Column, heading_path: Column, content: Column) -> Column:
    """Title and headings joined by " > ", a blank line, the content."""
    return F.concat(F.array_join(F.concat(F.array(title), F.coalesce(heading_path, F.array().cast("array<string>"))), " > "), F.lit("\n\n"), content)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def chunk_key(path: Column, index: Column) -> Column:
    """One column that orders chunks by file, then by place."""
    return F.concat(path, F.lit("#"), F.lpad(index.cast("string"), 6, "0"))
