"""Which paths belong to the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """With forward slashes, without empty and "." parts; null if nothing is given or a part is ".."."""
    raw = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+|/+$", "")
    parts = F.filter(F.split(raw, "/"), lambda x: ~x.isin("", "."))
    return F.when((raw != "") & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def benchmark_path(path: Column) -> Column:
    """As paths are compared in relevance cases: trimmed, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/")


def coverage_path(path: Column) -> Column:
    """As paths are compared in coverage lists: also without leading dots and slashes."""
    return F.regexp_replace(benchmark_path(path), r"^[./]+", "")


def _regex(pattern: str) -> str:
    """A shell pattern as a regular expression; a star crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[\\{inner}]" if inner[0] == "^" else f"[{inner}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def raw_fnmatch(path: Column, pattern: str) -> Column:
    return path.rlike(_regex(pattern))


def glob_match(path: Column, pattern: str) -> Column:
    """Shell pattern; a leading "**/" also fits the root, a trailing "/**" is everything below a folder."""
    path, pattern = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+|/+$", ""), pattern.replace("\\", "/").strip("/")
    if not pattern:
        return F.lit(False)
    found = raw_fnmatch(path, pattern)
    if pattern.startswith("**/"):
        found |= raw_fnmatch(path, pattern[3:])
    if pattern.endswith("/**"):
        root = pattern[:-3].rstrip("/")
        found |= (path == root) | path.startswith(f"{root}/")
    return found


def _any(path: Column, patterns: Iterable[str], match=glob_match) -> Column:
    return reduce(lambda a, b: a | b, (match(path, p) for p in patterns), F.lit(False))


def in_scope(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """A Markdown path that fits an included pattern and no excluded one."""
    return F.lower(path).endswith(".md") & _any(path, include) & ~_any(path, exclude)


def preview_scope(notes: DataFrame, include: Iterable[str], exclude: Iterable[str], shown: int = 30) -> DataFrame:
    """n_files and the first paths in order, one a row (n_files on each)."""
    inside = notes.where(in_scope(F.col("file_path"), include, exclude)).select("file_path")
    count = inside.agg(F.count("*").alias("n_files"))
    first = inside.orderBy("file_path").limit(shown)
    return first.join(F.broadcast(count))  # a single row
