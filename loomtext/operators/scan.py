"""Reading notes directly: line search by pattern, and whole notes by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import scope

#: Limits of a line search and of a read.
PATTERN_CHARS, NOTE_BYTES, NOTES, LINES_PER_NOTE, LINES, LINE_CHARS = 200, 512 * 1024, 2000, 10, 100, 300
READ_CHARS = 40_000


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")


def grep_notes(notes: DataFrame, pattern: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """file_path, line_no, line: the first matching lines, in order of path and line, within the limits of a search.

    Globs are plain shell patterns here, so "**/*.md" needs a folder. Notes without a match are dropped before
    their lines are exploded; only a note's first lines, and of these the first overall, go on.
    """
    if not 0 < len(pattern) <= PATTERN_CHARS:
        raise ValueError(f"a pattern has 1 to {PATTERN_CHARS} characters")
    path = F.col("file_path")
    inside = scope._any(path, include, scope.raw_fnmatch) & ~scope._any(path, exclude, scope.raw_fnmatch)
    first = notes.where(inside).select("file_path").orderBy("file_path").limit(NOTES)
    looked = notes.select("file_path", "text").join(first, "file_path", "left_semi").where(F.octet_length("text") <= NOTE_BYTES)
    lines = looked.where(F.exists(_lines(F.col("text")), lambda x: x.rlike(pattern))).select("file_path", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    found = lines.where(F.col("line").rlike(pattern))
    w = Window.partitionBy("file_path").orderBy("at")
    few = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= LINES_PER_NOTE)
    first = few.orderBy("file_path", "at").limit(LINES)
    return first.select("file_path", (F.col("at") + 1).alias("line_no"), F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, LINE_CHARS).alias("line"))


def read_notes(paths: DataFrame, notes: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, status (ok, invalid_path, excluded, out_of_scope, not_found), content, heading of every requested path."""
    raw = F.regexp_replace("path", r"\\", "/")
    bad = F.col("path").isNull() | (F.trim(raw) == "") | raw.startswith("/") | raw.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(raw, "/"), "..")
    left_out = scope._any(raw, exclude, scope.raw_fnmatch)
    outside = ~scope._any(raw, include, scope.raw_fnmatch)
    found = paths.join(notes.select(F.col("file_path"), "text"), raw == F.col("file_path"), "left")
    status = F.when(bad, "invalid_path").when(left_out, "excluded").when(outside, "out_of_scope").when(F.col("file_path").isNull(), "not_found").otherwise("ok")
    content = F.when(status == "ok", F.substring(F.coalesce("text", F.lit("")), 1, READ_CHARS))
    return found.select("path", status.alias("status"), content.alias("content"), F.regexp_extract(content, r"(?m)^\s*#+\s*(.*)$", 1).alias("heading"))
