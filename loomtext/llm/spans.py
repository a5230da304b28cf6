"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, and these at words that their neighbours choose, so that a passage is cut alike wherever it stands and whatever
is around it. The pieces (below also called sentences) tile the text exactly. At each starts a span: SENTENCES pieces, or as many
more as it takes to reach MIN_WORDS words. Spans depend on their own sentences alone, so a passage gives the same spans wherever it
stands. Their hashes are counted over all documents; of a repeated span the first occurrence (smallest doc_id, then
smallest position) stays, and every sentence that any other occurrence covers is removed.

Hashes are counted by aggregation, with partial sums before the shuffle; the repeated ones are joined back to their spans
by hash, where a very common passage is a skewed join key that Spark splits. Only documents that lose a sentence
are rebuilt.

Corner cases: a null text stays null and an empty one empty; a text without a whole span loses nothing. White space
and case do not count when sentences are compared. A passage repeated within one document stays once. Rows that share a doc_id are
told apart by their texts' hashes; rows equal in both are one document, and lose the same. Rows without doc_id come last.
An empty table gives an empty one. Other columns are kept as they are, whatever their names; only the report's own name is given up to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import Scratch, rows_at_once

SENTENCES = 2
MIN_WORDS = 15
#: Texts that a worker gets at once.
TEXTS = 1000
#: A sentence ends with the white space after . ! ? (and closing quotes), or with a line.
SENTENCE = re.compile(r"""[^.!?\n]*(?:[.!?]+["'”’)\]]*(?=\s|$)\s*|[.!?]+|\n\s*|$)""")
#: A word with the white space around it.
TOKEN = re.compile(r"\s*\S+\s*")
#: A sentence is cut after each word whose hash with the next one is the least of so many to either side; its ends count as less.
REACH = 4


def cuts(words: list[str], ends: np.ndarray) -> np.ndarray:
    """Which words of a text a piece ends with: ends (the numbers of sentences' last words), and those chosen by the REACH words to either side."""
    n = len(words)
    own = np.fromiter(map(zlib.crc32, [w.encode("utf-8", "replace") for w in words]), np.uint64, n)
    both = own * np.uint64(0x9E3779B97F4A7C15)
    both[:-1] ^= own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = ((both ^ (both >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    both[ends] = 0
    # the text starts after an end
    around = np.concatenate([np.zeros(REACH, np.uint64), both, np.zeros(REACH, np.uint64)])
    least = both.copy()
    for k in range(2 * REACH + 1):
        np.minimum(least, around[k : k + n], out=least)
    return least == both


def sentences(text: str) -> list[str]:
    """Pieces that make up the whole text: its sentences, cut as cuts() says."""
    whole = whole_sentences(text)
    words = [x.lower().split() for x in whole]
    upto = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    if not upto[-1]:
        return whole
    at = np.flatnonzero(cuts([w for ws in words for w in ws], upto[1:][np.diff(upto) > 0] - 1)) + 1
    first, out = np.searchsorted(at, upto).tolist(), []
    for k, sentence in enumerate(whole):
        n = first[k + 1] - first[k]
        if n < 1 or len(words[k]) < 2:
            out.append(sentence)
            continue
        inner = (at[first[k] : first[k + 1]] - upto[k]).tolist()
        inner = [x for x in inner if 0 < x < len(words[k])]
        if not inner:
            out.append(sentence)
            continue
        tokens = TOKEN.findall(sentence)
        out += ["".join(tokens[a:b]) for a, b in zip([0, *inner], [*inner, len(tokens)], strict=True)]
    return out


def whole_sentences(text: str) -> list[str]:
    """Sentences that make up the whole text."""
    out, held = [], []
    for m in SENTENCE.finditer(text):
        piece = m[0]
        if not piece:
            continue
        held.append(piece)
        if piece[-1].isspace() or m.end() == len(text):
            out.append("".join(held))
            held = []
    if held:
        out.append("".join(held))
    return out


def spans(pieces: list[str], least: int, min_words: int) -> list[tuple[int, int, int]]:
    """(first sentence, sentences, hash) of every span."""
    words = [p.lower().split() for p in pieces]
    counts = np.array([len(w) for w in words], np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    lines = [" ".join(w).encode("utf-8", "replace") for w in words]
    # the smallest end by words, not before the smallest by sentences
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words), np.arange(len(pieces)) + least)
    out = []
    for i, end in enumerate(ends.tolist()):
        if end > len(pieces):
            break
        if lines[i]:
            h = xxhash.xxh3_64_intdigest(b"\n".join(x for x in lines[i:end] if x))
            out.append((i, end - i, h - (1 << 64) if h >> 63 else h))
    return out


#: A row's own key: its doc_id (last, if it has none) and its text's hash.
KEY = ["id_1", "id_2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as one column, with each row's key."""
    ident, text = F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)), docs["text"].cast("string")
    return docs.select(F.struct("*").alias("span_row"), text.alias("span_text"), ident.alias("id_1"), F.xxhash64(text).alias("id_2"))


def repeated(docs: DataFrame, scratch: Scratch, least: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """id_1, id_2, cover (array of first sentence and number of sentences) of the documents that lose some."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row = [spans(sentences(text.as_py() or ""), least, min_words) for text in batch.column(0)]
            row = np.repeat(np.arange(len(of_row)), [len(x) for x in of_row])
            at, n, hashes = (np.fromiter((s[k] for x in of_row for s in x), kind, len(row)) for k, kind in enumerate((np.int32, np.int32, np.int64)))
            keys = [batch.column(k).to_numpy()[row] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, at, n, hashes)], [*KEY, "at", "n", "hash"])

    texts = _keyed(docs).select("span_text", *KEY)
    with rows_at_once(docs.sparkSession, TEXTS):
        found = scratch.cut(texts.mapInArrow(cut, "id_1 long, id_2 long, at int, n int, hash long"), "spans")
    place = F.struct(*KEY, "at")
    common = scratch.cut(found.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "common")
    hits = scratch.cut(found.join(common, "hash"), "hits")
    first = scratch.cut(hits.groupBy("hash").agg(F.min(place).alias("first")), "first")
    later = hits.join(first, "hash").where(place != F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("cover"))


def remove_repeats(docs: DataFrame, least: int = SENTENCES, min_words: int = MIN_WORDS, report: str | None = None) -> DataFrame:
    """The columns of docs with the text that is left; report names a struct column beside them: removed (pieces) and words.

    A column of docs that has the report's name gives way to it. Texts that lose nothing are not cut again.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    cover = scratch.cut(repeated(docs, scratch, least, min_words), "cover")

    @F.pandas_udf("text string, removed int, words int")
    def rest(texts, covers):
        import pandas as pd

        rows = []
        for text, cover in zip(texts, covers, strict=True):
            if text is None or cover is None:
                rows.append((None, 0, 0))
                continue
            pieces = sentences(text)
            gone = np.zeros(len(pieces) + 1, np.int64)
            for x in cover:
                gone[x["at"]] += 1
                gone[x["at"] + x["n"]] -= 1
            gone = np.cumsum(gone)[: len(pieces)] > 0
            lost = [p for p, g in zip(pieces, gone, strict=True) if g]
            left = "".join(p for p, g in zip(pieces, gone, strict=True) if not g)
            rows.append((left, len(lost), sum(len(p.split()) for p in lost)))
        return pd.DataFrame(rows, columns=["text", "removed", "words"])

    lost = F.col("cover").isNotNull()
    rows = _keyed(docs).join(cover, KEY, "left").withColumn("span_rest", rest(F.when(lost, F.col("span_text")), "cover"))
    text = F.when(lost, F.col("span_rest.text")).otherwise(F.col("span_text"))
    kept = [text.alias(c) if c == "text" else F.col(f"span_row.`{c}`") for c in docs.columns if c != report]
    return rows.select(*kept, *([F.struct("span_rest.removed", "span_rest.words").alias(report)] if report else []))
