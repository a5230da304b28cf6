"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range, so it grows with its document and sketches merge by
union. Of two documents of very unequal length, the share of the smaller one's hashes that the larger one holds estimates
containment; intersection over union estimates likeness. Of short texts too few hashes lie below the fraction to tell anything, so least
(LEAST; 0: the plain fraction) gives how many of the smallest ones stay anyhow. The estimate is the same for all: each sketch knows the bound below which it is
complete, and two are compared up to the lower bound. Merging stays exact, as a union's smallest hashes are among the smallest of its parts.

The next document in order of id is found by one range shuffle, with as many ranges as the texts' bytes ask for. Quantiles of doc_id give the bounds;
an id that fills several ranges, and rows without id, are divided by their texts' hashes. The least document of each
range is also sent to the range before it (that of the first range to the last one), so no task needs another's rows.

Corner cases: a null text is the empty one, with no shingle and an empty sketch; a text with fewer words than a shingle is one shingle;
two empty sketches are alike (1.0), an empty and another one are not (0.0). Equal texts have equal sketches. A single document is
its own next one. Rows that share a doc_id follow each other in order of their texts' hashes; a null doc_id goes first. An empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.shared import Scratch, fill_missing

FRACTION = 1 / 16
#: Smallest hashes that stay in a sketch even if they are above the fraction.
LEAST = 32
#: Bytes of text for a task that compares neighbours in order of id, and ranges of ids that are dealt to it.
TASK_BYTES, RANGES = 32 << 20, 4
TOP = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15
#: A word's hash is a polynomial of its bytes in this base, mixed.
BASE = 0x100000001B3


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of the word shingles of texts; words are maximal runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.back = np.ones(1, np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _grow(self, n: int) -> None:
        while len(self.powers) <= n:
            size = len(self.powers)
            step, inverse = pow(BASE, size, 1 << 64), pow(BASE, -size, 1 << 64)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(step)])
            self.back = np.concatenate([self.back, self.back * np.uint64(inverse)])

    def sums(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and sums up to each byte, of which a part's own is (sums[end] - sums[start]) * back[start]."""
        raw = np.frombuffer(data.lower(), np.uint8)
        gap = np.empty(len(raw) + 2, bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = self.space[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, ends, np.zeros(1, np.uint64)
        self._grow(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        return starts, ends, sums

    def words(self, data: bytes) -> np.ndarray:
        """A hash of each word."""
        starts, ends, sums = self.sums(data)
        return _mixed((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)

    def shingles(self, data: bytes) -> np.ndarray:
        words = self.words(data)
        if not len(words):
            return words
        k = min(self.shingle, len(words))
        n, out = len(words) - k + 1, np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(ODD) + words[i : i + n]
        return _mixed(out)


class Sketch:
    """Sorted hashes, and the bound up to which they are all of the document's hashes."""

    __slots__ = ("bound", "hashes")

    def __init__(self, hashes: np.ndarray, threshold: int, least: int = LEAST):
        """Of distinct sorted hashes."""
        n = int(np.searchsorted(hashes, np.uint64(threshold)))
        self.hashes = hashes[: max(n, least)]
        self.bound = TOP if len(hashes) <= least else max([threshold - 1, *map(int, self.hashes[-1:])])

    def text(self) -> str:
        return self.hashes.astype(">u8").tobytes().hex()


def threshold(fraction: float) -> int:
    return min(TOP, int(fraction * 2.0**64))


def sketch(text: str | None, hasher: Hasher, below: int, least: int = LEAST) -> Sketch:
    return Sketch(np.unique(hasher.shingles((text or "").encode("utf-8", "replace"))), below, least)


def _common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Hashes in both, in a, in b, up to the bound that both reach."""
    bound = np.uint64(min(a.bound, b.bound))
    x, y = (s.hashes[: np.searchsorted(s.hashes, bound, "right")] for s in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimate of common shingles over all shingles of the two."""
    both, x, y = _common(a, b)
    return both / (x + y - both) if x + y else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimate of the share of a's shingles that b has."""
    both, x, y = _common(a, b)
    return both / x if x else 1.0 if not y else 0.0


def merge(a: Sketch, b: Sketch, below: int, least: int = LEAST) -> Sketch:
    """The sketch of both documents' shingles together."""
    bound = np.uint64(min(a.bound, b.bound))
    merged = np.union1d(a.hashes, b.hashes)
    out = Sketch(merged, below, least)
    if bound < np.uint64(TOP):
        out.hashes = out.hashes[: np.searchsorted(out.hashes, bound, "right")]
        out.bound = min(out.bound, int(bound))
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """doc_id, sketch array<long> (the hashes as signed longs, sorted as unsigned ones) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, below = Hasher(shingle), threshold(fraction)
        for batch in batches:
            found = [sketch(t.as_py(), hasher, below, least).hashes.view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    return fill_missing(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, sketch array<long>")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the start of another one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows dealt to ranges of doc_id: doc_id, text, part, guest.

    A guest is the first row of the next range, there to be looked at only. Rows of a range lie together, in order, the guest last.
    """
    spark = docs.sparkSession
    docs = fill_missing(docs, doc_id="long", text="string").withColumn("h", F.xxhash64("text"))
    whole = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["bytes"] or 0) // task_bytes))
    ranges = RANGES * tasks
    nameless = min(whole["nameless"], -(-ranges * whole["nameless"] // max(1, whole["n"])))  # ranges of rows without id
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    bounds = np.array(sorted(int(x) for x in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)), np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series, there: pd.Series, h: pd.Series) -> pd.Series:
        """Bounds below doc_id, and of those that equal it a share by the text's hash."""
        own, share = doc_id.to_numpy(np.int64), h.to_numpy(np.int64) / 2.0**64 + 0.5
        below, upto = np.searchsorted(bounds, own), np.searchsorted(bounds, own, "right")
        at = nameless + np.where(upto > below, np.minimum(below + 1 + (share * (upto - below)).astype(np.int64), upto), below)
        return pd.Series(np.where(there, at, np.minimum((share * nameless).astype(np.int64), max(0, nameless - 1))).astype(np.int32))

    placed = docs.withColumn("part", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), F.col("h")))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h")).alias("first")
    heads = Scratch(spark, "ranges").cut(placed.groupBy("part").agg(first), "heads")  # a row for each range
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    heads = heads.select("part", before.alias("before"), F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    guests = placed.join(F.broadcast(heads), "part").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    guests = guests.groupBy("before", "doc_id", "h").agg(F.min("text").alias("text")).select("doc_id", "text", "h", F.col("before").alias("part"), F.lit(True).alias("guest"))
    rows = placed.select("doc_id", "text", "h", "part", F.lit(False).alias("guest")).union(guests)
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "h", "text")
    return dealt.select("doc_id", "text", "part", "guest")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, shingle: int = 5, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """Of every row: the fingerprints of its text and of its edited text, and their likeness to each other and to the next row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, below = Hasher(shingle), threshold(fraction)
        held = None  # the row before: part, doc_id, text, sketch
        for batch in batches:
            out = []
            for doc_id, text, part, guest in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc_id, text, part, guest = doc_id.as_py(), text.as_py() or "", part.as_py(), guest.as_py()
                own = sketch(text, hasher, below, least)
                if held and held[0] == part:
                    _, last, before, theirs = held
                    changed = edited(before, text)
                    other = sketch(changed, hasher, below, least)
                    out.append((last, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), theirs.text(), other.text(), likeness(theirs, other), likeness(theirs, own)))
                held = None if guest else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return with_next(docs).mapInArrow(run, COLUMNS)
