"""Token ids as packed binary rows: best-fit decreasing, with a segment tree over the rows' free space.

Every text becomes ids of a public vocabulary (special tokens' names are ordinary text). A document longer than a row is cut into whole rows and a rest, without losing or
adding an id. Pieces are packed longest first, each into the row whose free space is smallest among those that hold it; the
row is found in a segment tree over free-space values, in time of the logarithm of the row length. A packed row has
its ids and the position of each id within its piece (starting at 0 with every piece) as little-endian binary, the
cumulative lengths of its pieces, and for each piece its document and its offset there, from which documents can be put together again.

A task packs what it reads, in windows of at most WINDOW ids, and holds no more than a window. Documents do not move between
tasks: only a window's last rows can have free space that other windows' pieces might have filled.

Corner cases: null and empty texts have no ids and appear in no row. A document of exactly one row's length is a row of its own.
Very long texts are cut like any other, also such of white space alone; repeated rows are packed each by itself. A null doc_id is kept as null. An empty table gives an
empty one; other columns are ignored. Rows are numbered (shard, row), a shard being a task's window.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomtext.llm.bpe import PATTERN
from loomtext.llm.shared import fill_missing

ROW = 2048
#: White space (as Unicode has it) over which the encoder's pattern would run out of stack.
GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
WINDOW = 4_000_000
PACKED = "shard long, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in a file of base64 tokens and ranks; one per Python worker."""
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def unbroken(path: str) -> tiktoken.Encoding:
    """The same vocabulary with a pattern that takes a whole text as one word."""
    return tiktoken.Encoding("one word", pat_str="(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


def encoded(text: str, path: str) -> np.ndarray:
    """The ids of a text. Of a long gap, all white space but the last before a word is a word of its own, as the pattern has it, and is encoded apart."""
    enc, parts, at = vocabulary(path), [], 0
    for m in GAP.finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [enc.encode_to_numpy(text[at : m.start()], disallowed_special=()), unbroken(path).encode_to_numpy(text[m.start() : end], disallowed_special=())]
        at = end
    last = enc.encode_to_numpy(text[at:], disallowed_special=())
    return np.concatenate([*parts, last]) if parts else last


class FreeSpace:
    """A segment tree over free-space values 0..capacity: which values some open row has."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.some = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.some[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) with the least free space of at least need, no longer open."""
        at = need + self.size
        if not self.some[at]:
            while at & 1 or not self.some[at + 1]:  # up, till a right neighbour has some
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:  # down, to its least value
                at = 2 * at + (not self.some[2 * at])
        free = at - self.size
        while at:
            self.some[at] -= 1
            at >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of the numbers of pieces; pieces of equal length in their own order."""
    free, rows = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            left, row = capacity, len(rows)
            rows.append([])
        else:
            left, row = found
        rows[row].append(i)
        if left > lengths[i]:
            free.add(left - lengths[i], row)
    return rows


def _packed(window: list[tuple[int | None, np.ndarray]], shard: int, capacity: int, kind: str) -> pa.RecordBatch:
    """The rows of a window of (doc_id, ids)."""
    pieces = [(d, at, ids[at : at + capacity]) for d, ids in window for at in range(0, len(ids), capacity)]
    rows = best_fit_decreasing([len(ids) for _, _, ids in pieces], capacity)
    steps = np.arange(capacity, dtype=kind)
    columns = [[], [], [], [], [], []]
    for row in rows:
        own = [pieces[i] for i in row]
        lengths = [len(ids) for _, _, ids in own]
        columns[0].append(sum(lengths))
        columns[1].append(np.concatenate([ids for _, _, ids in own]).tobytes())
        columns[2].append(np.concatenate([steps[:n] for n in lengths]).tobytes())
        columns[3].append(np.cumsum([0, *lengths]).astype(np.int32))
        columns[4].append([d for d, _, _ in own])
        columns[5].append([at for _, at, _ in own])
    kinds = pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())
    arrays = [pa.array([shard] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PACKED.split(", ")])


def pack(docs: DataFrame, path: str, capacity: int = ROW, window: int = WINDOW) -> DataFrame:
    """The packed rows of all documents; ids and positions are uint16 where the vocabulary and rows allow it, else uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(path)
        kind = "<u2" if max(enc.n_vocab, capacity) <= 1 << 16 else "<u4"
        held, size, shard = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoded(text.as_py() or "", path)
                if not len(ids):
                    continue
                if size and size + len(ids) > window:
                    yield _packed(held, shard, capacity, kind)
                    held, size, shard = [], 0, shard + 1
                held.append((doc_id, ids.astype(kind)))
                size += len(ids)
        if held:
            yield _packed(held, shard, capacity, kind)

    return fill_missing(docs, doc_id="long", text="string").mapInArrow(run, PACKED)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Stores packed rows as Parquet, one binary cell a row of the id matrix, beside its segment lengths and position resets."""
    packed.write.mode("errorifexists").parquet(path)


def padded(row_ids: bytes, kind: str, capacity: int, pad: int) -> np.ndarray:
    """A row of the id matrix, filled up to the full length."""
    ids = np.frombuffer(row_ids, kind)
    return np.concatenate([ids, np.full(capacity - len(ids), pad, kind)])
