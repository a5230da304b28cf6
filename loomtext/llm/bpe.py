"""Byte-level BPE: encodes and decodes whole texts.

A text is cut into words by the vocabulary's own word pattern. A short word is merged with a contiguous rank
array: the parts between boundaries and the rank of each adjacent pair lie in two rows; the smallest rank is looked
for, its boundary is deleted, and the two neighbouring ranks are refreshed, till no pair has a rank. The rows of many words
are stacked, so that each round is a few numpy calls. Long words (over LONG_WORD bytes), for which repeated scans would take
quadratic time, are merged from a heap of pairs in the same order: lowest rank first, then leftmost.

Documents never move: one pass over the table, Arrow batches to Python, and only ids (or their digests) back.
Corner cases: a null text is the empty text, with no ids; white space of any length, special tokens inside a
text, repeated rows and very long words are encoded like any other; an empty table gives an empty table; columns other
than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import string
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a word is merged by repeated scans.
LONG_WORD = 128
#: Pieces in a worker's table of pieces already encoded; when it is full, it takes the place of an older one of that size.
KEPT = 100_000
#: Rows whose results a task hands back at once.
ROWS = 1000
#: Words merged at once, and characters of texts encoded at once.
BLOCK, CHARS = 20_000, 1_000_000
NONE = (1 << 31) - 1

#: The word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters alone, where it needs no Unicode tables.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
ONLY_LATIN = re.compile(f"[\x00-\x1b\x20-\x7f{LATIN}]*")
LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: A space that starts a piece only if no white space follows.
WIDE_SPACE = re.compile(r" (?:\s|$)")
#: Signs that end a word of letters and are a word of their own.
SIGNS = frozenset(string.punctuation)

#: What is kept of a piece: its ids in decimal with a comma before each, and the bytes they stand for.
Entry = tuple[str, bytes]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ranks:
    """(left id, right id) -> rank, for arrays: a table with open addressing."""

    BITS = 18
    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        size = 1 << max(self.BITS, int(len(left)).bit_length() + 2)
        self.shift, self.last = np.uint64(65 - size.bit_length()), size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 20 | right
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = at + 1 & self.last
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.ODD >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none or either id is below 0."""
        keys = left.astype(np.int64) << 20 | right
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], np.int32(NONE))
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.last
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Encoder:
    """Encoder and decoder of one vocabulary file; one per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        bytes_of = {letter: b for b, letter in letters.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of_id = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of_id[i] = bytes(bytes_of[c] for c in token)
        for token, i in special.items():
            self.bytes_of_id[i] = token.encode()
        #: id -> itself in decimal, after a comma
        self.decimal = [f",{i}" for i in range(len(self.bytes_of_id))]
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1))
        self.ranks = Ranks(left, right)
        both = np.indices((256, 256), np.int32).reshape(2, -1)
        #: ranks of pairs of single bytes
        self.byte_ranks = self.ranks.of(self.first[both[0]], self.first[both[1]]).reshape(256, 256)
        #: rank -> id of the merged token
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = special
        self.splitter = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.signs = {c: self._entry([vocab[c]]) for c in SIGNS}
        self.unicode_words = regex.compile(PATTERN)
        #: Pieces already encoded: at the start of a text, and after a space; and those met before the last KEPT ones.
        self.known: list[dict[str, Entry]] = [{}, {}]
        self.older: list[dict[str, Entry]] = [{}, {}]

    def words(self, text: str) -> list[str]:
        return LATIN_PATTERN.findall(text) if ONLY_LATIN.fullmatch(text) else self.unicode_words.findall(text)

    def merge(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct words: short ones in blocks of like length, long ones each by itself."""
        coded = sorted(words, key=len)
        out: dict[bytes, list[int]] = {}
        while coded and len(coded[-1]) > LONG_WORD:
            b = coded.pop()
            out[b] = self._heap(self.first[np.frombuffer(b, np.uint8)].tolist())
        start = 0
        while start < len(coded):
            most = len(coded[start]) * 5 // 4 + 1
            end = min(start + BLOCK, bisect_right(coded, most, start, key=len))
            out.update(zip(coded[start:end], self._scan(coded[start:end]), strict=True))
            start = end
        return out

    def _scan(self, words: list[bytes]) -> list[list[int]]:
        """The contiguous rank array of many words at once: a row for each word, a column for each part or adjacent pair.

        A round looks for each row's smallest rank, deletes that boundary (so all live rows get one column shorter) and
        refreshes the ranks at its left and right. Rows without a rank are done and leave.
        """
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        beyond = np.arange(width) >= lengths[:, None]
        parts, ranks = self.first[codes], self.byte_ranks[codes[:, :-1], codes[:, 1:]]
        parts[beyond], ranks[beyond[:, 1:]] = -1, NONE
        rows, out = np.arange(len(words)), [[]] * len(words)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            live = least != NONE
            if not live.all():
                done = ~live
                for row, n, ids in zip(rows[done].tolist(), (parts[done] >= 0).sum(1).tolist(), parts[done].tolist(), strict=True):
                    out[row] = ids[:n]
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return out
            n, width = parts.shape
            parts[np.arange(n), at] = self.merged[least]
            column = np.arange(width)
            parts = parts[column != at[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[column[:-1] != at[:, None]].reshape(n, width - 2)
            if width > 2:
                k = np.flatnonzero(at > 0)
                ranks[k, at[k] - 1] = self.ranks.of(parts[k, at[k] - 1], parts[k, at[k]])
                k = np.flatnonzero(at < width - 2)
                ranks[k, at[k]] = self.ranks.of(parts[k, at[k]], parts[k, at[k] + 1])

    def _heap(self, parts: list[int]) -> list[int]:
        n, left = len(parts), np.array(parts, np.int32)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(self.ranks.of(left[:-1], left[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            near = [(x, after[x]) for x in (before[i], i) if x >= 0 and after[x] >= 0]
            if near:
                found = self.ranks.of(np.array([parts[x] for x, _ in near]), np.array([parts[y] for _, y in near])).tolist()
                for (x, y), rank in zip(near, found, strict=True):
                    if rank != NONE:
                        heapq.heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _cut(self, text: str) -> list[tuple[int, list[str]]]:
        """A text without special tokens as pieces that are encoded by themselves: (1 if a space goes before each, pieces).

        Every space before a letter or sign starts a word, so a text without wider gaps is cut there, and pieces seen before
        need no pattern and no merges. Elsewhere the pattern cuts the whole text.
        """
        if WIDE_SPACE.search(text):
            return [(0, self.words(text))]
        head, *rest = text.split(" ")
        return [(0, [head] if head else []), (1, rest)]

    def _entry(self, ids: list[int]) -> Entry:
        return "".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes_of_id.__getitem__, ids))

    def _learn(self, k: int, new: list[str]) -> None:
        """Encodes pieces not met so far into the table k.

        A piece of letters alone is one word, and letters with a sign at the end are two; only other pieces need the pattern.
        """
        known, older, space = self.known[k], self.older[k], b" " if k else b""
        whole: list[str] = []
        signed: list[str] = []
        others: dict[str, list[bytes]] = {}
        for p in new:
            if found := older.get(p):
                known[p] = found
            elif p.isalpha():
                whole.append(p)
            elif p[:-1].isalpha() and p[-1] in SIGNS:
                signed.append(p)
            else:
                others[p] = [w.encode() for w in self.words(" " + p if k else p)]
        known.update(self._merged(whole, [space + p.encode() for p in whole]))
        bare = list({p[:-1] for p in signed})
        found = {p: known.get(p) or older.get(p) for p in bare}
        bare = [p for p in bare if not found[p]]
        found.update(self._merged(bare, [space + p.encode() for p in bare]))
        for p in signed:
            word, sign = found[p[:-1]], self.signs[p[-1]]
            known[p] = word[0] + sign[0], word[1] + sign[1]
        ids = self.merge({w for ws in others.values() for w in ws})
        for p, ws in others.items():
            known[p] = self._entry([i for w in ws for i in ids[w]])

    def _merged(self, pieces: list[str], words: list[bytes]) -> Iterator[tuple[str, Entry]]:
        """Pieces that are a word each, with their entries."""
        ids = self.merge(words)
        return ((p, self._entry(ids[w])) for p, w in zip(pieces, words, strict=True))

    def entries(self, texts: list[str]) -> Iterator[list[Entry]]:
        """Each text, of those that fit into memory together, as the entries of its pieces in order."""
        cut: list[list] = []
        for text in texts:
            own, at = [], 0
            for m in self.splitter.finditer(text) if self.splitter else ():
                own += [*self._cut(text[at : m.start()]), self.special[m[0]]] if m.start() > at else [self.special[m[0]]]
                at = m.end()
            cut.append(own + self._cut(text[at:]) if at < len(text) else own)
        for k in (0, 1):
            if len(self.known[k]) > KEPT:
                self.older[k], self.known[k] = self.known[k], {}
            met = set().union(*(x[1] for own in cut for x in own if isinstance(x, tuple) and x[0] == k))
            self._learn(k, [p for p in met if p not in self.known[k]])
        known = [x.__getitem__ for x in self.known]
        for own in cut:
            found: list[Entry] = []
            for x in own:
                found.append(self._entry([x])) if isinstance(x, int) else found.extend(map(known[x[0]], x[1]))
            yield found

    def entries_each(self, texts: Iterable[str | None]) -> Iterator[list[Entry]]:
        """The entries of each text (null: none), in order, CHARS characters of texts at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= CHARS:
                yield from self.entries(held)
                held, size = [], 0
        if held:
            yield from self.entries(held)

    def encode_each(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text (null: none), in order."""
        for found in self.entries_each(texts):
            yield ids_of(decimals_of(found)).tolist()

    def forget(self) -> None:
        """Drops the tables of pieces: a worker that waits for its next task holds nothing of the last one's texts."""
        self.known, self.older = [{}, {}], [{}, {}]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_each([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of_id.__getitem__, ids)).decode("utf-8", "replace")


def decimals_of(found: list[Entry]) -> str:
    """The ids in decimal, joined by commas."""
    return "".join([x[0] for x in found])[1:]


def ids_of(decimals: str) -> np.ndarray:
    return np.fromstring(decimals, np.int32, sep=",") if decimals else np.zeros(0, np.int32)


def decoded_of(found: list[Entry]) -> bytes:
    """The text that the ids stand for, in UTF-8: the pieces' bytes, each made from its ids, one after the other."""
    whole = b"".join([x[1] for x in found])
    try:
        whole.decode("utf-8")
    except UnicodeDecodeError:
        return whole.decode("utf-8", "replace").encode("utf-8")
    return whole


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = list(enc.encode_each(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of what encode() returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids).

    The ids of a row are made, decoded and digested in the worker that reads it; with_ids returns them too, as ids array<int>.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, of_ids, of_text, ids = [], [], [], []
            for found in enc.entries_each(t.as_py() for t in batch.column(1)):
                decimals = decimals_of(found)
                counts.append(decimals.count(",") + bool(decimals))
                of_ids.append(hashlib.sha256(decimals.encode()).hexdigest())
                of_text.append(hashlib.sha256(decoded_of(found)).hexdigest())
                if with_ids:
                    ids.append(ids_of(decimals))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)
        enc.forget()

    columns = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
