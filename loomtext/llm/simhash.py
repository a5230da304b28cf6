"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Only distinct fingerprints are compared, so exact copies cost one row each and nothing more. Links are found in three steps:

1. The 64 bits are cut into blocks, more of them the more fingerprints there are. Two fingerprints that differ in at most d bits agree in all
   but d blocks at least, so each is filed under every choice of that many blocks; linked ones share a file.
2. The least fingerprint of each file is its pivot: members near enough to it are linked to it. That is one row a member,
   however dense the file is, and joins almost all of a large group of near copies at once.
3. Only files that still hold more than one component are searched for pairs, and only pairs from different components.
   The pivot table (each fingerprint's Hamming distances to 32 orthogonal reference fingerprints, computed once) discards
   pairs by the largest difference of coordinates, which never exceeds the true distance; survivors are verified bit by bit.
   discards() counts how many pairs of a table each reference alone and all of them together discard.

Step 3 looks at every pair that steps 1 and 2 have not joined already, so the components are exact.

near_copies() (and survivors(), which the pipeline uses) also links texts whose sets of shingles have a Jaccard similarity of LIKE or more. Texts
are filed under bands of their smallest shingle hashes; in files that hold more than one component they are compared with the file's
pivot, by sizes, fingerprints and the minima themselves, and what these leave is verified on whole texts. Texts of files that still hold more than one
component meet by their rarest shingles (overlapping(), which leaves out no pair), not file by file, and are verified too. Bands miss about 1 in 100,000 pairs at LIKE.

Corner cases: null and blank texts have fingerprint zero and are linked like any other; a text with fewer words than a shingle is
one shingle; repeated rows and ids are linked with themselves. A null doc_id takes part, but is never the smallest id unless its
whole component has none. An empty table gives an empty one; other columns are ignored (and kept by survivors()). Of each component survivors() keeps
the row of the smallest doc_id (rows without one come last) and, among rows that share it, of the smallest text hash; of rows equal in both, one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.links import components
from loomtext.llm.shared import Scratch, fill_missing, rows_at_once
from loomtext.llm.sketch import ODD, Hasher, _mixed

SEED = 42
#: Fingerprints, at most, for so many blocks: up to it, a file of strangers has a member or two.
BLOCKS = ((6, 1 << 21), (7, 1 << 27), (8, 1 << 32), (10, 1 << 38))
#: Reference fingerprints: rows of a Hadamard matrix, each at distance 32 from any other. Differing bits that one of them does not tell from
#: equal ones, another does.
REFERENCES = [sum(((r & i).bit_count() & 1) << i for i in range(64)) for r in range(0, 64, 2)]
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Texts, and pairs of texts, that a worker gets at once.
TEXTS, PAIRS = 1000, 100
#: Near copies have at least this Jaccard similarity of shingles.
LIKE = 0.8
#: Of two texts at LIKE, all BANDS bands of BAND minima differ with probability (1 - LIKE ** BAND) ** BANDS, about 1 in 100,000.
BANDS, BAND = 16, 3
ORDERS = _mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(ODD))
#: Texts at LIKE differ in about 10 fingerprint bits, with a standard deviation of 3; pairs beyond these bits are not verified.
FAR = 24
#: Of the BANDS * BAND minima, two texts at LIKE share 38 on average, with a standard deviation of 3; pairs that share fewer than this are not verified.
SHARED = 22
#: How much larger each class of set sizes is than the one before.
SIZES = 1.03


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return fill_missing(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, kept: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, kept)]


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fp: Column) -> list[Column]:
    """The Hamming distances of a fingerprint to each reference, as columns d0, d1, ..."""
    return [_differ(fp, F.lit(signed(r))).cast("byte").alias(f"d{i}") for i, r in enumerate(REFERENCES)]


def within(distance: int, a: str = "a", b: str = "b") -> list[Column]:
    """For each reference, whether a pair's coordinates leave it possible that they are that near."""
    return [F.abs(F.col(f"{a}.d{i}") - F.col(f"{b}.d{i}")) <= distance for i in range(len(REFERENCES))]


def blocks_for(count: int) -> int:
    return next((n for n, most in BLOCKS if count <= most), BLOCKS[-1][0])


def link(prints: DataFrame, scratch: Scratch, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """node, root of all fingerprints (distinct, column fp) with a link; root is the least fingerprint of the component."""
    blocks = max(blocks or blocks_for(prints.count()), distance + 1)
    files = F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks(blocks, blocks - distance))])
    filed = prints.select("fp", F.explode(files).alias("f")).select("fp", "f.k", "f.part")
    shared = filed.groupBy("k", "part").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.cut(filed.join(shared, ["k", "part"]), "members")

    stars = members.where((F.col("fp") != F.col("pivot")) & (_differ(F.col("fp"), F.col("pivot")) <= distance))
    near = scratch.cut(components(stars.select(F.col("fp").alias("u"), F.col("pivot").alias("v")), scratch, "stars"), "near")

    placed = members.join(near, members["fp"] == near["node"], "left").select("k", "part", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("k", "part").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("k", "part")
    rest = scratch.cut(placed.join(mixed, ["k", "part"]).select("*", *pivot_table(F.col("fp"))), "rest")
    scratch.drop("members")
    a, b = rest.alias("a"), rest.alias("b")
    pair = (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") < F.col("b.root"))
    for near_in in within(distance):
        pair &= near_in
    pair &= _differ(F.col("a.fp"), F.col("b.fp")) <= distance
    bridges = a.join(b, pair).select(F.col("a.root").alias("u"), F.col("b.root").alias("v"))
    far = scratch.cut(components(bridges, scratch, "bridges"), "far")

    nodes = near.select("node", "root").union(far.join(near, "node", "left_anti").select("node", F.col("node").alias("root")))
    up = far.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return nodes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def discards(pairs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of counts for pairs(x, y) of fingerprints: pairs, near (at most that many bits), by_all, and by_0, by_1, ... discarded by each reference."""
    x, y = (F.struct(*pivot_table(F.col(c))).alias(n) for c, n in (("x", "a"), ("y", "b")))
    far = [F.count_if(~w).alias(f"by_{i}") for i, w in enumerate(within(distance))]
    alike = within(distance)[0]
    for w in within(distance)[1:]:
        alike &= w
    near = F.count_if(_differ(F.col("x"), F.col("y")) <= distance).alias("near")
    return pairs.select("x", "y", x, y).agg(F.count("*").alias("pairs"), near, F.count_if(~alike).alias("by_all"), *far)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    with rows_at_once(docs.sparkSession, TEXTS):
        rows = scratch.cut(fingerprints(docs, shingle), "rows")
    prints = scratch.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = scratch.cut(link(prints.select("fp"), scratch, distance), "roots")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = scratch.cut(placed.join(ids, "root").select("fp", "component_id"), "ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def minima(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, least): BANDS hashes of a text's distinct shingle hashes, each of the least ones in BAND orders, and 16 bits of each least one; none of a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    least = np.full(len(ORDERS), np.uint64((1 << 64) - 1))
    for k in range(0, len(shingles), CHUNK // 8):
        part = shingles[k : k + CHUNK // 8]
        least = np.minimum(least, np.array([_mixed(part ^ order).min() for order in ORDERS]))
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        out = _mixed(out * np.uint64(ODD) + column)
    return out.view(np.int64), _mixed(least).astype(np.uint16).view(np.int16)


def likeness(a: str | None, b: str | None, hasher: Hasher) -> float:
    """Jaccard similarity of the two texts' sets of word shingles."""
    x, y = (np.unique(hasher.shingles((t or "").encode("utf-8", "replace"))) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _alike(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, shingle: int, least: float) -> DataFrame:
    """u, v (roots) of those pairs(a, b, u, v) of texts whose whole shingle sets are alike."""
    pairs = scratch.cut(pairs.distinct(), f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    texts = fill_missing(docs, text="string").select(F.xxhash64("text").alias("tid"), "text")
    texts = scratch.cut(texts.join(asked, "tid", "left_semi").dropDuplicates(["tid"]), f"{name}-texts")

    @F.pandas_udf("double")
    def of_pair(one: pd.Series, other: pd.Series) -> pd.Series:
        hasher = Hasher(shingle)
        return pd.Series([likeness(a, b, hasher) for a, b in zip(one, other, strict=True)], dtype="float64")

    ends = [texts.select(F.col("tid").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab"]
    both = pairs.join(ends[1], "b").join(ends[0], "a")
    alike = both.withColumn("likeness", of_pair("a_text", "b_text")).where(F.col("likeness") >= least).select("u", "v")
    with rows_at_once(docs.sparkSession, PAIRS):
        return scratch.cut(alike, f"{name}-alike")


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root replaced by what roots(node, root) have for it."""
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rows.join(up, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def size_class(n: int) -> int:
    """Classes of set sizes: one a size while they are small, then each about SIZES longer than the one before."""
    return n if n * (SIZES - 1) < 1 else int(np.log(n * (SIZES - 1)) / np.log(SIZES)) + int(1 / (SIZES - 1))


def prefixes(n: int, known: int, least: float) -> Iterator[tuple[int, int]]:
    """(size class, elements) of the sets that can be alike to one of n elements, of which all but the last known ones are in no other set: by how many of these, rarest first, it meets them."""
    low, high = int(np.ceil(least * n - 1e-9)), int(n / least + 1e-9)
    size = max(low, 1)
    while size <= high:
        common = int(np.ceil(least / (1 + least) * (n + size) - 1e-9))
        if (take := min(known, known - common + 1)) > 0:
            yield size_class(size), take
        ahead, step = size + 1, size_class(size)
        while size_class(ahead) == step:
            ahead += 1
        size = ahead


def overlapping(texts: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int, least: float) -> DataFrame:
    """a, b, u, v: pairs of texts(tid, root, n), u and v their roots, that may be alike; no pair of different roots that is alike is left out.

    Two sets with c elements in common share one of the first n - c + 1 of each, in any order of all elements. Those that only one root has come first
    and meet nobody; the others follow, those of fewest texts first. How large c is depends on both sizes, so texts meet by element and size classes. Copies of one text
    that were edited in different places have enough of their own to fill their beginnings, so they meet only where they have edits in common.
    """
    whole = fill_missing(docs, text="string").select(F.xxhash64("text").alias("tid"), "text").join(texts.select("tid"), "tid", "left_semi")
    whole = whole.dropDuplicates(["tid"]).join(texts, "tid").select("text", "tid", "root")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            sets = [np.unique(hasher.shingles((t.as_py() or "").encode("utf-8", "replace"))) for t in batch.column(0)]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            keys = [pa.array(batch.column(k).to_numpy()[row], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["tid", "root", "e"])

    with rows_at_once(docs.sparkSession, PAIRS):
        elements = scratch.cut(whole.mapInArrow(cut, "tid long, root long, e long"), "alike-elements")
    held = elements.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("times"))
    known = elements.join(held.where("low <> high").select("e", "times"), "e").join(texts.select("tid", "n"), "tid")
    known = known.groupBy("tid", "root", "n").agg(F.collect_list(F.struct("times", "e")).alias("known")).where(F.size("known") >= least * F.col("n") - 1e-9)
    known = known.select("tid", "root", "n", F.transform(F.array_sort("known"), lambda x: x["e"]).alias("known"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, root, n, own in zip(*(batch.column(k) for k in range(4)), strict=True):
                n, own = n.as_py(), own.values.to_numpy()
                for size, take in prefixes(n, len(own), least):
                    columns = [np.full(take, x, np.int64) for x in (tid.as_py(), root.as_py(), n)] + [np.full(take, x, np.int32) for x in (size_class(n), size)]
                    columns += [len(own) - np.arange(take), own[:take]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["tid", "root", "n", "own", "other", "onward", "e"])

    with rows_at_once(docs.sparkSession, PAIRS):
        met = scratch.cut(known.mapInArrow(begin, "tid long, root long, n long, own int, other int, onward long, e long"), "alike-met")
    scratch.drop("alike-elements")
    meeting = ["e", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large")]
    met = met.select("tid", "root", "n", "own", "other", "onward", *meeting)
    mixed = met.groupBy("e", "small", "large").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("e", "small", "large")
    met = scratch.cut(met.join(mixed, ["e", "small", "large"]), "alike-mixed")
    scratch.drop("alike-met")
    a, b = (met.select("e", F.col(own).alias("own"), F.col(other).alias("other"), *[F.col(c).alias(f"{x}_{c}") for c in ("tid", "root", "n", "onward")]) for x, own, other in (("a", "own", "other"), ("b", "other", "own")))
    sizes = (F.col("a_n") >= least * F.col("b_n")) & (F.col("b_n") >= least * F.col("a_n"))
    # at their first common element both have as many left as they have in common
    enough = F.least("a_onward", "b_onward") >= least / (1 + least) * (F.col("a_n") + F.col("b_n")) - 1e-9
    pairs = a.join(b, ["e", "own", "other"]).where((F.col("a_root") < F.col("b_root")) & sizes & enough)
    return pairs.select(F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), F.col("a_root").alias("u"), F.col("b_root").alias("v"))


def link_alike(rows: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int, least: float) -> DataFrame:
    """node, root of the roots in rows(tid, fp, root, n, bands, least; a row each text) that texts of at least that likeness join."""
    filed = rows.select("tid", "fp", "root", "n", F.posexplode("bands").alias("k", "part"))
    signs = rows.select("tid", F.col("least").alias("sign"))

    def near(a: str, b: str) -> Column:
        """What two texts at LIKE fulfil, cheapest first; it is part of the joins, so that only pairs worth a look leave them."""
        sizes = (F.col(f"{a}n") >= least * F.col(f"{b}n")) & (F.col(f"{b}n") >= least * F.col(f"{a}n"))
        same = F.size(F.filter(F.zip_with(f"{a}sign", f"{b}sign", lambda x, y: x == y), lambda x: x))
        return sizes & (_differ(F.col(f"{a}fp"), F.col(f"{b}fp")) <= FAR) & (same >= SHARED)

    pivot = F.min(F.struct("tid", "fp", "root", "n")).alias("pivot")
    mixed = filed.groupBy("k", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot).where("low <> high")
    mixed = mixed.select("k", "part", *[F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("tid", "fp", "root", "n")])
    mixed = mixed.join(signs.select(F.col("tid").alias("pivot_tid"), F.col("sign").alias("pivot_sign")), "pivot_tid")
    rest = scratch.cut(filed.join(mixed, ["k", "part"]).join(signs, "tid"), "alike-rest")
    stars = rest.where((F.col("root") != F.col("pivot_root")) & near("", "pivot_"))
    stars = stars.select(F.col("pivot_tid").alias("a"), F.col("tid").alias("b"), F.col("pivot_root").alias("u"), F.col("root").alias("v"))
    first = scratch.cut(components(_alike(stars, docs, scratch, "stars-alike", shingle, least), scratch, "alike-stars"), "alike-first")

    # Pairs with the pivot are settled; what is left are the other pairs of files that still hold more than one component.
    left = _placed(rest.select("k", "part", "tid", "pivot_tid", "root", "n"), first)
    mixed = left.groupBy("k", "part").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k", "part")
    left = left.where("tid <> pivot_tid").join(mixed, ["k", "part"]).select("tid", "root", "n").distinct()
    left = scratch.cut(left, "alike-left")
    scratch.drop("alike-rest")
    pairs = overlapping(left, docs, scratch, shingle, least)
    second = scratch.cut(components(_alike(pairs, docs, scratch, "pairs-alike", shingle, least), scratch, "alike-pairs"), "alike-second")

    nodes = first.union(second.join(first, "node", "left_anti").select("node", F.col("node").alias("root")))
    return scratch.cut(_placed(nodes, second).select("node", "root"), "alike-roots")


def near_copies(docs: DataFrame, shingle: int = 5, distance: int = 4, like: float = LIKE) -> DataFrame:
    """As near_duplicates(), with links also between texts whose sets of shingles have at least that Jaccard similarity.

    Also tid, a hash of the text, and first: of the component's rows the least (last: whether doc_id is null, doc_id, tid).
    """
    scratch = Scratch(docs.sparkSession, "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            sets = [np.unique(hasher.shingles((t or "").encode("utf-8", "replace"))) for t in texts]
            columns = [pa.array([signed(fingerprint(t, shingle)) for t in texts], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            least = [minima(x) for x in sets]
            columns += [batch.column(2), pa.array([b for b, _ in least], pa.list_(pa.int64())), pa.array([x for _, x in least], pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fp", "n", "tid", "bands", "least"])

    read = fill_missing(docs, doc_id="long", text="string").select("doc_id", "text", F.xxhash64("text").alias("tid"))
    with rows_at_once(docs.sparkSession, TEXTS):
        rows = scratch.cut(read.mapInArrow(run, "doc_id long, fp long, n long, tid long, bands array<long>, least array<short>"), "rows")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid"))
    prints = scratch.cut(rows.groupBy("fp").agg(least_row.alias("least")), "prints")
    roots = scratch.cut(link(prints.select("fp"), scratch, distance), "roots")
    placed = scratch.cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    texts = rows.where("n > 0").select("tid", "fp", "n", "bands", "least").dropDuplicates(["tid"]).join(placed.select("fp", "root"), "fp")
    placed = _placed(placed, link_alike(texts, docs, scratch, shingle, like))
    ids = placed.groupBy("root").agg(F.min("least").alias("least"))
    ids = scratch.cut(placed.join(ids.withColumnRenamed("least", "first"), "root").select("fp", "first"), "ids")
    return rows.join(ids, "fp").select("doc_id", "tid", "fp", F.col("first.doc_id").alias("component_id"), "first")


def survivors(docs: DataFrame, shingle: int = 5, distance: int = 4) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id, and of the smallest text hash among rows that share it."""
    key = [F.col("doc_id").isNull().alias("simhash_last"), F.coalesce("doc_id", F.lit(0)).alias("simhash_id"), F.col("tid").alias("simhash_text")]
    names = ["simhash_last", "simhash_id", "simhash_text"]
    found = near_copies(docs, shingle, distance)
    keep = found.where(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid").eqNullSafe(F.col("first"))).select(*key).distinct()
    own = docs.select(F.struct("*").alias("simhash_row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("tid"))
    return own.select("simhash_row", *key).join(keep, names).dropDuplicates(names).select("simhash_row.*")
