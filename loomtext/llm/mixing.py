"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions.

A budget of words is shared among the sources by weight. A source stops at max_epochs times its size; what it
would get beyond is shared again among the rest by weight, round after round, until no source is above its cap. All rounds
use one number, the level (words for a unit of weight), which only rises: target = min(cap, weight * level).

A source whose target is e times its size takes every document floor(e) times, and once more the documents whose
seeded hash is at or below a cut. The cut is where the running sum of sizes, in the order of hashes, would go beyond
what is left of the target. Documents beyond the cut fill what is missing there: SWEEPS times on in the order of hashes those that
are no larger than the gap, then FILLS times the largest that fits. The cut is found from sums over 4096 hash ranges for each source, then over 4096 parts of the one range
that holds it, then exactly within one part (a 16-millionth of the source), so no source is ever gathered in one task.

The hash is that of doc_id, text and, of rows equal in both, their number among them: rows without ids and repeated rows are drawn one by one.
Numbers are given within partitions first, so that not even a third of all rows, if they were equal, would meet in one task.

Corner cases: a null or blank text has size 0 and is taken 0 words; its source's null is a source of its own, last in order.
Which of the rows that are equal in doc_id and text are taken is open where they differ in other columns; how many is not. Sources of equal names are one
source. An empty table gives an empty table, documents without a column doc_id, source or text count as if it were null. If the budget exceeds all
caps, every source stops at its cap. Extra columns of documents are kept by mix(), whatever their names, and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.shared import Scratch, fill_missing, word_count

#: Hash ranges of a source: signed 64-bit hashes by their upper 12 bits, then by the next 12.
RANGE_BITS = 12
#: How often the gap between a source's cut and its target is filled, by stretches of smaller documents and by single ones.
SWEEPS, FILLS = 1, 2


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """df, written once in the given order, with mix_rank from 0: counts of rows by partition, not one window over all."""
    kept = scratch.cut(df.orderBy(*order).withColumn("mix_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("mix_at", 33)
    sizes = kept.groupBy(part.alias("mix_part")).agg(F.count("*").alias("mix_n"))
    before = F.sum("mix_n").over(Window.orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("mix_part", F.coalesce(before, F.lit(0)).alias("mix_start"))
    at = F.col("mix_start") + F.col("mix_at").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("mix_part", part).join(starts, "mix_part").withColumn("mix_rank", at).drop("mix_part", "mix_start", "mix_at")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """source, source_size, mix_weight, target: the water-filling over the sums of sizes(source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, [F.col("source").asc_nulls_last()], scratch, "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(cycle, (F.col("mix_rank") % len(weights)).cast("int"))
    sources = scratch.cut(sources.select("source", "source_size", weight.alias("mix_weight")), "weights")
    cap, total = F.col("source_size") * float(max_epochs), float(budget) * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round clamps one source more, at least
        clamped = F.col("mix_weight") * level >= cap
        held, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("mix_weight")))).first()
        if not free:
            level = float("inf")
            break
        if (risen := (total - (held or 0.0)) / free) <= level:
            break
        level = risen
    target = cap if level == float("inf") else F.least(cap, F.col("mix_weight") * level)
    return sources.select("source", "source_size", "mix_weight", target.alias("target"))


def drawn(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """rows(doc_id, text, ...) with mix_hash, by which they are drawn, in place of text: rows equal in doc_id and text get different ones."""
    keyed = rows.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).drop("text")
    twice = scratch.cut(keyed.groupBy("mix_key").agg(F.count("*").alias("n")).where("n > 1").select("mix_key"), "twice")
    if twice.isEmpty():
        return keyed.withColumn("mix_hash", F.col("mix_key")).drop("mix_key")
    alone = keyed.join(twice, "mix_key", "left_anti").withColumn("mix_hash", F.col("mix_key"))
    some = scratch.cut(keyed.join(twice, "mix_key", "left_semi").withColumn("mix_part", F.spark_partition_id()), "some")
    sizes = some.groupBy("mix_key", "mix_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_key").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("mix_key", "mix_part", F.coalesce(before, F.lit(0)).alias("mix_start"))
    own = F.row_number().over(Window.partitionBy("mix_key", "mix_part").orderBy("mix_key"))
    numbered = some.withColumn("mix_no", own).join(starts, ["mix_key", "mix_part"])
    numbered = numbered.withColumn("mix_hash", F.xxhash64("mix_key", F.col("mix_start") + F.col("mix_no"))).drop("mix_part", "mix_start", "mix_no")
    return alone.unionByName(numbered).drop("mix_key")


def _digit(level: int) -> Column:
    """The level-th group of RANGE_BITS bits of mix_hash, from above; the first one with its sign, so that all are in the order of hashes."""
    top = F.shiftright("mix_hash", 64 - RANGE_BITS * (level + 1))
    return (top if not level else top.bitwiseAND((1 << RANGE_BITS) - 1)).cast("int")


def cuts(keyed: DataFrame, goal: DataFrame, scratch: Scratch, name: str = "cuts") -> DataFrame:
    """Of keyed(source, size, mix_hash) and goal(source, mix_left): source, mix_cut (the last hash up to which the documents still fit into
    what is left), mix_gap (what they leave) and mix_next (the hash that follows, and by how much the sum would be over with it)."""
    at = goal.select("source", F.lit(0).cast("long").alias("mix_before"), "mix_left").where("mix_left > 0")
    within = keyed.select("source", "size", "mix_hash")
    for level in range(2):
        sums = within.groupBy("source", _digit(level).alias("mix_digit")).agg(F.sum("size").alias("mix_size"))
        upto = F.sum("mix_size").over(Window.partitionBy("source").orderBy("mix_digit"))
        sums = sums.withColumn("mix_inner", upto)
        same = F.col("g.source").eqNullSafe(F.col("s.source"))
        crossed = sums.alias("s").join(at.alias("g"), same).where("mix_before + mix_inner - mix_size < mix_left AND mix_left <= mix_before + mix_inner")
        at = scratch.cut(crossed.select("g.source", F.col("mix_digit").alias(f"mix_digit{level}"), *[f"mix_digit{k}" for k in range(level)], (F.col("mix_before") + F.col("mix_inner") - F.col("mix_size")).alias("mix_before"), "mix_left"), f"{name}-{level}")
        same = F.col("k.source").eqNullSafe(F.col("c.source"))
        for k in range(level + 1):
            same &= F.col(f"c.mix_digit{k}") == _digit(k)
        within = keyed.alias("k").join(at.alias("c"), same).select("k.source", "size", "mix_hash")
    same = F.col("i.source").eqNullSafe(F.col("c.source"))
    inside = within.groupBy("source", "mix_hash").agg(F.sum("size").alias("mix_size")).alias("i").join(at.alias("c"), same).select("i.source", "mix_hash", "mix_size", "mix_before", "mix_left")
    upto = F.col("mix_before") + F.sum("mix_size").over(Window.partitionBy("source").orderBy("mix_hash"))
    fits = F.col("mix_upto") <= F.col("mix_left")
    floor = F.shiftleft(F.shiftright(F.min("mix_hash"), 64 - 2 * RANGE_BITS), 64 - 2 * RANGE_BITS)  # what lies below the part is taken anyhow
    cut = inside.withColumn("mix_upto", upto).groupBy("source").agg(
        F.coalesce(F.max(F.when(fits, F.col("mix_hash"))), floor - 1).alias("mix_cut"),
        (F.first("mix_left") - F.coalesce(F.max(F.when(fits, F.col("mix_upto"))), F.first("mix_before"))).alias("mix_gap"),
        F.min(F.when(~fits, F.struct("mix_hash", (F.col("mix_upto") - F.col("mix_left")).alias("over")))).alias("mix_next"),
    )
    return scratch.cut(cut, name)


def filled_up(keyed: DataFrame, found: DataFrame, scratch: Scratch, sweeps: int, fills: int) -> DataFrame:
    """source, mix_cut, mix_sweeps, mix_more: of cuts(), with documents beyond the cut that fill what it leaves.

    A sweep goes on in the order of hashes past the last one and takes documents no larger than the gap (most) from low to high, up to the
    one that is too much, or all if they do not fill the gap. Then each fill takes the largest document that still fits
    (its hash is in mix_more). Where the document at the cut brings the sum nearer to what is left than all of these, it is taken instead.
    """
    none, nothing = F.array().cast("array<struct<low: bigint, high: bigint, most: double>>"), F.array().cast("array<long>")
    found = found.withColumn("mix_sweeps", none).withColumn("mix_more", nothing).withColumn("mix_last", F.col("mix_cut"))

    def beyond(of: DataFrame) -> DataFrame:
        free = (F.col("mix_hash") > F.col("mix_last")) & (F.col("size") <= F.col("mix_gap")) & ~F.array_contains("mix_more", F.col("mix_hash"))
        return keyed.alias("k").join(of.where("mix_gap >= 1").alias("c"), F.col("k.source").eqNullSafe(F.col("c.source"))).where(free)

    for k in range(sweeps):
        rest = scratch.cut(beyond(found).select("k.source", "size", "mix_hash"), f"rest-{k}")
        if rest.isEmpty():
            break
        swept = cuts(rest, found.select("source", F.col("mix_gap").alias("mix_left")), scratch, f"swept-{k}")
        swept = swept.select("source", F.col("mix_cut").alias("high"), F.col("mix_gap").alias("gap"))
        whole = rest.groupBy("source").agg(F.max("mix_hash").alias("last"), F.sum("size").alias("all"))
        same = F.col("w.source").eqNullSafe(F.col("s.source"))
        swept = whole.alias("w").join(swept.alias("s"), same, "left").select("w.source", F.coalesce("high", "last").alias("high"), "gap", "all")
        rows = found.alias("f").join(swept.alias("s"), F.col("f.source").eqNullSafe(F.col("s.source")), "left")
        step = F.struct(F.col("mix_last").alias("low"), "high", F.col("mix_gap").cast("double").alias("most"))
        all_steps = F.when(F.col("high").isNull(), F.col("mix_sweeps")).otherwise(F.array_append("mix_sweeps", step))
        rows = rows.select("f.source", "mix_cut", "mix_next", "mix_more", all_steps.alias("mix_sweeps"), F.coalesce("gap", F.col("mix_gap") - F.coalesce("all", F.lit(0))).alias("mix_gap"), F.coalesce("high", "mix_last").alias("mix_last"))
        found = scratch.cut(rows, f"sweep-{k}")
    for k in range(fills):
        best = beyond(found).groupBy("k.source").agg(F.max(F.struct("size", "mix_hash")).alias("mix_best"))
        rows = found.alias("f").join(best.alias("b"), F.col("f.source").eqNullSafe(F.col("b.source")), "left")
        more = F.when(F.col("mix_best").isNull(), F.col("mix_more")).otherwise(F.array_append("mix_more", F.col("mix_best.mix_hash")))
        gap = F.col("mix_gap") - F.coalesce("mix_best.size", F.lit(0))
        found = scratch.cut(rows.select("f.source", "mix_cut", "mix_next", "mix_sweeps", "mix_last", gap.alias("mix_gap"), more.alias("mix_more")), f"fill-{k}")
        if found.where(F.size("mix_more") == k + 1).isEmpty():
            break
    instead = F.coalesce(F.col("mix_next.over") < F.col("mix_gap"), F.lit(False))
    cut = F.when(instead, F.col("mix_next.mix_hash")).otherwise(F.col("mix_cut"))
    return found.select("source", cut.alias("mix_cut"), F.when(instead, none).otherwise(F.col("mix_sweeps")).alias("mix_sweeps"), F.when(instead, nothing).otherwise(F.col("mix_more")).alias("mix_more"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 7, sweeps: int = SWEEPS, fills: int = FILLS) -> tuple[DataFrame, DataFrame]:
    """(sizes as written, draws): sizes has doc_id, source, size, mix_hash; draws has for each source its target and which hashes it takes.

    draws: source, source_size, target, mix_whole (repetitions of every document), mix_cut (once more up to this hash), mix_sweeps and
    mix_more (and beyond it those of these stretches and sizes, and these hashes).
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = fill_missing(docs, doc_id="long", source="string", text="string").withColumn("size", word_count(F.col("text")))
    sizes = scratch.cut(drawn(rows, seed, scratch).select("doc_id", "source", "size", "mix_hash"), "sizes")
    goal = targets(sizes, scratch, weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("mix_whole", whole.cast("int")).withColumn("mix_left", F.col("target") - F.col("mix_whole") * F.col("source_size"))
    goal = scratch.cut(goal, "goal")
    worded = sizes.where("size > 0")
    found = filled_up(worded, cuts(worded, goal, scratch), scratch, sweeps, fills)
    same = F.col("g.source").eqNullSafe(F.col("c.source"))
    draws = goal.alias("g").join(found.alias("c"), same, "left").select("g.source", "source_size", "target", "mix_whole", "mix_cut", "mix_sweeps", "mix_more")
    return sizes, scratch.cut(draws, "draws")


def repetitions() -> Column:
    """How often a document is taken, from size, mix_hash and the columns of draws beside them."""
    swept = F.exists("mix_sweeps", lambda s: (F.col("mix_hash") > s["low"]) & (F.col("mix_hash") <= s["high"]) & (F.col("size") <= s["most"]) & (F.col("size") > 0))
    once_more = (F.col("mix_hash") <= F.col("mix_cut")) | swept | F.array_contains("mix_more", F.col("mix_hash"))
    return F.coalesce(F.col("mix_whole"), F.lit(0)) + F.when(once_more, 1).otherwise(0)


def taken(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: what the mix takes of each document."""
    sizes, draws = plan(docs, seed=seed, **options)
    rows = sizes.alias("d").join(draws.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    rows = rows.withColumn("copies", repetitions())
    return rows.select("doc_id", "d.source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (rows without words: as often as their hash says)."""
    _, draws = plan(docs, seed=seed, **options)
    own = [(docs[c] if c in docs.columns else F.lit(None)).cast(kind).alias(name) for c, kind, name in (("doc_id", "long", "doc_id"), ("source", "string", "mix_source"), ("text", "string", "text"))]
    rows = docs.select(F.struct("*").alias("mix_row"), *own).withColumn("size", word_count(F.col("text")))
    rows = drawn(rows, seed, Scratch(docs.sparkSession, "mix-rows"))
    rows = rows.join(draws, F.col("mix_source").eqNullSafe(F.col("source")), "left").withColumn("mix_copies", repetitions())
    rows = rows.where("mix_copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    return rows.select("mix_row.*")
