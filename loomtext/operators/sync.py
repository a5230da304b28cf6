"""Change detection and incremental upkeep of index tables.

Everything is keyed by file_path. Bodies are read, and hashed, only where size or time differ; change lists are joined against
the tables, never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import scope
from loomtext.functions.text import content_hash
from loomtext.operators import index, inverted
from loomtext.operators.inverted import CHANNELS, less, path_of, signed_sums
from loomtext.sources.scratch import Scratch

BATCH = 400
DRAIN_LIMIT = 1000


def reconcile(notes: DataFrame, state: DataFrame, mode: str = "fast") -> DataFrame:
    """file_path, change (new, changed, stat_only, unchanged, deleted) of notes against file_state.

    fast takes equal size and time for equal content; strict hashes every body. The join carries sizes and times; the bodies come in
    a second join, for the paths that need one.
    """
    now = notes.select("file_path", F.col("file_size").alias("size"), F.col("modified_ns").alias("ns"))
    old = state.select(F.col("file_path").alias("old_path"), "file_hash", F.col("file_size").alias("old_size"), F.col("modified_ns").alias("old_ns"))
    both = now.join(old, now["file_path"] == old["old_path"], "full_outer")
    same_stat = F.col("size").eqNullSafe(F.col("old_size")) & F.col("ns").eqNullSafe(F.col("old_ns"))
    kind = F.when(F.col("file_path").isNull(), "deleted").when(F.col("old_path").isNull(), "new").when(same_stat & F.lit(mode == "fast"), "unchanged").otherwise(F.when(same_stat, "same").otherwise("other"))
    rows = both.select(F.coalesce("file_path", "old_path").alias("file_path"), "file_hash", kind.alias("kind"))
    settled = rows.where(F.col("kind").isin("deleted", "new", "unchanged")).select("file_path", F.col("kind").alias("change"))
    asked = rows.where(F.col("kind").isin("same", "other"))
    hashed = asked.join(notes.select("file_path", "text"), "file_path")
    change = F.when(~F.col("file_hash").eqNullSafe(content_hash(F.col("text"))), "changed").when(F.col("kind") == "other", "stat_only").otherwise("unchanged")
    return settled.unionByName(hashed.select("file_path", change.alias("change")))


def apply_stat_updates(state: DataFrame, notes: DataFrame, changes: DataFrame) -> DataFrame:
    """file_state with the size and time of stat_only paths."""
    new = notes.join(changes.where("change = 'stat_only'").select("file_path"), "file_path", "left_semi").select("file_path", F.col("file_size").alias("new_size"), F.col("modified_ns").alias("new_ns"))
    rest = [c for c in state.columns if c not in ("file_size", "modified_ns")]
    return state.join(new, "file_path", "left").select(*rest, F.coalesce("new_size", "file_size").alias("file_size"), F.coalesce("new_ns", "modified_ns").alias("modified_ns"))


def route_paths(paths: DataFrame, notes: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """file_path, op of requests(path, op): invalid ones dropped, missing or out-of-scope ones deleted, deletions first."""
    clean = paths.withColumn("file_path", scope.normalize_path(F.col("path"))).where("file_path IS NOT NULL")
    there = notes.select("file_path", F.lit(True).alias("there"))
    rows = clean.join(there, "file_path", "left")
    gone = (F.col("op") == "deleted") | F.col("there").isNull() | ~scope.in_scope(F.col("file_path"), include, exclude)
    return rows.groupBy("file_path").agg(F.when(F.bool_or(gone), "deleted").otherwise("changed").alias("op"))


def replace_rows(table: DataFrame, paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """table without the rows of paths, and with fresh ones."""
    return table.join(paths.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def apply_changes(tables: dict[str, DataFrame], routed: DataFrame, notes: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Every table without the routed paths' rows, and with those that build() makes of the changed notes.

    Blocks of postings lose the dead rows, parts without any are passed on as they are; terms and stats are the old ones less what the dead rows had, with the fresh ones'; counts of the manifest follow.
    """
    changed = notes.join(routed.where("op = 'changed'").select("file_path"), "file_path", "left_semi")
    fresh = build(changed)
    out = {name: replace_rows(df, routed, fresh[name]) for name, df in tables.items() if "file_path" in df.columns}
    if "postings" in tables:
        rows = inverted.lexical_rows(tables["postings"], "channel").withColumn("file_path", path_of("channel"))
        gone = rows.join(routed.select("file_path").distinct(), "file_path", "left_semi")
        dead = Scratch(routed.sparkSession, "dead").cut(gone.groupBy("channel", "part").agg(F.collect_list("key").alias("keys"), F.sum("n_terms").alias("total")), "dead")  # at most a part's rows
        lost = inverted.lost(tables["postings"], dead, "channel")
        stats = dead.groupBy("channel").agg(F.sum(F.size("keys")).alias("n_rows"), F.sum("total").alias("total_terms"))
        kept = [inverted.without(tables["postings"].where(F.col("channel") == c), dead.where(F.col("channel") == c)) for c in CHANNELS]
        out["postings"] = reduce(DataFrame.unionByName, kept).unionByName(fresh["postings"].select(*kept[0].columns))
        out |= signed_sums([tables, less(fresh, {"terms": lost, "stats": stats})])
    if "manifest" in tables:
        old = {name: tables[name].join(routed.select("file_path"), "file_path", "left_semi") for name in ("chunks", "file_state")}
        out["manifest"] = index.recounted(tables["manifest"], index.index_counts(old["chunks"], old["file_state"]), index.index_counts(fresh["chunks"], fresh["file_state"]))
    return out


def change_summary(routed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """changed, deleted, removed_chunks, added_chunks: one row."""
    ops = routed.agg(F.count_if(F.col("op") == "changed").alias("changed"), F.count_if(F.col("op") == "deleted").alias("deleted"))
    touched = routed.select("file_path")
    removed = before.join(touched, "file_path", "left_semi").agg(F.count("*").alias("removed_chunks"))
    added = after.join(touched, "file_path", "left_semi").agg(F.count("*").alias("added_chunks"))
    return ops.join(F.broadcast(removed)).join(F.broadcast(added))  # single rows


def upsert(table: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """One row a file_path, the last by order; a fresh row before an old one of equal order."""
    both = table.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)))
    last = both.groupBy("file_path").agg(F.max_by(F.struct(*table.columns), F.struct(order, "fresh")).alias("row"))
    return last.select("row.*")


def pending_batches(pending: DataFrame, notes: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...], batch: int = BATCH) -> DataFrame:
    """file_path, operation, batch_no: the latest entry of each path, oldest first, in batches; operations derived again.

    Positions are counted within minutes, and minutes are summed, so the order is never made in one task.
    """
    last = pending.groupBy("file_path").agg(F.max("queued_at").alias("queued_at"))
    there = notes.select("file_path", F.lit(True).alias("there"))
    valid = F.col("there").isNotNull() & scope.in_scope(F.col("file_path"), include, exclude)
    rows = last.join(there, "file_path", "left").select("file_path", "queued_at", F.when(valid, "changed").otherwise("deleted").alias("operation"), F.date_trunc("minute", "queued_at").alias("minute"))
    minutes = rows.groupBy("minute").agg(F.count("*").alias("n"))
    starts = minutes.select("minute", F.coalesce(F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("minute").orderBy("queued_at", "file_path"))
    return rows.withColumn("n", within).join(starts, "minute").select("file_path", "operation", F.floor((F.col("start") + F.col("n") - 1) / batch).alias("batch_no"))


def recovery_plan(pending: DataFrame, drain_limit: int = DRAIN_LIMIT) -> DataFrame:
    """n_pending and plan: drain the journal, or reconcile strictly if it is long."""
    n = F.count_distinct("file_path")
    return pending.agg(n.alias("n_pending"), F.when(n > drain_limit, "strict_reconcile").otherwise("drain").alias("plan"))


def renames(events: DataFrame) -> DataFrame:
    """path, op of events(file_path, old_path, op): a rename deletes the old path and changes the new one."""
    pair = F.array(F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("op")), F.struct(F.col("file_path").alias("path"), F.lit("changed").alias("op")))
    own = F.array(F.struct(F.col("file_path").alias("path"), F.when(F.col("op") == "delete", "deleted").otherwise("changed").alias("op")))
    rest = [c for c in events.columns if c not in ("file_path", "old_path", "op")]
    return events.select(*rest, F.explode(F.when(F.col("op") == "rename", pair).otherwise(own)).alias("e")).select(*rest, "e.*")


def differences(incremental: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, with their side: empty when an incremental sync equals a rebuild."""
    gone, extra = full.exceptAll(incremental), incremental.exceptAll(full)
    return gone.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


#: Ranges of keys that digests are made of; a digest table has no more rows.
RANGES = 1 << 16


def _range(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(RANGES)).cast("int")


def digests(rows: DataFrame, key: str = "file_path") -> DataFrame:
    """range, n, total, mix: of each range of keys the number of its rows and two sums of their hashes that no order changes; made without moving rows, and small enough to be stored beside a table."""
    names = sorted(rows.columns)
    # the hash of a null is its seed, so nulls are told apart by flags
    whole = [*names, F.array(*[F.col(c).isNull() for c in names])]
    hashed = rows.select(_range(key).alias("range"), F.xxhash64(*whole).alias("one"), F.xxhash64(F.lit("mix"), *whole).alias("two"))
    return hashed.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("one").cast("decimal(20,0)")).alias("total"), F.bit_xor("two").alias("mix"))


def unlike_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """range of every range whose digests differ, or that one side lacks."""
    names = ("n", "total", "mix")
    left, right = a.select("range", F.struct(*names).alias("l")), b.select("range", F.struct(*names).alias("r"))
    return left.join(right, "range", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("range")


def differences_by_digest(incremental: DataFrame, full: DataFrame, key: str = "file_path", stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What differences() gives, but only rows of unlike ranges are moved. stored: digests of both sides, if they are at hand.

    Columns of both sides have the same names, none of a map's type; their order does not matter. Repeated rows count. Two different ranges pass as equal only if 128 bits of their hashes agree.
    """
    full = full.select(*incremental.columns)
    ranges = Scratch(full.sparkSession, "digests").cut(unlike_ranges(*(stored or (digests(incremental, key), digests(full, key)))), "ranges")
    some = F.broadcast(ranges)  # at most RANGES rows
    one, other = (side.withColumn("range", _range(key)).join(some, "range", "left_semi").drop("range") for side in (incremental, full))
    return differences(one, other)
