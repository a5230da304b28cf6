"""File-change events as a stream, applied to index tables in micro-batches.

Coalescing needs no state beyond a micro-batch: the last operation of a path wins, and what is applied twice gives the same
tables. Each micro-batch adds a generation to the index, a delta of its own paths and of those that were put back (runs.py); its number is the batch's, so a batch
that failed is made again from the same state when the checkpoint replays it, and one that was applied is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.config import Config
from loomtext.functions.scope import in_scope
from loomtext.operators.index import MANIFEST, index_counts, recounted
from loomtext.operators.inverted import less
from loomtext.operators.sync import DRAIN_LIMIT, reconcile, recovery_plan, renames, route_paths
from loomtext.plans.build import derived_tables
from loomtext.sources.notes import generations, write_index
from loomtext.sources.runs import Derive, Runs
from loomtext.sources.scratch import Scratch

QUIET = "1500 milliseconds"
LATE = "1 hour"
BATCH = 200


def coalesce_events(events: DataFrame) -> DataFrame:
    """path, op, ts: the last operation of each Markdown path; a rename counts for both of its paths."""
    single = renames(events).where(F.lower("path").endswith(".md"))
    last = single.groupBy("path").agg(F.max_by(F.struct("op", "ts"), F.struct("ts", "event_id", F.col("op"))).alias("e"))
    return last.select("path", "e.op", "e.ts")


def debounced(events: DataFrame, quiet: str = QUIET, late: str | None = LATE) -> DataFrame:
    """path, burst_start, burst_end, op, n: bursts of events on a path, each closed by a quiet time.

    Works on a stream (with a watermark) and on a table. The last operation of a burst wins.
    """
    timed = renames(events.withColumn("ts", F.col("ts").cast("timestamp"))).where(F.lower("path").endswith(".md"))
    if late and events.isStreaming:
        timed = timed.withWatermark("ts", late)
    last = F.max_by("op", F.struct("ts", "event_id", "op")).alias("op")
    bursts = timed.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(last, F.count("*").alias("n"))
    return bursts.select("path", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "op", "n")


def flush_batches(coalesced: DataFrame, size: int = BATCH) -> DataFrame:
    """path, op, batch_no: changed paths first, then deleted ones, in batches; what changed paths leave of a batch is filled with deleted ones.

    Paths go in order of a hash's first digits, then of their names; positions are counted by operation and digits, not over all paths in one task.
    """
    placed = coalesced.select("path", "op", F.substring(F.sha2("path", 256), 1, 2).alias("part"))
    counts = placed.groupBy("op", "part").agg(F.count("*").alias("n"))  # at most 512 rows
    starts = counts.select("op", "part", F.coalesce(F.sum("n").over(Window.orderBy("op", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("op", "part").orderBy("path"))
    rows = placed.withColumn("n", within).join(F.broadcast(starts), ["op", "part"])
    return rows.select("path", "op", F.floor((F.col("start") + F.col("n") - 1) / size).alias("batch_no"))


def stream_sync(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies a stream of events: apply(coalesced, batch_id) has to give the same tables when a batch is replayed."""

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(coalesce_events(batch), batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class IndexSync:
    """Keeps the generations of an index below root in step with a stream of events; apply() is what stream_sync() calls.

    notes() gives the notes as they are now, build() the tables that some notes make. Paths go in batches of at most size; rejected(flushed) may return the
    batch_no of batches that cannot be applied: their paths are put back and go with the next micro-batch, unless a newer operation has come meanwhile. With more than
    DRAIN_LIMIT paths to apply, states are reconciled strictly against the notes instead, and nothing has to be drained.
    """

    def __init__(self, spark: SparkSession, root: str, notes: Callable[[], DataFrame], build: Callable[[DataFrame], dict[str, DataFrame]], config: Config, size: int = BATCH, drain_limit: int = DRAIN_LIMIT, rejected: Callable[[DataFrame], DataFrame] | None = None, derive: Derive | None = None):
        self.spark, self.root, self.notes, self.build, self.config, self.size, self.drain_limit, self.rejected = spark, root, notes, build, config, size, drain_limit, rejected
        self.runs = Runs(spark, root, derive or derived_tables)

    def start(self) -> None:
        """Generation -1: the index of the notes as they are, where there is none yet."""
        if not generations(self.spark, self.root):
            tables = self.build(self.notes())
            self._write(tables, tables.get("manifest"), self.spark.createDataFrame([], "path string, op string, ts timestamp"), -1)

    def tables(self, before: int | None = None) -> dict[str, DataFrame]:
        """The index as of the last complete generation (below a number), merged from its runs."""
        return self.runs.tables(before=before)

    def apply(self, coalesced: DataFrame, batch_id: int) -> None:
        if str(batch_id) in generations(self.spark, self.root):
            return  # applied before the checkpoint knew
        scratch = Scratch(self.spark, "sync")
        tables = self.tables(batch_id)
        waiting = coalesced.select("path", "op", "ts").withColumn("new", F.lit(1)).unionByName(tables["requeued"].withColumn("new", F.lit(0)))
        last = waiting.groupBy("path").agg(F.max_by(F.struct("op", "ts"), F.struct("new", "ts", F.col("op"))).alias("e"))
        pending = scratch.cut(last.select("path", "e.op", "e.ts"), "pending")
        notes = self.notes()
        if recovery_plan(pending.select(F.col("path").alias("file_path")), self.drain_limit).first()["plan"] == "strict_reconcile":
            found = reconcile(notes.where(in_scope(F.col("file_path"), self.config.include, self.config.exclude)), tables["file_state"], "strict")
            routed = found.where("change IN ('new', 'changed', 'stat_only', 'deleted')").select("file_path", F.when(F.col("change") == "deleted", "deleted").otherwise("changed").alias("op"))
            requeued = pending.where("false")
        else:
            flushed = scratch.cut(flush_batches(pending, self.size), "flushed")
            out = self.rejected(flushed).select("batch_no").distinct() if self.rejected else flushed.select("batch_no").where("false")
            refused = scratch.cut(flushed.join(out, "batch_no", "left_semi").select("path"), "refused")
            requeued = pending.join(refused, "path", "left_semi")
            routed = route_paths(pending.join(refused, "path", "left_anti").select("path", "op"), notes, self.config.include, self.config.exclude)
        routed = scratch.cut(routed, "routed")
        self._append(tables, routed, notes, requeued, batch_id)
        self.runs.compact()

    def _append(self, tables: dict[str, DataFrame], routed: DataFrame, notes: DataFrame, requeued: DataFrame, batch_id: int) -> None:
        """A delta of the routed paths: their fresh rows, their names, and what terms, stats and counts change by."""
        fresh = self.build(_of_paths(notes, routed.where("op = 'changed'")))
        delta = {name: df for name, df in fresh.items() if name not in ("terms", "stats", "manifest")} | {"touched": routed.select("file_path")}
        manifest = None
        if "postings" in fresh or "manifest" in fresh:
            old = {name: Scratch(self.spark, "old").cut(_of_paths(tables[name], routed), name) for name in ("chunks", "file_fields", "file_state")}
            if "postings" in fresh:
                delta |= less(fresh, self.runs.derive(old["chunks"], old["file_fields"]))
            manifest = recounted(tables["manifest"], index_counts(old["chunks"], old["file_state"]), index_counts(fresh["chunks"], fresh["file_state"]))
        self._write(delta, manifest, requeued, batch_id)

    def _write(self, tables: dict[str, DataFrame], manifest: DataFrame | None, requeued: DataFrame, batch_id: int) -> None:
        """A generation; its number is one more key of the manifest."""
        own = self.spark.createDataFrame([(str(batch_id), "generation", str(batch_id))], MANIFEST)
        if manifest is not None:
            index_id = manifest.first()["index_id"]
            own = manifest.where("key <> 'generation'").unionByName(own.withColumn("index_id", F.lit(index_id)))
        write_index(tables | {"requeued": requeued.select("path", "op", "ts"), "manifest": own}, self.root, str(batch_id), "overwrite")


def _of_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of some paths; of up to DRAIN_LIMIT by a list of them, which the files' ranges of paths are compared with before they are read."""
    some = [r["file_path"] for r in paths.select("file_path").limit(DRAIN_LIMIT + 1).collect()]
    return rows.where(F.col("file_path").isin(some)) if len(some) <= DRAIN_LIMIT else rows.join(paths.select("file_path"), "file_path", "left_semi")
