"""An index as runs: a first generation, deltas of what changed since, merged on reading and compacted by size.

A delta holds the rows of changed notes alone and, in touched, the paths whose older rows are dead; the newest run that touched a path has its rows. Postings of older runs
stay as they are: a search leaves dead rows out of them (table dead), and a delta's terms and stats are signed: what its rows add less what the
dead rows had. So a micro-batch writes as much as its notes make, whatever the size of the index.

When the newest runs together are at least half of the run before them, they become one run, and so on: a row is written again a number of times that grows with the logarithm
of the index only. A merge is complete when its manifest is there; the runs that it stands for are deleted at the next merge, as readers may still be at
them. Their manifests stay, so the generations ever applied are known.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import inverted
from loomtext.operators.inverted import path_of, signed_sums
from loomtext.sources.notes import TABLES, _listed, by_path, generations, read_table, write_tables

#: The newest runs are merged with the run before them when RATIO times their bytes reach its own.
RATIO = 2
#: Tables that are not rows of paths.
SHARED = ("postings", "terms", "stats", "requeued", "manifest", "touched")
Derive = Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


class Run(NamedTuple):
    first: int
    last: int
    path: str


class Runs:
    """The runs below root; derive makes postings of chunks and fields, for merges."""

    def __init__(self, spark: SparkSession, root: str, derive: Derive | None = None):
        self.spark, self.root, self.derive = spark, root, derive

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def bytes(self, run: Run) -> int:
        p, system = self._path(run.path)
        return system.getContentSummary(p).getLength()

    def complete(self) -> list[Run]:
        """All complete runs, those that a merge stands for included."""
        found = [Run(int(g), int(g), f"{self.root}/generation={g}") for g in generations(self.spark, self.root)]
        for name in _listed(self.spark, self.root):
            if name.startswith("merged=") and "_SUCCESS" in _listed(self.spark, f"{self.root}/{name}/manifest"):
                first, last = name.removeprefix("merged=").split("..")
                found.append(Run(int(first), int(last), f"{self.root}/{name}"))
        return found

    def current(self, before: int | None = None) -> list[Run]:
        """The runs that make the index up, the oldest first: the widest ones."""
        out: list[Run] = []
        for run in sorted(self.complete(), key=lambda r: (r.first, -r.last)):
            if (before is None or run.last < before) and (not out or run.first > out[-1].last):
                out.append(run)
        return out

    def _read(self, run: Run, name: str) -> DataFrame | None:
        return read_table(self.spark, run.path, name) if name in _listed(self.spark, run.path) else None

    def _touched(self, runs: list[Run]) -> DataFrame:
        """file_path, last: the newest of the given runs (by number in the list) that touched a path."""
        known = [(i, self._read(run, "touched")) for i, run in enumerate(runs)]
        none = self.spark.createDataFrame([], "file_path string, at int")
        rows = reduce(DataFrame.unionByName, [t.select("file_path", F.lit(i).alias("at")) for i, t in known if t is not None], none)
        return rows.groupBy("file_path").agg(F.max("at").alias("last"))

    def tables(self, runs: list[Run] | None = None, before: int | None = None) -> dict[str, DataFrame]:
        """The index that some runs make up (all, by default), and for more than one dead: channel, part, keys of postings that are no longer there."""
        runs = self.current(before) if runs is None else runs
        there = [[t for t in TABLES if t in _listed(self.spark, run.path)] for run in runs]
        if len(runs) == 1:
            return {name: self._read(runs[0], name) for name in there[0] if name != "touched"}
        out: dict[str, DataFrame] = {}
        for name in sorted({t for names in there for t in names} - set(SHARED)):
            parts = [self._read(run, name).withColumn("at", F.lit(i)) for i, run in enumerate(runs) if name in there[i]]
            rows = reduce(DataFrame.unionByName, parts).join(self._touched(runs), "file_path", "left")
            out[name] = rows.where("last IS NULL OR at >= last").select(*[c for c in parts[0].columns if c != "at"])
        for name in ("requeued", "manifest"):
            if name in there[-1]:
                out[name] = self._read(runs[-1], name)
        if "postings" in there[0]:
            salted = F.xxhash64("part", "at")  # parts of two runs may have one name
            blocks = reduce(DataFrame.unionByName, [self._read(run, "postings").withColumn("at", F.lit(i)) for i, run in enumerate(runs)])
            blocks = blocks.withColumn("part", salted)
            rows = inverted.lexical_rows(blocks.where(F.col("bucket") == inverted.HEADS), "channel", "at")
            gone = rows.withColumn("file_path", path_of("channel")).join(self._touched(runs), "file_path").where("at < last")
            out |= {"postings": blocks.drop("at"), "dead": gone.groupBy("channel", "part").agg(F.collect_list("key").alias("keys"))}
            out |= signed_sums([{n: self._read(run, n) for n in ("terms", "stats")} for run in runs])
        return out

    def merge(self, runs: list[Run]) -> Run:
        """Some neighbouring runs as one."""
        tables = self.tables(runs)
        tables.pop("dead", None)
        if runs[0] != self.current()[0]:  # else no older run is left whose rows could be dead
            tables["touched"] = self._touched(runs).select("file_path")
        elif "terms" in tables:
            tables["terms"] = tables["terms"].where("df > 0")
        name = f"merged={runs[0].first}..{runs[-1].last}"
        own = Run(runs[0].first, runs[-1].last, f"{self.root}/{name}")
        tables |= {t: by_path(tables[t]) for t in ("chunks", "vectors") if t in tables}
        write_tables({t: df for t, df in tables.items() if t not in ("postings", "manifest")}, own.path, "overwrite")
        if "postings" in tables:
            made = self.derive(self._read(own, "chunks"), self._read(own, "file_fields"))
            write_tables({"postings": made["postings"]}, own.path, "overwrite")
        write_tables({"manifest": tables["manifest"]}, own.path, "overwrite")
        return own

    def compact(self) -> Run | None:
        """Merges the newest runs, if they have grown enough, and deletes what earlier merges stand for."""
        runs = self.current()
        sizes = [self.bytes(run) for run in runs]
        at, total = len(runs) - 1, sizes[-1] if runs else 0
        while at > 0 and total * RATIO >= sizes[at - 1]:
            at -= 1
            total += sizes[at]
        if at >= len(runs) - 1:
            return None
        old = [run for run in self.complete() if run not in runs]
        own = self.merge(runs[at:])
        for run in old:
            for table in _listed(self.spark, run.path):
                if table != "manifest":
                    p, system = self._path(f"{run.path}/{table}")
                    system.delete(p, True)
        return own
