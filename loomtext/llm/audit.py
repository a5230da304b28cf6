"""Filter interaction audit: what each filter of a sequence removes, in every order, from tables of failing ids.

One table of failing ids is stored for each filter. Ids are taken through them one after the other: the rows that a filter's table holds (left semi) and
those it doesn't (left anti) are told apart, and each row remembers in a number, the mask, which filters it fails. A prefix of an order is a set of
filters; its survivors are the rows that lie on the anti side of all of them, whatever the order, so five filters need five splits for all 120 orders and
325 prefixes. Labels are id tables, too, and told apart alike. Only (part, mask) sums leave the rows: at most 32 times 4 a part, from which
the counts of each of 80 pairs (filters before, filter) are summed, and each order looks its steps up among them.

survivors() and removed() give the ids themselves for one prefix, by the same joins.

A row's id is doc_id with the digest of its text, so rows that share an id or lack one are judged by their own text; the digest is SHA-256, of whole texts.
Identical texts (filter E) are found by the smallest doc_id of each digest: a row fails unless its (doc_id, digest) is among those, so
the join's keys are all different however many copies a text has.

Corner cases: a null text is an empty one; it has 0 words, fails A and neither B nor C nor D; a null doc_id has no smaller one and fails no E, nor makes others fail;
rows equal in doc_id and text share their fate (neither is smaller). A null part is the empty string. A document counts as labelled if any row of labels says so; labels of
other ids and null ids are ignored. An empty table gives an empty report. Extra columns are ignored, whatever their names; a missing doc_id, text or part counts as null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import WORD, Scratch, fill_missing

#: Filters that a report takes at most: it has a row for each order and step.
MOST = 6
KEY = ["audit_id", "audit_digest"]


def text_filters() -> dict[str, Column]:
    """The conditions of the query on a column text, true for rows that fail: too short, repetitive, shouting, markup."""
    text = F.col("text")
    words = F.regexp_count(text, F.lit(WORD))
    different = F.size(F.array_distinct(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")))
    return {
        "A": words < 50,
        "B": 100 * different < 65 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


class Audit:
    """The stored relations of an audit: rows (doc_id, part, key) and a table of failing keys for each filter."""

    def __init__(self, docs: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "source", repeats: str | None = "E"):
        """filters: conditions on text by name; repeats: the name of the filter that later copies of a text fail, or None."""
        filters = text_filters() if filters is None else dict(filters)
        self.names = sorted([*filters, *([repeats] if repeats else [])])
        if len(self.names) > MOST:
            raise ValueError(f"an audit takes at most {MOST} filters")
        self.scratch = Scratch(docs.sparkSession, "audit")
        rows = fill_missing(docs, doc_id="long", text="string", **({part: "string"} if part not in ("doc_id", "text") else {}))
        rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"))
        digest = F.unhex(F.sha2("text", 256))
        # Keys are never null, for joins: a missing id is 0 with a digest of one byte more.
        digest = F.when(F.col("doc_id").isNull(), F.concat(digest, F.unhex(F.lit("00")))).otherwise(digest)
        failed = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in filters.items()]), lambda x: x.isNotNull())
        facts = rows.select("doc_id", "part", F.coalesce("doc_id", F.lit(0)).alias(KEY[0]), digest.alias(KEY[1]), failed.alias("failed"))
        facts = self.scratch.cut(facts, "facts")
        ids = facts.select("failed", *KEY).distinct().select(F.explode("failed").alias("filter"), *KEY)
        ids.write.partitionBy("filter").parquet(f"{self.scratch.root}/failing")
        self.rows = facts.drop("failed")
        key_type = "audit_id long, audit_digest binary"
        session = docs.sparkSession
        there = {r[0] for r in session.read.schema(f"{key_type}, filter string").parquet(f"{self.scratch.root}/failing").select("filter").distinct().collect()} if filters else set()
        none = session.createDataFrame([], key_type)
        self.failing = {name: session.read.schema(key_type).parquet(f"{self.scratch.root}/failing/filter={name}") if name in there else none for name in filters}
        if repeats:
            known = self.rows.where("doc_id IS NOT NULL").select(*KEY)
            first = known.groupBy(KEY[1]).agg(F.min(KEY[0]).alias(KEY[0]))
            self.failing[repeats] = self.scratch.cut(known.distinct().join(first, KEY, "left_anti"), "failing-repeats")

    def survivors(self, prefix: Sequence[str]) -> DataFrame:
        """doc_id, part and key of the rows that no filter of the prefix removes."""
        return reduce(lambda rows, name: rows.join(self.failing[name], KEY, "left_anti"), prefix, self.rows)

    def removed(self, prefix: Sequence[str], name: str) -> DataFrame:
        """The rows that a filter removes after a prefix."""
        return self.survivors(prefix).join(self.failing[name], KEY, "left_semi")

    def masked(self, marks: Mapping[str, DataFrame]) -> DataFrame:
        """part, mask (bit i: fails filter i), and a bit more for each table of doc_ids in marks: rows told apart by one table after the other."""
        rows = self.rows.select("part", "doc_id", *KEY, F.lit(0).alias("mask"))
        tables = [(self.failing[name], KEY) for name in self.names]
        tables += [(ids.select("doc_id").where("doc_id IS NOT NULL"), ["doc_id"]) for ids in marks.values()]
        for bit, (table, key) in enumerate(tables):
            inside = rows.join(table, key, "left_semi").withColumn("mask", F.col("mask") + F.lit(1 << bit))
            outside = rows.join(table, key, "left_anti")
            rows = self.scratch.cut(inside.unionByName(outside), f"split-{bit}")
            if bit:
                self.scratch.drop(f"split-{bit - 1}")
        return rows.select("part", "mask")

    def report(self, marks: Mapping[str, DataFrame]) -> DataFrame:
        """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, <mark>_lost and shapley.

        marks: tables of doc_ids by name, whose removal counts as a loss.
        """
        names, n = self.names, len(self.names)
        cells = self.masked(marks).groupBy("part", "mask").agg(F.count("*").alias("n"))
        cells = self.scratch.cut(cells, "cells")
        self.scratch.drop(f"split-{n + len(marks) - 1}")
        pairs = [(before, bit) for bit in (1 << i for i in range(n)) for before in range(1 << n) if not before & bit]
        pairs = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(b).alias("bit")) for s, b in pairs])
        cells = cells.select("part", "mask", "n", F.inline(pairs))
        fails, met, alone = "(mask & bit) != 0", "(mask & before) != 0", f"(mask & {(1 << n) - 1}) = bit"
        total = lambda test: F.sum(F.expr(f"CASE WHEN {test} THEN n ELSE 0L END"))
        counts = {
            "kept": total(f"NOT ({fails}) AND NOT ({met})"),
            "removed": total(f"{fails} AND NOT ({met})"),
            "redundant": total(f"{fails} AND {met}"),
            "unique_fails": total(alone),
        }
        for i, mark in enumerate(marks):
            counts[f"{mark}_lost"] = total(f"{fails} AND NOT ({met}) AND (mask & {1 << (n + i)}) != 0")
        steps = cells.groupBy("part", "before", "bit").agg(*[c.alias(name) for name, c in counts.items()])
        orders = []
        for order in permutations(range(n)):
            before = 0
            for step, i in enumerate(order, 1):
                orders.append(("".join(names[k] for k in order), step, before, 1 << i))
                before |= 1 << i
        orders = self.rows.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")
        # At most 720 orders of 6 steps, whatever the data.
        found = steps.join(F.broadcast(orders), ["before", "bit"])
        shares = found.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
        found = found.join(shares, ["part", "bit"])
        return found.select("part", "filter_order", "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The report with good_lost (labels.quality = 1) and toxic_lost (labels.toxic = 1)."""
    marked = fill_missing(labels, doc_id="long", quality="int", toxic="int")
    return Audit(docs, **options).report({"good": marked.where("quality = 1"), "toxic": marked.where("toxic = 1")})
