"""Quality classifier from weak labels: heuristic labellers, a label model fitted by expectation-maximisation, a hashed linear scorer.

1. Labellers look at a text and vote good, bad or nothing. They overlap, and none is right always.
2. The votes of all documents are counted by pattern (at most 3 to the power of the number of labellers, so a bounded table,
   whatever the corpus). Expectation-maximisation on these counts estimates for each labeller how often it casts each vote on good and
   on bad documents, and for each pattern the probability that its documents are good.
3. These posteriors are the labels on which a logistic scorer over hashed features is trained: words, pairs of neighbouring
   character classes, and stepped shape figures. It is fitted on at most SAMPLE documents, those with the smallest hashes,
   with whole texts; labelling, counting and scoring cover every document.

4. A second scorer of the same kind learns toxic vocabulary, in whatever language, from the toxic column of a table of labels: over the beginnings of
   words (so that the stems of unseen words count), on at most TOXIC_SAMPLE toxic and CLEAN_SAMPLE other labelled documents, those with the smallest
   hashes, with whole texts. Every whole document is scored.

A document is kept if the scorer's probability is at least KEEP and its probability of being toxic is below TOXIC. A short list of insults is one
of the labellers, weighed like the others; it rejects nothing by itself.

Corner cases: a null or blank text has quality 0 and is not kept. Very long texts are read whole. Repeated rows and rows without doc_id are
judged like any other; equal texts get equal scores. A corpus in which no labeller ever votes, or an empty one, leaves
the scorer at its prior. Of labels only the toxic column is read; without labels, or without both kinds of them, no document counts as toxic.
A column of docs named quality_verdict gives way to judge()'s own; kept() keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import fill_missing, rows_at_once
from loomtext.llm.sketch import Hasher, _mixed

#: Documents, at most, on which the scorer is fitted.
SAMPLE = 4000
DIMENSIONS = 1 << 16
KEEP = 0.5
#: Texts that a worker gets at once when the models are fitted.
TEXTS = 1000
#: Features that the driver looks at together when it fits.
PART = 1 << 17
#: Labelled documents, at most, on which the scorer of toxic vocabulary is fitted, and the probability from which a document is toxic.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 1500
TOXIC = 0.5
#: Lengths in bytes of the beginnings of words that it looks at, beside whole words, and the dimensions that these are hashed to.
STEMS, STEM_DIMENSIONS = (5, 6, 7, 8, 10), 1 << 18
#: Insults.
INSULTS = ("clown", "disgusting", "dumb", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
INSULT = re.compile(rb"(?<![a-z0-9_])(?:" + b"|".join(w.encode() for w in INSULTS) + rb")(?![a-z0-9_])")

#: Character classes: other, lower, upper, digit, space, line end, sentence end, other punctuation, sign, bar, beyond ASCII.
OTHER, LOWER, UPPER, DIGIT, SPACE, LINE, STOP, POINT, SIGN, BAR, WIDE = range(11)


def _classes() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t", SPACE), ("\n\r\v\f", LINE), (".!?", STOP), (",;:'\"()-/", POINT), ("#$%&*+<=>@[]\\^_`{}~", SIGN), ("|", BAR)):
        of[[ord(c) for c in chars]] = kind
    of[128:] = WIDE
    return of


CLASSES = _classes()
NAMES = ("signs", "signed", "bars", "capitals", "shouts", "commonest", "distinct", "run", "length", "stops", "lines", "digits")
#: Where the shape figures are cut into steps.
STEPS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 1.0, 2.0, 4.0, 8.0, 16.0])


@dataclass
class Profile:
    words: np.ndarray
    pairs: np.ndarray
    shape: np.ndarray
    insults: int


def profile(text: str | None, hasher: Hasher) -> Profile:
    data = (text or "").encode("utf-8", "replace")
    words = hasher.words(data)
    n = len(words)
    if not n:
        return Profile(words, np.zeros(0), np.zeros(len(NAMES)), 0)
    kinds = CLASSES[np.frombuffer(data, np.uint8)]
    count = np.bincount(kinds, minlength=11)
    pairs = np.bincount(kinds[:-1].astype(np.int64) * 16 + kinds[1:], minlength=256)
    seen = np.unique(words, return_counts=True)[1]
    change = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = count[LOWER] + count[UPPER]
    shape = np.array([
        count[SIGN] / len(data), pairs[SIGN * 16 + SIGN] / n, count[BAR] / n, count[UPPER] / max(letters, 1), data.count(b"!") / n, seen.max() / n,
        len(seen) / n, np.diff(change).max(), (len(data) - count[SPACE] - count[LINE]) / n, count[STOP] / n, 1 - len(set(lines)) / len(lines), count[DIGIT] / len(data),
    ])
    return Profile(words, pairs, shape, len(INSULT.findall(data.lower())))


def votes(p: Profile) -> str:
    """A letter for each labeller: g, b or - (no vote)."""
    n, f = len(p.words), dict(zip(NAMES, p.shape.tolist(), strict=True))

    def vote(bad: bool, good: bool, least: int = 1) -> str:
        return "-" if n < least else "b" if bad else "g" if good else "-"

    return "".join((
        vote(f["signs"] > 0.03, f["signs"] < 0.01),
        vote(f["signed"] > 0.1, f["signed"] < 0.02),
        vote(f["bars"] > 0.1, f["bars"] < 0.02),
        vote(f["capitals"] > 0.3, f["capitals"] < 0.2, 5),
        vote(f["shouts"] > 0.1, f["shouts"] < 0.05),
        vote(f["commonest"] > 0.2, f["commonest"] < 0.12, 20),
        vote(f["run"] >= 6, f["run"] <= 3, 20),
        vote(not 2 <= f["length"] <= 14, 3 <= f["length"] <= 10, 5),
        vote(not 0.01 <= f["stops"] <= 0.5, 0.02 <= f["stops"] <= 0.35, 30),
        vote(f["lines"] > 0.4, f["lines"] < 0.2, 20),
        vote(f["distinct"] < 0.15, f["distinct"] > 0.3, 40),
        vote(p.insults > 0, p.insults == 0, 20),
    ))


def fit_labels(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, rates[labeller, class, vote of bad or good]): expectation-maximisation from the votes' balance."""
    if not patterns:
        return np.zeros(0), np.zeros((0, 2, 2))
    given = np.array([["bg-".index(c) for c in p] for p in patterns])
    one = np.eye(3)[given][:, :, :2]  # pattern, labeller, vote; no vote tells nothing
    good, bad = one[:, :, 1].sum(1), one[:, :, 0].sum(1)
    # At first, a bad vote outweighs a good one: labellers name single faults.
    posterior = np.where(bad > 0, 0.2 / bad.clip(1), 0.9) * (good + bad > 0) + 0.5 * (good + bad == 0)
    rates = np.zeros((given.shape[1], 2, 2))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])  # class, pattern
        rates = np.einsum("cp,plv->lcv", weight, one) + 0.5
        rates /= rates.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        score = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", one, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, rates


def hashed(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of a text's features."""
    seen, times = np.unique(p.words, return_counts=True)
    pairs = np.flatnonzero(p.pairs)
    steps = np.searchsorted(STEPS, p.shape) + 16 * np.arange(len(p.shape))
    at = np.concatenate([seen % np.uint64(DIMENSIONS - 1024), DIMENSIONS - 1024 + pairs.astype(np.uint64), DIMENSIONS - 512 + steps.astype(np.uint64)])
    values = np.concatenate([np.sqrt(times / max(1, len(p.words))) * 0.5, np.sqrt(p.pairs[pairs] / max(1, p.pairs.sum())), np.full(len(steps), 0.5)])
    return at.astype(np.int64), values


def stems(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of a text's words and their beginnings."""
    data = (text or "").encode("utf-8", "replace")
    starts, ends, sums = hasher.sums(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    found = [_mixed((sums[ends] - sums[starts]) * hasher.back[starts]) % np.uint64(STEM_DIMENSIONS)]
    for n in STEMS:
        at = starts[ends - starts >= n]
        found.append(_mixed((sums[at + n] - sums[at]) * hasher.back[at] + np.uint64(n)) % np.uint64(STEM_DIMENSIONS))
    seen, times = np.unique(np.concatenate(found), return_counts=True)
    return seen.astype(np.int64), np.sqrt(times / len(starts)) * 0.5


def fit_scorer(picked: pa.Table, labels: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer for soft labels of rows(at, values), by full gradients with adaptive steps. The features stay where Arrow has put them."""
    weights, bias = np.zeros(dimensions), 0.0
    n = picked.num_rows
    if not n:
        return weights, bias
    lists = picked.column("at").combine_chunks()
    at, values = lists.flatten().to_numpy(), picked.column("values").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy())
    parts = [slice(k, k + PART) for k in range(0, len(at), PART)]
    first, second, of_bias = np.zeros(dimensions), np.zeros(dimensions), [0.0, 0.0]
    # Both classes weigh the same, however rare one is.
    share = np.clip(labels.mean(), 0.02, 0.98)
    importance = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share))
    for k in range(1, rounds + 1):
        z = sum((np.bincount(row[p], values[p] * weights[at[p]], n) for p in parts), np.full(n, bias))
        error = (1 / (1 + np.exp(-z)) - labels) * importance / n
        slope = sum((np.bincount(at[p], values[p] * error[row[p]], dimensions) for p in parts), decay * weights)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        of_bias = [0.9 * of_bias[0] + 0.1 * error.sum(), 0.999 * of_bias[1] + 0.001 * error.sum() ** 2]
        warm = 1 - 0.9**k, 1 - 0.999**k
        weights -= rate * (first / warm[0]) / (np.sqrt(second / warm[1]) + 1e-8)
        bias -= rate * (of_bias[0] / warm[0]) / (np.sqrt(of_bias[1] / warm[1]) + 1e-8)
    return weights, bias


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    posteriors: dict[str, float]
    rates: np.ndarray
    toxic_weights: np.ndarray | None = None
    toxic_bias: float = 0.0

    def toxic(self, text: str | None, hasher: Hasher) -> float:
        if self.toxic_weights is None:
            return 0.0
        at, values = stems(text, hasher)
        return float(1 / (1 + np.exp(-np.clip(values @ self.toxic_weights[at] + self.toxic_bias, -500, 500)))) if len(at) else 0.0

    def quality(self, p: Profile) -> float:
        if not len(p.words):
            return 0.0
        at, values = hashed(p)
        return float(1 / (1 + np.exp(-np.clip(values @ self.weights[at] + self.bias, -500, 500))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Label model on the votes of all docs, scorer on at most sample of them."""

    @F.pandas_udf("string")
    def pattern(texts: pd.Series) -> pd.Series:
        hasher = Hasher(1)
        return pd.Series([votes(profile(t, hasher)) for t in texts])

    rows = fill_missing(docs, doc_id="long", text="string")
    with rows_at_once(docs.sparkSession, TEXTS):
        counted = rows.select(pattern("text").alias("votes")).groupBy("votes").count().toPandas().sort_values("votes")
    patterns, counts = counted["votes"].tolist(), counted["count"].to_numpy(float)
    posterior, rates = fit_labels(patterns, counts)
    posteriors = dict(zip(patterns, posterior.tolist(), strict=True))

    total = int(counts.sum())
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    drawn = rows.where(draw < min(1.0, 1.5 * sample / max(1, total))).select(draw.alias("draw"), "text").orderBy("draw").limit(sample)

    @F.pandas_udf("at array<int>, values array<float>, votes string")
    def features(texts: pd.Series) -> pd.DataFrame:
        hasher = Hasher(1)
        found = [profile(t, hasher) for t in texts]
        both = [hashed(p) for p in found]
        return pd.DataFrame({"at": [a.astype(np.int32) for a, _ in both], "values": [v.astype(np.float32) for _, v in both], "votes": [votes(p) for p in found]})

    with rows_at_once(docs.sparkSession, TEXTS):
        picked = drawn.select(features("text").alias("f")).select("f.*").toArrow()
    weights, bias = fit_scorer(picked, np.array([posteriors[v] for v in picked.column("votes").to_pylist()], float))
    return Model(weights.astype(np.float32), bias, posteriors, rates)


def toxic_sample(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled documents on which toxic vocabulary is learnt."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("toxic"))
    drawn = [rows.where(which).orderBy(draw, "doc_id").limit(most) for which, most in (("toxic = 1", TOXIC_SAMPLE), ("toxic = 0", CLEAN_SAMPLE))]
    return drawn[0].union(drawn[1])


def fit_toxic(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """(weights, bias) of the scorer of toxic vocabulary; None if there are not both kinds of labels."""

    @F.pandas_udf("at array<int>, values array<float>")
    def features(texts: pd.Series) -> pd.DataFrame:
        hasher = Hasher(1)
        both = [stems(t, hasher) for t in texts]
        return pd.DataFrame({"at": [a.astype(np.int32) for a, _ in both], "values": [v.astype(np.float32) for _, v in both]})

    rows = fill_missing(docs, doc_id="long", text="string").join(toxic_sample(labels), "doc_id")
    with rows_at_once(docs.sparkSession, TEXTS):
        picked = rows.select("doc_id", "toxic", features("text").alias("f")).select("doc_id", "toxic", "f.*").toArrow().sort_by("doc_id")
    toxic = picked.column("toxic").to_numpy().astype(float)
    if len(np.unique(toxic)) < 2:
        return None
    weights, bias = fit_scorer(picked, toxic, STEM_DIMENSIONS)
    return weights.astype(np.float32), bias


def judge(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP, labels: DataFrame | None = None) -> DataFrame:
    """The columns of docs and quality_verdict: quality, labels (the label model's posterior), votes, insults, toxic, keep."""
    model = fit(docs, sample)
    if labels is not None and (learnt := fit_toxic(docs, labels)):
        model.toxic_weights, model.toxic_bias = learnt

    @F.pandas_udf("quality double, labels double, votes string, insults int, toxic double, keep boolean")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        hasher, out = Hasher(1), []
        for text in texts:
            p = profile(text, hasher)
            quality, cast, toxic = model.quality(p), votes(p), model.toxic(text, hasher)
            out.append((quality, model.posteriors.get(cast, 0.5), cast, p.insults, toxic, quality >= keep and toxic < TOXIC and len(p.words) > 0))
        return pd.DataFrame(out, columns=["quality", "labels", "votes", "insults", "toxic", "keep"])

    return docs.withColumn("quality_verdict", verdict(docs["text"].cast("string")))


def kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    own = docs.select(F.struct("*").alias("quality_row"), docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    return judge(own, **options).where("quality_verdict.keep").select("quality_row.*")
