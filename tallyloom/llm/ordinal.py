"""Toxicity as ordinal severity by a cumulative-link (proportional odds) model.

A text's features are the words it holds and their beginnings (four to six
letters, which catch inflected forms), each present or not.  Grades 0..K share
one weight for each feature; thresholds in ascending order part them:
P(grade > k) = 1 / (1 + exp(threshold_k - weights . features)).  The result is
the expected grade.

Labels say toxic or not.  Severity among toxic texts is graded out of fold: the
sample is dealt to folds, a model of the classes is learned from all folds but
one, features chosen anew, and its evidence orders the toxic texts of the fold
left out; the lower half is grade 1, the upper half grade 2.  The cut from which
a text counts as toxic is the one that is right most often out of fold.

Learning reads a bounded sample: at most ``max_rows`` labels, those with the least
hash of their id, of the texts that these ids have (exact copies once) as many at
most, and of the features that
``min_rows`` of them hold and whose shares in the classes differ by ``min_z``
standard errors the ``max_features`` that tell the classes apart best.  Scoring
reads every whole text.

Defined results: null and word-less texts have no features and get the base
rate's severity; rows with null labels or ids are not learned from; with no
labels, or of one class only, every severity is 0 and nothing is toxic; repeated
rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import written
from tallyloom.llm.word_codes import slices

_WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    found = set(words)
    for n in STEMS:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


@dataclass
class Model:
    """Weights by feature, ascending thresholds, and the severity from which a text counts as toxic."""

    weights: dict[str, float]
    thresholds: list[float]
    cut: float = 0.5

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each k."""
        if not self.thresholds:
            return []
        find = self.weights.get
        words = set(_WORD.findall((text or "").lower()))
        total = sum([find(w, 0.0) for w in words])
        for n in STEMS:
            total += sum([find(s, 0.0) for s in {w[:n] + "*" for w in words if len(w) > n}])
        return [1.0 / (1.0 + np.exp(np.clip(t - total, -60, 60))) for t in self.thresholds]


@dataclass
class Sample:
    """Rows of feature numbers, flattened: ``flat[i]`` is a feature of row ``owner[i]``."""

    flat: np.ndarray
    owner: np.ndarray
    rows: int

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sample:
        flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        return cls(flat.astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))


def loss(theta: np.ndarray, sample: Sample, grades: np.ndarray, n_features: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood plus the weights' penalty, and its gradient.

    ``theta`` holds the weights, the first threshold, and the logarithms of the steps up to the others, so these stay in order.
    """
    w, base, gaps = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1 :])
    cuts, n, i = base + np.concatenate(([0.0], np.cumsum(gaps))), sample.rows, np.arange(sample.rows)
    z = np.bincount(sample.owner, w[sample.flat], n)
    # P(grade > k), with 1 before the first threshold and 0 after the last
    over = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -60, 60)))
    padded = np.concatenate((np.ones((n, 1)), over, np.zeros((n, 1))), axis=1)
    slope = padded * (1 - padded)
    p = np.maximum(padded[i, grades] - padded[i, grades + 1], 1e-12)
    by_z, by_low, by_high = (slope[i, grades] - slope[i, grades + 1]) / p, -slope[i, grades] / p, slope[i, grades + 1] / p
    by_cut = np.array([by_low[grades == k + 1].sum() + by_high[grades == k].sum() for k in range(len(cuts))]) / -n
    gradient = np.empty_like(theta)
    gradient[:n_features] = -np.bincount(sample.flat, by_z[sample.owner], n_features) / n + penalty * w
    gradient[n_features] = by_cut.sum()
    gradient[n_features + 1 :] = [by_cut[g + 1 :].sum() * gaps[g] for g in range(len(gaps))]
    return float(-np.log(p).mean() + penalty / 2 * (w @ w)), gradient


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 1e-4, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised likelihood (Adam on the whole sample); ``rows`` hold feature numbers."""
    sample, levels = Sample.of(rows), int(grades.max())
    share = [np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(levels)]
    start = np.array([-np.log(s / (1 - s)) for s in share])
    theta = np.concatenate((np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, gradient = loss(theta, sample, grades, n_features, penalty)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(theta[n_features + 1 :])
    return theta[:n_features], theta[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))


def best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold on P(toxic) that is right most often; of several the one nearest to 1/2."""
    values = np.unique(chance)
    cuts = np.concatenate(([0.5], (values[1:] + values[:-1]) / 2))
    below_bad, below_good = (np.searchsorted(np.sort(chance[which]), cuts, side="left") for which in (toxic, ~toxic))
    right = (toxic.sum() - below_bad) + below_good
    best = cuts[right == right.max()]
    return float(best[np.argmin(np.abs(best - 0.5))])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    max_rows: int = 8000,
    max_features: int = 512,
    min_rows: int = 8,
    min_z: float = 3.0,
    folds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model from a bounded sample of labelled rows."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # One of each set of exact copies, else what a copied text happens to hold seems telling.
    texts = texts.select("text", "toxic").distinct()

    def run(batches):
        for batch in slices(batches, 3):
            found = [sorted(features(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], names=["fold", "toxic", "place", "found"])

    fold = F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int")
    held = written(texts.select(fold.alias("fold"), "toxic", F.xxhash64("text", "toxic").alias("place"), "text").mapInArrow(run, "fold int, toxic boolean, place long, found array<string>"), "labelled-features")
    # A labelled id may stand on any number of texts: of more than max_rows those stay whose hashes are least.
    if held.count() > max_rows:
        last = held.select("place").orderBy("place").limit(max_rows).agg(F.max("place")).first()[0]
        held = written(held.where(F.col("place") <= last).limit(max_rows), "labelled-sample")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in held.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    if len({toxic for toxic, _ in sizes}) < 2:
        return Model({}, [])

    # For each fold left out (folds: none is), the features that tell the classes of the other rows apart.
    def count(toxic: bool, left_out: int):
        return F.count_if((F.col("toxic") == toxic) & (F.col("fold") != left_out))

    def total(toxic: bool, left_out: int) -> int:
        return max(1, sum(n for (t, f), n in sizes.items() if t == toxic and f != left_out))

    counts = F.array(*[F.struct(F.lit(f).alias("out"), count(True, f).alias("a"), count(False, f).alias("b"), F.lit(total(True, f)).alias("bad"), F.lit(total(False, f)).alias("good")) for f in range(folds + 1)])
    each = held.select("toxic", "fold", F.explode("found").alias("feature")).groupBy("feature").agg(counts.alias("counts")).select("feature", F.inline("counts"))
    # Difference of the two shares in standard errors.
    pooled = (F.col("a") + F.col("b")) / (F.col("bad") + F.col("good"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("bad") + 1 / F.col("good")) + F.lit(1e-12))
    scored = each.where(F.col("a") + F.col("b") >= min_rows).withColumn("z", F.abs((F.col("a") / F.col("bad") - F.col("b") / F.col("good")) / spread)).where(F.col("z") >= min_z)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("out").orderBy(F.desc("z"), "feature")))
    chosen: dict[int, dict[str, int]] = {f: {} for f in range(folds + 1)}
    for r in ranked.where(F.col("rank") <= max_features).orderBy("out", "rank").collect():
        chosen[r["out"]][r["feature"]] = r["rank"] - 1
    wanted = F.array(*map(F.lit, sorted(set().union(*chosen.values())))).cast("array<string>")
    rows = held.select("fold", "toxic", F.array_sort(F.array_intersect("found", wanted)).alias("found")).orderBy("fold", "toxic", "found").collect()

    toxic, part = np.array([r["toxic"] for r in rows]), np.array([r["fold"] for r in rows])
    margin, chance, grades = np.zeros(len(rows)), np.zeros(len(rows)), toxic.astype(np.int64)

    def numbered(which: np.ndarray, names: dict[str, int]) -> list[np.ndarray]:
        return [np.array([names[f] for f in rows[i]["found"] if f in names], dtype=np.int64) for i in np.flatnonzero(which)]

    for f in range(folds):
        out = part == f
        if out.any() and len(set(toxic[~out])) == 2:
            weights, cuts = fit(numbered(~out, chosen[f]), grades[~out], len(chosen[f]))
            margin[out] = [weights[x].sum() - cuts[0] for x in numbered(out, chosen[f])]
            chance[out] = 1 / (1 + np.exp(np.clip(-margin[out], -60, 60)))
    for f in range(folds):
        bad = np.flatnonzero((part == f) & toxic)
        if len(bad):
            grades[bad[margin[bad] > np.median(margin[bad])]] = 2
    weights, cuts = fit(numbered(np.ones(len(rows), dtype=bool), chosen[folds]), grades, len(chosen[folds]))
    return Model({name: float(weights[i]) for name, i in chosen[folds].items()}, [float(c) for c in cuts], best_cut(chance, toxic))


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, above array<double>, severity, grade, toxic): expected grade, likeliest grade, and the flag."""
    schema = T.StructType([docs.schema[id_col], T.StructField("above", T.ArrayType(T.DoubleType())), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in slices(batches, 1):
            above = [known.above(t) for t in batch.column(1).to_pylist()]
            chance = [np.diff([1.0, *a, 0.0]) * -1 for a in above]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(above, pa.list_(pa.float64())),
                    pa.array([float(sum(a)) for a in above], pa.float64()),
                    pa.array([int(c.argmax()) for c in chance], pa.int32()),
                    pa.array([bool(a) and a[0] >= known.cut for a in above], pa.bool_()),
                ],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
