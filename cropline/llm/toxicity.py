"""Toxicity: severity grades by cumulative-link ordinal regression.

A text's features are sparse: which of a few hundred word beginnings and words it
has, and how often per word. One weight vector scores the text, and ordered
thresholds cut the score into grades: ``P(grade >= j) = sigmoid(score - cut_j)``.
All thresholds share the weights. The output is the expected severity, the sum of
these probabilities, and the most likely side of the first threshold.

Grades of labelled documents are 0 (not toxic), 1 (toxic) and 2 (toxic and of low
quality as well). The model is fitted on at most ``TRAINING`` labelled documents,
those with the least hash of their id, and of the texts these have, those with the least
hash of id and text. Words are counted in tasks; features are
chosen by how much more often one class has them. Only the counts of the chosen
features of the training documents come to the driver. Every document is scored,
whole.

Defined results: a null text is an empty one and has no features. Labels without a
document or with a null count for nothing, those with an id that several documents share
for each of them, equal rows for one; without toxic and non-toxic labels every text has severity 0. Repeated rows
get equal scores. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cropline.llm.common import column, fresh
from cropline.session import materialise

TRAINING = 8_192
FEATURES = 400
SUPPORT = 5
SHORTEST, LONGEST = 4, 8
STEPS = 400
PENALTY = 2e-4
_WORD = re.compile(r"[^\W\d_]+")


def _starts(text: str) -> Counter:
    """How many words begin with each start, and have each whole word (closed by a space)."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
            found[word[:size]] += n
        found[word + " "] += n
    return found


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each start, by class: one row per start and task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for grade, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            (toxic if grade else clean).update(_starts(text.as_py()).keys())
    starts = list(toxic.keys() | clean.keys())
    for at in range(0, len(starts), 100_000):
        part = starts[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array([toxic[s] for s in part], pa.int64()), pa.array([clean[s] for s in part], pa.int64())],
            ["start", "toxic", "clean"],
        )


class Matcher:
    """Counts chosen starts and words in whole texts."""

    def __init__(self, starts: list[str]):
        self.starts = starts
        self.automaton = ahocorasick.Automaton()
        for i, start in enumerate(starts):
            word = start.rstrip(" ")
            known = self.automaton.get(word, (len(word), []))
            known[1].append((i, start != word))
            self.automaton.add_word(word, known)
        if starts:
            self.automaton.make_automaton()

    def counts(self, text: str) -> tuple[Counter, int]:
        """Words per feature, and about how many words there are."""
        found: Counter = Counter()
        low = text.lower()
        if self.starts:
            for end, (size, uses) in self.automaton.iter(low):
                first = end - size + 1
                if first and low[first - 1].isalpha():
                    continue
                whole = end + 1 == len(low) or not low[end + 1].isalpha()
                for feature, closed in uses:
                    if whole or not closed:
                        found[feature] += 1
        return found, len(low.split())


def _rate(n: int, words: int) -> float:
    """Frequency of a feature in a thousand words, on a scale near that of presence."""
    return float(np.log1p(1000.0 * n / max(words, 1))) / 4


@dataclass(frozen=True)
class Model:
    starts: tuple[str, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def severity(self, matcher: Matcher, text: str) -> tuple[float, float]:
        """Probability of a grade above 0, and expected grade."""
        if not self.cuts:
            return 0.0, 0.0
        found, words = matcher.counts(text)
        score, size = 0.0, len(self.starts)
        for feature in sorted(found):
            score += self.weights[feature]
            score += self.weights[size + feature] * _rate(found[feature], words)
        above = [1.0 / (1.0 + float(np.exp(cut - score))) for cut in self.cuts]
        return above[0], sum(above)


def _fit(x: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts: penalised likelihood, by full-batch Adam steps."""
    levels = int(grades.max(initial=1))
    weights = np.zeros(x.shape[1])
    shares = np.array([np.clip((grades >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, levels + 1)])
    base = -np.log(shares / (1 - shares))
    # The first cut is free, later ones lie a positive step above the one before.
    raw = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    theta = np.concatenate([weights, raw])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        score = x @ theta[: x.shape[1]]
        steps = np.exp(theta[x.shape[1] + 1 :])
        cuts = theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(steps)])
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -30, 30)))
        edge = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
        rows = np.arange(len(x))
        low, high = edge[rows, grades], edge[rows, grades + 1]
        chance = np.maximum(low - high, 1e-9)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        by_score = -(slope_low - slope_high) / chance / len(x)
        by_cut = np.zeros((len(x), levels))
        for j in range(levels):
            by_cut[:, j] = np.where(grades == j + 1, slope_low, 0) - np.where(grades == j, slope_high, 0)
        by_cut = (by_cut / chance[:, None]).sum(axis=0) / len(x)
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([x.T @ by_score + PENALTY * theta[: x.shape[1]], tail[:1], tail[1:] * steps])
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(theta[x.shape[1] + 1 :]))])
    return theta[: x.shape[1]], cuts


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    training: int = TRAINING,
) -> Model:
    """Fit on at most ``training`` documents of ``labels`` (``doc_id``, ``quality``, ``toxic``)."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2)
    grade = grade.when(F.col("toxic") == 1, 1)
    known = labels.select(F.col("doc_id").alias("_label"), grade.alias("_grade")).filter("_grade IS NOT NULL")
    chosen = materialise(known.orderBy(F.xxhash64("_label"), "_label", "_grade").limit(training))
    texts = docs.select(
        column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text")
    )
    # Ids can be shared by many texts, so the bound holds for what the join gives: of equal rows one
    # counts, and of the others those with the least hash. Both sides of broadcasts have at most ``training`` rows.
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label")).select(
        "_id", "_grade", "_text", F.xxhash64("_id", "_text", "_grade").alias("_mark")
    )
    marks = materialise(joined.select(F.col("_mark").alias("_taken")).distinct().orderBy("_taken").limit(training))
    sample = materialise(
        joined.join(F.broadcast(marks), F.col("_mark") == F.col("_taken"), "left_semi").dropDuplicates(["_mark"]).drop("_mark")
    )
    sizes = dict(sample.groupBy((F.col("_grade") > 0).cast("int")).count().collect())
    ill, well = sizes.get(1, 0), sizes.get(0, 0)
    if not ill or not well:
        return Model((), (), ())
    presence = sample.select("_grade", "_text").mapInArrow(_presence, "start string, toxic bigint, clean bigint")
    counted = presence.groupBy("start").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    both = F.col("t") + F.col("c")
    pooled = both / F.lit(ill + well)
    spread = F.sqrt(pooled * (1 - pooled) * F.lit(1 / ill + 1 / well) + 1e-12)
    strength = F.abs(F.col("t") / F.lit(ill) - F.col("c") / F.lit(well)) / spread
    best = counted.filter(both >= SUPPORT).orderBy(strength.desc(), "start").limit(FEATURES)
    starts = sorted(row.start for row in best.collect())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(starts)
        for batch in batches:
            found = [matcher.counts(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([sorted(f) for f, _ in found], pa.list_(pa.int32())),
                    pa.array([[_rate(f[i], words) for i in sorted(f)] for f, words in found], pa.list_(pa.float64())),
                ],
                ["_id", "_grade", "_has", "_rates"],
            )

    kind = sample.schema["_id"].dataType.simpleString()
    # At most ``training`` rows, each with the few chosen features that it has.
    sparse = sample.mapInArrow(features, f"_id {kind}, _grade int, _has array<int>, _rates array<double>")
    rows = sparse.orderBy("_id", "_grade", "_has", "_rates").collect()
    x = np.zeros((len(rows), 2 * len(starts)))
    for values, row in zip(x, rows):
        values[row["_has"]] = 1.0
        values[[len(starts) + i for i in row["_has"]]] = row["_rates"]
    weights, cuts = _fit(x, np.array([r["_grade"] for r in rows]))
    return Model(tuple(starts), tuple(map(float, weights)), tuple(map(float, cuts)))


def score_severity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(_id, toxic_probability, severity, rejected)`` of every row."""
    texts = docs.select(
        column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text")
    )
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(list(model.starts))
        for batch in batches:
            found = [model.severity(matcher, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] >= 0.5 for f in found], pa.bool_()),
                ],
                ["_id", "toxic_probability", "severity", "rejected"],
            )

    return texts.mapInArrow(run, f"_id {kind}, toxic_probability double, severity double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` without the rejected rows: a filter inside each task, no join."""
    verdict = fresh(docs.columns, "_verdict")

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(list(model.starts))
        for texts in batches:
            yield texts.map(lambda text: model.severity(matcher, text or "")[0] >= 0.5)

    return docs.withColumn(verdict, rejected(column(text_column))).filter(~F.col(verdict)).drop(verdict)
