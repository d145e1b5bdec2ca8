"""Quality classifier: a sparse rule ensemble.

Texts are described by statistics of all their characters, words and lines, taken in
one Arrow pass (as Spark expressions they cost five times the CPU). A forest of
shallow trees is grown on labelled texts, and every path from a root to a node becomes
a rule, a conjunction of comparisons with thresholds. Logistic regression with
an L1 penalty gives most rules no weight. The others, their weights and the intercept
are compiled to one Spark column over the statistics, so whole tables are scored without a
join or a shuffle.

Statistics are shares and means, so a text's length alone tells nothing. Letters are those
of ASCII and all characters beyond it. The
model is fitted on at most ``TRAINING`` labelled texts: labels with the least hash of
their id are taken, and of the texts these have, those with the least hash.

Defined results: a null text is an empty one; its statistics are zeros, and it is scored
like any other. Labels that are null or without a document count for nothing; where several
documents share an id, each has its label, within the bound. Repeated rows count as
often as they come, and get equal scores. With labels of one kind only, every
score is the share of that kind, 1 or 0; without labels it is 0.5. An empty table gives
an empty result. Columns of the texts other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cropline.llm.common import column
from cropline.session import materialise

TRAINING = 8_192
TREES = 40
DEPTH = 3
PENALTY = 3e-4
SEED = 7
THRESHOLD = 0.7


STATISTICS = ("letters", "capitals", "digits", "stops", "marks", "word_length", "line_words", "distinct", "repeats")

# Bytes that are not the first of a character, and ASCII characters by kind; all others are letters.
_LATER = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())


def _measure(text: bytes) -> tuple[float, ...]:
    """The ``STATISTICS`` of a UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    size = len(joined)

    def found(kind: bytes) -> int:
        return size - len(joined.translate(None, kind))

    characters, others, digits, stops = size - found(_LATER), found(_OTHERS), found(_DIGITS), found(_STOPS)
    letters, count = characters - others, max(len(words), 1)
    return (
        letters / max(characters, 1),
        found(_CAPITALS) / max(letters, 1),
        digits / max(characters, 1),
        stops / count,
        (others - digits - stops) / count,
        characters / count,
        len(words) / (text.count(b"\n") + 1),
        len(set(words)) / count,
        sum(map(eq, words, islice(words, 1, None))) / count,
    )


def _measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # The text is the last column; statistics take its place.
        found = [_measure(text.as_py()) for text in batch.column(batch.num_columns - 1)]
        columns = [pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * len(STATISTICS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *STATISTICS])


def statistics(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with the columns ``STATISTICS`` in place of ``text``."""
    others = [c for c in texts.columns if c != text]
    rows = texts.select(*others, F.coalesce(column(text).cast("string"), F.lit("")).cast("binary").alias(text))
    layout = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in STATISTICS]])
    return rows.mapInArrow(_measure_all, layout)


@dataclass(frozen=True)
class Bound:
    """A comparison: the statistic is at most the threshold, or above it."""

    name: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.name)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Bound, ...]


def _condition(rule: Rule) -> Column:
    result = rule[0].holds()
    for bound in rule[1:]:
        result = result & bound.holds()
    return result


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules. Without any, every score is ``constant``."""

    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()
    intercept: float = 0.0
    constant: float | None = 0.5

    def score(self) -> Column:
        """Probability of label 1, from the columns that :func:`statistics` gives."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(_condition(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, names: list[str], rule: Rule = ()) -> list[Rule]:
    """Rules of a node and all below it; of several bounds of one kind the tightest counts."""
    found = [rule] if rule else []
    if node.numDescendants() == 0:
        return found
    split = node.split()
    name, threshold = names[split.featureIndex()], float(split.threshold())
    for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
        others = tuple(b for b in rule if (b.name, b.above) != (name, above))
        bound = Bound(name, above, threshold)
        longer = tuple(sorted((*others, bound), key=lambda b: (b.name, b.above)))
        found += _paths(child, names, longer)
    return found


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, training: int) -> DataFrame:
    """Statistics and ``label`` of at most ``training`` labelled rows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    chosen = known.select(F.col("doc_id").alias("_label"), F.col("quality").cast("double").alias("label"))
    chosen = materialise(chosen.orderBy(F.xxhash64("_label"), "_label", "label").limit(training))
    texts = docs.select(
        column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text")
    )
    # ``chosen`` has at most ``training`` rows; as many texts are kept, whatever ids they share.
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label"))
    measured = statistics(joined.select("label", F.xxhash64("_id", "_text").alias("_mark"), "_text"), "_text")
    return measured.orderBy("_mark", "label").limit(training)


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    training: int = TRAINING,
    trees: int = TREES,
    depth: int = DEPTH,
    penalty: float = PENALTY,
) -> RuleModel:
    """Fit on at most ``training`` texts of ``labels`` (``doc_id``, ``quality``)."""
    names = list(STATISTICS)
    # One task sums at most ``training`` short rows, in order, so that a rerun gives the same model.
    sample = materialise(_sample(docs, labels, id_column, text_column, training).coalesce(1))
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return RuleModel(constant=kinds[0] if kinds else 0.5)
    measured = sample.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, bootstrap=False, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED
    ).fit(measured)
    roots = [tree._call_java("rootNode") for tree in forest.trees]
    rules = sorted({rule for root in roots for rule in _paths(root, names)}, key=repr)
    if not rules:
        return RuleModel(constant=sample.agg(F.avg("label")).first()[0])
    held = materialise(sample.select("label", F.array(*[_condition(r).cast("double") for r in rules]).alias("held")))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100, tol=1e-6).fit(
        held.select("label", array_to_vector("held").alias("features"))
    )
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(fitted.intercept), None)


def score_quality(docs: DataFrame, model: RuleModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(_id, score, predicted)`` of every row."""
    texts = docs.select(column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text"))
    scored = statistics(texts, "_text").select("_id", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
