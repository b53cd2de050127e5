"""Text quality by a sparse ensemble of rules.

A small forest is grown over statistics of the texts, every path from a root becomes a rule (a
conjunction of thresholds), a lasso logistic regression picks and weighs the rules, and what is left
is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.common import free_prefix, text_or_empty
from retailcast.session import materialize

#: Statistics of a text, in the order of the vectors.
STATISTICS = (
    "words",
    "word_length",
    "symbols",
    "bars",
    "digits",
    "upper",
    "marks",
    "distinct_words",
    "repeats_last_word",
    "top_word",
    "lines_per_word",
    "repeated_lines",
)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Fit:
    """sample: at most so many labelled rows are used for the fit (those whose ids hash lowest)."""

    sample: int = 20_000
    trees: int = 20
    depth: int = 3
    penalty: float = 0.0005
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """Weights of rules; a rule is a tuple of (statistic, "<=" or ">", threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]


def _bytes_of(characters: str) -> list[int]:
    return [ord(c) for c in characters]


def statistics_of(text: str) -> tuple[float, ...]:
    """Shares are of characters, words or lines; all are 0 for an empty text."""
    words = text.split()
    size, n = len(text), len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=128)
    share = lambda which: float(counts[which].sum()) / size
    seen = Counter(words)
    lines = text.split("\n")
    return (
        float(n),
        size / n,
        share(_bytes_of("*#$%&@^~<>{}=")),
        share(_bytes_of("|")),
        share(slice(48, 58)),
        share(slice(65, 91)),
        share(_bytes_of(".,;:!?")),
        len(seen) / n,
        sum(map(str.__eq__, words[1:], words)) / n,
        max(seen.values()) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t) for t in texts], columns=list(STATISTICS), dtype=float)


def _with_statistics(docs: DataFrame, text_col: str) -> Column:
    return text_statistics(text_or_empty(text_col))


def _paths(node, path: tuple = ()) -> Iterator[tuple]:
    """The conjunction above every node but the root."""
    if path:
        yield path
    if node.getClass().getSimpleName() == "InternalNode":
        at, threshold = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        yield from _paths(node.leftChild(), (*path, (at, "<=", threshold)))
        yield from _paths(node.rightChild(), (*path, (at, ">", threshold)))


def _shortened(rule: tuple) -> tuple:
    """At most one threshold for each statistic and direction."""
    tightest: dict[tuple[str, str], float] = {}
    for at, sign, threshold in rule:
        pick = min if sign == "<=" else max
        tightest[at, sign] = pick(threshold, tightest.get((at, sign), threshold))
    return tuple(sorted((at, sign, t) for (at, sign), t in tightest.items()))


def _holds(rule: tuple) -> Column:
    return reduce(Column.__and__, [F.col(at) <= t if sign == "<=" else F.col(at) > t for at, sign, t in rule])


def fit(labelled: DataFrame, settings: Fit = Fit()) -> Model:
    """``labelled`` holds the statistics and ``label`` (0 or 1), and ``doc_id`` to choose the sample.

    Rows without a label are left out. With no labelled rows, or of one class only, the model is a
    constant: 0.5, or nearly that class.
    """
    chosen = labelled.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    rows = materialize(chosen.select(*STATISTICS, F.col("label").cast("double").alias("label")), "fit-rows")
    share = rows.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        return Model(0.0 if share is None else 5.0 * (2 * share - 1), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, minInstancesPerNode=5).fit(vectors)
    rules = sorted({_shortened(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"))})
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    names = [f"rule_{i}" for i in range(len(rules))]
    fired = rows.select("label", *[_holds(r).cast("double").alias(n) for r, n in zip(rules, names)])
    fired = VectorAssembler(inputCols=names, outputCol="features").transform(fired).select("label", "features")
    fired = materialize(fired, "fired-rules")
    lasso = LogisticRegression(regParam=settings.penalty, elasticNetParam=1.0, standardization=False, maxIter=50).fit(fired)
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def score(model: Model) -> Column:
    """Between 0 and 1, over columns named as the statistics."""
    total = reduce(Column.__add__, [F.when(_holds(rule), weight).otherwise(0.0) for rule, weight in model.rules], F.lit(model.intercept))
    return 1 / (1 + F.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never used for a fit; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("doc_id"), _with_statistics(docs, text_col).alias("s"))
    return materialize(narrow.select("doc_id", "s.*"), "statistics")


def _fit_on(table: DataFrame, labels: DataFrame, settings: Fit) -> Model:
    marks = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    return fit(table.join(marks, "doc_id"), settings)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty; these have a score as well. Equal texts score equally. A document with
    several labels counts once for each in the fit. An empty table gives an empty result. Columns of
    ``docs`` other than id and text, whatever their names, are not read.
    """
    table = _statistics_table(docs, id_col, text_col)
    model = _fit_on(table, labels, settings)
    scored = table.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, settings: Fit) -> DataFrame:
    """The rows of ``docs`` that a fit may read, told by ids alone: as few as its sample holds."""
    marks = labels.select(F.col("doc_id").alias("marked")).where(F.col("quality").isin(0, 1) & ~held_out("marked"))
    ids = docs.select(F.col(id_col).alias("doc_id")).join(marks, F.col("doc_id") == F.col("marked"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample).select("marked").distinct()
    return docs.join(F.broadcast(ids), F.col(id_col) == F.col("marked"), "left_semi")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, all their columns as they were.

    The fit reads the texts of its sample only; all others are read once, when they are judged. Null texts
    count as empty, and texts of any length are read whole; equal texts are judged alike, so repeated
    rows stay or go together. Without labelled rows all stay. An empty table stays empty.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = _fit_on(_statistics_table(_sampled(chosen, labels, "doc_id", settings), "doc_id", "text"), labels, settings)
    name = f"{free_prefix(docs)}statistics"
    own = docs.withColumn(name, _with_statistics(docs, text_col))
    nested = Model(model.intercept, tuple((tuple((f"{name}.{a}", s, t) for a, s, t in rule), w) for rule, w in model.rules))
    return own.where(score(nested) >= THRESHOLD).drop(name)
