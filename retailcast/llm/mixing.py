"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Every document draws an exponential key, divided by its quality weight; the smallest keys come first.
A source takes whole epochs of all its documents, then documents in key order up to the rest of its
target. No source is sorted as a whole: keys are counted into buckets, sums over the buckets show in
which bucket a source's budget ends, and only the documents of that bucket are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import free_prefix, sent_if_small, text_or_empty, word_count
from retailcast.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 1024
SEED = 20_011


def quality_weight(text_col: str = "text") -> Column:
    """Share of characters that are no symbols, a tenth at least; 1 for empty texts."""
    text = text_or_empty(text_col)
    plain = F.length(F.regexp_replace(text, r"[*#$%&|<>{}=~^]+", ""))
    return F.when(F.length(text) == 0, 1.0).otherwise(F.greatest(plain / F.length(text), F.lit(0.1)))


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, weight: Column, seed: int) -> DataFrame:
    draw = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), weight.alias("weight"), draw.alias("draw"))
    return narrow.select("doc_id", "source", "size", (-F.log("draw") / F.col("weight")).alias("key"), _bucket(F.col("draw"), F.col("weight")).alias("bucket"))


def _bucket(draw: Column, weight: Column) -> Column:
    """Grows with the key; near uniform, as 1 - draw ** (1 / weight) is for weights near 1."""
    return F.floor((1 - F.pow(draw, 1 / weight)) * BUCKETS).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: shares of the summed size by weight, none above ``max_epochs``
    times its source's size.

    ``sizes`` has a row per source (source, source_size), so the windows without partition see one
    row per source. The sources reach their limits in the order of limit / weight; those after the
    first that stays below it share what is left by weight.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    given = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_epochs)
    in_order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("limit").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(in_order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    shared = given.withColumn("level", (total - before) / after).withColumn("place", F.row_number().over(in_order))
    shared = shared.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * open_level)
    return shared.select("source", "source_size", target.alias("target"))


def _plan(keyed: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Per source: target, whole epochs, the bucket in which its budget ends, what is left for it there."""
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = materialize(sums, "bucket-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(max_epochs)))
    targets = targets.withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    cumulated = sums.withColumn("upto", running).withColumnRenamed("source", "of")
    met = targets.join(cumulated, F.col("source").eqNullSafe(F.col("of")) & (F.col("upto") > F.col("budget")), "left")
    ends = F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("words")).alias("left")))
    plan = met.groupBy("source", "source_size", "target", "epochs").agg(ends.alias("end"))
    return materialize(
        plan.select(F.col("source").alias("__source"), "source_size", "target", "epochs", F.col("end.bucket").alias("end_bucket"), F.col("end.left").alias("end_left")),
        "mixing-plan",
    )


def _edge(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of each source's last bucket, with the words taken of them."""
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("__source"))).where(F.col("bucket") == F.col("end_bucket"))
    order = Window.partitionBy("source").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_left") - before)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    weight: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    Sources in code point order (null last) weigh ``weights`` in turn and share all words. ``taken``
    counts words with repeats; the document at which a source's budget ends is taken in part, so that
    a source takes its target, rounded down. Null texts have no words, and nothing is taken of empty
    ones. Null ids draw one common key; equal keys are ordered by id, then size, and what rows that
    agree in all of these get is the same in sum. An empty table gives an empty result, a source
    without words the target 0. Columns of other names are not read.
    """
    keyed = materialize(_keys(docs, id_col, source_col, text_col, quality_weight(text_col) if weight is None else weight, seed), "mixing-keys")
    plan = sent_if_small(_plan(keyed, weights, max_epochs))
    met = keyed.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    whole = met.where(F.coalesce(F.col("bucket") != F.col("end_bucket"), F.lit(True)))
    whole = whole.withColumn("part", F.when(F.col("bucket") < F.col("end_bucket"), F.col("size")).otherwise(0))
    both = whole.select("doc_id", "size", "source_size", "target", "epochs", "part").unionByName(
        _edge(keyed, plan).select("doc_id", "size", "source_size", "target", "epochs", "part")
    )
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as rows of ``docs``: a document stands as often as it is taken.

    Documents stay whole here: the one at which a budget ends is taken if at least half of it fits.
    Only documents of the buckets in which budgets end are joined by id; all others are told by their
    source and key. Documents without words stand once.
    """
    weight = quality_weight(text_col)
    keyed = materialize(_keys(docs, id_col, source_col, text_col, weight, seed), "mixing-keys")
    plan = sent_if_small(_plan(keyed, weights, max_epochs))
    draw = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))
    pre = free_prefix(docs)
    at = lambda name: F.col(f"{pre}{name}")
    own = docs.withColumns({f"{pre}bucket": _bucket(draw, weight), f"{pre}size": word_count(text_col)})
    steps = plan.select(F.col("__source").alias(f"{pre}source"), F.col("epochs").alias(f"{pre}epochs"), F.col("end_bucket").alias(f"{pre}end"))
    own = own.join(steps, F.col(source_col).eqNullSafe(at("source")))
    at_end = F.coalesce(at("bucket") == at("end"), F.lit(False)) & (at("size") > 0)
    times = F.when(at("size") == 0, 1).otherwise(at("epochs") + F.when(at("bucket") < at("end"), 1).otherwise(0))
    whole = own.where(~at_end).withColumn(f"{pre}times", times.cast("int"))
    edge = _edge(keyed, plan).where("size > 0").groupBy(F.col("doc_id").alias(f"{pre}id"), F.col("size").alias(f"{pre}words"))
    edge = edge.agg(F.max((F.col("part") * 2 >= F.col("size")).cast("int")).alias(f"{pre}more"))
    cut = own.where(at_end).join(edge, F.col(id_col).eqNullSafe(at("id")) & (at("size") == at("words")))
    cut = cut.withColumn(f"{pre}times", (at("epochs") + at("more")).cast("int"))
    kept = [*docs.columns, f"{pre}times"]
    rows = whole.select(*kept).unionByName(cut.select(*kept)).where(at("times") > 0)
    return rows.withColumn(f"{pre}copy", F.explode(F.sequence(F.lit(1), at("times")))).select(*docs.columns)
