"""Heads over feature vectors as aggregates (F1), and the context of the distillation sets (D3).

A teacher's context is two drawn examples, one per class; its evidence is added to the teacher's logits.
Students are fitted by ``operators.descent``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.math import hash_index
from shotgrid.operators.sampling import dense_index


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)


def head_logits(features: Column, w: Column, b: Column) -> Column:
    """``W x + b`` for a head given as arrays."""
    return F.transform(F.arrays_zip(w.alias("wr"), b.alias("bk")), lambda r: dot(features, r["wr"]) + r["bk"])


def ce_loss(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: logsumexp(logits) - logits[label]."""
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(F.transform(logits, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, v: a + v))
    return lse - F.element_at(logits, label + 1)


def draw_context_examples(batches: DataFrame, pool: DataFrame, seed: int, batch_col: str = "batch_key") -> DataFrame:
    """One random pool example per class for every training batch (D3 for features):
    hash-drawn positions joined to a dense per-label index -- O(batches + pool)."""
    idx = dense_index(pool.select("id", "y"), ["id"], ["y"])   # features joined after the draw
    n_by = idx.groupBy("y").agg(F.count(F.lit(1)).alias("n"))   # one row per class
    draws = batches.select(batch_col).distinct() \
        .select(batch_col, F.explode(F.array(F.lit(0), F.lit(1))).alias("y")) \
        .join(F.broadcast(n_by), "y") \
        .withColumn("idx", hash_index(seed, F.concat_ws("|", F.lit("context"), F.col(batch_col).cast("string"),
                                                        F.col("y").cast("string")), F.col("n")))
    picked = draws.join(idx, ["y", "idx"]).select(batch_col, "y", "id").join(pool.select("id", "features"), "id")
    return picked.groupBy(batch_col).agg(
        F.max(F.when(F.col("y") == 0, F.col("features"))).alias("ctx0"),
        F.max(F.when(F.col("y") == 1, F.col("features"))).alias("ctx1"))


def context_logits(x: Column, ctx0: Column, ctx1: Column, tau: float) -> Column:
    """Evidence of the two context examples: ``-||x - c_k||^2 / tau``."""
    def sq(c):
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.array(-sq(ctx0) / F.lit(tau), -sq(ctx1) / F.lit(tau))


def weighted_means(df: DataFrame, keys: Sequence[str], features: str, weight: str | None = None) -> DataFrame:
    """(keys, mean): the (weighted) mean vector of every group, one partial aggregation."""
    vec = array_to_vector(F.col(features))
    mean = Summarizer.mean(vec, F.col(weight)) if weight else Summarizer.mean(vec)
    return df.groupBy(*keys).agg(mean.alias("mean")).select(*keys, vector_to_array("mean").alias("mean"))


def _head(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, w, b) from one mean vector per (keys, cls)."""
    g = classes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cls", "mean"))).alias("c"))
    g = g.withColumn("w", F.transform("c", lambda c: c["mean"]))
    return g.withColumn("b", F.transform("w", lambda w: -0.5 * dot(w, w))).drop("c")


def centroid_heads(df: DataFrame, keys: Sequence[str] = (), features: str = "features", label: str = "y") -> DataFrame:
    """(keys, w, b): the nearest-centroid head of every group."""
    return _head(weighted_means(df.withColumn("cls", F.col(label)), [*keys, "cls"], features), keys)


@dataclass(frozen=True)
class DistillConfig:
    """Batch sizes of the distillation sets by model (C11)."""
    batch_sizes: dict = field(default_factory=lambda: {"head-small": 4, "head-large": 2})
