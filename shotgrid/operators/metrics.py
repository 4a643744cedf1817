"""Metrics as aggregate expressions.

Partial aggregation before the shuffle is Spark's own (the reference's running correct
count and loss sum across batches, G14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.math import argmax, bce_with_logit, kl_rows
from shotgrid.functions.text import is_parsed, parse_answer

# metric registry (U3): name -> aggregate over (pred, label) columns
METRICS: Mapping[str, callable] = {
    "accuracy": lambda pred, label: F.avg((pred == label).cast("double")),
    "loss": lambda pred, label: F.avg(bce_with_logit(pred, label)),
}


def parse_answers(df: DataFrame, text: str = "generated", label: str = "label") -> DataFrame:
    """Predicted label from generated text, plus whether it was parseable."""
    return df.withColumn("predicted", parse_answer(text, label)).withColumn("parsed", is_parsed(text))


def causal_metrics(df: DataFrame, keys: Sequence[str], pred: str = "predicted", label: str = "label",
                   metrics: Sequence[str] = ("loss", "accuracy")) -> DataFrame:
    """Per group, mean BCE with the hard predicted label as the logit, and accuracy."""
    p, y = F.col(pred), F.col(label)
    return df.groupBy(*keys).agg(*[METRICS[m](p, y).alias(m) for m in metrics],
                                 F.count(F.lit(1)).alias("n"))


def domain_metrics(df: DataFrame, keys: Sequence[str], pred: str = "predicted", label: str = "label",
                   domains: Sequence[str] = ("in", "out")) -> DataFrame:
    """B8 + J4: one row per group with ``eval_{domain}_{metric}`` columns, as a single
    conditional aggregation (no join of per-domain results)."""
    p, y = F.col(pred), F.col(label)
    aggs = []
    for d in domains:
        is_d = F.col("domain") == d
        aggs += [F.avg(F.when(is_d, bce_with_logit(p, y))).alias(f"eval_{d}_loss"),
                 F.avg(F.when(is_d, (p == y).cast("double"))).alias(f"eval_{d}_accuracy"),
                 F.sum(is_d.cast("long")).alias(f"eval_{d}_n")]
    return df.groupBy(*keys).agg(*aggs)


def accuracy_from_logits(df: DataFrame, logits: Mapping[str, str], label: str = "label",
                         keys: Sequence[str] = ()) -> DataFrame:
    """G1 + E7: argmax prediction (lowest index on ties) against the label, for one or
    more logit columns in a single aggregation (``{output name: logits column}``)."""
    return df.groupBy(*keys).agg(
        *[F.avg((argmax(c) == F.col(label)).cast("double")).alias(name) for name, c in logits.items()],
        F.count(F.lit(1)).alias("n"))


def distillation_loss(df: DataFrame, teacher: str, student: str, batch_keys: Sequence[str],
                      temperature: float = 1.0) -> DataFrame:
    """``T^2 * sum KL(softmax(t/T) || softmax(s/T)) / batch size`` per batch; teacher and
    student logits of a row sit in the same row (J3)."""
    kl = kl_rows(teacher, student, temperature)
    return df.groupBy(*batch_keys).agg(
        (F.lit(float(temperature) ** 2) * F.sum(kl) / F.count(F.lit(1))).alias("loss"),
        F.count(F.lit(1)).alias("batch_size"))


def param_counts(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All parameters, trainable ones, and the trainable percentage."""
    g = params.groupBy(*keys).agg(F.sum("n").alias("all_params"),
                                  F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(F.lit(0))).alias("trainable_params"))
    return g.withColumn("trainable_pct", F.lit(100.0) * F.col("trainable_params") / F.col("all_params"))


def freeze(params: DataFrame, where: Column | None = None) -> DataFrame:
    """mark parameters as not trainable (all, or those matching ``where``)."""
    cond = F.lit(True) if where is None else where
    return params.withColumn("trainable", F.when(cond, F.lit(False)).otherwise(F.col("trainable")))
