"""Reporting over metric logs.

Every chart's data is one hash aggregate over the combined log instead of a filter loop
per combination; the results are small (one row per configuration).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotgrid.functions.text import display_label, method_from_file, metric_title
from shotgrid.schemas import PIVOT_METRICS, REPORT_METRICS

CONFIG_KEYS = ["model_name", "sample_size", "finetuning_method"]


def combine_logs(logs: Mapping[str, DataFrame]) -> DataFrame:
    """H1: union of logs with different columns, each tagged with the method parsed from
    its file name (B10); a column missing from a log is null."""
    tagged = [df.withColumn("finetuning_method", method_from_file(F.lit(name))) for name, df in logs.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def reformat_eval_metrics(df: DataFrame, infix: str) -> DataFrame:
    """``eval_x`` -> ``eval_{infix}_x`` for every column starting with 'eval'."""
    return df.withColumnsRenamed({c: f"{c[:4]}_{infix}{c[4:]}" for c in df.columns if c.startswith("eval")})


def means_by_size(df: DataFrame, metric: str) -> DataFrame:
    """G3 + G9: mean in/out metric per sample size (all models mixed), with trial count."""
    return df.groupBy("sample_size").agg(
        F.avg(f"eval_in_{metric}").alias(f"avg_in_{metric}"),
        F.avg(f"eval_out_{metric}").alias(f"avg_out_{metric}"),
        F.count(F.lit(1)).alias("num_trials"))


def means_by_config(df: DataFrame, metrics: Sequence[str] = REPORT_METRICS, group_by: str | None = None,
                    group: object | None = None) -> DataFrame:
    """Mean in/out of each metric per (model, size, method), optionally within one
    group (B6: ``None`` = all data), with its display label (B11)."""
    if group_by is not None and group is not None:
        df = df.filter(F.col(group_by) == F.lit(group))
    aggs = []
    for m in metrics:
        aggs += [F.avg(f"eval_in_{m}").alias(f"avg_in_{m}"), F.avg(f"eval_out_{m}").alias(f"avg_out_{m}")]
    return df.groupBy(*CONFIG_KEYS).agg(*aggs) \
             .withColumn("label", display_label("finetuning_method", "sample_size"))


def pivot_means(df: DataFrame, values: Sequence[str] = PIVOT_METRICS) -> DataFrame:
    """Pivot-table mean by (model, method, size), keys sorted."""
    keys = ["model_name", "finetuning_method", "sample_size"]
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]).orderBy(*keys)


def with_baseline(means: DataFrame, metrics: Sequence[str] = REPORT_METRICS, within: str = "model_name",
                  baseline_method: str = "zeroshot") -> DataFrame:
    """G6 + J5: the zero-shot mean of each metric next to every configuration of the same
    group.  ``means`` has one row per configuration, so the window is small."""
    w = Window.partitionBy(within)
    out = means
    for m in metrics:
        for d in ("in", "out"):
            # mean over the baseline's trials = weighted by trial counts of its rows
            num = F.sum(F.when(F.col("finetuning_method") == baseline_method, F.col(f"_sum_{d}_{m}"))).over(w)
            den = F.sum(F.when(F.col("finetuning_method") == baseline_method, F.col(f"_cnt_{d}_{m}"))).over(w)
            out = out.withColumn(f"base_{d}_{m}", num / den)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def config_sums(df: DataFrame, metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """Per-configuration means plus the sums/counts a weighted group baseline needs."""
    aggs = []
    for m in metrics:
        for d in ("in", "out"):
            c = f"eval_{d}_{m}"
            aggs += [F.avg(c).alias(f"avg_{d}_{m}"), F.sum(c).alias(f"_sum_{d}_{m}"), F.count(c).alias(f"_cnt_{d}_{m}")]
    return df.groupBy(*CONFIG_KEYS).agg(*aggs)


def distinct_keys(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Distinct values of each key in first-appearance order (``position`` = the row's place in the
    log, see ``sinks.with_position``); long form ``(key, value, ordinal)``, one scan."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    out = df.select(position, F.inline(pairs)).groupBy("key", "value").agg(F.min(position).alias("first_seen"))
    # one row per distinct key value: small
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("first_seen", "value"))).drop("first_seen")


def axis_bounds(means: DataFrame, metrics: Sequence[str] = REPORT_METRICS, within: str = "model_name") -> DataFrame:
    """Shared axis range of each chart: min of mins and max of maxes over both axes."""
    stacked = means.select(within, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"avg_in_{m}").alias("x"), F.col(f"avg_out_{m}").alias("y"))
        for m in metrics])).alias("p")).select(within, "p.*")
    return stacked.groupBy(within, "metric").agg(
        F.least(F.min("x"), F.min("y")).alias("axis_min"),
        F.greatest(F.max("x"), F.max("y")).alias("axis_max"))


def legend(means: DataFrame, metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """B11 + H3: display label of each configuration in sorted legend order, and the
    title of each metric chart."""
    labels = means.select("finetuning_method", "sample_size",
                          display_label("finetuning_method", "sample_size").alias("label")).distinct()
    ranked = labels.withColumn("legend_rank", F.dense_rank().over(Window.orderBy("label")))
    titles = F.array(*[F.struct(F.lit(m).alias("metric")) for m in metrics])
    return ranked.select("*", F.explode(titles).alias("_m")) \
                 .select("finetuning_method", "sample_size", "label", "legend_rank",
                         F.col("_m.metric").alias("metric"), metric_title(F.col("_m.metric")).alias("title"))


def report_rows(pivot: DataFrame, values: Sequence[str] = PIVOT_METRICS, digits: int = 2) -> DataFrame:
    """The pivot means as two-decimal text, in key order (decimal rounding half-up)."""
    def fmt(c):
        return F.round(F.col(c).cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string").alias(c)
    keys = ["model_name", "finetuning_method", "sample_size"]
    return pivot.select(*keys, *[fmt(v) for v in values]).orderBy(*keys)
