"""Registered queries over the metric logs (trial_metrics view): sinks, union, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotgrid.functions.text import method_from_file
from shotgrid.operators import report as R
from shotgrid.schemas import PIVOT_METRICS, REPORT_METRICS, TRAINING_METRICS
from shotgrid.session import fresh_path
from shotgrid.sources import sinks
from shotgrid.sources.views import trial_metrics, with_views


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (aggregates differ in the last bits between engines)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _logs(spark, sf) -> dict[str, DataFrame]:
    """A4 -> A6: one CSV log per method, named like the experiment's final logs, read back."""
    return sinks.read_logs(spark, sinks.write_logs(trial_metrics(spark, sf), fresh_path(spark, "logs"), "final"))


def combined(spark, sf) -> DataFrame:
    """A4 -> A6 -> B10 -> H1 -> A7: write each method's log, read them back with their
    own schemas, tag by file name, union by name, write and re-read the combined log."""
    comb = R.combine_logs(_logs(spark, sf))
    folder = fresh_path(spark, "combined")
    return sinks.read_combined(spark, sinks.write_combined(comb, folder))


def q_metrics_roundtrip(spark, sf):
    """All six logs as they are read back, each tagged with its method."""
    return R.combine_logs(_logs(spark, sf))


def q_combined_metrics(spark, sf):
    return combined(spark, sf)


_EVAL_IN = [f.name for f in TRAINING_METRICS.fields if f.name.startswith("eval_in_")]


def q_rename_domain(spark, sf):
    tm = trial_metrics(spark, sf)
    generic = tm.select("finetuning_method", "model_name", "sample_size", "trial", "train_loss",
                        *[F.col(c).alias(c.replace("eval_in_", "eval_")) for c in _EVAL_IN])
    return R.reformat_eval_metrics(generic, "in")


def q_means_by_size(spark, sf):
    return round_doubles(R.means_by_size(trial_metrics(spark, sf), "accuracy"))


def q_means_by_config(spark, sf):
    return round_doubles(R.means_by_config(trial_metrics(spark, sf)))


def q_pivot_means(spark, sf):
    return round_doubles(R.pivot_means(trial_metrics(spark, sf)))


def q_vs_baseline(spark, sf):
    out = R.with_baseline(R.config_sums(trial_metrics(spark, sf)))
    return round_doubles(out)


def q_distinct_keys(spark, sf):
    """Keys of a written log in the order of its lines, which are those of the trials."""
    path = sinks.write_combined(trial_metrics(spark, sf), fresh_path(spark, "combined"), order_by=("trial", "sample_size"))
    return R.distinct_keys(sinks.with_position(sinks.read_combined(spark, path)), R.CONFIG_KEYS, "position")


def q_axis_bounds(spark, sf):
    return round_doubles(R.axis_bounds(R.means_by_config(trial_metrics(spark, sf))))


def q_report_labels(spark, sf):
    return R.legend(R.means_by_config(trial_metrics(spark, sf)))


def q_report_rows(spark, sf):
    """The pivot of all logs, written as the report and read back."""
    rows = R.report_rows(R.pivot_means(R.combine_logs(_logs(spark, sf))))
    return sinks.read_report(spark, sinks.write_report(rows, fresh_path(spark, "report")))


def q_group_report(spark, sf):
    """G4 with ``group_by`` (B6): the report of one group of models."""
    return round_doubles(R.means_by_config(trial_metrics(spark, sf), group_by="model_name", group="A"))


def q_method_from_file(spark, sf):
    tm = trial_metrics(spark, sf)
    names = tm.select(F.concat(F.col("finetuning_method"), F.lit("_metrics_"), F.col("model_name"),
                               F.lit(".csv")).alias("file_name")).distinct()
    return names.withColumn("method", method_from_file("file_name"))


QUERIES = {
    "metrics_roundtrip": q_metrics_roundtrip,
    "combined_metrics": q_combined_metrics,
    "rename_domain": q_rename_domain,
    "means_by_size": q_means_by_size,
    "means_by_config": q_means_by_config,
    "pivot_means": q_pivot_means,
    "vs_baseline": q_vs_baseline,
    "distinct_keys": q_distinct_keys,
    "axis_bounds": q_axis_bounds,
    "report_labels": q_report_labels,
    "report_rows": q_report_rows,
    "method_from_file": q_method_from_file,
    "group_report": q_group_report,
}

# --------------------------------------------------------------------------- oracle SQL
_V = with_views("trial_metrics")
_CFG = "model_name, sample_size, finetuning_method"


def _avg_cols(metrics=REPORT_METRICS, src="eval_{d}_{m}", dst="avg_{d}_{m}"):
    return ", ".join(f"round(avg({src.format(d=d, m=m)}), 6) AS {dst.format(d=d, m=m)}"
                     for m in metrics for d in ("in", "out"))


_LABEL = """CASE WHEN finetuning_method = 'context_distillation' THEN 'CD (' || CAST(sample_size AS VARCHAR) || ')'
     WHEN finetuning_method = 'recursive_context_distillation' THEN 'CD_recursive (' || CAST(sample_size AS VARCHAR) || ')'
     WHEN finetuning_method = 'zeroshot' THEN ''
     ELSE finetuning_method || ' (' || CAST(sample_size AS VARCHAR) || ')' END"""

_TRAIN_COLS = ", ".join(f.name for f in TRAINING_METRICS.fields if f.name not in ("model_name", "sample_size"))
_MEANS = f"means AS (SELECT {_CFG}, {_avg_cols()}, {_LABEL} AS label FROM trial_metrics_x GROUP BY ALL)"
_PIVOT = ", ".join(f"avg({v}) AS {v}" for v in PIVOT_METRICS)
_SUMS = ", ".join(f"sum({c}) AS s_{c}, count({c}) AS n_{c}" for c in
                  [f"eval_{d}_{m}" for m in REPORT_METRICS for d in ("in", "out")])
_BASE = ", ".join(
    f"round(sum(CASE WHEN finetuning_method = 'zeroshot' THEN s_eval_{d}_{m} END) OVER (PARTITION BY model_name) / "
    f"sum(CASE WHEN finetuning_method = 'zeroshot' THEN n_eval_{d}_{m} END) OVER (PARTITION BY model_name), 6) AS base_{d}_{m}"
    for m in REPORT_METRICS for d in ("in", "out"))
_METHOD = """CASE WHEN contains(f, 'fewshot_lora') THEN 'fewshot_lora'
     WHEN contains(f, 'context_distillation') AND contains(f, 'recursive') THEN 'recursive_context_distillation'
     WHEN contains(f, 'context_distillation') THEN 'context_distillation'
     ELSE split_part(f, '_', 1) END"""
_FMT = ", ".join(f"CAST(CAST(round(CAST({v} AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) AS {v}"
                 for v in PIVOT_METRICS)
_TITLE = """CASE WHEN metric = 'runtime' THEN 'Runtime (s)' WHEN metric = 'peak_memory_gb' THEN 'Peak Memory Usage (GB)'
     ELSE upper(substr(metric, 1, 1)) || lower(substr(metric, 2)) END"""
_METRIC_VALUES = ", ".join(f"('{m}')" for m in REPORT_METRICS)

SQL = {
    "metrics_roundtrip": _V + f"SELECT model_name, CAST(sample_size AS INTEGER) AS sample_size, {_TRAIN_COLS}, "
                              f"finetuning_method FROM trial_metrics_x",
    "combined_metrics": _V + f"SELECT model_name, CAST(sample_size AS INTEGER) AS sample_size, {_TRAIN_COLS}, "
                             f"finetuning_method FROM trial_metrics_x",
    "rename_domain": _V + "SELECT finetuning_method, model_name, sample_size, trial, train_loss, "
                          + ", ".join(_EVAL_IN) + " FROM trial_metrics_x",
    "group_report": _V + f", {_MEANS} SELECT * FROM means WHERE model_name = 'A'",
    "means_by_size": _V + "SELECT sample_size, round(avg(eval_in_accuracy), 6) AS avg_in_accuracy, "
                          "round(avg(eval_out_accuracy), 6) AS avg_out_accuracy, count(*) AS num_trials "
                          "FROM trial_metrics_x GROUP BY sample_size",
    "means_by_config": _V + f", {_MEANS} SELECT * FROM means",
    "pivot_means": _V + f"SELECT model_name, finetuning_method, sample_size, "
                        + ", ".join(f"round(avg({v}), 6) AS {v}" for v in PIVOT_METRICS)
                        + " FROM trial_metrics_x GROUP BY ALL",
    "vs_baseline": _V + f", s AS (SELECT {_CFG}, {_avg_cols()}, {_SUMS} FROM trial_metrics_x GROUP BY ALL) "
                        f"SELECT {_CFG}, " + ", ".join(f"avg_{d}_{m}" for m in REPORT_METRICS for d in ("in", "out"))
                        + f", {_BASE} FROM s",
    "distinct_keys": _V + """, o AS (SELECT *, row_number() OVER (ORDER BY trial, sample_size) AS place FROM trial_metrics_x), k AS (
        SELECT 'model_name' AS key, CAST(model_name AS VARCHAR) AS value, min(place) AS place FROM o GROUP BY 2
        UNION ALL SELECT 'sample_size', CAST(sample_size AS VARCHAR), min(place) FROM o GROUP BY 2
        UNION ALL SELECT 'finetuning_method', finetuning_method, min(place) FROM o GROUP BY 2)
        SELECT key, value, CAST(row_number() OVER (PARTITION BY key ORDER BY place) AS INTEGER) AS ordinal FROM k""",
    "axis_bounds": _V + f", {_MEANS}, p AS (" + " UNION ALL ".join(
        f"SELECT model_name, '{m}' AS metric, avg_in_{m} AS x, avg_out_{m} AS y FROM means" for m in REPORT_METRICS)
        + ") SELECT model_name, metric, round(least(min(x), min(y)), 6) AS axis_min, "
          "round(greatest(max(x), max(y)), 6) AS axis_max FROM p GROUP BY model_name, metric",
    "report_labels": _V + f", {_MEANS}, l AS (SELECT DISTINCT finetuning_method, sample_size, label FROM means), "
        f"r AS (SELECT *, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS legend_rank FROM l) "
        f"SELECT finetuning_method, sample_size, label, legend_rank, metric, {_TITLE} AS title "
        f"FROM r, (VALUES {_METRIC_VALUES}) mt(metric)",
    "report_rows": _V + f", pv AS (SELECT model_name, finetuning_method, CAST(sample_size AS INTEGER) AS sample_size, "
                        f"{_PIVOT} FROM trial_metrics_x GROUP BY ALL) "
                        f"SELECT model_name, finetuning_method, sample_size, {_FMT} FROM pv",
    "method_from_file": _V + f"SELECT f AS file_name, {_METHOD} AS method FROM (SELECT DISTINCT "
                             f"finetuning_method || '_metrics_' || model_name || '.csv' AS f FROM trial_metrics_x)",
}
