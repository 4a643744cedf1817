"""Metric, history, combined-log and parameter sinks and sources (A4-A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotgrid.schemas import HISTORY, METHOD_NAMES, PIVOT_METRICS, TRAINED_METHODS, TRAINING_METRICS, metrics_schema
from shotgrid.session import path_exists


def log_name(method: str, kind: str = "metrics", exp_label: str | None = None) -> str:
    """``{method}_{kind}{_label}.csv`` (B12: optional ``'_' + label`` suffix)."""
    suffix = "" if exp_label is None else "_" + exp_label
    return f"{method}_{kind}{suffix}.csv"


def write_logs(df: DataFrame, folder: str, exp_label: str | None = None) -> dict[str, str]:
    """A4 for rows of any methods (column ``finetuning_method``): one log per method, each in
    its method's schema, as one partitioned write per schema.  Returns method -> path."""
    out = {}
    for trained in (True, False):
        methods = [m for m in METHOD_NAMES if (m in TRAINED_METHODS) == trained]
        schema = metrics_schema(methods[0])
        kind = f"{folder}/{'trained' if trained else 'scored'}"
        rows = df.filter(F.col("finetuning_method").isin(*methods))
        log = F.concat("finetuning_method", F.lit(log_name("", "metrics", exp_label)))
        rows.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in schema.fields], log.alias("log")) \
            .write.mode("overwrite").partitionBy("log").option("header", True).csv(kind)
        out |= {m: f"{kind}/log={log_name(m, 'metrics', exp_label)}" for m in methods}
    return out


def read_logs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """File name -> the log's rows, in its own schema.  A method without rows has no log; a log that is there and
    can't be read is an error."""
    return {path.rpartition("log=")[2]: read_metrics(spark, path, method) for method, path in paths.items() if path_exists(spark, path)}


def read_metrics(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A metrics log read with its explicit schema (no inference)."""
    return spark.read.schema(metrics_schema(method)).option("header", True) \
        .option("enforceSchema", False).csv(path)


def write_histories(df: DataFrame, folder: str, exp_label: str | None = None) -> str:
    """A5 for the histories of several methods (column ``finetuning_method``) in one
    partitioned write: a folder with one log per method."""
    path = f"{folder}/histories"
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY.fields],
              F.concat("finetuning_method", F.lit(log_name("", "training_history", exp_label))).alias("log")) \
      .write.mode("overwrite").partitionBy("log").option("header", True).csv(path)
    return path


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """All history logs of a folder with the file name each row comes from (``log``)."""
    schema = T.StructType([*HISTORY.fields, T.StructField("log", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


COMBINED = T.StructType(TRAINING_METRICS.fields + [T.StructField("finetuning_method", T.StringType())])


def write_combined(df: DataFrame, folder: str, name: str = "combined_metrics", order_by: Sequence[str] = ()) -> str:
    """The combined log (union of all method logs) in the fixed combined column order; a
    column that none of the logs has is null.  ``order_by``: the order of its lines (part file after part file)."""
    path = f"{folder}/{name}.csv"
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in COMBINED.fields]) \
      .write.mode("overwrite").option("header", True).csv(path)
    return path


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMBINED).option("header", True).option("enforceSchema", False).csv(path)


def with_position(log: DataFrame, name: str = "position") -> DataFrame:
    """A log with the place of each line: file, the block of the file, and the line's turn in the block.  A block's
    lines are read in order by one task, so the place doesn't depend on how files are dealt to tasks."""
    return log.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("turn")).alias(name))


REPORT = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("finetuning_method", T.StringType()),
                       T.StructField("sample_size", T.IntegerType()), *[T.StructField(m, T.StringType()) for m in PIVOT_METRICS]])


def write_report(df: DataFrame, folder: str, name: str = "report") -> str:
    """The report's rows in key order as one CSV file (a row per configuration of the experiment)."""
    path = f"{folder}/{name}.csv"
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REPORT.fields]) \
      .coalesce(1).sortWithinPartitions("model_name", "finetuning_method", "sample_size").write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("header", True).option("enforceSchema", False).csv(path)


PARAMS = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("sample_size", T.IntegerType()),
    T.StructField("trial", T.IntegerType()), T.StructField("layer", T.StringType()),
    T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
    T.StructField("value", T.DoubleType()), T.StructField("trainable", T.BooleanType()),
])


def save_params(df: DataFrame, folder: str) -> str:
    """Tuned parameters, one folder per (model, sample_size, trial) label."""
    path = f"{folder}/params"
    df.select(*[F.col(f.name).cast(f.dataType) for f in PARAMS.fields]) \
      .write.mode("overwrite").partitionBy("model", "sample_size", "trial").parquet(path)
    return path


def load_params(spark: SparkSession, path: str, model: str, sample_size: int | None = None,
                trial: int | None = None) -> DataFrame:
    """A10: partition-pruned read of one label's parameters."""
    df = spark.read.schema(PARAMS).parquet(path).filter(F.col("model") == model)
    if sample_size is not None:
        df = df.filter(F.col("sample_size") == sample_size)
    if trial is not None:
        df = df.filter(F.col("trial") == trial)
    return df
