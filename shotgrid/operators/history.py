"""Training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.operators.sampling import dense_index


def split_entries(entries: DataFrame, run_keys=("run",), trim_last: int = 3) -> DataFrame:
    """C12 + B5: drop each run's last ``trim_last`` entries (train summary and the two
    final evaluations), then split by key presence: an entry without ``eval_loss`` is a
    training entry.  Long form ``(run..., kind, pos, loss)``, ``pos`` from 1 per kind.

    Positions come from ``dense_index`` (range-partitioned), so a run that holds most of the
    entries is numbered by many tasks."""
    order = ["ts", "event_id"]
    e = dense_index(entries, order, list(run_keys), index_col="_i", count_col="_n")
    e = e.filter(F.col("_i") < F.col("_n") - F.lit(trim_last))
    e = e.withColumn("kind", F.when(F.col("eval_loss").isNull(), F.lit("train")).otherwise(F.lit("val"))) \
         .withColumn("value", F.coalesce(F.col("eval_loss"), F.col("loss"))) \
         .select(*run_keys, *order, "kind", "value")
    e = dense_index(e, order, [*run_keys, "kind"], index_col="_k")
    return e.select(*run_keys, "kind", (F.col("_k") + 1).cast("int").alias("pos"), F.col("value").alias("loss"))


def zip_long(split: DataFrame, run_keys=("run",)) -> DataFrame:
    """E5 relationally: the i-th training loss next to the i-th validation loss, epoch
    from 1 (W3), stopping at the shorter list: one aggregation by (run, pos) that keeps the
    positions with both."""
    def of(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("loss")))

    def some(kind):
        return F.max((F.col("kind") == kind).cast("int"))

    both = split.groupBy(*run_keys, F.col("pos").alias("epoch")).agg(
        of("train").alias("train_loss"), of("val").alias("val_loss"), some("train").alias("_t"), some("val").alias("_v"))
    return both.filter((F.col("_t") == 1) & (F.col("_v") == 1)).drop("_t", "_v")


def learning_curves(history: DataFrame) -> DataFrame:
    """Mean train and validation loss per epoch within (model, size, method)."""
    return history.groupBy("model_name", "sample_size", "finetuning_method", "epoch") \
                  .agg(F.avg("train_loss").alias("avg_train_loss"), F.avg("val_loss").alias("avg_val_loss"))
