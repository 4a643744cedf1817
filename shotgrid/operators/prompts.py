"""Prompt building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.math import hash_index
from shotgrid.functions.text import demo_text, minimal_pattern, teacher_context as teacher_text
from shotgrid.operators.sampling import dense_index
from shotgrid.sources.views import as_pairs


def icl_context(demos: DataFrame, keys: Sequence[str] = ("sample_size", "trial"),
                order_col: str = "rn", description: str | None = None, separator: str = ",") -> DataFrame:
    """One context string per trial from its demonstrations, in sample order.

    A trial group holds at most its shot count of rows, so the ordered collect is bounded
    by the sample-size parameter; structs are sorted by ``rn`` because collect order is
    not defined.
    """
    head = "" if description is None else f"{description}{separator}"
    parts = demos.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                             demo_text(separator=separator).alias("s")))).alias("_d"),
        F.count(F.lit(1)).alias("n_demos"))
    return parts.select(*keys, "n_demos",
                        F.concat(F.lit(head), F.array_join(F.transform("_d", lambda x: x["s"]), ""))
                        .alias("context"))


def icl_prompts(eval_rows: DataFrame, contexts: DataFrame,
                cells: Sequence[tuple[int, int]], keys: Sequence[str] = ("sample_size", "trial")) -> DataFrame:
    """Every evaluation row under every trial's context.

    The trial cells are a bounded parameter list: each evaluation row is expanded to its
    cells in place, then equi-joined to the contexts (one row per cell; AQE measures their texts)."""
    grid = F.array(*[F.struct(F.lit(s).alias(keys[0]), F.lit(t).alias(keys[1])) for s, t in cells])
    expanded = eval_rows.select("*", F.explode(grid).alias("_c")) \
                        .select("*", F.col(f"_c.{keys[0]}").alias(keys[0]), F.col(f"_c.{keys[1]}").alias(keys[1])) \
                        .drop("_c")
    joined = expanded.join(contexts.select(*keys, "context"), list(keys))
    return joined.withColumn("text", minimal_pattern("premise", "hypothesis", F.col("context")))


def teacher_contexts(batches: DataFrame, pool: DataFrame, seed: int, batch_col: str = "batch_id") -> DataFrame:
    """A fresh teacher context per training batch (D3): one random contradiction (label 1)
    and one random entailment (label 0) example of the pool for every batch.

    Each batch draws a position per label from a keyed hash; the pool gets a dense
    per-label index and the draws are an equi-join on (label, position), so the work is
    O(batches + pool) -- no batch x pool product.  ``pool`` is (id, text, label); a pool without
    one of the labels is an error.
    """
    # only (id, label) is indexed and checkpointed; the drawn rows get their text after
    idx = dense_index(pool.select("id", "label"), ["id"], ["label"])
    n_by_label = idx.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # <= 2 rows
    draws = batches.select(batch_col).distinct() \
        .select(batch_col, F.explode(F.array(F.lit(0), F.lit(1))).alias("label")) \
        .join(n_by_label, "label") \
        .withColumn("idx", hash_index(seed, F.concat_ws("|", F.lit("teacher"), F.col(batch_col).cast("string"),
                                                        F.col("label").cast("string")), F.col("n")))
    # the drawn rows are split into pairs after the join
    picked = as_pairs(draws.join(idx, ["label", "idx"]).select(batch_col, "label", "id").join(pool.select("id", "text"), "id"))
    wide = picked.groupBy(batch_col).agg(
        F.max(F.when(F.col("label") == 1, F.col("premise"))).alias("c_premise"),
        F.max(F.when(F.col("label") == 1, F.col("hypothesis"))).alias("c_hypothesis"),
        F.max(F.when(F.col("label") == 0, F.col("premise"))).alias("e_premise"),
        F.max(F.when(F.col("label") == 0, F.col("hypothesis"))).alias("e_hypothesis"))
    text = teacher_text("c_premise", "c_hypothesis", "e_premise", "e_hypothesis")
    missing = F.raise_error(F.lit("a teacher context needs a row of each label"))
    return wide.select(batch_col, F.when(text.isNull(), missing).otherwise(text).alias("teacher_context"))
