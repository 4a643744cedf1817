"""Dataset sources (A1-A3) and the cleaning filters they apply."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.session import input_state, is_complete, shared_dir
from shotgrid.sources.views import as_pairs, nli_rows, table


def remove_neutral(df: DataFrame, label: str = "label") -> DataFrame:
    """B1 + B2: drop label 1 (neutral), then recode 2 -> 1; the filter reaches the scan."""
    return df.filter(F.col(label) != 1) \
             .withColumn(label, F.when(F.col(label) == 2, F.lit(1)).otherwise(F.col(label)).cast("int"))


def isolate_heuristic(df: DataFrame, heuristic: str = "lexical_overlap") -> DataFrame:
    """Keep one heuristic."""
    return df.filter(F.col("heuristic") == heuristic)


def filter_label(df: DataFrame, label: int) -> DataFrame:
    """Rows of one label."""
    return df.filter(F.col("label") == label)


def key_filter(**equals) -> Column:
    """Conjunction of equality filters; a ``None`` value means no filter."""
    cond = F.lit(True)
    for k, v in equals.items():
        if v is not None:
            cond = cond & (F.col(k) == F.lit(v))
    return cond


def in_domain_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned in-domain (train, validation) as (id, text, label): sample or join first, split
    the texts that remain with ``as_pairs``."""
    p = nli_rows(spark, sf_dir, "in")
    return tuple(remove_neutral(p.filter(F.col("split") == s)).select("id", "text", "label") for s in ("train", "validation"))


def in_domain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A1: cleaned in-domain (train, validation)."""
    cols = ["id", "premise", "hypothesis", "label"]
    train, val = in_domain_rows(spark, sf_dir)
    return as_pairs(train).select(*cols), as_pairs(val).select(*cols)


def out_domain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate_heuristic(nli_rows(spark, sf_dir, "out")).select("id", "text", "label", "heuristic")


def out_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: out-of-domain rows of one heuristic (all splits)."""
    return as_pairs(out_domain_rows(spark, sf_dir)).select("id", "premise", "hypothesis", "label", "heuristic")


def _in_all(spark, sf_dir):
    train, val = in_domain(spark, sf_dir)
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("validation")))


# Bump when a materialised definition changes: copies live in the shared folder across runs.
DEFINITION_VERSION = "2"

DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nli_in": _in_all,
    "nli_out": out_domain,
}


def materialized(spark: SparkSession, kind: str, params: Sequence, source: DataFrame,
                 build: Callable[[], DataFrame]) -> DataFrame:
    """A3 / A10: a derived table written once under the shared folder and read back
    afterwards.  Its place is keyed by the parameters and by the files of ``source`` with their
    sizes and modification times, so a changed input is built anew; a folder without its
    ``_SUCCESS`` mark (a writer that failed) is built again."""
    key = "\n".join([DEFINITION_VERSION, *map(str, params), *input_state(source)])
    path = f"{shared_dir(spark)}/{kind}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_dataset(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A3: a named dataset, materialised if absent; unknown names raise."""
    if name not in DATASETS:
        raise ValueError(f"Dataset {name} not supported.")
    return materialized(spark, "datasets", [name], table(spark, sf_dir, "documents"), lambda: DATASETS[name](spark, sf_dir))
