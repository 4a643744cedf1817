"""Sampling, selection and batching.

Every draw is a stateless keyed hash (``functions.sample_key``), so a sample depends only
on (seed, keys, id): the same in any partitioning, on recomputation after an executor is
lost, and in the DuckDB oracle.  Positions are an explicit dense index built without a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotgrid.functions.math import hash_index, sample_key
from shotgrid.session import cut_lineage


# ------------------------------------------------------------------------ dense index
def dense_index(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
                index_col: str = "idx", partitions: int | None = None,
                count_col: str | None = None) -> DataFrame:
    """0-based position of each row in ``order_by`` order (within ``group_by``), as an
    explicit column, the distributed equivalent of positional row identity.

    Range-partitions by (group, order), sorts within partitions, checkpoints (so the
    partition layout is fixed even if a task reruns), then adds per-partition offsets
    from a table with one row per (partition, group) -- never a single-partition window
    over the data.
    """
    keys = list(group_by) + list(order_by)
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    ordered = cut_lineage(ordered)
    ordered = ordered.withColumn("_pid", F.spark_partition_id()) \
                     .withColumn("_mono", F.monotonically_increasing_id())
    # first monotonic id of each (partition, group) + its row count
    counts = ordered.groupBy("_pid", *group_by).agg(F.count(F.lit(1)).alias("_n"),
                                                    F.min("_mono").alias("_first"))
    w = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_by else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    extra = []
    if count_col:   # rows of the whole group, from the same small table
        wg = Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(0))
        offsets = offsets.withColumn(count_col, F.sum("_n").over(wg))
        extra = [count_col]
    # offsets has one row per (partition, group) that has rows.  Without groups that is
    # one row per partition: broadcast.  With groups it can grow with the number of
    # groups, so the join is left to AQE, which broadcasts it only after measuring it.
    offsets = offsets.select("_pid", *group_by, "_off", "_first", *extra)
    on = F.col("o._pid") == F.col("f._pid")
    for g in group_by:                                  # a null group is a group
        on = on & F.col(f"o.{g}").eqNullSafe(F.col(f"f.{g}"))
    side = offsets.alias("f")
    out = ordered.alias("o").join(side if group_by else F.broadcast(side), on) \
                 .select("o.*", *[f"f.{c}" for c in ("_off", "_first", *extra)])
    return out.withColumn(index_col, (F.col("_off") + F.col("_mono") - F.col("_first")).cast("long")) \
              .drop("_pid", "_mono", "_off", "_first")


def select_by_index(df: DataFrame, positions: DataFrame, order_by: str = "id",
                    position_col: str = "position") -> DataFrame:
    """Rows at the given positions (repeats allowed, like ``dataset.select(indices)``)."""
    indexed = dense_index(df, [order_by])
    return positions.join(indexed, positions[position_col] == indexed["idx"]).drop("idx")


# ----------------------------------------------------------------------- sample n rows
def _count_guard(n_rows: int, n: int, what: str) -> None:
    if n > n_rows:
        raise ValueError(f"cannot take a sample of {n} from {n_rows} rows ({what}) without replacement")


def sample_n(df: DataFrame, n: int, seed: int, *key_parts, id_col: str = "id") -> DataFrame:
    """Uniform sample of exactly ``n`` rows without replacement (C2, C4): the rows with the
    ``n`` smallest keys.  More rows than the input has is an error.

    Rows are first kept only below a key expected to pass about 4n of them (widened until at
    least n pass, so the result is exact); the bounded top-n runs on those, so that the rows
    that move don't grow with the number of partitions."""
    keyed = df.withColumn("_h", sample_key(seed, *[F.lit(p) for p in key_parts], F.col(id_col)))
    n_rows = df.count()
    _count_guard(n_rows, n, "sample_n")
    share = min(1.0, 4.0 * n / max(n_rows, 1) + 1e-9)
    while share < 1.0:
        kept = keyed.filter(F.col("_h") < F.lit(_threshold_hex(share)))
        if kept.count() >= n:
            keyed = kept
            break
        share *= 4.0
    return keyed.orderBy("_h", id_col).limit(n).drop("_h")


# ---------------------------------------------------------------------------- trials
def _threshold_hex(p: float) -> str:
    """Smallest 15-hex-digit string with share ``p`` of md5 keys below it ('g' = all)."""
    if p >= 1.0:
        return "g"
    return format(min(int(p * 16 ** 15) + 1, 16 ** 15 - 1), "015x")


def trial_grid(df: DataFrame, sizes: Sequence[int], num_trials: int, seed: int,
               id_col: str = "id", oversample: float = 4.0) -> DataFrame:
    """For each size, ``num_trials`` independent samples without replacement.

    Returns ``(sample_size, trial, rn, id)``, ``rn`` = 1..size in draw order.

    The key of (size, trial, id) is uniform, so each trial's sample is the ``size``
    rows with the smallest keys.  Each row checks all grid cells at once in an array
    and keeps only cells where its key is below a per-size threshold (about
    ``oversample * size`` expected survivors): nothing is joined or materialised per
    cell.  A cell with fewer than ``size`` survivors is recomputed with a 4x larger
    threshold, so the result is exactly the full top-``size`` per cell.
    """
    sizes = sorted(set(int(s) for s in sizes))
    ids = df.select(F.col(id_col).alias("id"))
    n_rows = ids.count()
    _count_guard(n_rows, max(sizes), "trial_grid")
    cells = [(s, t) for s in sizes for t in range(num_trials)]
    share = {s: min(1.0, oversample * s / max(n_rows, 1) + 1e-9) for s in sizes}

    def survivors(todo: list[tuple[int, int]], boost: float) -> DataFrame:
        grid = F.array(*[F.struct(F.lit(s).alias("sample_size"), F.lit(t).alias("trial"),
                                  F.lit(_threshold_hex(min(1.0, share[s] * boost))).alias("thr"))
                         for s, t in todo])
        keyed = F.transform(grid, lambda g: F.struct(
            g["sample_size"].alias("sample_size"), g["trial"].alias("trial"),
            sample_key(seed, g["sample_size"], g["trial"], F.col("id")).alias("h"), g["thr"].alias("thr")))
        kept = F.filter(keyed, lambda c: c["h"] < c["thr"])
        return ids.select("id", F.explode(kept).alias("c")) \
                  .select(F.col("c.sample_size").alias("sample_size"), F.col("c.trial").alias("trial"),
                          F.col("c.h").alias("h"), "id")

    parts: list[DataFrame] = []
    todo, boost = cells, 1.0
    while todo:
        cand = cut_lineage(survivors(todo, boost))        # counted now and ranked below
        if boost * min(share[s] for s, _ in todo) >= 1.0:
            parts.append(cand)
            break
        got = {(r["sample_size"], r["trial"]): r["n"]
               for r in cand.groupBy("sample_size", "trial").agg(F.count(F.lit(1)).alias("n")).collect()}
        ok = [c for c in todo if got.get(c, 0) >= c[0]]
        todo = [c for c in todo if got.get(c, 0) < c[0]]
        if not todo:
            parts.append(cand)
        elif ok:
            okdf = df.sparkSession.createDataFrame(ok, "sample_size int, trial int")
            parts.append(cand.join(F.broadcast(okdf), ["sample_size", "trial"]))
        boost *= 4.0
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("sample_size", "trial").orderBy("h", "id")
    return cand.withColumn("rn", F.row_number().over(w)) \
               .filter((F.col("rn") <= F.col("sample_size")) & (F.col("rn") <= F.lit(max(sizes)))) \
               .select("sample_size", "trial", "rn", "id")


def attach_rows(sample: DataFrame, rows: DataFrame) -> DataFrame:
    """Late join of sampled ids to their full rows (J6).  The sample is small beside the
    rows; AQE broadcasts it after measuring it."""
    return sample.join(rows, "id")


def per_label(df: DataFrame, quantity: int, seed: int, *key_parts, label_col: str = "label",
              id_col: str = "id", labels: Sequence = ()) -> DataFrame:
    """``quantity`` random rows of every label in one pass (C5); quantity < 1 -> empty.  A label
    with fewer rows is an error, as is one of ``labels`` without rows.

    The literal bound lets Spark insert WindowGroupLimit before the shuffle, so a label
    holding most rows still ships only ``quantity`` rows per input partition.
    """
    if quantity < 1:
        return df.limit(0).withColumn("rn", F.lit(0))
    key = sample_key(seed, *[F.lit(p) for p in key_parts], F.col(label_col), F.col(id_col))
    sizes = {r[0]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") < quantity).collect()} if not labels else \
            {lab: df.filter(F.col(label_col) == F.lit(lab)).limit(int(quantity)).count() for lab in labels}
    for lab, n in sizes.items():
        _count_guard(n, quantity, f"label {lab}")
    w = Window.partitionBy(label_col).orderBy("_h", id_col)
    return df.withColumn("_h", key).withColumn("rn", F.row_number().over(w)) \
             .filter(F.col("rn") <= F.lit(int(quantity))).drop("_h")


def validation_subset(eval_df: DataFrame, seed: int, *key_parts, id_col: str = "id",
                      small: int = 50, take: int = 10) -> DataFrame:
    """Shuffle an evaluation sample; keep ``take`` rows if it has >= ``small`` rows, else all
    (C7, H4).  The input is an evaluation sample, bounded by its size parameter."""
    n = eval_df.count()
    k = take if n >= small else n
    key = sample_key(seed, *[F.lit(p) for p in key_parts], F.col(id_col))
    return eval_df.withColumn("_h", key).orderBy("_h", id_col).limit(k).drop("_h")


def draw_positions(spark, n_draws: int, seed: int, sizes: dict[str, int]) -> DataFrame:
    """``n_draws`` positions drawn with replacement, the same draw numbers applied to each
    named dataset (paired positions, C8).  Returns ``(draw, dataset, position)``."""
    named = F.array(*[F.struct(F.lit(name).alias("dataset"), F.lit(int(n)).alias("n")) for name, n in sizes.items()])
    draws = spark.range(n_draws).select(F.col("id").alias("draw"), F.explode(named).alias("d"))
    return draws.select("draw", F.col("d.dataset").alias("dataset"),
                        hash_index(seed, F.col("draw"), F.col("d.n")).alias("position"))


def micro_batches(df: DataFrame, batch_size: int, order_by: str = "id") -> DataFrame:
    """Consecutive fixed-size batches in order, the last one short."""
    indexed = dense_index(df, [order_by])
    return indexed.withColumn("batch_id", F.floor(F.col("idx") / F.lit(batch_size)).cast("long")) \
                  .withColumn("pos_in_batch", (F.col("idx") % F.lit(batch_size)).cast("int"))


def head_n(df: DataFrame, n: int, order_by: str = "id") -> DataFrame:
    """First n rows in ``order_by`` order."""
    return df.orderBy(order_by).limit(n)
