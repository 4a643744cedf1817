"""Operator 3: shards of near-equal bytes by longest-processing-time scheduling.

Documents with equal text form a group and stay together.  Groups go, largest first, to the
least-loaded shard through a heap.  The heap never sees single groups: they are counted by
size class (exact up to ``2**PRECISION`` bytes, beyond it the size with its top ``PRECISION``
bits, i.e. within 0.03 %), and a class of m groups of one size is dealt out in bulk.  There
are at most ``2**PRECISION * (64 - PRECISION)`` classes whatever the input, so the schedule
that the driver computes has a fixed bound; groups find their shard by their rank inside
their class, which is a distributed dense index.

Defined cases: a null text has no bytes and equals only other null texts; an empty text is an
ordinary text; rows repeated in full are rows of one group; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm.common import documents, stored
from shotgrid.operators.sampling import dense_index

SHARDS = 24
ROW_OVERHEAD = 8
PRECISION = 12


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """``classes``: (class, groups, bytes of all its groups).  Returns for each class the
    cumulative number of groups that go to shards 0, 1, ..: rank r goes to the first shard
    whose bound exceeds r."""
    heap = [(0.0, k) for k in range(shards)]
    out = []
    for cls, m, total in sorted(classes, reverse=True):
        size, left, given = total / m, m, [0] * shards
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] <= size:
                each = left // shards
                heap = [(load + each * size, k) for load, k in heap]     # keeps the heap order
                given = [g + each for g in given]
                left -= each * shards
                continue
            load, k = heap[0]
            rest = min(heap[1:3])[0] if shards > 1 else float("inf")
            n = left if shards == 1 else min(left, int((rest - load) / size) + 1)
            heapq.heapreplace(heap, (load + n * size, k))
            given[k] += n
            left -= n
        out.append((cls, np.cumsum(given).tolist()))
    return out


def lpt_shards(docs: DataFrame, shards: int = SHARDS, precision: int = PRECISION) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stored(docs.select(
        "doc_id",
        (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("grp")), "shard_rows")

    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    drop = F.greatest(F.length(F.bin("bytes")) - precision, F.lit(0))
    groups = groups.withColumn("drop", drop) \
                   .withColumn("cls", F.expr("shiftleft(shiftright(bytes, drop), drop)"))
    groups = dense_index(groups.select("grp", "bytes", "cls"), ["grp"], ["cls"], "rank", partitions=parts)
    hist = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("total"))
    plan = schedule([tuple(r) for r in hist.collect()], shards)      # bounded number of classes
    plan = spark.createDataFrame(plan, "cls long, bounds array<long>")
    placed = groups.join(plan, "cls").select(
        "grp", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))).alias("shard"))
    out = rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard")
    out = dense_index(out, ["doc_id", "text_crc32", "size"], ["shard"], "slot", partitions=parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(documents(spark, sf_dir))


QUERIES = {"op3_lpt_shards": op3_lpt_shards}
