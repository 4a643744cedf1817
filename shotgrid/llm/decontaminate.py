"""Operator 10: benchmark decontamination by SimHash windows (DataFrame functions only).

A benchmark item of L words leaks into a document where a window of L words of the document has
a weighted five-word-shingle similarity of 0.75 or more with it (a shingle weighs as often as it
occurs: shared weight over total weight).  The chain:

1. Anchors.  Such a window shares at least one shingle with the item, so only windows that an
   equal shingle aligns with an item are looked at: shingle at word p of the document and at word
   q of the item gives the window that starts at p - q (moved inside the document).  A bit array
   of fixed size over the benchmark's shingles (no false negatives) lets all other words and
   documents go in the scan.
2. A 64-bit SimHash over the words of every such window and of every item.
3. Multi-index search: RADIUS + 1 blocks of bits; two fingerprints within RADIUS agree in at
   least one block, so a join on (L, block, bits) finds every pair within the radius.
4. Pairs beyond the radius.  Similarity 0.75 doesn't bound the distance (edits clumped at an edge
   change one word in 7, a repeated word more bits than that), so a window and an item that it is
   aligned with are also a pair where the window can hold enough of the item's shingles: they are
   counted by stretches of L positions, and a window lies in two of them at most, which loses none.
5. All these pairs are verified by the exact similarity.

Nothing is limited or sampled; a passage that a third of all documents share costs one window each.

Defined cases: texts of fewer than five words are one shingle; null or empty texts, and items
without words, match nothing; case doesn't count; rows of one doc_id are one document (the best
window counts); null ids are kept as null; ties between windows go to the first that an anchor aligns; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm.common import documents, stored, without_ids

SHINGLE = 5
PERCENT = 75
RADIUS = 16
BITS = 64
FILTER_BITS, FILTER_HASHES = 19, 4      # the bit array has 2**19 bits (64 KB), four of them per shingle


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def gram_hash(hashes: Column, i: Column, k: int) -> Column:
    """Hash of the k words from i on."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])


def gram_starts(hashes: Column, k: int) -> Column:
    return F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))


def grams(ws: Column) -> Column:
    """The shingles of a window as text: runs of SHINGLE words, or all words if there are fewer."""
    k = F.least(F.size(ws), F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(ws, i, k), " "))


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it in lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def simhash(ws: Column) -> Column:
    """64-bit SimHash of an array of words."""
    def bits(hashes: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            ones = F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
            return acc.bitwiseOR(F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.expr("1L"), b))
                                 .otherwise(F.expr("0L")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.expr("0L"), add)

    return _let(F.transform(ws, lambda w: F.xxhash64(w)), bits)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """array<struct<block, bits>>: the fingerprint cut into radius + 1 blocks."""
    n, at, out = radius + 1, 0, []
    for i in range(n):
        width = BITS // n + (i < BITS % n)
        cut = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(i).alias("block"), cut.alias("bits")))
        at += width
    return F.array(*out)


def _slots(h: Column) -> list[Column]:
    mask = F.lit((1 << FILTER_BITS) - 1).cast("long")
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(mask) for i in range(FILTER_HASHES)]


def _bitmap(shingles: DataFrame) -> DataFrame:
    """One row: the bit array as 64-bit words.  Its size is fixed."""
    spark = shingles.sparkSession
    set_bits = shingles.select(F.explode(F.array(*_slots(F.col("gram")))).alias("slot"))
    set_bits = set_bits.groupBy((F.shiftright("slot", 6)).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("slot").bitwiseAND(63).cast("int"))).alias("v"))
    every = spark.range(1 << (FILTER_BITS - 6)).withColumnRenamed("id", "i")
    full = every.join(set_bits, "i", "left").select("i", F.coalesce("v", F.expr("0L")).alias("v"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("bits"))


def _anchors(k: int, maybe) -> Column:
    """array<struct<p, gram>>: the runs of k words that may be a shingle of the benchmark."""
    at = F.filter(gram_starts(F.col("hs"), k), lambda i: maybe(gram_hash(F.col("hs"), i, k)))
    return F.transform(at, lambda i: F.struct(i.alias("p"), gram_hash(F.col("hs"), i, k).alias("gram")))


def _gram_hashes(k: int) -> Column:
    return F.transform(gram_starts(F.col("hs"), k), lambda i: gram_hash(F.col("hs"), i, k))


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word), n_words, distance, similarity, windows: one row per
    document and item that leaks into it, with the best window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = stored(items.select("item_id", "ws", F.size("ws").alias("len"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"),
                                simhash(F.col("ws")).alias("print")), "benchmark_items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect()) or [SHINGLE]       # at most SHINGLE values
    hashed = items.select("item_id", "len", "k", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    shingles = None
    for k in sizes:
        one = hashed.where(F.col("k") == k).select("item_id", "len", "k", F.posexplode(_gram_hashes(k)).alias("q", "gram"))
        shingles = one if shingles is None else shingles.unionByName(one)
    shingles = shingles.distinct()

    # 1. documents with an anchor, and the windows that anchors align with items
    def maybe(h: Column) -> Column:
        tests = [F.getbit(F.get(F.col("bitmap"), F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1
                 for s in _slots(h)]
        return functools.reduce(Column.__and__, tests)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    d = d.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w))).withColumn("bitmap", _bitmap(shingles).scalar())
    found = [_anchors(k, maybe) for k in sizes]
    # the row number also keeps the filter above this projection: pushed below, it would put the
    # splitting of a text into the lambda over its words
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ws",
                 (F.concat(*found) if len(found) > 1 else found[0]).alias("hits"))
    d = stored(d.where(F.size("hits") > 0), "anchored")
    hits = d.select("row", F.size("ws").alias("n"), F.inline("hits")).join(shingles, "gram")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("len")))
    hits = stored(hits.select("row", "n", "item_id", "len", "k", "p", start.alias("start")), "aligned")
    windows = hits.select("row", "start", "len").distinct() \
        .groupBy("row").agg(F.collect_list(F.struct("start", "len")).alias("at"))
    windows = d.select("row", "doc_id", "ws").join(windows, "row").select("row", "doc_id", "ws", F.inline("at"))
    windows = windows.select("row", "doc_id", "start", "len", F.slice("ws", F.col("start") + 1, F.col("len")).alias("window"))

    # 2., 3. fingerprints; pairs that agree in a block
    windows = stored(windows.withColumn("print", simhash(F.col("window"))).withColumn("w", F.monotonically_increasing_id()),
                     "windows")
    left = windows.select("w", "len", F.col("print").alias("a"), F.inline(blocks(F.col("print"), radius)))
    right = items.select("item_id", "len", F.col("print").alias("b"), F.inline(blocks(F.col("print"), radius)))
    pairs = left.join(right, ["len", "block", "bits"]) \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("w", "item_id")

    # 4. aligned pairs whose window may hold enough of the item's shingles, whatever their distance
    stretch = F.floor(F.col("p") / F.col("len"))
    counts = hits.select("row", "item_id", "len", "p", stretch.alias("stretch")).distinct() \
        .groupBy("row", "item_id", "len", "stretch").agg(F.count(F.lit(1)).alias("found"))
    size = F.least(F.col("len"), F.col("n") - F.col("start"))
    total = size - F.least(size, F.lit(SHINGLE)) + 1 + F.col("len") - F.col("k") + 1            # shingles of both
    first = F.floor(F.col("start") / F.col("len"))
    enough = hits.select("row", "item_id", "len", "start", total.alias("total"), F.explode(F.array(first, first + 1)).alias("stretch")) \
        .distinct().join(counts, ["row", "item_id", "len", "stretch"]) \
        .groupBy("row", "item_id", "len", "start", "total").agg(F.sum("found").alias("found")) \
        .where((100 + PERCENT) * F.col("found") >= PERCENT * F.col("total"))
    enough = enough.join(windows.select("w", "row", "start", "len"), ["row", "start", "len"]).select("w", "item_id")
    pairs = pairs.unionByName(enough).distinct()

    # 5. exact verification
    pairs = pairs.join(windows.select("w", "doc_id", "start", "window", F.col("print").alias("a")), "w") \
                 .join(items.select("item_id", "ws", F.col("print").alias("b")), "item_id")
    pairs = pairs.select("doc_id", "item_id", "start", F.size("window").alias("n_words"),
                         F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"),
                         grams(F.col("window")).alias("x"), grams(F.col("ws")).alias("y"))
    times = lambda arr, g: F.size(F.filter(arr, lambda z: z == g))
    shared = F.aggregate(F.array_distinct("y"), F.lit(0), lambda acc, g: acc + F.least(times(F.col("x"), g), times(F.col("y"), g)))
    pairs = pairs.withColumn("shared", shared).withColumn("total", F.size("x") + F.size("y") - F.col("shared"))
    pairs = pairs.where(100 * F.col("shared") >= PERCENT * F.col("total"))
    best = F.max_by(F.struct("start", "n_words", "distance", (F.col("shared") / F.col("total")).alias("similarity")),
                    F.struct(F.col("shared") / F.col("total"), -F.col("start"))).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("windows")).select(
        "doc_id", "item_id", "best.*", "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item leaks into (a null id can't be named and stays)."""
    return without_ids(docs, find_leaks(docs, benchmark).select("doc_id"))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_simhash_decontamination": op10_simhash_decontamination}
