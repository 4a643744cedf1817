"""Operator 6: n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles (64-bit hashes); two documents link where
100 * intersection >= 75 * union.  Documents with equal sets are one class, and the join works on
classes:

1. One scan writes (doc_id, class, set size), and the shingles that are frequent in most pieces of
   the input.  These few hot shingles are last in the global order and are not dealt out: a second
   scan gives each class the hot ones that it has, so no task gets a run of a third of all classes.
2. A further scan deals the shingles, packed and sorted, to buckets of the hash space (their
   number grows with the shingles, so a bucket has a bounded size).  A bucket counts how many
   classes have each shingle and passes on the shingles of two or more: no others can match.
3. Global order: rarest shingle first, ties by hash, hot shingles last.  A set of n shingles keeps its first
   n - ceil(0.75 n) + l shingles, its l-prefix; two linked sets share at least min(l, l')
   shingles of their prefixes.  l in 1, 2, 4, 8 is chosen per document by estimated cost: the
   entries that its prefix meets in the index, plus VERIFY times the candidates these can make at
   l matches each.  A document whose prefix meets nobody is done here (nearly all are).
4. Documents that share a prefix shingle are put into clusters: each shingle names its smallest
   class, and connected components of these stars are the clusters, so that a shingle of g
   documents gives g rows and not g * g.  Clusters are joined in tasks of about BLOCK documents;
   a larger one is cut into blocks and every pair of blocks is a task, so that no task holds more
   than 2 * BLOCK documents, however large a group of near copies is.
5. A task counts shared prefix shingles, verifies exactly the pairs that share enough and aren't
   linked yet, and returns a spanning forest of the links, not the pairs.
6. Connected components of the forests; a component's id is its smallest doc_id.

Nothing is capped: blocks and buckets only cut the work.

Defined cases: a text with 1 to 4 words has one shingle, all its words; null, empty and blank
texts have size 0 and are linked with nothing; rows that repeat a document are in its class; a
null doc_id is kept, and a component of null ids only has a null id; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from shotgrid.llm import text as T
from shotgrid.llm.common import documents, freeing, freeing_group, over_batches, pack, stored, unpack, without_ids
from shotgrid.llm.graph import components

SHINGLE, PERCENT = 5, 75
MATCHES = (1, 2, 4, 8)
VERIFY = 50
CHUNK_SHINGLES, CHUNK_SETS = 2_000_000, 60_000
BUCKET_SHINGLES = 2_500_000
BLOCK = 2048
#: A shingle is hot where at least HOT_SHARE of the sets of a piece of the input (of 1 MB; HOT_LEAST
#: sets at least) have it, in HOT_PIECES of the pieces: at most 1 / (HOT_LEAST * HOT_PIECES) of a
#: piece's shingles, about 250,000, whatever the input.
HOT_SHARE, HOT_LEAST, HOT_PIECES = 0.02, 8, 0.1


def least_overlap(n):
    """ceil(0.75 n): what a linked set shares with any partner at least."""
    return (PERCENT * n + 99) // 100


def shingle_sets(texts: pa.Array):
    """(lo, hi, sorted distinct shingles per text, class of each set) of a batch."""
    for lo, hi, hashes, counts in T.tokenize(texts):
        grams, doc = T.windows(hashes, counts, SHINGLE)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        sums = np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
        yield lo, hi, sets, T.mix(sums)


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, class, n (set size); the first row of each piece of the input also has the shingles
    that are frequent in it (``frequent``)."""
    def run(batch: pa.RecordBatch):
        for lo, hi, sets, cls in shingle_sets(batch.column("text")):
            _, first = np.unique(cls, return_index=True)
            found, count = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
            often = found[count >= max(HOT_LEAST, HOT_SHARE * len(first))]
            yield {"doc_id": batch.column("doc_id")[lo:hi], "class": cls.astype(np.int64), "n": [len(s) for s in sets],
                   "frequent": [often.astype(np.int64)] + [None] * (hi - lo - 1)}

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                        "doc_id long, class long, n long, frequent array<long>")


def hot_list(sets: DataFrame) -> np.ndarray:
    """The hot shingles, rising (a bounded number)."""
    pieces = sets.where(F.col("frequent").isNotNull())
    least = max(2, math.ceil(HOT_PIECES * pieces.count()))
    rows = pieces.select(F.explode("frequent").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    return np.sort(np.array([r.s for r in rows.select("s").collect()], np.int64).astype(np.uint64))


def _is_hot(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(shingles), bool)
    return hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles


def hot_shingles(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """class, n, hot (the hot shingles that it has) of the classes with any."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batch: pa.RecordBatch):
        for _, _, sets, cls in shingle_sets(batch.column("text")):
            _, first = np.unique(cls, return_index=True)
            rows = [(int(cls[i].astype(np.int64)), len(sets[i]), sets[i][m].astype(np.int64)) for i in first
                    if (m := _is_hot(sets[i], shared.value)).any()]
            yield {"class": [r[0] for r in rows], "n": [r[1] for r in rows], "hot": [r[2] for r in rows]}

    rows = over_batches(docs.select("text"), run, "class long, n int, hot array<long>")
    return rows.groupBy("class").agg(F.first("n").alias("n"), F.first("hot").alias("hot"))


# ------------------------------------------------------- shingles that two classes or more have
_BLOB = pa.schema([("bucket", pa.int32()), ("shingles", pa.binary()), ("refs", pa.binary()), ("classes", pa.binary()),
                   ("sizes", pa.binary())])
_SHARED = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("df", pa.int32()), ("shingle", pa.int64())])


def _blobs(sets: dict[int, tuple[np.ndarray, int]], buckets: int) -> pa.RecordBatch:
    classes = np.array(list(sets), np.uint64)
    sizes = np.array([n for _, n in sets.values()], np.uint32)
    shingles = np.concatenate([s for s, _ in sets.values()])
    refs = np.repeat(np.arange(len(sizes), dtype=np.uint16), [len(s) for s, _ in sets.values()])
    sets.clear()
    order = np.argsort(shingles)
    shingles, refs = shingles[order], refs[order]
    del order
    first = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    at = np.append(np.searchsorted(shingles, first), len(shingles))
    rows = []
    for k in range(buckets):
        a, b = at[k], at[k + 1]
        if a < b:
            here, ref = np.unique(refs[a:b], return_inverse=True)
            rows.append((k, pack(shingles[a:b]), pack(ref.astype(np.uint16)), pack(classes[here]), pack(sizes[here])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOB, strict=True)], schema=_BLOB)


def shared_shingles(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(class, n, df, shingle) for the shingles, but the hot ones, that at least two classes have."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        sets, total = {}, 0
        for batch in batches:
            for _, _, found, cls in shingle_sets(batch.column("text")):
                for c, s in zip(cls.tolist(), found, strict=True):
                    if c not in sets:
                        cold = s[~_is_hot(s, shared.value)]
                        if len(cold):
                            sets[c] = (cold, len(s))
                            total += len(cold)
                    if total >= CHUNK_SHINGLES or len(sets) >= CHUNK_SETS:
                        yield _blobs(sets, buckets)
                        sets, total = {}, 0
        if sets:
            yield _blobs(sets, buckets)

    def count(table: pa.Table) -> pa.Table:
        shingle, ref, classes, sizes, known = [], [], [], [], 0
        for i in range(table.num_rows):                            # blob by blob; a ref is a place among all blobs' classes
            r = {c: table[c][i].as_py() for c in ("shingles", "refs", "classes", "sizes")}
            shingle.append(unpack(r["shingles"], np.uint64))
            ref.append(unpack(r["refs"], np.uint16).astype(np.uint32) + np.uint32(known))
            classes.append(unpack(r["classes"], np.uint64))
            sizes.append(unpack(r["sizes"], np.uint32))
            known += len(classes[-1])
        shingle, ref = np.concatenate(shingle), np.concatenate(ref)
        classes, sizes = np.concatenate(classes), np.concatenate(sizes)
        order = np.argsort(shingle)
        shingle = shingle[order]
        often = np.zeros(len(shingle), bool)                       # single shingles go first: they are most
        equal = shingle[1:] == shingle[:-1]
        often[1:] |= equal
        often[:-1] |= equal
        shingle, ref = shingle[often], ref[order[often]]
        cls, n = classes[ref], sizes[ref]
        order = np.lexsort((cls, shingle))
        shingle, cls, n = shingle[order], cls[order], n[order]
        first = np.ones(len(shingle), bool)                        # a class may come from several tasks
        first[1:] = (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])
        shingle, cls, n = shingle[first], cls[first], n[first]
        _, inverse, df = np.unique(shingle, return_inverse=True, return_counts=True)
        df = df[inverse] if len(shingle) else np.zeros(0, np.int64)
        keep = df > 1
        return pa.Table.from_arrays([pa.array(cls[keep].astype(np.int64)), pa.array(n[keep].astype(np.int32)),
                                     pa.array(df[keep].astype(np.int32)), pa.array(shingle[keep].astype(np.int64))], schema=_SHARED)

    packed = docs.select("text").mapInArrow(freeing(deal), "bucket int, shingles binary, refs binary, classes binary, sizes binary")
    return packed.groupBy("bucket").applyInArrow(freeing_group(count), "class long, n int, df int, shingle long")


# ------------------------------------------------------------------------- adaptive prefixes
def prefixes(shared: DataFrame, hot: DataFrame | None = None, hot_df: int = 1) -> DataFrame:
    """class, n, matches (l), reach (prefix shingles that others have) and all shared shingles,
    rarest first, of the classes whose prefix meets another class.  ``hot_df`` is the count that hot
    shingles are taken to have in the cost."""
    one = shared.groupBy("class").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    if hot is not None:
        last = F.transform(F.sort_array("hot"), lambda s: F.struct(F.lit(hot_df).alias("df"), s.alias("shingle")))
        more = hot.select(F.col("class").alias("h_class"), F.col("n").alias("h_n"), last.alias("y"))
        none = F.array().cast(one.schema["x"].dataType)
        one = one.join(more, F.col("class") == F.col("h_class"), "full_outer").select(
            F.coalesce("class", "h_class").alias("class"), F.coalesce("n", "h_n").alias("n"),
            F.concat(F.coalesce("x", none), F.coalesce("y", none)).alias("x"))
    need = F.floor((PERCENT * F.col("n") + 99) / 100).cast("int")
    one = one.withColumn("need", need).withColumn("reach1", F.size("x") - F.col("need") + 1).where(F.col("reach1") > 0)

    def reach(m: int) -> Column:
        return F.least(F.col("reach1") + (m - 1), F.size("x"))

    def cost(m: int) -> Column:
        met = F.aggregate(F.slice("x", 1, reach(m)), F.lit(0.0), lambda acc, t: acc + t["df"] - 1)
        return F.when((F.lit(m) == 1) | (F.col("need") >= m), met * (1 + VERIFY / m))

    best = F.array_min(F.array(*[F.struct(cost(m).alias("cost"), F.lit(m).alias("m"), reach(m).alias("reach"))
                                 for m in MATCHES if m == 1] +
                               [F.when(F.col("need") >= m, F.struct(cost(m).alias("cost"), F.lit(m).alias("m"), reach(m).alias("reach")))
                                for m in MATCHES if m > 1]))
    return one.withColumn("best", best).select("class", "n", F.col("best.m").alias("matches"), F.col("best.reach").alias("reach"),
                                               F.transform("x", lambda t: t["shingle"]).alias("shingles"))


def _join_block(table: pa.Table) -> pa.Table:
    """Spanning forest of the links among the sets of one task.  ``side`` is 0 for all sets of a
    block by itself; between two blocks only sets of side 0 and 1 are compared."""
    cls, n = table["class"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    matches, reach, side = (table[c].to_numpy().astype(np.int64) for c in ("matches", "reach", "side"))
    lists = [x.values.to_numpy() for x in table["shingles"].combine_chunks()] if len(table) else []
    sizes = np.array([len(x) for x in lists], np.int64)
    vocab, ids = np.unique(np.concatenate(lists), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(lists)), sizes)
    in_prefix = (np.arange(len(ids)) - begins[owner]) < reach[owner]
    post_id, post_doc = ids[in_prefix], owner[in_prefix]
    order = np.argsort(post_id, kind="stable")
    post_doc = post_doc[order]
    post_at = np.searchsorted(post_id[order], np.arange(len(vocab) + 1))
    label, mark, out = np.arange(len(lists)), np.zeros(len(vocab), bool), []
    two_sided = side.max(initial=0) > 0
    for x in range(len(lists)):
        if two_sided and side[x]:
            continue
        own = ids[begins[x]:ends[x]]
        pre = own[:reach[x]]
        met = np.concatenate([post_doc[post_at[t]:post_at[t + 1]] for t in pre])
        shared = np.bincount(met, minlength=len(lists))
        ok = (shared >= np.minimum(matches, matches[x])) & (label != label[x])
        ok &= (100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x]))
        ok &= (side == 1) if two_sided else (np.arange(len(lists)) < x)
        ys = np.flatnonzero(ok)
        if not len(ys):
            continue
        mark[own] = True
        spans = np.concatenate([ids[begins[y]:ends[y]] for y in ys])
        both = np.add.reduceat(mark[spans].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[ys])[:-1]]))
        mark[own] = False
        for y in ys[100 * both >= PERCENT * (n[ys] + n[x] - both)]:
            if label[y] != label[x]:
                out.append((cls[x], cls[y]))
                label[label == label[y]] = label[x]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between classes."""
    post = candidates.select("class", F.explode(F.slice("shingles", 1, F.col("reach"))).alias("shingle"))
    star = post.groupBy("shingle").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("g")).where(F.col("g") > 1)
    edges = post.join(star, "shingle").where(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct()
    cluster = stored(components(edges), "clusters")
    # clusters above one block: at most the number of classes over BLOCK
    large = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > block)
    bins = max(1, math.ceil(cluster.count() / block))
    rows = candidates.join(cluster, F.col("class") == F.col("node")).join(F.broadcast(large), "root", "left")
    parts = F.coalesce(F.ceil(F.col("g") / block).cast("int"), F.lit(1))
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    # small clusters share tasks (they have no prefix shingle in common); a large one gives a task per pair of parts
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "class", "n", "matches", "reach", "shingles",
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("task"),
        F.when(F.col("parts") == 1, -1).otherwise(F.least("part", "other")).alias("i"),
        F.when(F.col("parts") == 1, -1).otherwise(F.greatest("part", "other")).alias("j"),
        F.when((F.col("parts") > 1) & (F.col("part") > F.col("other")), 1).otherwise(0).alias("side"))
    return rows.groupBy("task", "i", "j").applyInArrow(freeing_group(_join_block), "a long, b long")


def class_components(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, class, n of every row; least: class, root (component), least (smallest doc_id of the class))."""
    sets = stored(set_sizes(docs), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_list(sets)
    shared = shared_shingles(docs, max(parts, math.ceil(total / BUCKET_SHINGLES)), hot)
    with_hot = hot_shingles(docs, hot) if len(hot) else None
    candidates = stored(prefixes(shared, with_hot, max(2, int(HOT_SHARE * sets.count()))), "prefixes")
    found = stored(components(links(candidates, block)), "components")
    least = sets.where(F.col("n") > 0).groupBy("class").agg(F.min("doc_id").alias("least"))
    least = stored(least.join(found, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")), "least")
    return sets.drop("frequent"), least.select("class", "root", "least")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    sets, least = class_components(docs, block)
    # written before it is joined: a component with most classes is then a skewed join that can be split
    ids = stored(least.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    ids = least.join(ids, "root").select(F.col("class").alias("c"), "component_id")
    out = sets.join(ids, (F.col("class") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id"))
                      .otherwise(F.col("doc_id")).alias("component_id"))


def with_class(docs: DataFrame) -> DataFrame:
    """``docs`` with the class (``_class``) and set size (``_n``) of each row."""
    schema = T_.StructType([*docs.schema.fields, T_.StructField("_class", T_.LongType()), T_.StructField("_n", T_.LongType())])

    def run(batches):
        for batch in batches:
            cls, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, sets, found in shingle_sets(batch.column("text")):
                cls[lo:hi], n[lo:hi] = found.astype(np.int64), [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls), pa.array(n)], names=[*batch.schema.names, "_class", "_n"])

    return docs.mapInArrow(freeing(run), schema)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id and, where rows of different texts share this
    id, of the smallest class.  Of rows that repeat id and class the one with the smallest hash of all columns stays.
    Rows without words, and rows with null ids (they can't be named), stay."""
    sets, least = class_components(docs)
    first = stored(least.where(F.col("least").isNotNull()).groupBy("root").agg(F.min(F.struct("least", "class")).alias("first")), "first")
    chosen = least.join(first, "root").where((F.col("first.least") == F.col("least")) & (F.col("first.class") == F.col("class")))
    chosen = chosen.select(F.col("least").alias("k_id"), F.col("class").alias("k_class"))
    rows = sets.where(F.col("doc_id").isNotNull()).select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    rows = rows.join(chosen, (F.col("doc_id") == F.col("k_id")) & (F.col("class") == F.col("k_class")), "left")
    kept = F.col("class").isNull() | F.col("k_class").isNotNull()
    each = rows.groupBy("doc_id").agg(F.max(kept).alias("some"), F.min(kept).alias("all"), F.count("class").alias("sets"))
    each = stored(each, "decisions")
    out = without_ids(docs, each.where(~F.col("some")))
    # ids of several rows that don't all stay are decided row by row
    mixed = stored(each.where(F.col("some") & (~F.col("all") | (F.col("sets") > 1))).select(F.col("doc_id").alias("_mixed")), "mixed")
    if mixed.isEmpty():
        return out
    some = with_class(docs.join(mixed, docs["doc_id"] == F.col("_mixed"), "left_semi"))
    here = some.join(chosen, (F.col("doc_id") == F.col("k_id")) & (F.col("_class") == F.col("k_class")) & (F.col("_n") > 0), "left")
    words = here.where((F.col("_n") > 0) & F.col("k_class").isNotNull()).groupBy("doc_id", "_class").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return without_ids(out, mixed).unionByName(words).unionByName(here.where(F.col("_n") == 0).select(*docs.columns))


def op6_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op6_adaptive_prefix_join": op6_adaptive_prefix_join}
