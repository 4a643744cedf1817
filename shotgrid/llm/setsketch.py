"""Operator 11: near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles (64-bit hashes); two documents link where
100 * intersection >= 85 * union.  Documents with equal sets are one class; the join works on classes.

1. One scan sketches every set: register i is ``1 - floor(log_b h_i)``, cut to 0 .. LIMIT + 1, where
   h_i is the smallest of exponentially distributed hashes of the set's members (rate RATE).
   Registers of a union are the larger ones of both, so sketches merge; the share of equal registers
   of two sets grows with their similarity.
2. Registers are banded, BANDS of WIDTH each.  Classes that agree in a band are a bucket: two sets at
   the threshold miss each other in all bands with probability (1 - 0.85^5)^32 = 7e-9.  A task first
   puts its own classes of a bucket under its smallest one, so what moves for a bucket that holds a
   third of all classes is a row per task and not a row per class.
3. Each class is held against one partner, the bucket head that it meets in most bands: their similarity
   is estimated from the registers by maximum likelihood, pairs whose likelihood at the threshold is below
   exp(-SURE) of the greatest are left out, and the others are verified on full sets, a head's classes
   in parts of bounded size.  A group of g near copies costs g comparisons here and not g * g.
4. Components of these links.  A bucket whose classes are in one component is done: no further
   link could change a component.  Of the other buckets (equal ones once) all pairs of classes of
   different components are estimated from the registers, in blocks; where any pair passes, its
   classes come with their full sets and the pairs that pass are verified, again in blocks.
   So no link between two components is lost, and no task holds more than two blocks.
5. Components of all links; a component's id is its smallest doc_id.

The estimate is joint: the likelihood takes the numbers of smaller, equal and larger registers with
both cardinalities (known, or estimated from the registers by ``cardinality``).

Defined cases: a text with 1 to 4 words has one shingle, all its words; null, empty and blank texts
have size 0 and are linked with nothing; rows that repeat a document are in its class and kept like
it; a null doc_id is kept in the result, a component of null ids only has a null id and its rows are
kept; very long texts are sketched whole, in pieces; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrid.llm import text as T
from shotgrid.llm.common import documents, freeing, freeing_group, over_batches, pack, stored, unpack
from shotgrid.llm.graph import components

SHINGLE, PERCENT = 5, 85
BANDS, WIDTH = 32, 5
REGISTERS = BANDS * WIDTH
BASE, RATE, LIMIT = 1.001, 20.0, 2 ** 16 - 2
SURE = 25.0                     # log of the likelihood ratio at which a pair is left out unverified
TASK_BANDS = 2_000_000          # bucket entries that a task sorts at once
BLOCK = 1024                    # classes of a block
BLOCK_SHINGLES = 2_000_000      # shingles of a block
SPREAD = 1 << 15                # members hashed at once when sets are sketched
_MULTIPLY = np.random.default_rng(11).integers(1, 2 ** 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 2 ** 64 - 1, REGISTERS, dtype=np.uint64)


# ------------------------------------------------------------------------------ the sketch
def registers(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (rows of REGISTERS) of the sets ``members[starts[i]:starts[i + 1]]``; no set is empty."""
    n, out = len(starts) - 1, np.empty((len(starts) - 1, REGISTERS), np.uint16)
    scale = 1.0 / math.log(BASE)
    for i in range(REGISTERS):
        h = members * _MULTIPLY[i]                       # members are random 64-bit numbers: a linear permutation will do
        h += _ADD[i]
        least = np.minimum.reduceat(h, starts[:-1]) if n else np.zeros(0, np.uint64)
        # uniform in (0, 1] -> exponential with rate RATE; its order is that of the uniform hash
        x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / RATE
        out[:, i] = np.clip(1 - np.floor(np.log(x) * scale), 0, LIMIT + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    """Estimated set sizes of rows of registers."""
    return len(regs.T) * (1 - 1 / BASE) / (RATE * math.log(BASE) * (BASE ** -regs.astype(np.float64)).sum(axis=-1))


def _less(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j, larger, smaller, equal, u, v):
    """Of similarity ``j`` given how many registers of the first set are larger, smaller and equal; u and v
    are the sets' shares of the sum of both sizes."""
    up, down = _less(np.maximum(u - v * j, 0.0)), _less(np.maximum(v - u * j, 0.0))
    tiny = 1e-300
    return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def estimate(larger, smaller, equal, n, m) -> tuple[np.ndarray, np.ndarray]:
    """(similarity of greatest likelihood, log of its ratio to the likelihood at the threshold) for arrays
    of register counts and set sizes, by golden section (the likelihood has one peak)."""
    u, v = n / (n + m), m / (n + m)
    top = np.minimum(u / v, v / u)
    lo, hi, g = np.zeros_like(top), top.copy(), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(a, larger, smaller, equal, u, v) > log_likelihood(b, larger, smaller, equal, u, v)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    j = (lo + hi) / 2
    least = np.minimum(PERCENT / 100, top)
    return j, log_likelihood(j, larger, smaller, equal, u, v) - log_likelihood(least, larger, smaller, equal, u, v)


def _at_threshold(larger, smaller, equal, n, m):
    """Log likelihood at the threshold (at the largest similarity that the sizes allow, if that is less)."""
    u, v = n / (n + m), m / (n + m)
    return log_likelihood(np.minimum(PERCENT / 100, np.minimum(u / v, v / u)), larger, smaller, equal, u, v)


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs (rows of registers a and b, sizes n and m) can be at the threshold or above: those whose
    likelihood there is at least exp(-SURE) of the greatest.  Most pairs are decided by bounds of the greatest
    likelihood, from above by that of free shares of larger, smaller and equal registers, from below by that of
    the share of equal ones as the similarity; only the others are maximised."""
    n, m = n.astype(np.float64), m.astype(np.float64)
    ok = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    equal = (a == b).sum(axis=-1)
    ok &= 2 * equal >= REGISTERS            # else the ratio is far beyond SURE
    at = np.flatnonzero(ok)
    if not len(at):
        return ok
    a = a[at] if a.ndim == 2 else a
    larger, same = (a > b[at]).sum(axis=-1).astype(np.float64), equal[at].astype(np.float64)
    smaller = REGISTERS - same - larger
    n, m = np.broadcast_to(n, ok.shape)[at], np.broadcast_to(m, ok.shape)[at]
    here = _at_threshold(larger, smaller, same, n, m)
    free = sum(k * np.log(np.maximum(k, 1.0) / REGISTERS) for k in (larger, smaller, same))
    u, v = n / (n + m), m / (n + m)
    guess = np.minimum(same / REGISTERS, np.minimum(u / v, v / u))
    far = (guess < PERCENT / 100) & (log_likelihood(guess, larger, smaller, same, u, v) - here > SURE)
    passed = ~far
    rest = np.flatnonzero(passed & (free - here > SURE))
    if len(rest):
        j, ratio = estimate(larger[rest], smaller[rest], same[rest], n[rest], m[rest])
        passed[rest] = (j >= PERCENT / 100) | (ratio <= SURE)
    ok[at] = passed
    return ok


# ------------------------------------------------------------------------- sets and classes
def shingle_sets(texts: pa.Array) -> Iterator[tuple]:
    """(lo, hi, members of all sets, starts, class of each set) of a batch; a set without members has class 0."""
    for lo, hi, hashes, counts in T.tokenize(texts):
        grams, doc = T.windows(hashes, counts, SHINGLE)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        cls = np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
        yield lo, hi, np.concatenate(sets), starts, np.where(np.diff(starts) > 0, T.mix(cls), np.uint64(0)).astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, class, n (set size), registers (packed; null in an empty set, and where the class came before in the batch)."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, members, starts, cls in shingle_sets(batch.column("text")):
            n = np.diff(starts)
            _, first = np.unique(cls, return_index=True)
            first = np.sort(first[n[first] > 0])
            regs = [None] * (hi - lo)
            # sets of about SPREAD members are sketched together
            for some in np.split(first, np.flatnonzero(np.diff(np.cumsum(n[first]) // SPREAD)) + 1) if len(first) else []:
                own = np.concatenate([members[starts[i]:starts[i + 1]] for i in some])
                for i, r in zip(some, registers(own, np.concatenate([[0], np.cumsum(n[some])])), strict=True):
                    regs[i] = r.tobytes()
            yield {"doc_id": batch.column("doc_id")[lo:hi], "class": cls, "n": n, "registers": regs}

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                        "doc_id long, class long, n long, registers binary")


# ------------------------------------------------------------------------------- buckets
def buckets(classes: DataFrame) -> DataFrame:
    """bucket, class, head: the classes of every band value that two or more classes have.  ``head``
    is a smaller class of the bucket (the class itself for the bucket's smallest)."""
    schema = pa.schema([("bucket", pa.int64()), ("class", pa.int64()), ("head", pa.int64()), ("own", pa.int64())])

    def run(batches):
        values, owners, size = [], [], 0

        def out():
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            first = np.concatenate([[True], value[1:] != value[:-1]])
            run_of = np.cumsum(first) - 1
            # a local head's row counts its local bucket; the others' rows stay out of the shuffle's way
            own = np.where(first, np.bincount(run_of)[run_of], 0)
            return pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(owner), pa.array(owner[np.flatnonzero(first)][run_of]),
                                               pa.array(own)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, WIDTH).astype(np.uint64)
            h = np.zeros(regs.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(WIDTH):
                h = T.mix(h ^ (regs[:, :, k] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
            values.append(h.ravel())
            owners.append(np.repeat(batch.column("class").to_numpy(), BANDS))
            size += len(values[-1])
            if size >= TASK_BANDS:
                yield out()
                values, owners, size = [], [], 0
        if size:
            yield out()

    local = classes.select("class", "registers").mapInArrow(freeing(run), "bucket long, class long, head long, own long")
    # entries below a local head need no shuffle; local heads (one row per task and bucket) find the bucket's head
    local = stored(local, "local_buckets")
    w = Window.partitionBy("bucket")
    heads = local.where(F.col("own") > 0).withColumn("total", F.sum("own").over(w)).where(F.col("total") > 1) \
        .select("bucket", "class", F.min("class").over(w).alias("head"))
    return heads.unionByName(local.where(F.col("own") == 0).select("bucket", "class", "head"))


# ------------------------------------------------------------------------------- verification
def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles (packed) of the classes in ``wanted``.  A bit array (16 bits per class, at most 8 MB) keeps
    most other sets out of the join that decides."""
    wanted = stored(wanted.select("class").distinct(), "wanted")     # ids only
    bits = 1 << min(26, max(16, int(16 * wanted.count()).bit_length()))
    words = wanted.select(F.pmod(F.col("class"), F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("on")).collect()
    marks = np.zeros(bits // 64, np.int64)
    marks[[w.word for w in words]] = [w.on for w in words]
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def marked(cls: np.ndarray) -> np.ndarray:
        bit = cls & (bits - 1)
        return (shared.value[bit >> 6] >> (bit & 63)) & 1 > 0

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, members, starts, cls in shingle_sets(batch.column("text")):
            _, first = np.unique(cls, return_index=True)
            first = first[marked(cls[first]) & (np.diff(starts)[first] > 0)]
            yield {"class": cls[first], "shingles": [pack(members[starts[i]:starts[i + 1]]) for i in first]}

    rows = over_batches(docs.select("text"), run, "class long, shingles binary").join(wanted, "class", "left_semi")
    return stored(rows.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two rising arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = _shared(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _column(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _registers(rows: pa.Table | pa.RecordBatch, name: str = "registers") -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, head, n of the pairs (class, head) whose registers allow a link."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ok = possible(_registers(batch, "registers"), _registers(batch, "h_registers"), _column(batch, "n"), _column(batch, "h_n"))
        yield {c: batch.column(c).filter(pa.array(ok)) for c in ("class", "head", "n")}

    own = classes.select("class", "n", "registers")
    head = classes.select(F.col("class").alias("head"), F.col("n").alias("h_n"), F.col("registers").alias("h_registers"))
    return over_batches(pairs.select("class", "head").join(own, "class").join(head, "head"), run, "class long, head long, n long")


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (class, head, n) that are linked.  A head's classes are dealt to parts of about
    BLOCK_SHINGLES shingles; each part gets the head's set, and small parts share tasks."""
    def verify(table: pa.Table) -> pa.Table:
        head, cls, shingles = _column(table, "head"), _column(table, "class"), table["shingles"]
        a, b, own = [], [], None
        for i in np.lexsort((cls != head, head)).tolist():        # a head's row, then its classes
            mine = unpack(shingles[i].as_py(), np.uint64)
            if cls[i] == head[i]:
                own = mine
            elif linked(mine, own):
                a.append(cls[i])
                b.append(head[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parts = stored(pairs.groupBy("head").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"), F.sum("n").alias("w")), "star_parts")
    bins = max(1, math.ceil((parts.agg(F.sum("w")).first()[0] or 0) / BLOCK_SHINGLES))
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("head").alias("class"), "head", "parts", "part")
    # only heads of several parts (each of BLOCK_SHINGLES shingles or more) are looked up
    members = pairs.join(parts.where(F.col("parts") > 1).select("head", "parts"), "head", "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    both = members.select("class", "head", "parts", "part").unionByName(heads).select(
        "class", "head", F.pmod(F.xxhash64("head", "part"), F.lit(bins)).alias("task"),
        F.when(F.col("parts") > 1, F.xxhash64("head", "part")).otherwise(F.lit(0)).alias("alone"))
    return both.join(sets, "class").groupBy("task", "alone").applyInArrow(freeing_group(verify), "a long, b long")


def blocks(rows: DataFrame, weight: str) -> DataFrame:
    """``rows`` (unit, class, ...) with task, i, j and side.  Small units share tasks; a unit above one block is
    cut into parts, and every pair of parts is a task: side 0 and 1 are held against each other."""
    units = stored(rows.groupBy("unit").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(weight) / BLOCK_SHINGLES))
                                            .cast("int").alias("parts"), F.count(F.lit(1)).alias("g"), F.sum(weight).alias("w")), "units")
    total = units.agg(F.sum("g"), F.sum("w")).first()
    bins = max(1, math.ceil(max((total[0] or 0) / BLOCK, (total[1] or 0) / BLOCK_SHINGLES)))
    large = units.where(F.col("parts") > 1).select("unit", "parts")
    rows = rows.join(large, "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = F.col("parts") == 1
    return rows.withColumns({
        "task": F.when(one, F.pmod(F.xxhash64("unit"), F.lit(bins))).otherwise(F.col("unit")),
        "i": F.when(one, -1).otherwise(F.least("part", "other")), "j": F.when(one, -1).otherwise(F.greatest("part", "other")),
        "side": F.when(F.col("part") > F.col("other"), 1).otherwise(0)}).drop("part", "other", "parts")


def _open_pairs(unit, root, side, regs, n) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): pairs of rows of one unit, of different roots (and sides, where there are two), that can be linked."""
    order = np.argsort(unit, kind="stable")
    two = side.max(initial=0) > 0
    for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1) if len(order) else []:
        for k, x in enumerate(rows):
            if two and side[x]:
                continue
            ys = rows[side[rows] == 1] if two else rows[k + 1:]
            ys = ys[root[ys] != root[x]]
            if len(ys):
                ys = ys[possible(regs[x], regs[ys], n[x:x + 1], n[ys])]
            if len(ys):
                yield x, ys


def open_classes(rows: DataFrame) -> DataFrame:
    """unit, class of the rows (unit, class, root, n, registers) that can be linked with a class of another root in the unit."""
    def run(table: pa.Table) -> pa.Table:
        unit, cls, root, n, side = (_column(table, c) for c in ("unit", "class", "root", "n", "side"))
        keep = np.zeros(len(unit), bool)
        for x, ys in _open_pairs(unit, root, side, _registers(table), n):
            keep[x] = True
            keep[ys] = True
        return pa.table({"unit": pa.array(unit[keep]), "class": pa.array(cls[keep])})

    cut = blocks(rows.withColumn("weight", F.lit(1)), "weight").drop("weight")
    return cut.groupBy("task", "i", "j").applyInArrow(freeing_group(run), "unit long, class long").distinct()


def block_links(rows: DataFrame) -> DataFrame:
    """(a, b): per task a spanning forest of the links between different roots of the rows (unit, class, root, n,
    registers, shingles)."""
    def run(table: pa.Table) -> pa.Table:
        unit, cls, root, n, side = (_column(table, c) for c in ("unit", "class", "root", "n", "side"))
        root, shingles, out = root.copy(), table["shingles"], []
        cached = {}

        def members(i):
            if i not in cached:
                if len(cached) > 256:
                    cached.clear()
                cached[i] = unpack(shingles[i].as_py(), np.uint64)
            return cached[i]

        for x, ys in _open_pairs(unit, root, side, _registers(table), n):
            for y in ys:
                if root[x] != root[y] and linked(members(int(x)), members(int(y))):
                    out.append((cls[x], cls[y]))
                    root[root == root[y]] = root[x]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks(rows, "n").groupBy("task", "i", "j").applyInArrow(freeing_group(run), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    rows = stored(sketches(docs), "sketches")
    classes = stored(rows.where(F.col("n") > 0).groupBy("class").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("registers", ignorenulls=True).alias("registers")), "classes")
    met = stored(buckets(classes), "buckets")

    # every class and the bucket head that it meets most often
    pairs = met.where(F.col("class") != F.col("head")).groupBy("class", "head").agg(F.count(F.lit(1)).alias("bands"))
    best = stored(pairs.groupBy("class").agg(F.max(F.struct("bands", (-F.col("head")).alias("m"))).alias("x")).select(
        "class", (-F.col("x.m")).alias("head")), "best")
    sets = candidate_sets(docs, met)
    first = stored(star_links(stored(likely(best, classes), "likely"), sets), "star_links")

    # buckets with classes of several components, equal ones once
    found = components(first)
    found = stored(found.select(F.col("node").alias("class"), "root"), "first_components")
    met = met.select("bucket", "class").join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))
    met = stored(met, "bucket_roots")
    still = met.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g"),
                                      F.bit_xor(F.xxhash64("class")).alias("unit")).where(F.col("lo") != F.col("hi"))
    once = stored(still.groupBy("unit", "g").agg(F.min("bucket").alias("bucket")), "open_buckets")
    units = met.join(once.select("bucket", F.xxhash64("unit", "g").alias("unit")), "bucket").select("unit", "class", "root")
    units = stored(units.join(classes.select("class", "n", "registers"), "class"), "open_units")
    names = stored(open_classes(units), "open_classes")
    rest = units.join(names, ["unit", "class"]).join(sets, "class")
    second = block_links(stored(rest, "open_sets"))
    groups = stored(components(stored(first.unionByName(second), "links")), "components")

    least = stored(classes.select("class", "least").join(groups, F.col("class") == F.col("node"), "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")), "least")
    # written before it is joined: a component with most classes is then a skewed join that can be split
    ids = stored(least.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    ids = least.join(ids, "root").select(F.col("class").alias("c"), "component_id")
    out = rows.join(ids, (F.col("class") == F.col("c")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op11_setsketch_dedup": op11_setsketch_dedup}
