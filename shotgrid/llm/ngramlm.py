"""Operator 1: language-model scoring with an Elias-Fano n-gram trie.

Training is one Spark job per order.  Tasks count n-grams in numpy chunks and deal them, packed
and sorted, to ranges of the key space; a range's task merges the counts and writes one shard of
the level:

* level 1, the vocabulary: an Elias-Fano sequence of word hashes; a word's id is its rank;
* level k: for every parent (an n-gram of level k - 1, by rank) its next words, made one rising
  sequence ``(parent - first) * V + word`` and kept as Elias-Fano, with monotone pointers from
  parents to their first child.  Ranges are cut by the parents' counts, so that a frequent
  context is split over shards and no task gets more than about TASK_TOKENS tokens.

A second, map-only pass over the shards turns counts into probabilities (absolute discounting
with discounts from the counts of counts of all shards) and quantises them to 256 centres per
shard.  Every n-gram of every order is counted, so the counts of counts are those of the whole
training text; the query stores all of them (``EVERY``).

Shards are files in the shared folder (``spark.checkpoint.dir``) that every task maps into memory:
workers of a host share the pages, and nothing of the model is collected or broadcast but the list
of shards.  Scoring is map-only: a word after a context is found by searching the successor of
``(context - first) * V + word`` among the context's children.

    p(w | c) = a(c w) + b(c) * p(w | shorter c),   p(w) = (n(w) + 1) / (N + V + 1)

Defined cases: a null or empty text is one end token; words never seen in training have the
probability of count 0 and no longer context; without training rows N = V = 0; a null id counts as
the text '' in the split; repeated rows are counted and scored each; an empty table gives no rows;
other columns are ignored.  Files need a shared folder that tasks can open (a mounted path).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm import efano as E
from shotgrid.llm import text as T
from shotgrid.llm.common import crc_mod, documents, freeing, freeing_group, pack, unpack
from shotgrid.session import fresh_path

ORDER = 3
LEAST_COUNT = {1: 1, 2: 1, 3: 2}         # default of train(): n-grams that a level stores, by order
EVERY = dict.fromkeys(LEAST_COUNT, 1)    # what the query passes
FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 1_000_000
TASK_TOKENS = 2_000_000
CENTRES = 256
END = int(T.mix(np.array([0x51ED270B], np.uint64))[0])
U = np.uint64


def shared_file(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared folder, as a path that tasks can open."""
    path = fresh_path(spark, kind)
    scheme, _, rest = path.partition("://") if "://" in path else ("file", "", path.removeprefix("file:"))
    if scheme != "file":
        raise ValueError(f"memory-mapped levels need a mounted shared folder, not {path}")
    return "/" + rest.lstrip("/")


def chunks(batches, column: str = "text"):
    """(batch, first row, last row + 1, token hashes, tokens per row), about CHUNK_TOKENS at a
    time; every row's tokens end with END."""
    for batch in batches:
        held, lo0, total = [], 0, 0
        for lo, hi, hashes, counts in T.tokenize(batch.column(column)):
            ends = np.cumsum(counts)
            held.append((np.insert(hashes, ends, U(END)), counts + 1))
            total += len(hashes) + len(counts)
            if total >= CHUNK_TOKENS or hi == batch.num_rows:
                yield batch, lo0, hi, np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
                held, lo0, total = [], hi, 0


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often (or with what weight) they occur."""
    if weights is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


# --------------------------------------------------------------------------------- levels
@dataclass
class Level:
    """The shards of one order.  ``first`` has each shard's lowest key, ``base`` the rank of its
    first n-gram.  From order 2 on a key is (parent << 32 | word)."""
    order: int
    words: int = 0                                        # V: size of the vocabulary
    paths: list[str] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    parents: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    fixed: dict[int, float] = field(default_factory=dict)  # back-off weights of parents that lie in two shards or more
    tallies: list[int] = field(default_factory=lambda: [0] * 4)    # n-grams seen 1 to 4 times, stored or not

    def shard(self, i: int) -> dict:
        got = _MAPPED.get(self.paths[i])
        if got is None:
            got = _MAPPED[self.paths[i]] = E.load(self.paths[i])
        return got

    def table(self, i: int) -> dict:
        path = self.paths[i] + ".prob"
        got = _MAPPED.get(path)
        if got is None:
            got = _MAPPED[path] = E.load(path)
        return got

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key (rising), or -1."""
        out = np.full(len(keys), -1, np.int64)
        for i, at in self._slices(keys, self.first) if self.paths else ():
            got = self._local(i, keys[at])
            out[at] = np.where(got < 0, -1, got + self.base[i])
        return out

    def _local(self, i: int, keys: np.ndarray) -> np.ndarray:
        s = self.shard(i)
        if self.order == 1:
            return E.find(s, keys)
        parent, word = (keys >> U(32)).astype(np.int64), keys & U(0xFFFFFFFF)
        lo, hi = self.parents[i]
        inside = (parent >= lo) & (parent <= hi)
        out = np.full(len(keys), -1, np.int64)
        out[inside] = E.find(s, (parent[inside] - lo).astype(U) * U(self.words) + word[inside])
        return out

    def _slices(self, ranks: np.ndarray, first: np.ndarray):
        """(shard, slice) of rising ``ranks`` by the shards' ``first``."""
        at = np.searchsorted(ranks, first)
        for i, (a, b) in enumerate(zip(at, np.append(at[1:], len(ranks)), strict=True)):
            if a < b:
                yield i, slice(a, b)

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        """Counts of n-grams by rising rank (any order)."""
        out = np.zeros(len(ranks), np.int64)
        for i, at in self._slices(ranks, self.base) if self.paths else ():
            out[at] = self.shard(i)["counts"][ranks[at] - self.base[i]]
        return out

    def alpha(self, ranks: np.ndarray) -> np.ndarray:
        """Discounted probabilities of n-grams by rising rank."""
        out = np.zeros(len(ranks))
        for i, at in self._slices(ranks, self.base) if self.paths else ():
            t = self.table(i)
            out[at] = t["alpha_book"][t["alpha"][ranks[at] - self.base[i]]]
        return out

    def backoff(self, parents: np.ndarray) -> np.ndarray:
        """Weight of the shorter context for each parent (rising ranks); 1 without children."""
        out = np.ones(len(parents))
        for i, at in self._slices(parents, self.parents[:, 0]) if self.paths else ():
            t, (lo, hi) = self.table(i), self.parents[i]
            here = parents[at]
            here = here[:np.searchsorted(here, hi, "right")]
            out[at.start:at.start + len(here)] = t["bow_book"][t["bow"][here - lo]]
        for p, b in self.fixed.items():
            i = np.searchsorted(parents, p)
            if i < len(parents) and parents[i] == p:
                out[i] = b
        return out

    def children(self, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and counts of the children of one parent, through its pointers."""
        words, counts = [], []
        for i, (lo, hi) in enumerate(self.parents):
            if lo <= parent <= hi:
                s = self.shard(i)
                ptr = {k[4:]: v for k, v in s.items() if k.startswith("ptr_")}
                at = E.value(ptr, np.array([parent - lo, parent - lo + 1])).astype(np.int64) - np.array([parent - lo, parent - lo + 1])
                index = np.arange(at[0], at[1])
                words.append((E.value(s, index) - U((parent - lo) * self.words)).astype(np.int64))
                counts.append(np.asarray(s["counts"])[index])
        return np.concatenate(words), np.concatenate(counts)


_MAPPED: dict[str, dict] = {}


@dataclass
class Model:
    """Sizes and the lists of shards; the levels themselves are files."""
    tokens: int = 0                         # N
    documents: int = 0
    levels: list[Level] = field(default_factory=list)

    @property
    def words(self) -> int:
        return self.levels[0].words

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids (-1: unknown) of token hashes."""
        keys, inverse = np.unique(hashes, return_inverse=True)
        return self.levels[0].find(keys)[inverse]

    def parents(self, rank: np.ndarray, starts: np.ndarray, at_start: int) -> np.ndarray:
        """Rank of what stands before each token."""
        out = np.concatenate([[-1], rank[:-1]])
        out[starts] = at_start
        return out

    def search(self, level: Level, parent: np.ndarray, ids: np.ndarray, where: np.ndarray):
        """(positions, their n-grams' ranks or -1, rising; which of these each position has)."""
        at = np.flatnonzero(where & (parent >= 0) & (ids >= 0))
        keys, inverse = np.unique(parent[at].astype(U) << U(32) | ids[at].astype(U), return_inverse=True)
        return at, level.find(keys), inverse

    def log10(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n(w), log10 of the base probability, log10 probability) of each token."""
        starts = np.cumsum(counts) - counts
        keys, inverse = np.unique(hashes, return_inverse=True)
        found = self.levels[0].find(keys)
        n = np.zeros(len(keys), np.int64)
        n[found >= 0] = self.levels[0].counts(found[found >= 0])
        ids, n = found[inverse], n[inverse]
        p = (n + 1) / (self.tokens + self.words + 1)
        base, rank, at, at_start = np.log10(p), ids, np.arange(len(ids)), self.words
        for level in self.levels[1:]:
            # weight of the shorter context, by distinct n-gram; 1 where the context has no children
            weight = np.ones(len(found))
            weight[found >= 0] = level.backoff(found[found >= 0])
            bow = np.ones(len(ids))
            bow[at] = weight[inverse]
            bow = np.concatenate([[1.0], bow[:-1]])
            bow[starts] = level.backoff(np.array([at_start])) if at_start >= 0 else 1.0
            parent = self.parents(rank, starts, at_start)
            at, found, inverse = self.search(level, parent, ids, bow < 1)
            alpha = np.zeros(len(found))
            alpha[found >= 0] = level.alpha(found[found >= 0])
            p = bow * p
            p[at] += alpha[inverse]
            rank, at_start = np.full(len(ids), -1, np.int64), -1
            rank[at] = found[inverse]
        return n, base, np.log10(p)


# ------------------------------------------------------------------------------- training
_DEAL = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_META = "part int, path string, size long, total long, info string"


def _dealt(keys: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    at = np.append(np.searchsorted(keys, bounds), len(keys))
    rows = [(k, pack(keys[a:b]), pack(n[a:b].astype(np.uint32))) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DEAL, strict=True)], schema=_DEAL)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [(unpack(r["keys"], U), unpack(r["n"], np.uint32).astype(np.int64)) for r in table.to_pylist()]
    return counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _count_job(rows: DataFrame, keys_of, bounds: np.ndarray, write) -> list[dict]:
    """Counts keys over the rows; the task of each range of keys calls ``write(part, keys, n)``."""
    def deal(batches):
        for _, _, _, hashes, counts in chunks(batches):
            keys, n = keys_of(hashes, counts)
            if len(keys):
                yield _dealt(keys, n, bounds)

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        got = write(part, *_merged(table))
        return pa.Table.from_pylist([got] if got else [], schema=pa.schema(
            [("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("total", pa.int64()),
             ("info", pa.string())]))

    packed = rows.select("text").mapInArrow(freeing(deal), "part int, keys binary, n binary")
    out = packed.groupBy("part").applyInArrow(freeing_group(merge), _META).collect()       # one small row per shard
    return [r.asDict() | {"info": json.loads(r.info)} for r in sorted(out, key=lambda r: r.part)]


def _cuts(n: np.ndarray, tokens: int) -> list[tuple[int, float]]:
    """Where ranges of about ``tokens`` occurrences begin: (rank, share of the words below it)."""
    total = np.cumsum(n)
    marks = np.arange(tokens, total[-1] if len(n) else 0, tokens)
    at = np.searchsorted(total, marks, "right")
    share = (marks - (total[at] - n[at])) / n[at]
    return sorted({(int(i), float(s) if n[i] > tokens else 0.0) for i, s in zip(at, share, strict=True)})


def _tallies(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _vocabulary(rows: DataFrame, folder: str, parts: int, task_tokens: int) -> tuple[Level, list[dict]]:
    def write(part: int, keys: np.ndarray, n: np.ndarray) -> dict:
        path = f"{folder}/1-{part}"
        E.save(path, E.build(keys, 1 << 64) | {"counts": n.astype(np.int64)})
        end = np.flatnonzero(keys == U(END))
        return {"part": part, "path": path, "size": len(keys), "total": int(n.sum()),
                "info": json.dumps({"cuts": _cuts(n, task_tokens), "documents": int(n[end].sum())})}

    bounds = (np.arange(parts, dtype=np.float64) * (2.0**64 / parts)).astype(U)
    shards = _count_job(rows, lambda hashes, counts: counted(hashes), bounds, write)
    level = Level(1, paths=[s["path"] for s in shards], first=bounds[[s["part"] for s in shards]],
                  base=np.concatenate([[0], np.cumsum([s["size"] for s in shards])]).astype(np.int64)[:max(1, len(shards))])
    level.words = sum(s["size"] for s in shards)
    return level, shards


def _next_level(rows: DataFrame, model: Model, folder: str, below: list[dict], task_tokens: int,
                least: int) -> tuple[Level, list[dict]]:
    """Counts the level above the model's last one and writes its shards."""
    order, words = len(model.levels) + 1, model.words
    if max(words + 1, sum(s["size"] for s in below)) >= 1 << 32:
        raise ValueError("more than 2**32 n-grams of one order: raise LEAST_COUNT")
    marks = {0}
    for base, s in zip(model.levels[-1].base.tolist(), below, strict=True):
        marks |= {(base << 32)} | {((base + i) << 32) | int(share * words) for i, share in s["info"]["cuts"]}
    if order == 2:                                       # the start of a text is parent V
        marks |= {(words << 32) | int(k * words / math.ceil(model.documents / task_tokens))
                  for k in range(math.ceil(model.documents / task_tokens))}
    bounds = np.array(sorted(marks), U)

    def keys_of(hashes: np.ndarray, counts: np.ndarray):
        ids = model.ids(hashes)
        starts = np.cumsum(counts) - counts
        parent = model.parents(ids, starts, words)
        every = np.ones(len(ids), bool)
        for level in model.levels[1:]:                        # rank of the n-gram that ends at each token
            at, found, inverse = model.search(level, parent, ids, every)
            rank = np.full(len(ids), -1, np.int64)
            rank[at] = found[inverse]
            parent = model.parents(rank, starts, -1)
        ok = parent >= 0
        return counted(parent[ok].astype(U) << U(32) | ids[ok].astype(U))

    def write(part: int, keys: np.ndarray, n: np.ndarray) -> dict:
        tallies, keep = _tallies(n), n >= least
        keys, n = keys[keep], n[keep]
        if not len(keys):
            return {"part": part, "path": None, "size": 0, "total": 0, "info": json.dumps({"tallies": tallies})}
        parent = (keys >> U(32)).astype(np.int64)
        lo, hi = int(parent[0]), int(parent[-1])
        x = (parent - lo).astype(U) * U(words) + (keys & U(0xFFFFFFFF))
        begin = np.searchsorted(parent, np.arange(lo, hi + 2))
        ptr = E.build((begin + np.arange(len(begin))).astype(U), int(begin[-1]) + len(begin) + 1)      # made strictly rising
        path = f"{folder}/{order}-{part}"
        E.save(path, E.build(x, (hi - lo + 1) * words) | {f"ptr_{k}": v for k, v in ptr.items()} | {"counts": n.astype(np.uint32)})
        edges = {}
        for p in {lo, hi}:
            c = n[parent == p]
            edges[p] = [int(c.sum()), int((c == 1).sum()), int((c == 2).sum()), int((c > 2).sum())]
        return {"part": part, "path": path, "size": len(keys), "total": int(n.sum()),
                "info": json.dumps({"cuts": _cuts(n, task_tokens), "tallies": tallies, "parents": [lo, hi], "edges": edges})}

    shards = _count_job(rows, keys_of, bounds, write)
    tallies = np.sum([s["info"]["tallies"] for s in shards], axis=0).tolist() if shards else [0] * 4
    shards = [s for s in shards if s["path"]]
    level = Level(order, words, [s["path"] for s in shards], bounds[[s["part"] for s in shards]] if shards else np.zeros(0, U),
                  np.array([s["info"]["parents"] for s in shards], np.int64).reshape(-1, 2),
                  np.concatenate([[0], np.cumsum([s["size"] for s in shards])]).astype(np.int64)[:max(1, len(shards))], tallies=tallies)
    return level, shards


def discounts(tallies: list[int]) -> list[float]:
    """What counts 1, 2 and 3 or more give away, from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, x) for x in tallies)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k * 0.95) for k, d in zip((1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), strict=True)]


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and centres: 256 bins of equal numbers of values, in logarithm; few values are exact."""
    values = np.unique(x)
    if len(values) > CENTRES:
        cuts = np.unique(np.quantile(x, np.linspace(0, 1, CENTRES + 1)[1:-1], method="lower"))
        code = np.searchsorted(cuts, x, "left")
        n = np.bincount(code, minlength=len(cuts) + 1)
        book = np.bincount(code, weights=np.log(x), minlength=len(cuts) + 1) / np.maximum(n, 1)
        return code.astype(np.uint8), np.exp(book)
    return np.searchsorted(values, x).astype(np.uint8), values


def _probabilities(spark: SparkSession, model: Model, level: Level, shards: list[dict]) -> None:
    """Writes the quantised probabilities beside each shard (map-only)."""
    below = model.levels[-1]
    give = np.array([0.0, *discounts(level.tallies)])

    def total_of(parents: np.ndarray) -> np.ndarray:
        if level.order > 2:
            return below.counts(parents)
        out = np.full(len(parents), model.documents, np.int64)          # parent V: the start of a text
        word = parents < model.words
        out[word] = below.counts(parents[word])
        return out

    def run(batches):
        for batch in batches:
            for i in batch.column("i").to_pylist():
                s, (lo, hi) = level.shard(i), level.parents[i]
                n = np.asarray(s["counts"]).astype(np.int64)
                parent = (E.value(s, np.arange(len(n))) // U(level.words)).astype(np.int64)
                kept = n - give[np.minimum(n, 3)]
                total = np.maximum(1, total_of(np.arange(lo, hi + 1)))
                alpha, book = _quantised(kept / total[parent])
                sums = np.bincount(parent, weights=kept, minlength=hi - lo + 1)
                bow, bow_book = _quantised(np.clip(1 - sums / total, 1e-9, 1.0))
                E.save(level.paths[i] + ".prob", {"alpha": alpha, "alpha_book": book, "bow": bow, "bow_book": bow_book})
                yield pa.RecordBatch.from_pylist([{"i": i}], schema=pa.schema([("i", pa.int32())]))

    n = len(shards)
    spark.range(n).select(F.col("id").cast("int").alias("i")).repartition(max(1, n)).mapInArrow(freeing(run), "i int").count()
    parts: dict[int, list] = {}
    for s in shards:
        for p, t in s["info"]["edges"].items():
            parts.setdefault(int(p), []).append(t)
    split = {p: np.sum(t, axis=0) for p, t in parts.items() if len(t) > 1}
    for p, (total, n1, n2, n3) in split.items():
        whole = max(1, int(total_of(np.array([p]))[0]))
        level.fixed[p] = float(np.clip(1 - (total - give[1] * n1 - give[2] * n2 - give[3] * n3) / whole, 1e-9, 1.0))


def train(rows: DataFrame, order: int = ORDER, task_tokens: int = TASK_TOKENS, least: dict[int, int] = LEAST_COUNT) -> Model:
    """The model of the texts of ``rows``; a level stores n-grams that occur ``least[order]`` times or more."""
    spark = rows.sparkSession
    folder = shared_file(spark, "llm/ngrams")
    level, shards = _vocabulary(rows, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), task_tokens)
    model = Model(sum(s["total"] for s in shards), sum(s["info"]["documents"] for s in shards), [level])
    while len(model.levels) < order and shards:
        level, shards = _next_level(rows, model, folder, shards, task_tokens, least[len(model.levels) + 1])
        if not shards:
            break
        _probabilities(spark, model, level, shards)
        model.levels.append(level)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    def run(batches):
        for batch, lo, hi, hashes, counts in chunks(batches):
            n, base, full = model.log10(hashes, counts)
            starts = np.cumsum(counts) - counts
            base, full = np.add.reduceat(base, starts), np.add.reduceat(full, starts)
            known = np.add.reduceat((n > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(counts.astype(np.int64)), pa.array(known),
                 pa.array(np.full(hi - lo, model.tokens, np.int64)), pa.array(base), pa.array(full)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT), least=EVERY))


QUERIES = {"op1_elias_fano_lm": op1_elias_fano_lm}
