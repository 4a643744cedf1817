"""Operator 5: quality classifier by co-training.

Two views of a document: its text (presence of words that go with rejection, and the shape of
its words and lines) and the page's metadata (language, source, stated length).  Each view has
a logistic classifier.  Over ROUNDS rounds each view labels the unlabelled documents that it is sure
of (calibrated on labelled rows it wasn't trained on) for the other view; at the end both views are
calibrated again and combined by a logistic model of their two log odds, which scores every
document.  A document is rejected where a label would be quality 0 or toxic 1.

The labelled rows are a bounded sample, the first LABELLED by hash of the id: their words are counted
in Spark for the lexicon, and what the driver gets of them is one bit per feature.  The unlabelled rows
are all others: one scan writes the features of every document as bits, and in each round a pass over
these adds up, per task, gradient and curvature of the documents that the teaching view is sure of, for
both views at once; sums of fixed size reach the driver, which makes the Newton step.  The pseudo-labelled
rows together weigh at most PSEUDO times the labelled ones, so the balance is the same at every size.
Lexicon and words: runs of letters, A-Z as a-z.  Scoring reads all rows, map-only.

Defined cases: a null or empty text has no words and is scored by its shape and metadata; a null
quality counts as 1 and a null toxic as 0, a row with both null isn't a label; a document labelled
twice is rejected if one label says so; null languages, sources and lengths are values of their
own; without both classes among the labels all documents are kept with score 1; repeated rows are
scored each; an empty table gives no rows; other columns are ignored (and kept by `keep_good`).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm import rules
from shotgrid.llm import text as T
from shotgrid.llm.common import documents, first_by_hash, freeing, over_batches, stored

LABELLED = 10_000
PSEUDO = 0.5                 # weight of all pseudo-labelled rows beside that of the labelled ones, at most
LEXICON = 512
LEAST_DOCS = 3               # documents of the sample that a lexicon word occurs in at least
ROUNDS, STEPS = 3, 2         # a round makes STEPS Newton steps from where the last one ended
SURE = 0.98
RIDGE = 1.0
META_BINS = 256
SHAPES = 9                   # numbers that _shape gives

_LETTERS = np.ones(256, bool)                 # what separates words here: all that is no letter
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
_DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True


# ------------------------------------------------------------------------------ features
def _shape(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Shape features, one row per text."""
    s = rules.part_stats(raw, cuts) if len(raw) <= T.CHUNK else rules.long_stats(raw)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars,
                     s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["n_upper"] / chars,
                     per(_DIGIT[raw]) / chars, per(_MARK[raw]) / chars, np.log1p(words / np.maximum(s["n_lines"], 1))], 1)


def _text_parts(texts: pa.Array):
    """(lo, hi, shape features, word hashes, words per text)."""
    raw, offsets = T.buffers(texts)
    for lo, hi in T.ranges(offsets):
        part, cuts = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        if len(part) > T.CHUNK:
            none = np.zeros(0, np.int64)
            hashes = np.concatenate([T.span_hash(x, *T.word_spans(x, none, _LETTERS), True) for x in T.pieces(part)])
            counts = np.array([len(hashes)])
        else:
            start, end = T.word_spans(part, cuts, _LETTERS)
            hashes, counts = T.span_hash(part, start, end, True), np.diff(np.searchsorted(start, cuts))
        yield lo, hi, _shape(part, cuts), hashes, counts


def _meta(langs: list, sources: list, lengths: list) -> np.ndarray:
    """Bins of the metadata, three per row: language, source, stated length."""
    bin_of = lambda x: zlib.crc32(x.encode()) % META_BINS
    size = ["null" if n is None else str(int(np.log2(max(1, n)) * 2)) for n in lengths]
    return np.array([[bin_of(f"lang={a}"), bin_of(f"source={b}"), bin_of(f"size={c}")]
                     for a, b, c in zip(langs, sources, size, strict=True)], np.int64).reshape(-1, 3)


def features(rows: DataFrame) -> DataFrame:
    """y, fold, shape and words (distinct hashes) of a bounded sample."""
    def run(batch: pa.RecordBatch):
        for lo, hi, shape, hashes, counts in _text_parts(batch.column("text")):
            at = np.cumsum(counts)
            yield {"y": batch.column("y")[lo:hi], "fold": batch.column("fold")[lo:hi], "shape": list(shape),
                   "words": [np.unique(hashes[e - n:e].astype(np.int64)) for e, n in zip(at, counts, strict=True)]}

    return over_batches(rows, run, "y int, fold boolean, shape array<double>, words array<long>")


# ------------------------------------------------------------------------------ learning
ROWS_AT_ONCE = 2000          # features are 0 and 1 in bytes; so many rows at once are made floats


def _floats(x: np.ndarray):
    for at in range(0, len(x), ROWS_AT_ONCE):
        yield slice(at, at + ROWS_AT_ONCE), np.column_stack([x[at:at + ROWS_AT_ONCE].astype(float), np.ones(len(x[at:at + ROWS_AT_ONCE]))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton steps."""
    k = x.shape[1] + 1
    w, price = np.zeros(k), np.full(k, ridge)
    price[-1] = 1e-6
    for _ in range(steps):
        hessian, slope = np.diag(price), price * w
        for rows, part in _floats(x):
            p = _chance(part @ w)
            hessian += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
            slope += part.T @ (p - y[rows])
        step = np.linalg.solve(hessian, slope)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[part @ w for _, part in _floats(x)]])


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lexicon(train: DataFrame) -> np.ndarray:
    """The LEXICON words with the largest likelihood ratio statistic among those that go with rejection, of rows
    (y, words); sorted hashes."""
    total = train.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    if not total["n"] or not 0 < total["bad"] < total["n"]:
        return np.zeros(0, np.int64)
    base = total["bad"] / total["n"]
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    rate = bad / n

    def part(k, p, q):
        return F.when(k > 0, k * F.log(p / F.lit(q))).otherwise(0.0)

    words = train.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
    words = words.where((n >= LEAST_DOCS) & (rate > base)).withColumn("score", part(bad, rate, base) + part(n - bad, 1 - rate, 1 - base))
    top = words.where(F.col("score") >= 3.0).orderBy(F.desc("score"), "word").limit(LEXICON)
    return np.sort(np.array([r["word"] for r in top.select("word").collect()], np.int64))


@dataclass
class Model:
    """What scoring needs; its size is fixed by LEXICON and META_BINS."""
    words: np.ndarray
    edges: np.ndarray               # per shape feature, the cuts between its bins
    text: np.ndarray
    meta: np.ndarray
    calibrate: np.ndarray           # weights of the two views' log odds, and the intercept

    def shape_columns(self, shape: np.ndarray) -> np.ndarray:
        out = [shape[:, [j]] > self.edges[j][None, :] for j in range(shape.shape[1])]
        return np.concatenate(out, 1)

    def text_odds(self, shape: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log odds of the text view; ``hashes`` are words of the texts ``doc``."""
        k = len(self.words)
        z = self.shape_columns(shape) @ self.text[k:-1] + self.text[-1]
        if k and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), k - 1)
            hit = self.words[at] == hashes
            pairs = np.unique(doc[hit] * k + at[hit])
            z += np.bincount(pairs // k, weights=self.text[pairs % k], minlength=len(z))
        return z

    def meta_odds(self, meta: np.ndarray) -> np.ndarray:
        return self.meta[meta].sum(1) + self.meta[-1]

    def reject(self, z_text: np.ndarray, z_meta: np.ndarray) -> np.ndarray:
        return _chance(self.calibrate[0] * z_text + self.calibrate[1] * z_meta + self.calibrate[2])


def one_hot(bins: np.ndarray, n: int = META_BINS) -> np.ndarray:
    out = np.zeros((len(bins), n), bool)
    np.put_along_axis(out, bins.astype(np.int64), True, 1)
    return out


def bits(model: Model, shape: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The text view's features, one row per text, as booleans: words of the lexicon, then bins of the shape."""
    k = len(model.words)
    present = np.zeros((len(shape), k), bool)
    if k and len(hashes):
        at = np.minimum(np.searchsorted(model.words, hashes), k - 1)
        hit = model.words[at] == hashes
        present[doc[hit], at[hit]] = True
    return np.concatenate([present, model.shape_columns(shape)], 1)


def views(docs: DataFrame, sample: DataFrame, model: Model) -> DataFrame:
    """text (packed bits), meta (bins), y (null: not in ``sample``), fold of every document, equal rows once.
    ``sample`` (l_id, y, fold) has at most LABELLED rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        meta = _meta(*[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]).astype(np.int16)
        for lo, hi, shape, hashes, counts in _text_parts(batch.column("text")):
            x = np.packbits(bits(shared.value, shape, np.repeat(np.arange(hi - lo), counts), hashes.astype(np.int64)), axis=1)
            yield {"text": [r.tobytes() for r in x], "meta": [r.tobytes() for r in meta[lo:hi]], "y": batch.column("y")[lo:hi],
                   "fold": batch.column("fold")[lo:hi]}

    rows = _columns(docs, F.lit(None).cast("int")).drop("y").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"), "left")
    rows = over_batches(rows, run, "text binary, meta binary, y int, fold boolean")
    return stored(rows.groupBy("text", "meta", "y", "fold").count().drop("count"), "views")


def _matrices(text: list, meta: list, width: int) -> dict[str, np.ndarray]:
    """Features of both views from the columns of ``views``."""
    x = np.frombuffer(b"".join(text), np.uint8).reshape(len(text), -1)
    return {"text": np.unpackbits(x, axis=1, count=width).astype(bool),
            "meta": one_hot(np.frombuffer(b"".join(meta), np.int16).reshape(-1, 3))}


@dataclass
class Student:
    """A view's weights, and how its log odds become chances (slope, intercept)."""
    weights: np.ndarray
    scale: np.ndarray

    def sure(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rows it is sure of, its labels)."""
        p = _chance(_apply(self.scale, _apply(self.weights, x)[:, None]))
        return (p >= SURE) | (p <= 1 - SURE), (p >= 0.5).astype(float)


OTHER = {"text": "meta", "meta": "text"}


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of the summed logistic loss, without the ridge."""
    slope, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for rows, part in _floats(x):
        p = _chance(part @ w)
        slope += part.T @ (p - y[rows])
        hessian += (part * (p * (1 - p))[:, None]).T @ part
    return slope, hessian


def pseudo_sums(unlabelled: DataFrame, students: dict[str, Student], current: dict[str, np.ndarray], width: int) -> dict:
    """view -> (rows, gradient, Hessian) over the unlabelled rows that the other view is sure of, at the weights ``current``."""
    shared = unlabelled.sparkSession.sparkContext.broadcast((students, current))

    def run(batches):
        teachers, w = shared.value
        sums = {v: [0, np.zeros(len(w[v])), np.zeros((len(w[v]), len(w[v])))] for v in w}
        for batch in batches:
            if batch.num_rows:
                x = _matrices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width)
                for v, other in OTHER.items():
                    sure, y = teachers[other].sure(x[other])
                    slope, hessian = slopes(x[v][sure], y[sure], w[v])
                    sums[v][0] += int(sure.sum())
                    sums[v][1] += slope
                    sums[v][2] += hessian
        for v, (n, slope, hessian) in sums.items():
            # row i of the matrix from its diagonal on, then the gradient; the row count is the gradient's last entry
            rows = [np.where(np.arange(len(slope)) >= i, hessian[i], 0.0)[i:] for i in range(len(slope))] + [np.append(slope, n)]
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["view", "i", "row"])

    rows = unlabelled.select("text", "meta").mapInArrow(freeing(run), "view string, i int, row array<double>")
    added = rows.groupBy("view", "i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("view", "i", vector_to_array("s").alias("s"))
    got: dict[str, dict[int, list]] = {v: {} for v in OTHER}
    for r in added.collect():                              # as many rows as features
        got[r["view"]][r["i"]] = r["s"]
    out = {}
    for v, by in got.items():
        k = len(current[v])
        if not by:
            out[v] = 0, np.zeros(k), np.zeros((k, k))
            continue
        hessian = np.zeros((k, k))
        for i in range(k):
            hessian[i, i:] = by[i]
        out[v] = int(by[k][-1]), np.array(by[k][:-1]), hessian + np.triu(hessian, 1).T
    return out


def cotrain(model: Model, labelled: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, sums) -> Model:
    """Trains both views.  ``labelled``: features of the labelled rows by view, y their labels, ``fold`` those kept
    from training for calibration; ``sums(students, current)`` gives what ``pseudo_sums`` does."""
    train, check = np.flatnonzero(~fold), np.flatnonzero(fold) if fold.any() else np.flatnonzero(~fold)
    current = {v: logistic(x[train], y[train]) for v, x in labelled.items()}

    def student(v: str) -> Student:
        odds = _apply(current[v], labelled[v][check])
        return Student(current[v], logistic(odds[:, None], y[check], ridge=0.01))

    for _ in range(ROUNDS):
        students = {v: student(v) for v in labelled}
        for _ in range(STEPS):
            found = sums(students, current)
            for v, (n, slope, hessian) in found.items():
                weight = min(1.0, PSEUDO * len(train) / n) if n else 0.0
                price = np.full(len(current[v]), RIDGE)
                price[-1] = 1e-6
                own_slope, own_hessian = slopes(labelled[v][train], y[train], current[v])
                curve = own_hessian + weight * hessian + np.diag(price + 1e-9)
                current[v] = current[v] - np.linalg.solve(curve, own_slope + weight * slope + price * current[v])
    model.text, model.meta = current["text"], current["meta"]
    odds = np.column_stack([_apply(current[v], labelled[v][check]) for v in ("text", "meta")])
    model.calibrate = logistic(odds, y[check], ridge=0.01)
    return model


def _columns(docs: DataFrame, y) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), y.alias("y"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of ``docs`` with ``labels`` (doc_id, quality, toxic)."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where((F.col("quality").isNotNull() | F.col("toxic").isNotNull()) & F.col("doc_id").isNotNull()) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad.cast("int")).alias("y"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    sample = stored(first_by_hash(known, "doc_id", LABELLED, 5).select(F.col("doc_id").alias("l_id"), "y", fold.alias("fold")), "labelled_ids")
    rows = _columns(docs, F.lit(None).cast("int")).drop("y").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    rows = features(rows.drop("l_id"))
    # rows equal in words, shape and label once, however often an id or a text is repeated
    rows = stored(rows.groupBy("y", "fold", "shape", F.xxhash64("words").alias("h"), F.size("words").alias("k")).agg(F.first("words").alias("words"))
                  .drop("h", "k"), "labelled")
    sides = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sides.values()) < 4 or len({y for _, y in sides}) < 2:
        return None
    whole = len(sides) == 4                                    # both classes on both sides; else all rows train and calibrate
    train = rows.where(~F.col("fold")) if whole else rows
    shape = np.array([r["shape"] for r in train.select("shape").sort("shape").collect()])
    edges = np.quantile(shape, [*np.linspace(0.05, 0.95, 10), 0.98, 0.995], axis=0).T
    model = Model(lexicon(train), edges, np.zeros(0), np.zeros(0), np.array([1.0, 0.0, 0.0]))
    every = views(docs, sample, model)
    own = every.where(F.col("y").isNotNull()).orderBy("text", "meta", "y", "fold").toArrow()        # at most LABELLED distinct rows and copies of their ids
    width = len(model.words) + edges.size
    labelled = _matrices(own["text"].to_pylist(), own["meta"].to_pylist(), width)
    folds = own["fold"].to_numpy(zero_copy_only=False).astype(bool) if whole else np.zeros(own.num_rows, bool)
    unlabelled = every.where(F.col("y").isNull())
    return cotrain(model, labelled, own["y"].to_numpy().astype(float), folds,
                   lambda students, current: pseudo_sums(unlabelled, students, current, width))


def _scores(model: Model | None, texts: pa.Array, langs: list, sources: list, lengths: list):
    """(lo, hi, text odds, metadata odds, chance of rejection)."""
    meta = _meta(langs, sources, lengths)
    if model is None:
        zero = np.zeros(len(texts))
        yield 0, len(texts), zero, zero, zero
        return
    for lo, hi, shape, hashes, counts in _text_parts(texts):
        doc = np.repeat(np.arange(hi - lo), counts)
        a, b = model.text_odds(shape, doc, hashes.astype(np.int64)), model.meta_odds(meta[lo:hi])
        yield lo, hi, a, b, model.reject(a, b)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_odds, meta_odds (log odds of rejection), score (chance to be good), keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        cols = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
        for lo, hi, a, b, p in _scores(shared.value, batch.column("text"), *cols):
            yield {"doc_id": batch.column("doc_id")[lo:hi], "text_odds": a, "meta_odds": b, "score": 1 - p, "keep": p < 0.5}

    return over_batches(_columns(docs, F.lit(None).cast("int")), run,
                        "doc_id long, text_odds double, meta_odds double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, _, _, p in _scores(shared.value, batch.column("text"), *cols):
                keep[lo:hi] = p < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(freeing(run), docs.schema)


def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_cotrained_quality": op5_cotrained_quality}
