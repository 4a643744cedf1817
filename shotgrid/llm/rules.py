"""Operator 8: quality rules with adaptive thresholds.

1. Statistics of every whole text (vectorised over Arrow batches).
2. Mergeable quantile sketches per language and source: logarithmic buckets (DDSketch), so a
   sketch is rows (lang, source, metric, bucket, n) and merging is a sum.  Buckets are counted
   before the shuffle and a sketch has at most about 1,100 rows per metric, so a source that
   holds a third of all documents costs no more than any other.
3. Cutoffs per (lang, source), from the median and the spread of the lower half, which junk on
   the high side can't move until it is half of the source.  The merged sketch of the language counts
   as ``PRIOR`` further documents of every source: a cutoff is the mean of the source's and the
   language's, weighed by the source's documents and ``PRIOR``, so small sources lean on their
   language and large ones on themselves, without a border between them.
4. A join back by (lang, source); a document stays if it passes the base rules and no metric
   lies beyond its group's cutoff.

Defined cases: a null text has no words and fails the base rules; null languages and sources
form groups of their own; repeated rows count as often as they occur; a value equal to its
cutoff passes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrid.llm import text as T
from shotgrid.llm.common import documents, over_batches, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA, LEAST = 1.02, 1e-6           # relative error of a quantile: about 1 %
PRIOR = 50                          # documents that the language's sketch counts for in each source
SPREADS = 4.0                       # lower-half spreads (median - 5 % quantile) above the median
#: metric -> (value that always passes, share of the median that counts as spread at least)
METRICS = {"word_length": (0.0, 0.1), "symbols": (0.05, 0.25), "dup_lines": (0.3, 0.25),
           "repeats": (0.2, 0.25), "capitals": (0.3, 0.25)}

_SYMBOL, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False

STATS = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, n_lines long, n_upper long")


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per document."""
    _, first = np.unique(T.mix(keys + T.mix(doc.astype(np.uint64))), return_index=True)
    return np.bincount(doc[first], minlength=n)


def _repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words per document that lie in a run of WINDOW words found twice or more in it."""
    n, doc = len(counts), np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < WINDOW:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[:len(doc) - WINDOW + 1] == doc[WINDOW - 1:])
    key = np.zeros(len(at), np.uint64)
    for i in range(WINDOW):
        key += hashes[at + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    key = T.mix(key + T.mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twice = np.zeros(len(key), bool)
    equal = key[order][1:] == key[order][:-1]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cover = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def part_stats(raw: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    n = len(cuts) - 1
    start, end = T.word_spans(raw, cuts)
    counts = np.diff(np.searchsorted(start, cuts))
    hashes = T.span_hash(raw, start, end, lower=False)
    solid = ~T.WHITE[raw]
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
    # lines: from a text's begin or behind a newline, up to the next newline or the text's end
    nl = np.flatnonzero(raw == 10)
    first = np.sort(np.concatenate([cuts[:-1], nl + 1]), kind="stable")
    last = np.sort(np.concatenate([cuts[1:], nl]), kind="stable")
    words = np.searchsorted(start, last) - np.searchsorted(start, first)
    line_doc = np.repeat(np.arange(n), per(raw == 10) + 1)
    full = words > 0
    keys, doc = T.span_hash(raw, first[full], last[full], lower=False), line_doc[full]
    lines = np.bincount(doc, minlength=n)
    return {"n_words": counts, "word_chars": per(solid & _FIRST_BYTE[raw]), "n_symbols": per(_SYMBOL[raw]),
            "n_dup_lines": lines - _distinct(keys, doc, n), "n_repeat_words": _repeated(hashes, counts),
            "n_lines": lines, "n_upper": per(_UPPER[raw])}


def long_stats(raw: np.ndarray) -> dict[str, np.ndarray]:
    """One text above the piece size: words by pieces, lines one by one."""
    hashes = np.concatenate([T.span_hash(x, *T.word_spans(x, np.zeros(0, np.int64)), lower=False) for x in T.pieces(raw)])
    seen, lines, dup = set(), 0, 0
    for line in raw.tobytes().split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    solid, count = ~T.WHITE[raw], np.array([len(hashes)])
    one = lambda x: np.array([int(x)])
    return {"n_words": count, "word_chars": one((solid & _FIRST_BYTE[raw]).sum()), "n_symbols": one(_SYMBOL[raw].sum()),
            "n_dup_lines": one(dup), "n_repeat_words": _repeated(hashes, count), "n_lines": one(lines),
            "n_upper": one(_UPPER[raw].sum())}


def _stats(batch: pa.RecordBatch):
    raw, offsets = T.buffers(batch.column("text"))
    for lo, hi in T.ranges(offsets):
        part, cuts = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        got = long_stats(part) if len(part) > T.CHUNK else part_stats(part, cuts)
        yield got | {c: batch.column(c)[lo:hi] for c in ("doc_id", "lang", "source")}


def text_stats(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return over_batches(rows, _stats, STATS)


# ----------------------------------------------------------------------- sketches, cutoffs
def metrics(stats: DataFrame) -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {"word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / chars,
            "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeats": F.col("n_repeat_words") / words, "capitals": F.col("n_upper") / chars}


def bucket(x: Column) -> Column:
    return F.when(x <= LEAST, 0).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA))).cast("int")


def bucket_value(b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), b - 0.5))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over the documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics(stats).items()])
    return stats.where(~base_failed()).select("lang", "source", F.inline(each)) \
        .groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """One row per (keys, metric): its documents and the value at each point."""
    group = Window.partitionBy(*keys, "metric")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(group))
    at = [bucket_value(F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("bucket")))).alias(k) for k, p in points.items()]
    return s.groupBy(*keys, "metric").agg(F.max("all").alias("docs"), *at)


def cutoffs(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: documents, and for each metric the lowest and highest value to keep."""
    q = quantiles(sketch, keys, {"low": 0.05, "mid": 0.5})
    out = []
    for k, (floor, share) in METRICS.items():
        here = F.col("metric") == k
        spread = SPREADS * F.greatest(F.col("mid") - F.col("low"), F.col("mid") * share)
        out.append(F.max(F.when(here, F.greatest(F.col("mid") + spread, F.lit(floor)))).alias(f"{k}_max"))
    two_sided = F.max(F.when(F.col("metric") == "word_length", F.col("mid") - SPREADS * F.greatest(
        F.col("mid") - F.col("low"), F.col("mid") * 0.1)))
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *out, two_sided.alias("word_length_min"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics, base verdict, verdict and the broken metrics of every row of ``docs``."""
    stats = stored(text_stats(docs), "rule_stats")
    sketch = stored(sketches(stats), "rule_sketches")
    by_lang = cutoffs(merge(sketch, ["lang"]), ["lang"])
    by_source = cutoffs(sketch, ["lang", "source"])
    names = [c for c in by_lang.columns if c not in ("lang", "docs")]
    wide = by_lang.select(F.col("lang").alias("l"), *[F.col(c).alias(f"l_{c}") for c in names])
    cut = by_source.join(wide, by_source.lang.eqNullSafe(wide.l))
    cut = cut.select(F.col("lang").alias("c_lang"), F.col("source").alias("c_source"),
                     *[((F.col("docs") * F.col(c) + PRIOR * F.col(f"l_{c}")) / (F.col("docs") + PRIOR)).alias(c) for c in names])
    out = stats.join(cut, stats.lang.eqNullSafe(cut.c_lang) & stats.source.eqNullSafe(cut.c_source), "left")
    m = metrics(stats)
    broken = [F.when(v > F.col(f"{k}_max"), F.lit(k)) for k, v in m.items()]
    broken.append(F.when(m["word_length"] < F.col("word_length_min"), F.lit("word_length_low")))
    broken = F.filter(F.array(*broken), lambda x: x.isNotNull())
    failed = base_failed()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"),
                      F.when(~failed, F.array_join(broken, ",")).otherwise("base").alias("reasons"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op8_quality_rules": op8_quality_rules}
