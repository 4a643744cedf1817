"""Operator 7: language identification by multilingual mixture inference.

Training counts hashed byte trigrams per language over all training rows (partial counts per
task, one sum in Spark).  A document is then a mixture of languages: expectation-maximisation
finds the proportions under which its trigrams are most likely, and languages are taken away
one by one while the likelihood, less half the log of the trigram count for every language,
does not fall.  The prediction is the largest share of the set that remains.

The model is a table of 2**16 probabilities per language, so what is collected and broadcast
is bounded by the number of languages, not by the corpus.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text
when nothing was learned; equal shares go to the language first in byte order; rows with a
null language are not learned from but are predicted; a null id counts as the text '' in the
split; repeated rows are counted and predicted each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm import text as T
from shotgrid.llm.common import crc_mod, documents, freeing, over_batches

BITS = 16
BINS = 1 << BITS
FOLDS, HELD_OUT = 4, 2
UNIFORM = 0.01                 # share of the uniform distribution in every language's trigrams
STEPS = 20
LEAST_SHARE = 0.02
OVERLAP = 3.0                  # neighbouring trigrams share bytes: so many count as one observation

# letters as they are in lower case, bytes of other scripts as they are, all else a space
_MAP = np.full(256, 0x20, np.uint32)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at each byte but the last two."""
    x = _MAP[raw]
    if len(x) < 3:
        return np.zeros(0, np.uint16)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)


def _bins(raw: np.ndarray) -> np.ndarray:
    """Trigrams of one text (padded where it has fewer than three bytes)."""
    return trigrams(raw if len(raw) > 2 else np.concatenate([[32], raw, [32, 32]]).astype(np.uint8))


def _counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of one text, and how often each occurs."""
    if len(raw) > T.CHUNK:
        total = sum(np.bincount(_bins(raw[at:at + T.CHUNK + 2]), minlength=BINS)
                    for at in range(0, len(raw) - 2, T.CHUNK))
        bins = np.flatnonzero(total)
        return bins, total[bins].astype(float)
    b = np.sort(_bins(raw), kind="stable")           # radix sort of 16-bit values
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return b[first], np.diff(np.append(first, len(b))).astype(float)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """(lang, bin, n) over rows (text, lang)."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = T.buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                if lang not in total:
                    total[lang] = np.zeros(BINS, np.int64)
                part = raw[offsets[i]:offsets[i + 1]]
                for at in range(0, max(1, len(part) - 2), T.CHUNK):
                    piece = _bins(part[at:at + T.CHUNK + 2])
                    if len(piece) > BINS // 8:
                        total[lang] += np.bincount(piece, minlength=BINS)
                    else:
                        np.add.at(total[lang], piece, 1)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], names=["lang", "bin", "n"])

    return rows.mapInArrow(freeing(run), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and P(bin | language) as a BINS x languages table."""
    got = count_trigrams(rows).toArrow()             # at most BINS rows per language
    lang = np.array(got.column("lang").to_pylist(), dtype=object)
    names = sorted(set(lang))
    table = np.zeros((BINS, len(names)))
    bins, n = got.column("bin").to_numpy(), got.column("n").to_numpy()
    for j, name in enumerate(names):
        here = lang == name
        table[bins[here], j] = n[here] / max(1, n[here].sum())
    return names, (1 - UNIFORM) * table + UNIFORM / BINS


def _em(p: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` that make the counts ``n`` most likely; log likelihood."""
    total = n.sum()
    for _ in range(STEPS):
        new = w * (p.T @ (n / (p @ w))) / total
        done = np.abs(new - w).max() < 1e-3
        w = new
        if done:
            break
    return w, float(n @ np.log(p @ w))


def mixture(p: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """Shares of the languages that remain under the penalised likelihood."""
    k = p.shape[1]
    if k == 1:
        return {0: 1.0}
    w, _ = _em(p, n, np.full(k, 1 / k))
    keep = np.flatnonzero(w >= min(LEAST_SHARE, w.max()))
    price = 0.5 * np.log(max(2.0, n.sum() / OVERLAP))
    w, like = _em(p[:, keep], n, w[keep] / w[keep].sum()) if len(keep) > 1 else (np.ones(1), 0.0)
    while len(keep) > 1:
        rest = np.delete(np.arange(len(keep)), np.argmin(w))
        w2, like2 = _em(p[:, keep[rest]], n, w[rest] / w[rest].sum()) if len(rest) > 1 else \
            (np.ones(1), float(n @ np.log(p[:, keep[rest[0]]])))
        if (like - like2) / OVERLAP > price:
            break
        keep, w, like = keep[rest], w2, like2
    return dict(zip(keep.tolist(), w.tolist(), strict=True))


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs (the set with its shares) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch):
        p, texts = model.value, batch.column("text")
        raw, offsets = T.buffers(texts)
        pred, score, langs = [], [], []
        for i, text in enumerate(texts):
            text = text.as_py()
            if not names or not text or not any(map(str.isalpha, text)):
                pred.append("und"), score.append(0.0), langs.append([])
                continue
            bins, n = _counts(raw[offsets[i]:offsets[i + 1]])
            shares = mixture(p[bins], n)
            best = max(shares, key=lambda j: (shares[j], -j))
            pred.append(names[best]), score.append(min(1.0, shares[best]))
            langs.append([f"{names[j]}:{s:.3f}" for j, s in sorted(shares.items(), key=lambda x: -x[1])])
        yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
               "lang_pred": pred, "score": score, "langs": langs}

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return over_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)) \
        .select("text", "lang")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, *fit(training_rows(docs)))


QUERIES = {"op7_language_mixture": op7_language_mixture}
