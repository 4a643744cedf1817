"""Operator 13: cross-tokenizer alignment by sparse products of token-byte incidence matrices.

For a text, tokenizer A's tokens and tokenizer B's tokens cover the same bytes.  A and B are their
incidence matrices (tokens x bytes) in compressed sparse rows, built by hand here:

* the product A.Bt by Gustavson's rows (every entry (i, k) of A brings row k of Bt, entries of
  equal place add up) has the bytes that two tokens share: the overlap links;
* tokens i and i + 1 of A lie in different groups where the last token of B that overlaps i ends
  before the first that overlaps i + 1, that is where both tokenizers end a token;
* the product of the group incidence matrices (A tokens x groups, groups x B tokens) has a link for
  every pair of tokens that share a group.

Texts are encoded and multiplied in one map-only pass over Arrow batches: many short texts are one
block-diagonal product, and a large product is made in slices of rows, so memory is bounded by a
slice and by the largest text.  The pass writes each document's digest and its distinct linked id
pairs.  How many documents hold an id pair is counted per task and summed in Spark.  A second pass
over the written rows looks the counts up: those of the pairs that most documents hold (at most
``HEAD`` of them: the broadcast's bound) come from a broadcast table, and the links of all others
meet their counts in a join; no pair of these is in many documents, so that join has no hot key.

Defined cases: null and empty texts, and texts whose joined tokens differ from space + text (B's
normaliser may change them), have no tokens: zeros and the digest ''; strings of special tokens
inside texts are plain text; rows that repeat a document count as documents of their own; a null
doc_id is kept; very long texts are encoded whole and multiplied in slices; an empty table gives
no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.llm.common import documents, freeing, over_batches, pack, stored, unpack
from shotgrid.llm.packing import encoder

PIECE = 1 << 18                 # bytes of texts that are multiplied together
SLICE = 1 << 20                 # entries of a product made at once
TASK_PAIRS = 4_000_000          # id pairs that a counting task keeps before it merges them
HEAD = 1 << 19                  # id pairs whose counts are broadcast at most (12 MB)
ROW_BITS = 40


# ------------------------------------------------------------------------------- sparse rows
class Rows(NamedTuple):
    """A sparse matrix by rows: row i has the columns ``columns[at[i]:at[i + 1]]``, with ``values``."""
    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def incidence(owner: np.ndarray, height: int, width: int) -> Rows:
    """Rows x columns, where column k belongs to row ``owner[k]`` (not falling)."""
    return Rows(np.searchsorted(owner, np.arange(height + 1)), np.arange(len(owner)), np.ones(len(owner), np.int64), width)


def transposed_incidence(owner: np.ndarray, width: int) -> Rows:
    """Row k has its only entry in column ``owner[k]``."""
    return Rows(np.arange(len(owner) + 1), owner, np.ones(len(owner), np.int64), width)


def product(a: Rows, b: Rows, slice_entries: int = SLICE) -> Iterator[tuple[int, Rows]]:
    """Gustavson's product: (first row, some rows of a.b) slice by slice; a slice makes about
    ``slice_entries`` entries before equal places are added up (a single row may make more)."""
    brings = np.diff(b.at)[a.columns]                        # entries that each entry of a brings
    made = np.concatenate([[0], np.cumsum(brings)])[a.at]    # entries made before each row of a
    lo, height = 0, len(a.at) - 1
    while lo < height:
        hi = min(height, max(lo + 1, int(np.searchsorted(made, made[lo] + slice_entries, "right")) - 1))
        here = slice(a.at[lo], a.at[hi])
        n = brings[here]
        at = spread(b.at[a.columns[here]], n)
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(a.at[lo:hi + 1])), n)
        place = row * b.width + b.columns[at]
        value = np.repeat(a.values[here], n) * b.values[at]
        if len(place) and (np.diff(place) < 0).any():
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        value = np.add.reduceat(value, first) if len(first) else value
        place = place[first]
        yield lo, Rows(np.searchsorted(place, np.arange(hi - lo + 1) * b.width), place % b.width, value, b.width)
        lo = hi


def joined(parts: Iterator[tuple[int, Rows]], width: int) -> Rows:
    at, columns, values, known = [np.zeros(1, np.int64)], [], [], 0
    for _, r in parts:
        at.append(r.at[1:] + known)
        columns.append(r.columns)
        values.append(r.values)
        known += len(r.columns)
    none = [np.zeros(0, np.int64)]
    return Rows(np.concatenate(at), np.concatenate(columns or none), np.concatenate(values or none), width)


def overlap_links(a_bytes: np.ndarray, b_bytes: np.ndarray) -> Rows:
    """A tokens x B tokens: bytes that they share.  Both cover the same bytes; the arguments are
    the tokens' lengths in bytes, all above 0."""
    a = incidence(np.repeat(np.arange(len(a_bytes)), a_bytes), len(a_bytes), int(a_bytes.sum()))
    bt = transposed_incidence(np.repeat(np.arange(len(b_bytes)), b_bytes), len(b_bytes))
    return joined(product(a, bt), len(b_bytes))


def groups(overlaps: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token), both rising from 0."""
    first, last = overlaps.columns[overlaps.at[:-1]], overlaps.columns[overlaps.at[1:] - 1]
    cut = first[1:] > last[:-1]
    of_a = np.concatenate([[0], np.cumsum(cut)]) if len(first) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], first[1:][cut]]) if len(first) else np.zeros(0, np.int64)
    return of_a, np.searchsorted(starts, np.arange(overlaps.width), "right") - 1


def group_links(of_a: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[int, Rows]]:
    """Slices of A tokens x B tokens: 1 where the tokens share a group."""
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    return product(transposed_incidence(of_a, n), incidence(of_b, n, len(of_b)))


# ------------------------------------------------------------------------------- tokenizers
def default_tokenizers() -> tuple[str, str, str]:
    """(A's file, the same vocabulary as ranks, B's file)."""
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


class Vocabulary:
    """The bytes of every token of a tokenizer, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[spread(self.start[ids], self.length[ids])]


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    """A piece's bytes: <0xHH> is the byte HH, U+2581 is a space."""
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


_LOADED: dict[tuple, tuple] = {}


def tokenizers(files: tuple[str, str, str]):
    """(encode A, A's vocabulary, encode B, B's vocabulary); one per Python worker."""
    if files not in _LOADED:
        import json

        import sentencepiece

        with open(files[0], encoding="utf-8") as f:
            entries = json.load(f)
        # byte-level spelling: printable Latin-1 characters stand for themselves, all other bytes for U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = dict(entries["model"]["vocab"]) | {t["content"]: t["id"] for t in entries.get("added_tokens", [])}
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        b = sentencepiece.SentencePieceProcessor(model_file=files[2])
        pieces = [piece_bytes(b.id_to_piece(i), b.is_byte(i)) for i in range(b.vocab_size())]
        _LOADED[files] = encoder(files[:2]), Vocabulary(tokens), lambda text: b.encode(text, num_threads=1), Vocabulary(pieces)
    return _LOADED[files]


# ------------------------------------------------------------------------------- documents
NUMBERS = 1 << 16                 # ids are below this
_DECIMAL: list[Vocabulary] = []


def _written(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of ``a1,a2|b1;a3|b2,b3;``, where each group starts in them and their end); group g has the
    A tokens a_at[g] to a_at[g + 1] - 1 and the B tokens b_at[g] to b_at[g + 1] - 1."""
    if not _DECIMAL:
        _DECIMAL.append(Vocabulary([b"%d," % i for i in range(NUMBERS)]))
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.uint8)
    place_a, place_b = np.arange(len(ids_a)) + b_at[of_a], np.arange(len(ids_b)) + a_at[of_b + 1]
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark[place_a[a_at[1:] - 1]], mark[place_b[b_at[1:] - 1]] = ord("|"), ord(";")
    raw = _DECIMAL[0].spell(ids)
    ends = np.cumsum(_DECIMAL[0].length[ids])
    last = np.flatnonzero(mark)
    raw[ends[last] - 1] = mark[last]
    return raw, np.concatenate([[0], ends[place_b[b_at[1:] - 1]]])


def _aligned(texts: list[tuple[int, str]], files) -> Iterator[tuple]:
    """(place, n_a, n_b, n_groups, n_links, digest, id pairs, links of each) of texts that are not empty."""
    encode_a, vocab_a, encode_b, vocab_b = tokenizers(files)
    rows, a, b = [], [], []
    for place, text in texts:
        raw = np.frombuffer(b" " + text.encode(), np.uint8)
        x, y = encode_a(" " + text).astype(np.int64), np.array(encode_b(text), np.int64)
        if np.array_equal(vocab_a.spell(x), raw) and np.array_equal(vocab_b.spell(y), raw) \
                and vocab_a.length[x].all() and vocab_b.length[y].all():
            rows.append(place)
            a.append(x)
            b.append(y)
    if not rows:
        return
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    # one block-diagonal product: the texts' bytes follow each other, and all texts end a token in both
    of_a, of_b = groups(overlap_links(vocab_a.length[ids_a], vocab_b.length[ids_b]))
    text_a = np.concatenate([[0], np.cumsum([len(x) for x in a])])
    text_b = np.concatenate([[0], np.cumsum([len(x) for x in b])])
    group_at = np.append(of_a[text_a[:-1]], of_a[-1] + 1)
    owner = np.repeat(np.arange(len(rows)), np.diff(text_a))
    found, links = [], np.zeros(len(rows), np.int64)
    for lo, part in group_links(of_a, of_b):
        n = np.diff(part.at)
        token = np.repeat(np.arange(lo, lo + len(n)), n)
        links += np.bincount(owner[token], minlength=len(rows))
        key = (owner[token] << 32) | (ids_a[token] << 16) | ids_b[part.columns]
        found.append(np.unique(key, return_counts=True))
    key, count = found[0] if len(found) == 1 else merged([f[0] for f in found], [f[1] for f in found])
    key_at = np.searchsorted(key, np.arange(len(rows) + 1) << 32)
    a_at, b_at = np.searchsorted(of_a, np.arange(group_at[-1] + 1)), np.searchsorted(of_b, np.arange(group_at[-1] + 1))
    raw, starts = _written(ids_a, ids_b, of_a, of_b, a_at, b_at)
    for i, place in enumerate(rows):
        digest = hashlib.sha256(raw[starts[group_at[i]]:starts[group_at[i + 1]] - 1]).hexdigest()
        k = slice(key_at[i], key_at[i + 1])
        yield (place, len(a[i]), len(b[i]), int(group_at[i + 1] - group_at[i]), int(links[i]), digest,
               (key[k] & 0xFFFFFFFF).astype(np.uint32), count[k].astype(np.uint32))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def alignments(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, row (unique in this result), n_a, n_b, n_groups, n_links, groups_sha256, and the linked
    id pairs (A id << 16 | B id) with their links, packed."""
    files = files or default_tokenizers()
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        number = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            some, size, out = [], 0, {}

            def settle():
                for place, n_a, n_b, n_groups, n_links, digest, pairs, links in _aligned(some, files):
                    out[place] = n_a, n_b, n_groups, n_links, digest, pack(pairs), pack(links)

            for place in range(len(ids)):
                text = texts[place].as_py()
                if text:
                    some.append((place, text))
                    size += len(text)
                    if size >= PIECE:
                        settle()
                        some, size = [], 0
            settle()
            rows = [(i, number + k, *out.get(k, (0, 0, 0, 0, "", b"", b""))) for k, i in enumerate(ids)]
            number += len(rows)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        freeing(run), "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, k (how many documents hold the id pair linked), best (k is a's highest)."""
    def run(batches):
        keys, counts, size = [], [], 0

        def out():
            key, count = merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array((key >> 16).astype(np.int32)), pa.array((key & 0xFFFF).astype(np.int32)),
                                               pa.array(count)], names=["a", "b", "k"])

        for batch in batches:
            here = [unpack(p, np.uint32) for p in batch.column(0).to_pylist() if p]
            if here:
                key, count = np.unique(np.concatenate(here), return_counts=True)
                keys.append(key)
                counts.append(count)
                size += len(key)
            if size >= TASK_PAIRS:
                key, count = merged(keys, counts)
                keys, counts, size = [key], [count], len(key)
                if size >= TASK_PAIRS // 2:
                    yield out()
                    keys, counts, size = [], [], 0
        if keys:
            yield out()

    counted = aligned.select("pairs").mapInArrow(freeing(run), "a int, b int, k long")
    counted = stored(counted.groupBy("a", "b").agg(F.sum("k").alias("k")), "pair_counts")
    # one row per A id of the vocabulary
    highest = counted.groupBy("a").agg(F.max("k").alias("highest"))
    return stored(counted.join(F.broadcast(highest), "a").select("a", "b", "k", (F.col("k") == F.col("highest")).alias("best")), "pair_best")


def _least_count(counts: DataFrame, head: int) -> int:
    """The smallest k such that at most ``head`` pairs have k or more."""
    classes = counts.select(F.floor(F.log2("k") * 16).cast("int").alias("c"), "k").groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))       # at most 16 classes per doubling
    least, known = None, 0
    for r in classes.orderBy(F.desc("c")).collect():
        known += r["n"]
        if known > head:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def align(docs: DataFrame, files: tuple[str, str, str] | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    aligned = stored(alignments(docs, files), "alignments")
    counts = pair_counts(aligned)
    least = _least_count(counts, head)
    table = counts.where(F.col("k") >= least).select(
        (F.shiftleft(F.col("a").cast("long"), 16) + F.col("b")).alias("pair"), "k", "best").orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy().astype(np.uint32), table["k"].to_numpy(), table["best"].to_numpy().astype(np.int64)))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        pair, k, best = shared.value
        out = {"n_best": [], "count_sum": [], "rest": [], "rest_links": []}
        for p, c in zip(batch.column("pairs").to_pylist(), batch.column("links").to_pylist(), strict=True):
            key, links = (unpack(p, np.uint32), unpack(c, np.uint32).astype(np.int64)) if p else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            out["n_best"].append(int((links[known] * best[at[known]]).sum()))
            out["count_sum"].append(int((links[known] * k[at[known]]).sum()))
            out["rest"].append(key[~known].astype(np.int64))
            out["rest_links"].append(links[~known])
        yield {c: batch.column(c) for c in ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | out

    digest = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    columns = [c.split()[0] for c in digest.split(", ")]
    rows = over_batches(aligned, run, digest + ", row long, rest array<long>, rest_links array<long>")
    if counts.where(F.col("k") < least).isEmpty():               # all pairs are in the broadcast table
        return rows.select(*columns)
    rows = stored(rows, "looked_up")
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "rest_links")).alias("x")).select(
        "row", F.shiftright("x.rest", 16).cast("int").alias("a"), F.col("x.rest").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("b"),
        F.col("x.rest_links").alias("links"))
    rest = rest.join(counts.where(F.col("k") < least), ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("k")).alias("more_sum"))
    out = rows.join(rest, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(*columns)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


QUERIES = {"op13_token_alignment": op13_token_alignment}
