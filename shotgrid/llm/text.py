"""Vectorised text helpers for code that runs inside Arrow batches.

``tokenize`` turns a batch of texts into one 64-bit hash per word without a Python loop over
words: the batch's UTF-8 bytes are one numpy array, word borders come from a byte mask, and a
word's hash is a difference of prefix sums of ``r[byte] * P**i`` (a polynomial hash modulo
2**64 over random byte values, then mixed).  Two different words share a hash with
probability about 2**-64, so counts and set sizes by hash are exact for all practical sizes.

Memory is bounded: texts are handled in pieces of ``CHUNK`` bytes; a longer text is cut at
white space, and only its 8-byte word hashes are kept together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
_RANDOM = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _RANDOM.copy()
_LOWER[65:91] = _RANDOM[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK) + 1
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def word_spans(raw: np.ndarray, cuts: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (bytes) of the words of ``raw``; no word crosses a cut.  ``white`` says
    for each byte if it separates words."""
    w = ~white[raw]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    p, q = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _RANDOM)[raw] * p[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * q[start])


def pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end at white space (or are one long word)."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not WHITE[raw[end - 1]]:
            stop = np.flatnonzero(WHITE[raw[at:end]])
            if len(stop):
                end = at + int(stop[-1]) + 1
            else:
                end = min(len(raw), end + CHUNK)
        yield raw[at:end]
        at = end


def ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs lo..hi-1 of texts that have at most CHUNK bytes together; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1))
        yield lo, hi
        lo = hi


def tokenize(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (lo, hi, hashes, counts): the word hashes of the texts lo..hi-1, text after text,
    and the number of words of each.  Words are ``[^\\x20\\x09-\\x0D]+``; with ``lower``, A-Z
    count as a-z.  Empty and null texts have no words."""
    raw, offsets = buffers(texts)
    for lo, hi in ranges(offsets):
        part, cuts = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        if len(part) > CHUNK:
            none = np.zeros(0, np.int64)
            hashes = np.concatenate([span_hash(x, *word_spans(x, none), lower) for x in pieces(part)])
            yield lo, hi, hashes, np.array([len(hashes)])
        else:
            start, end = word_spans(part, cuts)
            yield lo, hi, span_hash(part, start, end, lower), np.diff(np.searchsorted(start, cuts))


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words that lies within one text, and its text's number.
    A text with 1 to k-1 words has one run: all its words."""
    doc = np.repeat(np.arange(len(counts)), counts)
    out, of = [], []
    if len(hashes) >= k:
        mul = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
        h = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            h += hashes[i:len(hashes) - k + 1 + i] * mul[i]
        same = doc[:len(doc) - k + 1] == doc[k - 1:]
        out.append(mix(h[same]))
        of.append(doc[:len(doc) - k + 1][same])
    ends = np.cumsum(counts)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        whole = hashes[ends[d] - counts[d]:ends[d]]
        h = np.uint64(len(whole))
        with np.errstate(over="ignore"):
            for x in whole:
                h = h * np.uint64(0xD6E8FEB86659FD93) + x
        out.append(mix(np.array([h], np.uint64)))
        of.append(np.array([d]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(of)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]
