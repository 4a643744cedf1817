"""Elias-Fano sequences as numpy arrays, with vectorised search, and files of arrays that tasks
map into memory.

A strictly rising sequence of n values below u keeps the lower ``width = log2(u / n)`` bits of
each value packed, and the upper parts in unary: value i sets bit ``(x >> width) + i``.  A
directory holds the zeros before every word of 64 bits.  Searching a value selects the run of
its upper part and then searches the lower bits inside the run."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

U = np.uint64


def _scatter_or(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """words[at] |= bits for a rising ``at``."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] |= np.bitwise_or.reduceat(bits, first)


def build(x: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the strictly rising uint64 values ``x`` (all below ``universe``)."""
    n = len(x)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    i = np.arange(n, dtype=U)
    upper = (x >> U(width)) + i
    high = np.zeros(((int(universe) >> width) + n) // 64 + 2, U)
    _scatter_or(high, (upper >> U(6)).astype(np.int64), U(1) << (upper & U(63)))
    zeros = np.zeros(len(high) + 1, np.int64)
    np.cumsum(64 - np.bitwise_count(high).astype(np.int64), out=zeros[1:])
    low = np.zeros(n * width // 64 + 2, U)
    if width:
        v, bit = x & U((1 << width) - 1), i * U(width)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        _scatter_or(low, word, v << shift)
        over = shift + U(width) > U(64)
        _scatter_or(low, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return {"ef": np.array([n, width], np.int64), "high": high, "zeros": zeros[:-1].astype(np.uint32 if n < 2**31 else np.int64),
            "low": low}


def _select0(a: dict, k: np.ndarray) -> np.ndarray:
    """Bit position of the k-th zero (from 0) of the unary part; ``k`` rises or is in any order."""
    word = np.searchsorted(a["zeros"], k.astype(a["zeros"].dtype), "right") - 1
    v = ~a["high"][word]
    rest = k - a["zeros"][word].astype(np.int64)
    at = word.astype(np.int64) * 64
    for w in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(v & U((1 << w) - 1)).astype(np.int64)
        go = rest >= count
        rest -= np.where(go, count, 0)
        v = np.where(go, v >> U(w), v)
        at += np.where(go, w, 0)
    return at


def _low(a: dict, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U)
    bit = i.astype(U) * U(width)
    word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
    v = a["low"][word] >> shift
    over = np.flatnonzero(shift + U(width) > U(64))
    if len(over):
        v[over] |= a["low"][word[over] + 1] << (U(64) - shift[over])
    return v & U((1 << width) - 1)


def successor(a: dict, x: np.ndarray) -> np.ndarray:
    """Index of the first value >= x, for uint64 ``x`` below the universe."""
    n, width = int(a["ef"][0]), int(a["ef"][1])
    if not n:
        return np.zeros(len(x), np.int64)
    h = (x >> U(width)).astype(np.int64)
    # the run of upper part h lies between zero h - 1 and zero h
    end = _select0(a, h) - h
    start = np.zeros(len(x), np.int64)
    later = h > 0
    start[later] = _select0(a, h[later] - 1) - (h[later] - 1)
    target = x & U((1 << width) - 1) if width else np.zeros(len(x), U)
    todo = np.flatnonzero(start < end)
    lo, hi, t = start[todo], end[todo], target[todo]
    while len(todo):
        mid = (lo + hi) >> 1
        less = _low(a, mid, width) < t
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        done = lo >= hi
        start[todo[done]] = lo[done]
        more = ~done
        todo, lo, hi, t = todo[more], lo[more], hi[more], t[more]
    return start


def value(a: dict, i: np.ndarray, universe_words: np.ndarray | None = None) -> np.ndarray:
    """The values at the indices ``i`` (select of ones by the word directory)."""
    width = int(a["ef"][1])
    ones = np.arange(len(a["high"]), dtype=np.int64) * 64 - a["zeros"].astype(np.int64)
    word = np.searchsorted(ones, i, "right") - 1
    v, rest, at = a["high"][word], i - ones[word], word.astype(np.int64) * 64
    for w in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(v & U((1 << w) - 1)).astype(np.int64)
        go = rest >= count
        rest = rest - np.where(go, count, 0)
        v = np.where(go, v >> U(w), v)
        at = at + np.where(go, w, 0)
    return ((at - i).astype(U) << U(width)) | _low(a, i, width)


def find(a: dict, x: np.ndarray) -> np.ndarray:
    """Index of each x, or -1."""
    n, width = int(a["ef"][0]), int(a["ef"][1])
    i = successor(a, x)
    ok = np.flatnonzero(i < n)
    out = np.full(len(x), -1, np.int64)
    if len(ok):
        # equal lower bits inside the run of equal upper bits: the bit of value i must be set in that run
        pos = (x[ok] >> U(width)).astype(np.int64) + i[ok]
        same = (a["high"][pos >> 6] >> (pos & 63).astype(U)) & U(1) == U(1)
        if width:
            same &= _low(a, i[ok], width) == (x[ok] & U((1 << width) - 1))
        out[ok[same]] = i[ok[same]]
    return out


# ------------------------------------------------------------------------------- files
def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays, complete or absent: a rerun task replaces it by the same bytes."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += (a.nbytes + 63) // 64 * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    os.replace(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    m = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(m[:8].tobytes(), "little")
    head = json.loads(m[8:8 + n].tobytes())
    return {k: m[8 + n + at:8 + n + at + size * np.dtype(kind).itemsize].view(kind) if size else np.zeros(0, kind)
            for k, (kind, size, at) in head.items()}
