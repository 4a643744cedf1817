import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shotgrid.llm import efano, rules
from shotgrid.llm import text as T
from tests.llm.helpers import odd_rows, words


@pytest.fixture(params=[1 << 20, 200])
def chunk(request, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", request.param)


def texts():
    return [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 10_000]


@pytest.mark.parametrize("fold", [True, False])
def test_word_hashes_are_one_to_one(chunk, fold):
    seen = {}
    arr = pa.array(texts() + ["Aa aA\x0bAA", "a", "A"])
    for lo, hi, hashes, counts in T.tokenize(arr, fold):
        want = [words(t, fold) for t in arr[lo:hi].to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        for w, h in zip((x for ws in want for x in ws), hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_match_tuples():
    arr = pa.array(["a b c d e f g", "a b c", "", None, "a b c d e", "b c d e f"])
    for lo, hi, hashes, counts in T.tokenize(arr):
        grams, doc = T.windows(hashes, counts, 5)
        assert np.bincount(doc, minlength=6).tolist() == [3, 1, 0, 0, 1, 1]
        assert grams[0] == grams[4] and grams[1] == grams[5] and grams[3] not in (grams[0], grams[1])


def brute_stats(t):
    ws = words(t, False)
    runs = collections.Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = {i + k for i in range(len(ws) - 7) if runs[tuple(ws[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line, False):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_rule_statistics_against_brute_force(chunk):
    rng = random.Random(3)
    extra = ["\n".join(rng.choice(["a b c d", "x y", "", "  ", "# | <b> 100%"]) for _ in range(40)) for _ in range(20)]
    arr = pa.array(texts() + extra)
    raw, offsets = T.buffers(arr)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for lo, hi in T.ranges(offsets):
        part = raw[offsets[lo]:offsets[hi]]
        got = rules.long_stats(part) if len(part) > T.CHUNK else rules.part_stats(part, offsets[lo:hi + 1] - offsets[lo])
        for i in range(lo, hi):
            assert tuple(int(got[k][i - lo]) for k in names) == brute_stats(arr[i].as_py())


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1, 1 << 64), (500, 600), (3000, 10**12), (3000, 1 << 64)])
def test_elias_fano_round_trip(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False) if universe < 1 << 64
                  else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
    if n > 1000:
        x = np.unique(np.concatenate([x, np.arange(universe // 2, universe // 2 + 900, dtype=np.uint64)]))   # a dense run
    efano.save(str(tmp_path / "f"), efano.build(x, universe))
    a = efano.load(str(tmp_path / "f"))
    q = np.unique(np.concatenate([x, rng.integers(0, min(universe, (1 << 64) - 1), 500, dtype=np.uint64)]))
    want = np.searchsorted(x, q)
    assert (efano.successor(a, q) == want).all()
    assert (efano.find(a, q) == np.where(np.isin(q, x), want, -1)).all()
    assert (efano.value(a, np.arange(len(x))) == x).all()
