"""Operator 11 against all pairs, and the sketch against its laws."""

import collections
import math

import numpy as np
import pytest

from shotgrid.llm import setsketch as S
from tests.conftest import SF01
from tests.llm.helpers import odd_rows, sentence, shingles, table


def brute(rows, percent=85):
    """(doc_id, set size, component, kept) of each row, by all pairs that share a shingle."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in index[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            index[g].append(i)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            groups[find(i)].append(rows[i][0])
    out = []
    for i, (r, s) in enumerate(zip(rows, sets, strict=True)):
        component = min(groups[find(i)], default=None) if s else r[0]
        out.append((r[0], len(s), component, r[0] == component))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def regs_of(*sets):
    members = [np.sort(np.array(list(s), np.uint64)) for s in sets]
    return S.registers(np.concatenate(members), np.concatenate([[0], np.cumsum([len(m) for m in members])]))


def random_set(rng, n):
    return set(rng.integers(0, 2 ** 63, n).tolist())


def test_registers_merge_and_count():
    rng = np.random.default_rng(1)
    for n in (1, 10, 1000, 50_000):
        a, b = random_set(rng, n), random_set(rng, 3 * n)
        ra, rb, both = regs_of(a, b, a | b)
        assert (S.merge(ra, rb) == both).all()
        for r, s in ((ra, a), (rb, b), (both, a | b)):
            assert abs(float(S.cardinality(r)) / len(s) - 1) < 5 / math.sqrt(S.REGISTERS)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.85, 1.0])
def test_likelihood_estimates_similarity(share):
    rng, errors = np.random.default_rng(2), []
    for _ in range(30):
        n = 400
        common = random_set(rng, int(2 * n * share / (1 + share)))
        a, b = common | random_set(rng, n - len(common)), common | random_set(rng, n - len(common))
        x, y = regs_of(a, b)
        j, _ = S.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([len(a)]), np.array([len(b)]))
        errors.append(j[0] - len(a & b) / len(a | b))
    spread = math.sqrt(share * (1 - share) / S.REGISTERS) + 0.003
    assert abs(np.mean(errors)) < 5 * spread / math.sqrt(30) and np.abs(errors).max() < 6 * spread


def test_pairs_at_the_threshold_pass_and_far_ones_do_not():
    rng = np.random.default_rng(3)
    for share, least, most in ((0.85, 200, 200), (0.95, 200, 200), (0.4, 0, 0)):
        passed = 0
        for _ in range(200):
            common = random_set(rng, int(200 * share))
            rest = [random_set(rng, 1) for _ in range(200 - len(common))]
            a, b = set(common), set(common)
            for k, r in enumerate(rest):
                (a if k % 2 else b).update(r)
            x, y = regs_of(a, b)
            passed += int(S.possible(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0])
        assert least <= passed <= most


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(S.near_duplicates(docs.repartition(6))) == brute(rows)


def variants(count, edits, n=120):
    """A base text and copies of it with some words replaced, each in another place."""
    base = sentence(77, n).split()
    out = []
    for i in range(count):
        w = list(base)
        for e in range(edits[i % len(edits)]):
            w[(i * 37 + e * 61) % n] = f"new{i}_{e}"
        out.append(" ".join(w))
    return out


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """A third of the rows are near copies of each other, some pairs above the threshold and some below; small blocks and
    parts force every split."""
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(S, "TASK_BANDS", 700)
    texts = variants(120, [0, 1, 2, 3, 4]) + [sentence(1000 + i) for i in range(150)] + [sentence(5)] * 40
    rows = [(i * 3 + 1, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = result(S.near_duplicates(table(spark, rows).repartition(9)))
    want = brute([r[:2] for r in rows])
    assert got == want
    assert len({r[2] for r in want}) > 150


def test_chain_is_one_component(spark):
    """Each text is linked with the next only; the ends share little."""
    w = [f"t{i}" for i in range(400)]
    rows = [(100 - i, " ".join(w[4 * i:4 * i + 120]), "en", "a", 1) for i in range(30)]
    got = result(S.near_duplicates(table(spark, rows)))
    assert got == brute([r[:2] for r in rows])
    assert {r[2] for r in got} == {71}


def test_odd_rows(spark):
    rows = odd_rows()
    assert result(S.near_duplicates(table(spark, rows, extra=True))) == brute([r[:2] for r in rows])


def test_empty_table(spark):
    assert S.near_duplicates(table(spark, [])).collect() == []
    assert result(S.near_duplicates(table(spark, [(1, None, None, None, None), (2, "", None, None, 0)]))) == [(1, 0, 1, True), (2, 0, 2, True)]
