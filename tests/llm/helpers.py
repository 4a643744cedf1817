"""Brute-force versions and odd tables shared by the tests of this folder."""

from __future__ import annotations

import collections
import re

from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that clash with names the operators use inside
CLASHING = "row long, n long, class long, size long, shard int, y int, hits int, spans string, score double"


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t: str | None, fold: bool = True) -> list[str]:
    return WORD.findall(lower(t or "") if fold else t or "")


def sentence(seed: int, n: int = 60) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"tok{i % 5003}" for i in range(220_000))            # above the piece size of 1 MB
    rows = [(1, sentence(1), "en", "a", 10), (2, sentence(1), "en", "a", 10), (3, None, "en", "a", None), (4, "", None, None, 0),
            (5, " \n\t ", "fr", "b", 4), (6, "one two", "fr", None, 7), (7, "one two", "fr", "b", 7), (None, "three four five", "de", "b", 15),
            (None, None, None, None, None), (8, long, "en", "c", len(long)), (9, "É à ü 漢字 😀 " * 30, "fr", "c", 60),
            (10, sentence(1) + " extra", "en", "a", 11), (11, "a\n\na\nb\na", "en", "a", 8), (12, "x" * 5000, "en", "d", 5000)]
    return rows + [rows[0], rows[5]]


def table(spark, rows: list[tuple], extra: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "source")
    if extra:
        for c in CLASHING.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(1 as {kind}) as {name}")
    return df


def shingles(t: str | None) -> frozenset:
    w = words(t)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccard_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set size, smallest linked doc_id) of each row, by all pairs that share a shingle."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in index[g]).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            index[g].append(i)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            groups[find(i)].append(rows[i][0])
    return [(r[0], len(s), min(groups[find(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]
