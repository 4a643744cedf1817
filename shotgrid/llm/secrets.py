r"""Operator 9: secret scans with inferred credential grammars.

1. Base rules find labelled credentials (fixed patterns below, leftmost, not overlapping).
2. Grammar inference: from a bounded sample of distinct credentials of each kind of any length
   (the first by hash, up to ``SAMPLE`` strings and ``TREE`` characters) a prefix tree over character classes is built and
   statistically compatible states are merged (ALERGIA with the Hoeffding test), red states
   first, which gives one probabilistic automaton per kind.  A character-bigram model of all
   other candidate strings (as often as they occur) is the background.
3. Every candidate string of every whole text is scored: the automaton's log likelihood, with
   the characters of a class equally likely, less the background's.  A candidate that doesn't
   lie inside a base span (it may contain some) is added (kind ``grammar``) when that ratio is at least ``MARGIN`` and, per
   character, at least the ``QUANTILE`` of the kind's own labelled credentials.

What is learned is bounded by ``SAMPLE``, ``TREE`` and the number of bigrams whatever the corpus; scanning is map-only.

Spans are whole matches in code points, end exclusive.  Defined cases: a null or empty text has
no spans; without labelled credentials only the base rules work; a credential above ``TREE``
characters is found but not learned from; spans that start together are in the order of
``KINDS``; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrid.llm.common import documents, freeing, over_batches

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")           # a maximal run either has 16 characters or fails
KINDS = ("assign", "access", "hex", "grammar")
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SAMPLE, TREE = 2000, 256_000                 # strings per kind, and their characters together (the states of its prefix tree)
CHUNK = 1_000_000                           # characters counted at a time for the background
ALPHA = 0.05
MARGIN, QUANTILE = 15.0, 0.01
FLOOR = math.log(1e-4)
CAPITALS = math.log(0.01)

_CLASS = {ord(c): "d" for c in "0123456789"} | {ord(c): "h" for c in "abcdef"} | {ord(c): "H" for c in "ABCDEF"} \
    | {ord(c): "l" for c in "ghijklmnopqrstuvwxyz"} | {ord(c): "L" for c in "GHIJKLMNOPQRSTUVWXYZ"}
_SIZE = {"d": math.log(10), "h": math.log(6), "H": math.log(6), "l": math.log(20), "L": math.log(20)}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it touches no base span) of the credential-like strings that don't lie
    inside a base span."""
    out, at = [], 0
    blocks = sorted((s[0], s[1]) for s in spans)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b - a >= 12 and text[b - 1] == ".":
            b -= 1
        if b - a < 12:
            continue
        while at < len(blocks) and blocks[at][1] <= a:
            at += 1
        if at == len(blocks) or blocks[at][0] >= b:
            out.append((a, b, True))
            continue
        k = at
        while k < len(blocks) and blocks[k][0] <= a and blocks[k][1] < b:
            k += 1
        if k == len(blocks) or blocks[k][0] > a:
            out.append((a, b, False))
    return out


# ------------------------------------------------------------------- grammar inference
class Automaton:
    """Probabilistic automaton merged from a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.n, self.final, self.next = [0], [0], [{}]      # next: symbol -> [state, count]
        for s in strings:
            q = 0
            self.n[0] += 1
            for c in s:
                if c not in self.next[q]:
                    self.next[q][c] = [len(self.n), 0]
                    self.n.append(0), self.final.append(0), self.next.append({})
                edge = self.next[q][c]
                edge[1] += 1
                q = edge[0]
                self.n[q] += 1
            self.final[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.edges = {(q, c): (t, math.log(k / self.n[q])) for q in self.red for c, (t, k) in self.next[q].items()}
        self.ends = {q: math.log(self.final[q] / self.n[q]) if self.final[q] else FLOOR for q in self.red}

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.final[a], self.n[a], self.final[b], self.n[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, self.n[a], y[1] if y else 0, self.n[b]):
                    return False
                if x and y and self.n[y[0]] > 1:        # one string alone can't contradict
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.final[a] += self.final[b]
            for c, (t, k) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += k
                    todo.append((self.next[a][c][0], t))
                else:
                    self.next[a][c] = [t, k]

    def _merge(self) -> None:
        self.red = [0]
        while True:
            known = set(self.red)
            blue = [(self.n[t], -t, q, c) for q in self.red for c, (t, _) in self.next[q].items() if t not in known]
            if not blue:
                return
            _, t, q, c = max(blue)
            t = -t
            for r in self.red:
                if self._compatible(r, t):
                    self.next[q][c][0] = r
                    self._fold(r, t)
                    break
            else:
                self.red.append(t)

    def score(self, classes: str) -> float:
        q, total = 0, 0.0
        for c in classes:
            t, p = self.edges.get((q, c), (q, FLOOR))
            q, total = t, total + p - _SIZE.get(c, 0.0)
        return total + self.ends[q]


def bigram_counts(strings: list[str]) -> np.ndarray:
    """How often each pair of ASCII characters (first * 128 + second) stands in the strings, a
    blank before and after each."""
    codes = np.frombuffer((" " + " ".join(strings) + " ").encode("ascii"), np.uint8).astype(np.int64)
    return np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128) if strings else np.zeros(128 * 128, np.int64)


def bigrams(counts: np.ndarray) -> dict[str, int]:
    return {chr(i >> 7) + chr(i & 127): int(counts[i]) for i in np.flatnonzero(counts).tolist()}


class Grammars:
    """Automata by kind, the background, and the kinds' cutoffs."""

    def __init__(self, credentials: dict[str, list[str]], others: list[str] | dict[str, int]):
        """``others``: the other strings, or the counts of their bigrams."""
        pairs = others if isinstance(others, dict) else bigrams(bigram_counts(others))
        first: dict[str, int] = defaultdict(int)
        for k, n in pairs.items():
            first[k[0]] += n
        symbols = 70
        self.pairs = {k: math.log((n + 0.5) / (first[k[0]] + 0.5 * symbols)) for k, n in pairs.items()}
        self.unseen = {a: math.log(0.5 / (n + 0.5 * symbols)) for a, n in first.items()}
        self.never = math.log(1 / symbols)
        self.automata, self.cutoffs = {}, {}
        for kind, strings in sorted(credentials.items()):
            strings = sorted(s for s in strings if s)
            if strings:
                self.automata[kind] = Automaton([s.translate(_CLASS) for s in strings])
                each = sorted(self._ratio(kind, s) / len(s) for s in strings)
                self.cutoffs[kind] = each[int(QUANTILE * (len(each) - 1))]

    def background(self, s: str) -> float:
        """Log likelihood as ordinary text; a word in capitals is the word, at a price."""
        plain = self._pairs(s)
        return max(plain, self._pairs(s.lower()) + CAPITALS) if s.isupper() else plain

    def _pairs(self, s: str) -> float:
        total = 0.0
        for a, b in zip(" " + s, s + " ", strict=True):
            p = self.pairs.get(a + b)
            total += p if p is not None else self.unseen.get(a, self.never)
        return total

    def _ratio(self, kind: str, s: str) -> float:
        return self.automata[kind].score(s.translate(_CLASS)) - self.background(s)

    def accepts(self, s: str) -> bool:
        if not self.automata:
            return False
        classes, ground = s.translate(_CLASS), None
        for kind, a in self.automata.items():
            own = a.score(classes)
            if ground is None:
                ground = self.background(s)
            if own - ground >= MARGIN and (own - ground) / len(s) >= self.cutoffs[kind]:
                return True
        return False


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


def first_of(values: dict[str, int]) -> dict[str, int]:
    """The first of distinct strings by (hash, string): SAMPLE of them and TREE characters at most.  What is among the
    first of all strings is among the first of any part of them, so parts can be cut before they are merged."""
    out, size = {}, 0
    for v, h in sorted(values.items(), key=lambda x: (x[1], x[0]))[:SAMPLE]:
        size += len(v)
        if size > TREE:
            break
        out[v] = h
    return out


def labelled_sample(docs: DataFrame) -> DataFrame:
    """(kind, value, n): of the distinct credentials of each kind the first by hash (see ``first_of``), of which
    each task keeps as many, and (kind ``other``) the bigrams of all other candidates with their counts."""
    def run(batches):
        kept: dict[str, dict[str, int]] = defaultdict(dict)
        held: dict[str, int] = defaultdict(int)                    # characters kept
        others, length, counts = [], 0, bigram_counts([])
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if not text:
                    continue
                spans = base_spans(text)
                for a, b, free in candidates(text, spans):
                    if free:
                        others.append(text[a:b])
                        length += b - a
                if length >= CHUNK:
                    counts += bigram_counts(others)
                    others, length = [], 0
                for _, _, kind, value in spans:
                    if len(value) <= TREE and value not in kept[kind]:
                        kept[kind][value] = _key(value)
                        held[kind] += len(value)
                for kind, values in kept.items():
                    if len(values) > 4 * SAMPLE or held[kind] > 4 * TREE:
                        kept[kind] = first_of(values)
                        held[kind] = sum(map(len, kept[kind]))
        counts += bigram_counts(others)
        rows = [(kind, v, h, 0) for kind, values in kept.items() for v, h in first_of(values).items()]
        rows += [("other", pair, 0, n) for pair, n in bigrams(counts).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "value", "h", "n"])

    rows = docs.select("text").mapInArrow(freeing(run), "kind string, value string, h long, n long")
    rows = rows.groupBy("kind", "value", "h").agg(F.sum("n").alias("n"))
    for keys in (["kind", (F.col("h") % 64)], ["kind"]):
        w = Window.partitionBy(*keys).orderBy("h", "value")
        upto = F.sum(F.length("value")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("r", F.row_number().over(w)).withColumn("c", upto) \
            .where(((F.col("r") <= SAMPLE) & (F.col("c") <= TREE)) | (F.col("kind") == "other")).drop("r", "c")
    return rows.select("kind", "value", "n")


def infer(docs: DataFrame) -> Grammars:
    groups, others = defaultdict(list), {}
    for r in labelled_sample(docs).collect():           # at most SAMPLE strings and TREE characters per kind, and the bigrams
        if r.kind == "other":
            others[r.value] = r.n
        else:
            groups[r.kind].append(r.value)
    return Grammars(groups, others)


def scan_text(text: str | None, grammars: Grammars) -> list[tuple[int, int, str, str]]:
    if not text:
        return []
    spans = base_spans(text)
    more = [(a, b, "grammar", text[a:b]) for a, b, _ in candidates(text, spans) if grammars.accepts(text[a:b])]
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """doc_id and the spans (start, end, kind) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(grammars)

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"),
               "spans": [[{"start": a, "end": b, "kind": k} for a, b, k, _ in scan_text(t.as_py(), model.value)]
                         for t in batch.column("text")]}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                        "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redacted(text: str, spans: list[tuple[int, int, str, str]], mark: str = "[SECRET]") -> str:
    """``text`` with every credential (not the key word before it) replaced by ``mark``."""
    cuts: list[list[int]] = []
    for a, b in sorted((b - len(v), b) for _, b, _, v in spans):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    out, at = [], 0
    for a, b in cuts:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """``docs`` with the credentials in ``text`` replaced, and ``n_chars`` counted anew where the
    text changed; all other columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(grammars)
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redacted(t, s) if t and (s := scan_text(t, model.value)) else t for t in old]
            if length is not None:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(length).to_pylist(), strict=True)]
                field = batch.schema.field(length)
                batch = batch.set_column(length, field, pa.array(sizes, field.type))
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(freeing(run), docs.schema)


def op9_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spans = scan(docs, infer(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


QUERIES = {"op9_secret_grammars": op9_secret_grammars}
