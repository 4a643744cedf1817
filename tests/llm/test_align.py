"""Operator 13 against a straight-line version in plain Python."""

import collections
import hashlib

import numpy as np
import pytest

from shotgrid.llm import align
from tests.conftest import SF001
from tests.llm.helpers import odd_rows, table

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters():
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute(rows):
    """The contract, token by token, with ``tokenizers`` for A."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters, docs, holds = byte_letters(), [], collections.Counter()
    for _, text in rows:
        groups = []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            ab = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
            bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            whole = (" " + text).encode()
            if b"".join(ab) == whole and b"".join(bb) == whole:
                ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                common, i, j = set(ends_a) & set(ends_b), 0, 0
                for c in sorted(common):
                    x, y = [], []
                    while i < len(a) and ends_a[i] <= c:
                        x.append(a[i])
                        i += 1
                    while j < len(b) and ends_b[j] <= c:
                        y.append(b[j])
                        j += 1
                    groups.append((x, y))
        docs.append(groups)
        holds.update({(p, q) for x, y in groups for p in x for q in y})
    highest = collections.defaultdict(int)
    for (p, _), k in holds.items():
        highest[p] = max(highest[p], k)
    out = []
    for (doc_id, _), groups in zip(rows, docs, strict=True):
        links = [(p, q) for x, y in groups for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(holds[link] == highest[link[0]] for link in links), sum(holds[link] for link in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(5))
def test_product_equals_dense(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 3, (rng.integers(1, 9), 7)), rng.integers(0, 3, (7, rng.integers(1, 9)))

    def rows(m):
        at = np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))])
        return align.Rows(at, np.nonzero(m)[1], m[m > 0], m.shape[1])

    for size in (1, 5, 1000):
        got = align.joined(align.product(rows(x), rows(y), size), y.shape[1])
        dense = np.zeros((len(x), y.shape[1]), int)
        for i in range(len(x)):
            dense[i, got.columns[got.at[i]:got.at[i + 1]]] = got.values[got.at[i]:got.at[i + 1]]
        assert (dense == x @ y).all()


def test_overlaps_and_groups():
    a, b = np.array([2, 3, 1, 4]), np.array([1, 1, 2, 2, 1, 3])          # common ends: 2, 6, 10
    links = align.overlap_links(a, b)
    shared = {(i, int(j)): int(v) for i in range(4) for j, v in zip(links.columns[links.at[i]:links.at[i + 1]], links.values[links.at[i]:links.at[i + 1]],
                                                                      strict=True)}
    assert shared == {(0, 0): 1, (0, 1): 1, (1, 2): 2, (1, 3): 1, (2, 3): 1, (3, 4): 1, (3, 5): 3}
    of_a, of_b = align.groups(links)
    assert of_a.tolist() == [0, 1, 1, 2] and of_b.tolist() == [0, 0, 1, 1, 2, 2]
    pairs = {(lo + i, int(j)) for lo, r in align.group_links(of_a, of_b) for i in range(len(r.at) - 1) for j in r.columns[r.at[i]:r.at[i + 1]]}
    assert pairs == {(0, 0), (0, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 4), (3, 5)}


@pytest.mark.parametrize("head", [align.HEAD, 300, 0])
def test_alignment_against_brute_force(spark, head):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = align.align(docs.repartition(5), head=head)
    assert got.columns == COLUMNS
    assert result(got) == brute(rows)


def test_odd_documents(spark):
    rows = odd_rows() + [(20, "<|endoftext|> and </s> <unk> <0x41> [INST]", "en", "a", 1), (21, "▁under ▁score", "en", "a", 1),
                         (22, "  two  spaces \n\n\t tab\r\n", "en", "a", 1), (23, "ﬁne ℌ ½ é   ​", "en", "a", 1), (24, "\x00\x01", "en", "a", 1),
                         (25, "漢字かな交じり文 Привет мир 😀😃", "ja", "a", 1), (26, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "en", "a", 1)]
    got = align.align(table(spark, rows, extra=True))
    assert result(got) == brute([r[:2] for r in rows])


def test_empty_table(spark):
    assert align.align(table(spark, [])).collect() == []
    assert align.align(table(spark, [(1, None, None, None, None)])).collect()[0].asDict() == dict(zip(COLUMNS, (1, 0, 0, 0, 0, 0, 0, ""), strict=True))


def test_token_spellings_cover_both_vocabularies():
    encode_a, vocab_a, encode_b, vocab_b = align.tokenizers(align.default_tokenizers())
    text = "Déjà vu — 漢字 😀\n\n\tx = {1: 'a'};" * 3
    assert vocab_a.spell(encode_a(" " + text).astype(np.int64)).tobytes() == (" " + text).encode()
    assert vocab_b.spell(np.array(encode_b(text))).tobytes() == (" " + text).encode()
