"""Scorer registry, count scorer, subword tokens, log sources and positions."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotgrid.operators import scorers as SC
from shotgrid.operators import subword as SW
from shotgrid.operators import tokens as TK
from shotgrid.operators.report import distinct_keys
from shotgrid.sources import sinks


# ------------------------------------------------------------------------------ registry
def doubling(factor):
    return SC.Scorer(np.array([factor]), lambda w: float(w[0]), lambda f, b: pd.DataFrame({"id": b["id"], "y": b["x"] * f}), "id long, y double")


def test_unknown_models_are_refused(spark):
    SC.register("twice", "toy")(lambda spark, by=2.0: doubling(by))
    assert SC.load_scorer(spark, "twice", "toy", by=3.0).weights.tolist() == [3.0]
    for name, kind in (("twice", "other"), ("thrice", "toy"), ("opt-125m", "CausalLM")):
        with pytest.raises(ValueError, match="not supported"):
            SC.load_scorer(spark, name, kind)


def test_weights_are_measured_and_made_ready(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, x double").repartition(5)
    assert sorted((r.id, r.y) for r in SC.score_with(df, doubling(2.0)).collect()) == [(i, 2.0 * i) for i in range(20)]
    assert sorted((r.id, r.y) for r in SC.score_with(df, doubling(5.0)).collect()) == [(i, 5.0 * i) for i in range(20)]
    assert SC.score_with(df.limit(0), doubling(2.0)).count() == 0
    with pytest.raises(ValueError, match="limit"):
        SC.score_with(df, SC.Scorer(np.zeros(10_000), None, None, "id long"), limit=1000)


def test_heads_that_were_not_saved_are_an_error(spark, tmp_path):
    from shotgrid.plans import q_signals  # noqa: F401 - registers the heads
    from shotgrid.plans.q_learn import params_table
    heads = spark.createDataFrame([("head-small", 16, 0, [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.5])],
                                  "model_name string, sample_size int, trial int, w array<array<double>>, b array<double>")
    path = sinks.save_params(params_table(heads), str(tmp_path))
    scorer = SC.load_scorer(spark, "head-small", "classification", path=path, sample_size=16, trial=0)
    rows = spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 1.0])], "id long, features array<double>")
    assert sorted(tuple(r) for r in SC.score_with(rows, scorer).collect()) == [(1, 0, 2.0, 1.5), (2, 1, 1.0, 1.5)]
    with pytest.raises(ValueError, match="no parameters"):
        SC.load_scorer(spark, "head-small", "classification", path=path, sample_size=16, trial=7)


# --------------------------------------------------------------------------- count scorer
def test_count_scorer_against_a_loop(spark):
    corpus = ["the cat sat", "the dog sat down", "a cat and a dog", "été naïve ÉTÉ", None, ""]
    rows = [("in", 1, 0, "the cat sat on", "a cat sat"), ("in", 2, 1, "", "the dog"), ("out", 3, 1, "été", "Été? Été!"), ("out", 4, 0, "x", ""),
            ("out", 5, 0, "the cat", "unseen words")]
    df = spark.createDataFrame(rows, "domain string, id long, label int, premise string, hypothesis string")
    counts = SC.corpus_counts(spark.createDataFrame([(t,) for t in corpus], "text string"))
    got = {(r.model_name, r.id): (r.score0, r.score1) for r in
           SC.zero_shot_scores(df, *SC.corpus_totals(counts, keep=SC.needed_tokens(df))).collect()}

    def words(t):
        out, w = [], ""
        for ch in (t or "").lower() + " ":
            if ch.isalpha():
                w += ch
            elif w:
                out.append(w)
                w = ""
        return out

    n = Counter(w for t in corpus for w in words(t))
    total, distinct = sum(n.values()), len(n)
    for m in SC.COUNT_MODELS:
        for _, i, _, premise, hypothesis in rows:
            near, a, b = words(premise), 0.0, 0.0
            for w in words(hypothesis):
                p = (n[w] + m.alpha) / (total + m.alpha * (distinct + 1))
                a += math.log(m.beta * near.count(w) / max(len(near), 1) + (1 - m.beta) * p)
                b += math.log(p)
            assert np.allclose(got[m.name, i], (a, b))
    assert len(got) == len(rows) * len(SC.COUNT_MODELS)
    assert got["count-a", 1][0] > got["count-a", 1][1] and got["count-a", 5][0] < got["count-a", 5][1]


# -------------------------------------------------------------------------------- tokens
TEXTS = ["Plain words.", "déjà vu — naïve café", "漢字かな交じり文", "Привет, мир!", "😀 emoji\n\ttabs", "<|endoftext|> is text", "", None, "a" * 5000, "\x00 odd \u200b"]


def test_subwords_keep_every_character(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    ids = SW.encode(df, SW.default_file(), "text", "ids")
    back = SW.decode(ids, SW.default_file(), "ids", "back").collect()
    assert {r.id: r.back for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(50256 not in r.ids for r in back)


def test_subwords_by_ranks_are_those_of_the_tokenizer(spark):
    texts = [*TEXTS, "x" * 9000, " \n" * 5000, "  two  spaces ", "it's <|endoftext|>\u00a0漢"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    file, ranks = SW.default_file(), SW.default_ranks()
    slow, fast = ({r.id: list(r.ids) for r in SW.encode(df, file, "text", "ids", *more).collect()} for more in ((), (ranks,)))
    assert fast == slow and fast[7] == [] and all(fast[i] for i, t in enumerate(texts) if t)
    gave_up = " " * 1_500_000 + "x"                       # more than the regular expression engine takes
    assert SW._encoder(file, ranks)(gave_up).tolist() == SW.tokenizer(file).encode(gave_up, add_special_tokens=False).ids
    whole = [*fast.values(), None]
    for lists in (whole, [*whole, fast[2][:-1], fast[4][:1]], [*whole, [50256, *fast[0]]], [None, []], []):
        rows = spark.createDataFrame(list(enumerate(lists)), "id long, ids array<int>").coalesce(1)
        slow_, fast_ = ({r.id: r.back for r in SW.decode(rows, file, "ids", "back", *more).collect()} for more in ((), (ranks,)))
        assert fast_ == slow_ and len(fast_) == len(lists)
    pieces = SW._ranked(ranks)[1]
    assert SW._looked_up(pa.array(whole, pa.list_(pa.int32())), pieces).to_pylist() == [*[t or "" for t in texts], ""]
    assert SW._looked_up(pa.array([fast[2], fast[4][:1]], pa.list_(pa.int32())), pieces) is None       # cut inside a character


def test_words_of_all_scripts(spark):
    df = spark.createDataFrame([(1, "Ärger, été 漢字! Привет x2y _z")], "id long, text string")
    assert df.select(TK.tokens("text").alias("t")).first().t == ["ärger", "été", "漢字", "привет", "x", "y", "z"]


# ---------------------------------------------------------------------------------- logs
def test_a_log_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert sinks.read_logs(spark, {"icl": f"{tmp_path}/scored/log=icl_metrics.csv"}) == {}
    bad = tmp_path / "scored" / "log=icl_metrics.csv"
    bad.mkdir(parents=True)
    (bad / "part-0.csv").write_text("other,header\n1,2\n")
    with pytest.raises(Exception, match="(?i)header|schema|column"):
        sinks.read_logs(spark, {"icl": str(bad)})["icl_metrics.csv"].collect()


def test_keys_appear_in_the_order_of_the_lines(spark, tmp_path):
    order = [5, 3, 9, 1, 7]
    rows = [(f"m{order[i // 200]}", order[(i // 40) % 5], i, "icl") for i in range(1000)]
    log = spark.createDataFrame(rows, "model_name string, sample_size int, trial int, finetuning_method string").repartition(7)
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():                                               # several files, read in blocks
        spark.conf.set(k, v)
    try:
        path = sinks.write_combined(log, str(tmp_path), order_by=("trial",))
        assert len(list((tmp_path / "combined_metrics.csv").glob("part-*.csv"))) > 1
        back = sinks.with_position(sinks.read_combined(spark, path))
        got = {(r.key, r.value): r.ordinal for r in distinct_keys(back, ["model_name", "sample_size"], "position").collect()}
        assert back.select(F.countDistinct("position")).first()[0] == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {**{("model_name", f"m{v}"): k + 1 for k, v in enumerate(order)}, **{("sample_size", str(v)): k + 1 for k, v in enumerate(order)}}


def test_report_is_written_and_read_back(spark, tmp_path):
    rows = [("b", "icl", 4, *["0.50"] * 8), ("a", "icl", 2, *["1.25"] * 7, None)]
    df = spark.createDataFrame(rows, sinks.REPORT)
    path = sinks.write_report(df, str(tmp_path))
    assert len(list((tmp_path / "report.csv").glob("part-*.csv"))) == 1
    assert [tuple(r) for r in sinks.read_report(spark, path).collect()] == sorted(rows)
