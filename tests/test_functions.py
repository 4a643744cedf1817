"""Edge cases of the column expressions, on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from shotgrid.functions import (batch_size_rule, bce_with_logit, display_label, kl_rows, linear_schedule,
                                method_from_file, metric_title, minimal_pattern, parse_answer, softmax,
                                teacher_context)
from shotgrid.operators.history import zip_long
from shotgrid.operators.report import reformat_eval_metrics
from shotgrid.operators.tokens import pad_truncate


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text,actual,expected", [
    ("Yes,", 1, 0), ("  Yes,,", 1, 0), ("no", 0, 1), ("No, yes", 1, 0), ("I know", 0, 1),
    ("maybe", 0, 1), ("maybe", 1, 0), ("", 1, 0), ("\n\tYES \n", 1, 0), ("no yes", 1, 0),
])
def test_parse_answer(spark, text, actual, expected):
    df = spark.createDataFrame([(text, actual)], "t string, a int")
    assert df.select(parse_answer("t", "a")).first()[0] == expected


def test_minimal_pattern_context_spacing(spark):
    df = spark.createDataFrame([("P", "H", ""), ("P", "H", "ctx")], "premise string, hypothesis string, c string")
    got = [r[0] for r in df.select(minimal_pattern("premise", "hypothesis", F.col("c"))).collect()]
    assert got == ["P H?", "ctx P H?"]


def test_teacher_context_literal(spark):
    df = spark.createDataFrame([("cp", "ch", "ep", "eh")], "a string, b string, c string, d string")
    got = df.select(teacher_context("a", "b", "c", "d")).first()[0]
    assert got.startswith("The question you are trying to solve")
    assert "Example input: cp ch?\nExample output: No \n Explanation: The answer is No" in got
    assert "Example input: ep eh?\nExample output: Yes \n Explanation: The answer is Yes" in got
    assert got.endswith("Now determine whether the following is a contradiction or an entailment.\n")


def test_causal_loss_golden(spark):
    # 25 of 50 positive, all predicted 1 -> 0.8133 at accuracy 0.50; all predicted 0 -> 0.6931
    data = [(1, 1 if i < 25 else 0) for i in range(50)]
    df = spark.createDataFrame(data, "p int, y int")
    loss, acc = df.agg(F.avg(bce_with_logit("p", "y")), F.avg((F.col("p") == F.col("y")).cast("double"))).first()
    assert round(loss, 4) == 0.8133 and acc == 0.5
    data = [(1, 1 if i < 27 else 0) for i in range(50)]
    loss, acc = spark.createDataFrame(data, "p int, y int").agg(
        F.avg(bce_with_logit("p", "y")), F.avg((F.col("p") == F.col("y")).cast("double"))).first()
    assert round(loss, 4) == 0.7733 and acc == 0.54
    zero = spark.createDataFrame([(0, i % 2) for i in range(50)], "p int, y int")
    assert round(zero.agg(F.avg(bce_with_logit("p", "y"))).first()[0], 4) == 0.6931


@pytest.mark.parametrize("ids,side,exp_ids,exp_mask", [
    ([], "left", [0, 0, 0], [0, 0, 0]),
    ([5, 6, 7], "left", [5, 6, 7], [1, 1, 1]),
    ([5, 6, 7, 8], "left", [5, 6, 7], [1, 1, 1]),
    ([5], "left", [0, 0, 5], [0, 0, 1]),
    ([5], "right", [5, 0, 0], [1, 0, 0]),
    ([5, 6, 7, 8], "right", [5, 6, 7], [1, 1, 1]),
])
def test_pad_truncate(spark, ids, side, exp_ids, exp_mask):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    i, m = pad_truncate("ids", 3, side)
    got = df.select(i, m).first()
    assert list(got[0]) == exp_ids and list(got[1]) == exp_mask


def test_zip_stops_at_shorter(spark):
    df = spark.createDataFrame([(1, "train", 1, 1.0), (1, "train", 2, 2.0), (1, "val", 1, 0.5), (2, "val", 1, 1.0), (3, "train", 1, None),
                                (3, "val", 1, None)], "run int, kind string, pos int, loss double")
    assert rows(zip_long(df).orderBy("run")) == [(1, 1, 1.0, 0.5), (3, 1, None, None)]


def test_softmax_and_kl(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([0.0, 800.0], [0.0, 0.0])], "t array<double>, s array<double>")
    got = df.select(softmax("t", 2.0), kl_rows("t", "s")).collect()
    p = got[0][0]
    assert math.isclose(sum(p), 1.0) and math.isclose(p[1] / p[0], math.exp(0.5))
    assert abs(got[0][1]) < 1e-12            # equal -> 0
    assert math.isclose(got[1][1], math.log(2.0), rel_tol=1e-9)  # zero-probability class adds 0
    assert got[1][1] >= 0


def test_batch_size_and_schedule(spark):
    df = spark.createDataFrame([("opt-350m", 8), ("opt-350m", 16), ("opt-350m", 4), ("opt-125m", 16)],
                               "m string, s int")
    assert [r[0] for r in df.select(batch_size_rule("m", "s")).collect()] == [4, 2, 8, 8]
    sch = spark.createDataFrame([(0,), (5,), (10,), (55,), (100,)], "step int")
    got = [r[0] for r in sch.select(linear_schedule("step", F.lit(100), F.lit(10), 1.0)).collect()]
    assert got == [0.0, 0.5, 1.0, 0.5, 0.0]


def test_method_labels_titles(spark):
    names = ["fewshot_lora_metrics_final.csv", "recursive_context_distillation_metrics.csv",
             "context_distillation_metrics.csv", "icl_metrics_final.csv", "zeroshot_metrics.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r[0] for r in df.select(method_from_file("f")).collect()] == [
        "fewshot_lora", "recursive_context_distillation", "context_distillation", "icl", "zeroshot"]
    lab = spark.createDataFrame([("context_distillation", 16), ("recursive_context_distillation", 4096),
                                 ("zeroshot", 50), ("icl", 2)], "m string, s int")
    assert [r[0] for r in lab.select(display_label("m", "s")).collect()] == [
        "CD (16)", "CD_recursive (4096)", "", "icl (2)"]
    t = spark.createDataFrame([("accuracy",), ("runtime",), ("peak_memory_gb",), ("lOSS",)], "metric string")
    assert [r[0] for r in t.select(metric_title("metric")).collect()] == [
        "Accuracy", "Runtime (s)", "Peak Memory Usage (GB)", "Loss"]


def test_reformat_eval_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "eval_loss double, eval_accuracy double, train_loss double")
    assert reformat_eval_metrics(df, "out").columns == ["eval_out_loss", "eval_out_accuracy", "train_loss"]
