"""Heads as aggregates against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from shotgrid.operators import learn as L

SF01 = "/root/testdata/sf0.01"


def labelled_rows(spark, n=60):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 3))
    y = (x @ np.array([0.5, -1.0, 2.0]) > 0).astype(int)
    rows = [("a", x[i].tolist(), int(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "model_name string, features array<double>, y int")


def test_centroid_heads_and_logits(spark):
    x, y, df = labelled_rows(spark)
    head = L.centroid_heads(df, ["model_name"]).first()
    w = np.stack([x[y == 0].mean(0), x[y == 1].mean(0)])
    assert np.allclose(head.w, w)
    lg = df.crossJoin(F.broadcast(L.centroid_heads(df, ["model_name"]).drop("model_name"))).select(
        L.head_logits(F.col("features"), F.col("w"), F.col("b")).alias("l")).collect()
    assert np.allclose([r.l for r in lg], x @ w.T - 0.5 * (w * w).sum(1))


def test_context_logits(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0], [0.0, 2.0])], "x array<double>, a array<double>, b array<double>")
    assert df.select(L.context_logits(F.col("x"), F.col("a"), F.col("b"), 0.5).alias("l")).first().l == [-8.0, -2.0]


def test_saved_parameters_are_read_by_label(spark, tmp_path):
    from shotgrid.plans.q_learn import params_table, trial_heads
    from shotgrid.sources import sinks
    heads = trial_heads(spark, SF01)
    path = sinks.save_params(params_table(heads), str(tmp_path))
    one = sinks.load_params(spark, path, "head-large", 8, 3)
    w = np.array(heads.filter("model_name = 'head-large' and sample_size = 8 and trial = 3").first().w)
    back = np.zeros_like(w)
    for r in one.filter("layer = 'W'").collect():
        back[r.i, r.j] = r.value
    assert np.allclose(back, w) and one.filter("layer = 'b'").count() == 2
