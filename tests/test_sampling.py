"""Sampling invariants: exact sizes, partition independence, brute-force agreement."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shotgrid.functions import hash_index, sample_key
from shotgrid.operators import sampling as S


def brute_force_grid(df, sizes, trials, seed):
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, t) for s in sizes for t in range(trials)], "sample_size int, trial int")
    pairs = df.select("id").join(grid, how="cross").withColumn("h", sample_key(seed, "sample_size", "trial", "id"))
    w = Window.partitionBy("sample_size", "trial").orderBy("h", "id")
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("sample_size")) \
                .select("sample_size", "trial", "rn", "id")


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 300).withColumn("label", (F.col("id") % 3).cast("int"))


def test_trial_grid_exact_sizes_and_brute_force(spark, ids):
    got = S.trial_grid(ids, [2, 4, 8, 16], 5, 42)
    per = {(r[0], r[1]): (r[2], r[3]) for r in
           got.groupBy("sample_size", "trial").agg(F.count("*"), F.countDistinct("id")).collect()}
    assert all(n == d == k[0] for k, (n, d) in per.items()) and len(per) == 20
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute_force_grid(ids, [2, 4, 8, 16], 5, 42).collect()))


def test_trial_grid_fallback_path_is_exact(spark, ids):
    # a tiny oversampling share forces deficient cells through the widening loop
    got = S.trial_grid(ids, [2, 16], 6, 7, oversample=0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute_force_grid(ids, [2, 16], 6, 7).collect()))


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_partition_independence(spark, ids, parts):
    base = sorted(map(tuple, S.trial_grid(ids, [4], 3, 42).collect()))
    assert sorted(map(tuple, S.trial_grid(ids.repartition(parts), [4], 3, 42).collect())) == base
    smp = sorted(r[0] for r in S.sample_n(ids.repartition(parts), 10, 42, "x").select("id").collect())
    assert smp == sorted(r[0] for r in S.sample_n(ids, 10, 42, "x").select("id").collect())


def test_sample_larger_than_rows_raises(spark, ids):
    with pytest.raises(Exception, match="cannot take a sample"):
        S.sample_n(ids, 301, 42).collect()
    assert S.sample_n(ids, 300, 42).count() == 300
    with pytest.raises(ValueError):
        S.trial_grid(ids.limit(10), [16], 1, 42)


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_index_matches_row_number(spark, ids, parts):
    got = S.dense_index(ids.repartition(parts), ["id"], ["label"]).select("id", "idx")
    w = Window.partitionBy("label").orderBy("id")
    exp = ids.withColumn("idx", F.row_number().over(w) - 1).select("id", "idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_per_label_and_validation_subset(spark, ids):
    got = S.per_label(ids, 3, 42, "q")
    assert sorted(r[0] for r in got.groupBy("label").count().select("count").collect()) == [3, 3, 3]
    assert S.per_label(ids, 0, 42).count() == 0
    for n, k in ((49, 49), (50, 10), (51, 10)):
        assert S.validation_subset(spark.range(n), 42).count() == k


def test_micro_batches_last_short(spark):
    mb = S.micro_batches(spark.range(0, 21), 8)
    sizes = sorted(r[1] for r in mb.groupBy("batch_id").count().collect())
    assert sizes == [5, 8, 8]


def test_history_split_with_hot_run(spark):
    """Drop-last-3 and per-kind positions against a brute-force window, with one run
    holding most entries and the data spread over many partitions."""
    import datetime as dt
    from shotgrid.operators.history import split_entries
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0 if i % 10 else 1 + i % 3, i, t0 + dt.timedelta(seconds=i),
             None if i % 3 else float(i), float(i) if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "run long, event_id long, ts timestamp, eval_loss double, loss double")
    got = sorted(map(tuple, split_entries(df.repartition(7)).collect()))
    w = Window.partitionBy("run").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    b = df.withColumn("rd", F.row_number().over(w)).filter("rd > 3") \
          .withColumn("kind", F.when(F.col("eval_loss").isNull(), "train").otherwise("val"))
    wk = Window.partitionBy("run", "kind").orderBy("ts", "event_id")
    exp = b.select("run", "kind", F.row_number().over(wk).alias("pos"),
                   F.coalesce("eval_loss", "loss").alias("loss"))
    assert got == sorted(map(tuple, exp.collect()))


@pytest.mark.parametrize("n", [5, 20, 60, 300])
def test_sample_is_the_smallest_keys(spark, ids, n):
    want = [r.id for r in ids.withColumn("h", sample_key(42, F.lit("big"), F.col("id"))).orderBy("h", "id").limit(n).collect()]
    for parts in (1, 6):
        got = S.sample_n(ids.repartition(parts), n, 42, "big").select("id").collect()
        assert sorted(r.id for r in got) == sorted(want)


def test_guards_at_zero_one_less_and_enough_rows(spark, ids):
    for rows, ok in ((0, False), (4, False), (5, True)):
        if ok:
            assert S.sample_n(ids.limit(rows), 5, 42).count() == 5
        else:
            with pytest.raises(ValueError, match="cannot take a sample"):
                S.sample_n(ids.filter(F.col("id") < rows), 5, 42)
    assert S.sample_n(ids.limit(0), 0, 42).count() == 0
    with pytest.raises(ValueError, match="label"):
        S.per_label(ids.filter("id < 8"), 3, 42)            # label 2 has two rows
    with pytest.raises(ValueError, match="label 7"):
        S.per_label(ids, 3, 42, labels=(0, 7))


def test_draws_reach_positions_above_32_bits(spark):
    n = 10**12
    top = spark.range(2000).select(hash_index(1, "id", n).alias("p")).agg(F.max("p"), F.min("p")).first()
    assert top[0] > 9 * 10**11 and 0 <= top[1] < 10**11


def test_teacher_context_without_a_label_raises(spark):
    from shotgrid.operators.prompts import teacher_contexts
    batches = spark.createDataFrame([("a",), ("b",)], "batch_id string")
    pool = spark.createDataFrame([(1, "p\nh", 0), (2, "q\ni\nj", 1)], "id long, text string, label int")
    assert teacher_contexts(batches, pool, 42).count() == 2
    with pytest.raises(Exception, match="row of each label"):
        teacher_contexts(batches, pool.filter("label = 0"), 42).collect()


def test_every_character_of_a_text_reaches_a_column(spark):
    from shotgrid.sources.views import as_pairs, nli_pairs, nli_rows
    texts = ["one line", "a\nb\nc", "", "\n\n x ", None, "é\n漢\n"]
    got = as_pairs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).orderBy("id").collect()
    assert [(r.premise, r.hypothesis) for r in got] == [
        ("one line", ""), ("a", "b\nc"), ("", ""), ("", "\n x "), (None, ""), ("é", "漢\n")]
    sf = "/root/testdata/sf0.001"
    size = lambda df, *cols: df.agg(*[F.sum(F.length(c)) for c in cols]).first()
    whole, pairs = size(nli_rows(spark, sf), "text"), size(nli_pairs(spark, sf), "premise", "hypothesis")
    breaks = nli_rows(spark, sf).filter(F.col("text").contains("\n")).count()
    assert whole[0] == pairs[0] + pairs[1] + breaks


def test_materialized_follows_its_input_and_survives_a_failed_write(spark, tmp_path):
    import uuid
    from shotgrid.session import shared_dir
    from shotgrid.sources.datasets import materialized
    src, kind, calls = str(tmp_path / "in"), f"test-{uuid.uuid4().hex}", []

    def get(*params):
        source = spark.read.parquet(src)

        def build():
            calls.append(1)
            return source
        return materialized(spark, kind, params, source, build)

    spark.range(3).write.parquet(src)
    assert get().count() == 3 and get().count() == 3 and len(calls) == 1       # loaded the second time
    assert get("other").count() == 3 and len(calls) == 2
    spark.range(4).write.mode("append").parquet(src)
    assert get().count() == 7 and len(calls) == 3                              # changed input
    base = shared_dir(spark).removeprefix("file://")
    (folder,) = [f for f in __import__("pathlib").Path(base, kind).iterdir() if spark.read.parquet(str(f)).count() == 7]
    (folder / "_SUCCESS").rename(folder / "_SUCCESS.gone")                     # as a failed writer leaves it
    assert get().count() == 7 and len(calls) == 4


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from shotgrid import session

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Session)


def test_logs_of_both_shapes_are_read(spark, tmp_path):
    """Literal rows of a training log and of an inference log."""
    from shotgrid.schemas import metrics_schema
    from shotgrid.sources import sinks
    trained = ("model_name,sample_size,train_runtime,train_samples_per_second,train_steps_per_second,total_flos,train_loss,epoch,"
               "train_peak_memory_gb,eval_in_loss,eval_in_accuracy,eval_in_runtime,eval_in_samples_per_second,"
               "eval_in_steps_per_second,eval_in_peak_memory_gb,eval_out_loss,eval_out_accuracy,eval_out_runtime,"
               "eval_out_samples_per_second,eval_out_steps_per_second,eval_out_peak_memory_gb\n"
               "opt-125m,2,76.6694,1.043,0.522,20903740047360.0,0.09104223455869942,40.0,2.501254081726074,1.6512948274612427,"
               "0.52,2.3888,20.931,2.93,1.9606671333312988,1.3591598272323608,0.46,2.3738,21.063,2.949,1.9606671333312988\n")
    scored = ("model_name,sample_size,eval_in_loss,eval_in_accuracy,eval_in_runtime,eval_in_samples_per_second,eval_in_peak_memory_gb,"
              "eval_out_loss,eval_out_accuracy,eval_out_runtime,eval_out_samples_per_second,eval_out_peak_memory_gb\n"
              "opt-125m,2,1.5,0.5,3.4,14.7,1.25,1.25,0.75,3.5,14.25,1.25\n")
    (tmp_path / "a.csv").write_text(trained)
    (tmp_path / "b.csv").write_text(scored)
    (a,) = sinks.read_metrics(spark, str(tmp_path / "a.csv"), "fewshot").collect()
    (b,) = sinks.read_metrics(spark, str(tmp_path / "b.csv"), "icl").collect()
    assert len(a) == 21 and a.total_flos == 20903740047360.0 and a.eval_out_steps_per_second == 2.949 and a.epoch == 40.0
    assert len(b) == len(metrics_schema("icl")) == 12 and b.eval_out_accuracy == 0.75


def test_icl_scoring_does_not_grow_with_cells_times_tokens(spark):
    """Rows of the largest intermediate: rows * cells * models and matches, whatever the texts' length."""
    from shotgrid.operators import scorers as SC
    long = "w " * 3000
    ev = spark.createDataFrame([("in", i, 0, long, "x y") for i in range(3)], "domain string, id long, label int, premise string, hypothesis string")
    demos = spark.createDataFrame([(2, t, i % 2, "a b", "x") for t in range(10) for i in range(2)],
                                  "sample_size int, trial int, label int, premise string, hypothesis string")
    cells = [(2, t) for t in range(10)]
    zs = SC.zero_shot_scores(ev, spark.createDataFrame([("x", 3)], "token string, n long"), {"N": 10, "V": 3})
    out = SC.icl_scores(ev, demos, zs, cells)
    assert out.count() == 3 * 10 * len(SC.COUNT_MODELS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(regexp_extract_all") <= 6 and "Cartesian" not in plan
