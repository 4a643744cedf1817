"""Gradient descent over tables against plain numpy loops and numeric derivatives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotgrid.operators import descent as G

SF01 = "/root/testdata/sf0.01"
HEADS = [G.SoftmaxHead(3, 4), G.LowRankHead(3, 4, rank=2, alpha=3.0)]


def numeric(f, p, h=1e-6):
    return np.array([(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(len(p))])


@pytest.mark.parametrize("loss", [G.soft_loss, G.self_loss])
@pytest.mark.parametrize("head", HEADS)
def test_gradients_are_derivatives(head, loss):
    rng = np.random.default_rng(4)
    p, x = rng.normal(size=head.size), rng.normal(size=(5, head.features))
    target = rng.normal(size=(5, head.classes))
    if loss is G.soft_loss:
        target = np.exp(target) / np.exp(target).sum(axis=1, keepdims=True)
        target[0] = [1.0, 0.0, 0.0]
    _, dz = loss(head.logits(p, x), target)
    want = numeric(lambda q: loss(head.logits(q, x), target)[0].sum(), p)
    assert np.allclose(head.slope(p, x, dz)[head.trainable], want[head.trainable], atol=1e-6)


def test_self_loss_is_not_the_detached_one():
    rng = np.random.default_rng(5)
    z, e = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    q = np.exp(z + e) / np.exp(z + e).sum(axis=1, keepdims=True)
    fixed, dz_fixed = G.soft_loss(z, q)
    free, dz_free = G.self_loss(z, e)
    assert np.allclose(fixed, free) and not np.allclose(dz_fixed, dz_free)


def problem(spark, head, models=3, rows=23, batch=5, epochs=2):
    """Models of different sizes with their own rows and batches."""
    rng = np.random.default_rng(6)
    data, start = [], []
    for g in range(models):
        n = rows - 4 * g
        x, y = rng.normal(size=(n, head.features)), rng.integers(0, head.classes, n)
        spe = -(-n // batch)
        start.append((g, spe, epochs * spe, 1, rng.normal(size=head.size).tolist()))
        data += [(g, i // batch, x[i].tolist(), np.eye(head.classes)[y[i]].tolist()) for i in range(n)]
    return (data, start, spark.createDataFrame(data, "gid int, slot int, features array<double>, target array<double>"),
            spark.createDataFrame(start, "gid int, spe int, total int, warm int, p array<double>"))


def plain(data, start, head, loss, opt):
    """One model after the other, one batch after the other: gid -> (parameters, losses)."""
    out = {}
    for g, spe, total, warm, p in start:
        p, m, v, losses = np.array(p), np.zeros(head.size), np.zeros(head.size), []
        for t in range(total):
            rows = [r for r in data if r[0] == g and r[1] == t % spe]
            x, target = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            each, dz = loss(head.logits(p, x), target)
            grad = head.slope(p, x, dz) / len(rows)
            losses.append(each.mean())
            rate = opt.rate * (t / warm if t < warm else max(0.0, (total - t) / max(total - warm, 1)))
            if opt.momentless:
                change = grad
            else:
                m, v = opt.beta1 * m + (1 - opt.beta1) * grad, opt.beta2 * v + (1 - opt.beta2) * grad ** 2
                change = (m / (1 - opt.beta1 ** (t + 1))) / (np.sqrt(v / (1 - opt.beta2 ** (t + 1))) + opt.eps)
            p = np.where(head.trainable, p - rate * (change + opt.decay * p), p)
        out[g] = p, losses
    return out


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("opt", [G.Optimiser(0.05, decay=0.02), G.Optimiser(0.3, momentless=True)])
def test_all_models_at_once_equal_one_after_the_other(spark, tmp_path, monkeypatch, head, opt):
    data, start, rows, models = problem(spark, head)
    monkeypatch.setattr(G, "STATE_BYTES", head.size * 8 * 2)                       # several passes
    states = G.descend(rows.repartition(4), models, head, G.soft_loss, opt, max(s[2] for s in start), str(tmp_path))
    want = plain(data, start, head, G.soft_loss, opt)
    ends = {r.gid: r.p for r in G.last_states(states).collect()}
    steps = {(r.gid, r.step): r.loss for r in states.where("step > 0 and step <= total").collect()}
    assert set(ends) == set(want)
    for g, (p, losses) in want.items():
        assert np.allclose(ends[g], p, atol=1e-9)
        assert np.allclose([steps[g, t + 1] for t in range(len(losses))], losses)
    frozen = ~head.trainable
    assert all(np.array_equal(np.array(ends[s[0]])[frozen], np.array(s[4])[frozen]) for s in start)


def test_a_stopped_run_continues(spark, tmp_path):
    head, opt = HEADS[0], G.Optimiser(0.1)
    _, start, rows, models = problem(spark, head)
    whole = G.last_states(G.descend(rows, models, head, G.soft_loss, opt, 10, f"{tmp_path}/a")).orderBy("gid").collect()
    G.descend(rows, models, head, G.soft_loss, opt, 4, f"{tmp_path}/b")
    (tmp_path / "b" / "step=4" / "_SUCCESS").unlink()                              # a step whose write failed
    assert G.last_step(spark, f"{tmp_path}/b") == 3
    again = G.last_states(G.descend(rows, models, head, G.soft_loss, opt, 10, f"{tmp_path}/b")).orderBy("gid").collect()
    assert [r.gid for r in whole] == [r.gid for r in again] and all(np.allclose(a.p, b.p) for a, b in zip(whole, again, strict=True))
    assert G.last_step(spark, f"{tmp_path}/none") is None


def test_odd_rows_are_left_out(spark, tmp_path):
    head = HEADS[0]
    data, start, rows, models = problem(spark, head)
    odd = spark.createDataFrame([(0, 0, None, [1.0, 0.0, 0.0]), (1, 0, [1.0] * 4, None), (77, 0, [1.0] * 4, [1.0, 0.0, 0.0])], rows.schema)
    state = G.start(models)
    a = {r.gid: r for r in G.gradient_sums(rows, state, head, G.soft_loss).collect()}
    b = {r.gid: r for r in G.gradient_sums(rows.unionByName(odd), state, head, G.soft_loss).collect()}
    assert set(a) == set(b) and all(a[g].n == b[g].n and np.allclose(a[g].g, b[g].g) for g in a)
    none = G.descend(rows.limit(0), models, head, G.soft_loss, G.Optimiser(0.1), 2, str(tmp_path)).where("step = 2").collect()
    assert {r.gid: r.p for r in none} == {s[0]: s[4] for s in start}
    assert G.gradient_sums(rows, state.limit(0), head, G.soft_loss).count() == 0


def test_evaluation(spark):
    head, rng = HEADS[0], np.random.default_rng(8)
    x, y = rng.normal(size=(40, 4)), rng.integers(0, 3, 40)
    params = rng.normal(size=(2, head.size))
    rows = spark.createDataFrame([("in" if i % 2 else "out", x[i].tolist(), int(y[i])) for i in range(40)], "domain string, features array<double>, label int")
    models = spark.createDataFrame([(g + 5, params[g].tolist()) for g in range(2)], "gid int, p array<double>")
    got = {(r.gid, r.domain): r for r in G.evaluate(rows.repartition(3), models, head).collect()}
    for g in range(2):
        z = head.logits(params[g], x)
        s = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        for d, mine in (("in", np.arange(40) % 2 == 1), ("out", np.arange(40) % 2 == 0)):
            r = got[g + 5, d]
            assert r.n == 20 and np.isclose(r.loss, -s[mine, y[mine]].mean()) and np.isclose(r.accuracy, (z.argmax(axis=1) == y)[mine].mean())


def test_parameters_as_a_table(spark):
    head = HEADS[1]
    models = spark.createDataFrame([(0, [float(i) for i in range(head.size)])], "gid int, p array<double>")
    rows = G.long_params(models, ["gid"], head).collect()
    assert [(r.layer, r.i, r.j) for r in sorted(rows, key=lambda r: r.value)] == (
        [("W", i, j) for i in range(3) for j in range(4)] + [("A", i, j) for i in range(2) for j in range(4)]
        + [("B", i, j) for i in range(3) for j in range(2)] + [("b", i, 0) for i in range(3)])
    assert {r.layer for r in rows if not r.trainable} == {"W"}


def test_distillation_losses_fall(spark):
    from shotgrid.plans.q_descent import context_distill
    for recursive in (False, True):
        got = context_distill(spark, SF01, recursive, 64).collect()
        assert len(got) == 4 and {r.sample_size for r in got} == {16, 64}
        assert all(0 <= r.loss < r.start_loss and r.n == r.sample_size for r in got), recursive
    whole = context_distill(spark, SF01)                       # 4096 by default: the whole pool, where it is smaller
    assert whole.agg(F.max("n")).first()[0] == 200


def test_fits_learn_and_logs_are_complete(spark, monkeypatch):
    from shotgrid.plans.q_descent import Fits
    fits = Fits(spark, SF01, "fewshot_lora", epochs=2)
    with monkeypatch.context() as m:                                # a known run is read, not trained again
        m.setattr(G, "updated", None)
        assert Fits(spark, SF01, "fewshot_lora", epochs=2).states.count() == fits.states.count()
    n = fits.grid.count()
    entries = fits.log_entries()
    per = entries.groupBy("gid").agg(F.count("loss").alias("a"), F.count("eval_loss").alias("b")).join(fits.grid, "gid").collect()
    assert len(per) == n and all(r.a == r.total + 1 and r.b == 2 + 2 for r in per)
    history = fits.history()
    assert history.count() == 2 * n and set(history.columns) == {"model_name", "sample_size", "epoch", "train_loss", "val_loss", "finetuning_method"}
    first = fits.steps().where("step = 1").agg(F.avg("loss")).first()[0]
    last = fits.steps().join(fits.grid.select("gid", "total"), "gid").where("step = total").agg(F.avg("loss")).first()[0]
    assert last < first


def test_steps_have_tasks_by_their_rows_and_not_by_the_plan(spark, tmp_path, monkeypatch):
    """A step's tasks follow the rows and the state, whatever the number of shuffle partitions and input files."""
    from shotgrid.plans import q_descent as QD
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=4).tolist(), int(rng.integers(0, 10))) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, descend = [], G.descend

    def watched(rows, models, head, loss, opt, steps, folder):
        states = descend(rows, models, head, loss, opt, 1, folder)
        seen.append((rows.count(), rows.rdd.getNumPartitions(), [spark.read.parquet(G.state_path(folder, k)).rdd.getNumPartitions() for k in (0, 1)]))
        raise InterruptedError

    monkeypatch.setattr(G, "descend", watched)
    monkeypatch.setattr(G, "ROWS_PER_TASK", 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        for run in (lambda: QD.Fits(spark, str(tmp_path), folder=f"{tmp_path}/a"), lambda: QD.context_distill(spark, str(tmp_path), folder=f"{tmp_path}/b"),
                    lambda: QD.context_distill(spark, str(tmp_path), True, folder=f"{tmp_path}/c")):
            with pytest.raises(InterruptedError):
                run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [n for n, _, _ in seen] == [600, 512, 512]          # 2 models x 300 draws, 2 models x (16 + 240 of the pool)
    assert all(parts <= 2 and files == [1, 1] for _, parts, files in seen)


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("opt", [G.Optimiser(0.05, decay=0.02), G.Optimiser(0.3, momentless=True)])
def test_small_batches_in_blocks_equal_one_after_the_other(spark, tmp_path, monkeypatch, head, opt):
    """Steps of small batches taken a block at a time are those of one batch after the other; a stopped run continues."""
    data, start, rows, models = problem(spark, head, batch=2, epochs=1)             # 12, 10 and 8 steps
    odd = [(0, 0, None, [1.0, 0.0, 0.0]), (1, 0, [1.0] * 4, None), (1, 3, [1.0] * 4, [None, 0.0, 0.0]), (2, 1, [1.0, None, 1.0, 1.0], [1.0, 0.0, 0.0]),
           (77, 0, [1.0] * 4, [1.0, 0.0, 0.0]), (2, 9, [1.0] * 4, [1.0, 0.0, 0.0])]  # and rows of no model, or behind its steps
    monkeypatch.setattr(G, "BLOCK_STEPS", 5)
    blocks = G.in_blocks(rows.unionByName(spark.createDataFrame(odd, rows.schema)).repartition(4), len(data))
    assert {r.block for r in blocks.select("block").distinct().collect()} == {0, 1, 2}
    want = plain(data, start, head, G.soft_loss, opt)
    for again in (False, True):
        if again:
            (tmp_path / "step=2" / "_SUCCESS").unlink()
        states = G.descend_in_blocks(blocks, models, head, G.soft_loss, opt, str(tmp_path))
        ends = {r.gid: r.p for r in G.last_states(states).collect()}
        assert set(ends) == set(want) and all(np.allclose(ends[g], want[g][0], atol=1e-9) for g in want)
    got = {(r.gid, r.step): r for r in states.collect()}
    assert set(got) == {(0, 0), (0, 5), (0, 10), (0, 12), (1, 0), (1, 5), (1, 10), (2, 0), (2, 5), (2, 8)}
    assert got[0, 12].n == 3 and got[2, 8].n == 5 and got[0, 0].n is None
    assert got[1, 10].n == 9 and np.isclose(got[1, 10].loss, np.average(want[1][1][5:], weights=[2, 2, 2, 2, 1]))
    assert G.gradient_sums(blocks, G.start(models), head, G.soft_loss).count() == 3


def test_the_grid_distils_the_whole_pool(spark, tmp_path, monkeypatch):
    """Both distillations of the grid take all rows of the pool, also of one above 4096 rows, and a step for every two or four."""
    from shotgrid.plans import experiment as X
    from shotgrid.plans import q_descent as QD
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(30)])
    documents = [(i, " ".join(rng.choice(words, 6)) + "\n" + " ".join(rng.choice(words, 6)), "en" if i % 3 else "fr", "s", 40) for i in range(480)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(480)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i, rng.normal(size=3).tolist(), int(rng.integers(0, 10))) for i in range(10_280)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")

    class NoFits:
        def __init__(self, *_):
            pass

        def metrics(self):
            return spark.createDataFrame([], "model_name string, sample_size int, trial int")

    seen, distill = [], QD.context_distill

    def watched(*args, **kwargs):
        out = distill(*args, **kwargs).cache()
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(QD, "Fits", NoFits)
    monkeypatch.setattr(QD, "context_distill", watched)
    log = X.experiment_grid(spark, str(tmp_path)).where("finetuning_method like '%context_distillation'").collect()
    pool = 10_280 * 2 // 5
    assert sorted((r.finetuning_method, r.model_name, r.sample_size) for r in log) == sorted(
        (f"{kind}context_distillation", m, n) for kind in ("", "recursive_") for m in ("head-large", "head-small") for n in (16, pool))
    assert all(r.n == r.sample_size and r.steps == r.sample_size // (2 if r.model_name == "head-large" else 4) for r in seen)
    assert len(seen) == 8 and pool > 4096
