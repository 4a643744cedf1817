"""Gradient descent as Spark jobs, for all models of an experiment at once.

A model is a row ``(gid, p)`` of a state table, ``p`` its parameters as one array.  One step is one job:

* forward and backward: an Arrow pass over the step's rows adds up, per task and model, the gradient,
  the loss and the number of rows; a grouped vector sum (partial aggregation, so a model trained on
  all rows moves one vector per task) merges them;
* update: the state table joined with the sums, as array expressions: learning rate by the schedule,
  moment estimates, decay, frozen parameters left alone;
* the new state is written below the run's folder and read back, so the next step starts from files:
  a lost executor costs tasks of one step, and a run that was stopped continues from its last
  complete step.

Models train on their own rows (``rows.gid``) and in their own micro-batches: a model's step t uses the
rows whose ``slot`` is t modulo its steps per epoch, and a model whose steps are done stays as it is.
Batches of a few rows make thousands of dependent steps: ``descend_in_blocks`` takes BLOCK_STEPS of them in one
job, the rows of a model's block in one task, and writes the states between blocks as above.
What is broadcast is the state: models x parameters, set by the experiment's grid and the number of
features and not by the rows; more than ``STATE_BYTES`` of it goes in several passes.

Defined cases: a row with a null feature vector or target is left out; a model without rows in a step
keeps its state; a step of which no model has rows writes the same state again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotgrid.functions.math import linear_schedule
from shotgrid.session import fresh_path, is_complete

STATE_BYTES = 256 << 20
STATE_FILE_BYTES = 32 << 20       # of a state per file, and so per task of an update
ROWS_PER_TASK = 2048             # of training rows that a table of bounded size is dealt out by
BLOCK_STEPS = 4096               # steps of a model that one task takes one after the other


# --------------------------------------------------------------------------- heads
@dataclass(frozen=True)
class SoftmaxHead:
    """``z = W x + b``; p holds W row by row, then b."""
    classes: int
    features: int

    @property
    def size(self) -> int:
        return self.classes * (self.features + 1)

    @property
    def trainable(self) -> np.ndarray:
        return np.ones(self.size, bool)

    def weights(self, p: np.ndarray) -> np.ndarray:
        return p[:self.classes * self.features].reshape(self.classes, self.features)

    def logits(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights(p).T + p[-self.classes:]

    def slope(self, p: np.ndarray, x: np.ndarray, dz: np.ndarray) -> np.ndarray:
        """Gradient by p of sum(dz * logits)."""
        return np.concatenate([(dz.T @ x).ravel(), dz.sum(axis=0)])


@dataclass(frozen=True)
class LowRankHead(SoftmaxHead):
    """``z = (W0 + scale B A) x + b`` with W0 frozen; p holds W0, A (rank x features), B (classes x rank), b.
    B starts at 0, so the model starts as its base."""
    rank: int = 4
    alpha: float = 16.0

    @property
    def scale(self) -> float:
        return self.alpha / self.rank

    @property
    def size(self) -> int:
        return self.classes * self.features + self.rank * (self.features + self.classes) + self.classes

    @property
    def trainable(self) -> np.ndarray:
        return np.arange(self.size) >= self.classes * self.features

    def factors(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.classes * self.features, self.rank * self.features
        return p[at:at + n].reshape(self.rank, self.features), p[at + n:-self.classes].reshape(self.classes, self.rank)

    def weights(self, p: np.ndarray) -> np.ndarray:
        a, b = self.factors(p)
        return super().weights(p) + self.scale * b @ a

    def slope(self, p: np.ndarray, x: np.ndarray, dz: np.ndarray) -> np.ndarray:
        a, b = self.factors(p)
        full = dz.T @ x                                   # by the merged weights
        return np.concatenate([np.zeros(full.size), (self.scale * b.T @ full).ravel(), (self.scale * full @ a.T).ravel(), dz.sum(axis=0)])


# --------------------------------------------------------------------------- losses
def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def soft_loss(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss per row, its derivative by z): sum of q (log q - log softmax z).  For one-hot targets that
    is cross-entropy, for a teacher's probabilities the distillation loss."""
    s = _log_softmax(z)
    own = np.where(target > 0, target * np.log(np.where(target > 0, target, 1.0)), 0.0)
    return (own - target * s).sum(axis=1), np.exp(s) * target.sum(axis=1, keepdims=True) - target


def self_loss(z: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distillation loss where the teacher is the student itself with ``evidence`` added to its logits,
    and nothing is held fixed: with q = softmax(z + e) the derivative has the student's part
    softmax(z) - q and the teacher's part q_k (log q_k - log softmax(z)_k - loss)."""
    s, t = _log_softmax(z), _log_softmax(z + evidence)
    q = np.exp(t)
    loss = (q * (t - s)).sum(axis=1)
    return loss, np.exp(s) - q + q * (t - s - loss[:, None])


# --------------------------------------------------------------------------- one step
@dataclass(frozen=True)
class Optimiser:
    """Adam with decoupled weight decay under the linear schedule (S1); ``momentless`` is plain descent."""
    rate: float
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.0
    momentless: bool = False


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _models(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gids rising, parameters) of a state table."""
    table = state.select("gid", "p").toArrow()
    gids = table["gid"].to_numpy()
    order = np.argsort(gids)
    return gids[order], table["p"].combine_chunks().flatten().to_numpy().reshape(len(gids), -1)[order] if len(gids) else np.zeros((0, 0))


def _passes(state: DataFrame, head: SoftmaxHead, models: int | None = None) -> Iterator[DataFrame]:
    """The state (of so many models) in parts of at most STATE_BYTES."""
    parts = math.ceil((state.count() if models is None else models) * head.size * 8 / STATE_BYTES)
    for k in range(parts):
        yield state if parts == 1 else state.where(F.pmod("gid", F.lit(parts)) == k)


def gradient_sums(rows: DataFrame, state: DataFrame, head: SoftmaxHead, loss, models: int | None = None) -> DataFrame:
    """(gid, g, loss, n): sums over each model's rows (gid, features, target) of gradient and loss.  ``models``: how
    many models the state has, where that is known."""
    schema = "gid int, g array<double>, loss double, n long"
    usable = rows.where(F.col("features").isNotNull() & F.col("target").isNotNull()).select("gid", "features", "target")
    out = None
    for part in _passes(state, head, models):
        shared = rows.sparkSession.sparkContext.broadcast(_models(part))

        def run(batches, shared=shared):
            gids, params = shared.value
            total, losses, seen = np.zeros(params.shape), np.zeros(len(gids)), np.zeros(len(gids), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                gid, x = batch.column(0).to_numpy(), _vectors(batch.column(1), head.features)
                target = _vectors(batch.column(2), head.classes)
                at = np.minimum(np.searchsorted(gids, gid), len(gids) - 1)
                at = np.where(gids[at] == gid, at, -1)               # models of another pass
                for k in np.unique(at[at >= 0]):
                    mine = at == k
                    each, dz = loss(head.logits(params[k], x[mine]), target[mine])
                    total[k] += head.slope(params[k], x[mine], dz)
                    losses[k] += each.sum()
                    seen[k] += mine.sum()
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(gids[some], pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64())),
                                              pa.array(losses[some]), pa.array(seen[some])], names=["gid", "g", "loss", "n"])

        sums = usable.mapInArrow(run, schema)
        out = sums if out is None else out.unionByName(sums)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    return out.groupBy("gid").agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")) \
        .select("gid", vector_to_array("g").alias("g"), "loss", "n")


def updated(state: DataFrame, sums: DataFrame, step: int, opt: Optimiser, trainable: Sequence[bool]) -> DataFrame:
    """The state after step ``step`` (from 0); ``sums`` has at most a row per model."""
    s = state.select("gid", "spe", "total", "warm", "p", "m", "v").join(F.broadcast(sums), "gid", "left")
    s = s.withColumn("rate", linear_schedule(F.lit(step), F.col("total"), F.col("warm"), opt.rate)).withColumn("g", F.expr("transform(g, x -> x / n)"))
    if opt.momentless:
        m, v, change = "m", "v", "g"
    else:
        s = s.withColumns({"m2": F.expr(f"zip_with(m, g, (a, x) -> a * {opt.beta1!r}D + x * {1 - opt.beta1!r}D)"),
                           "v2": F.expr(f"zip_with(v, g, (a, x) -> a * {opt.beta2!r}D + x * x * {1 - opt.beta2!r}D)")})
        m, v = "m2", "v2"
        change = f"zip_with(m2, v2, (a, b) -> (a / {1 - opt.beta1 ** (step + 1)!r}D) / (sqrt(b / {1 - opt.beta2 ** (step + 1)!r}D) + {opt.eps!r}D))"
    moved = f"zip_with(p, {change}, (x, c) -> x - rate * (c + x * {opt.decay!r}D))"
    frozen = [k for k, t in enumerate(trainable) if not t]
    if frozen:                                            # the frozen parameters come first
        moved = f"concat(slice(p, 1, {len(frozen)}), slice({moved}, {len(frozen) + 1}, {len(trainable) - len(frozen)}))"
    s = s.withColumn("moved", F.expr(moved))
    return s.selectExpr("gid", "spe", "total", "warm", "if(n is null, p, moved) as p", f"if(n is null, m, {m}) as m", f"if(n is null, v, {v}) as v",
                        "if(n is null, null, rate) as rate", "sqrt(aggregate(g, 0D, (acc, x) -> acc + x * x)) as grad_norm", "loss / n as loss", "n")


def start(models: DataFrame) -> DataFrame:
    """State before the first step of models (gid, spe, total, warm, p)."""
    zero = F.transform("p", lambda x: F.lit(0.0))
    return models.select("gid", "spe", "total", "warm", "p", zero.alias("m"), zero.alias("v"), F.lit(None).cast("double").alias("rate"),
                         F.lit(None).cast("double").alias("grad_norm"), F.lit(None).cast("double").alias("loss"), F.lit(None).cast("long").alias("n"))


# --------------------------------------------------------------------------- a run
def dealt(rows: DataFrame, count: int) -> DataFrame:
    """``rows``, at most ``count`` of them, in as many partitions as they need: every step starts a task for each, and
    those of the plan they come from grow with the tables it reads."""
    return rows.repartition(max(1, math.ceil(count / ROWS_PER_TASK)))


STATE = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("gid", "spe", "total", "warm")],
                      *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("p", "m", "v")],
                      *[T.StructField(c, T.DoubleType()) for c in ("rate", "grad_norm", "loss")], T.StructField("n", T.LongType())])


def state_path(folder: str, step: int) -> str:
    return f"{folder}/step={step}"


def last_step(spark: SparkSession, folder: str) -> int | None:
    """The last step of a run that was written in full, if any."""
    step = None
    while is_complete(spark, state_path(folder, 0 if step is None else step + 1)):
        step = 0 if step is None else step + 1
    return step


def _state_files(models: int, head: SoftmaxHead) -> int:
    return max(1, math.ceil(models * head.size * 24 / STATE_FILE_BYTES))               # p, m and v


def _begun(models: DataFrame, head: SoftmaxHead, count: int, folder: str) -> int:
    """The last written state of the run below ``folder``; a new run's start is written."""
    done = last_step(models.sparkSession, folder)
    if done is None:
        start(models).select(*[F.col(f.name).cast(f.dataType) for f in STATE.fields]).repartition(_state_files(count, head)) \
            .write.mode("overwrite").parquet(state_path(folder, 0))
    return done or 0


def _state(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(state_path(folder, step))


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """One scan with the step as partition column."""
    return spark.read.schema(T.StructType([*STATE.fields, T.StructField("step", T.IntegerType())])).parquet(folder)


def descend(rows: DataFrame, models: DataFrame, head: SoftmaxHead, loss, opt: Optimiser, steps: int, folder: str) -> DataFrame:
    """F9, ``steps`` times: trains the models (gid, spe, total, warm, p) on rows (gid, slot, features, target).
    Returns the states of all steps, ``step`` 0 being the start: loss, n, rate and grad_norm of a state are
    those of the step that led to it.  A folder with states of an earlier run is continued."""
    spark = rows.sparkSession
    count = models.count()
    done = _begun(models, head, count, folder)
    plan = models.select("gid", "spe", "total")           # one row per model of the grid
    rows = rows.join(plan, "gid").select("gid", "slot", "spe", "total", "features", "target")

    for step in range(done, steps):
        state = _state(spark, folder, step)
        now = rows.where((F.col("slot") == F.lit(step) % F.col("spe")) & (F.lit(step) < F.col("total")))
        updated(state, gradient_sums(now, state, head, loss, count), step, opt, head.trainable.tolist()) \
            .write.mode("overwrite").parquet(state_path(folder, step + 1))
    return _states(spark, folder).where(F.col("step") <= steps)


def in_blocks(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (gid, slot, features, target), about ``count`` of them, written by blocks of BLOCK_STEPS slots and read
    back with their ``block``: the job of a block opens its own files only.  Left out are rows whose vector or target is
    null or holds a null."""
    path = fresh_path(rows.sparkSession, "blocks")
    whole = F.forall("features", lambda x: x.isNotNull()) & F.forall("target", lambda x: x.isNotNull())
    blocks = rows.where(whole).withColumn("block", F.floor(F.col("slot") / BLOCK_STEPS).cast("int"))
    blocks.repartition(max(1, math.ceil(count / ROWS_PER_TASK)), "block", "gid").write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema(blocks.schema).parquet(path)


def _block_steps(head: SoftmaxHead, loss, opt: Optimiser):
    """(a model's rows of a block, its state) -> its state after the block's steps."""
    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:                            # rows of no model
            return state
        was = state.to_pylist()[0]
        p, m, v, total, warm = np.array(was["p"]), np.array(was["m"]), np.array(was["v"]), was["total"], was["warm"]
        slot = rows["slot"].to_numpy()
        order = np.argsort(slot, kind="stable")
        order = order[slot[order] < total]
        slot = slot[order]
        x, target = (_vectors(rows[c].combine_chunks(), width)[order] for c, width in (("features", head.features), ("target", head.classes)))
        rate = norm = None
        losses, begin, trainable = 0.0, 0, head.trainable
        for end in [*(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)] if len(slot) else ():
            step = int(slot[begin])
            each, dz = loss(head.logits(p, x[begin:end]), target[begin:end])
            change = g = head.slope(p, x[begin:end], dz) / (end - begin)
            if not opt.momentless:
                m, v = m * opt.beta1 + g * (1 - opt.beta1), v * opt.beta2 + g * g * (1 - opt.beta2)
                change = (m / (1 - opt.beta1 ** (step + 1))) / (np.sqrt(v / (1 - opt.beta2 ** (step + 1))) + opt.eps)
            rate = opt.rate * (step / max(warm, 1) if step < warm else max(0.0, (total - step) / max(total - warm, 1)))
            p = np.where(trainable, p - rate * (change + opt.decay * p), p)
            losses, norm, begin = losses + each.sum(), math.sqrt(g @ g), end
        now = was | {"p": p, "m": m, "v": v, "rate": rate, "grad_norm": norm, "loss": losses / len(slot) if len(slot) else None, "n": len(slot) or None}
        return pa.Table.from_pylist([now], state.schema)

    return run


def descend_in_blocks(rows: DataFrame, models: DataFrame, head: SoftmaxHead, loss, opt: Optimiser, folder: str) -> DataFrame:
    """F9 over one epoch of batches of a few rows: a model's step t takes its rows of slot t, for all its ``total`` steps.  Each
    step needs the one before, so a job takes the steps of a block, all models side by side.  ``rows`` are those of ``in_blocks``.
    Returns each model's states after its blocks, ``step`` 0 being the start and then the steps taken; loss and n are those of
    the block's rows, rate and grad_norm those of its last step.  A folder with states of an earlier run is continued."""
    spark = rows.sparkSession
    count, steps = models.agg(F.count(F.lit(1)), F.max("total")).first()
    done = _begun(models, head, count, folder)
    for block in range(done, math.ceil((steps or 0) / BLOCK_STEPS)):
        now = rows.where(F.col("block") == block).select("gid", "slot", "features", "target")
        now.groupBy("gid").cogroup(_state(spark, folder, block).groupBy("gid")).applyInArrow(_block_steps(head, loss, opt), STATE) \
            .repartition(_state_files(count, head)).write.mode("overwrite").parquet(state_path(folder, block + 1))
    mine = (F.col("step") - 1) * BLOCK_STEPS < F.col("total")          # a model whose steps are done stays as it is
    return _states(spark, folder).where(mine).withColumn("step", F.least(F.col("step") * BLOCK_STEPS, F.col("total")))


def last_states(states: DataFrame) -> DataFrame:
    """Each model's state after its last step (gid, p, step)."""
    return states.where(F.col("step") == F.col("total")).select("gid", "p", "step")


def evaluate(rows: DataFrame, models: DataFrame, head: SoftmaxHead, by: str = "domain") -> DataFrame:
    """(gid, ``by``, n, loss, accuracy) of every model (gid, p) on all rows (by, features, label): mean
    cross-entropy, and the share whose largest logit (ties: the first) is the label.  One pass for all models."""
    schema = f"gid int, {by} string, n long, loss double, correct long"
    out = None
    for part in _passes(models, head):
        shared = rows.sparkSession.sparkContext.broadcast(_models(part))

        def run(batches, shared=shared):
            gids, params = shared.value
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                group, x, y = np.array(batch.column(0).to_pylist(), object), _vectors(batch.column(1), head.features), batch.column(2).to_numpy()
                for g in set(group.tolist()):
                    mine = np.flatnonzero(group == g)
                    at = sums.setdefault(g, np.zeros((len(gids), 3)))
                    for k in range(len(gids)):
                        s = _log_softmax(head.logits(params[k], x[mine]))
                        at[k] += len(mine), -s[np.arange(len(mine)), y[mine]].sum(), (s.argmax(axis=1) == y[mine]).sum()
            for g, at in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int32()), pa.array([g] * len(gids), pa.string()), pa.array(at[:, 0].astype(np.int64)),
                                                  pa.array(at[:, 1]), pa.array(at[:, 2].astype(np.int64))], names=["gid", by, "n", "loss", "correct"])

        usable = rows.where(F.col("features").isNotNull() & F.col("label").isNotNull()).select(by, "features", F.col("label").cast("int").alias("label"))
        sums = usable.mapInArrow(run, schema)
        out = sums if out is None else out.unionByName(sums)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"gid int, {by} string, n long, loss double, accuracy double")
    return out.groupBy("gid", by).agg(F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("loss"),
                                      (F.sum("correct") / F.sum("n")).alias("accuracy"))


def long_params(states: DataFrame, keys: Sequence[str], head: SoftmaxHead) -> DataFrame:
    """A state's parameters as a long table (keys, layer, i, j, value, trainable)."""
    layers = [("W", head.classes, head.features)]
    if isinstance(head, LowRankHead):
        layers += [("A", head.rank, head.features), ("B", head.classes, head.rank)]
    layers.append(("b", head.classes, 1))
    layer = i = j = trainable = None
    begin = 0
    for name, height, width in layers:
        at, here = F.col("pos") - begin, F.col("pos") < begin + height * width
        begin += height * width

        def case(old: Column | None, value: Column, here=here) -> Column:
            return F.when(here, value) if old is None else F.when(old.isNull() & here, value).otherwise(old)

        layer, i, j = case(layer, F.lit(name)), case(i, F.floor(at / width).cast("int")), case(j, (at % width).cast("int"))
        trainable = case(trainable, F.lit(not (name == "W" and isinstance(head, LowRankHead))))
    return states.select(*keys, F.posexplode("p").alias("pos", "value")).select(
        *keys, layer.alias("layer"), i.alias("i"), j.alias("j"), "value", trainable.alias("trainable"))
