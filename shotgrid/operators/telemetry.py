"""Training-loop telemetry as a prefix scan.

The reference tags memory readings with a stateful callback.  Here the callback's events are a table
``(run, event_id, ts, kind, memory)`` in (ts, event_id) order within a run.  Kinds: train_begin, train_end,
stop (the trainer's signal that training should stop), prediction_step, log; others only carry memory.  The
callback's state is small: training, stopping or neither; whether evaluation has started since the last
tagged log; the number of tagged logs; the peak memory since the last reset.

Events are range-partitioned by (run, ts, event_id), so a run that holds a third of all events is many
chunks, one per partition.  A chunk's effect on the state is a transition: for each state it may be entered in,
the state it leaves and the logs it adds.  Transitions are found for all chunks at once (pass in), composed along
each run over a table of one row per chunk, and give the state at every chunk's start; with that, running
sums and maxima inside the chunk give every row's state (pass out).  Peak memory is carried the same way.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotgrid.session import cut_lineage

CHUNK_ROWS = 1_000_000
#: States a chunk may be entered in, with (training, stopping); while not training, stopping doesn't matter.
IDLE, TRAINING, STOPPING = 0, 1, 2
_ENTRY = {IDLE: (0, 0), TRAINING: (1, 0), STOPPING: (1, 1)}


def _so_far(c: Column, before: bool = False) -> Column:
    """The running aggregate ``c`` inside the chunk, up to this row or to the one before it."""
    return c.over(Window.partitionBy("run", "chunk").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1 if before else 0))


def _tagged(training: Column, stopping: Column) -> Column:
    """A log that the callback tags: training is over or about to stop."""
    return (F.col("kind") == "log") & ((training == 0) | (stopping == 1))


def _predicting(training: Column) -> Column:
    return (F.col("kind") == "prediction_step") & (training == 0)


def _state(training: Column, stopping: Column) -> Column:
    return F.when(training == 0, IDLE).when(stopping == 1, STOPPING).otherwise(TRAINING)


def in_chunks(tel: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The events with their chunk, and what the chunk's own markers so far say of training and stopping (null:
    nothing).  Written to the shared folder, so a chunk is the same rows in every later pass."""
    parts = max(int(tel.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(tel.count() / chunk_rows))
    x = tel.select("run", "event_id", "ts", F.coalesce("kind", F.lit("")).alias("kind"), "memory") \
        .repartitionByRange(parts, "run", "ts", "event_id").withColumn("chunk", F.spark_partition_id())
    training = F.when(F.col("kind") == "train_begin", 1).when(F.col("kind") == "train_end", 0)
    stopping = F.when(F.col("kind") == "train_begin", 0).when(F.col("kind") == "stop", 1)
    return cut_lineage(x.withColumn("own_t", _so_far(F.last(training, ignorenulls=True)))
                        .withColumn("own_s", _so_far(F.last(stopping, ignorenulls=True))))


def transitions(x: DataFrame) -> DataFrame:
    """One row per (run, chunk): for each state of entry, the state at the chunk's end (``st_``), the tagged logs
    (``n_``), and whether evaluation has started at its end (``e_``; null: as it was)."""
    at, out = F.struct("ts", "event_id"), []
    last = F.max_by(F.struct("own_t", "own_s"), at)
    for k, (t0, s0) in _ENTRY.items():
        t, s = F.coalesce("own_t", F.lit(t0)), F.coalesce("own_s", F.lit(s0))
        log, pred = F.max(F.when(_tagged(t, s), at)), F.max(F.when(_predicting(t), at))
        out += [_state(F.coalesce(last["own_t"], F.lit(t0)), F.coalesce(last["own_s"], F.lit(s0))).alias(f"st_{k}"),
                F.sum(_tagged(t, s).cast("long")).alias(f"n_{k}"),
                F.when(log.isNull(), F.when(pred.isNotNull(), True)).otherwise(F.coalesce(pred > log, F.lit(False))).alias(f"e_{k}")]
    return x.groupBy("run", "chunk").agg(*out)


def entries(changes: DataFrame) -> DataFrame:
    """(run, chunk, st, started, logs): the state at each chunk's start, from the transitions of a run's chunks
    one after another.  A run has at most one row per partition of the events here."""
    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        st, started, logs, out = IDLE, False, 0, []
        for r in rows:
            out.append({"run": r["run"], "chunk": r["chunk"], "st": st, "started": started, "logs": logs})
            started = started if r[f"e_{st}"] is None else r[f"e_{st}"]
            st, logs = r[f"st_{st}"], logs + r[f"n_{st}"]
        return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field("run"), ("chunk", pa.int32()), ("st", pa.int32()),
                                                           ("started", pa.bool_()), ("logs", pa.int64())]))

    run = changes.schema["run"].dataType.simpleString()
    return changes.groupBy("run").applyInArrow(compose, f"run {run}, chunk int, st int, started boolean, logs long")


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joins on (run, chunk); a null run is a run."""
    b = b.withColumnsRenamed({"run": "b_run", "chunk": "b_chunk"})
    return a.join(b, F.col("run").eqNullSafe(F.col("b_run")) & (F.col("chunk") == F.col("b_chunk"))).drop("b_run", "b_chunk")


def with_state(tel: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``is_training``, ``qualifying`` (a tagged log), ``log_no``, ``pred`` (a prediction step after training),
    ``reset`` and ``seg`` (resets so far in the chunk)."""
    x = in_chunks(tel, chunk_rows)
    x = _same(x, entries(transitions(x)))
    t = F.coalesce("own_t", (F.col("st") != IDLE).cast("int"))
    s = F.coalesce("own_s", (F.col("st") == STOPPING).cast("int"))
    x = x.withColumns({"is_training": t == 1, "qualifying": _tagged(t, s), "pred": _predicting(t)})
    x = x.withColumn("log_no", F.col("logs") + _so_far(F.sum(F.col("qualifying").cast("long")))) \
         .withColumn("preds", _so_far(F.sum(F.col("pred").cast("long"))))
    # prediction steps at the last tagged log before: they only grow, so it is a running maximum
    x = x.withColumn("preds_then", _so_far(F.max(F.when(F.col("qualifying"), F.col("preds"))), before=True))
    first = F.when(F.col("preds_then").isNull(), (F.col("preds") == 1) & ~F.col("started")).otherwise(F.col("preds") - F.col("preds_then") == 1)
    x = x.withColumn("reset", (F.col("kind") == "train_begin") | (F.col("pred") & first))
    return x.withColumn("seg", _so_far(F.sum(F.col("reset").cast("long")))).drop("own_t", "own_s", "st", "started", "logs", "preds", "preds_then")


def phase_of(log_no, val_in_training: bool):
    """Phase of the k-th log after training; ``None`` for the skipped ones."""
    k = F.col(log_no) if isinstance(log_no, str) else log_no
    first = 3 if val_in_training else 1
    return (F.when(k == first, F.lit("train"))
             .when(k == first + 1, F.lit("eval_in"))
             .when(k > first + 1, F.lit("eval_out")))


def phase_tags(tel: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every log event after training with its number and phase in both modes."""
    s = with_state(tel, chunk_rows).filter("qualifying")
    return s.select("run", "event_id", "ts", "log_no",
                    phase_of("log_no", True).alias("phase_val"),
                    phase_of("log_no", False).alias("phase_noval"))


def _peaks_before(x: DataFrame) -> DataFrame:
    """(run, chunk, peak): the highest memory since the last reset at each chunk's start."""
    each = x.groupBy("run", "chunk").agg(F.max("seg").alias("seg"), F.max(F.when(F.col("seg") == 0, F.col("memory"))).alias("head"),
                                         F.max(F.struct("seg", "memory"))["memory"].alias("tail"))

    def compose(table: pa.Table) -> pa.Table:
        peak, out = None, []
        for r in table.sort_by("chunk").to_pylist():
            out.append({"run": r["run"], "chunk": r["chunk"], "peak": peak})
            peak = r["tail"] if r["seg"] else max((m for m in (peak, r["head"]) if m is not None), default=None)
        return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field("run"), ("chunk", pa.int32()), ("peak", pa.float64())]))

    run = x.schema["run"].dataType.simpleString()
    return each.groupBy("run").applyInArrow(compose, f"run {run}, chunk int, peak double")


def phase_peaks(tel: DataFrame, val_in_training: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Peak memory reported at each tagged log: the running maximum since the last reset."""
    s = with_state(tel, chunk_rows).withColumn("memory", F.col("memory").cast("double"))
    # segments only grow inside a chunk, so the largest (segment, memory) so far is the segment's peak so far
    s = s.withColumn("own_peak", _so_far(F.max(F.struct("seg", "memory")))["memory"])
    s = cut_lineage(s.select("run", "chunk", "event_id", "memory", "qualifying", "log_no", "seg", "own_peak"))
    tagged = s.filter("qualifying").withColumn("phase", phase_of("log_no", val_in_training)).filter(F.col("phase").isNotNull())
    tagged = _same(tagged, _peaks_before(s))
    peak = F.when(F.col("seg") == 0, F.greatest("own_peak", "peak")).otherwise(F.col("own_peak"))
    return tagged.select("run", "event_id", "log_no", "phase", peak.alias("peak_memory"))


def epoch_micros(ts: str):
    """Microseconds since 1970-01-01 of a timestamp column, without the session time zone
    (event times are wall-clock TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")),
                            F.col(ts).cast("timestamp_ntz"))


def throughput(tel: DataFrame, step_kind: str = "prediction_step") -> DataFrame:
    """Samples per second of each run = steps / (last event - first event)."""
    us = epoch_micros("ts")
    g = tel.groupBy("run").agg(F.sum((F.col("kind") == step_kind).cast("long")).alias("n_steps"),
                               ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("runtime"))
    return g.withColumn("samples_per_second",
                        F.when(F.col("runtime") > 0, F.col("n_steps") / F.col("runtime")))
