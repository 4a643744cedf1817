"""Phase tagging and peak memory on a hand-written event sequence."""

import datetime as dt
import random

import pytest

from shotgrid.operators import telemetry as TL


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    seq = [("log", 1.0), ("train_begin", 2.0), ("log", 9.0), ("prediction_step", 3.0), ("log", 4.0),
           ("train_end", 1.0), ("log", 5.0), ("log", 6.0), ("prediction_step", 2.0), ("prediction_step", 7.0),
           ("log", 1.0), ("prediction_step", 3.0), ("log", 2.0), ("log", 8.0)]
    rows = [(1, i, t0 + dt.timedelta(seconds=i), k, m) for i, (k, m) in enumerate(seq)]
    return spark.createDataFrame(rows, "run long, event_id long, ts timestamp, kind string, memory double")


def test_phase_tags_both_modes(spark):
    got = [(r["event_id"], r["log_no"], r["phase_val"], r["phase_noval"])
           for r in TL.phase_tags(events(spark)).orderBy("event_id").collect()]
    # logs during training (events 2, 4) do not count; the first log (before training) does
    assert got == [(0, 1, None, "train"), (6, 2, None, "eval_in"), (7, 3, "train", "eval_out"),
                   (10, 4, "eval_in", "eval_out"), (12, 5, "eval_out", "eval_out"), (13, 6, "eval_out", "eval_out")]


def test_phase_peaks_reset_rules(spark):
    got = {r["event_id"]: r["peak_memory"] for r in TL.phase_peaks(events(spark), False).collect()}
    # segment from train_begin (event 1) runs to the first post-training prediction step (8)
    assert got[0] == 1.0
    assert got[6] == 9.0 and got[7] == 9.0
    # reset at event 8 (first prediction step after the last tagged log): max(2, 7) -> 7
    assert got[10] == 7.0
    # reset at event 11: max(3, 2, 8) -> 3 at event 12, 8 at event 13 (no new prediction step)
    assert got[12] == 3.0 and got[13] == 8.0


def test_throughput(spark):
    r = TL.throughput(events(spark)).first()
    assert r["n_steps"] == 4 and r["runtime"] == 13.0


def test_chunked_state_equals_unchunked(spark):
    """Chunk carries (a hot run split into many pieces) don't change the answers."""
    ev = events(spark)
    for fn in (TL.phase_tags, lambda t, c: TL.phase_peaks(t, False, c)):
        whole = sorted(map(tuple, fn(ev, 1_000_000).collect()))
        for c in (1, 2, 3, 5):
            assert sorted(map(tuple, fn(ev, c).collect())) == whole


class Callback:
    """The callback itself, event by event."""

    def __init__(self):
        self.training = self.stopping = self.started = False
        self.logs, self.peak = 0, None

    def take(self, kind, memory):
        """Number and peak of a tagged log, or None."""
        if kind == "train_begin":
            self.training, self.stopping, self.peak = True, False, None
        elif kind == "train_end":
            self.training = False
        elif kind == "stop":
            self.stopping = True
        elif kind == "prediction_step" and not self.started and not self.training:
            self.started, self.peak = True, None
        if memory is not None:
            self.peak = memory if self.peak is None else max(self.peak, memory)
        if kind == "log" and (not self.training or self.stopping):
            self.logs, self.started = self.logs + 1, False
            return self.logs, self.peak
        return None


def random_events(seed, n=400, runs=4):
    rng = random.Random(seed)
    kinds = ["train_begin", "train_end", "stop", "prediction_step", "prediction_step", "log", "log", "step", None]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(None if r == 0 else r, i, t0 + dt.timedelta(seconds=rng.randrange(n // 2)), rng.choice(kinds),
             None if rng.random() < 0.1 else float(rng.randrange(100))) for i in range(n) for r in [rng.choice([0, 1, 1, 1, 2, 3][:runs + 2])]]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("chunk", [1_000_000, 40, 7])
def test_prefix_scan_equals_the_callback(spark, seed, chunk):
    rows = random_events(seed)
    want, calls = {}, {}
    for run, event, _, kind, memory in sorted(rows, key=lambda r: (r[2], r[1])):
        got = calls.setdefault(run, Callback()).take(kind, memory)
        if got:
            want[event] = got
    df = spark.createDataFrame(rows, "run long, event_id long, ts timestamp, kind string, memory double")
    tags = {r.event_id: r.log_no for r in TL.phase_tags(df, chunk).collect()}
    assert tags == {e: n for e, (n, _) in want.items()}
    peaks = {r.event_id: (r.log_no, r.peak_memory) for r in TL.phase_peaks(df, False, chunk).collect()}
    assert peaks == want


def test_stop_signal_opens_the_logs(spark):
    t0 = dt.datetime(2024, 1, 1)
    seq = ["train_begin", "log", "stop", "log", "train_end", "log", "train_begin", "log"]
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=i), k, 1.0) for i, k in enumerate(seq)],
                               "run long, event_id long, ts timestamp, kind string, memory double")
    assert sorted((r.event_id, r.log_no) for r in TL.phase_tags(df).collect()) == [(3, 1), (5, 2)]


def test_empty_telemetry(spark):
    df = spark.createDataFrame([], "run long, event_id long, ts timestamp, kind string, memory double")
    assert TL.phase_tags(df).count() == 0 and TL.phase_peaks(df).count() == 0
