"""Numeric expressions: keyed hashing, losses, softmax, argmax, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_key(seed, *parts) -> Column:
    """Stateless sampling key ``md5('seed|part|...')``: identical in every engine,
    independent of partitioning and call order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def hash_index(seed, draw, n) -> Column:
    """Position in ``[0, n)`` drawn from the key of ``draw`` (sampling with replacement)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), _col(draw).cast("string")))
    key = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")          # 60 bits
    return F.pmod(key, _col(n) if not isinstance(n, int) else F.lit(n))


def keyed_uniform(seed, *parts) -> Column:
    """Number in [0, 1) drawn from the key of ``parts``: 52 bits, so it is exact in every engine."""
    key = F.conv(F.substring(sample_key(seed, *parts), 1, 13), 16, 10).cast("long")
    return key.cast("double") / F.lit(float(1 << 52))


def bce_with_logit(x, y) -> Column:
    """Stable binary cross-entropy with logit ``x`` and target ``y``."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def softmax(arr, temperature: float = 1.0) -> Column:
    """Max-shifted softmax of an array column, divided by a temperature."""
    a = F.transform(_col(arr), lambda v: v / F.lit(float(temperature)))
    m = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def log_softmax(arr, temperature: float = 1.0) -> Column:
    a = F.transform(_col(arr), lambda v: v / F.lit(float(temperature)))
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(F.transform(a, lambda v: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v))
    return F.transform(a, lambda v: v - lse)


def kl_rows(teacher, student, temperature: float = 1.0) -> Column:
    """Per-row ``sum_k p_k (log p_k - log q_k)`` with p = softmax(teacher/T), q = softmax(student/T);
    a zero teacher probability contributes 0."""
    p = softmax(teacher, temperature)
    lp = log_softmax(teacher, temperature)
    lq = log_softmax(student, temperature)
    z = F.arrays_zip(p.alias("p"), lp.alias("lp"), lq.alias("lq"))
    return F.aggregate(z, F.lit(0.0),
                       lambda acc, r: acc + F.when(r["p"] > 0, r["p"] * (r["lp"] - r["lq"])).otherwise(F.lit(0.0)))


def argmax(arr) -> Column:
    """Index of the largest element, lowest index on ties (0-based)."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def batch_size_rule(model_name, sample_size, large_model: str = "opt-350m") -> Column:
    """Few-shot batch size: large model and size >= 8 -> int(32 / size), else 8."""
    m, s = _col(model_name), _col(sample_size)
    return F.when((m == large_model) & (s >= 8), F.floor(F.lit(32) / s)).otherwise(F.lit(8)).cast("int")


def distill_batch_size(model_name, large_model: str = "opt-350m") -> Column:
    return F.when(_col(model_name) == large_model, F.lit(2)).otherwise(F.lit(4)).cast("int")


def steps_per_epoch(n, batch) -> Column:
    """ceil(n / batch); total steps = epochs x this."""
    return F.ceil(_col(n) / _col(batch)).cast("int")


def linear_schedule(step, total, warmup, base_lr) -> Column:
    """Linear warm-up then linear decay to 0 (step counted from 0)."""
    s, t, w = _col(step).cast("double"), _col(total).cast("double"), _col(warmup).cast("double")
    return F.lit(float(base_lr)) * F.when(s < w, s / F.greatest(w, F.lit(1.0))) \
        .otherwise(F.greatest(F.lit(0.0), (t - s) / F.greatest(t - w, F.lit(1.0))))
