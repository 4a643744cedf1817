"""Registered queries: telemetry, training histories, answers and metrics, logits, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.math import log_softmax, softmax
from shotgrid.functions.text import method_from_file
from shotgrid.operators import history as H
from shotgrid.operators import metrics as M
from shotgrid.operators import telemetry as TL
from shotgrid.operators.sampling import micro_batches
from shotgrid.operators.scorers import Scorer, load_scorer, register, score_with
from shotgrid.plans.q_learn import HEAD_MODELS, params_table, trial_heads
from shotgrid.plans.q_report import round_doubles
from shotgrid.schemas import MODEL_NAMES, SEED
from shotgrid.session import fresh_path
from shotgrid.sources import sinks
from shotgrid.sources import views as V

TEMP = 2.0


# ---------------------------------------------------------------------------- telemetry
def q_phase_tags(spark, sf):
    # the event time as epoch microseconds: an exact integer in every engine
    return TL.phase_tags(V.telemetry(spark, sf)) \
        .withColumn("ts_us", TL.epoch_micros("ts")).drop("ts")


def q_phase_peaks(spark, sf):
    return TL.phase_peaks(V.telemetry(spark, sf), val_in_training=False)


def q_throughput(spark, sf):
    return round_doubles(TL.throughput(V.telemetry(spark, sf)))


# ------------------------------------------------------------------------------ history
def q_history_split(spark, sf):
    return H.split_entries(V.log_entries(spark, sf))


def history(spark, sf) -> DataFrame:
    """Histories of the runs through the history sink (A5), one log per method, read back
    and tagged by file name."""
    long = H.zip_long(H.split_entries(V.log_entries(spark, sf)))
    sizes = F.array(*[F.lit(s) for s in (2, 4, 8, 16)])
    long = long.select(
        F.when(F.col("run") % 2 == 0, MODEL_NAMES[0]).otherwise(MODEL_NAMES[1]).alias("model_name"),
        F.element_at(sizes, (F.col("run") % 4 + 1).cast("int")).alias("sample_size"),
        "epoch", "train_loss", "val_loss",
        F.when(F.floor(F.col("run") / 4) % 2 == 0, "fewshot").otherwise("fewshot_lora").alias("finetuning_method"))
    path = sinks.write_histories(long, fresh_path(spark, "history"), "final")
    rows = sinks.read_histories(spark, path)
    return rows.withColumn("finetuning_method", method_from_file("log")).drop("log")


def q_history_long(spark, sf):
    return history(spark, sf)


def q_learning_curves(spark, sf):
    return round_doubles(H.learning_curves(history(spark, sf)))


# ----------------------------------------------------------------------- answers/metrics
def parsed(spark, sf) -> DataFrame:
    return M.parse_answers(V.predictions(spark, sf))


def q_parse_answers(spark, sf):
    return parsed(spark, sf).select("id", "domain", "generated", "predicted", "parsed")


def q_causal_metrics(spark, sf):
    return round_doubles(M.causal_metrics(parsed(spark, sf), ["model_name", "sample_size", "trial", "domain"]))


def q_domain_metrics(spark, sf):
    return round_doubles(M.domain_metrics(parsed(spark, sf), ["model_name", "sample_size", "trial"]))


# ------------------------------------------------------------------------------- logits
def q_softmax_temp(spark, sf):
    """Every element of both vectors: (id, k, p, lq)."""
    both = F.zip_with(softmax("teacher", TEMP), log_softmax("student", TEMP),
                      lambda p, lq: F.struct(p.alias("p"), lq.alias("lq")))
    rows = V.logits(spark, sf).select("id", F.posexplode(both).alias("k", "v"))
    return round_doubles(rows.select("id", "k", "v.p", "v.lq"))


def q_accuracy_from_logits(spark, sf):
    lg = V.logits(spark, sf)
    return round_doubles(M.accuracy_from_logits(lg, {"teacher_accuracy": "teacher", "student_accuracy": "student"}))


def _head_scorer(model: str):
    """Loader of a saved classification head (A10) by its label."""
    def load(spark, path: str, sample_size: int, trial: int) -> Scorer:
        rows = sinks.load_params(spark, path, model, sample_size, trial).select("layer", "i", "j", "value").collect()     # classes x features
        if not rows:
            raise ValueError(f"no parameters of {model}, {sample_size} shots, trial {trial} below {path}")

        def prepare(values):
            import numpy as np

            w = np.zeros((1 + max(i for _, i, _, _ in values), 1 + max(j for _, _, j, _ in values)))
            b = np.zeros(len(w))
            for layer, i, j, value in values:
                if layer == "W":
                    w[i, j] = value
                else:
                    b[i] = value
            return w, b

        def score(head, batch):
            import numpy as np
            import pandas as pd

            w, b = head
            z = np.stack(batch["features"].to_list()) @ w.T + b if len(batch) else np.zeros((0, len(b)))
            return pd.DataFrame({"id": batch["id"], "predicted": z.argmax(axis=1).astype("int32"), "score0": z[:, 0], "score1": z[:, 1]})

        return Scorer([tuple(r) for r in rows], prepare, score, "id long, predicted int, score0 double, score1 double")

    return load


for _name in HEAD_MODELS:
    register(_name, "classification")(_head_scorer(_name))


def q_model_plugin(spark, sf):
    """A saved head, loaded by name and type, scores every evaluation vector."""
    path = sinks.save_params(params_table(trial_heads(spark, sf)), fresh_path(spark, "models"))
    scorer = load_scorer(spark, HEAD_MODELS[0], "classification", path=path, sample_size=16, trial=0)
    rows = V.vec_points(spark, sf).where(F.col("split") == "validation").select("id", "features")
    return round_doubles(score_with(rows, scorer))


def q_distill_loss(spark, sf):
    lg = micro_batches(V.logits(spark, sf), 4)
    return round_doubles(M.distillation_loss(lg, "teacher", "student", ["batch_id"], TEMP))


# ---------------------------------------------------------------------------- parameters
def q_param_counts(spark, sf):
    return round_doubles(M.param_counts(V.param_table(spark, sf), ["layer"]))


def q_param_freeze(spark, sf):
    """F11 then G12: freeze every layer of one brand family and count again, per model part."""
    frozen = M.freeze(V.param_table(spark, sf), F.col("layer").startswith("Brand#1"))
    return round_doubles(M.param_counts(frozen.withColumn("part", F.substring("layer", 1, 7)), ["part"]))


QUERIES = {
    "param_freeze": q_param_freeze,
    "phase_tags": q_phase_tags,
    "phase_peaks": q_phase_peaks,
    "throughput": q_throughput,
    "history_split": q_history_split,
    "history_long": q_history_long,
    "learning_curves": q_learning_curves,
    "parse_answers": q_parse_answers,
    "causal_metrics": q_causal_metrics,
    "domain_metrics": q_domain_metrics,
    "softmax_temp": q_softmax_temp,
    "accuracy_from_logits": q_accuracy_from_logits,
    "distill_loss": q_distill_loss,
    "model_plugin": q_model_plugin,
    "param_counts": q_param_counts,
}

# --------------------------------------------------------------------------- oracle SQL
_RUN = "PARTITION BY run ORDER BY ts, event_id"
_INC = f"({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_STATE = f"""s0 AS (SELECT *, coalesce(last_value(CASE kind WHEN 'train_begin' THEN 1 WHEN 'train_end' THEN 0 END IGNORE NULLS)
                 OVER {_INC}, 0) = 1 AS is_training FROM telemetry),
s1 AS (SELECT *, (kind = 'log' AND NOT is_training) AS qualifying FROM s0),
s2 AS (SELECT *, CAST(sum(CAST(qualifying AS INTEGER)) OVER {_INC} AS BIGINT) AS log_no FROM s1)"""


def _phase(first: int) -> str:
    return (f"CASE WHEN log_no = {first} THEN 'train' WHEN log_no = {first + 1} THEN 'eval_in' "
            f"WHEN log_no > {first + 1} THEN 'eval_out' END")


_SPLIT = """e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS rd FROM log_entries),
k AS (SELECT run, ts, event_id, CASE WHEN eval_loss IS NULL THEN 'train' ELSE 'val' END AS kind,
             coalesce(eval_loss, loss) AS loss FROM e WHERE rd > 3),
sp AS (SELECT run, kind, CAST(row_number() OVER (PARTITION BY run, kind ORDER BY ts, event_id) AS INTEGER) AS pos, loss FROM k),
hl AS (SELECT CASE WHEN t.run % 2 = 0 THEN 'opt-125m' ELSE 'opt-350m' END AS model_name,
              [2, 4, 8, 16][t.run % 4 + 1] AS sample_size, t.pos AS epoch, t.loss AS train_loss, v.loss AS val_loss,
              CASE WHEN CAST(floor(t.run / 4) AS BIGINT) % 2 = 0 THEN 'fewshot' ELSE 'fewshot_lora' END AS finetuning_method
       FROM sp t JOIN sp v ON t.run = v.run AND t.pos = v.pos AND t.kind = 'train' AND v.kind = 'val')"""

_CLEAN = "rtrim(lower(regexp_replace(regexp_replace(generated, '^\\s+', ''), '\\s+$', '')), ',')"
_PARSED = f"""pa AS (SELECT *, CAST(CASE WHEN contains(c, 'yes') THEN 0 WHEN contains(c, 'no') THEN 1 ELSE 1 - label END AS INTEGER) AS predicted,
                  (contains(c, 'yes') OR contains(c, 'no')) AS parsed
           FROM (SELECT *, {_CLEAN} AS c FROM predictions))"""
_BCE = "(greatest(CAST(predicted AS DOUBLE), 0) - predicted * label + ln(1 + exp(-abs(CAST(predicted AS DOUBLE)))))"


_ROWS = f"""sm AS (
  SELECT id, label, list_transform(teacher, lambda x: x / {TEMP}) AS a, list_transform(student, lambda x: x / {TEMP}) AS b FROM logits),
el AS (
  SELECT id, unnest(range(len(a))) AS k, unnest(a) - list_max(a) AS t, unnest(b) - list_max(b) AS s,
         ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))) AS lt,
         ln(list_sum(list_transform(b, lambda x: exp(x - list_max(b))))) AS ls
  FROM sm)"""

SQL = {
    "param_freeze": V.with_views("param_table") + """SELECT substr(layer, 1, 7) AS part, CAST(sum(n) AS BIGINT) AS all_params,
        CAST(sum(CASE WHEN trainable AND NOT starts_with(layer, 'Brand#1') THEN n ELSE 0 END) AS BIGINT) AS trainable_params,
        round(100.0 * sum(CASE WHEN trainable AND NOT starts_with(layer, 'Brand#1') THEN n ELSE 0 END) / sum(n), 6) AS trainable_pct
        FROM param_table GROUP BY 1""",
    "phase_tags": V.with_views("telemetry") + f",\n{_STATE}\nSELECT run, event_id, epoch_us(ts) AS ts_us, log_no, {_phase(3)} AS phase_val, "
                  f"{_phase(1)} AS phase_noval FROM s2 WHERE qualifying",
    "phase_peaks": V.with_views("telemetry") + f""",
{_STATE},
p1 AS (SELECT *, (kind = 'prediction_step' AND NOT is_training) AS pred FROM s2),
p2 AS (SELECT *, sum(CAST(pred AS INTEGER)) OVER {_INC} AS _p FROM p1),
p3 AS (SELECT *, coalesce(last_value(CASE WHEN qualifying THEN _p END IGNORE NULLS)
                 OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_log_p FROM p2),
p4 AS (SELECT *, sum(CAST(kind = 'train_begin' OR (pred AND _p - last_log_p = 1) AS INTEGER)) OVER {_INC} AS seg FROM p3),
p5 AS (SELECT *, max(memory) OVER (PARTITION BY run, seg ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak_memory, {_phase(1)} AS phase FROM p4)
SELECT run, event_id, log_no, phase, peak_memory FROM p5 WHERE qualifying AND phase IS NOT NULL""",
    "throughput": V.with_views("telemetry") + """SELECT run, n_steps, round(runtime, 6) AS runtime,
        round(CASE WHEN runtime > 0 THEN n_steps / runtime END, 6) AS samples_per_second
        FROM (SELECT run, CAST(sum(CASE WHEN kind = 'prediction_step' THEN 1 ELSE 0 END) AS BIGINT) AS n_steps,
                     (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS runtime FROM telemetry GROUP BY run)""",
    "history_split": V.with_views("log_entries") + f",\n{_SPLIT}\nSELECT run, kind, pos, loss FROM sp",
    "history_long": V.with_views("log_entries") + f",\n{_SPLIT}\nSELECT * FROM hl",
    "learning_curves": V.with_views("log_entries") + f",\n{_SPLIT}\nSELECT model_name, sample_size, finetuning_method, "
                       "epoch, round(avg(train_loss), 6) AS avg_train_loss, round(avg(val_loss), 6) AS avg_val_loss "
                       "FROM hl GROUP BY ALL",
    "parse_answers": V.with_views("predictions") + f",\n{_PARSED}\nSELECT id, domain, generated, predicted, parsed FROM pa",
    "causal_metrics": V.with_views("predictions") + f",\n{_PARSED}\nSELECT model_name, sample_size, trial, domain, "
                      f"round(avg({_BCE}), 6) AS loss, round(avg(CAST(predicted = label AS DOUBLE)), 6) AS accuracy, "
                      f"count(*) AS n FROM pa GROUP BY ALL",
    "domain_metrics": V.with_views("predictions") + f",\n{_PARSED}\nSELECT model_name, sample_size, trial, " + ", ".join(
        f"round(avg(CASE WHEN domain = '{d}' THEN {_BCE} END), 6) AS eval_{d}_loss, "
        f"round(avg(CASE WHEN domain = '{d}' THEN CAST(predicted = label AS DOUBLE) END), 6) AS eval_{d}_accuracy, "
        f"CAST(sum(CASE WHEN domain = '{d}' THEN 1 ELSE 0 END) AS BIGINT) AS eval_{d}_n" for d in ("in", "out"))
        + " FROM pa GROUP BY ALL",
    "softmax_temp": V.with_views("logits") + f""", {_ROWS}
        SELECT id, CAST(k AS INTEGER) AS k, round(exp(t - lt), 6) AS p, round(s - ls, 6) AS lq FROM el""",
    "accuracy_from_logits": V.with_views("logits") + """SELECT
        round(avg(CAST(list_position(teacher, list_max(teacher)) - 1 = label AS DOUBLE)), 6) AS teacher_accuracy,
        count(*) AS n,
        round(avg(CAST(list_position(student, list_max(student)) - 1 = label AS DOUBLE)), 6) AS student_accuracy
        FROM logits""",
    "model_plugin": V.with_views("vec_points") + f""",
t16 AS (SELECT id, features, y, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', 16, 0, id)), id) AS rn
        FROM vec_points WHERE split = 'train' AND domain = 'in' QUALIFY rn <= 16),
c AS (SELECT y, j, avg(x) AS w FROM (SELECT y, unnest(features) AS x, unnest(range(len(features))) AS j FROM t16) GROUP BY ALL),
b AS (SELECT y, -0.5 * sum(w * w) AS b FROM c GROUP BY y),
z AS (SELECT e.id, c.y, sum(e.x * c.w) + any_value(b.b) AS z
      FROM (SELECT id, unnest(features) AS x, unnest(range(len(features))) AS j FROM vec_points WHERE split = 'validation') e
      JOIN c ON c.j = e.j JOIN b ON b.y = c.y GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN y = 0 THEN z END) AS s0, max(CASE WHEN y = 1 THEN z END) AS s1 FROM z GROUP BY id)
SELECT id, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS predicted, round(s0, 6) AS score0, round(s1, 6) AS score1 FROM s""",
    "distill_loss": V.with_views("logits") + f""", {_ROWS},
        r AS (SELECT id, sum(exp(t - lt) * ((t - lt) - (s - ls))) AS kl FROM el GROUP BY id),
        nr AS (SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 4) AS BIGINT) AS batch_id, kl FROM r)
        SELECT batch_id, round({TEMP ** 2} * sum(kl) / count(*), 6) AS loss, count(*) AS batch_size FROM nr GROUP BY batch_id""",
    "param_counts": V.with_views("param_table") + """SELECT layer, CAST(sum(n) AS BIGINT) AS all_params,
        CAST(sum(CASE WHEN trainable THEN n ELSE 0 END) AS BIGINT) AS trainable_params,
        round(100.0 * sum(CASE WHEN trainable THEN n ELSE 0 END) / sum(n), 6) AS trainable_pct
        FROM param_table GROUP BY layer""",
}
