"""Registered queries over the text-pair view: loading, cleaning, sampling, prompts.

Each query has a Spark plan and the same computation as DuckDB SQL (the oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.functions.math import distill_batch_size, sample_key
from shotgrid.operators import prompts as P
from shotgrid.operators import sampling as S
from shotgrid.schemas import (EVAL_SIZE, LARGE_SAMPLE_SIZE, MODEL_NAMES, NUM_TRIALS, SAMPLE_SIZES, SEED,
                              TEACHER_CONTRADICTION_EXPLANATION, TEACHER_CONTRADICTION_OUTPUT, TEACHER_END,
                              TEACHER_ENTAILMENT_EXPLANATION, TEACHER_ENTAILMENT_OUTPUT, TEACHER_EXAMPLE_INPUT, TEACHER_QUESTION)
from shotgrid.sources import datasets as D
from shotgrid.sources.views import as_pairs, nli_pairs, nli_rows, sql_text, with_views

N_DRAWS = 100           # positions drawn with replacement
CELLS = [(s, t) for s in SAMPLE_SIZES for t in range(NUM_TRIALS)]


def _md5(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def _hash_pos(draw_sql: str, n_sql: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {draw_sql})), 1, 15) AS BIGINT) % {n_sql})"


# shared SQL pieces -------------------------------------------------------------------
_CLEAN = """clean_in AS (
  SELECT id, split, premise, hypothesis, CASE WHEN label = 2 THEN 1 ELSE label END AS label
  FROM nli_pairs WHERE domain = 'in' AND label <> 1),
clean_train AS (SELECT id, premise, hypothesis, label FROM clean_in WHERE split = 'train'),
clean_val AS (SELECT id, premise, hypothesis, label FROM clean_in WHERE split = 'validation'),
out_lo AS (SELECT id, premise, hypothesis, label, heuristic FROM nli_pairs
           WHERE domain = 'out' AND heuristic = 'lexical_overlap')"""

_GRID_VALUES = ", ".join(f"({s}, {t})" for s, t in CELLS)
_TRIALS = f"""trials AS (
  SELECT sample_size, trial, CAST(rn AS INTEGER) AS rn, id FROM (
    SELECT g.sample_size, g.trial, c.id,
           row_number() OVER (PARTITION BY g.sample_size, g.trial
                              ORDER BY {_md5(f"'{SEED}'", 'g.sample_size', 'g.trial', 'c.id')}, c.id) AS rn
    FROM clean_train c, (VALUES {_GRID_VALUES}) g(sample_size, trial))
  WHERE rn <= sample_size)"""
_EVAL = f"""eval_in AS (SELECT id, premise, hypothesis, label FROM clean_val
            ORDER BY {_md5(f"'{SEED}'", "'eval'", "'in'", 'id')}, id LIMIT {EVAL_SIZE}),
eval_out AS (SELECT id, premise, hypothesis, label FROM out_lo
             ORDER BY {_md5(f"'{SEED}'", "'eval'", "'out'", 'id')}, id LIMIT {EVAL_SIZE})"""


def _pre(*extra: str) -> str:
    return with_views("nli_pairs") + ",\n" + ",\n".join((_CLEAN,) + extra) + "\n"


# spark helpers -------------------------------------------------------------------------
def _clean(spark, sf):
    return D.in_domain(spark, sf)


def trials(spark, sf) -> DataFrame:
    """C3 over the cleaned in-domain training rows; trials numbered from 0."""
    train, _ = D.in_domain_rows(spark, sf)
    return S.trial_grid(train, SAMPLE_SIZES, NUM_TRIALS, SEED)


def trial_rows(spark, sf) -> DataFrame:
    """The trials' rows: ids are joined to the texts, then only those texts are split."""
    train, _ = D.in_domain_rows(spark, sf)
    return as_pairs(S.attach_rows(trials(spark, sf), train))


def eval_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """C4: one fixed evaluation sample per domain, shared by every method."""
    _, val = D.in_domain_rows(spark, sf)
    out = D.out_domain_rows(spark, sf).drop("heuristic")
    return (as_pairs(S.sample_n(val, EVAL_SIZE, SEED, "eval", "in")),
            as_pairs(S.sample_n(out, EVAL_SIZE, SEED, "eval", "out")))


# queries -------------------------------------------------------------------------------
def q_load_in_domain(spark: SparkSession, sf: str) -> DataFrame:
    train, val = D.in_domain(spark, sf)
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("validation")))


def q_load_out_domain(spark, sf):
    return D.out_domain(spark, sf)


def q_materialize_dataset(spark, sf):
    return D.load_dataset(spark, "nli_in", sf)


def q_remove_neutral(spark, sf):
    return D.remove_neutral(nli_rows(spark, sf)).select("id", "domain", "split", "label")


def q_isolate_heuristic(spark, sf):
    return D.isolate_heuristic(nli_rows(spark, sf)).select("id", "domain", "split", "label")


def q_filter_keys(spark, sf):
    """B4 + B6: one label within a conjunction of key filters (``None`` = no filter)."""
    rows = D.filter_label(nli_rows(spark, sf), 0)
    return rows.filter(D.key_filter(domain="out", split="train", heuristic=None)).select("id", "heuristic", "label")


def q_select_by_index(spark, sf):
    train, _ = _clean(spark, sf)
    n = train.count()
    pos = S.draw_positions(spark, N_DRAWS, SEED, {"train": n}).select("draw", "position")
    return S.select_by_index(train.select("id", "label"), pos).select("draw", "position", "id", "label")


def q_sample_n(spark, sf):
    train, _ = _clean(spark, sf)
    return S.sample_n(train, 64, SEED, "sample").select("id", "label")


def q_trial_grid(spark, sf):
    return trial_rows(spark, sf).select("sample_size", "trial", "rn", "id", "label", "premise")


def q_eval_sample(spark, sf):
    ein, eout = eval_sets(spark, sf)
    return ein.select(F.lit("in").alias("domain"), "id", "label") \
              .unionByName(eout.select(F.lit("out").alias("domain"), "id", "label"))


def q_sample_per_label(spark, sf):
    train, _ = _clean(spark, sf)
    return S.per_label(train, 3, SEED, "per_label", labels=(0, 1)).select("label", "rn", "id")


def distill_sets(spark, sf, large_sample_size: int = LARGE_SAMPLE_SIZE) -> DataFrame:
    """The first 16-shot trial and a fresh large sample, as (sample_size, rn, id).  Where the pool has
    fewer than ``large_sample_size`` rows, all of them are the large sample."""
    train, _ = D.in_domain_rows(spark, sf)
    large_sample_size = min(large_sample_size, train.count())
    small = trials(spark, sf).filter((F.col("sample_size") == 16) & (F.col("trial") == 0)) \
        .select("sample_size", "rn", "id")
    big = S.sample_n(train.select("id"), large_sample_size, SEED, "large") \
        .withColumn("h", sample_key(SEED, F.lit("large"), F.col("id")))
    big = S.dense_index(big, ["h", "id"]) \
        .select(F.lit(large_sample_size).alias("sample_size"), (F.col("idx") + 1).cast("int").alias("rn"), "id")
    return small.unionByName(big)


def q_distill_sets(spark, sf):
    return distill_sets(spark, sf)


def q_validation_subset(spark, sf):
    """Few-shot fits are validated on rows of the in-domain evaluation sample."""
    ein, _ = eval_sets(spark, sf)
    return S.validation_subset(ein, SEED, "val").select("id", "label")


def q_validation_subset_out(spark, sf):
    """Low-rank fits are validated on rows of the out-of-domain evaluation sample."""
    _, eout = eval_sets(spark, sf)
    return S.validation_subset(eout, SEED, "val").select("id", "label")


def q_sample_with_replacement(spark, sf):
    _, val = _clean(spark, sf)
    out = D.out_domain(spark, sf)
    pos = S.draw_positions(spark, N_DRAWS, SEED, {"in": val.count(), "out": out.count()})
    pin = S.select_by_index(val.select("id"), pos.filter(F.col("dataset") == "in"))
    pout = S.select_by_index(out.select("id"), pos.filter(F.col("dataset") == "out"))
    return pin.unionByName(pout).select("draw", "dataset", "position", "id")


def q_head_n(spark, sf):
    train, _ = _clean(spark, sf)
    return S.head_n(train, 8).select("id", "label")


def q_micro_batches(spark, sf):
    _, val = _clean(spark, sf)
    return S.micro_batches(val.select("id"), 8).select("id", "batch_id", "pos_in_batch")


def q_minimal_pattern(spark, sf):
    p = nli_pairs(spark, sf)
    return p.select("id", P.minimal_pattern("premise", "hypothesis").alias("text"),
                    P.minimal_pattern("premise", "hypothesis", F.col("heuristic")).alias("text_ctx"))


def contexts(spark, sf) -> DataFrame:
    return P.icl_context(trial_rows(spark, sf))


def q_icl_context(spark, sf):
    return contexts(spark, sf)


def distill_batches(spark, sf, large_sample_size: int = LARGE_SAMPLE_SIZE) -> DataFrame:
    """C10 + C11 over the distillation sets: ``batch_key = model:size:batch``, batches of 2 rows
    for the large model and of 4 for the small one."""
    models = F.explode(F.array(*[F.lit(m) for m in MODEL_NAMES])).alias("model_name")
    return distill_sets(spark, sf, large_sample_size).select("*", models).withColumn(
        "batch_key", F.concat_ws(":", "model_name", F.col("sample_size").cast("string"),
                                 F.floor((F.col("rn") - 1) / distill_batch_size("model_name")).cast("string")))


def q_teacher_context(spark, sf):
    train, _ = D.in_domain_rows(spark, sf)
    return P.teacher_contexts(distill_batches(spark, sf), train, SEED, batch_col="batch_key")


def q_icl_prompts(spark, sf):
    ein, eout = eval_sets(spark, sf)
    ev = ein.withColumn("domain", F.lit("in")).unionByName(eout.withColumn("domain", F.lit("out")))
    return P.icl_prompts(ev, contexts(spark, sf), CELLS).select("domain", "id", "sample_size", "trial", "text")


def training_schedule(spark, sf) -> DataFrame:
    """C11 + S2 + S1 over the trial grid and the distillation sets: batch size by model
    and shot count, steps per epoch, total and warm-up steps, learning rate per step."""
    from shotgrid.functions.math import batch_size_rule, linear_schedule, steps_per_epoch
    models = F.explode(F.array(*[F.lit(m) for m in MODEL_NAMES])).alias("model_name")
    few = trials(spark, sf).groupBy("sample_size", "trial").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("fewshot").alias("method"), models, "sample_size", "trial", "n") \
        .withColumn("batch_size", batch_size_rule("model_name", "sample_size")) \
        .withColumn("epochs", F.lit(40)).withColumn("warmup_ratio", F.lit(0.1)).withColumn("base_lr", F.lit(1e-5))
    dst = distill_sets(spark, sf).groupBy("sample_size").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("context_distillation").alias("method"), models, "sample_size", F.lit(0).alias("trial"), "n") \
        .withColumn("batch_size", distill_batch_size("model_name")) \
        .withColumn("epochs", F.lit(1)).withColumn("warmup_ratio", F.lit(0.0)).withColumn("base_lr", F.lit(5e-5))
    g = few.unionByName(dst).withColumn("steps_per_epoch", steps_per_epoch("n", "batch_size")) \
        .withColumn("total_steps", F.col("epochs") * F.col("steps_per_epoch")) \
        .withColumn("warmup_steps", F.ceil(F.col("warmup_ratio") * F.col("total_steps")).cast("int"))
    steps = g.select("*", F.explode(F.sequence(F.lit(0), F.col("total_steps") - 1)).alias("step"))
    lr = F.col("base_lr") * linear_schedule("step", "total_steps", "warmup_steps", 1.0)
    return steps.select("method", "model_name", "sample_size", "trial", "batch_size", "steps_per_epoch",
                        "total_steps", "warmup_steps", "step", F.round(lr, 12).alias("lr"))


def q_training_schedule(spark, sf):
    return training_schedule(spark, sf)


QUERIES = {
    "training_schedule": q_training_schedule,
    "load_in_domain": q_load_in_domain,
    "load_out_domain": q_load_out_domain,
    "materialize_dataset": q_materialize_dataset,
    "remove_neutral": q_remove_neutral,
    "isolate_heuristic": q_isolate_heuristic,
    "filter_keys": q_filter_keys,
    "select_by_index": q_select_by_index,
    "sample_n": q_sample_n,
    "trial_grid": q_trial_grid,
    "eval_sample": q_eval_sample,
    "sample_per_label": q_sample_per_label,
    "distill_sets": q_distill_sets,
    "validation_subset": q_validation_subset,
    "validation_subset_out": q_validation_subset_out,
    "sample_with_replacement": q_sample_with_replacement,
    "head_n": q_head_n,
    "micro_batches": q_micro_batches,
    "minimal_pattern": q_minimal_pattern,
    "icl_context": q_icl_context,
    "teacher_context": q_teacher_context,
    "icl_prompts": q_icl_prompts,
}

_DEMO = "c.premise || ' ' || c.hypothesis || ' ?' || (['entailment', 'contradiction'])[c.label + 1] || ','"
_CTX = f"""contexts AS (
  SELECT t.sample_size, t.trial, count(*) AS n_demos,
         string_agg({_DEMO}, '' ORDER BY t.rn) AS context
  FROM trials t JOIN clean_train c ON t.id = c.id GROUP BY t.sample_size, t.trial)"""
_DISTILL = f"""big AS (SELECT id, CAST(row_number() OVER (ORDER BY {_md5(f"'{SEED}'", "'large'", 'id')}, id) AS INTEGER) AS rn
               FROM clean_train ORDER BY {_md5(f"'{SEED}'", "'large'", 'id')}, id LIMIT {LARGE_SAMPLE_SIZE}),
distill AS (SELECT sample_size, rn, id FROM trials WHERE sample_size = 16 AND trial = 0
            UNION ALL SELECT CAST((SELECT least({LARGE_SAMPLE_SIZE}, count(*)) FROM clean_train) AS INTEGER) AS sample_size, rn, id FROM big)"""

_TEACHER = " || ".join([
    sql_text(TEACHER_QUESTION), sql_text(TEACHER_EXAMPLE_INPUT), "cp", "' '", "ch", sql_text("?\n"),
    sql_text(TEACHER_CONTRADICTION_OUTPUT), sql_text(TEACHER_CONTRADICTION_EXPLANATION),
    sql_text(TEACHER_EXAMPLE_INPUT), "ep", "' '", "eh", sql_text("?\n"),
    sql_text(TEACHER_ENTAILMENT_OUTPUT), sql_text(TEACHER_ENTAILMENT_EXPLANATION), sql_text(TEACHER_END)])

_SCHED_LR = ("round(base_lr * CASE WHEN step < warmup_steps THEN step / greatest(CAST(warmup_steps AS DOUBLE), 1.0) "
             "ELSE greatest(0.0, (total_steps - step) / greatest(CAST(total_steps - warmup_steps AS DOUBLE), 1.0)) END, 12)")
_SCHED = f"""g0 AS (
  SELECT 'fewshot' AS method, m.model_name, t.sample_size, t.trial, count(*) AS n,
         CAST(CASE WHEN m.model_name = 'opt-350m' AND t.sample_size >= 8 THEN floor(32 / t.sample_size) ELSE 8 END AS INTEGER) AS batch_size,
         40 AS epochs, 0.1 AS warmup_ratio, 1e-5 AS base_lr
  FROM trials t, (VALUES ('opt-125m'), ('opt-350m')) m(model_name) GROUP BY ALL
  UNION ALL
  SELECT 'context_distillation', m.model_name, d.sample_size, 0, count(*),
         CASE WHEN m.model_name = 'opt-350m' THEN 2 ELSE 4 END, 1, 0.0, 5e-5
  FROM distill d, (VALUES ('opt-125m'), ('opt-350m')) m(model_name) GROUP BY ALL),
g1 AS (SELECT *, CAST(ceil(n / batch_size) AS INTEGER) AS steps_per_epoch FROM g0),
g2 AS (SELECT *, epochs * steps_per_epoch AS total_steps FROM g1),
g3 AS (SELECT *, CAST(ceil(CAST(warmup_ratio AS DOUBLE) * total_steps) AS INTEGER) AS warmup_steps FROM g2)"""

SQL = {
    "training_schedule": _pre(_TRIALS, _DISTILL, _SCHED) + f"""SELECT method, model_name, sample_size, trial, batch_size,
        steps_per_epoch, total_steps, warmup_steps, CAST(step AS INTEGER) AS step, {_SCHED_LR} AS lr
        FROM (SELECT *, unnest(range(total_steps)) AS step FROM g3)""",
    "load_in_domain": _pre() + "SELECT id, premise, hypothesis, label, split FROM clean_in",
    "load_out_domain": _pre() + "SELECT id, premise, hypothesis, label, heuristic FROM out_lo",
    "materialize_dataset": _pre() + "SELECT id, premise, hypothesis, label, split FROM clean_in",
    "remove_neutral": with_views("nli_pairs") +
        "SELECT id, domain, split, CAST(CASE WHEN label = 2 THEN 1 ELSE label END AS INTEGER) AS label "
        "FROM nli_pairs WHERE label <> 1",
    "isolate_heuristic": with_views("nli_pairs") +
        "SELECT id, domain, split, label FROM nli_pairs WHERE heuristic = 'lexical_overlap'",
    "filter_keys": with_views("nli_pairs") +
        "SELECT id, heuristic, label FROM nli_pairs WHERE label = 0 AND domain = 'out' AND split = 'train'",
    "select_by_index": _pre(
        "t AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS idx FROM clean_train)",
        "n AS (SELECT count(*) AS n FROM t)",
        f"d AS (SELECT range AS draw, {_hash_pos('range', 'n.n')} AS position FROM range({N_DRAWS}), n)")
        + "SELECT d.draw, d.position, t.id, t.label FROM d JOIN t ON d.position = t.idx",
    "sample_n": _pre() + f"SELECT id, label FROM clean_train ORDER BY {_md5(repr(str(SEED)), repr('sample'), 'id')}, id LIMIT 64",
    "trial_grid": _pre(_TRIALS) +
        "SELECT t.sample_size, t.trial, t.rn, t.id, c.label, c.premise FROM trials t JOIN clean_train c ON t.id = c.id",
    "eval_sample": _pre(_EVAL) +
        "SELECT 'in' AS domain, id, label FROM eval_in UNION ALL SELECT 'out' AS domain, id, label FROM eval_out",
    "sample_per_label": _pre() + f"""SELECT label, CAST(rn AS INTEGER) AS rn, id FROM (
        SELECT label, id, row_number() OVER (PARTITION BY label
               ORDER BY {_md5(f"'{SEED}'", "'per_label'", 'label', 'id')}, id) AS rn FROM clean_train) WHERE rn <= 3""",
    "distill_sets": _pre(_TRIALS, _DISTILL) + "SELECT sample_size, rn, id FROM distill",
    **{name: _pre(_EVAL) + f"SELECT id, label FROM {rows} ORDER BY {_md5(repr(str(SEED)), repr('val'), 'id')}, id LIMIT "
       f"(SELECT CASE WHEN count(*) >= 50 THEN 10 ELSE count(*) END FROM {rows})"
       for name, rows in (("validation_subset", "eval_in"), ("validation_subset_out", "eval_out"))},
    "sample_with_replacement": _pre(
        "vi AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM clean_val)",
        "vo AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM out_lo)",
        "ns AS (SELECT 'in' AS dataset, count(*) AS n FROM vi UNION ALL SELECT 'out', count(*) FROM vo)",
        f"d AS (SELECT range AS draw, ns.dataset, {_hash_pos('range', 'ns.n')} AS position FROM range({N_DRAWS}), ns)")
        + "SELECT d.draw, d.dataset, d.position, vi.id FROM d JOIN vi ON d.dataset = 'in' AND d.position = vi.idx "
          "UNION ALL SELECT d.draw, d.dataset, d.position, vo.id FROM d JOIN vo ON d.dataset = 'out' AND d.position = vo.idx",
    "head_n": _pre() + "SELECT id, label FROM clean_train ORDER BY id LIMIT 8",
    "micro_batches": _pre() + """SELECT id, CAST(floor((rn - 1) / 8) AS BIGINT) AS batch_id,
        CAST((rn - 1) % 8 AS INTEGER) AS pos_in_batch
        FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM clean_val)""",
    "minimal_pattern": with_views("nli_pairs") + """SELECT id, premise || ' ' || hypothesis || '?' AS text,
        CASE WHEN heuristic IS NULL OR heuristic = '' THEN '' ELSE heuristic || ' ' END
          || premise || ' ' || hypothesis || '?' AS text_ctx FROM nli_pairs""",
    "icl_context": _pre(_TRIALS, _CTX) + "SELECT sample_size, trial, n_demos, context FROM contexts",
    "teacher_context": _pre(_TRIALS, _DISTILL,
        """batches AS (SELECT DISTINCT m.model_name || ':' || CAST(sample_size AS VARCHAR) || ':' ||
                       CAST(CAST(floor((rn - 1) / CASE WHEN m.model_name = 'opt-350m' THEN 2 ELSE 4 END) AS BIGINT) AS VARCHAR) AS batch_key
                       FROM distill, (VALUES ('opt-125m'), ('opt-350m')) m(model_name))""",
        "pool AS (SELECT id, premise, hypothesis, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS idx FROM clean_train)",
        "nl AS (SELECT label, count(*) AS n FROM pool GROUP BY label)",
        "dr AS (SELECT b.batch_key, nl.label, " + _hash_pos("concat_ws('|', 'teacher', b.batch_key, nl.label)", "nl.n")
        + " AS idx FROM batches b, nl)",
        """w AS (SELECT dr.batch_key,
                  max(CASE WHEN dr.label = 1 THEN p.premise END) AS cp, max(CASE WHEN dr.label = 1 THEN p.hypothesis END) AS ch,
                  max(CASE WHEN dr.label = 0 THEN p.premise END) AS ep, max(CASE WHEN dr.label = 0 THEN p.hypothesis END) AS eh
                FROM dr JOIN pool p ON dr.label = p.label AND dr.idx = p.idx GROUP BY dr.batch_key)""")
        + f"SELECT batch_key, {_TEACHER} AS teacher_context FROM w",
    "icl_prompts": _pre(_TRIALS, _CTX, _EVAL) + """SELECT e.domain, e.id, c.sample_size, c.trial,
        CASE WHEN c.context = '' THEN '' ELSE c.context || ' ' END || e.premise || ' ' || e.hypothesis || '?' AS text
        FROM (SELECT 'in' AS domain, * FROM eval_in UNION ALL SELECT 'out' AS domain, * FROM eval_out) e, contexts c""",
}
