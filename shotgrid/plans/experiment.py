"""Experiment plans: zero-shot (F3), in-context learning (F4) and the grid of all six
methods (F10), each over all models and trials at once."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.operators import metrics as M
from shotgrid.operators import sampling as S
from shotgrid.operators import scorers as SC
from shotgrid.operators import report as R
from shotgrid.operators.tokens import TOKEN_PATTERN
from shotgrid.schemas import EVAL_SIZE, NUM_TRIALS, SAMPLE_SIZES, SEED, TRAINED_METHODS, TRAINING_METRICS
from shotgrid.session import cut_lineage, fresh_path
from shotgrid.sources import sinks
from shotgrid.sources import datasets as D
from shotgrid.sources import views as V

CELLS = [(s, t) for s in SAMPLE_SIZES for t in range(NUM_TRIALS)]
_KEYS = ("domain", "id", "label")


def quality_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(train pool, eval rows of both domains) of the quality task."""
    qin = V.quality_rows(spark, sf, "in")
    pool = qin.filter(F.col("split") == "train").select("id", "text", "label")
    ein = S.sample_n(qin.filter(F.col("split") == "validation"), EVAL_SIZE, SEED, "q_eval", "in")
    eout = S.sample_n(V.quality_rows(spark, sf, "out"), EVAL_SIZE, SEED, "q_eval", "out")
    # bounded (2 x eval size) and reused by every scoring step
    ev = cut_lineage(V.as_pairs(ein.unionByName(eout)).select("domain", "id", "label", "premise", "hypothesis"))
    return pool, ev


def corpus_model(spark, sf) -> DataFrame:
    """The count scorer's 'pre-trained model': corpus statistics, built once per corpus
    and then loaded (as the reference loads a downloaded model)."""
    corpus = V.corpus(spark, sf)
    return D.materialized(spark, "corpus_counts", [TOKEN_PATTERN], corpus, lambda: SC.corpus_counts(corpus))


def _zs_metrics(choices: DataFrame) -> DataFrame:
    m = M.domain_metrics(choices, ["model_name"])
    return m.select("model_name", F.col("eval_in_n").cast("int").alias("sample_size"),
                    "eval_in_loss", "eval_in_accuracy", "eval_out_loss", "eval_out_accuracy")


def _icl_metrics(choices: DataFrame) -> DataFrame:
    m = M.domain_metrics(choices, ["model_name", "sample_size", "trial"])
    return m.select("model_name", "sample_size", "trial", "eval_in_loss", "eval_in_accuracy",
                    "eval_out_loss", "eval_out_accuracy")


def _shared(spark, sf, models):
    """Pieces every count-scored method uses, built once: the pool, the evaluation rows
    and the zero-shot scores (corpus counts of the words that occur in the evaluation rows)."""
    pool, ev = quality_sets(spark, sf)
    return pool, ev, SC.zero_shot_scores(ev, *SC.corpus_totals(corpus_model(spark, sf), keep=SC.needed_tokens(ev)), _KEYS, models)


def _icl_choices(pool, ev, zs, models, cells) -> DataFrame:
    sizes = sorted({s for s, _ in cells})
    trials = S.trial_grid(pool, sizes, max(t for _, t in cells) + 1, SEED)
    # bounded (a row per draw of the grid) and read by every aggregate of the scores: the texts are scanned once
    demos = cut_lineage(V.as_pairs(S.attach_rows(trials, pool)))
    return SC.choose(SC.icl_scores(ev, demos, zs, cells, _KEYS, models))


def zero_shot_choices(spark, sf, models=SC.COUNT_MODELS) -> DataFrame:
    return SC.choose(_shared(spark, sf, models)[2])


def zero_shot(spark, sf, models=SC.COUNT_MODELS) -> DataFrame:
    """every model on both domains in one job; one metrics row per model (H2: rows of
    one distributed result).  B9: ``sample_size`` is the evaluation-set size, as the
    zero-shot log records it.  J1: the actual label rides along with each scored row."""
    return _zs_metrics(zero_shot_choices(spark, sf, models))


def icl_eval(spark, sf, models=SC.COUNT_MODELS, cells: Sequence[tuple[int, int]] = CELLS) -> DataFrame:
    """every (model, size, trial) in one job: trial demos -> per-trial likelihood ->
    closed-choice answers on both domains -> metrics."""
    pool, ev, zs = _shared(spark, sf, models)
    return _icl_metrics(_icl_choices(pool, ev, zs, models, cells))


def experiment_grid(spark, sf, models=SC.COUNT_MODELS, cells: Sequence[tuple[int, int]] = CELLS) -> DataFrame:
    """all six methods, one metrics row per model, size and trial, through the metric logs (A4), their union (H1)
    and the combined log (A7), and read back (A6).  Zero-shot and in-context scoring share the evaluation rows,
    the corpus statistics and the zero-shot scores; columns that only a timed GPU run can fill are null.  Both distillations
    go over the whole pool, in the experiment's batches of two and four rows."""
    from shotgrid.plans.q_descent import Fits, context_distill
    pool, ev, zs = _shared(spark, sf, models)
    results = {"zeroshot": _zs_metrics(SC.choose(zs)), "icl": _icl_metrics(_icl_choices(pool, ev, zs, models, cells))}
    # the learners' jobs are small and each waits for its last step: submitted side by side
    whole = {"large_sample_size": None, "most_steps": None}
    learners = {**{method: (lambda m=method: Fits(spark, sf, m).metrics()) for method in TRAINED_METHODS},
                "context_distillation": lambda: context_distill(spark, sf, **whole),
                "recursive_context_distillation": lambda: context_distill(spark, sf, True, **whole)}
    with ThreadPoolExecutor(len(learners)) as pool_:
        results |= dict(zip(learners, pool_.map(lambda f: f(), learners.values()), strict=True))
    rows = None
    for method, df in results.items():
        have = set(df.columns)
        full = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRAINING_METRICS.fields],
                         F.lit(method).alias("finetuning_method"))
        rows = full if rows is None else rows.unionByName(full)
    folder = fresh_path(spark, "grid")
    logs = sinks.read_logs(spark, sinks.write_logs(rows, folder, "final"))
    return sinks.read_combined(spark, sinks.write_combined(R.combine_logs(logs), folder))
