"""Scoring operators (U5, F1, F2) and the bundled count-based language scorer.

The reference scores prompts with a pre-trained causal language model restricted to the
answers Yes / No.  Here a *scorer* is anything that turns prompt rows into per-choice
scores on the executors:

* the count scorer -- relational: a conditional word model estimated on the corpus.  "Yes" is the
  probability of the hypothesis' words given the premise, where a word comes from the premise with weight
  ``beta`` and else from the corpus (backed off and smoothed); "No" is their probability by the corpus
  alone.  The premise speaks for "Yes" as far as it predicts the hypothesis; no word list is involved.  An
  in-context trial adds a multinomial naive-Bayes log likelihood learned from that trial's demonstrations
  only (no parameter update, as in-context learning).  Everything is joins and aggregates, so it has an exact
  SQL oracle.
* the registry (U5) -- any per-batch Python model by (name, type): ``register`` a loader, ``load_scorer`` it,
  and ``score_with`` it; its weights are measured, broadcast and made ready once per Python worker.

UDF surface of the reference: batched map functions (U1) and filter predicates (U2)
are built-in column expressions here; lifecycle callbacks (U4) are the telemetry table
and its window queries; the metric callback (U3) is ``metrics.METRICS``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.functions.text import answer_word, minimal_pattern, parse_answer
from shotgrid.operators.tokens import tokens

NB_VOCAB = 10_000  # additive-smoothing vocabulary size of the demo likelihood


@dataclass(frozen=True)
class CountModel:
    name: str
    alpha: float   # smoothing of the corpus' word probabilities and of the demo likelihood
    lam: float     # weight of the in-context likelihood
    beta: float    # share of the hypothesis' words that come from the premise


COUNT_MODELS = [CountModel("count-a", 1.0, 1.0, 0.5), CountModel("count-b", 0.5, 2.0, 0.2)]


def _models_array(models: Sequence[CountModel]) -> Column:
    return F.array(*[F.struct(F.lit(m.name).alias("model_name"), F.lit(float(m.alpha)).alias("alpha"), F.lit(float(m.lam)).alias("lam"),
                              F.lit(float(m.beta)).alias("beta")) for m in models])


def needed_tokens(rows: DataFrame) -> DataFrame:
    """Distinct tokens of the evaluation rows' hypotheses."""
    return rows.select(F.explode(tokens("hypothesis")).alias("token")).distinct()


def corpus_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): occurrences of every token of the corpus, in one pass (partial aggregation before the shuffle)."""
    return corpus.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def corpus_totals(counts: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(token rows, {N: occurrences, V: distinct tokens}); with ``keep`` only its tokens' rows (a
    semi-join that AQE broadcasts after measuring the set)."""
    t = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
    rows = counts if keep is None else counts.join(keep.select("token"), "token", "left_semi")
    return rows, {"N": int(t["N"] or 0), "V": int(t["V"])}


def _word_counts(rows: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    return rows.select(*keys, F.explode(tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias(name))


def zero_shot_scores(rows: DataFrame, counts: DataFrame, total: dict, keys: Sequence[str] = ("domain", "id", "label"),
                     models: Sequence[CountModel] = COUNT_MODELS) -> DataFrame:
    """F2 zero-shot: per (model, row) the log probability of the hypothesis with and without the premise.  A row
    without words scores 0 on both."""
    words = _word_counts(rows, keys, "hypothesis", "n_h").join(_word_counts(rows, keys, "premise", "n_p"), [*keys, "token"], "left") \
        .join(counts.select("token", "n"), "token", "left")
    words = words.select(*keys, "token", "n_h", F.coalesce("n_p", F.lit(0)).alias("n_p"), F.coalesce("n", F.lit(0)).alias("n"))
    each = rows.select(*keys, F.size(tokens("premise")).alias("length"), F.explode(_models_array(models)).alias("m")).select(*keys, "length", "m.*")
    j = each.join(words, list(keys), "left")
    p = (F.col("n") + F.col("alpha")) / (F.lit(total["N"]) + F.col("alpha") * (total["V"] + 1))
    given = F.col("beta") * F.col("n_p") / F.greatest(F.col("length"), F.lit(1)) + (1 - F.col("beta")) * p
    return j.groupBy("model_name", *keys).agg(F.coalesce(F.sum(F.col("n_h") * F.log(given)), F.lit(0.0)).alias("score0"),
                                              F.coalesce(F.sum(F.col("n_h") * F.log(p)), F.lit(0.0)).alias("score1"))


def choose(df: DataFrame, label: str = "label") -> DataFrame:
    """Closed-choice answer among the allowed answers (E4): the higher score wins, ties go to
    the first choice ('Yes').  The answer text then goes through the same parser as generated
    text (D5)."""
    pred = F.when(F.col("score1") > F.col("score0"), F.lit(1)).otherwise(F.lit(0))
    return df.withColumn("generated", answer_word(pred)) \
             .withColumn("predicted", parse_answer("generated", label))


def icl_scores(rows: DataFrame, demos: DataFrame, zs: DataFrame, cells: Sequence[tuple[int, int]],
               keys: Sequence[str] = ("domain", "id", "label"), models: Sequence[CountModel] = COUNT_MODELS,
               vocab: int = NB_VOCAB) -> DataFrame:
    """F2 in-context: zero-shot score + lam * (demo naive-Bayes log likelihood + log prior),
    per (model, size, trial, row).

    A token that a trial's demonstrations lack contributes the same to every such trial, so a
    row's likelihood is (its tokens) * ln(a / (t + a V)) plus a correction for the tokens that
    occur in the demonstrations.  Only those matches are joined: the work is rows * cells plus
    matches, not rows * tokens * cells."""
    cell = ["sample_size", "trial"]
    dt = demos.select(*cell, "label", F.explode(tokens(minimal_pattern("premise", "hypothesis"))).alias("token"))
    count = [F.sum((F.col("label") == c).cast("long")) for c in (0, 1)]
    nb = dt.groupBy(*cell, "token").agg(count[0].alias("c0"), count[1].alias("c1"))
    prior = demos.groupBy(*cell).agg(count[0].alias("d0"), F.count(F.lit(1)).alias("dn"))
    tot = prior.join(dt.groupBy(*cell).agg(count[0].alias("t0"), count[1].alias("t1")), cell, "left").fillna(0, ["t0", "t1"])

    text = tokens(minimal_pattern("premise", "hypothesis"))
    per_token = rows.select(*keys, F.explode(text).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    match = per_token.join(nb, "token").select(*keys, *cell, "n", "c0", "c1", F.explode(_models_array(models)).alias("m"))
    more = [F.sum(F.col("n") * (F.log(F.col(f"c{c}") + F.col("m.alpha")) - F.log(F.col("m.alpha")))) for c in (0, 1)]
    match = match.groupBy("m.model_name", *cell, *keys).agg(more[0].alias("m0"), more[1].alias("m1"))

    grid = F.array(*[F.struct(F.lit(s).alias("sample_size"), F.lit(t).alias("trial")) for s, t in cells])
    base = rows.select(*keys, F.size(text).alias("tokens"), F.explode(grid).alias("g")) \
        .select(*keys, "tokens", "g.*", F.explode(_models_array(models)).alias("m")).select(*keys, "tokens", *cell, "m.*")
    j = base.join(tot, cell).join(match, ["model_name", *cell, *keys], "left").join(zs, ["model_name", *keys])
    a = F.col("alpha")

    def score(c: int, prior_count: Column) -> Column:
        ll = F.col("tokens") * (F.log(a) - F.log(F.col(f"t{c}") + a * vocab)) + F.coalesce(F.col(f"m{c}"), F.lit(0.0))
        return F.col(f"score{c}") + F.col("lam") * (ll + F.log((prior_count + a) / (F.col("dn") + 2 * a)))

    return j.select("model_name", *cell, *keys, score(0, F.col("d0")).alias("score0"),
                    score(1, F.col("dn") - F.col("d0")).alias("score1"))


# ----------------------------------------------------------------- model plug-in
WEIGHT_BYTES = 512 << 20        # weights that are broadcast at most


@dataclass(frozen=True)
class Scorer:
    """A loaded model: its weights, ``prepare`` (weights -> model, once per Python worker), ``score`` (model, batch -> rows)
    and the schema of the rows."""
    weights: object
    prepare: Callable[[object], object]
    score: Callable[[object, pd.DataFrame], pd.DataFrame]
    schema: str


_LOADERS: dict[tuple[str, str], Callable[..., Scorer]] = {}
_READY: dict[str, object] = {}


def register(name: str, kind: str):
    """Makes a loader ``(spark, **where) -> Scorer`` known as the model ``name`` of type ``kind``."""
    def add(loader):
        _LOADERS[name, kind] = loader
        return loader

    return add


def load_scorer(spark: SparkSession, name: str, kind: str, **where) -> Scorer:
    if (name, kind) not in _LOADERS:
        raise ValueError(f"Model {name!r} of type {kind!r} is not supported; known: {sorted(_LOADERS)}")
    return _LOADERS[name, kind](spark, **where)


def score_with(df: DataFrame, scorer: Scorer, limit: int = WEIGHT_BYTES) -> DataFrame:
    """Scores the rows of ``df`` batch by batch."""
    size = len(pickle.dumps(scorer.weights))
    if size > limit:
        raise ValueError(f"weights of {size} bytes are above the limit of {limit} for a broadcast")
    shared = df.sparkSession.sparkContext.broadcast(scorer.weights)
    prepare, score, key = scorer.prepare, scorer.score, uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shotgrid.operators import scorers

        if key not in scorers._READY:
            scorers._READY[key] = prepare(shared.value)
        for b in batches:
            yield score(scorers._READY[key], b)

    return df.mapInPandas(run, scorer.schema)
