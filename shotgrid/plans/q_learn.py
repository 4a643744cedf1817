"""Registered queries: classification heads, parameter save and load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.math import argmax, bce_with_logit
from shotgrid.operators import learn as L
from shotgrid.operators import sampling as S
from shotgrid.plans.q_report import round_doubles
from shotgrid.schemas import NUM_TRIALS, SAMPLE_SIZES, SEED
from shotgrid.session import fresh_path
from shotgrid.sources import sinks
from shotgrid.sources.views import vec_points, with_views

HEAD_MODELS = sorted(L.DistillConfig().batch_sizes)
KEYS = ["model_name", "sample_size"]


def vec_sets(spark, sf):
    """(train pool, eval rows of both domains) of the feature task."""
    v = vec_points(spark, sf)
    pool = v.filter((F.col("split") == "train") & (F.col("domain") == "in")).select("id", "features", "y")
    ev = v.filter(F.col("split") == "validation").select("domain", "id", "features", F.col("y").alias("label"))
    return pool, ev


def _each_model(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(*[F.lit(m) for m in HEAD_MODELS])).alias("model_name"), "*")


# ---------------------------------------------------------------------------------- F1
def q_score_head(spark, sf):
    """F1: the nearest-centroid head of the pool scores every evaluation row."""
    pool, ev = vec_sets(spark, sf)
    head = L.centroid_heads(pool).select(F.struct("w", "b"))           # one row of classes x features
    scored = ev.withColumn("head", head.scalar())
    scored = scored.withColumn("logits", L.head_logits(F.col("features"), F.col("head.w"), F.col("head.b")))
    out = scored.groupBy("domain").agg(
        F.avg((argmax("logits") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(L.ce_loss(F.col("logits"), F.col("label"))).alias("loss"),
        F.count(F.lit(1)).alias("n"))
    return round_doubles(out)


# --------------------------------------------------------------------------- A9 / A10
def trial_heads(spark, sf) -> DataFrame:
    """Nearest-centroid head of every (model, size, trial): each trial starts anew (A10)."""
    pool, _ = vec_sets(spark, sf)
    rows = S.attach_rows(S.trial_grid(pool, SAMPLE_SIZES, NUM_TRIALS, SEED), pool)
    return _each_model(L.centroid_heads(rows, ["sample_size", "trial"]))


def params_table(heads: DataFrame) -> DataFrame:
    """Heads as a long parameter table: layers ``W`` (class i, feature j) and ``b``."""
    keys = ["model_name", "sample_size", "trial"]
    w = heads.select(*keys, F.posexplode("w").alias("i", "row")).select(*keys, "i", F.posexplode("row").alias("j", "value"))
    b = heads.select(*keys, F.posexplode("b").alias("i", "value")).withColumn("j", F.lit(0))
    both = w.withColumn("layer", F.lit("W")).unionByName(b.withColumn("layer", F.lit("b")))
    return both.withColumn("trainable", F.lit(True)).withColumnRenamed("model_name", "model")


def q_params_roundtrip(spark, sf):
    """A9 + A10: save every trial's parameters by label, load one label back (pruned)."""
    path = sinks.save_params(params_table(trial_heads(spark, sf)), fresh_path(spark, "models"))
    return round_doubles(sinks.load_params(spark, path, HEAD_MODELS[0], 16, 0))


def evaluate_students(ev: DataFrame, students: DataFrame) -> DataFrame:
    """Evaluation with no context of every student at once: hard prediction, G2 loss and
    accuracy per domain.  There is one student per (model, size) of the experiment, whatever the
    data, so the evaluation rows are expanded to them in place."""
    heads = students.agg(F.collect_list(F.struct(*KEYS, "w", "b")))
    j = ev.withColumn("heads", heads.scalar()).select("domain", "label", "features", F.explode("heads").alias("s"))
    lg = L.head_logits(F.col("features"), F.col("s.w"), F.col("s.b"))
    j = j.select("domain", "label", "s.model_name", "s.sample_size", argmax(lg).alias("predicted"))
    return j.groupBy(*KEYS).agg(*[
        F.avg(F.when(F.col("domain") == d, c)).alias(f"eval_{d}_{n}") for d in ("in", "out")
        for c, n in ((bce_with_logit("predicted", "label"), "loss"),
                     ((F.col("predicted") == F.col("label")).cast("double"), "accuracy"))])


QUERIES = {
    "score_head": q_score_head,
    "params_roundtrip": q_params_roundtrip,
}

# --------------------------------------------------------------------------- oracle SQL
_POOL = "pool AS (SELECT id, features, y FROM vec_points WHERE split = 'train' AND domain = 'in')"
_TRIAL = f"""t16 AS (SELECT id, features, y, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', 16, 0, id)), id) AS rn
            FROM pool QUALIFY rn <= 16)"""
SQL = {
    "params_roundtrip": with_views("vec_points") + f""", {_POOL}, {_TRIAL},
w AS (SELECT y AS i, j, avg(x) AS value FROM (SELECT y, unnest(features) AS x, unnest(range(len(features))) AS j FROM t16) GROUP BY ALL),
a AS (SELECT 'W' AS layer, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, value FROM w
      UNION ALL SELECT 'b', CAST(i AS INTEGER), 0, -0.5 * sum(value * value) FROM w GROUP BY i)
SELECT '{HEAD_MODELS[0]}' AS model, 16 AS sample_size, 0 AS trial, layer, i, j, round(value, 6) AS value, true AS trainable FROM a""",
    "score_head": with_views("vec_points") + """,
c AS (SELECT y, j, avg(x) AS w FROM (SELECT y, unnest(features) AS x, unnest(range(len(features))) AS j
      FROM vec_points WHERE split = 'train' AND domain = 'in') GROUP BY y, j),
bb AS (SELECT y, -0.5 * sum(w * w) AS b FROM c GROUP BY y),
e AS (SELECT id, domain, y AS label, unnest(features) AS x, unnest(range(len(features))) AS j
      FROM vec_points WHERE split = 'validation'),
lg AS (SELECT e.id, e.domain, e.label, c.y AS k, sum(e.x * c.w) + bb.b AS logit
       FROM e JOIN c ON e.j = c.j JOIN bb ON c.y = bb.y GROUP BY e.id, e.domain, e.label, c.y, bb.b),
r AS (SELECT id, domain, label, max(CASE WHEN k = 0 THEN logit END) AS l0, max(CASE WHEN k = 1 THEN logit END) AS l1
      FROM lg GROUP BY ALL)
SELECT domain, round(avg(CAST((CASE WHEN l1 > l0 THEN 1 ELSE 0 END) = label AS DOUBLE)), 6) AS accuracy,
       round(avg(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))
                 - CASE WHEN label = 0 THEN l0 ELSE l1 END), 6) AS loss,
       count(*) AS n
FROM r GROUP BY domain""",
}
