"""Bindings of the experiment's data model to the driver tables.

Each view exists twice: a Spark builder (``spark, sf_dir -> DataFrame``) and the same
definition as a DuckDB common-table expression, so every oracle query can be written
against the same names.  Views are lazy projections; Catalyst prunes their unused
columns and pushes filters into the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.schemas import ANSWER_STRINGS, METHODS_F, METHODS_O, MODEL_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pairs(df: DataFrame) -> DataFrame:
    """``text`` as a pair that holds every character of it: premise = the first line,
    hypothesis = all remaining lines (empty for a text of one line)."""
    nl = F.locate("\n", df.text)
    hypothesis = F.when(nl > 0, F.substr(df.text, nl + 1)).otherwise("")
    return df.withColumns({"premise": F.substring_index(df.text, "\n", 1), "hypothesis": hypothesis}).drop("text")


_PREMISE_SQL = "string_split(text, chr(10))[1]"
_HYPOTHESIS_SQL = "CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"


# --------------------------------------------------------------------------- nli_pairs
def _domain_filter(d: DataFrame, domain: str | None) -> DataFrame:
    """Domain predicate on the raw ``lang`` column, so it reaches the Parquet scan."""
    if domain == "in":
        return d.filter(d.lang == "en")
    if domain == "out":
        return d.filter((d.lang != "en") | d.lang.isNull())
    return d


def nli_rows(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """Labelled texts, not yet split into pairs: what is sampled or joined by id is split
    afterwards (``as_pairs``).  ``domain`` restricts to one domain with a predicate pushed
    into the scan."""
    d = _domain_filter(table(spark, sf_dir, "documents"), domain)
    is_in = d.lang == "en"
    return d.select(
        d.doc_id.alias("id"),
        F.when(d.doc_id % 5 == 0, "validation").otherwise("train").alias("split"),
        F.when(is_in, "in").otherwise("out").alias("domain"),
        "text",
        F.when(is_in, d.doc_id % 3).otherwise(F.floor(d.doc_id / 4) % 2).cast("int").alias("label"),
        F.when(d.doc_id % 4 == 0, "lexical_overlap")
         .when(d.doc_id % 4 == 1, "subsequence")
         .otherwise("constituent").alias("heuristic"),
    )


def nli_pairs(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """Labelled text pairs of whole texts."""
    return as_pairs(nli_rows(spark, sf_dir, domain))


NLI_PAIRS_SQL = f"""nli_pairs AS (
  SELECT doc_id AS id,
         CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN lang = 'en' THEN 'in' ELSE 'out' END AS domain,
         {_PREMISE_SQL} AS premise,
         {_HYPOTHESIS_SQL} AS hypothesis,
         CAST(CASE WHEN lang = 'en' THEN doc_id % 3 ELSE CAST(floor(doc_id / 4) AS BIGINT) % 2 END AS INTEGER) AS label,
         CASE doc_id % 4 WHEN 0 THEN 'lexical_overlap' WHEN 1 THEN 'subsequence' ELSE 'constituent' END AS heuristic
  FROM documents)"""


# ----------------------------------------------------------------------- quality_pairs
def quality_rows(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """Texts with a real signal: label = 1 - quality (0 = 'Yes', good document)."""
    d = _domain_filter(table(spark, sf_dir, "documents"), domain)
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train").alias("split"),
        F.when(F.col("lang") == "en", "in").otherwise("out").alias("domain"),
        "text",
        (F.lit(1) - F.col("quality")).cast("int").alias("label"),
    )


def quality_pairs(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """Pairs of whole texts with a real signal."""
    return as_pairs(quality_rows(spark, sf_dir, domain))


QUALITY_PAIRS_SQL = f"""quality_pairs AS (
  SELECT l.doc_id AS id,
         CASE WHEN l.doc_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN d.lang = 'en' THEN 'in' ELSE 'out' END AS domain,
         {_PREMISE_SQL} AS premise,
         {_HYPOTHESIS_SQL} AS hypothesis,
         CAST(1 - l.quality AS INTEGER) AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# -------------------------------------------------------------------------- vec_points
def vec_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        e.vec_id.alias("id"),
        e.embedding.cast("array<double>").alias("features"),
        (e.label >= 5).cast("int").alias("y"),
        F.when(e.vec_id % 5 == 0, "validation").otherwise("train").alias("split"),
        F.when(e.vec_id % 2 == 0, "in").otherwise("out").alias("domain"),
    )


VEC_POINTS_SQL = """vec_points AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features,
         CAST(label >= 5 AS INTEGER) AS y,
         CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN vec_id % 2 = 0 THEN 'in' ELSE 'out' END AS domain
  FROM embeddings)"""


# ------------------------------------------------------------------------- predictions
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers next to the actual label of cleaned pairs (both domains)."""
    p = nli_pairs(spark, sf_dir)
    p = p.filter(~((p.domain == "in") & (p.label == 1)))
    label = F.when((p.domain == "in") & (p.label == 2), 1).otherwise(p.label)
    answers = F.array(*[F.lit(a) for a in ANSWER_STRINGS])
    sizes = F.array(*[F.lit(s) for s in (2, 4, 8, 16)])
    return p.select(
        "id", "domain",
        F.when(p.id % 2 == 0, MODEL_NAMES[0]).otherwise(MODEL_NAMES[1]).alias("model_name"),
        F.element_at(sizes, (F.floor(p.id / 2) % 4 + 1).cast("int")).alias("sample_size"),
        (F.floor(p.id / 8) % 10).cast("int").alias("trial"),
        F.element_at(answers, (p.id % len(ANSWER_STRINGS) + 1).cast("int")).alias("generated"),
        label.cast("int").alias("label"),
    )


def sql_text(s: str) -> str:
    """A string as a SQL expression."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))


def _sql_answers() -> str:
    return "[" + ", ".join(map(sql_text, ANSWER_STRINGS)) + "]"


PREDICTIONS_SQL = f"""predictions AS (
  SELECT id, domain,
         CASE WHEN id % 2 = 0 THEN '{MODEL_NAMES[0]}' ELSE '{MODEL_NAMES[1]}' END AS model_name,
         [2, 4, 8, 16][CAST(floor(id / 2) AS BIGINT) % 4 + 1] AS sample_size,
         CAST(CAST(floor(id / 8) AS BIGINT) % 10 AS INTEGER) AS trial,
         {_sql_answers()}[id % {len(ANSWER_STRINGS)} + 1] AS generated,
         CAST(CASE WHEN domain = 'in' AND label = 2 THEN 1 ELSE label END AS INTEGER) AS label
  FROM nli_pairs WHERE NOT (domain = 'in' AND label = 1))"""


# ------------------------------------------------------------------------------ logits
CLASSES = 32        # the 64 elements of a vector are the logits of two models


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    emb = e.embedding.cast("array<double>")
    return e.select(
        e.vec_id.alias("id"),
        F.slice(emb, 1, CLASSES).alias("teacher"),
        F.slice(emb, CLASSES + 1, CLASSES).alias("student"),
        e.label.cast("int").alias("label"),
    )


LOGITS_SQL = f"""logits AS (
  SELECT vec_id AS id,
         CAST(embedding AS DOUBLE[])[1:{CLASSES}] AS teacher,
         CAST(embedding AS DOUBLE[])[{CLASSES + 1}:{2 * CLASSES}] AS student,
         CAST(label AS INTEGER) AS label
  FROM embeddings)"""


# ----------------------------------------------------------------------- trial_metrics
def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per (model, size, method, trial); a method without training has
    null train_* columns, exactly like a log of an inference-only method."""
    li = table(spark, sf_dir, "lineitem")
    k = li.l_orderkey % 3
    method = F.when(li.l_linestatus == "F",
                    F.when(k == 0, METHODS_F[0]).when(k == 1, METHODS_F[1]).otherwise(METHODS_F[2])) \
              .otherwise(F.when(k == 0, METHODS_O[0]).when(k == 1, METHODS_O[1]).otherwise(METHODS_O[2]))
    trains = method.isin("fewshot", "fewshot_lora")
    return li.select(
        li.l_returnflag.alias("model_name"),
        li.l_linenumber.alias("sample_size"),
        method.alias("finetuning_method"),
        li.l_orderkey.alias("trial"),
        F.when(trains, li.l_quantity * 3.0).alias("train_runtime"),
        F.when(trains, F.lit(2000.0) / li.l_quantity).alias("train_samples_per_second"),
        F.when(trains, F.lit(250.0) / li.l_quantity).alias("train_steps_per_second"),
        F.when(trains, li.l_extendedprice * 1e6).alias("total_flos"),
        F.when(trains, F.lit(40.0)).alias("epoch"),
        F.when(trains, li.l_extendedprice / 3e5).alias("train_loss"),
        F.when(trains, li.l_tax * 20.0).alias("train_peak_memory_gb"),
        (li.l_extendedprice / 1e5).alias("eval_in_loss"),
        li.l_discount.alias("eval_in_accuracy"),
        li.l_quantity.alias("eval_in_runtime"),
        (F.lit(50.0) / li.l_quantity).alias("eval_in_samples_per_second"),
        F.when(trains, F.lit(7.0) / li.l_quantity).alias("eval_in_steps_per_second"),
        (li.l_discount * 10).alias("eval_in_peak_memory_gb"),
        (li.l_extendedprice / 2e5).alias("eval_out_loss"),
        li.l_tax.alias("eval_out_accuracy"),
        (li.l_quantity + li.l_linenumber).alias("eval_out_runtime"),
        (F.lit(50.0) / (li.l_quantity + li.l_linenumber)).alias("eval_out_samples_per_second"),
        F.when(trains, F.lit(7.0) / (li.l_quantity + li.l_linenumber)).alias("eval_out_steps_per_second"),
        (li.l_tax * 10).alias("eval_out_peak_memory_gb"),
    )


TRIAL_METRICS_SQL = f"""trial_metrics AS (
  SELECT l_returnflag AS model_name, l_linenumber AS sample_size,
         CASE WHEN l_linestatus = 'F' THEN
              CASE l_orderkey % 3 WHEN 0 THEN '{METHODS_F[0]}' WHEN 1 THEN '{METHODS_F[1]}' ELSE '{METHODS_F[2]}' END
         ELSE CASE l_orderkey % 3 WHEN 0 THEN '{METHODS_O[0]}' WHEN 1 THEN '{METHODS_O[1]}' ELSE '{METHODS_O[2]}' END
         END AS finetuning_method,
         l_orderkey AS trial,
         l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber
  FROM lineitem),
trial_metrics_x AS (
  SELECT model_name, sample_size, finetuning_method, trial,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN l_quantity * 3.0 END AS train_runtime,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN 2000.0 / l_quantity END AS train_samples_per_second,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN 250.0 / l_quantity END AS train_steps_per_second,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN l_extendedprice * CAST(1e6 AS DOUBLE) END AS total_flos,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN CAST(40 AS DOUBLE) END AS epoch,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN l_extendedprice / 3e5 END AS train_loss,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN l_tax * 20.0 END AS train_peak_memory_gb,
         l_extendedprice / 1e5 AS eval_in_loss, l_discount AS eval_in_accuracy, l_quantity AS eval_in_runtime,
         50.0 / l_quantity AS eval_in_samples_per_second,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN 7.0 / l_quantity END AS eval_in_steps_per_second, l_discount * 10 AS eval_in_peak_memory_gb,
         l_extendedprice / 2e5 AS eval_out_loss, l_tax AS eval_out_accuracy,
         l_quantity + l_linenumber AS eval_out_runtime,
         50.0 / (l_quantity + l_linenumber) AS eval_out_samples_per_second,
         CASE WHEN finetuning_method IN ('fewshot', 'fewshot_lora') THEN 7.0 / (l_quantity + l_linenumber) END AS eval_out_steps_per_second, l_tax * 10 AS eval_out_peak_memory_gb
  FROM trial_metrics)"""


# --------------------------------------------------------------------------- telemetry
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-loop callback events: one run per user, memory reading in ``memory``."""
    ev = table(spark, sf_dir, "events")
    kind = (F.when(ev.event_type == "signup", "train_begin")
             .when(ev.event_type == "purchase", "train_end")
             .when(ev.event_type == "view", "prediction_step")
             .when(ev.event_type == "click", "log")
             .when(ev.event_type == "error", "step"))
    return ev.select(ev.user_id.alias("run"), ev.event_id, ev.ts, kind.alias("kind"),
                     ev.value.alias("memory"))


TELEMETRY_SQL = """telemetry AS (
  SELECT user_id AS run, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'train_begin' WHEN 'purchase' THEN 'train_end'
              WHEN 'view' THEN 'prediction_step' WHEN 'click' THEN 'log' WHEN 'error' THEN 'step' END AS kind,
         value AS memory
  FROM events)"""


# ------------------------------------------------------------------------- log_entries
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer log: clicks are training entries (``loss``), views validation entries
    (``eval_loss``); a missing key is a null column.  ``seq`` orders entries in a run."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return ev.select(
        ev.user_id.alias("run"), ev.ts, ev.event_id,
        F.when(ev.event_type == "click", ev.value).alias("loss"),
        F.when(ev.event_type == "view", ev.value).alias("eval_loss"),
    )


LOG_ENTRIES_SQL = """log_entries AS (
  SELECT user_id AS run, ts, event_id,
         CASE WHEN event_type = 'click' THEN value END AS loss,
         CASE WHEN event_type = 'view' THEN value END AS eval_loss
  FROM events WHERE event_type IN ('click', 'view'))"""


# ------------------------------------------------------------------------- param_table
def param_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(p.p_partkey.alias("param_id"), p.p_brand.alias("layer"),
                    p.p_size.cast("long").alias("n"), (p.p_size % 4 == 0).alias("trainable"))


PARAM_TABLE_SQL = """param_table AS (
  SELECT p_partkey AS param_id, p_brand AS layer, CAST(p_size AS BIGINT) AS n,
         (p_size % 4 = 0) AS trainable
  FROM part)"""


# ------------------------------------------------------------------------------ corpus
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(d.doc_id, d.text)


VIEW_SQL = {
    "nli_pairs": NLI_PAIRS_SQL,
    "quality_pairs": QUALITY_PAIRS_SQL,
    "vec_points": VEC_POINTS_SQL,
    "predictions": NLI_PAIRS_SQL + ",\n" + PREDICTIONS_SQL,
    "logits": LOGITS_SQL,
    "trial_metrics": TRIAL_METRICS_SQL,
    "telemetry": TELEMETRY_SQL,
    "log_entries": LOG_ENTRIES_SQL,
    "param_table": PARAM_TABLE_SQL,
}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named views for an oracle query."""
    seen: list[str] = []
    for n in names:
        if n == "predictions" and "nli_pairs" in names:
            seen.append(PREDICTIONS_SQL)
        else:
            seen.append(VIEW_SQL[n])
    return "WITH " + ",\n".join(seen) + "\n"
