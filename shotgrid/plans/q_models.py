"""Registered queries: vocabulary and tokens, closed-choice scoring, zero-shot, ICL, grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotgrid.functions.text import minimal_pattern
from shotgrid.operators import subword as SW
from shotgrid.operators import tokens as TK
from shotgrid.plans import experiment as X
from shotgrid.plans import q_descent
from shotgrid.plans.q_report import round_doubles
from shotgrid.schemas import ANSWER_VERBALISER, EVAL_SIZE, MAX_LENGTH, SEED, TRAINING_METRICS
from shotgrid.operators.scorers import COUNT_MODELS, NB_VOCAB
from shotgrid.sources import datasets as D
from shotgrid.sources import views as V

VOCAB = 65_536          # size parameter of the vocabulary
MAX_LEN = MAX_LENGTH
ANSWERS = [w.lower() for w in ANSWER_VERBALISER]      # always in the vocabulary (E4)


def vocab(spark, sf):
    """The corpus vocabulary (the 'tokenizer'), built once per corpus and size, then loaded."""
    corpus = V.corpus(spark, sf)
    return D.materialized(spark, "vocab", [VOCAB, TK.TOKEN_PATTERN, *ANSWERS], corpus,
                          lambda: TK.build_vocab(corpus, VOCAB, always=ANSWERS))


def q_build_vocab(spark, sf):
    """E1 vocabulary build itself (always computed, never loaded)."""
    return TK.build_vocab(V.corpus(spark, sf), VOCAB, always=ANSWERS).select("token", "token_id", "n")


def q_encode_tokens(spark, sf):
    docs = V.corpus(spark, sf).withColumnRenamed("doc_id", "id")
    enc = TK.encode(docs, vocab(spark, sf), input_ids="text")
    return enc.select("id", F.size("input_ids").alias("n_tokens"), F.array_join("input_ids", " ").alias("ids"))


def _prompts(spark, sf):
    return V.nli_pairs(spark, sf).withColumn("text", minimal_pattern("premise", "hypothesis"))


def q_pad_truncate(spark, sf):
    enc = TK.encode(_prompts(spark, sf), vocab(spark, sf), input_ids="text")
    li, lm = TK.pad_truncate("input_ids", MAX_LEN, "left")
    ri, rm = TK.pad_truncate("input_ids", MAX_LEN, "right")
    return enc.select("id", *[F.array_join(c, " ").alias(n) for c, n in
                              ((li, "left_ids"), (lm, "left_mask"), (ri, "right_ids"), (rm, "right_mask"))])


def q_decode_tokens(spark, sf):
    v = vocab(spark, sf)
    enc = TK.encode(_prompts(spark, sf), v, input_ids="text", p_ids="premise")
    li, _ = TK.pad_truncate("input_ids", MAX_LEN, "left")
    gen = enc.select("id", F.concat(li, "p_ids", F.array(F.lit(TK.EOS))).alias("gen"))
    return TK.decode_suffix(gen, v, "gen", MAX_LEN)


def q_choice_decode(spark, sf):
    ch = X.zero_shot_choices(spark, sf)
    return round_doubles(ch.select("model_name", "domain", "id", "score0", "score1", "generated", "predicted"))


def q_zero_shot(spark, sf):
    return round_doubles(X.zero_shot(spark, sf))


def q_icl_eval(spark, sf):
    return round_doubles(X.icl_eval(spark, sf))


def q_experiment_grid(spark, sf):
    return round_doubles(X.experiment_grid(spark, sf))


def q_subword_roundtrip(spark, sf):
    """E1 with a pre-trained subword vocabulary: every text encoded to ids and decoded back."""
    docs = V.corpus(spark, sf).select(F.col("doc_id").alias("id"), "text")
    ids = SW.encode(docs, SW.default_file(), "text", "ids", SW.default_ranks())
    back = SW.decode(ids, SW.default_file(), "ids", "decoded", SW.default_ranks())
    return back.select("id", F.length("decoded").cast("long").alias("n_chars"), F.md5("decoded").alias("text_md5"))


def q_answer_choices(spark, sf):
    """Ids of the allowed answers in the corpus vocabulary."""
    return TK.choice_ids(vocab(spark, sf), ANSWERS)


QUERIES = {
    "answer_choices": q_answer_choices,
    "subword_roundtrip": q_subword_roundtrip,
    "build_vocab": q_build_vocab,
    "encode_tokens": q_encode_tokens,
    "pad_truncate": q_pad_truncate,
    "decode_tokens": q_decode_tokens,
    "choice_decode": q_choice_decode,
    "zero_shot": q_zero_shot,
    "icl_eval": q_icl_eval,
    "experiment_grid": q_experiment_grid,
}

# --------------------------------------------------------------------------- oracle SQL
_TOK = "regexp_extract_all(lower({}), '" + TK.TOKEN_PATTERN.replace("{", "{{").replace("}", "}}") + "')"
_VOCAB = f"""vn AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY token),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 3 AS INTEGER) AS token_id, n FROM (
    SELECT token, max(n) AS n FROM (
      SELECT * FROM (SELECT token, n FROM vn ORDER BY n DESC, token LIMIT {VOCAB})
      UNION ALL SELECT token, n FROM vn WHERE token IN ('yes', 'no')
      UNION ALL SELECT * FROM (VALUES ('yes', 0), ('no', 0))) GROUP BY token))"""


def _encode(src: str, text: str, name: str) -> str:
    return f"""{name}_t AS (SELECT id, unnest(toks) AS token, unnest(range(len(toks))) AS pos
                 FROM (SELECT id, {_TOK.format(text)} AS toks FROM {src})),
{name} AS (SELECT s.id, coalesce(e.ids, []) AS ids FROM {src} s LEFT JOIN (
             SELECT t.id, list(coalesce(v.token_id, 1) ORDER BY t.pos) AS ids
             FROM {name}_t t LEFT JOIN v ON t.token = v.token GROUP BY t.id) e ON s.id = e.id)"""


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
_PROMPTS = "prompts AS (SELECT id, premise || ' ' || hypothesis || '?' AS text, premise FROM nli_pairs)"


def _pad(side: str, what: str) -> str:
    t = f"ids[1:{MAX_LEN}]"
    pad = f"list_transform(range({MAX_LEN} - len({t})), lambda x: 0)"
    if what == "ids":
        body = t
        fill = pad
    else:
        body = f"list_transform(range(len({t})), lambda x: 1)"
        fill = pad
    parts = (fill, body) if side == "left" else (body, fill)
    return f"array_to_string(list_concat({parts[0]}, {parts[1]}), ' ')"


_MODELS = ", ".join(f"('{m.name}', CAST({m.alpha} AS DOUBLE), CAST({m.lam} AS DOUBLE), CAST({m.beta} AS DOUBLE))" for m in COUNT_MODELS)
_MD5 = "md5(concat_ws('|', '{seed}', 'q_eval', '{dom}', id))"
_SCORER = f"""cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY token),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS "N", count(*) AS "V" FROM cnt),
models AS (SELECT * FROM (VALUES {_MODELS}) m(model_name, alpha, lam, beta)),
ev AS (SELECT * FROM (SELECT 'in' AS domain, id, label, premise, hypothesis FROM quality_pairs
                      WHERE domain = 'in' AND split = 'validation'
                      ORDER BY {_MD5.format(seed=SEED, dom='in')}, id LIMIT {EVAL_SIZE})
       UNION ALL
       SELECT * FROM (SELECT 'out' AS domain, id, label, premise, hypothesis FROM quality_pairs WHERE domain = 'out'
                      ORDER BY {_MD5.format(seed=SEED, dom='out')}, id LIMIT {EVAL_SIZE})),
pt AS (SELECT m.model_name, m.alpha, m.lam, e.domain, e.id, e.label,
              unnest(CASE WHEN len(e.toks) = 0 THEN [NULL] ELSE e.toks END) AS token
       FROM (SELECT *, {_TOK.format("premise || ' ' || hypothesis || '?'")} AS toks FROM ev) e, models m),
hw AS (SELECT domain, id, token, count(*) AS n_h FROM (SELECT domain, id, unnest({_TOK.format('hypothesis')}) AS token FROM ev) GROUP BY ALL),
pw AS (SELECT domain, id, token, count(*) AS n_p FROM (SELECT domain, id, unnest({_TOK.format('premise')}) AS token FROM ev) GROUP BY ALL),
wd AS (SELECT m.model_name, e.domain, e.id, e.label, h.n_h, m.beta, coalesce(p.n_p, 0) / greatest(len({_TOK.format('e.premise')}), 1) AS share,
              (coalesce(c.n, 0) + m.alpha) / (tot."N" + m.alpha * (tot."V" + 1)) AS p
       FROM ev e CROSS JOIN models m CROSS JOIN tot LEFT JOIN hw h ON h.domain = e.domain AND h.id = e.id
       LEFT JOIN pw p ON p.domain = h.domain AND p.id = h.id AND p.token = h.token LEFT JOIN cnt c ON c.token = h.token),
zs AS (SELECT model_name, domain, id, label, coalesce(sum(n_h * ln(beta * share + (1 - beta) * p)), 0) AS score0, coalesce(sum(n_h * ln(p)), 0) AS score1
       FROM wd GROUP BY ALL)"""


def _choose(src: str) -> str:
    return f"""SELECT *, CASE WHEN contains(lower(generated), 'yes') THEN 0 WHEN contains(lower(generated), 'no') THEN 1
                ELSE 1 - label END AS predicted
         FROM (SELECT *, CASE WHEN score1 > score0 THEN 'No' ELSE 'Yes' END AS generated FROM {src})"""


_BCE = "(greatest(CAST(predicted AS DOUBLE), 0) - predicted * label + ln(1 + exp(-abs(CAST(predicted AS DOUBLE)))))"


def _dm(keys: str) -> str:
    return ", ".join(
        f"round(avg(CASE WHEN domain = '{d}' THEN {_BCE} END), 6) AS eval_{d}_loss, "
        f"round(avg(CASE WHEN domain = '{d}' THEN CAST(predicted = label AS DOUBLE) END), 6) AS eval_{d}_accuracy"
        for d in ("in", "out"))


_GRID_VALUES = ", ".join(f"({s}, {t})" for s, t in X.CELLS)
_ICL = f"""pool AS (SELECT id, premise, hypothesis, label FROM quality_pairs WHERE domain = 'in' AND split = 'train'),
trials AS (SELECT sample_size, trial, rn, id FROM (
    SELECT g.sample_size, g.trial, c.id, row_number() OVER (PARTITION BY g.sample_size, g.trial
           ORDER BY md5(concat_ws('|', '{SEED}', g.sample_size, g.trial, c.id)), c.id) AS rn
    FROM pool c, (VALUES {_GRID_VALUES}) g(sample_size, trial)) WHERE rn <= sample_size),
demos AS (SELECT t.sample_size, t.trial, p.label, p.premise, p.hypothesis FROM trials t JOIN pool p ON t.id = p.id),
dt AS (SELECT sample_size, trial, label, unnest({_TOK.format("premise || ' ' || hypothesis || '?'")}) AS token FROM demos),
nb AS (SELECT sample_size, trial, token, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS c0,
              sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS c1 FROM dt GROUP BY ALL),
tt AS (SELECT sample_size, trial, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS t0,
              sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS t1 FROM dt GROUP BY ALL),
pr AS (SELECT sample_size, trial, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS d0, count(*) AS dn FROM demos GROUP BY ALL),
ipt AS (SELECT pt.*, g.sample_size, g.trial FROM pt, (VALUES {_GRID_VALUES}) g(sample_size, trial)),
ll AS (SELECT i.model_name, i.alpha, i.lam, i.sample_size, i.trial, i.domain, i.id, i.label,
              coalesce(sum(CASE WHEN i.token IS NOT NULL THEN ln((coalesce(nb.c0, 0) + i.alpha) / (coalesce(tt.t0, 0) + i.alpha * {NB_VOCAB})) END), 0) AS ll0,
              coalesce(sum(CASE WHEN i.token IS NOT NULL THEN ln((coalesce(nb.c1, 0) + i.alpha) / (coalesce(tt.t1, 0) + i.alpha * {NB_VOCAB})) END), 0) AS ll1
       FROM ipt i LEFT JOIN nb ON i.sample_size = nb.sample_size AND i.trial = nb.trial AND i.token = nb.token
       LEFT JOIN tt ON i.sample_size = tt.sample_size AND i.trial = tt.trial GROUP BY ALL),
isc AS (SELECT ll.model_name, ll.sample_size, ll.trial, ll.domain, ll.id, ll.label,
               zs.score0 + ll.lam * (ll.ll0 + ln((pr.d0 + ll.alpha) / (pr.dn + 2 * ll.alpha))) AS score0,
               zs.score1 + ll.lam * (ll.ll1 + ln((pr.dn - pr.d0 + ll.alpha) / (pr.dn + 2 * ll.alpha))) AS score1
        FROM ll JOIN pr ON ll.sample_size = pr.sample_size AND ll.trial = pr.trial
        JOIN zs ON ll.model_name = zs.model_name AND ll.domain = zs.domain AND ll.id = zs.id AND ll.label = zs.label),
ich AS ({_choose('isc')}),
icl AS (SELECT model_name, sample_size, trial, {_dm('')} FROM ich GROUP BY model_name, sample_size, trial)"""

_ZSM = f"""zch AS ({_choose('zs')}),
zsm AS (SELECT model_name, CAST(sum(CASE WHEN domain = 'in' THEN 1 ELSE 0 END) AS INTEGER) AS sample_size, {_dm('')}
        FROM zch GROUP BY model_name)"""



def _log(measured: tuple[str, ...]) -> str:
    return ", ".join(f"CAST({f.name} AS DOUBLE) AS {f.name}" if f.name in measured and f.name.startswith(("train", "epoch", "eval")) else
                     f.name if f.name in measured else f"CAST(NULL AS DOUBLE) AS {f.name}" for f in TRAINING_METRICS.fields)


_SCORES = ("model_name", "sample_size", "eval_in_loss", "eval_in_accuracy", "eval_out_loss", "eval_out_accuracy")


def _grid_sql() -> str:
    parts = [f"SELECT {_log(_SCORES)}, '{m}' AS finetuning_method FROM ({V.with_views('quality_pairs')}, {_SCORER}, {_ZSM}, {_ICL} SELECT * FROM {t})"
             for m, t in (("zeroshot", "zsm"), ("icl", "icl"))]
    learners = {"fewshot": q_descent.SQL["fewshot_fit"], "fewshot_lora": q_descent.SQL["lora_fit"],
                "context_distillation": q_descent.distill_sql(False, None, None), "recursive_context_distillation": q_descent.distill_sql(True, None, None)}
    for m, sql in learners.items():
        parts.append(f"SELECT {_log((*_SCORES, 'train_loss', 'epoch') if 'fewshot' in m else _SCORES)}, '{m}' AS finetuning_method FROM ({sql})")
    return " UNION ALL ".join(parts)


SQL = {
    "answer_choices": f"WITH {_VOCAB} SELECT token, token_id FROM v WHERE token IN ('yes', 'no')",
    "build_vocab": f"WITH {_VOCAB} SELECT token, token_id, n FROM v",
    "subword_roundtrip": "SELECT doc_id AS id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "encode_tokens": f"WITH {_VOCAB}, {_DOCS}, {_encode('docs', 'text', 'enc')} "
                     "SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, array_to_string(ids, ' ') AS ids FROM enc",
    "pad_truncate": V.with_views("nli_pairs") + f", {_VOCAB}, {_PROMPTS}, {_encode('prompts', 'text', 'enc')} "
                    f"SELECT id, {_pad('left', 'ids')} AS left_ids, {_pad('left', 'mask')} AS left_mask, "
                    f"{_pad('right', 'ids')} AS right_ids, {_pad('right', 'mask')} AS right_mask FROM enc",
    "decode_tokens": V.with_views("nli_pairs") + f", {_VOCAB}, {_PROMPTS}, {_encode('prompts', 'text', 'enc')}, "
                     f"{_encode('prompts', 'premise', 'penc')}, "
                     f"""gen AS (SELECT e.id, list_concat(list_concat(list_transform(range({MAX_LEN} - len(e.ids[1:{MAX_LEN}])), lambda x: 0),
                                 e.ids[1:{MAX_LEN}]), list_concat(p.ids, [2])) AS g FROM enc e JOIN penc p ON e.id = p.id),
                         suf AS (SELECT id, list_filter(g[{MAX_LEN + 1}:], lambda x: x >= 3) AS s FROM gen),
                         su AS (SELECT id, unnest(s) AS tid, unnest(range(len(s))) AS pos FROM suf),
                         dec AS (SELECT su.id, string_agg(v.token, ' ' ORDER BY su.pos) AS txt FROM su JOIN v ON su.tid = v.token_id GROUP BY su.id)
                         SELECT suf.id, coalesce(dec.txt, '') AS generated_text FROM suf LEFT JOIN dec ON suf.id = dec.id""",
    "choice_decode": V.with_views("quality_pairs") + f", {_SCORER}, ch AS ({_choose('zs')}) "
                     "SELECT model_name, domain, id, round(score0, 6) AS score0, round(score1, 6) AS score1, "
                     "generated, CAST(predicted AS INTEGER) AS predicted FROM ch",
    "zero_shot": V.with_views("quality_pairs") + f", {_SCORER}, {_ZSM} SELECT * FROM zsm",
    "icl_eval": V.with_views("quality_pairs") + f", {_SCORER}, {_ICL} SELECT * FROM icl",
    "experiment_grid": _grid_sql(),
}
