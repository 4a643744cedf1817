"""String expressions: prompts, answer parsing, display labels.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotgrid.schemas import (ANSWER_VERBALISER, DEMO_VERBALISER, TEACHER_CONTRADICTION_EXPLANATION,
                              TEACHER_CONTRADICTION_OUTPUT, TEACHER_END, TEACHER_ENTAILMENT_EXPLANATION,
                              TEACHER_ENTAILMENT_OUTPUT, TEACHER_EXAMPLE_INPUT, TEACHER_QUESTION)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minimal_pattern(premise="premise", hypothesis="hypothesis", context=None) -> Column:
    """``context + premise + ' ' + hypothesis + '?'``; a non-empty context gets one space."""
    body = F.concat(_col(premise), F.lit(" "), _col(hypothesis), F.lit("?"))
    if context is None:
        return body
    ctx = F.lit(context) if isinstance(context, str) else context
    prefix = F.when(ctx.isNull() | (ctx == ""), F.lit("")).otherwise(F.concat(ctx, F.lit(" ")))
    return F.concat(prefix, body)


def demo_text(premise="premise", hypothesis="hypothesis", label="label", separator=",") -> Column:
    """One in-context demonstration: ``'{premise} {hypothesis} ?' + verbal(label) + sep``."""
    verbal = F.element_at(F.array(*[F.lit(v) for v in DEMO_VERBALISER]), _col(label) + 1)
    return F.concat(_col(premise), F.lit(" "), _col(hypothesis), F.lit(" ?"), verbal, F.lit(separator))


def teacher_context(contra_premise, contra_hypothesis, entail_premise, entail_hypothesis) -> Column:
    """Teacher instruction with one contradiction and one entailment example."""
    return F.concat(
        F.lit(TEACHER_QUESTION),
        F.lit(TEACHER_EXAMPLE_INPUT), _col(contra_premise), F.lit(" "), _col(contra_hypothesis), F.lit("?\n"),
        F.lit(TEACHER_CONTRADICTION_OUTPUT), F.lit(TEACHER_CONTRADICTION_EXPLANATION),
        F.lit(TEACHER_EXAMPLE_INPUT), _col(entail_premise), F.lit(" "), _col(entail_hypothesis), F.lit("?\n"),
        F.lit(TEACHER_ENTAILMENT_OUTPUT), F.lit(TEACHER_ENTAILMENT_EXPLANATION),
        F.lit(TEACHER_END),
    )


def clean_answer(text) -> Column:
    """Python ``text.strip().lower().rstrip(',')`` as column functions."""
    t = F.regexp_replace(_col(text), r"^\s+", "")
    t = F.regexp_replace(t, r"\s+$", "")
    return F.regexp_replace(F.lower(t), ",+$", "")


def parse_answer(text, actual) -> Column:
    """'yes' anywhere -> 0, else 'no' anywhere -> 1, else the wrong label ``1 - actual``."""
    t = clean_answer(text)
    return (F.when(t.contains("yes"), F.lit(0))
             .when(t.contains("no"), F.lit(1))
             .otherwise(F.lit(1) - _col(actual))).cast("int")


def is_parsed(text) -> Column:
    t = clean_answer(text)
    return t.contains("yes") | t.contains("no")


def answer_word(label) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in ANSWER_VERBALISER]), _col(label) + 1)


def method_from_file(name) -> Column:
    """Method of a metrics log from its file name; the order of the tests matters."""
    n = _col(name)
    return (F.when(n.contains("fewshot_lora"), F.lit("fewshot_lora"))
             .when(n.contains("context_distillation") & n.contains("recursive"),
                   F.lit("recursive_context_distillation"))
             .when(n.contains("context_distillation"), F.lit("context_distillation"))
             .otherwise(F.split(n, "_").getItem(0)))


def display_label(method, size) -> Column:
    m, s = _col(method), _col(size).cast("string")
    return (F.when(m == "context_distillation", F.concat(F.lit("CD ("), s, F.lit(")")))
             .when(m == "recursive_context_distillation", F.concat(F.lit("CD_recursive ("), s, F.lit(")")))
             .when(m == "zeroshot", F.lit(""))
             .otherwise(F.concat(m, F.lit(" ("), s, F.lit(")"))))


def metric_title(metric) -> Column:
    """Chart title of a metric: fixed titles for two, else Python ``str.capitalize``."""
    m = _col(metric)
    cap = F.concat(F.upper(F.substring(m, 1, 1)), F.lower(F.substring(m, 2, 1 << 30)))
    return (F.when(m == "runtime", F.lit("Runtime (s)"))
             .when(m == "peak_memory_gb", F.lit("Peak Memory Usage (GB)"))
             .otherwise(cap))
