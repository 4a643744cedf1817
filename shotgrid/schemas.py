"""Explicit schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the original experiment's for identical results).
# D6 verbalisers.  Used inside in-context demonstrations, by label id 0, 1.
DEMO_VERBALISER = ["entailment", "contradiction"]
# Answer vocabulary of the closed-choice decoder, by label id 0, 1.
ANSWER_VERBALISER = ["Yes", "No"]
# Teacher context pieces (literal spaces and newlines matter).
TEACHER_QUESTION = (
    "The question you are trying to solve is whether the premise and hypothesis are a "
    "contradiction or an entailment. \n"
    "The answer is No when the premise and hypothesis are a contradiction and the answer is "
    "Yes when the hypothesis and \n"
    "premise are an entailment \n "
)
TEACHER_CONTRADICTION_EXPLANATION = (
    "Explanation: The answer is No because the premise and hypothesis are a contradiction. \n ")
TEACHER_ENTAILMENT_EXPLANATION = (
    "Explanation: The answer is Yes because the premise and hypothesis are an entailment. \n ")
TEACHER_EXAMPLE_INPUT = "Example input: "
TEACHER_CONTRADICTION_OUTPUT = "Example output: No \n "
TEACHER_ENTAILMENT_OUTPUT = "Example output: Yes \n "
TEACHER_END = "Now determine whether the following is a contradiction or an entailment.\n"
# Method names as written in metric-log file names and the combined log.
METHOD_NAMES = ["zeroshot", "icl", "fewshot", "fewshot_lora", "context_distillation",
                "recursive_context_distillation"]
# Columns averaged by the pivot report, in the report's (sorted) order.
PIVOT_METRICS = ["eval_in_accuracy", "eval_in_loss", "eval_in_peak_memory_gb", "eval_in_runtime",
                 "eval_out_accuracy", "eval_out_loss", "eval_out_peak_memory_gb", "eval_out_runtime"]
# Default chart metrics of the in/out-domain report.
REPORT_METRICS = ["accuracy", "runtime", "peak_memory_gb", "loss"]
# Experiment defaults: shot sizes, trials, evaluation rows, seed.
SAMPLE_SIZES = [2, 4, 8, 16]
NUM_TRIALS = 10
EVAL_SIZE = 50
LARGE_SAMPLE_SIZE = 4096
MAX_LENGTH = 512
SEED = 42
# ---------------------------------------------------------------------------------------

# Our own fixture values (not from the original experiment).
MODEL_NAMES = ["opt-125m", "opt-350m"]
METHODS_F = ["zeroshot", "icl", "fewshot"]
METHODS_O = ["fewshot_lora", "context_distillation", "recursive_context_distillation"]
ANSWER_STRINGS = ["  Yes,", "no", "I know", "maybe", "", "No, yes", "\n\tYES \n"]

PAIRS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("premise", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

_EVAL_FIELDS = ["loss", "accuracy", "runtime", "samples_per_second", "peak_memory_gb"]
_TRAINING_EVAL_FIELDS = ["loss", "accuracy", "runtime", "samples_per_second", "steps_per_second", "peak_memory_gb"]

INFERENCE_METRICS = T.StructType(
    [T.StructField("model_name", T.StringType()), T.StructField("sample_size", T.IntegerType())]
    + [T.StructField(f"eval_{d}_{m}", T.DoubleType()) for d in ("in", "out") for m in _EVAL_FIELDS]
)

TRAINING_METRICS = T.StructType(
    [T.StructField("model_name", T.StringType()), T.StructField("sample_size", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("train_runtime", "train_samples_per_second", "train_steps_per_second", "total_flos", "train_loss", "epoch",
        "train_peak_memory_gb")]
    + [T.StructField(f"eval_{d}_{m}", T.DoubleType()) for d in ("in", "out") for m in _TRAINING_EVAL_FIELDS]
)

HISTORY = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("sample_size", T.IntegerType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
])


TRAINED_METHODS = ("fewshot", "fewshot_lora")


def metrics_schema(method: str) -> T.StructType:
    return TRAINING_METRICS if method in TRAINED_METHODS else INFERENCE_METRICS
