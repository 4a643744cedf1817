"""The DuckDB oracle gate on a fast subset of the registered queries (sf0.01);
``tools/oracle_check.py`` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.01"
FAST = ["remove_neutral", "trial_grid", "icl_context", "teacher_context", "parse_answers", "causal_metrics",
        "domain_metrics", "softmax_temp", "distill_loss", "phase_tags", "phase_peaks", "history_long",
        "means_by_config", "vs_baseline", "report_rows", "build_vocab", "pad_truncate", "zero_shot",
        "score_head", "param_counts", "method_from_file", "context_distill", "recursive_distill", "params_roundtrip",
        "answer_choices", "decode_tokens", "experiment_grid", "metrics_roundtrip", "combined_metrics", "learning_curves",
        "materialize_dataset", "rename_domain", "distinct_keys", "group_report", "filter_keys", "model_plugin",
        "gradient_steps", "gradient_params", "fit_history", "validation_subset_out",
        "subword_roundtrip", "choice_decode", "icl_eval", "encode_tokens", "distill_sets", "training_schedule"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_registered_with_sql_or_rows_only():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    # all queries but those of the training-data operators that SQL can't express
    assert all(n.startswith("op") or n == "pipeline" for n in set(q) - set(s))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.sql(E.oracle_sql()[name]).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    assert sc == dc
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["sample_size", "trial", "n_demos", "context"]
