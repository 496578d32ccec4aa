"""Every registered query of the subpackage on the smallest tables."""

import pytest

import __spark_entry__ as E
from retail_signal.llm import registry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
#: The columns that the queries' contracts name.
COLUMNS = {
    "op1_toxicity_viterbi": {"doc_id", "held_out", "score", "predicted"},
    "op2_benchmark_edits": {"doc_id", "item_id", "distance"},
    "op3_secret_entropy": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4_pii_context": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5_revisit_asof": {"record_id", "status", "origin_id"},
    "op6_token_records": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op7_quality_pu": {"doc_id", "held_out", "score", "predicted"},
    "op8_simhash_pivots": {"doc_id", "fingerprint", "component_id"},
    "op9_risk_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op10_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op11_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_phrase_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op13_slack_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
}


def test_all_and_the_pipeline_are_registered():
    assert set(registry.QUERIES) == {*COLUMNS, "pipeline"} <= set(E.queries())
    assert set(registry.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_whole_table_and_columns(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    n = got.count()
    if name not in ("op2_benchmark_edits", "op5_revisit_asof", "op12_phrase_collocations", "op13_slack_packing"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, name):
    res = compare(spark, duck(SF), name, registry.QUERIES[name], registry.SQL[name], SF)
    assert res["ok"], res
