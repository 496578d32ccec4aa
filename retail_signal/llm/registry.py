"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_phrase_collocations
from .decontam import op2_benchmark_edits
from .mixing import OP10_SQL, op10_source_mix
from .packing import op13_slack_packing
from .periodic import op11_periodic_runs
from .pii import op4_pii_context
from .quality import op7_quality_pu
from .records import op6_token_records
from .revisits import OP5_SQL, op5_revisit_asof
from .rules import op9_risk_rules
from .secrets import op3_secret_entropy
from .simhash import op8_simhash_pivots
from .toxicity import op1_toxicity_viterbi

QUERIES = {
    "op1_toxicity_viterbi": op1_toxicity_viterbi,
    "op2_benchmark_edits": op2_benchmark_edits,
    "op3_secret_entropy": op3_secret_entropy,
    "op4_pii_context": op4_pii_context,
    "op5_revisit_asof": op5_revisit_asof,
    "op6_token_records": op6_token_records,
    "op7_quality_pu": op7_quality_pu,
    "op8_simhash_pivots": op8_simhash_pivots,
    "op9_risk_rules": op9_risk_rules,
    "op10_source_mix": op10_source_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_slack_packing": op13_slack_packing,
}

SQL = {
    "op5_revisit_asof": OP5_SQL,
    "op10_source_mix": OP10_SQL,
    "op12_phrase_collocations": OP12_SQL,
}


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after the other, over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
