import corpus_pipeline as C
from pyspark.sql import functions as F

from retail_signal.llm import decontam, mixing, quality, records, simhash
from retail_signal.llm.common import materialise, table
from .helpers import frame, odd_rows

SF = "/root/testdata/sf0.01"


def test_run_equals_the_stages_one_by_one(spark):
    """Each decision taken anew from the operators' tables, row by row."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    kept = {r.doc_id for r in quality.op7_quality_pu(spark, SF).where("predicted = 1").collect()}
    left = table(spark, SF, "documents").where(F.col("doc_id").isin(list(kept)))
    kept = {r.doc_id for r in simhash.near_duplicates(left).collect() if r.doc_id == r.component_id}
    items = [decontam.normal(r.text) for r in table(spark, SF, "benchmark").collect()]

    def clean(text):
        text = decontam.normal(text)
        return all(decontam.myers(decontam.masks(i), len(i), text)[0] > int(len(i) * 0.1) for i in items)
    kept = {i for i in kept if clean(docs[i].text)}
    left = table(spark, SF, "documents").where(F.col("doc_id").isin(list(kept)))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix_table(left).collect() if r.size}
    got = C.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_odd_rows_and_empty_tables_pass_all_stages(spark):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        for name, stage in C.STAGES[:-1]:
            out = materialise(stage(spark, docs, SF), name)
            assert out.columns == docs.columns
            docs = out
        n = docs.count()
        assert C.token_stage(spark, docs, SF).count() == n


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert records.END_ID == 2 and C.ORACLE_SQL is None
