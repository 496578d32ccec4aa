import random

import duckdb
import pytest

from retail_signal.llm import mixing as M
from .helpers import frame, odd_rows, prose


def _docs(seed, n=300):
    rnd = random.Random(seed)
    sources = ["hot"] * 5 + ["é", "Z", "a", "b", None]
    return [(i // 2 if i % 11 == 0 else i, prose(rnd.choice([0, 1, 5, 50, 400]), i), "en", rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("spec", [M.MixSpec(), M.MixSpec(bits=2, levels=1), M.MixSpec(bits=1, levels=4), M.MixSpec(bits=20, levels=3)])
def test_equals_the_sorted_definition(spark, spec):
    import pandas as pd
    rows = _docs(1)
    got = sorted(map(tuple, M.mix_table(frame(spark, rows), spec).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]))
    want = sorted(con.execute(M.OP10_SQL).fetchall(), key=str)
    assert got == want


def test_targets_are_met_and_capped(spark):
    rows = M.mix_table(frame(spark, _docs(2))).collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken <= 2 * r.size
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) * 2


def test_budgets_are_nested(spark):
    docs = frame(spark, _docs(3))
    small, large = ({(r.doc_id, r.size): r.taken for r in M.mix_table(docs, M.MixSpec(share=s)).collect()} for s in (0.4, 0.7))
    assert all(large[k] >= v for k, v in small.items())


def test_mix_repeats_rows(spark):
    docs = frame(spark, _docs(4))
    table = M.mix_table(docs)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(M.word_count(M.whole_text()).alias("n")).groupBy().sum("n").first()[0] == table.groupBy().sum("taken").first()[0]


def test_odd_rows_and_empty_tables(spark):
    got = M.mix_table(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert M.mix_table(frame(spark, [])).count() == 0 and M.mix(frame(spark, [])).count() == 0
    blank = M.mix_table(frame(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
