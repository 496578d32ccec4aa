from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_signal.llm import toxicity as T
from .helpers import frame, odd_rows, prose

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def costs(spark):
    return T.character_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("seen, words", [
    ("you 1d10t", ["you", "idiot"]), ("i d i o t", ["idiot"]), ("STUUUPIIID!!", ["stupid"]),
    ("$cum and tr4$h", ["scum", "and", "trash"]), ("w.o.r.t.h.l.e.s.s", ["worthless"]), ("Version 2.0.", ["version", "2.0"]),
])
def test_restores(costs, seen, words):
    assert T.Restorer(costs).words(seen) == words


@pytest.mark.parametrize("seen, words", [
    ("m.0.r.0.n", ["moron"]), ("1.d.1.0.t", ["idiot"]), ("st.up.id", ["stupid"]), ("stuupid", ["stupid"]),
    ("iiddiioott", ["idiot"]), ("a$$ dumba$$", ["ass", "dumbass"]), ("!diot", ["idiot"]), ("you i d i o t. he", ["you", "idiot", "he"]),
    ('"m o r o n!"', ["moron"]), ("stupid$$$ THE!! OF,!!", ["stupid", "the", "of"]), ("455 ass hello", ["455", "ass", "hello"]),
    ("a" + "idiot" + "t" * 100, ["aidiot"]), ("i/d/i/o/t", ["idiot"]), ("1/d/1/0/t", ["idiot"]), ("i~d~i~o~t", ["idiot"]),
    ("i,d,i,o,t", ["idiot"]), ("you (i) (d) (i) (o) (t)", ["you", "idiot"]), ("i d i o t!!!!!!!!!!", ["idiot"]),
    ("and/or 1/2/3 (a) b.", ["and/or", "1/2/3", "a", "b"]),
])
def test_restores_every_form_of_disguise(costs, seen, words):
    assert T.Restorer(costs).words(seen) == words


def test_viterbi_is_the_best_of_all_paths(costs):
    table = costs.tolist()

    def best(seen):
        options, before = [], ""
        for c in seen:
            steps = [(c, T._symbol(c), 0.0)] + [(x, ord(x) - 96, T.LEET_COST) for x in T.LEET.get(c, "")]
            if c == before:
                steps.append(("", None, T.DROP_REPEAT_COST))
            options.append(steps)
            before = c
        least = None
        for path in product(*options):
            a = b = T.BOUNDARY
            cost = 0.0
            for _, s, channel in path:
                cost += channel
                if s is not None:
                    cost += table[a][b][s]
                    a, b = b, s
            cost += table[a][b][T.BOUNDARY]
            if least is None or cost < least[0] - 1e-9:
                least = (cost, "".join(o for o, _, _ in path))
        return least[1]
    for seen in ("1d10t", "l00ser", "7r4sh", "sssc|m", "m0rr0n", "2b8"):
        assert T.viterbi(seen, table) == best(seen)


def test_trigram_costs_are_probabilities(costs):
    assert np.allclose(np.exp(-costs).sum(-1), 1, atol=1e-3)


def test_held_out_accuracy(spark):
    got = T.op1_toxicity_viterbi(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.sum(F.expr("cast(predicted = 1 and toxic = 1 as int)")).alias("tp"),
                F.sum("predicted").alias("p"), F.sum("toxic").alias("t")).first()
    assert r.tp / r.p > 0.95 and r.tp / r.t > 0.9


def test_disguised_documents_score_like_plain_ones(spark):
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, prose(30, i) + (" what a moron they are" if i < 20 else "")) for i in range(60)]
    rows += [(100, prose(30, 100) + " what a m0r0n they are"), (101, prose(30, 101) + " what a m o r o n they are"),
             (102, prose(30, 102) + " what a moooron they are"), (103, prose(30, 103) + " home again on the hills")]
    got = {r.doc_id: r.score for r in T.toxicity_scores(frame(spark, rows), labels, F.lit(True)).collect()}
    assert min(got[100], got[101], got[102]) > 0.3 > got[103]


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, 1), (99, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(frame(spark, odd_rows()), labels, F.lit(True)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity_scores(frame(spark, []), labels, F.lit(True)).count() == 0
    none = T.toxicity_scores(frame(spark, odd_rows()), labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
