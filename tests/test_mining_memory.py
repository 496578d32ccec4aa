"""FP-growth on coded baskets (M4)."""

from retail_signal.operators import domains as dm


def _rows(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 or None) for i in range(60)], "store long, a int, b boolean")


CONDITIONS = {"even": "a = 0", "odd": "a = 1", "third": "b"}


def test_coded_baskets_give_the_itemsets_and_rules_of_the_names(spark):
    rows = _rows(spark)
    named = dm.transaction_items(rows, CONDITIONS, ["store"])
    coded = dm.transaction_items(rows, CONDITIONS, ["store"], coded=True)
    assert dict(coded.dtypes)["items"] == "array<int>"
    names = list(CONDITIONS)
    sets = {(tuple(sorted(r["items"])), r.freq) for r in dm.frequent_itemsets(coded, 0.1, names).collect()}
    assert sets == {(("even",), 30), (("odd",), 30), (("third",), 20), (("even", "third"), 10), (("odd", "third"), 10)}
    assert sets == {(tuple(sorted(r["items"])), r.freq) for r in dm.frequent_itemsets(named, 0.1).collect()}

    def rules(found):
        return {(tuple(sorted(r.antecedent)), tuple(r.consequent), round(r.confidence, 9), round(r.lift, 9), round(r.support, 9)) for r in found.collect()}
    mined = rules(dm.mine_rules(coded, 0.1, 0.3, names))
    assert mined == rules(dm.mine_rules(named, 0.1, 0.3))
    assert {(a, c) for a, c, *_ in mined} == {(("third",), ("even",)), (("third",), ("odd",)), (("even",), ("third",)), (("odd",), ("third",))}


def test_no_basket_stays_held(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    dm.mine_rules(dm.transaction_items(_rows(spark), CONDITIONS, ["store"], coded=True), 0.1, 0.3, list(CONDITIONS)).collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
