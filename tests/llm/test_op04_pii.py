import random
import re

from pyspark.sql import functions as F

from retail_signal.llm import pii as P
from .helpers import frame, odd_rows


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base(text):
    found = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(f"card:{m.start()}:{m.end()}")
    found += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(found)


PARTS = ["a", "b.c", "@", "x-y", ".", "_", "%", "+", "1", "23", "456", "255", "256", " ", "-", "  ", "(", ")", "4111111111111111",
         "4111 1111 1111 1111", "\n", "é", "\U0001F600", "", "", "1.2.3.4", "0000255", "a@b.c", "+1 (234) 555-6789",
         "..", "--", "@@", "d.e", "5500-0000-0000-0004", "a_b@c.d_e@f.g"]


def test_known_forms_equal_the_plain_patterns(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["1" * 30_000, "1 " * 20_000, "a@" + "b." * 20_000 + "c", "a" * 50_000, "1." * 20_000, "+1" + " 1" * 20_000,
              "x" * 50_000 + "@y.z"]
    got = P.spans(frame(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.known) == base(texts[r.doc_id])


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"hello phone: +1 234 555 {1000 + i} ok w{i}") for i in range(30)]
    rows += [(100 + i, f"some phone: 0171-{i}23-99. More the 12345678") for i in range(5)]
    rows += [(200 + i, f"the +1 234 777 {1000 + i} end the house the tree the sky") for i in range(10)]
    got = {r.doc_id: r.context for r in P.extract(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(5):
        assert [(s.kind, s.value) for s in got[100 + i]] == [("context", f"0171-{i}23-99")]
    assert not any(got[i] for i in got if not 100 <= i < 105)  # "the" is no pattern


def test_instances_found_in_one_round_support_patterns_of_the_next(spark):
    rows = [(i, f"dial: +1 234 555 {1000 + i} today") for i in range(20)]
    rows += [(100 + i, f"dial: 0171-{i:02}3-99 tonight:") for i in range(20)]  # teaches "after tonight:"
    rows += [(200, "mobile 0999-444-11 tonight:")]
    got = {r.doc_id: [s.value for s in r.context] for r in P.extract(frame(spark, rows), P.BootSpec(rounds=3)).collect()}
    assert got[105] == ["0171-053-99"] and got[200] == ["0999-444-11"]
    once = {r.doc_id: [s.value for s in r.context] for r in P.extract(frame(spark, rows), P.BootSpec(rounds=1)).collect()}
    assert once[105] and not once[200]


def test_prose_without_digits_counts_against_a_pattern(spark):
    rows = [(i, f"about +1 234 555 {1000 + i} w") for i in range(10)] + [(50, "about 0171-023-99 x")]
    rows += [(100 + i, "they talk about rain and hills") for i in range(100)]
    assert not any(r.context for r in P.extract(frame(spark, rows)).collect())
    totals = P.pattern_totals(frame(spark, rows), spark.createDataFrame([("before about",)], "pattern string")).first()
    assert totals.total == 111


def test_chosen_pairs_are_those_that_occur(spark):
    edges = spark.createDataFrame([(f"before p{i}", f"v{i}", None if i % 2 else "phone", 1) for i in range(40)],
                                  "pattern string, value string, kind string, n long")
    patterns = spark.createDataFrame([(f"before p{i}", "phone", 0.9) for i in range(39)], "pattern string, kind string, confidence double")
    instances = spark.createDataFrame([(f"v{i}", "phone", 0.9) for i in range(40)] + [("v1", "card", 0.9)],
                                      "value string, kind string, confidence double")
    got = P.chosen_pairs(edges, patterns, instances).collect()
    assert sorted((r.value, r.pattern) for r in got) == sorted((f"v{i}", f"before p{i}") for i in range(1, 39, 2))


def test_identifiers_of_groups_few_digits_or_none(spark):
    rows = [(i, f"hello phone: +1 234 555 {1000 + i} ok then") for i in range(60)]
    unseen = ["(555) 123 4567", "078 05 1120", "DE89 3704 0044 0532 0130 00", "johnny", "AB12CD", "4711", "Zoë"]
    rows += [(100 + i, f"my  phone: {v}, and so on") for i, v in enumerate(unseen)]
    got = {r.doc_id: r.context for r in P.extract(frame(spark, rows)).collect()}
    for i, v in enumerate(unseen):
        text = dict(rows)[100 + i]
        assert [text[s.start:s.end] for s in got[100 + i]] == [s.value for s in got[100 + i]] == [v.lstrip("(")]
    assert not any(got[i] for i in range(60))


def test_main_path_is_native(spark):
    plan = P.extract(frame(spark, [(1, "call +1 234 555 1000 now")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_and_empty_tables(spark):
    got = P.extract(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert P.extract(frame(spark, [])).count() == 0
    digest = P.op4_pii_context(spark, "/root/testdata/sf0.001").where(F.length("base_sha256") != 64)
    assert digest.count() == 0
