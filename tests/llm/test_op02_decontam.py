import random

from hypothesis import given, settings
from hypothesis import strategies as st

from retail_signal.llm import decontam as D
from .helpers import frame, odd_rows, prose


def least_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=20), st.text("ab ", max_size=40))
def test_myers_is_the_edit_distance(p, t):
    assert D.myers(D.masks(p), len(p), t) == least_distance(p, t)


def _edited(text, n, rnd):
    s = list(text)
    for _ in range(n):
        at = rnd.randrange(len(s))
        kind = rnd.random()
        if kind < 0.4:
            s[at] = rnd.choice("abcxyz ")
        elif kind < 0.7:
            del s[at]
        else:
            s.insert(at, rnd.choice("abcxyz "))
    return "".join(s)


def test_no_passage_within_the_budget_is_missed():
    rnd = random.Random(5)
    items = [(i, prose(rnd.randint(6, 50), 1000 + i)) for i in range(30)]
    matcher = D.Matcher(items, 0.1)
    for trial in range(150):
        k = rnd.randrange(len(items))
        budget = int(len(items[k][1]) * 0.1)
        text = prose(50, trial) + " " + _edited(items[k][1], rnd.randint(0, budget), rnd) + " " + prose(50, 500 + trial)
        found = matcher.matches(text)
        assert k in found and found[k][0] <= budget


def test_matches_equal_brute_force():
    rnd = random.Random(6)
    items = [(i, prose(12, 2000 + i)) for i in range(8)]
    matcher = D.Matcher(items, 0.1)
    for trial in range(60):
        k = rnd.randrange(8)
        text = prose(20, trial) + " " + _edited(items[k][1], rnd.randint(0, 14), rnd)
        found = matcher.matches(text)
        for i, (_, item) in enumerate(items):
            distance = least_distance(item, text)[0]
            assert (i in found) == (distance <= int(len(item) * 0.1))
            if i in found:
                assert found[i][0] == distance


def test_least_distance_in_repetitive_texts():
    """Overlapping diagonals of few letters: the first is not the best."""
    rnd = random.Random(8)
    wrong = 0
    for trial in range(400):
        letters = rnd.choice(["ab", "abc", "ab "])
        item = " ".join("".join(rnd.choice(letters) for _ in range(60)).split()) or "a"
        if len(item) < 25:
            continue
        text = "".join(rnd.choice(letters) for _ in range(20)) + "".join(
            _edited(item, rnd.randint(0, 6), rnd) for _ in range(rnd.randint(1, 3))) + "".join(rnd.choice(letters) for _ in range(20))
        text = D.normal(text)
        got = D.Matcher([(0, item)], 0.1).matches(text)
        distance = least_distance(item, text)[0]
        assert (0 in got) == (distance <= int(len(item) * 0.1))
        wrong += 0 in got and got[0][0] != distance
    assert wrong == 0


def test_short_items_match_whole_words(spark):
    items = [(1, "who wrote hamlet"), (2, "yes"), (3, "capital of peru"), (4, "谁写了哈姆雷特"), (5, "!!!"), (6, "two plus two is four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "I ask: Who wrote  Hamlet?"), (2, "eyes and yesterday"), (3, "well, yes."), (4, "the capitol of peru"), (5, "capital of perugia"),
            (6, "问：谁写了哈姆雷特"), (7, "two plus too is fou"), (8, "two plus minus is four"), (9, None)]
    got = {(r.doc_id, r.item_id, r.distance) for r in D.contamination(frame(spark, docs), bench).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (4, 3, 1), (6, 4, 0), (7, 6, 2)} - ({(6, 4, 0)} if D.normal("问：谁写了哈姆雷特").split()[-1] != "谁写了哈姆雷特" else set())


def test_planted_short_items_are_found():
    rnd = random.Random(9)
    items = [(i, prose(rnd.randint(1, 4), 3000 + i)) for i in range(60)]
    items = [(i, t) for i, t in items if len(t) < 25]
    matcher, hit, n = D.Matcher(items, 0.1), 0, 0
    for trial in range(300):
        k = rnd.randrange(len(items))
        text = items[k][1]
        for _ in range(rnd.randint(0, int(len(text) * 0.1))):  # edits inside words
            at = rnd.choice([i for i, c in enumerate(text) if c != " "])
            text = text[:at] + "z" + text[at + 1:]
        n += 1
        hit += k in matcher.matches(f"qqq {text} www")
    assert hit == n


def test_spans_are_those_of_the_original_text(spark):
    item = prose(15, 1)
    text = "Intro,  text!\n" + item.upper().replace(" ", " %%% ") + "\nend İ"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    rows = D.contamination(frame(spark, [(1, text), (2, prose(200, 3))]), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == {(1, 7, 0)}
    assert D.normal(text[rows[0].start:rows[0].end]) == item


def test_blocks_of_the_benchmark_find_the_same(spark):
    bench = spark.createDataFrame([(i, prose(15, i)) for i in range(12)], "item_id long, text string")
    docs = frame(spark, [(i, prose(40, 99 + i) + " " + prose(15, i % 12)) for i in range(30)])
    one = sorted(map(tuple, D.contamination(docs, bench).collect()))
    many = sorted(map(tuple, D.contamination(docs, bench, D.EditSpec(block_chars=200)).collect()))
    assert one == many and len(one) >= 30
    left = [sorted(r.doc_id for r in D.decontaminated(docs, bench, D.EditSpec(block_chars=c)).collect()) for c in (200, 10**6)]
    assert left[0] == left[1]


def test_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, prose(30, 4)), (None, prose(30, 4))], "item_id long, text string")
    docs = frame(spark, odd_rows())
    assert sorted(r.doc_id for r in D.contamination(docs, bench).where("item_id = 1").collect()) == [4, 5, 5]
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(odd_rows()) - 3
    assert D.decontaminated(docs, bench.limit(0)).count() == len(odd_rows())
    assert D.contamination(docs, bench.limit(0)).count() == 0
    assert D.contamination(frame(spark, []), bench).count() == 0
