import hashlib
import re
from collections import Counter
from math import log2

from hypothesis import given, settings
from hypothesis import strategies as st

from retail_signal.llm import secrets as S
from .helpers import frame, odd_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PARTS = ["password", "PassWd", "api_key", "apikey", "toKen", "secret", '"', "'", ":", "=", " ", "AKIA", "ABCD1234EFGH", "deadbeef",
         "0123456789abcdef", "x.y-z", "é", "\U0001F600", "\n", "longervalue99"]


def base(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(x for _, _, x in sorted(found))


def _allow():
    return re.compile("|".join(f"(?:{S._inline(a)})" for a in S.ALLOW))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_known_forms_equal_the_plain_patterns(text):
    found = S.findings(text, S.SecretSpec(), _allow())
    assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k != "entropy") == base(text)


@settings(max_examples=150, deadline=None)
@given(st.text("abcdefABCDEFxyzXYZ0123456789+/", min_size=0, max_size=60))
def test_incremental_counts_equal_direct_entropy(text):
    hot = set()
    for i in range(len(text) - S.WINDOW + 1):
        w = text[i:i + S.WINDOW]
        bits = -sum(n / len(w) * log2(n / len(w)) for n in Counter(w).values())
        digits, lower, upper = (sum(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
        kind = S._class_of(digits, lower, upper, sum(c.isalpha() and c.lower() > "f" for c in w), len(w) - digits - lower - upper)
        if kind and bits >= S.LIMITS[kind] - 1e-9:
            hot.update(range(i, i + S.WINDOW))
    got = {p for a, b, _ in S.hot_spans(text) for p in range(a, b)}
    assert got == hot


def test_entropy_adds_and_the_allow_list_suppresses():
    def kinds(text, spec=S.SecretSpec()):
        return [k for k, *_ in S.findings(text, spec, re.compile("|".join(f"(?:{S._inline(a)})" for a in spec.allow) or "(?!)"))]
    assert kinds("key AbC9dEf8GhI7jKl6MnO5pQr4 end") == ["entropy"]
    assert kinds("id 123e4567-e89b-12d3-a456-426614174000") == []
    assert kinds("see a/path/to/some/nested/file_name_here") == []
    assert kinds("keitlichenlichkeitbeheitlich " * 3) == []
    assert kinds("AbC9dEf8GhI7jKl6MnO5pQr4", S.SecretSpec(allow=("AbC9.*",))) == []
    assert kinds("token = AbC9dEf8GhI7jKl6MnO5pQr4") == ["assign"]  # found once


def test_only_the_span_is_suppressed_not_its_whole_run():
    def spans(text):
        return [(k, text[a:b]) for k, a, b, _ in S.findings(text, S.SecretSpec(), _allow())]
    key, digest = "xY7kQ9mZ2pL4vB8nR3tW6s", "5f1d7a84db00d2fce00b31a7fc73224f"
    assert spans(f"{digest}/{key}") == [("hex", digest), ("entropy", f"/{key}")]
    assert [k for k, _ in spans(f"AKIAABCD1234EFGH-{key}")] == ["access", "entropy"]
    assert spans(f"example/{key}")[0][1].endswith(key)
    assert spans("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []
    assert spans("qzjxkvwpfmbgthycdnsrl") == [("entropy", "qzjxkvwpfmbgthycdnsrl")]


def test_keys_beside_sequences_examples_and_dashes_are_found():
    def spans(text):
        return [text[a:b] for k, a, b, _ in S.findings(text, S.SecretSpec(), _allow()) if k == "entropy"]
    key = "xY7kQ9mZ2pL4vB8nR3tW6sJ5hG1dF0aC8eU2iO4q"
    assert spans("0123456789" + key) == [key]
    assert "".join(spans(key[:18] + "Example" + key[25:])) == key[:18] + "Example" + key[25:]
    dashed = "qZjXkVwPfMbGtHyCdN-sRlQzJxKvWpFmBgTh"
    assert spans(dashed) == [dashed]
    assert spans("abcdefghijklmnopqrstuvwxyz" + key) == [key]
    assert spans("123e4567-e89b-12d3-a456-426614174000/" + key)[0].endswith(key)
    assert spans("src/main/java/org/sample/project/util/StringHelperFactory") == []
    assert spans("very-long-article-title-with-many-plain-words-inside") == []


def test_planted_keys_are_found_and_names_are_not():
    import base64
    import random
    rnd = random.Random(11)
    words = ["alpha", "river", "report", "Summer", "index", "value", "garden", "Window", "market", "number", "simple", "letter"]

    def key():
        raw = rnd.randbytes(rnd.choice([18, 24, 30, 36]))
        return rnd.choice([base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="),
                           "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32)),
                           "".join(rnd.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(28))])

    def name():
        join = rnd.choice("/_-")
        return rnd.choice([join.join(rnd.choices(words, k=rnd.randint(4, 8))), "".join(w.title() for w in rnd.choices(words, k=4)),
                           str(rnd.getrandbits(90)), "%08x-%04x-%04x-%04x-%012x" % tuple(rnd.getrandbits(b) for b in (32, 16, 16, 16, 48))])

    def entropy(text):
        return any(k in ("entropy", "hex") for k, *_ in S.findings(text, S.SecretSpec(), _allow()))
    found = sum(entropy(f"the {rnd.choice(words)} {key()} of") for _ in range(500))
    false = sum(entropy(f"the {rnd.choice(words)} {name()} of") for _ in range(500))
    assert found >= 0.9 * 500 and false <= 0.1 * 500, (found, false)


def test_query_digest_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in S.op3_secret_entropy(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = base(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[r.doc_id].n_assign == want.count("assign:")


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows() + [(20, "f" * 50_000), (21, "token=" + "aB3" * 20_000), (22, "AKIA" * 20_000)]
    got = S.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in got}
    assert by[1] == by[2] == by[3] == [] and by[20] == [("hex", 0, 50_000)]
    assert by[21] == [("assign", 0, 60_006)] and by[22] == [("access", 0, 80_000)]
    assert S.scan(frame(spark, [])).count() == 0
