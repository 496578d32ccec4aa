import random

from pyspark.sql import functions as F

from retail_signal.llm import revisits as R

DDL = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, length long, block string"


def _log(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        url = "http://hot.example.com/a" if rnd.random() < 0.4 else f"https://www.e{rnd.randint(0, 5)}.org:443/p/?utm_x=1&b=2&a=1#f"
        kind = rnd.choice(["response", "revisit", "revisit"])
        headers = {k: rnd.choice(v) for k, v in (("etag", ['"1"', 'W/"1"', '"2"']), ("last-modified", ["m1", "m2"]),
                                                   ("date", [f"d{i}"]), ("content-type", ["t1", "t2"])) if rnd.random() < 0.7}
        rows.append((i, url, rnd.randint(0, 300), kind, headers, rnd.choice([None, "x"]) if kind == "response" else None, i, "clash"))
    return rows


def _key(url):
    rest = url.split("#")[0].split("://", 1)[1]
    if "hot" in rest:
        return rest
    return rest.split("/")[0].removeprefix("www.").removesuffix(":443") + "/p?a=1&b=2"


def _brute(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [q for q in rows if q[3] == "response" and _key(q[1]) == _key(r[1]) and (q[2], q[0]) < (r[2], r[0])]
        if not before:
            out[r[0]] = ("no_origin", None, None)
            continue
        o = max(before, key=lambda q: (q[2], q[0]))
        tag, tag_0 = ((q[4].get("etag") or "").removeprefix("W/") for q in (r, o))
        pairs = [(tag, tag_0), (r[4].get("last-modified"), o[4].get("last-modified"))]
        common = [(a, b) for a, b in pairs if a and b]
        status = "mismatch" if any(a != b for a, b in common) else "resolved" if common else "unverified"
        merged = o[4] | {k: v for k, v in r[4].items() if k in R.PERMITTED} if status != "mismatch" else None
        out[r[0]] = (status, o[0], merged)
    return out


def test_equals_brute_force_whatever_the_block(spark):
    rows = _log(400, 1)
    want = _brute(rows)
    for seconds in (1, 17, 3600):
        got = R.resolve(spark.createDataFrame(rows, DDL), seconds).collect()
        assert {r.record_id: (r.status, r.origin_id, r.merged_headers) for r in got} == want
        assert len(got) == len(want)


def test_canonical_urls(spark):
    def key(url):
        return spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u"))).first()[0]
    assert key("HTTP://WWW.Example.com:80/A/?utm_source=x&b=1&a=2#z") == "example.com/A?a=2&b=1"
    assert key("https://example.com") == "example.com"
    assert key("http://example.com/x?ref=1") == "example.com/x"
    assert key(None) is None


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, 5, "revisit", None, None, None, ""), (2, "http://a/", None, "revisit", None, None, None, ""),
            (3, "http://a/", None, "response", None, "d", 1, ""), (4, "http://a", 9, "revisit", {"etag": "q"}, None, None, ""),
            (5, "http://b/" + "x" * 50_000, 1, "response", {}, None, 1, ""), (6, "http://b/" + "x" * 50_000, 2, "revisit", None, None, None, ""),
            (6, "http://b/" + "x" * 50_000, 2, "revisit", None, None, None, ""), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DDL)
    got = sorted((r.record_id, r.status, r.origin_id) for r in R.resolve(df).collect())
    assert got == [(1, "no_origin", None), (2, "no_origin", None), (4, "no_origin", None), (6, "unverified", 5), (6, "unverified", 5)]
    assert R.resolve(df.limit(0)).count() == 0
