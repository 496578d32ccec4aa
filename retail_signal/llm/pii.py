"""Personal data by known forms and bootstrapped contextual extraction.

Emails, IP addresses, card numbers and phone numbers of known form are the
seeds.  The words beside them are patterns ("word before", "word after").
Seeds and other identifier-like tokens are instances; an edge of the graph
says how often a pattern stood beside an instance.  Scores go back and forth:

* a pattern's confidence for a kind is the share of its occurrences, in all
  documents, that stand beside instances of the kind,
  weighted by the instances' confidence and smoothed towards zero; ordinary
  words and instances of other kinds count against it, identifier-like tokens
  not known yet neither way; it needs ``min_instances`` different instances;
* an instance's confidence is that not all of its confident patterns err;
  seeds keep one.

Identifier-like are tokens, and runs of digit groups with one space between
each two, of more than four characters with @, three digits, or letters and
digits.  After ``rounds`` rounds, those of confident instances beside a
confident pattern are reported as ``context`` spans, besides the known forms,
and so is any other token beside one, with digits or without; such tokens
count against patterns like all ordinary words, and a confident pattern's own
word is none of them.

Only DataFrame functions run here.  The known forms are matched without
nested repetition, so no text, however long, exhausts a matcher's stack:
separators between two digits and dots between two domain characters are
first replaced by marks, of the same length, which makes each form a run of
one class of characters.  Positions add up the lengths of the matches and of
what lies between them.

The graph holds counts only, summed before each exchange; texts never move.

Defined results: a null or empty text has no spans; repeated rows are searched
each for itself; a candidate that overlaps a known form is none; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, whole_text

KINDS = ("email", "ip", "card", "phone")
_SPACE = r"\x20\x09-\x0D"
#: Marks stand for a dot in a domain and a separator in a number; characters
#: of a text that look like them count as any other sign.
DOT, GAP = "\ue001", "\ue002"
_LOCAL = rf"A-Za-z0-9._%+{DOT}-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{GAP}])[0-9][0-9{GAP}]{{12,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+",
}
_SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


@dataclass(frozen=True)
class BootSpec:
    rounds: int = 3
    min_confidence: float = 0.8
    min_instances: int = 3
    smoothing: float = 1.0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit rule over at most 19 digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.lpad(digits, 19, "0"), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
        return F.forall(F.split(part, r"\."), lambda p: (F.length(p) < 4) & (F.substring(p, 1, 3).cast("int") < 256))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "candidate":
        mixed = (n > 0) & value.rlike("[A-Za-z]")
        return (F.length(_core(value)) > 4) & ((n > 2) | value.contains("@") | mixed)
    return F.lit(True)


def _core(value: Column) -> Column:
    return F.regexp_replace(_lead(value), r"[^A-Za-z0-9]++\z", "")


def _lead(value: Column) -> Column:
    return F.regexp_replace(value, r"\A[^A-Za-z0-9+@]++", "")


def _prepared(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    if kind == "card":
        return F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    if kind == "candidate":
        return F.regexp_replace(text, r"(?<=[0-9)])\x20(?=[(]?[0-9])", GAP)
    return text


def _beside(gap: Column, pattern: str) -> Column:
    return F.translate(F.lower(F.regexp_extract(gap, pattern, 1)), DOT, ".")


def _spans(kind: str) -> Column:
    """Valid matches of ``kind`` from its columns of matches and gaps."""
    zipped = F.arrays_zip(F.col(f"hits_{kind}").alias("hit"), F.col(f"gaps_{kind}").alias("gap"),
                          F.slice(f"gaps_{kind}", F.lit(2), F.size(f"gaps_{kind}")).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        hit = x["hit"]
        start = acc["at"] + F.length(x["gap"])
        if kind == "candidate":
            first = start + F.length(hit) - F.length(_lead(hit))
            value = F.translate(_core(hit), GAP, " ")
        else:
            first, value = start, hit
        span = F.struct(
            F.lit(kind).alias("kind"), first.alias("start"), (first + F.length(value)).alias("end"), value.alias("value"),
            _beside(x["gap"], rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]*+\z").alias("before"),
            _beside(x["next"], rf"\A[{_SPACE}]*+([^{_SPACE}]++)").alias("after"))
        out = F.when(hit.isNotNull() & _valid(kind, hit), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(F.length(hit), F.lit(0))).alias("at"), out.alias("out"))
    none = F.array().cast(f"array<{_SPAN}>")
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, flagged, text, known, candidates) of every document:
    spans of known form by kind and start, and other identifier-like tokens."""
    slim = docs.select("doc_id", F.translate(whole_text(), DOT + GAP, "\ufffd\ufffd").alias("text"))
    out = slim.withColumn("flagged", F.col("text").rlike("[0-9@]"))
    needed = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    # A text without the signs of a kind has one gap, nothing, and no match.
    for kind, pattern in PATTERNS.items():
        of = F.when(F.col("flagged") & needed.get(kind, F.lit(True)), _prepared(kind, F.col("text"))).otherwise("")
        out = out.withColumn(f"text_{kind}", of)
    out = out.withColumns({f"hits_{k}": F.regexp_extract_all(f"text_{k}", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
                          | {f"gaps_{k}": F.split(f"text_{k}", p, -1) for k, p in PATTERNS.items()})
    out = out.withColumns({f"spans_{k}": _spans(k) for k in PATTERNS})
    known = F.concat(*[F.col(f"spans_{k}") for k in KINDS])
    out = out.withColumn("known", known).withColumn("candidates", F.filter(
        "spans_candidate", lambda c: ~F.exists("known", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))))
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "flagged", "text", "known", "candidates")


def _occurrences(found: DataFrame, column: str) -> DataFrame:
    """(row, at, kind, value, pattern): one row for each word beside a span."""
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("s.before").alias("word")),
                    F.struct(F.lit("after").alias("side"), F.col("s.after").alias("word")))
    return (found.select("row", F.explode(column).alias("s"))
            .select("row", F.col("s.start").alias("at"), F.col("s.kind").alias("kind"),
                    F.lower(F.col("s.value")).alias("value"), F.explode(sides).alias("p"))
            .where("p.word <> ''").select("row", "at", "kind", "value", F.concat_ws(" ", "p.side", "p.word").alias("pattern")))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often its word occurs in all documents, for the
    words of ``patterns``."""
    words = (docs.select(F.explode(F.split(F.lower(whole_text()), f"[{_SPACE}]+")).alias("word"))
             .groupBy("word").agg(F.count("*").alias("total")))
    wanted = patterns.select("pattern", F.substring_index("pattern", " ", -1).alias("word"))
    return wanted.join(words, "word").select("pattern", "total")


def confident(edges: DataFrame, totals: DataFrame, spec: BootSpec = BootSpec()) -> tuple[DataFrame, DataFrame]:
    """Scores after all rounds: patterns (pattern, kind, confidence) and
    instances (value, kind, confidence), both above the least confidence.

    ``edges``: (pattern, value, kind, n), kind null for what is no seed."""
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    instances = seeds
    others = materialise(edges.where("kind is null").select("pattern", "value").distinct(), "pii-others")
    counts = edges.groupBy("pattern", "value").agg(F.sum("n").alias("n"))
    ordinary = (counts.groupBy("pattern").agg(F.sum("n").alias("beside")).join(totals, "pattern")
                .select("pattern", F.greatest(F.col("total") - F.col("beside"), F.lit(0)).alias("ordinary")))
    counts = materialise(counts.join(ordinary, "pattern"), "pii-edges")
    for _ in range(spec.rounds):
        known = counts.join(instances, "value")
        against = known.groupBy("pattern").agg((F.sum("n") + F.max("ordinary") + F.lit(spec.smoothing)).alias("all"))
        # A value may be known as several kinds; each counts for itself.
        patterns = (known.groupBy("pattern", "kind")
                    .agg(F.sum(F.col("n") * F.col("confidence")).alias("weight"), F.count("*").alias("instances"))
                    .where(F.col("instances") >= spec.min_instances).join(against, "pattern")
                    .select("pattern", "kind", (F.col("weight") / F.col("all")).alias("confidence"))
                    .where(F.col("confidence") >= spec.min_confidence))
        patterns = materialise(patterns, "pii-patterns")
        found = (others.join(patterns, "pattern").groupBy("value", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("confidence"))
                 .where(F.col("confidence") >= spec.min_confidence))
        instances = materialise(seeds.unionByName(found), "pii-instances")
    return patterns, instances


def plain_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row, plain): tokens beside a confident pattern that overlap no known
    form and no candidate, with the places where they stand."""
    words = patterns.select(F.substring_index("pattern", " ", -1).alias("word")).distinct()
    confident_patterns = patterns.select("pattern").distinct()
    # Between token i and token i + 1 stands gap i + 1; gap 0 is what comes first.
    tokens = (found.withColumn("tokens", F.regexp_extract_all("text", F.lit(f"[^{_SPACE}]++"), F.lit(0)))
              .select("row", F.posexplode(F.arrays_zip(
                  F.col("tokens").alias("token"),
                  F.concat(F.array(F.lit("")), F.col("tokens")).alias("before"),
                  F.slice("tokens", F.lit(2), F.size("tokens")).alias("after"))).alias("i", "t"))
              .where("t.token is not null"))
    sides = F.array(F.concat(F.lit("before "), F.lower("t.before")), F.concat(F.lit("after "), F.lower("t.after")))
    beside = (tokens.select("row", "i", F.lower("t.token").alias("word"), F.explode(sides).alias("pattern"))
              .join(confident_patterns, "pattern", "left_semi").join(words, "word", "left_anti")
              .groupBy("row").agg(F.sort_array(F.collect_set("i")).alias("at")))
    tokens, gaps = F.regexp_extract_all("text", F.lit(f"[^{_SPACE}]++"), F.lit(0)), F.split("text", f"[^{_SPACE}]++", -1)

    def place(i: Column) -> Column:
        def length(total: Column, x: Column) -> Column:
            return total + F.length(x)
        start = F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0), length), length)
        token = F.element_at("tokens", i + 1)
        lead = F.length(F.regexp_extract(token, r"\A[^\p{L}\p{N}+@]*+", 0))
        value = F.regexp_replace(F.substring(token, lead + 1, F.length(token)), r"[^\p{L}\p{N}]++\z", "")
        return F.struct(F.lit("context").alias("kind"), (start + lead).alias("start"),
                        (start + lead + F.length(value)).alias("end"), value.alias("value"),
                        F.lit("").alias("before"), F.lit("").alias("after"))

    def free(s: Column) -> Column:
        return (s["end"] > s["start"]) & ~F.exists(F.concat("known", "candidates"), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    return (found.join(beside, "row").withColumns({"tokens": tokens, "gaps": gaps})
            .select("row", F.filter(F.transform("at", place), free).alias("plain")))


def chosen_pairs(edges: DataFrame, patterns: DataFrame, instances: DataFrame) -> DataFrame:
    """(value, pattern) of candidates that stand beside a confident pattern of
    their kind: of the pairs that occur, never of all within a kind."""
    pairs = edges.where("kind is null").select("value", "pattern").distinct()
    return (pairs.join(patterns.select("pattern", F.col("kind").alias("of")), "pattern")
            .join(instances.select("value", F.col("kind").alias("of")).distinct(), ["value", "of"], "left_semi")
            .select("value", "pattern").distinct())


def extract(docs: DataFrame, spec: BootSpec = BootSpec()) -> DataFrame:
    """(doc_id, known, context): spans of known form, and those discovered."""
    found = materialise(spans(docs), "pii-spans")
    seen = _occurrences(found, "known")
    other = _occurrences(found, "candidates").withColumn("kind", F.lit(None).cast("string"))
    edges = materialise(seen.unionByName(other).groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")), "pii-graph")
    totals = pattern_totals(docs, edges.select("pattern").distinct())
    patterns, instances = confident(edges, totals, spec)
    chosen = chosen_pairs(edges, patterns, instances)
    new = (other.drop("kind").join(chosen, ["value", "pattern"], "left_semi").select("row", "at").distinct()
           .groupBy("row").agg(F.collect_set("at").alias("starts")))
    picked = F.filter("candidates", lambda c: F.array_contains("starts", c["start"]))
    none = F.array().cast(f"array<{_SPAN}>")
    context = F.concat(F.coalesce(F.transform(picked, lambda c: c.withField("kind", F.lit("context"))), none),
                       F.coalesce("plain", none))
    ordered = F.array_sort(context, lambda a, b: a["start"] - b["start"])
    return (found.drop("text").join(new, "row", "left").join(plain_spans(found, patterns), "row", "left")
            .select("doc_id", "known", ordered.alias("context")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii_context(spark, sf_dir):
    """Personal data of every document, with a digest of those of known form."""
    found = extract(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.size("context").cast("long").alias("n_context"),
                        F.sha2(joined(F.col("known")), 256).alias("base_sha256"),
                        joined(F.concat("known", "context")).alias("spans"))
