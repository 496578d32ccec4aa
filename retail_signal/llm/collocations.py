"""Phrases whose words keep company more often than their parts would.

1. Every task cuts its texts into pieces and words and writes, for each shard
   of about ``shard_words`` words, the words as numbers of the shard's own
   dictionary, and that dictionary with its counts.
2. The dictionaries are added up by (lang, word).  Words found ``least`` times
   get dense global ids (no phrase of rarer words can be a candidate), dealt
   per hash bucket; an id stands for a language as well.
3. Each shard gets the ids of its own words by a join and counts its n-grams
   in a counting quotient filter (``quotient``): ids packed, permuted
   invertibly, sorted, equal ones counted.  Its slices by the top bits of the
   quotient are shuffled, and each slice's sorted filters are merged.  A
   frequent n-gram is one entry a shard, and the permutation deals entries
   evenly, so no key is hot.
4. Counts of the parts come by joins on n-grams; a phrase of three words or
   more is cut where it scores lowest.

The packed width follows the number of frequent words; nothing is broadcast
that grows with the input (bucket offsets: 4,096 rows).  Scores are exact in
38-digit decimals.

Defined results: a null or empty text has no words; a null language is
``und``; repeated rows count again; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotient
from .common import column, map_arrow, materialise, record_batch, table

SHARD_WORDS = 1_000_000
SLICE_ENTRIES = 1 << 20
BUCKETS = 4096
BREAKS = b".,;:!?\n\x0b\x0c\r"

_BREAK = b"\n"
_TABLE = bytes.maketrans(BREAKS + b"\t", _BREAK * len(BREAKS) + b" ")


def tokens(raw: bytes) -> list[bytes]:
    """Lower-case words (A-Z only), a line feed between pieces."""
    return [t for t in raw.lower().translate(_TABLE).replace(_BREAK, b" \n ").split(b" ") if t]


class _Numbers(dict):
    """Numbers of the words of one language, taken from a shared counter."""

    def __init__(self, words: list, lang: str):
        super().__init__({_BREAK: 0})
        self.words, self.lang = words, lang

    def __missing__(self, word):
        self.words.append((self.lang, word))
        self[word] = n = len(self.words)
        return n


_WORD = pa.struct([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])
_SHARD = pa.schema([("shard", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(_WORD))])
_SHARD_DDL = "shard long, n_words long, ids binary, words array<struct<lang:string,word:binary,f:long>>"


def _sharder(shard_words: int):
    def emit(shard: int, ids: list, words: list) -> pa.RecordBatch:
        stream = np.concatenate(ids)
        f = np.bincount(stream, minlength=len(words) + 1)[1:]
        coded = pa.StructArray.from_arrays([pa.array([x[0] for x in words], pa.string()), pa.array([x[1] for x in words], pa.binary()),
                                            pa.array(f, pa.int64())], names=_WORD.names)
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), coded)
        return record_batch(_SHARD, [[shard], [int(f.sum())], [stream.tobytes()], one])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, words, numbers, size = TaskContext.get().partitionId() << 33, [], [], {}, 0
        gap = np.zeros(1, np.int32)
        for batch in batches:
            for lang, raw in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
                if not raw:
                    continue
                known = numbers.get(lang)
                if known is None:
                    known = numbers[lang] = _Numbers(words, lang)
                found = tokens(raw)
                ids += [np.fromiter(map(known.__getitem__, found), np.int32, len(found)), gap]
                size += len(found)
                if size >= shard_words:
                    yield emit(shard, ids, words)
                    shard, ids, words, numbers, size = shard + 1, [], [], {}, 0
        if words:
            yield emit(shard, ids, words)
    return read


def dense_ids(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with ``id`` from 1 on, without gaps: numbered in each hash
    bucket, behind the words of the buckets before (at most 4,096 rows)."""
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("bucket").count()
             .select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return (dealt.withColumn("place", place).join(F.broadcast(bases), "bucket")
            .withColumn("id", F.col("base") + F.col("place")).drop("bucket", "base", "place"))


_SLICE = pa.schema([("slice", pa.int64()), ("filter", pa.binary())])


def _counter(packing: quotient.Packing, slice_bits: int):
    half = packing.half

    def grams(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every n-gram of two words and more that no break or rare word cuts,
        counted; one length at a time."""
        whole = ids[:-1] > 0
        for k in range(2, packing.words + 1):
            whole = whole[:len(ids) - k + 1] & (ids[k - 1:] > 0)
            at = np.flatnonzero(whole)
            yield quotient.summed(half, *packing.permute(*packing.pack([ids[at + i] for i in range(k)])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, local, ids in zip(column(batch, "ids"), column(batch, "local"), column(batch, "global")):
                stream = np.frombuffer(raw.as_buffer(), np.int32)
                lookup = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
                lookup[local.values.to_numpy(zero_copy_only=False)] = ids.values.to_numpy(zero_copy_only=False)
                hi, lo, n = quotient.summed(half, *map(np.concatenate, zip(*grams(lookup[stream]))))
                out = list(quotient.slices(half, slice_bits, hi, lo, n))
                if out:
                    yield record_batch(_SLICE, list(zip(*out)))
    return count


_GRAM = pa.schema([("gram", pa.list_(pa.int64())), ("f", pa.int64())])


def _merger(packing: quotient.Packing, least: int):
    def rows(merger: quotient.Merger) -> pa.RecordBatch:
        hi, lo, n = merger.result()
        often = np.flatnonzero(n >= least)
        ids = np.stack(packing.unpack(*packing.restore(hi[often], lo[often])), axis=1)
        sizes = (ids > 0).sum(axis=1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = ids[ids > 0]
        return record_batch(_GRAM, [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), pa.array(n[often], pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, merger = None, None
        for batch in batches:
            for which, raw in zip(column(batch, "slice").to_pylist(), column(batch, "filter").to_pylist()):
                if which != at:
                    if merger:
                        yield rows(merger)
                    at, merger = which, quotient.Merger()
                merger.add(raw)
        if merger:
            yield rows(merger)
    return merge


def gram_counts(docs: DataFrame, max_words: int = 3, least: int = 10, shard_words: int = SHARD_WORDS,
                slice_entries: int = SLICE_ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, counts, totals): words (lang, word, f, id) found ``least`` times;
    counts (gram, f) of id n-grams of 2 to ``max_words`` words found as often;
    totals (lang, n) of all words."""
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    shards = materialise(map_arrow(slim, _sharder(shard_words), _SHARD_DDL), "phrase-shards")
    listed = shards.select("shard", F.posexplode("words").alias("place", "w")).select("shard", "place", "w.*")
    vocabulary = materialise(listed.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-vocabulary")
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialise(dense_ids(vocabulary.where(F.col("f") >= least), ["lang", "word"]), "phrase-words")

    n_words = shards.agg(F.sum("n_words")).first()[0] or 0
    packing = quotient.Packing(max(4, words.count().bit_length()), max_words)
    slice_bits = min(packing.half, max(6, (n_words * (max_words - 1) // slice_entries).bit_length()))
    own = (listed.join(words.select("lang", "word", "id"), ["lang", "word"])
           .groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("own"))
           .select("shard", F.expr("transform(own, x -> x.place + 1)").alias("local"), F.expr("own.id").alias("global")))
    numbered = shards.select("shard", "ids").join(own, "shard").select("ids", "local", "global")
    filters = map_arrow(numbered, _counter(packing, slice_bits), "slice long, filter binary")
    dealt = filters.repartition("slice").sortWithinPartitions("slice")
    counts = materialise(map_arrow(dealt, _merger(packing, least), "gram array<long>, f long"), "phrase-grams")
    return words, counts, totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), at most 1,000,000."""
    def exact(c):
        return c.cast("decimal(19,0)")
    product = exact(left) * exact(right)
    scaled = (exact(a) * exact(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled, product)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, cover: int = 50, top: int = 2000,
                 **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top``
    phrases of 2 to ``max_words`` words found ``least`` times.  A phrase goes
    if a longer candidate that holds it is found ``cover`` per cent as often."""
    words, counts, totals = gram_counts(docs, max_words, least, **options)
    single = words.select(F.array("id").alias("gram"), "f", "lang")
    parts = single.unionByName(counts.withColumn("lang", F.lit(None).cast("string")))
    inside = counts.where(F.size("gram") > 2).select(
        F.explode(F.expr("""flatten(transform(sequence(2, size(gram) - 1), k ->
            transform(sequence(1, size(gram) - k + 1), i -> slice(gram, i, k))))""")).alias("gram"), F.col("f").alias("longer"))
    covered = inside.groupBy("gram").agg(F.max("longer").alias("longer"))
    left = counts.join(covered, "gram", "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("f"))).select("gram", F.col("f").alias("a"))
    cuts = left.select("gram", "a", F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("slice(gram, 1, k)")).withColumn("tail", F.expr("slice(gram, k + 1, size(gram))"))
    cuts = (cuts.join(parts.select(F.col("gram").alias("head"), F.col("f").alias("l"), "lang"), "head")
            .join(parts.select(F.col("gram").alias("tail"), F.col("f").alias("r")), "tail"))
    scored = (cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
              .groupBy("gram", "a").agg(F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "gram", "a", "cut.score", "cut.l", "cut.r"))
    # Ranked in salted parts first: a language may hold most phrases.
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    within = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    few = salted.withColumn("place", F.rank().over(within)).where(F.col("place") <= top).drop("place", "salt")
    over = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    few = few.withColumn("place", F.rank().over(over)).where(F.col("place") <= top).drop("place")
    named = (few.select("*", F.posexplode("gram").alias("at", "id")).join(words.select("id", "word"), "id")
             .groupBy("lang", "gram", "a", "score", "l", "r")
             .agg(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("spelt"))
             .withColumn("phrase", F.expr("array_join(spelt.word, ' ')")))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (named.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_collocations(spark, sf_dir):
    """The first 2,000 phrases of 2 to 3 words of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE k = 3
    UNION ALL
    SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN longer USING (lang, phrase)
  WHERE c.k = 3 OR m IS NULL OR 100 * m < 50 * a),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cut, w[1] AS head, CASE WHEN k = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS tail FROM kept
  UNION ALL
  SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = c.head
              JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = c.tail),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
