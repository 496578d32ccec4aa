"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit set where more than half of its shingles'
64-bit hashes have it.  Documents whose fingerprints differ in at most
``radius`` bits are linked; each gets the least doc_id it reaches.

1. Copies share a fingerprint: links are sought between distinct ones only.
2. The 64 bits are cut into ``radius`` + 2 bands.  A link changes at most
   ``radius`` bands, so linked fingerprints agree on two whole bands: each
   fingerprint enters one block for each pair of bands, keyed by their bits.
3. In a block, every fingerprint's Hamming distances to the reference
   fingerprints (pivots) are computed first.  By the triangle inequality a
   pair whose distances to any pivot differ by more than ``radius`` is no
   link: the block is sorted by the first pivot's column, only a window of it
   is paired, the pairs are thinned column by column (the maximum coordinate
   difference), and the survivors are verified by their differing bits.
4. A block returns a spanning forest of its links, at most a link for each
   member, never all its pairs; the links' components give the classes.

A block of more than ``BLOCK`` members is not held by one task: its members
are dealt into parts of about that many, and each pair of parts is a block of
its own.  Nothing is capped.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a null doc_id counts in no minimum, and a class of null ids only
has a null component; repeated rows are returned as often as they come; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, table, texts_of, whole_text
from .components import components
from ..session import ship_package

BLOCK = 4096
PIVOTS = 16
SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Reference fingerprints: hashes of their numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of a text's ``width``-word shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        shingles = [joined[a:b - 1] for a, b in zip([0, *ends], ends[width - 1:])]
        shingles[-1] = joined[ends[-width - 1]:]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = np.unpackbits(hashes, axis=1).sum(0)
    else:
        ones = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])


def _fingerprinter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield record_batch(_PRINTS, [column(batch, "doc_id"), column(batch, "text_hash"), prints])
    return run


def row_key() -> list:
    """What tells rows of ``docs`` apart: the id and a hash of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash")]


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint's 64 bits as a signed long."""
    slim = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, _fingerprinter(width), "doc_id long, text_hash long, fp long")


def bands(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``count`` bands over 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_keys(prints: DataFrame, radius: int) -> DataFrame:
    """(pair, key, fp): one row for each pair of bands."""
    def band(shift: int, bits: int):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = list(combinations(bands(radius + 2), 2))
    keys = [F.struct(F.lit(i).alias("pair"), F.shiftleft(band(*a), b[1]).bitwiseOR(band(*b)).alias("key"))
            for i, (a, b) in enumerate(pairs)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "fp")


def links_between(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all linked pairs between two arrays of fingerprints, or
    within one (``right`` None), found through the pivot distance tables."""
    def distances(x):
        return np.bitwise_count(x[:, None] ^ REFERENCES).astype(np.int16)
    table_l = distances(left)
    order_l = np.argsort(table_l[:, 0], kind="stable")
    if right is None:
        right, table_r, order_r = left, table_l, order_l
    else:
        table_r = distances(right)
        order_r = np.argsort(table_r[:, 0], kind="stable")
    first = table_r[order_r, 0]
    low = np.searchsorted(first, table_l[order_l, 0] - radius, "left")
    high = np.searchsorted(first, table_l[order_l, 0] + radius, "right")
    if right is left:
        low = np.arange(1, len(left) + 1)  # each pair once
    sizes, found_i, found_j = np.maximum(high - low, 0), [], []
    step = 2_000_000  # pairs at a time
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + step, "right")))
        n = sizes[start:stop]
        i = np.repeat(order_l[start:stop], n)
        j = order_r[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)]
        for p in range(1, PIVOTS):
            near = np.abs(table_l[i, p] - table_r[j, p]) <= radius
            i, j = i[near], j[near]
        linked = np.bitwise_count(left[i] ^ right[j]) <= radius
        found_i.append(i[linked])
        found_j.append(j[linked])
        start = stop
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def forest(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Each print that links reach, with the least one it reaches here."""
    parent = np.arange(len(prints))
    while True:
        a, b = parent[i], parent[j]
        low = np.minimum(a, b)
        new = parent.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, parent):
            break
        parent = new
    moved = np.flatnonzero(parent != np.arange(len(prints)))
    return list(zip(prints[moved].tolist(), prints[parent[moved]].tolist()))


_FOUND = pa.schema([("pair", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_FOUND_DDL = "pair int, key long, fp long, u long, v long"


def _block_links(radius: int, limit: int):
    """Over rows sorted by (pair, key): links (u, v) of the blocks, and the
    members (pair, key, fp) of blocks beyond ``limit``, passed on as they
    come.  At most ``limit`` and a batch of rows are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(pair, key, fps):
            n = len(fps)
            return record_batch(_FOUND, [[pair] * n, [key] * n, fps, [None] * n, [None] * n])

        def solved(fps):
            fps = np.unique(fps)
            return forest(fps.view(np.int64), *links_between(fps.view(np.uint64), None, radius))

        block, held, size, large = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, key, fp = (column(batch, c).to_numpy() for c in ("pair", "key", "fp"))
            cut = np.flatnonzero((pair[1:] != pair[:-1]) | (key[1:] != key[:-1])) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            edges = []
            # Only blocks of two and more, and the ones at the batch's ends.
            worth = np.flatnonzero(stops - starts > 1)
            for k in np.unique(np.concatenate([[0], worth, [len(starts) - 1]])):
                a, b = starts[k], stops[k]
                own = (int(pair[a]), int(key[a]))
                if own != block:
                    if size > 1 and not large:
                        edges += solved(np.concatenate(held))
                    block, held, size, large = own, [], 0, False
                held.append(fp[a:b])
                size += b - a
                large = large or size > limit
                if large:
                    yield passed(*own, np.concatenate(held))
                    held = []
            if edges:
                u, v = zip(*edges)
                yield record_batch(_FOUND, [[None] * len(u)] * 3 + [list(u), list(v)])
        if size > 1 and not large:
            edges = solved(np.concatenate(held))
            if edges:
                u, v = zip(*edges)
                yield record_batch(_FOUND, [[None] * len(u)] * 3 + [list(u), list(v)])
    return run


def _large_links(large: DataFrame, radius: int, limit: int) -> DataFrame:
    """Links of blocks beyond ``limit``: their members in parts, and a task
    for each pair of parts."""
    parts = materialise(large.groupBy("pair", "key").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")),
                        "block-parts")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (large.join(parts, ["pair", "key"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("pair", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                     "own", "fp"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, a, b = key
        fps = pdf["fp"].to_numpy()
        if a == b:
            fps = np.unique(fps)
            edges = forest(fps, *links_between(fps.view(np.uint64), None, radius))
        else:
            mine = np.unique(fps[pdf["own"].to_numpy() == a])
            others = np.unique(fps[pdf["own"].to_numpy() == b])
            i, j = links_between(mine.view(np.uint64), others.view(np.uint64), radius)
            edges = forest(np.concatenate([mine, others]), i, j + len(mine))
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    ship_package(large.sparkSession)
    return dealt.groupBy("pair", "key", "a", "b").applyInPandas(solve, "u long, v long")


def fingerprint_links(distinct: DataFrame, radius: int, limit: int = BLOCK) -> DataFrame:
    """(u, v): links that connect what links of at most ``radius`` bits
    connect among the distinct fingerprints (fp)."""
    keyed = block_keys(distinct, radius).repartition("pair", "key").sortWithinPartitions("pair", "key")
    found = materialise(map_arrow(keyed, _block_links(radius, limit), _FOUND_DDL), "block-links")
    links = found.where("u is not null").select("u", "v")
    large = found.where("u is null").select("pair", "key", "fp")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, radius, limit))
    return links.distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, limit: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for every row of ``docs``;
    ``root`` names the component by a fingerprint of it."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(fingerprint_links(classes.select("fp"), radius, limit))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "root").select(F.col("fp").alias("c_fp"), "component_id", "root"),
                        "fingerprint-components")
    return prints.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", "text_hash", "fp", "component_id", "root")


#: Keys of rows to drop that are sent to every task (16 bytes each); more are
#: joined by a shuffle.
SENT_KEYS = 2_000_000


def deduplicated(docs: DataFrame, width: int = 4, radius: int = 4, sent_keys: int = SENT_KEYS) -> DataFrame:
    """``docs`` with one row of each component: of its rows the one with the
    least (doc_id, hash of the text), ids before nulls.  Rows are told apart
    by id and text, so rows that share an id stay unless their texts are near,
    and rows without an id take part.  Of rows equal in both, the one with
    the least hash over all columns stays.

    Only keys of the rows that go, and of rows that repeat one that stays,
    meet the texts: up to ``sent_keys`` of them are broadcast, so no text
    moves; beyond that the join shuffles."""
    key = ["doc_id", "text_hash"]
    found = near_duplicates(docs, width, radius).groupBy("root", *key).agg(F.count(F.lit(1)).alias("copies"))
    found = materialise(found, "near-duplicate-keys")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows"))
    # Most components are one row; the others give the marks.
    first = first.where("rows > 1").drop("rows", "keys")
    marks = (found.join(first, "root").withColumn("stays", order == F.col("first"))
             .where(~F.col("stays") | (F.col("copies") > 1))
             .select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "stays"))
    marks = materialise(marks, "near-duplicate-marks")
    n, repeats = marks.agg(F.count(F.lit(1)), F.count_if("stays")).first()
    if not n:
        return docs
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    marked = inner.join(F.broadcast(marks) if n <= sent_keys else marks,
                        F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    kept = marked.where("stays is null").select("row")
    if repeats:
        again = (marked.where("stays").withColumn("h", F.xxhash64(F.to_json("row")))
                 .groupBy(*key).agg(F.min_by("row", "h").alias("row")))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")


def op8_simhash_pivots(spark, sf_dir):
    """All documents with 4-word shingles, linked at 4 differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
