"""Token ids as length-delimited binary records, with an offset index.

A file is a header and a run of records.  All numbers are little-endian.

    header   8 bytes  b"TOKREC1" and the width of an id in bytes (2 or 4)
    record   8 bytes  n, the payload's length
             4 bytes  masked crc32 of those 8 bytes
             n bytes  payload: doc_id (8), 1 if the doc_id is null (1), ids
             4 bytes  masked crc32 of the payload

A mask rotates the crc right by 15 bits and adds a constant, so that the crc
of bytes that hold crcs stays useful.  The index is a Parquet table beside the
files: (file, part, position, doc_id, offset, n_tokens), one row a record, so
a reader can shuffle records and seek to each.

Files come in ascending order of doc_id (nulls first; rows that share an id in
any order of theirs): the documents are dealt by ranges of doc_id and sorted
within, and file names ascend with the ranges.  Each task attempt writes files
of a name of its own, and a file counts only if the index lists it, so a lost
executor or a second attempt leaves at most files nobody reads.

Files go through ``pyarrow.fs``, to whatever store the checkpoint folder's
URI names.  Encoding splits texts at ASCII white space, which no token of a
pre-tokenizer that drops white space spans, and remembers the ids of pieces;
for other tokenizers ``by_word=False`` encodes whole texts.

Defined results: a null or empty text is the end id alone; an empty table
writes no file and an empty index; other columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, scratch, table

MAGIC = b"TOKREC1"
MASK = 0xA282EAD8
END_ID = 2
HEAD = 9  # bytes of a payload before its ids


def masked_crc(data) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF)


def head(doc_id: int | None) -> bytes:
    return struct.pack("<q?", doc_id or 0, doc_id is None)


def head_id(payload) -> int | None:
    doc_id, null = struct.unpack_from("<q?", payload)
    return None if null else doc_id


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, masked_crc(length), payload, masked_crc(payload)))


def read_frames(data: memoryview, start: int = 8) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record; a damaged one raises."""
    at = start
    while at < len(data):
        length = data[at:at + 8]
        n = int.from_bytes(length, "little")
        end = at + 16 + n
        if end > len(data) or masked_crc(length) != data[at + 8:at + 12]:
            raise ValueError(f"damaged record length at {at}")
        payload = data[at + 12:end - 4]
        if masked_crc(payload) != data[end - 4:end]:
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at = end


def store(uri: str):
    """The file system and the path of a URI or a local path."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Memory:
    """A dictionary of two generations: when the younger reaches ``limit`` it
    becomes the older, and what is used again moves back to the younger."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def recall(self, keys: list) -> tuple[list, list]:
        """The values of ``keys`` (different ones), None where not known, and
        the places of those."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        values = list(map(self.young.get, keys))
        missing = []
        for i in [i for i, v in enumerate(values) if v is None]:
            value = values[i] = self.old.get(keys[i])
            if value is None:
                missing.append(i)
            else:
                self.young[keys[i]] = value
        return values, missing


class WordEncoder:
    """Ids of texts as bytes, by remembered words.

    Holds for a pre-tokenizer that drops white space and cuts between letters
    and other signs, behind a normalizer that lowers case.  A word of letters
    and trailing signs is two pieces, encoded once each; any other word is
    encoded as it is.
    """
    TAIL = "!\"#$%&()*+,./:;=?@_|~-"
    #: Latin letters that stay one letter in lower case.
    LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"

    def __init__(self, path: str, dtype: str, limit: int = 300_000, special: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype(dtype)
        self.words, self.pieces = Memory(limit), Memory(limit)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece.  A piece of one kind of sign is one
        pre-token, whose last id alone ends a word, so the ids of many pieces
        that are encoded as one text part again."""
        values, missing = self.pieces.recall(pieces)
        for i in range(0, len(missing), 1000):
            at = missing[i:i + 1000]
            ids = np.array(self._encode([" ".join([pieces[k] for k in at])])[0], self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(at):
                raise ValueError("the tokenizer does not cut words where this encoder does")
            raw, start = ids.tobytes(), 0
            for k, end in zip(at, (ends * ids.itemsize).tolist()):
                values[k] = self.pieces.young[pieces[k]] = raw[start:end]
                start = end
        return dict(zip(pieces, values))

    def _learn(self, found: list[str]) -> list[bytes]:
        trimmed = pc.utf8_rtrim(pa.array(found), characters=self.TAIL)
        regular = pc.match_substring_regex(trimmed, self.LETTERS).to_numpy(zero_copy_only=False)
        heads = _strings(trimmed)
        tails = [w[len(h):] for w, h in zip(found, heads)]
        plain = np.flatnonzero(regular).tolist()
        ids = self._of_pieces(list({heads[i] for i in plain} | {tails[i] for i in plain if tails[i]}))
        ids[""] = b""
        out: list = [None] * len(found)
        for i in plain:
            out[i] = ids[heads[i]] + ids[tails[i]]
        whole = np.flatnonzero(~regular).tolist()
        if whole:
            for i, encoded in zip(whole, self._encode([found[i] for i in whole])):
                out[i] = np.array(encoded, self.dtype).tobytes()
        self.words.young.update(zip(found, out))
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token that lower case could make
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = _strings(coded.dictionary)
        # Each distinct word's ids once, then gathered for every word.
        ids, missing = self.words.recall(distinct)
        if missing:
            for i, learnt in zip(missing, self._learn([distinct[i] for i in missing])):
                ids[i] = learnt
        pool = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // pool.itemsize
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        small = np.int32 if len(ends) and ends[-1] < 2**31 else np.int64
        first = (np.cumsum(sizes) - sizes).astype(small)[word] - (ends - n).astype(small)
        at = np.repeat(first, n)
        at += np.arange(len(at), dtype=small)
        out = pool[at].tobytes()
        stops = np.concatenate([[0], ends])[lists.offsets.to_numpy()] * pool.itemsize
        return [out[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist())]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Ids of whole texts as bytes, for any tokenizer."""

    def __init__(self, path: str, dtype: str, special: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.tokenizer.encode_special_tokens = not special

    def __call__(self, texts: pa.Array) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


_ENCODERS: dict[tuple, Callable] = {}


def encoder(path: str, dtype: str, by_word: bool, special: bool) -> Callable[[pa.Array], list[bytes]]:
    """One encoder for each Python worker, kept between its tasks."""
    key = (path, dtype, by_word, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = (WordEncoder if by_word else TextEncoder)(path, dtype, special=special)
    return _ENCODERS[key]


def encoded_parts(encode: Callable[[pa.Array], list[bytes]], texts: pa.Array, size: int = 16 << 20) -> Iterator[bytes]:
    """``encode`` over runs of texts of about ``size`` bytes, at least one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield from encode(texts.slice(start, stop - start))
        start = stop


_INDEX = pa.schema([("file", pa.string()), ("part", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64()),
                    ("offset", pa.int64()), ("n_tokens", pa.int64())])
_INDEX_DDL = "file string, part int, position long, doc_id long, offset long, n_tokens long"


def _writer(folder: str, tokenizer: str, end_id: int, width: int, by_word: bool, special: bool):
    dtype = {2: "<u2", 4: "<u4"}[width]
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        part = TaskContext.get().partitionId()
        name, out, position, offset = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.tok", None, 0, len(MAGIC) + 1
        encode = encoder(tokenizer, dtype, by_word, special)
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}")
                    out.write(MAGIC + bytes([width]))
                offsets, counts = [], []
                ids = column(batch, "doc_id").to_pylist()
                texts = column(batch, "text").fill_null("")
                for doc_id, encoded in zip(ids, encoded_parts(encode, texts)):
                    record = frame(head(doc_id) + encoded + end)
                    out.write(record)
                    offsets.append(offset)
                    counts.append(len(encoded) // width + 1)
                    offset += len(record)
                n = batch.num_rows
                yield record_batch(_INDEX, [[name] * n, [part] * n, list(range(position, position + n)),
                                            column(batch, "doc_id"), offsets, counts])
                position += n
        finally:
            if out is not None:
                out.close()
    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, width: int = 2,
                  by_word: bool = True, special: bool = True) -> DataFrame:
    """Write the files under ``folder``; returns the index, itself written to
    ``folder``/index.  ``width`` must hold the tokenizer's largest id;
    ``special``: strings of special tokens in a text become those tokens."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    index = map_arrow(ordered, _writer(folder, tokenizer, end_id, width, by_word, special), _INDEX_DDL)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


_READ = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_READ_DDL = "file string, doc_id long, start long, n_tokens long, ids_crc32 long, offset long"


def _reader(folder: str, chunk: int = 2000):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        for batch in batches:
            for name, start in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as f:
                    data = memoryview(f.read())
                if data[:len(MAGIC)] != MAGIC:
                    raise ValueError(f"{name} is no token file")
                width, rows = data[len(MAGIC)], []
                for offset, payload in read_frames(data, len(MAGIC) + 1):
                    ids = np.frombuffer(payload[HEAD:], f"<u{width}")
                    rows.append((name, head_id(payload), start, len(ids), zlib.crc32(ids.astype("<u4")), offset))
                    start += len(ids)
                    if len(rows) == chunk:
                        yield record_batch(_READ, list(map(list, zip(*rows))))
                        rows = []
                if rows:
                    yield record_batch(_READ, list(map(list, zip(*rows))))
    return read


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(file, doc_id, start, n_tokens, ids_crc32, offset) of every record of
    the listed files, read back and verified.  ``start`` counts the ids of all
    records before; the sum over files runs over one row a file."""
    per_file = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    # One file a task: a file holds what one range of the documents holds.
    starts = materialise(starts, "record-files")
    dealt = starts.repartition(max(1, starts.count()), "file")
    return map_arrow(dealt, _reader(folder), _READ_DDL)


def encode_corpus(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "records")
    index = write_records(docs, folder, tokenizer, **options)
    return read_records(docs.sparkSession, folder, index)


def op6_token_records(spark, sf_dir):
    """All documents as records of word_bpe_49k ids, read back from the files."""
    import public_tokenizers
    return encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
