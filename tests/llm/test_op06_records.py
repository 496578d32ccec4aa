import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retail_signal.llm import records as R
from retail_signal.llm.common import scratch
from .helpers import frame, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't they'll I'm", "naïve café ÀÉ", "ß ẞ İ ı Σς", "á éx", " x y\x85z\x1cq", "x1y22 3.14,", "!!! ??? ...",
       "日本語 テスト", "\U0001F600\U0001F601", "it's'the", "end.' 's", "<|endoftext|> a<|startoftext|>b", "_under_score__", "A!b?C", "\x00\x01", "ﬁ ①"]


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_encode_like_whole_texts():
    import pyarrow as pa
    tokenizer = Tokenizer.from_file(PATH)
    texts = ODD + [" ".join(ODD), "", " ", "\n".join(ODD) * 3]
    for limit in (300_000, 3):
        encode = R.WordEncoder(PATH, "<u2", limit=limit)
        for _ in range(2):
            got = [np.frombuffer(b, "<u2").tolist() for b in encode(pa.array(texts))]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = R.op6_token_records(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(rows)


def test_index_seeks_to_each_record(spark):
    folder = scratch(spark, "test-records")
    index = R.write_records(frame(spark, list(enumerate(ODD))), folder, PATH).collect()
    files, root = R.store(folder)
    tokenizer = Tokenizer.from_file(PATH)
    for r in index:
        with files.open_input_file(f"{root}/{r.file}") as f:
            data = memoryview(f.read())
        offset, payload = next(R.read_frames(data, r.offset))
        assert R.head_id(payload) == r.doc_id
        ids = np.frombuffer(payload[R.HEAD:], "<u2").tolist()
        assert ids == tokenizer.encode(ODD[r.doc_id], add_special_tokens=False).ids + [2] and len(ids) == r.n_tokens


def test_damage_is_found():
    good = R.MAGIC + b"\x02" + R.frame(b"payload one") + R.frame(b"")
    assert [bytes(p) for _, p in R.read_frames(memoryview(good))] == [b"payload one", b""]
    for i in range(8, len(good)):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            list(R.read_frames(memoryview(bytes(bad))))
    with pytest.raises(ValueError):
        list(R.read_frames(memoryview(good[:-1])))


def test_odd_rows_empty_tables_and_whole_text_encoder(spark):
    rows = odd_rows()
    for by_word in (True, False):
        got = R.encode_corpus(frame(spark, rows), PATH, by_word=by_word).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected([r[:2] for r in rows])
    assert R.encode_corpus(frame(spark, []), PATH).count() == 0
