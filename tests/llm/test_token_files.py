import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldshift.llm import token_files

PATH = P.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n", "Don't STOP'S 'S 12345 ré É ß Straße", "a<|endoftext|>b <|startoftext|>", "é café İI ΣΣ",
    "x\xa0y　z", "a\x1cb\x85c", "日本語 \U0001f642!!", "***$$$ --- ...a...", "\xd7\xf7\xaa\xba", "long " * 3000, "z" * 4000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def want(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tokenizer, tmp_path, encoding):
    rows = [(len(TEXTS) - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "tie", "x"), (3, "tie", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / encoding)
    got = token_files.store(docs, PATH, path, encoding).collect()
    by_place = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_place] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at = 0
    for r in by_place:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    texts = {r[0]: r[1] for r in rows if r[0] != 3}
    for r in got:
        if r.doc_id in texts:
            assert list(r.ids) == want(tokenizer, texts[r.doc_id]), texts[r.doc_id]
    some = token_files.read(spark, path, F.col("doc_id") == 5, ids=False).collect()
    assert [(r.doc_id, r.start) for r in some] == [(r.doc_id, r.start) for r in got if r.doc_id == 5]


def test_files_have_the_encoding_and_page_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same few words again") for i in range(500)], "doc_id long, text string")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = tmp_path / encoding
        token_files.write(token_files.encode_sorted(docs, PATH), str(path), encoding)
        for file in path.glob("*.parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
            assert name in column.encodings and column.has_offset_index
    with pytest.raises(ValueError):
        token_files.write(docs, str(tmp_path / "x"), "plain")


def test_empty(spark):
    assert token_files.digests(token_files.store(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


def test_query(spark, tokenizer):
    from fieldshift.llm.queries import op10_token_files

    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {r.doc_id: r for r in op10_token_files(spark, d).collect()}
    at = 0
    for i, t in rows:
        ids = np.array(want(tokenizer, t), "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
