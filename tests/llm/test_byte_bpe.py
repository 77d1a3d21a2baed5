import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from fieldshift.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "  ", "a  b", "a \n b\n", "\n\n x", "x'sé 's  's\t　zz  q ", "  lead", "é 1234567 <|endoftext|>\r\n",
    "日本語 テスト。🙂👍🏽", "a\x1c\x1d b\x1c c \x85 d\x0b\x1f", "word " * 3000, "x" * 5000, "tie tie", "tie tie",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_knows_foreign_keys():
    keys = byte_bpe.read_ranks(PATH)[:5000]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(len(keys)))
    assert [h.find(k) for k in keys] == list(range(len(keys)))
    assert h.find(b"no such token at all") == -1
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


def test_heap_merge_equals_repeated_scan():
    ranks = {bytes([b]): b for b in range(97, 100)}
    for i, pair in enumerate([b"ab", b"bc", b"abab", b"ca", b"abc", b"cc", b"cca"]):
        ranks[pair] = 1000 + i

    def scan(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(3)
    for _ in range(500):
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 20)))
        assert byte_bpe.heap_merge(word, ranks) == scan(word)


def test_round_trip_and_ids(spark, reference):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN)
    together = {r.doc_id: (r.ids, r.decoded) for r in byte_bpe.encode(docs, PATH, P.PATTERN, decoded=True).collect()}
    assert together == {r.doc_id: (r.ids, r.decoded) for r in byte_bpe.decode(encoded, PATH).collect()}
    rows = {r.doc_id: r for r in byte_bpe.decode(encoded, PATH).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = reference.encode_ordinary(text or "")
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want
        assert rows[i].n_tokens == len(want) and bytes(rows[i].decoded) == (text or "").encode()


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, PATH, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert byte_bpe.encode(odd, PATH, P.PATTERN).count() == 3


def test_query_has_the_digests(spark, reference):
    from fieldshift.llm.queries import op1_byte_bpe

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_byte_bpe(spark, d).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = reference.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 7)
    codec = byte_bpe.Codec(byte_bpe.PerfectHash(byte_bpe.read_ranks(PATH)), P.PATTERN)
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(30))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
