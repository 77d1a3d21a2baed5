import re

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken
from test_simhash import groups, slow_print

import corpus_pipeline
from fieldshift.llm import byte_bpe, mixing
from fieldshift.llm.queries import ORACLES
from fieldshift.llm.support import documents, materialize

D = "/root/testdata/sf0.01"


def test_every_stage_against_a_plain_version(spark):
    docs = documents(spark, D)
    columns = docs.columns
    states = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, D), "stage")
        assert docs.columns == columns
        states.append({r.doc_id: r for r in docs.collect()})
    good, first, clean, mixed = states
    source = {r.doc_id: r for r in documents(spark, D).collect()}

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    kept = con.execute(f"select doc_id from ({ORACLES['op9_quality']}) where kept").fetchall()
    assert good.keys() == {i for (i,) in kept} and all(good[i] == source[i] for i in good)

    labels = groups({i: slow_print(r.text) for i, r in good.items()})
    assert first.keys() == set(labels.values()) and all(first[i] == source[i] for i in first)

    assert clean.keys() == first.keys()
    for i, r in clean.items():
        assert r.text == re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1<assigned>"', first[i].text)
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (first[i].lang, first[i].source)

    assert mixed.keys() <= clean.keys() and all(mixed[i] == clean[i] for i in mixed)
    tokens = {i: len(r.text.split()) for i, r in clean.items()}
    assert 0.5 < sum(tokens[i] for i in mixed) / sum(tokens.values()) < 0.9

    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.bpe_encoding(spark, docs, D).collect()}
    assert out.keys() == mixed.keys()
    for i, r in out.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(mixed[i].text)

    again = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, D).collect()}
    assert again == {i: r.ids_sha256 for i, r in out.items()}


def test_sample_follows_the_weights(spark):
    rows = mixing.mix(documents(spark, D)).collect()
    assert all(0 <= r.probability <= 1 for r in rows)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, copies, and columns with clashing names."""
    spell = lambda x: "word" + "".join(chr(97 + x // 26**k % 26) for k in range(4))
    prose = lambda seed, n: " ".join(spell((seed * 7919 + i * 104729) % 456_979) for i in range(n))
    rows = [(i, prose(i, 60), "en", f"s{i % 3}", 60) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s0", 0), (102, " \n", None, None, 2), (None, prose(3, 60), "en", "s0", 60), (103, prose(200, 60), None, "s1", 60)]
    rows += [(104, prose(201, 60), "de", None, 60), (105, prose(5, 60), "en", "s2", 60), (7, prose(7, 60), "en", "s1", 60), (7, prose(900, 80), "en", "s1", 80)]
    rows += [(106, prose(300, 40000), "en", "s1", 1), (107, prose(301, 60) + f' token = "{"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"}"', "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: docs.doc_id for c in ("_row", "row", "id", "n", "kept", "n_words", "n_tokens", "weight", "probability", "topic", "fp", "findings", "_stays_id")}
    return docs.withColumns(clash)


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, D), "odd")
        assert after.columns == docs.columns and after.schema == docs.schema, name
        assert after.count() <= docs.count()
        docs = after
        if name == "quality rules":
            left = [r.doc_id for r in docs.collect()]
            assert sorted(i for i in left if i is not None and i < 100) == sorted([*range(60), 7, 7]) and None in left
            assert not {100, 101, 102} & set(left) and {103, 104, 106, 107} <= set(left)
        if name == "simhash near-dedup":
            left = [r.doc_id for r in docs.collect()]
            assert sorted(i for i in left if i is not None) == [*range(60), 103, 104, 106, 107] and left.count(None) == 1
        if name == "secret scans":
            assert docs.where("doc_id = 107").first().text.endswith('token = "<assigned>"')
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()}
    assert set(out) == {r.doc_id for r in docs.collect()} and all(r.n_tokens > 0 for r in out.values())


def test_run_on_empty_and_repeated_tables(spark, tmp_path):
    docs = odd_documents(spark)
    for name, table in (("none", docs.limit(0)), ("twice", docs.unionByName(docs))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) > 20
