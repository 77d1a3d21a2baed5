import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldshift.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "a b a b a b a b", "É é\x0bx\x85y z"]
    texts += [" ".join(rng.choices("abcdef", k=rng.randint(1, 60))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == slow_print(t)


def test_tree_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    points = [base]
    for _ in range(12):
        points.append(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    points = np.unique(np.concatenate(points))
    shard = np.sort(rng.integers(0, 3, len(points)))
    forest = simhash.Forest(points, shard)
    got = set()
    for a, b in forest.matches(np.arange(len(points)), 3):
        got |= set(zip(a.tolist(), b.tolist()))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(near & (shard[:, None] == shard[None, :]))) if i != j}
    assert got == want


def test_block_choices_share_a_block():
    rng = random.Random(4)
    for count in (4, 5, 6, 8):
        masks = simhash.agreeing(list(range(64)), count, 3)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not flips & m for m in masks)
            mask, depth = next(m for m in masks if not flips & m), 0
            while wider := simhash.again(mask, 3):  # dealt anew until no bits are left, the pair stays together
                mask, depth = next(m for m in wider if not flips & m), depth + 1
                assert all(w & m == m for m in [mask] for w in simhash.again(mask, 3))
            assert mask.bit_count() >= 61 and depth < 30


def test_a_hot_shard_is_dealt_into_bounded_trees(spark):
    """50,000 fingerprints that share 40 bits, by which any choice of blocks would put a third of them in one shard."""
    rng = np.random.default_rng(9)
    low = rng.choice(1 << 24, 50_000, replace=False).astype(np.uint64)
    points = np.concatenate([low | np.uint64(0xABCDEF1234 << 24), rng.integers(0, 1 << 64, 1000, dtype=np.uint64)])
    distinct = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(4).cache()
    most = 2000
    sizes = simhash.deal(distinct, most=most).groupBy("mask", "bits").count()
    shape = sizes.selectExpr("max(count) m", "sum(count) s").first()
    assert shape.m <= most and shape.s < 100 * len(points)
    links = {(r.a, r.b) for r in simhash.fingerprint_links(distinct, most=most).collect()}
    label = {int(p): int(p) for p in points.view(np.int64)}

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def join(a, b):
        x, y = sorted((find(a), find(b)))
        label[y] = x

    for a, b in links:
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") >= 1
        join(a, b)
    got = {i: find(i) for i in label}
    label = {i: i for i in label}
    ordered = np.sort(low)  # all pairs within 3 bits: by flipping each set of 3 of the 24 bits that differ
    one = [1 << i for i in range(24)]
    for flip in one + [a | b for i, a in enumerate(one) for b in one[:i]] + [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]:
        other = ordered ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(ordered, other), len(ordered) - 1)
        for a, b in zip(ordered[ordered[at] == other], other[ordered[at] == other]):
            if a < b:
                join(*(int((x | np.uint64(0xABCDEF1234 << 24)).view(np.int64)) for x in (a, b)))
    assert got == {i: find(i) for i in label}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(60):
        words = [rng.choice("lorem ipsum dolor sit amet consetetur elitr sed".split()) for _ in range(120)]
        texts[i] = " ".join(words)
    for i in range(60, 160):
        words = texts[rng.randrange(60)].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "new"
        texts[i] = " ".join(words).upper()
    texts |= {160: None, 161: "", 162: "\t", 163: "one", 164: "one"}
    rows = [(i, t, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want_prints = {i: slow_print(t) for i, t in texts.items()}
    for most in (simhash.MOST_MEMBERS, 8):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, most=most).collect()}
        assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want_prints
        assert {i: r.component_id for i, r in got.items()} == groups(want_prints)
        assert all(len(r.fingerprint) == 16 for r in got.values())


def test_empty_and_null(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, 7), (7, 7), (7, 7)]


def test_query_equals_all_pairs(spark):
    from fieldshift.llm.queries import op5_simhash

    d = "/root/testdata/sf0.001"
    prints = {r.doc_id: slow_print(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op5_simhash(spark, d).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == groups(prints)


def test_keep_first(spark):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "f g h i j k", "z"), (1, "a b c d e", "q"), (None, "a b c d e", "n"), (4, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({c: F.lit(c) for c in ("_stays_id", "id", "row", "n", "_rows", "fp", "component_id")})
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 4]
    assert simhash.keep_first(docs.where("doc_id > 1")).count() == 3
    assert simhash.keep_first(docs.limit(0)).count() == 0
