import random
import re

import numpy as np

from fieldshift.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1) if i is not None else ():
            passage = tuple(w[k : k + width])
            first[passage] = min(first.get(passage, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_packed_integers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 1 << 60], rng.integers(0, 1 << 20, 1000), rng.integers(0, 1 << 62, 100)):
        values = np.array(values, np.uint64)
        assert np.array_equal(substring.unpack(substring.pack(values)), values)


def test_rolling_hash_depends_on_the_run_alone():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    twice = np.concatenate([values, values[::-1], values])
    h = substring._rolling(twice, substring._BASES[0], 7)
    assert np.array_equal(h[:294], h[600:894]) and len(np.unique(h[:590])) == 590


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(f"{rng.choice('xyz')}{rng.randint(0, 60)}" for _ in range(rng.randint(0, 20))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i * 7 % 120, rng.choice([" ", "\n", " \x0b"]).join(parts)))
    rows += [(200, None), (201, ""), (202, passages[0]), (202, passages[0]), (None, passages[1]), (-5, passages[2]), (203, "é " * 400), (204, "é " * 300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int").repartition(3)
    want = slow(rows, 8)
    two_levels = {"chunk_bytes": 900, "block_bits": 3, "most_bits": 2, "group_windows": 8}
    for settings in ({}, {"chunk_bytes": 700}, {"chunk_bytes": 3000, "cell_bits": 6, "block_bits": 4}, two_levels | {"cell_bits": 9}, two_levels):
        got = substring.remove_repeats(docs, width=8, **settings).collect()
        assert sorted([tuple(r) for r in got], key=repr) == want, settings


def test_messages_of_a_chunk_are_bounded_at_any_size():
    """A sketch of 2 ** 47 cells is that of 100 TB."""
    rng = np.random.default_rng(4)
    for bits in (20, 30, 47):
        shift, fine = substring._shifts(bits, bits - substring.BLOCK_BITS, substring.MOST_BITS)
        cells = np.unique(rng.integers(0, 1 << bits, 200_000, dtype=np.uint64))
        codec = substring._Cells()
        sent = list(substring._messages(codec, 0, 7, shift, cells, np.ones(len(cells))))
        assert len(sent) <= 1 << substring.MOST_BITS and sum(m[3] for m in sent) == len(cells)
        assert max(len(m[4]) for m in sent) / 200_000 * len(sent) < 12
        # a batch's merged messages to the finer parts of one coarse part, and the cells that a fine part adds up
        inner = np.unique(rng.integers(0, 1 << shift, 200_000, dtype=np.uint64))
        assert len(list(substring._messages(codec, 0, 7, fine, inner, np.ones(len(inner))))) <= 1 << substring.MOST_BITS
        assert fine <= max(substring.BLOCK_BITS, 23)
    assert substring._shifts(64, 0, 12) == (64, 64) and substring._shifts(64, 24, 12) == (52, 40)


def test_hashes_of_a_window_are_independent():
    """Words whose first 64 bits are equal still make the second hash differ."""
    values = substring._word_hashes([b"a", b"b", b"a"])
    assert values.shape == (3, 2) and (values[0] == values[2]).all() and (values[0] != values[1]).all()
    clash = values.copy()
    clash[1, 0] = clash[0, 0]
    high, low = (substring._rolling(clash[:2, k], substring._BASES[k], 1) for k in (0, 1))
    assert high[0] == high[1] and low[0] != low[1]


def test_empty_and_short(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in substring.remove_repeats(short).collect()) == [(1, 2, 0, "a b"), (2, 2, 0, "a b"), (3, 0, 0, "")]
