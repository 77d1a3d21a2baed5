import random

import pytest
from pyspark.sql import functions as F

from fieldshift.llm import mixing


def make(spark, n=3000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        rows.append((i, " ".join(["w"] * rng.randint(1, 80)), rng.choice(["en", "en", "de", None]), source, rng.choice("abc")))
    rows += [(n, None, "en", "hot", "a"), (n, None, "en", "hot", "a"), (None, "x y", "en", None, "a"), (n + 1, "long " * 9000, "fr", "s0", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")


def slow_rake(cells, targets):
    mass = {k: v for k, v in cells.items()}
    for _ in range(400):
        for d, want in enumerate(targets):
            have = {}
            for k, v in mass.items():
                have[k[d]] = have.get(k[d], 0) + v
            mass = {k: v * want[k[d]] / have[k[d]] if have[k[d]] else 0 for k, v in mass.items()}
    return mass


def test_marginals_meet_targets_and_the_sample_follows(spark):
    docs = make(spark)
    rows = mixing.mix(docs, topic=F.col("topic")).collect()
    assert len(rows) == docs.count()
    cells, p = {}, {}
    for r in rows:
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.n_tokens
        p[k] = (r.weight, r.probability)
    total = sum(cells.values())
    targets = []
    for d, power in enumerate((0.5, 0.7, 0.7)):
        sums = {}
        for k, v in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        whole = sum(v**power for v in sums.values() if v)
        asked = {k: (v**power / whole if v else 0) for k, v in sums.items()}
        targets.append({k: v / total / 0.7 for k, v in attainable(sums, asked, 0.7 * total).items()})
    want = slow_rake({k: v / total for k, v in cells.items()}, targets)
    for k, v in cells.items():
        assert p[k][0] * v / total == pytest.approx(want[k], abs=1e-6)
    assert sum(p[k][1] * v for k, v in cells.items()) == pytest.approx(0.7 * total, rel=1e-6)
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert kept == pytest.approx(0.7 * total, rel=0.1)


def test_given_targets_and_small_fraction(spark):
    docs = make(spark).where("source is not null and lang is not null")
    targets = {"source": {"hot": 0.5, **{f"s{i}": 0.1 for i in range(5)}}, "lang": {"en": 0.5, "de": 0.5, "fr": 0.0}, "topic": {"a": 0.2, "b": 0.3, "c": 0.5}}
    rows = mixing.mix(docs, targets, 0.2, F.col("topic")).collect()
    expected = {}
    for r in rows:
        for d in targets:
            expected[d, r[d]] = expected.get((d, r[d]), 0) + r.n_tokens * r.probability
    total = sum(r.n_tokens * r.probability for r in rows)
    for d, want in targets.items():
        for v, share in want.items():
            assert expected.get((d, v), 0) / total == pytest.approx(share, abs=1e-4)


def test_cluster_rounds_equal_local_ones(spark, monkeypatch):
    docs = make(spark, 300)
    read = lambda df: {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in df.collect()}
    cells = mixing.cell_sums(mixing.describe(docs, F.col("topic")))
    for targets in (None, {"lang": {"en": 0.6, "de": 0.4}}):
        monkeypatch.setattr(mixing, "MOST_LOCAL_CELLS", 1)
        monkeypatch.setattr(mixing, "ROUNDS", 6)
        monkeypatch.setattr(mixing, "CLUSTER_ROUNDS", 6)
        got = read(mixing.weights(cells, targets, strict=False))
        monkeypatch.setattr(mixing, "MOST_LOCAL_CELLS", 200_000)
        want = read(mixing.weights(cells, targets, strict=False))
        monkeypatch.undo()
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_sample_keeps_the_columns_and_empty(spark):
    docs = make(spark, 200).drop("topic").withColumn("weight", F.lit("clash"))
    kept = mixing.sample(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in mixing.mix(docs).collect() if r.kept}
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def attainable(held, want, budget):
    """Tokens per value: the target's, or all there are, the rest shared by the others in proportion."""
    whole = set()
    while True:
        rest = (budget - sum(held[v] for v in whole)) / sum(w for v, w in want.items() if v not in whole)
        more = {v for v, w in want.items() if v not in whole and w * rest >= held[v]}
        if not more:
            return {v: held[v] if v in whole else w * rest for v, w in want.items()}
        whole |= more


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_expected_shares_at_the_production_parameters(spark, caplog, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    cells = mixing.cell_sums(mixing.describe(docs)).cache()
    with caplog.at_level("WARNING", logger=mixing.log.name):
        table = mixing.weights(cells).cache()
    assert not caplog.messages
    p = {(r.source, r.lang, r.topic): r.probability for r in table.collect()}
    rows = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
    budget = mixing.FRACTION * sum(rows.values())
    reported = {(r.dimension, r.value): r for r in mixing.shares(cells, table).collect()}
    for at, d in enumerate(mixing.DIMENSIONS):
        held, got = {}, {}
        for k, v in rows.items():
            held[k[at]] = held.get(k[at], 0) + v
            got[k[at]] = got.get(k[at], 0) + v * p[k]
        powers = {v: h ** mixing.TEMPER[d] for v, h in held.items()}
        want = {v: x / sum(powers.values()) for v, x in powers.items()}
        for v, x in attainable(held, want, budget).items():
            assert got[v] / sum(got.values()) == pytest.approx(x / budget, abs=1e-5), (d, v)
            assert reported[d, v].target == pytest.approx(x / budget) and reported[d, v].expected == pytest.approx(got[v] / budget)
    assert sum(p[k] * v for k, v in rows.items()) == pytest.approx(budget)


def test_given_targets_that_tokens_cannot_make_up(spark, caplog, monkeypatch):
    rows = [("a", "x", "t", 900.0), ("b", "x", "t", 100.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    apart = spark.createDataFrame([("a", "x", "t", 500.0), ("b", "y", "t", 500.0)], cells.schema)
    for most in (200_000, 1):
        monkeypatch.setattr(mixing, "MOST_LOCAL_CELLS", most)
        monkeypatch.setattr(mixing, "CLUSTER_ROUNDS", 3)
        with pytest.raises(mixing.Infeasible, match="source 'b'"):
            mixing.weights(cells, {"source": {"a": 0.5, "b": 0.5}}, 0.7)
        with pytest.raises(mixing.Infeasible):  # each can be met, but not both: a is all of x
            mixing.weights(apart, {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.6, "y": 0.4}}, 0.5)
        caplog.clear()
        loose = {r.source: r.probability for r in mixing.weights(cells, {"source": {"a": 0.5, "b": 0.5}}, 0.7, strict=False).collect()}
        assert loose["b"] == 1 and loose["a"] == pytest.approx(600 / 900) and len(caplog.messages) == 2
        held = {r.source: r.probability for r in mixing.weights(cells, {"source": {"a": 0.5, "b": 0.5}}, 0.2).collect()}
        assert held == pytest.approx({"a": 100 / 900, "b": 1.0})


def test_feasible_targets_hold_though_cells_are_kept_whole(spark, monkeypatch):
    tokens = {("a", "x"): 50, ("a", "y"): 950, ("b", "x"): 900, ("b", "y"): 600}
    rows = [(s, l, "t", float(n)) for (s, l), n in tokens.items()]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.45, "y": 0.55}}
    for most, rounds in ((200_000, 60), (1, 8)):
        monkeypatch.setattr(mixing, "MOST_LOCAL_CELLS", most)
        monkeypatch.setattr(mixing, "CLUSTER_ROUNDS", rounds)
        got = {(r.source, r.lang): r.probability * tokens[r.source, r.lang] for r in mixing.weights(cells, targets, 0.6, strict=most > 1).collect()}
        assert sum(got.values()) == pytest.approx(1500)
        assert got["a", "x"] <= 50 and got["a", "x"] + got["a", "y"] == pytest.approx(750, abs=5)
        assert got["a", "x"] + got["b", "x"] == pytest.approx(675, abs=5)
