"""Order statistics, quotas and distances by counting and separation, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.functions.grid import Grid
from fieldshift.operators import allocation, polygons, ranks


def groups(seed=1):
    rng = np.random.default_rng(seed)
    return {
        "even": rng.normal(size=200), "odd": rng.normal(size=301), "tied": np.repeat([1.0, 2.0], [70, 31]), "one": np.array([5.0]),
        "same": np.full(50, -3.0), "far": np.concatenate([rng.normal(size=99), [1e300, -1e300]]), "small": np.float32(rng.random(400)).astype(float),
    }


@pytest.mark.parametrize("pieces", [1, 3, 4096])
def test_ranked_values(spark, pieces):
    data = groups()
    values = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, x double").repartition(5)
    wanted = [(g, r) for g, vs in data.items() for r in {0, len(vs) // 2, len(vs) - 1, len(vs)}]
    got = {(r.g, r.rank): r.x for r in ranks.ranked(values, ["g"], "x", spark.createDataFrame(wanted, "g string, rank long"), pieces).collect()}
    assert got == {(g, r): np.sort(data[g])[r] for g, r in wanted if r < len(data[g])}


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_percentiles_and_medians(spark, monkeypatch, at_once):
    monkeypatch.setattr(ranks, "AT_ONCE", at_once)
    data = groups(2)
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    values = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = {r.g: r.p for r in ranks.percentiles(values, ["g"], "x", shares).collect()}
    assert got.keys() == data.keys()
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-12)
    middle = {r.g: (r.x, r.y) for r in ranks.medians(values.withColumn("y", -F.col("x")), ["g"], ["x", "y"]).collect()}
    assert middle == {g: (np.median(vs), -np.median(vs)) for g, vs in data.items()}
    assert ranks.percentiles_of_all(values.limit(0), F.col("x"), [0.5]).count() == 0


@pytest.mark.parametrize("scores", ["spread", "tied", "few"])
def test_quotas_against_a_sort(spark, scores):
    rng = np.random.default_rng(3)
    width, n = 20, 300
    place = rng.permutation(width * 40)[:n]
    score = {"spread": rng.random(n), "tied": np.full(n, 0.5), "few": rng.choice([0.1, 0.2, 1e9], n)}[scores]
    cells = [(int(p // width), int(p % width), int(c), float(s)) for p, c, s in zip(place, rng.integers(2, 5, n), score)]
    table = [(2, 1, 0, 40), (3, 1, 0, 10), (3, 2, 10, 35), (4, 1, 0, 30), (4, 2, 30, 500), (4, 3, 500, 900), (9, 1, 0, 5)]
    df = spark.createDataFrame(cells, "row int, col int, class_target int, score double")
    quotas = spark.createDataFrame(table, "from_class int, to_class int, low long, high long")
    got = {(r.row, r.col): r.to_class for r in allocation.select_by_quota(df, quotas, width).collect()}
    want = {}
    for c in (2, 3, 4):
        own = sorted((x for x in cells if x[2] == c), key=lambda x: (-x[3], -(x[0] * width + x[1])))
        for rank, x in enumerate(own, 1):
            for start, to, low, high in table:
                if start == c and low < rank <= high:
                    want[x[:2]] = to
    assert got == want


def test_distances_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    grid = Grid(0.0, 0.0, 10.0, 8.0, 70, 60)
    shapes = {1: {(r, c) for r in range(20, 30) for c in range(5, 9)} - {(24, 6)}, 2: {(0, 0), (59, 69)}, 3: {(int(r), int(c)) for r, c in zip(rng.integers(0, 60, 40), rng.integers(0, 70, 40))}}
    reach = {1: 55.0, 2: 0.0, 3: 31.0}
    cells = spark.createDataFrame([(i, r, c) for i, s in shapes.items() for r, c in s], "region_id long, row int, col int")
    got = {}
    for x in polygons.around(cells, spark.createDataFrame(list(reach.items()), "region_id long, reach double"), grid).collect():
        assert (x.region_id, x.row, x.col) not in got and x.reach == reach[x.region_id]
        got[x.region_id, x.row, x.col] = (x.square_gap, x.centre_gap)
    want = {}
    for i, shape in shapes.items():
        at = np.array(sorted(shape))
        for r in range(grid.height):
            for c in range(grid.width):
                dr, dc = np.abs(at[:, 0] - r), np.abs(at[:, 1] - c)
                square = np.hypot(np.maximum(dc - 0.5, 0) * 10.0, np.maximum(dr - 0.5, 0) * 8.0).min()
                if square <= reach[i]:
                    want[i, r, c] = (square, np.hypot(dc * 10.0, dr * 8.0).min())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
