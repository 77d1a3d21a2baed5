"""Raster operators against NumPy on hand-made grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.functions import grid as g
from fieldshift.functions import raster
from fieldshift.functions.rules import CHANGE_RULES, INDEX_RULES, Rule, classify, midpoint
from fieldshift.operators import alignment, allocation, clustering, focal, pixels, polygons, quality, regions, statistics

GRID = g.Grid(0.0, 100.0, 10.0, 10.0, 8, 10)


def cells_of(spark, array, name="value"):
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(array) if not np.isnan(v)]
    return spark.createDataFrame(rows, f"row int, col int, {name} float")


def array_of(table, name, shape):
    out = np.full(shape, np.nan)
    for r in table.collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


def test_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.1, 0.3), (0.0, 0.0), (5e-11, 5e-11), (nan, 0.5), (0.5, None), (inf, 0.5), (-0.5, 0.6), (0.2, -0.1)]
    table = spark.createDataFrame(rows, "red float, nir float")
    got = [r[0] for r in table.select(raster.vegetation_index(F.col("red"), F.col("nir"))).collect()]
    assert got[0] == pytest.approx(0.5) and got[1:6] == [None] * 5 and got[6] == 1.0 and got[7] == -1.0


def test_nodata_is_tested_before_scaling(spark):
    table = spark.createDataFrame([(-9999.0,), (-9999.09,), (-9998.0,), (float("nan"),), (2.0,)], "v float")
    got = [r[0] for r in table.select(raster.unmasked(F.col("v"), -9999.0, 0.5, 1.0)).collect()]
    assert got == [None, None, -4998.0, None, 2.0]


def test_classes_at_bounds_and_general_rules(spark):
    values = np.array([-1, 0.0999, 0.10, 0.25, 0.45, 0.65, 0.6501, 1], np.float32)
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v float")
    assert [r[0] for r in table.select(classify(F.col("v"), INDEX_RULES)).collect()] == [1, 1, 2, 3, 4, 4, 5, 5, 0, 0]
    table = spark.createDataFrame([(float(np.float32(v)),) for v in (-0.2001, -0.2, -0.05, 0.0499, 0.05, 0.2)], "v float")
    assert [r[0] for r in table.select(classify(F.col("v"), CHANGE_RULES)).collect()] == [1, 2, 3, 3, 4, 5]
    overlapping = [Rule(1, "a", 0.0, 1.0), Rule(2, "b", 0.5, 0.75, False, True)]
    table = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 0.6, 0.75, 0.9, 1.0)], "v float")
    assert [r[0] for r in table.select(classify(F.col("v"), overlapping)).collect()] == [0, 1, 1, 2, 2, 1, 0]
    with pytest.raises(ValueError):
        Rule(1, "x", 2.0, 1.0)


def test_class_targets():
    assert [midpoint(r, True) for r in INDEX_RULES[1:4]] == [0.175, 0.35, 0.55]
    assert midpoint(INDEX_RULES[0], True) == math.nextafter(0.10, -1) and midpoint(INDEX_RULES[4], False) == math.nextafter(0.65, 1)


def test_ready_forms(spark):
    make = lambda *v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "row int, col int, value float")
    assert [round(r.value, 5) for r in pixels.ready_index(make(1.01, -0.5)).collect()] == [1.01, -0.5]
    assert [round(r.value, 4) for r in pixels.ready_index(make(5000.0, -100.0)).collect()] == [0.5, -0.01]
    for bad in ((20000.0, 0.0), (float("nan"),)):
        with pytest.raises(ValueError):
            pixels.ready_index(make(*bad))


def test_common_mask(spark):
    a = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.01), (0, 2, None), (0, 3, -1.0)], "row int, col int, ndvi float")
    b = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.1), (0, 2, 0.1), (0, 3, float("nan"))], "row int, col int, ndvi float")
    assert [tuple(r) for r in pixels.common_mask([a, b]).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        pixels.common_mask([a])
    with pytest.raises(ValueError):
        pixels.require_cells(pixels.common_mask([a.where("col = 3"), b]))


def test_areas_and_transitions_are_dense(spark):
    table = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (0, 3)], "a int, b int")
    areas = {r.class_id: (r.pixel_count, r.area_m2, r.percent) for r in statistics.class_areas(table, "a", INDEX_RULES, 100.0).collect()}
    assert areas[1] == (3, 300.0, 100.0) and areas[5] == (0, 0.0, 0.0) and len(areas) == 5
    matrix = statistics.transition_matrix(table, "a", "b", INDEX_RULES, 100.0)
    rows = {(r.from_class, r.to_class): r.pixel_count for r in matrix.collect()}
    assert len(rows) == 25 and rows[1, 2] == 2 and rows[1, 1] == 1 and sum(rows.values()) == 3
    p = {(r.from_class, r.to_class): r.probability for r in statistics.transition_probabilities(matrix, INDEX_RULES).collect()}
    assert p[1, 2] == pytest.approx(2 / 3) and p[4, 4] == 1.0 and p[4, 1] == 0.0
    with pytest.raises(ValueError):
        statistics.transition_probabilities(table, INDEX_RULES)
    empty = statistics.class_areas(table.limit(0), "a", INDEX_RULES, 1.0).collect()
    assert [r.pixel_count for r in empty] == [0] * 5


def test_display_range_makes_room(spark):
    table = spark.createDataFrame([(0.5,), (0.5,)], "v float")
    r = statistics.display_range(table, ["v"], 0.05, 0.99).first()
    assert (r.vmin, r.vmax) == pytest.approx((0.475, 0.525))
    r = statistics.display_range(spark.createDataFrame([(0.2,), (0.4,)], "v float"), ["v"], 0.0, 1.0, True).first()
    assert (r.vmin, r.vmax) == pytest.approx((-0.02, 0.4))


PICTURE = np.array([
    [1, 1, 3, 3, 5, 5, 5, 3],
    [3, 3, 1, 3, 5, 3, 5, 3],
    [2, 2, 3, 3, 5, 5, 5, 3],
    [1, 1, 3, 4, 3, 3, 3, 3],
    [1, 3, 1, 4, 3, 2, 3, 2],
    [1, 1, 1, 4, 3, 2, 2, 2],
])


def flood(picture):
    label, out = {}, 0
    for start in np.ndindex(*picture.shape):
        if start in label or picture[start] not in (1, 2, 4, 5):
            continue
        out, todo = out + 1, [start]
        label[start] = out
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= n[0] < picture.shape[0] and 0 <= n[1] < picture.shape[1] and n not in label and picture[n] == picture[start]:
                    label[n] = out
                    todo.append(n)
    return label


def test_regions_touch_by_sides_and_class(spark):
    rows = [(r, c, int(v)) for (r, c), v in np.ndenumerate(PICTURE)]
    runs = regions.change_runs(spark.createDataFrame(rows, "row int, col int, delta_class int"))
    want = sorted(sorted(k for k, v in flood(PICTURE).items() if v == n) for n in set(flood(PICTURE).values()))
    for most in (regions.MOST_LOCAL_LINKS, 0):  # on the driver, and in rounds
        found = regions.regions_of_runs(runs, most)
        groups = {}
        for r in found.collect():
            groups.setdefault(r.region_id, []).extend((r.row, c) for c in range(r.first_col, r.last_col + 1))
        assert sorted(sorted(x) for x in groups.values()) == want
    table = {(r.min_row, r.min_col, r.delta_class): r for r in regions.region_table(found, GRID).collect()}
    ring = table[0, 4, 5]
    assert (ring.pixel_count, ring.bbox_min_x, ring.bbox_max_y, ring.bbox_min_y) == (8, 40.0, 100.0, 70.0)
    assert (ring.centre_x, ring.centre_y) == pytest.approx((55.0, 85.0))
    cells = regions.region_cells(found, regions.region_table(found, GRID))
    around = {r.region_id: r.perimeter_m for r in polygons.perimeters(cells, GRID).collect()}
    assert around[ring.region_id] == 160.0  # the hole counts
    top = regions.largest_regions(regions.region_table(found, GRID), 2).collect()
    assert sorted((r.change_type, r["rank"]) for r in top) == [("degradation", 1), ("degradation", 2), ("improvement", 1), ("improvement", 2)]
    assert regions.region_table(regions.regions_of_runs(runs.limit(0)), GRID).count() == 0


def test_largest_ties_are_ordered(spark):
    rows = [(2 * r, 0, 1) for r in range(30)]
    runs = regions.change_runs(spark.createDataFrame(rows, "row int, col int, delta_class int"))
    top = regions.largest_regions(regions.region_table(regions.regions_of_runs(runs), GRID)).orderBy("rank").collect()
    assert [r.min_row for r in top] == list(range(0, 40, 2))


def test_focal_repeats_edges(spark):
    rng = np.random.default_rng(5)
    x = rng.random((10, 8))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:5, :4] = np.nan
    padded = np.pad(x.astype(np.float32).astype(float), 2, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (5, 5)).reshape(10, 8, 25)
    count = (~np.isnan(windows)).sum(axis=2)
    mean = np.where(count, np.nansum(windows, axis=2) / np.maximum(count, 1), 0)
    square = np.where(count, np.nansum(windows**2, axis=2) / np.maximum(count, 1), 0)
    cells = cells_of(spark, x)
    assert np.allclose(array_of(focal.local_mean(cells, GRID, F.col("value")), "local_mean", x.shape), mean)
    assert np.allclose(array_of(focal.local_deviation(cells, GRID, F.col("value")), "local_std", x.shape), np.sqrt(np.maximum(square - mean**2, 0)), atol=1e-7)


def test_quotas_round_halves_to_even_and_slicing_is_greedy(spark):
    rng = np.random.default_rng(6)
    rows = [(i // 8, i % 8, 4, float(s)) for i, s in enumerate(rng.permutation(80).tolist())]
    rows += [(20 + i, 0, 3, 1.0) for i in range(5)]
    cells = spark.createDataFrame(rows, "row int, col int, class_target int, score double")
    p = spark.createDataFrame([(4, 1, 2.5 / 80), (4, 2, 1.5 / 80), (4, 3, 3.5 / 80), (3, 1, 0.1), (3, 2, 0.5)], "from_class int, to_class int, probability double")
    table = allocation.quotas(cells, p, rising=False)
    assert sorted((r.from_class, r.to_class, r.requested) for r in table.collect()) == [(3, 2, 2), (4, 1, 2), (4, 2, 2), (4, 3, 4)]
    got = allocation.select_by_quota(cells, table, 8).collect()
    best = sorted((r for r in rows if r[2] == 4), key=lambda r: -r[3])
    want = {(r[0], r[1]): to for r, to in zip(best, [1, 1, 2, 2, 3, 3, 3, 3])} | {(24, 0): 2, (23, 0): 2}
    assert {(r.row, r.col): r.to_class for r in got} == want


def test_change_direction_is_checked(spark):
    cells = spark.createDataFrame([(0, 0, 0.9)], "row int, col int, ndvi_target float")
    up = spark.createDataFrame([(0, 0, 0.5)], "row int, col int, applied double")
    assert allocation.apply_change(cells, up, "increase").first().forecast == 1.0
    assert allocation.apply_change(cells, up, "decrease").first().forecast == pytest.approx(0.4)
    with pytest.raises(ValueError):
        allocation.apply_change(cells, up, "sideways")


def test_clusters(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.05, (60, 2)) for m in (0.0, 1.0, 2.0)])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    rows[5] = (5, None, rows[5][2])
    table = spark.createDataFrame(rows, "i int, a double, b double")
    model = clustering.cluster(table, ["a", "b"], ["i"])
    assert model.k == 3 and model.silhouette > 0.8
    labels = {r.i: r.label for r in table.select("i", model.label().alias("label")).collect()}
    assert all(len({labels[i] for i in range(k, k + 60) if i != 5}) == 1 for k in (0, 60, 120))
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "i int, a double, b double")
    assert clustering.cluster(same, ["a", "b"], ["i"]).k == 1
    assert clustering.sample_positions(10, 4) == [0, 3, 6, 9] and clustering.sample_positions(3, 4) == [0, 1, 2]
    places = clustering.numbered(table, ["i"], 5).orderBy("i").collect()
    assert [r.position for r in places] == list(range(180))


def test_silhouette_and_start():
    x = np.array([[0.0], [1.0], [10.0]])
    a, b = (10 - 1) / 10, (9 - 1) / 9
    assert clustering.silhouette(x, np.array([0, 0, 1])) == pytest.approx((a + b + 1.0) / 3)
    assert clustering.silhouette(x, np.zeros(3)) == -1.0
    assert clustering.start_centres(x, 2).tolist() == [[0.0], [10.0]]


def test_cluster_names():
    pixel = [dict(cluster=i, mean_abs_delta=d, median_ndvi_target=m, mean_delta=c) for i, (d, m, c) in enumerate([(0.1, 0.2, 0.0), (0.1, 0.6, 0.0), (0.5, 0.3, -0.4), (0.4, 0.3, 0.3)])]
    assert clustering.name_pixel_clusters(pixel) == {0: "stable_urban", 1: "stable_green", 2: "degradation", 3: "other"}
    keys = ("delta_mean", "area_mean", "compactness_mean", "ndvi_base_mean", "ndvi_target_mean", "neighbour_count_mean", "surrounding_delta_mean")
    region = [dict(zip(("cluster", *keys), v)) for v in [(0, -0.5, 9, 1, 0.8, 0.1, 0, 0), (1, -0.2, 1, 0, 0.4, 0.3, 5, -0.3), (2, 0.3, 5, 1, 0, 0, 0, 0)]]
    assert clustering.name_region_clusters(region) == {0: "new_development", 1: "degradation", 2: "other"}
    assert clustering.name_region_clusters([]) == {}


def test_utm_against_known_values_and_back():
    x, y = g.to_utm(np.array([33.0, 30.5]), np.array([60.0, 59.9]), "EPSG:32636")
    assert x[0] == pytest.approx(500000.0, abs=1e-3) and y[0] == pytest.approx(6651411.190, abs=0.01)
    lon, lat = g.from_utm(x, y, "EPSG:32636")
    assert np.allclose(lon, [33.0, 30.5], atol=1e-9) and np.allclose(lat, [60.0, 59.9], atol=1e-9)
    with pytest.raises(ValueError):
        g.to_utm(0, 0, "EPSG:3857")


def test_grids():
    grid = g.covering_grid(503.2, 1007.0, 541.0, 1033.3)
    assert (grid.left, grid.top, grid.width, grid.height) == (500.0, 1040.0, 5, 4) and grid.cell_area == 100.0
    with pytest.raises(ValueError):
        grid.require_same(GRID)
    with pytest.raises(ValueError):
        g.Grid(0, 0, 0, 10, 1, 1)
    assert [g.nice_length(v) for v in (0, 1, 3, 70, 499, 0.03)] == [1.0, 1, 2, 50, 200, pytest.approx(0.02)]


def test_band_area_of_the_whole_earth(spark):
    area = spark.range(1).select(g.band_area(F.lit(-90.0), F.lit(90.0), 360.0)).first()[0]
    assert area == pytest.approx(5.10065621724e14, rel=1e-9)


def test_clip_and_areas(spark):
    square, hole = [(5, 15), (75, 15), (75, 95), (5, 95)], [(25, 35), (45, 35), (45, 65), (25, 65)]
    edges = alignment.rings_frame(spark, [[square, hole]])
    assert alignment.polygon_areas(edges).first().area == 70 * 80 - 20 * 30
    cells = cells_of(spark, np.ones((10, 8)))
    got = {(r.row, r.col) for r in alignment.clip(cells, edges, GRID).collect()}
    inside = lambda x, y: 5 <= x < 75 and 15 <= y < 95 and not (25 <= x < 45 and 35 <= y < 65)
    assert got == {(r, c) for r in range(10) for c in range(8) if inside(c * 10 + 5, 95 - r * 10)}


def test_resampling_weighs_valid_cells(spark):
    x = np.arange(80, dtype=float).reshape(10, 8)
    x[4, 4] = np.nan
    same = alignment.resample(cells_of(spark, x), GRID, GRID)
    assert np.allclose(array_of(same, "value", x.shape), x, equal_nan=True)
    shifted = g.Grid(5.0, 95.0, 10.0, 10.0, 7, 9)
    got = array_of(alignment.resample(cells_of(spark, x), GRID, shifted), "value", (9, 7))
    corners = np.stack([x[:-1, :-1], x[:-1, 1:], x[1:, :-1], x[1:, 1:]])
    assert np.allclose(got, np.nanmean(corners, axis=0))
    with pytest.raises(ValueError):
        alignment.resample(cells_of(spark, x), g.Grid(0, 1, 1, 1, 2, 2, "EPSG:2154"), GRID)


def test_rectangles():
    assert polygons.smallest_rectangle(np.array([(0, 0), (40, 0), (40, 10), (0, 10)], float)) == pytest.approx(4.0)
    tilted = np.array([(0, 0), (30, 30), (20, 40), (-10, 10)], float)
    assert polygons.smallest_rectangle(tilted) == pytest.approx(3.0)
    assert polygons.smallest_rectangle(np.array([(0, 0), (1, 1)], float)) == 0.0


def test_filling_and_lone_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 0, 2)], "region_id long, row int, col int")
    values = spark.createDataFrame([(0, c, 0.1 * c, 0.2, 0.1, 2) for c in range(3)], "row int, col int, ndvi_base float, ndvi_target float, delta float, class_target int")
    zones = polygons.zonal_statistics(cells, values)
    assert {r.region_id: r.std_ndvi_base for r in zones.collect()}[1] is None
    filled = {r.region_id: r for r in polygons.fill_with_medians(zones).collect()}
    assert filled[1].std_ndvi_base == filled[2].std_ndvi_base and filled[1].class_2_share == 1.0


def test_raster_requirements(spark):
    with pytest.raises(quality.InputError):
        quality.require_raster(cells_of(spark, np.full((2, 2), np.nan)), "value", GRID)
    one = cells_of(spark, np.ones((2, 2)))
    quality.require_raster(one, "value", GRID, (0, 0, 10, 10))
    with pytest.raises(quality.InputError):
        quality.require_raster(one, "value", GRID, (1000, 0, 2000, 10))
    assert quality.band_metadata(one, "value", GRID).first().valid_count == 4


def test_empty_cells_leak_into_scores_only_when_asked(spark):
    rng = np.random.default_rng(11)
    rows = [(r, c, 0.6, float(np.float32(v)), float(np.float32(v - 0.6))) for r in range(10) for c in range(8) for v in [rng.uniform(0.1, 0.5)] if (r, c) != (4, 4)]
    cells = spark.createDataFrame(rows, "row int, col int, ndvi_base float, ndvi_target float, delta float").withColumn("capacity", F.abs("delta").cast("double"))
    influence = cells.select("row", "col", F.lit(0.5).alias("influence"))
    read = lambda df: {(r.row, r.col): r.score for r in df.collect()}
    size = {(r, c): abs(d) for r, c, _, _, d in rows}
    top = max(size.values())
    leaky, strict = (read(allocation.degradation_scores(cells, influence, GRID, leak)) for leak in (True, False))
    assert all(leaky[k] - strict[k] == pytest.approx(0.25 * (v / top - v / 9999), abs=1e-6) for k, v in size.items())
    leaky, strict = (read(allocation.recovery_scores(cells, GRID, leak)) for leak in (True, False))
    assert all(strict[k] - leaky[k] == pytest.approx(v / top - v / 9999, abs=1e-6) for k, v in size.items())
    full = cells.unionByName(cells.limit(1).withColumn("row", F.lit(4)).withColumn("col", F.lit(4)))
    same = [read(allocation.recovery_scores(full, GRID, leak)) for leak in (True, False)]
    assert same[0] == same[1]
