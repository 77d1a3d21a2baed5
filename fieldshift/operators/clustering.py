"""Deterministic k-means: fitted on the driver to a bounded, evenly spaced sample, predicted by column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.raster import FLOAT_STEP
from ..sources.scratch import written
from .ranks import medians as medians_of
from .ranks import percentiles

# Fixed values.
MOST_STEPS, LEAST_SHIFT = 100, 1e-6
SAMPLE = 1200


@dataclass
class Clusters:
    """Centres in the standardized space of the named features, with what standardizes them."""

    names: list[str]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    centres: np.ndarray
    silhouette: float | None = None
    sample_labels: np.ndarray = field(default_factory=lambda: np.empty(0, int))

    @property
    def k(self) -> int:
        return len(self.centres)

    @property
    def original_centres(self) -> np.ndarray:
        return self.centres * self.scales + self.means

    def label(self, prefix: str = "") -> Column:
        """The nearest centre's number, the first among equals."""
        distances = []
        for centre in self.centres:
            terms = []
            for name, fill, mean, scale, at in zip(self.names, self.medians, self.means, self.scales, centre):
                x = F.coalesce(F.col(prefix + name).cast("double"), F.lit(float(fill)))
                terms.append(F.pow((x - F.lit(float(mean))) / F.lit(float(scale)) - F.lit(float(at)), 2))
            distances.append(sum(terms[1:], terms[0]))
        all_of = F.array(*distances)
        return (F.array_position(all_of, F.array_min(all_of)) - 1).cast("int")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def start_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Equally spaced members in the order of a weighted sum of features."""
    if k == 1:
        return x.mean(axis=0, keepdims=True)
    order = np.argsort(x @ np.linspace(1.0, 2.0, x.shape[1]), kind="stable")
    return x[order[np.rint(np.linspace(0, len(x) - 1, k)).astype(int)]].copy()


def lloyd(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after up to 100 steps, and the labels that the last step began with; an empty cluster moves to the
    point farthest from its centre."""
    labels = np.zeros(len(x), int)
    for _ in range(MOST_STEPS):
        gaps = _squares(x, centres)
        labels = gaps.argmin(axis=1)
        size = np.bincount(labels, minlength=len(centres))
        moved = np.stack([x[labels == c].mean(axis=0) if size[c] else x[gaps.min(axis=1).argmax()] for c in range(len(centres))])
        shift = np.sqrt(((moved - centres) ** 2).sum())
        centres = moved
        if shift <= LEAST_SHIFT:
            break
    return centres, labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over points of (b - a) / max(a, b); -1 for one cluster. A lone point has a = 0."""
    names, index = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return -1.0
    member = np.eye(len(names))[index]
    sums = np.sqrt(np.maximum(_squares(x, x), 0.0)) @ member
    size = member.sum(axis=0)
    own = np.arange(len(x)), index
    a = np.where(size[index] > 1, sums[own] / np.maximum(size[index] - 1, 1), 0.0)
    other = sums / size
    other[own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where(top <= FLOAT_STEP, 0.0, (b - a) / np.where(top > 0, top, 1.0)).mean())


def fit(sample: np.ndarray, medians: np.ndarray, means: np.ndarray, scales: np.ndarray, names: Sequence[str]) -> Clusters:
    """The k from 2 to about log2 of the sample with the best silhouette, the smallest among equals."""
    x = np.where(np.isfinite(sample), sample, medians)
    x = (x - means) / scales
    one = Clusters(list(names), medians, means, scales, x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, len(names))))
    if len(x) < 2 or (x.std(axis=0) <= FLOAT_STEP).all():
        return one
    best = None
    for k in range(2, min(len(x) - 1, max(2, int(np.log2(len(x))) + 1)) + 1):
        centres, labels = lloyd(x, start_centres(x, k))
        if len(np.unique(labels)) > 1:
            score = silhouette(x, labels)
            if best is None or score > best[0]:
                best = (score, centres)
    if best is None:
        return one
    centres, labels = lloyd(x, best[1])
    return Clusters(list(names), medians, means, scales, centres, best[0], labels)


def scaling(table: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, medians, and mean and population deviation after missing values became medians, in two passes."""
    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    found = medians_of(table.withColumn("_all", F.lit(0)), ["_all"], names).first()
    medians = np.array([0.0 if found is None or found[c] is None else found[c] for c in names])
    filled = [F.coalesce(clean(c), F.lit(float(m))) for c, m in zip(names, medians)]
    second = table.agg(*[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first()
    means, scales = (np.array([0.0 if v is None else v for v in second[i::2]]) for i in (0, 1))
    return table.count(), medians, means, np.where(scales <= FLOAT_STEP, 1.0, scales)


def numbered(table: DataFrame, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """Adds position, 0 for the first row in ``order``: counted within ranges and offset by the ranges before.

    No partition holds all rows; the ranges are one row each.
    """
    ranged = table.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn("position", (F.col("_before") + place - 1).cast("long")).drop("_part", "_before")


def sample_positions(count: int, most: int = SAMPLE) -> list[int]:
    if count <= most:
        return list(range(count))
    return np.rint(np.linspace(0, count - 1, most)).astype(int).tolist()


def cluster(table: DataFrame, names: Sequence[str], order: Sequence[str], most: int = SAMPLE) -> Clusters:
    """Clusters of ``table``; at most ``most`` rows, evenly spaced in ``order``, reach the driver."""
    count, medians, means, scales = scaling(table, names)
    if count == 0:
        raise ValueError("nothing to cluster")
    wanted = table.sparkSession.createDataFrame([(p,) for p in sample_positions(count, most)], "position long")
    rows = numbered(table.select(*dict.fromkeys([*order, *names])), order).join(F.broadcast(wanted), "position").orderBy("position")
    sample = np.array([[np.nan if r[c] is None else float(r[c]) for c in names] for r in rows.collect()], float).reshape(-1, len(names))
    return fit(sample, medians, means, scales, names)


def pixel_features(pixels: DataFrame) -> DataFrame:
    """What unassigned pixels are clustered by."""
    return pixels.select(
        "row",
        "col",
        *[F.col(c).cast("double").alias(c) for c in ("ndvi_base", "ndvi_target", "delta")],
        F.abs(F.col("delta").cast("double")).alias("abs_delta"),
        F.col("class_target").cast("double").alias("class_target"),
        (F.col("class_base") - F.col("class_target")).cast("double").alias("class_delta"),
    )


FEATURES = ("ndvi_base", "ndvi_target", "delta", "abs_delta", "class_target", "class_delta")


def pixel_cluster_statistics(labelled: DataFrame) -> DataFrame:
    """Per cluster: count and means, and the median of the second date."""
    mean = lambda c, name: F.avg(c).alias(name)
    labelled = written(labelled.select("cluster", *FEATURES), "labelled")  # so that labels are worked out once
    middle = percentiles(labelled, ["cluster"], "ndvi_target", [0.5], stored=True).select("cluster", F.col("p")[0].alias("median_ndvi_target"))
    sums = labelled.groupBy("cluster").agg(
        F.count("*").alias("pixel_count"),
        mean("ndvi_base", "mean_ndvi_base"),
        mean("ndvi_target", "mean_ndvi_target"),
        mean("delta", "mean_delta"),
        mean("abs_delta", "mean_abs_delta"),
        mean("class_target", "mean_class_target"),
        mean("class_delta", "mean_class_delta"),
    )
    return sums.join(F.broadcast(middle), "cluster", "left")


def region_cluster_statistics(features: DataFrame) -> DataFrame:
    """Per cluster of regions: count, area and the means that tell what it stands for."""
    means = {
        "area_m2": "area_mean", "compactness": "compactness_mean", "eccentricity": "eccentricity_mean", "mean_ndvi_base": "ndvi_base_mean",
        "mean_ndvi_target": "ndvi_target_mean", "mean_delta_ndvi": "delta_mean", "min_delta_ndvi": "delta_min_mean",
        "neighbour_polygon_count": "neighbour_count_mean", "surrounding_mean_delta_ndvi": "surrounding_delta_mean",
        "surrounding_mean_ndvi": "surrounding_ndvi_mean", "forecast_weight": "forecast_weight_mean",
    }
    return features.groupBy("cluster").agg(
        F.count("*").alias("polygon_count"), F.sum("area_m2").alias("area_sum"), *[F.avg(c).alias(n) for c, n in means.items()]
    )


def _z(values: np.ndarray) -> np.ndarray:
    spread = values.std()
    return (values - values.mean()) / spread if np.isfinite(spread) and spread > FLOAT_STEP else np.zeros(len(values))


def name_region_clusters(rows: Sequence) -> dict[int, str]:
    """Of the clusters that lose: the one most like building is new_development, then the one most like decline is
    degradation; all others are other. Loss counts for both; size, compactness and a former green for building;
    loss around, neighbours and a remaining green for decline."""
    names = {r["cluster"]: "other" for r in rows}
    losing = sorted((r for r in rows if r["delta_mean"] < 0), key=lambda r: r["cluster"])
    if not losing:
        return names
    z = {c: _z(np.array([float(r[c]) for r in losing])) for c in (
        "area_mean", "compactness_mean", "ndvi_base_mean", "ndvi_target_mean", "delta_mean", "neighbour_count_mean", "surrounding_delta_mean")}
    building = -z["delta_mean"] + z["area_mean"] + z["compactness_mean"] + z["ndvi_base_mean"] - z["ndvi_target_mean"]
    decline = -z["delta_mean"] - z["surrounding_delta_mean"] + z["neighbour_count_mean"] + z["ndvi_target_mean"] - z["area_mean"]
    first = int(building.argmax())
    names[losing[first]["cluster"]] = "new_development"
    rest = [i for i in range(len(losing)) if i != first]
    if rest:
        names[losing[max(rest, key=lambda i: (decline[i], -i))]["cluster"]] = "degradation"
    return names


def name_pixel_clusters(rows: Sequence) -> dict[int, str]:
    """Among the steadier half of the clusters the least green is stable_urban and the greenest of the rest
    stable_green; of what remains at or below the median change the most losing is degradation."""
    rows = sorted(rows, key=lambda r: r["cluster"])
    names = {r["cluster"]: "other" for r in rows}
    if not rows:
        return names
    steady = [r for r in rows if r["mean_abs_delta"] <= np.median([r["mean_abs_delta"] for r in rows])] or rows
    urban = min(steady, key=lambda r: r["median_ndvi_target"])
    names[urban["cluster"]] = "stable_urban"
    rest = [r for r in steady if r is not urban]
    green = max(rest, key=lambda r: r["median_ndvi_target"]) if rest else None
    if green is not None:
        names[green["cluster"]] = "stable_green"
    cut = np.median([r["mean_delta"] for r in rows])
    losing = [r for r in rows if r["mean_delta"] <= cut and r is not urban and r is not green]
    if losing:
        names[min(losing, key=lambda r: r["mean_delta"])["cluster"]] = "degradation"
    return names
