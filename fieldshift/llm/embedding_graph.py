"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of a label become one point with a count. The points of each label are dealt to overlapping clusters:
each to the cluster of its nearest centre and to all whose centre is nearly as near. A graph is built per cluster shard
(nearest neighbours, robustly pruned, with reverse edges), the adjacency lists of a point's shards are united, and each
shard searches its own points: a greedy beam from the shard's medoid and the point itself, then a range expansion that
follows every node near the threshold. Found pairs are verified in double precision.

Within a shard no link is lost. A node is marked as cut where its candidate list or its degree may leave out a point at
or over the threshold. From a node without mark, each such point is a neighbour, or a neighbour is nearer to it by the
factor ALPHA; so the range expansion reaches all of them, if it meets no cut node. A point whose search meets one is
compared with its whole shard, in blocks, and so is every point of a shard above LEAF. Links between shards that do not
overlap are audited on a bounded sample against all rows; if too many are missing, points are dealt anew, each to all
clusters that may hold a point linked to it.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import merge_labels
from .support import materialize

THRESHOLD = 0.93
#: Points that a shard is planned for, and the most centres in all.
SHARD, MOST_CENTRES = 2048, 4096
#: Vectors that centres are fitted to.
FITTED = 20_000
#: Nearness to the nearest centre, in cosine, within which a point joins other clusters too.
MARGIN = 0.15
DEGREE, NEAREST, ALPHA, LEAF = 24, 48, 1.5, 8192
BEAM, SLACK = 32, 0.08
#: Points at a smaller squared distance are never pruned for one another, as no step between them gets nearer to a third.
TINY = 1e-9
#: Cosine below the threshold down to which pairs are verified in double precision.
ROUNDING = 1e-4
#: Searches by one task.
SEARCHES = 4096
#: Points audited at first and at most, the true links between distinct points that measure recall, and the least recall.
AUDITED, MOST_AUDITED, MEASURED, LEAST_RECALL = 256, 4096, 200, 0.95

log = logging.getLogger(__name__)


def robust_prune(x: np.ndarray, owners: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each owner the neighbours kept of its candidates, which come nearest first (-1: none).

    The nearest candidate is kept, and those that it is closer to by the factor alpha than the owner is go; and so on.
    Distances are of unit vectors. All owners go in step.
    """
    m, width = near.shape
    to_owner = np.where(near >= 0, 2 - 2 * np.einsum("ij,ikj->ik", x[owners], x[np.maximum(near, 0)]), np.inf)
    alive = near >= 0
    kept = np.full((m, degree), -1, np.int64)
    rows = np.arange(m)
    for place in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = np.where(some, near[rows, first], -1)
        kept[:, place] = pick
        between = 2 - 2 * np.einsum("ij,ikj->ik", x[np.maximum(pick, 0)], x[np.maximum(near, 0)])
        alive &= ~some[:, None] | (alpha * alpha * np.maximum(between, TINY) > to_owner)
        alive[rows, first] = False
    return kept


def flat_graph(x: np.ndarray, leaf: int = LEAF, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (from, to) with their reverses over unit vectors, and whether each node is cut; no edges above ``leaf`` points.

    A node is cut if points at or over the threshold may be neither among its candidates nor covered by what was kept.
    """
    n = len(x)
    take = min(NEAREST, n - 1)
    none = np.empty(0, np.int64)
    if n > leaf or take < 1:
        return none, none, np.full(n, n > leaf)
    out, cut = [], np.zeros(n, bool)
    for at in range(0, n, 256):
        owners = np.arange(at, min(n, at + 256))
        sims = x[owners] @ x.T
        sims[np.arange(len(owners)), owners] = -np.inf
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        kept = robust_prune(x, owners, near)
        row, place = np.nonzero(kept >= 0)
        out.append((owners[row], kept[row, place]))
        last = np.where(kept[:, -1] >= 0, sims[np.arange(len(owners)), kept[:, -1]], -np.inf)
        cut[owners] = ((sims >= threshold - ROUNDING).sum(axis=1) > take) | (last >= threshold - ROUNDING)
    a, b = (np.concatenate(c) for c in zip(*out))
    return np.concatenate([a, b]), np.concatenate([b, a]), cut


class Graph:
    """Vectors, neighbour lists and cut nodes of one shard; finds what lies within a cosine of given points."""

    def __init__(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, cut: np.ndarray):
        order = np.argsort(a, kind="stable")
        self.x, self.low, self.cut = x, x.astype(np.float32), cut
        self.to, self.first = b[order], np.searchsorted(a[order], np.arange(len(x) + 1))
        self.medoid = int(np.argmax(x @ x.mean(axis=0))) if len(x) else 0

    def _neighbours(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.first[node + 1] - self.first[node]
        offset = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        return np.repeat(row, width), self.to[np.repeat(self.first[node], width) + offset]

    def search(self, queries: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK):
        """Pieces of (query, node) pairs of different points with cosine at or over the threshold: all there are."""
        n = len(self.x)
        block = max(8, min(512, 8_000_000 // max(1, n)))
        # a path to a point at distance r stays within (1 + 1 / ALPHA ** 2) * r of the query
        slack = max(slack, (1 - threshold) * ((1 + ALPHA**-2) ** 2 - 1) + 1e-3)
        cut = self.cut[queries]
        for part in (queries[~cut], queries[cut]):
            for at in range(0, len(part), block):
                own = part[at : at + block]
                sims = self.low[own] @ self.low.T if self.cut[own[0]] else self._walk(own, threshold, beam, slack)
                yield from self._verified(own, sims, threshold)

    def _verified(self, queries: np.ndarray, sims: np.ndarray, threshold: float):
        row, node = np.nonzero(sims >= threshold - ROUNDING)
        for i in range(0, len(row), 1 << 17):
            a, b = queries[row[i : i + (1 << 17)]], node[i : i + (1 << 17)]
            near = (np.einsum("ij,ij->i", self.x[a], self.x[b]) >= threshold) & (a != b)
            yield a[near], b[near]

    def _walk(self, queries: np.ndarray, threshold: float, beam: int, slack: float) -> np.ndarray:
        """Cosines of the nodes seen from each query, of all nodes where a cut one is met; -2 elsewhere."""
        n, m = len(self.x), len(queries)
        sims = np.full((m, n), -2, np.float32)  # -2: not seen
        opened = np.zeros((m, n), bool)
        rows = np.arange(m)

        def see(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = sims[row, node] == -2
            row, node = row[new], node[new]
            for i in range(0, len(row), 1 << 17):
                r, v = row[i : i + (1 << 17)], node[i : i + (1 << 17)]
                sims[r, v] = np.einsum("ij,ij->i", self.low[queries[r]], self.low[v])
            return row, node

        see(rows, np.full(m, self.medoid))
        see(rows, queries)
        heads = np.stack([np.full(m, self.medoid), queries], 1)  # the beam: the nearest nodes seen
        for _ in range(4 * beam):
            score = np.where(opened[rows[:, None], heads], -3, sims[rows[:, None], heads])
            best = np.argmax(score, axis=1)
            go = score[rows, best] > -2
            if not go.any():
                break
            row, node = rows[go], heads[go, best[go]]
            opened[row, node] = True
            row, node = see(*self._neighbours(row, node))
            if not len(row):
                continue
            # the new nodes of each query side by side, padded with the query's first head
            pairs = np.unique(row * n + node)
            row, node = pairs // n, pairs % n
            count = np.bincount(row, minlength=m)
            pad = np.repeat(heads[:, :1], int(count.max()), 1)
            pad[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = node
            heads = np.concatenate([heads, pad], 1)
            if heads.shape[1] > beam:
                near = np.argsort(-sims[rows[:, None], heads], axis=1, kind="stable")[:, : 2 * beam]
                heads = np.take_along_axis(heads, near, 1)
        row, node = np.nonzero((sims >= threshold - slack) & ~opened)
        while len(row):
            opened[row, node] = True
            fresh = []
            for i in range(0, len(row), 1 << 15):
                r, v = see(*self._neighbours(row[i : i + (1 << 15)], node[i : i + (1 << 15)]))
                fresh.append(np.unique((r * n + v)[sims[r, v] >= threshold - slack]))
            new = np.unique(np.concatenate(fresh))
            row, node = new // n, new % n
            shut = ~opened[row, node]
            row, node = row[shut], node[shut]
        unsure = np.flatnonzero(((sims >= threshold - slack) & self.cut).any(axis=1))
        if len(unsure):
            sims[unsure] = self.low[queries[unsure]] @ self.low.T
        return sims


def _unit(vectors: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    """Vectors of one length, none of them zero, as rows of length 1."""
    if isinstance(vectors, list):
        x = np.array(vectors, np.float64)
    else:
        whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        x = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(label, vector, point, n): the distinct usable vectors of each label; point is the smallest id, n the rows."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    return (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.alias("vector"))
        .where(usable)
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("point"), F.count("*").alias("n"))
    )


def _centres(found: DataFrame, shard: int) -> dict:
    """Centres of the labels with more than ``shard`` points, fitted to a bounded sample; others have one cluster."""
    sizes = found.groupBy("label", F.size("vector").alias("width")).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    shard = max(shard, 2 * total // MOST_CENTRES)
    large = {(r.label, r.width): math.ceil(r["count"] / shard) for r in sizes.where(F.col("count") > shard).collect()}
    if not large:
        return {}
    names = found.sparkSession.createDataFrame([(k[0], k[1]) for k in large], "label " + found.schema["label"].dataType.simpleString() + ", width int")
    sample = (
        found.withColumn("width", F.size("vector"))
        .join(F.broadcast(names), ["label", "width"])
        .orderBy(F.xxhash64("point"))
        .limit(FITTED)
        .collect()
    )
    fitted = {}
    for key, count in large.items():
        own = [r.vector for r in sample if (r.label, r.width) == key]
        if len(own) > count > 1:
            x = _unit(own)
            centres = x[:count]
            for _ in range(6):
                nearest = np.argmax(x @ centres.T, axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, x)
                norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
                centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
            fitted[key] = centres
    return fitted


def _link(found: DataFrame, threshold: float, margin: float | None, shard: int, searches: int) -> DataFrame:
    """(point, links, pairs, root): per searched point the rows and other points it links to, and edges (point, root)
    with links null.

    Without a margin a point joins every cluster that is the nearest of any vector linked to it, so no link is lost:
    vectors at cosine t are sqrt(2 - 2 t) apart, so that much moves the difference of two centres' products at most.
    """
    apart = math.sqrt(max(0.0, 2 - 2 * threshold))
    kind = found.schema["label"].dataType.simpleString()
    centres = found.sparkSession.sparkContext.broadcast(_centres(found, shard))

    def deal(batches):
        for batch in batches:
            label, vector, point, n = batch.columns
            widths = vector.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.unique(np.stack([pc.dictionary_encode(label).indices.to_numpy(), widths]), axis=1, return_inverse=True)[1].reshape(-1)
            for key in range(int(keys.max(initial=-1)) + 1):
                at = np.flatnonzero(keys == key)
                width = int(widths[at[0]])
                own = centres.value.get((label[int(at[0])].as_py(), width))
                rows, cells, mine = at, np.zeros(len(at), np.int32), np.ones(len(at), bool)
                if own is not None:
                    near = _unit(vector.take(pa.array(at))) @ own.T
                    best = np.argmax(near, axis=1)
                    apart_from = np.sqrt(np.maximum(0, 2 - 2 * own @ own.T)) if margin is None else None
                    reach = margin if margin is not None else apart * apart_from[best] * 1.0001 + TINY
                    row, cell = np.nonzero(near >= near[np.arange(len(at)), best][:, None] - reach)
                    rows, cells, mine = at[row], cell.astype(np.int32), best[row] == cell
                taken = batch.take(pa.array(rows))
                columns = [taken.column(0), pa.array(np.full(len(rows), width, np.int32)), pa.array(cells), taken.column(2), taken.column(3), taken.column(1), pa.array(mine)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["label", "width", "cell", "point", "n", "vector", "own"]
    dealt = materialize(
        found.select("label", "vector", "point", "n").mapInArrow(
            deal, f"label {kind}, width int, cell int, point long, n long, vector array<double>, own boolean"
        ),
        "dealt",
    )

    def build(table: pa.Table) -> pa.Table:
        point = table.column("point").to_numpy()
        a, b, cut = flat_graph(_unit(table.column("vector")), threshold=threshold)
        ends = np.searchsorted(np.sort(a), np.arange(len(point) + 1))
        b = point[b[np.argsort(a, kind="stable")]]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(b))
        return pa.table({"point": pa.array(point), "near": lists, "cut": pa.array(cut)})

    adjacency = (
        dealt.groupBy("label", "width", "cell")
        .applyInArrow(build, "point long, near array<long>, cut boolean")
        .groupBy("point")
        .agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("cut").alias("cut"))  # bounded: a list per shard of the point
    )
    parts = dealt.groupBy("label", "width", "cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / F.lit(searches)).cast("int").alias("parts"))
    ready = (
        dealt.join(adjacency, "point")
        .join(parts.where("parts > 0"), ["label", "width", "cell"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("search", F.col("own") & (F.pmod(F.xxhash64("point"), F.col("parts")) == F.col("part")))
        .select("label", "width", "cell", "part", "point", "n", "vector", "near", "cut", "search")
    )

    def search(table: pa.Table) -> pa.Table:
        point = table.column("point").to_numpy()
        order = np.argsort(point)
        point, count = point[order], table.column("n").to_numpy()[order]
        x = _unit(table.column("vector"))[order]
        near = table.column("near").combine_chunks().take(pa.array(order))
        a, to = np.repeat(np.arange(len(point)), near.value_lengths().to_numpy(zero_copy_only=False)), near.flatten().to_numpy()
        b = np.searchsorted(point, to)
        inside = (b < len(point)) & (point[np.minimum(b, len(point) - 1)] == to)
        queries = np.flatnonzero(table.column("search").to_numpy(zero_copy_only=False)[order])
        cut = table.column("cut").to_numpy(zero_copy_only=False)[order]
        links, pairs, labels = count - 1, np.zeros(len(point), np.int64), np.arange(len(point))
        for q, node in Graph(x, a[inside], b[inside], cut).search(queries, threshold):
            links = links + np.bincount(q, count[node], len(point)).astype(np.int64)
            pairs += np.bincount(q, minlength=len(point))
            merge_labels(labels, q, node)
        tied = np.flatnonzero(labels != np.arange(len(point)))
        none = np.concatenate([np.zeros(len(queries), bool), np.ones(len(tied), bool)])
        return pa.table({
            "point": pa.array(np.concatenate([point[queries], point[tied]])),
            "links": pa.array(np.concatenate([links[queries], np.zeros(len(tied), np.int64)]), mask=none),
            "pairs": pa.array(np.concatenate([pairs[queries], np.zeros(len(tied), np.int64)]), mask=none),
            "root": pa.array(np.concatenate([point[queries], point[labels[tied]]])),
        })

    return ready.groupBy("label", "width", "cell", "part").applyInArrow(search, "point long, links long, pairs long, root long")


def audit(
    found: DataFrame, linked: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED, most: int = MOST_AUDITED, measured: int = MEASURED
) -> tuple[float, int]:
    """The share of the pairs of distinct points truly linked that ``linked`` (point, pairs) counts, and how many were seen.

    The points with the smallest hashes are compared with every point, in blocks where these lie: ``audited`` of them, and
    four times as many again while fewer than ``measured`` true pairs are seen, up to ``most``. Copies of a point count
    nothing, neither its own nor those of others. Where no pair is seen, the share is 1 of none: recall is not measured.
    """
    while True:
        rows = found.orderBy(F.xxhash64("point", F.lit(1))).limit(audited).select("label", "vector", "point").collect()
        got, true = _audited(found, linked, rows, threshold)
        if true >= measured or len(rows) < audited or audited >= most:
            break
        audited = min(most, 4 * audited)
    log.info("recall %.4f over %d true pairs of %d points", got / true if true else 1.0, true, len(rows))
    if not true:
        log.warning("recall is not measured: no true pair among %d points", len(rows))
    return (got / true if true else 1.0), true


def _audited(found: DataFrame, linked: DataFrame, rows: list, threshold: float) -> tuple[int, int]:
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.label, len(r.vector)), []).append(r)
    ready = {k: (_unit([r.vector for r in v]), np.array([r.point for r in v])) for k, v in groups.items()}
    shared = found.sparkSession.sparkContext.broadcast(ready)

    def count(batches):
        for batch in batches:
            label, vector, point = batch.columns
            names, widths = pc.dictionary_encode(label), vector.value_lengths().to_numpy(zero_copy_only=False)
            codes, ids, out = names.indices.to_numpy(), point.to_numpy(), []
            for (name, width), (x, asked) in shared.value.items():
                code = names.dictionary.index(pa.scalar(name, names.dictionary.type)).as_py()
                at = np.flatnonzero((codes == code) & (widths == width))
                if len(at):
                    near = _unit(vector.take(pa.array(at))) @ x.T >= threshold
                    near &= ids[at][:, None] != asked
                    out += zip(asked.tolist(), near.sum(axis=0).tolist())
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["point", "true"])

    true = found.select("label", "vector", "point").mapInArrow(count, "point long, true long").groupBy("point").agg(F.sum("true").alias("true"))
    got = true.join(linked.select("point", "pairs"), "point", "left").agg(F.sum(F.least(F.coalesce("pairs", F.lit(0)), F.col("true"))), F.sum("true")).first()
    return got[0] or 0, got[1] or 0


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    margin: float = MARGIN,
    shard: int = SHARD,
    searches: int = SEARCHES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows of one label link if the cosine of their vectors, in double precision, is at least ``threshold``; kept holds
    for the smallest id that links reach. Vectors that are null, zero, or hold null or non-finite components, rows
    without label, and rows without id link with nothing. Vectors of different lengths don't link. Equal vectors are
    searched once; rows with one id count as several. An empty table gives no row; extra columns are ignored.
    """
    found = materialize(points(vectors, id_col, vector_col, label_col), "points")
    for reach in (margin, None):
        linked = materialize(_link(found, threshold, reach, shard, searches), "links")
        counts = linked.where("links is not null").select("point", "links", "pairs")
        if reach is None or audit(found, counts, threshold)[0] >= LEAST_RECALL:
            break
    nodes = connected_components(linked.where("links is null").select("point", "root"))
    named = (
        found.join(counts, "point")
        .join(nodes, F.col("point") == F.col("node"), "left")
        .select("label", "vector", "links", F.coalesce("component", "point").alias("component_id"))
    )
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    joined = rows.join(named, (rows.label == named.label) & (rows.vector == named.vector) & rows.vec_id.isNotNull(), "left")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
