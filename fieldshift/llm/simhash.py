"""Near-duplicate documents by SimHash fingerprints and BK-trees over fingerprint shards.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` or more bit blocks, so each distinct
fingerprint is dealt to one shard per choice of agreeing blocks. A shard's members become a BK-tree (children keyed
by integer Hamming distance to the parent) and every member is searched in it, following only edges whose key lies
within the radius of the distance to the node. Trees are built in the task that holds the shard: broadcasting them
would send something that grows with the corpus to every executor. A shard with more than ``most`` members is dealt
again, by blocks of the bits that its members don't share yet, until none is left; so trees are bounded, each member
stands in a bounded number of them, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import map_documents, materialize, raw_texts

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Members that a shard is planned for, and the most that become one tree.
MEMBERS, MOST_MEMBERS = 1024, 16_384
#: Blocks by which a larger shard is dealt again.
BLOCKS_AGAIN = 6
#: Members of shards that a task gathers before it builds their trees.
HELD = 200_000
#: Node visits that are held at once.
FRONTIER = 1 << 20


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 values; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    n = len(words) - width + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): a row per document; a null or blank text has fingerprint 0."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in raw_texts(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

        return apply

    return map_documents(docs, [id_col, text_col], "doc_id long, fp long", make)


class Forest:
    """BK-trees of many shards at once, in arrays; the first member of each shard is its root."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        n = len(points)
        self.points = points
        keys, group = np.unique(shard, return_inverse=True)
        self.root = np.full(n, -1, np.int64)  # of each point's shard
        parents, marks, nodes = [], [], []
        left, first_level = np.arange(n), True
        while len(left):
            _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
            head = left[first][inverse]
            if first_level:
                self.root[left], first_level = head, False
            rest = head != left
            left, head = left[rest], head[rest]
            distance = np.bitwise_count(points[left] ^ points[head]).astype(np.int64)
            group = head * 128 + distance
            _, child = np.unique(group, return_index=True)
            parents.append(head[child])
            marks.append(distance[child])
            nodes.append(left[child])
        edge = np.concatenate([p * 128 + m for p, m in zip(parents, marks)]) if parents else np.empty(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], np.concatenate(nodes)[order] if nodes else edge

    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of different points within the radius, as arrays of indices, piece by piece."""
        stack = [(queries[i : i + FRONTIER], self.root[queries[i : i + FRONTIER]]) for i in range(0, len(queries), FRONTIER)]
        while stack:
            query, node = stack.pop()
            distance = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
            near = (distance <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edge, node * 128 + np.maximum(distance - radius, 0))
            width = np.searchsorted(self.edge, node * 128 + np.minimum(distance + radius, 127), "right") - low
            ends = np.cumsum(width)
            for at in _cuts(ends, FRONTIER):
                part = slice(*at)
                w = width[part]
                total = int(w.sum())
                if total:
                    offset = np.arange(total) - np.repeat(np.cumsum(w) - w, w)
                    stack.append((np.repeat(query[part], w), self.child[np.repeat(low[part], w) + offset]))


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the points that pairs (a, b) connect a common, lowest label, in place."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


def shard_links(points: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all points which searches within their shard's tree reach; at most one per point."""
    forest, labels = Forest(points, shard), np.arange(len(points))
    for a, b in forest.matches(np.arange(len(points)), radius):
        merge_labels(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(len(points)))
    return points[linked], points[labels[linked]]


def agreeing(bits: list[int], count: int, radius: int) -> list[int]:
    """Masks over ``bits`` in ``count`` blocks, on one of which two fingerprints within the radius agree."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, count)]
    return [sum(choice) for choice in combinations(blocks, count - radius)]


def again(mask: int, radius: int) -> list[int]:
    """Larger masks, on one of which two fingerprints that agree on ``mask`` agree too; none where bits run out."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in agreeing(free, min(len(free), BLOCKS_AGAIN), radius)] if len(free) > radius else []


def block_count(distinct: int, radius: int = RADIUS, members: int = MEMBERS) -> int:
    """Blocks such that evenly spread fingerprints leave at most ``members`` in a shard; any count finds every link."""
    count = radius + 1
    while distinct >> ((count - radius) * (64 // count)) > members and count < 2 * radius + 2:
        count += 1
    return count


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def deal(distinct: DataFrame, radius: int = RADIUS, most: int = MOST_MEMBERS) -> DataFrame:
    """(fp, mask, bits): the shards (mask, bits) of each fingerprint, of two members at least and ``most`` at most."""
    spark = distinct.sparkSession
    masks = agreeing(list(range(64)), block_count(distinct.count(), radius), radius)
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks])
    now = distinct.select("fp", F.explode(keys).alias("s")).select("fp", "s.*")
    parts = []
    while True:
        sizes = materialize(now.groupBy("mask", "bits").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        large = (F.col("size") > most) & (F.bit_count("mask") < 64 - radius)
        parts.append(now.join(sizes.where(~large), ["mask", "bits"]).select("fp", "mask", "bits"))
        hot = sizes.where(large)
        # masks, not shards: their number is bounded by the ways to choose blocks, whatever the corpus
        masks = [r.mask for r in hot.select("mask").distinct().collect()]
        if not masks:
            return reduce(DataFrame.unionByName, parts)
        wider = [(m, _signed(w)) for m in masks for w in again(m % (1 << 64), radius)]
        table = F.broadcast(spark.createDataFrame(wider, "mask long, wider long"))
        members = now.join(hot, ["mask", "bits"]).select("fp", "mask")
        dealt = members.join(table, "mask").select("fp", F.col("wider").alias("mask"), fp.bitwiseAND(F.col("wider")).alias("bits"))
        now = materialize(dealt.distinct(), "again")  # two masks can widen to one


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST_MEMBERS) -> DataFrame:
    """(a, b): links that connect the fingerprints of ``distinct`` (fp long) within ``radius`` bits of each other."""
    shared = deal(distinct, radius, most).select("fp", F.xxhash64("mask", "bits").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def out(rows):
            a, b = shard_links(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def joined():
            return tuple(np.concatenate(x) for x in zip(*held))

        for batch in batches:
            fp, shard = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            held.append((fp.view(np.uint64), shard))
            count += len(fp)
            if count >= HELD:
                rows = joined()
                last = int(np.searchsorted(rows[1], rows[1][-1]))  # where the shard that may go on begins
                held, count = [tuple(x[last:] for x in rows)], len(rows[1]) - last
                if last:
                    yield out(tuple(x[:last] for x in rows))
        if held:
            yield out(joined())

    return shared.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST_MEMBERS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles are 3 words with repeats (fewer words:
    all of them as one; none, or a null text: fingerprint zero, which links like any other). Documents whose
    fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id reachable. Equal
    fingerprints are grouped first, so copies add no search. Repeated ids keep their rows; a null id stays null and
    names no component unless its group has no other id. An empty table gives no row; extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    nodes = connected_components(fingerprint_links(distinct.select("fp"), radius, most))
    grouped = distinct.join(nodes, distinct.fp == nodes.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(grouped.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, once each; a row without an id stays.

    Null and blank texts, whose fingerprint is zero, are grouped like any other; texts of any length are taken whole.
    Among rows with one id the one with the smallest hash stays; equal rows count as one. An empty table gives no row.
    Rows pass as one struct, so that no column's name can clash.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    groups = near_duplicates(docs, id_col, text_col, radius)
    stays = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    stays = materialize(stays, "stays")
    single, several = (stays.where(c).select("id") for c in ("n = 1", "n > 1"))
    # ids grow with the corpus, so they are never broadcast, however few: rows are dealt by id at every size
    kept = rows.join(single.hint("merge"), "id", "left_semi").select("row")
    if not several.isEmpty():
        first = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.unionByName(first.select("row"))
    return kept.unionByName(rows.where("id is null").select("row")).select("row.*")
