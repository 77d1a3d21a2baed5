import numpy as np
import pytest

from fieldshift.llm import embedding_graph as g

SCHEMA = "vec_id long, label int, embedding array<float>, n string"


def slow(rows, threshold):
    usable = {}
    for at, (i, label, x, *_) in enumerate(rows):
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            x = np.array(x, np.float32).astype(float)
            if np.any(x != 0):
                usable[at] = (label, x / np.sqrt(x @ x))
    links = {at: [] for at in range(len(rows))}
    for a, (la, xa) in usable.items():
        for b, (lb, xb) in usable.items():
            if a != b and la == lb and len(xa) == len(xb) and xa @ xb >= threshold:
                links[a].append(b)
    out = []
    for at, (i, *_) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            new = [b for b in links[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        first = None if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(links[at]), first, None if i is None else i == first))
    return sorted(out, key=repr)


def some_rows(n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(40)] + 0.12 * rng.normal(size=dim) if rng.random() < 0.6 else rng.normal(size=dim)
        rows.append((i, int(rng.integers(3)) if i % 3 else 0, x.astype(np.float32).tolist(), "x"))
    rows += [(n + i, 0, rows[0][2], "x") for i in range(60)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + 100 + i, 1, x, "x") for i, x in enumerate(odd)]
    rows += [(None, 1, rows[1][2], "x"), (n + 200, None, rows[1][2], "x"), (5, rows[5][1], rows[5][2], "x")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard": 60, "searches": 25, "margin": 0.3}])
def test_against_all_pairs(spark, settings):
    rows = some_rows()
    got = g.near_duplicates(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    got = sorted([tuple(r) for r in got], key=repr)
    want = slow(rows, g.THRESHOLD)
    if not settings:
        assert got == want
    else:  # overlapping shards: approximate, but never a link that isn't one
        assert len(got) == len(want)
        found, true = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.95 * true <= found <= true


def test_graph_search_reaches_all(spark):
    rng = np.random.default_rng(1)
    x = g._unit((rng.normal(size=(30, 16))[rng.integers(0, 30, 900)] + 0.1 * rng.normal(size=(900, 16))).tolist())
    graph = g.Graph(x, *g.flat_graph(x, leaf=200))
    found = set()
    for a, b in graph.search(np.arange(900), 0.93):
        found |= set(zip(a.tolist(), b.tolist()))
    near = x @ x.T >= 0.93
    true = {(i, j) for i, j in zip(*np.nonzero(near)) if i != j}
    assert found <= true and len(found) >= 0.99 * len(true)


def test_pruning_drops_what_a_kept_neighbour_covers():
    x = g._unit([[1, 0], [1, 0.1], [1, 0.11], [0, 1]])
    kept = g.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]))
    assert kept[0][kept[0] >= 0].tolist() == [1, 3]


def test_audit_sees_missing_links(spark):
    rows = some_rows(200)
    found = g.points(spark.createDataFrame(rows, SCHEMA))
    nothing = found.selectExpr("point", "cast(0 as long) as pairs")
    share, seen = g.audit(found, nothing)
    assert share == 0 and seen > 0


def test_audit_goes_on_until_it_has_seen_enough_links(spark):
    """Two of 3,000 points are linked: a small sample sees no link, a larger one does, and none at all is told."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[1] = x[0] + 0.01 * rng.normal(size=32)
    found = g.points(spark.createDataFrame([(i, 0, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)).cache()
    zero = found.selectExpr("point", "cast(0 as long) as pairs")
    assert g.audit(found, zero, audited=8) == (0.0, 2)
    assert g.audit(found, found.selectExpr("point", "cast(if(point < 2, 1, 0) as long) as pairs"), audited=8) == (1.0, 2)
    assert g.audit(found.where("point > 1"), zero, audited=8, most=64) == (1.0, 0)


def test_empty(spark):
    assert g.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def tight_groups(spread=0.012, dim=32, seed=5):
    """Nine pairs of groups of 100 points with cosines of at least 0.94 across a pair, and 200 points without links."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(9):
        axis, off = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for side in (axis, axis + 0.3 * off):
            out.append(side / np.linalg.norm(side) + spread * rng.normal(size=(100, dim)))
    return np.concatenate([*out, rng.normal(size=(200, dim))])


def test_links_between_tight_groups_are_found(spark):
    x = np.array(tight_groups(), np.float32)
    unit = g._unit(x.tolist())
    near = unit @ unit.T >= g.THRESHOLD
    assert near[0, 100:200].any() and near[:100, 100:200].mean() > 0.5
    rows = [(i, 0, v.tolist(), "x") for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in g.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i][0] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i][1] for i in range(1800)] == [i // 200 * 200 for i in range(1800)]


@pytest.mark.parametrize("leaf", [8192, 100])
def test_search_loses_nothing_in_a_shard(leaf):
    rng = np.random.default_rng(8)
    x = g._unit(np.concatenate([tight_groups(), *[c + s * rng.normal(size=(n, 32)) for c, s, n in zip(rng.normal(size=(60, 32)), rng.uniform(0.01, 0.4, 60), rng.integers(2, 60, 60))]]).tolist())
    x[:7] = x[0]  # equal directions
    near = x @ x.T >= g.THRESHOLD
    np.fill_diagonal(near, False)
    pieces = list(g.Graph(x, *g.flat_graph(x, leaf=leaf)).search(np.arange(len(x)), g.THRESHOLD))
    a, b = (np.concatenate(c) for c in zip(*pieces))
    assert len(a) == near.sum() and near[a, b].all()


def test_failed_audit_deals_anew_and_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(g, "LEAST_RECALL", 1.1)
    rows = some_rows()
    got = g.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=15, margin=0.0).collect()
    assert sorted([tuple(r) for r in got], key=repr) == slow(rows, g.THRESHOLD)


def test_audit_leaves_copies_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, (np.ones(8) + 0.02 * rng.normal(size=8)).tolist(), "x") for i in range(12)]
    rows += [(100 + i, 0, rows[0][2], "x") for i in range(3000)] + [(5000 + i, 1, [1.0, 0.0], "x") for i in range(3000)]
    found = g.points(spark.createDataFrame(rows, SCHEMA)).cache()
    assert g.audit(found, found.selectExpr("point", "cast(0 as long) as pairs")) == (0, 132)
    assert g.audit(found, found.selectExpr("point", "cast(if(point < 6, 11, 0) as long) as pairs")) == (0.5, 132)
    assert g.audit(found, g._link(found, g.THRESHOLD, g.MARGIN, g.SHARD, g.SEARCHES).where("links is not null")) == (1, 132)
