"""Operators against plain sequential versions on planted data, hot spots included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectab.operators import ann, cells, density, hac, labels, search, stats
from vectab.plans.cluster_map import cluster_map
from vectab.plans.graph import connected_components
from vectab.plans.scaling import global_row_number, running


def planted(n, dims=8, groups=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.array([centres[i % groups] + 0.3 * rng.normal(size=dims) for i in range(n)])


def frame(spark, vectors, parts=3):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


def naive_hac(dist):
    clusters, out, levels = [[i] for i in range(len(dist))], [], []
    while len(clusters) > 1:
        levels.append([list(c) for c in clusters])
        best = min(
            ((np.mean([dist[i][j] for i in a for j in b]), x, y)
             for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y))
        _, x, y = best
        merged = clusters[x] + clusters[y]
        clusters = [c for k, c in enumerate(clusters) if k not in (x, y)] + [merged]
        out.append((best[0], len(merged)))
    levels.append(clusters)
    return out, levels[::-1]


def test_hac_equals_sequential(spark):
    v = planted(40)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    want, levels = naive_hac(dist)
    rows, merges = hac.hac(frame(spark, v), "id", "v")
    got = merges.orderBy("rank").collect()
    assert [m.height for m in got] == pytest.approx([h for h, _ in want], abs=1e-9)
    assert [m.size for m in got] == [s for _, s in want]
    order = [r.key for r in hac.leaf_order(rows, merges).orderBy("place").collect()]
    assert order == levels[0][0]
    for k in (1, 4, 13):
        cut = hac.cut_tree(rows, merges, k).collect()
        assert {r.key: r.cluster for r in cut} == {i: c for c, ids in enumerate(levels[k - 1]) for i in ids}

    def spread(ids):
        pairs = [dist[a][b] for x, a in enumerate(ids) for b in ids[x + 1:]]
        return float(np.mean(pairs)) if pairs else 0.0

    curve = {r.k: r.spread for r in stats.spread_by_k(merges, 40).collect()}
    assert curve == pytest.approx({k: sum(map(spread, levels[k - 1])) for k in range(1, 40)}, abs=1e-9)
    peak = max(range(1, 40), key=lambda k: (round(curve[k], 12), -k))
    auto = hac.auto_cluster(frame(spark, v, 5), "id", "v")
    assert auto.select("clusterNumber").distinct().count() == max(1, peak - 1)


def naive_ball(points, eps, min_pts):
    near = lambda p: [j for j, q in enumerate(points) if math.hypot(q[0] - p[0], q[1] - p[1]) < eps]
    seen, label, lists = set(), {}, []
    for i, p in enumerate(points):
        if i in seen:
            continue
        seen.add(i)
        around = near(p)
        if len(around) < min_pts:
            continue
        c = len(lists)
        lists.append([i])
        label[i] = c
        for j in around:
            seen.add(j)
            if label.get(j) != c:
                lists[c].append(j)
                label[j] = c
    return label, lists


def naive_dbscan(points, eps, min_pts):
    near = [[j for j, q in enumerate(points) if math.hypot(q[0] - p[0], q[1] - p[1]) < eps] for p in points]
    core = [len(n) >= min_pts for n in near]
    comp, count = {}, 0
    for i in range(len(points)):
        if core[i] and i not in comp:
            stack = [i]
            comp[i] = count
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and j not in comp:
                        comp[j] = count
                        stack.append(j)
            count += 1
    label = dict(comp)
    for i in range(len(points)):
        if not core[i]:
            reach = [comp[j] for j in near[i] if core[j]]
            if reach:
                label[i] = min(reach)
    return label


def crowded(seed=3):
    """A third of the points at one place, a crowded disc, two strips and scattered points."""
    rng = random.Random(seed)
    pts = [(0.5, 0.5)] * 60
    pts += [(0.2 + rng.gauss(0, 0.02), 0.2 + rng.gauss(0, 0.02)) for _ in range(60)]
    pts += [(0.6 + 0.004 * i, 0.9) for i in range(40)] + [(0.6 + 0.004 * i, 0.853) for i in range(20)]
    pts += [(rng.random(), rng.random()) for _ in range(40)]
    rng.shuffle(pts)
    return pts


def points_frame(spark, pts, parts):
    rows = [(i, x, y) for i, (x, y) in enumerate(pts)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "id long, x double, y double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 6])
def test_density_ball_equals_sequential(spark, parts):
    pts = crowded()
    want, lists = naive_ball(pts, 0.05, 4)
    label, members = density.density_ball(points_frame(spark, pts, parts), "id", "id", 0.05, 4)
    assert {r.id: r.cluster for r in label.collect() if r.cluster is not None} == want
    got = {}
    for r in members.orderBy("cluster", "list_pos").collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert got == dict(enumerate(lists))


@pytest.mark.parametrize("direct", [4096, 4])
def test_dbscan_equals_sequential(spark, monkeypatch, direct):
    # a small bound sends full cells through the finer boxes
    monkeypatch.setattr(density, "DIRECT_PAIRS", direct)
    pts = crowded()
    got = density.dbscan(points_frame(spark, pts, 4), "id", "id", 0.05, 4)
    assert {r.id: r.cluster for r in got.collect() if r.cluster is not None} == naive_dbscan(pts, 0.05, 4)


def test_cell_parts_do_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(density, "PART_ROWS", 7)
    pts = crowded(9)
    label, _ = density.density_ball(points_frame(spark, pts, 4), "id", "id", 0.05, 4)
    assert {r.id: r.cluster for r in label.collect() if r.cluster is not None} == naive_ball(pts, 0.05, 4)[0]


def copies(n, seed):
    """Vectors of which a third are one and the same."""
    v = planted(n, seed=seed)
    v[: n // 3] = v[0]
    return v


def test_joins_with_copies(spark, tmp_path, monkeypatch):
    a, b = copies(60, 2), copies(90, 5)
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    left, right = frame(spark, a), frame(spark, b)
    sims = np.round((a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)), 12)
    want = dict(enumerate(sims.argmax(axis=1).tolist()))
    brute = search.best_match(left, right, "id", "v", block_rows=17)
    assert {r.id: r.hit_key for r in brute.collect()} == want
    index = ann.ann_build(right, "id", "v", n_cells=6)
    assert {r.id: r.hit_key for r in ann.match_ann(left, index, "id", "v").collect()} == want
    path = str(tmp_path / "ix")
    ann.ann_save(index, path)
    for i in (0, 40):
        order = sorted(range(90), key=lambda j: (-sims[i][j], j))[:10]
        got = ann.search_ann(ann.ann_load(spark, path), a[i].tolist(), 10, n_probe=1)
        assert [r.key for r in got.collect()] == order
    graph = search.knn_graph(right, "id", "v", 3, block_rows=20).orderBy("i", "rank").collect()
    same = np.round((b @ b.T) / np.outer(np.linalg.norm(b, axis=1), np.linalg.norm(b, axis=1)), 12)
    want = [(i, j) for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-same[i][j], j))[:3]]
    assert [(r.i, r.j) for r in graph] == want


def test_recall_of_limited_probe(spark):
    v = planted(300, groups=6, seed=4)
    index = ann.ann_build(frame(spark, v), "id", "v", n_cells=12)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for i in range(5):
        best = set(np.argsort(-(u @ u[i]), kind="stable")[:10].tolist())
        hit += len(best & {r.key for r in ann.search_ann(index, v[i].tolist(), 10, 6, exact=False).collect()})
    assert hit / 50 >= 0.9


def test_declutter_equals_sequential(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        x, y = (50.0, 50.0) if i % 3 == 0 else (rng.random() * 300, rng.random() * 200)
        rows.append((i, x, x + 7 * rng.randint(1, 9), y, y + 14))
    shown = []
    for r in rows:
        if not any(r[1] <= s[2] and s[1] <= r[2] and r[3] <= s[4] and s[3] <= r[4] for s in shown):
            shown.append(r)
    df = spark.createDataFrame(rows, "id long, min_x double, max_x double, min_y double, max_y double")
    assert sorted(r.id for r in labels.declutter(df.repartition(5), "id").collect()) == [s[0] for s in shown]


def test_components_of_long_chain(spark):
    nodes = spark.range(64).select(F.col("id").alias("node"))
    pairs = [(i, i + 1) for i in range(63) if i != 20]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u long, v long")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(64)}


def test_order_helpers_with_hot_group(spark):
    rows = [(i, 0 if i % 3 else i % 7, float((i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, v double").repartition(4)
    numbered = global_row_number(df, ["v", "id"], "n").collect()
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert {r.id: r.n for r in numbered} == {r[0]: i for i, r in enumerate(order)}
    low = running(df, ["id"], "v", "min", "low", group=["g"], inclusive=False).collect()
    total = running(df, ["id"], "v", "sum", "total").collect()
    best, want = {}, {}
    for i, g, v in rows:
        want[i] = best.get(g)
        best[g] = min(v, best.get(g, v))
    assert {r.id: r.low for r in low} == want
    sums = np.cumsum([r[2] for r in rows])
    assert [r.total for r in sorted(total, key=lambda r: r.id)] == pytest.approx(sums.tolist())


def test_cluster_map_columns(spark):
    v = planted(30)
    got = cluster_map([frame(spark, v)], "id", "v", eps=0.5)
    assert {"clusterNumber", "coordinates", "dbscanCluster", "center"} <= set(got.columns)
    assert got.count() == 30
    labelled = got.filter("dbscanCluster IS NOT NULL")
    assert labelled.count() > 0 and labelled.filter("center").count() > 0


def test_cluster_map_of_two_tables_with_equal_keys(spark):
    v = planted(24)
    a, b = frame(spark, v[:12]), frame(spark, v[12:])
    got = cluster_map([a, b], "id", "v", eps=0.5, all_lows=True, names=["a", "b"])
    assert got.count() == 24
    assert got.groupBy("table_name").count().orderBy("table_name").collect() == [("a", 12), ("b", 12)]


def test_density_over_given_edges(spark):
    pts = crowded(6)
    close = [(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if math.hypot(q[0] - p[0], q[1] - p[1]) < 0.05]
    edges = spark.createDataFrame(close, "i long, j long")
    items = spark.range(len(pts)).select(F.col("id").alias("pos"))
    label, _ = density.density_ball_edges(items, edges, 4)
    assert {r.pos: r.cluster for r in label.collect() if r.cluster is not None} == naive_ball(pts, 0.05, 4)[0]


def test_metrics(spark):
    v = planted(40, seed=8)
    df = frame(spark, v)
    far = np.linalg.norm(v[:, None] - v[None], axis=2)
    got = search.best_match(df, df, "id", "v", metric="euclidean").collect()
    assert {r.id: r.hit_key for r in got} == {i: i for i in range(40)}
    assert far.shape == (40, 40)
    with pytest.raises(ValueError):
        search.best_match(df, df, "id", "v", metric="manhattan")
    one = df.withColumn("c", F.lit(1))
    sums = v @ v.sum(axis=0) - (v * v).sum(axis=1)
    assert [r.id for r in stats.medoid(one, "id", "v", "c", "dot").filter("central").collect()] == [int(sums.argmax())]


def test_hot_keys_change_nothing(spark, monkeypatch):
    from vectab.operators import spatial
    from vectab.plans import scaling

    monkeypatch.setattr(scaling, "SKEW_BYTES", 0)  # treat every table as large
    monkeypatch.setattr(spatial, "PART_ROWS", 9)
    big = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert scaling.hot_keys(big, ["k"])
    for how in ("inner", "left"):
        got = scaling.salted_join(big, small, ["k"], "id", how).select("id", "k", "v")
        want = big.join(small, "k", how).select("id", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    pts = crowded(12)
    pairs = spatial.eps_join(points_frame(spark, pts, 4), 0.05, "id").collect()
    near = {(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if math.hypot(q[0] - p[0], q[1] - p[1]) < 0.05}
    assert len(pairs) == len(near) and {(r.i, r.j) for r in pairs} == near
    label, _ = density.density_ball(points_frame(spark, pts, 4), "id", "id", 0.05, 4)
    assert {r.id: r.cluster for r in label.collect() if r.cluster is not None} == naive_ball(pts, 0.05, 4)[0]


def test_projection_equals_numpy(spark):
    from vectab.operators.projection import project_2d

    v = planted(50, groups=3, seed=13)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)
    axes = [a if a[np.abs(a).argmax()] > 0 else -a for a in axes[:2]]
    got = {r.id: (r.x, r.y) for r in project_2d(frame(spark, v), "id", "v").collect()}
    for i in range(50):
        assert got[i] == pytest.approx((u[i] @ axes[0], u[i] @ axes[1]), abs=1e-8)
