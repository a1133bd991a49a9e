"""Inputs in many files, crowded and large ones: what each step may hold and ship."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic import dataframe as spark_frame
from pyspark.sql.group import GroupedData

from vectab.checks import QUERIES
from vectab.operators import ann, blocks, hac, search, spatial
from vectab.plans import graph


@pytest.mark.parametrize("name, table", [("stream_embed", "documents"), ("stream_search", "embeddings")])
def test_streams_read_folders_of_parts(spark, sf, tmp_path, name, table):
    """A table may be a folder of part files; beside it lie other tables that are not read."""
    for t in ("documents", "embeddings"):
        rows = spark.read.parquet(f"{sf}/{t}.parquet").limit(40)
        rows.repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    os.mkdir(tmp_path / "one")
    spark.read.parquet(str(tmp_path / f"{table}.parquet")).toPandas().to_parquet(tmp_path / "one" / f"{table}.parquet")
    parts = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert parts and parts == sorted(map(tuple, QUERIES[name](spark, str(tmp_path / "one")).collect()))


@pytest.mark.parametrize("name, table, column", [("stream_embed", "documents", "lang"), ("stream_search", "embeddings", "label")])
def test_streams_read_partitioned_folders(spark, sf, tmp_path, name, table, column):
    """A column may stand in the names of the folders only."""
    rows = spark.read.parquet(f"{sf}/{table}.parquet").limit(40)
    rows.write.partitionBy(column).parquet(str(tmp_path / "k=1" / f"{table}.parquet"))
    os.mkdir(tmp_path / "one")
    rows.toPandas().to_parquet(tmp_path / "one" / f"{table}.parquet")
    parts = sorted(map(tuple, QUERIES[name](spark, str(tmp_path / "k=1")).collect()))
    assert parts and parts == sorted(map(tuple, QUERIES[name](spark, str(tmp_path / "one")).collect()))


def test_greedy_set_of_a_crowd_forms_no_square(spark, tmp_path, monkeypatch):
    """Everyone is close to everyone: one item is kept, and the edges asked for stay in line with the items."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "array(cast(rand(3) / 50 AS float), cast(rand(4) / 50 AS float)) AS embedding", "0 AS label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    asked, join = [], spatial.eps_join
    monkeypatch.setattr(spatial, "eps_join", lambda *a, **k: asked.append(join(*a, **k)) or asked[-1])
    assert [r.vec_id for r in QUERIES["greedy_independent_set"](spark, str(tmp_path)).collect()] == [0]
    assert asked and sum(e.count() for e in asked) < 100 * 3000


@pytest.mark.parametrize("eps", [0.05, 0.3])
def test_greedy_set_edges_on_demand(spark, eps):
    """Given edges, edges on demand and a plain walk agree, with several stretches of the order."""
    rng = np.random.default_rng(5)
    xy = rng.random((300, 2)).tolist()
    kept = []
    for i, p in enumerate(xy):
        if all(np.hypot(p[0] - xy[j][0], p[1] - xy[j][1]) >= eps for j in kept):
            kept.append(i)
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(xy)], "pos long, x double, y double")
    edges = spatial.eps_join(points, eps, "pos").selectExpr("i AS a", "j AS b")
    on_demand = lambda probes, others: spatial.eps_join(probes, eps, "pos", others=others).selectExpr("i AS a", "j AS b")
    monkey = graph.BLOCK_ITEMS
    graph.BLOCK_ITEMS = 50
    try:
        found = [graph.greedy_independent_set(points, edges), graph.greedy_independent_set(points, on_demand),
                 graph.greedy_independent_set(spatial.clique_cells(points, eps), on_demand, ["cx", "cy"])]
        assert [sorted(r.pos for r in f.collect()) for f in found] == [kept] * 3
    finally:
        graph.BLOCK_ITEMS = monkey


def test_blocks_are_copied_as_little_as_cores_allow():
    rows = blocks.BLOCK_ROWS
    assert blocks.plan_blocks(615_000, 615_000, rows, 12) == (7, 7)
    left, right = blocks.plan_blocks(40, 615_000, rows, 12)
    assert left == 1 and 7 <= right <= 12  # the large side is not copied for a few that ask
    assert blocks.plan_blocks(0, 0, rows, 12) == (1, 1)


def test_many_hits_leave_tile_by_tile(spark, monkeypatch):
    v = np.random.default_rng(2).normal(size=(120, 4))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    monkeypatch.setattr(blocks, "HIT_TILE", 500)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = search.pair_distances(rows, "id", "v", 2.0).collect()
    assert len(got) == 120 * 119 // 2 and all(abs(r.dist - (1 - u[r.i] @ u[r.j])) < 1e-9 for r in got)
    # what a task gives for a block pair comes in pieces of a tile at most
    seen = {}
    monkeypatch.setattr(spark_frame.DataFrame, "groupBy", lambda f, *k: seen.setdefault("g", type("G", (), {"applyInArrow": lambda s, run, out: seen.setdefault("run", run)})()))
    left, right = (blocks.keyed_vectors(rows, "id", "v", s) for s in "lr")
    run = blocks.threshold_join(left, right, -1.0, sizes=(120, 120))
    columns = {"is_left": [True] * 120 + [False] * 120, "l_key": [*range(120)] + [None] * 120, "l_vec": v.tolist() + [None] * 120,
               "r_key": [None] * 120 + [*range(120)], "r_vec": [None] * 120 + v.tolist()}
    sizes = [b.num_rows for b in run(iter(pa.table(columns).to_batches()))]
    assert sum(sizes) == 120 * 120 and max(sizes) <= 500


def test_best_one_is_best_k_with_rivals():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 4, (50, 9)) / 3 + rng.normal(size=(50, 9)) * 1e-14
    s[3], s[4, 2], s[5, :] = -np.inf, np.nan, 0.5
    for got, want in zip(blocks.best_one(s), blocks.best_k(np.round(s, 12), 1)):
        assert got.tolist() == want.tolist()


def test_best_few_is_best_k_with_rivals(monkeypatch):
    """Also with ties, odd scores and sizes; of usual scores none but the close ones are rounded and ranked."""
    rng, best_k = np.random.default_rng(4), blocks.best_k
    for n, k in [(5, 3), (64, 2), (900, 3), (1500, 5), (1537, 2), (4001, 3)]:
        s = np.where(rng.random((40, n)) < 0.5, rng.integers(0, 9, (40, n)) / 9, rng.random((40, n))) + rng.normal(size=(40, n)) * 1e-13
        s[3], s[4, 2], s[5], s[6, 1:], s[7, 0], s[8, 1] = -np.inf, np.nan, 0.5, -np.inf, np.inf, 1e305
        s[9], s[10], s[11, :3] = s[9] * 1e9, -s[10], -np.inf
        s[12], s[12, [0, n // 2, n - 1]] = np.round(s[12] / 2, 2), 0.75 + np.array([-2, 0, 2]) * 1e-13
        with np.errstate(over="ignore"):
            want = best_k(np.round(s, 12), k)
            for got, right in zip(blocks.best_few(s, k), want):
                assert got.tolist() == right.tolist()
    seen = []
    monkeypatch.setattr(blocks, "best_k", lambda s, k: seen.append(s) or best_k(s, k))
    run, _ = blocks.kernel(T.LongType(), T.LongType(), lambda s: blocks.best_few(s, 3), "cosine", False, rounded=False)
    left, right = (pa.table({f"{x}_key": range(1000), f"{x}_vec": list(rng.normal(size=(1000, 8)))}) for x in "lr")
    assert len(run(left, right)) == 3000 and not seen


def test_tree_is_the_same_wherever_its_end_is_made(spark, monkeypatch):
    rows = [(i, x) for i, x in enumerate(np.random.default_rng(6).normal(size=(60, 5)).tolist())]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    jobs, cut = [], hac.cut_lineage
    monkeypatch.setattr(hac, "cut_lineage", lambda df: jobs.append(1) or cut(df))
    whole = sorted(map(tuple, hac.hac(table, "id", "v")[1].selectExpr("rank", "node", "left", "right", "round(height, 9)", "size", "round(spread, 9)").collect()))
    assert len(jobs) < 6  # the last clusters cost no jobs
    monkeypatch.setattr(hac, "FINISH", 20)
    parts = sorted(map(tuple, hac.hac(table, "id", "v")[1].selectExpr("rank", "node", "left", "right", "round(height, 9)", "size", "round(spread, 9)").collect()))
    assert whole == parts and len(whole) == 59


def test_limited_matching_shuffles_no_pair_with_a_vector(spark):
    """Visits carry codes only, and short lists meet a small indexed side by broadcast."""
    v = np.random.default_rng(8).normal(size=(80, 6)).tolist()
    table = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    index = ann.ann_build(table, "id", "v", n_cells=6)
    rows = table.selectExpr("id AS l_key", "v AS l_vec", "1 AS more")
    assert set(ann.nearest_cells(index, rows, 2, with_vector=False).columns) == {"l_key", "more", "parent", "cell", "away"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ann.match_ann(table, index, "id", "v", n_probe=3)
        assert all(r.id == r.hit_key for r in found.collect())
        assert "BroadcastHashJoin [r_key" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_matching_sends_a_row_to_a_block_once(spark, tmp_path, monkeypatch):
    """Not to each cell that may win. Cutting the index into blocks, and crowded cells into parts, changes no match."""
    rng = np.random.default_rng(9)
    v, asked = rng.normal(size=(300, 6)), rng.normal(size=(500, 6))
    v[40:120] = v[40]  # a crowd of copies: the smallest key wins
    asked[:50] = v[40]
    rows = lambda x: spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(enumerate(np.round(unit(asked) @ unit(v).T, 12).argmax(axis=1).tolist()))
    sent, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda a, b: (sent.append(a._df) if "l_vec" in a._df.columns else None) or cogroup(a, b))
    index = ann.ann_build(rows(v), "id", "v")
    found = lambda: {r.id: r.hit_key for r in ann.match_ann(rows(asked), index, "id", "v").collect()}
    assert found() == want and sum(f.count() for f in sent) == len(asked)
    sent.clear()
    monkeypatch.setattr(ann, "BLOCK_VALUES", 6 * 50)
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    assert found() == want
    blocks = sum(f.select("block").distinct().count() for f in sent[:1])
    pairs = sum(f.count() for f in sent)
    assert len(sent) == 2 and blocks >= 4 and pairs == sent[0].union(sent[1]).select("l_key", "block").distinct().count()
    # the rows of whole blocks are gone, then all rows
    near = index.entries.filter(F.col("parent") == index.entries.first()["parent"]).select("key").toPandas()["key"].tolist()
    path = str(tmp_path / "ix")
    ann.ann_open(rows(v), "id", "v", path)
    index = ann.ann_open(rows(v).filter(~F.col("id").isin(near)), "id", "v", path)
    scores = np.round(unit(asked) @ unit(v).T, 12)
    scores[:, near] = -2
    assert found() == dict(enumerate(scores.argmax(axis=1).tolist()))
    ann.ann_open(rows(v).limit(0), "id", "v", path)
    ann.ann_compact(spark, path)
    index = ann.ann_load(spark, path)
    assert found() == {}


def test_pairs_of_a_table_are_scored_once(spark, monkeypatch):
    """Whatever the blocks, keys and bound: each pair once, smaller key first; a row is copied once for each block."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(90, 4))
    v[7], v[8] = v[6], 0
    names = [f"k{i * 37 % 90:02d}" for i in range(90)]
    rows = spark.createDataFrame(list(zip(names, v.tolist())) + [("gone", None), (None, v[0].tolist())], "id string, v array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    score = np.round(u @ u.T, 12)
    used = [i for i in range(90) if i != 8]
    monkeypatch.setattr(blocks, "HIT_TILE", 300)
    monkeypatch.setattr(blocks, "SLICE", 20)
    for bound, block_rows in [(2.0, 30), (2.0, 1000), (0.4, 30)]:
        want = sorted((*sorted((names[i], names[j])), round(1 - score[i, j], 9)) for i in used for j in used if i < j and score[i, j] >= 1 - bound)
        got = sorted((r.i, r.j, round(r.dist, 9)) for r in search.pair_distances(rows, "id", "v", bound, block_rows).collect())
        assert got == want
    assert [blocks.plan_triangle(r, 98304, 12) for r in (0, 500, 10_000, 615_000)] == [1, 1, 5, 7]


def test_pair_distances_query_gives_every_pair(spark, sf):
    from __spark_entry__ import oracle_sql, queries
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert queries()["pair_distances"](spark, sf).count() == rows * (rows - 1) // 2
    assert ">=" not in oracle_sql()["pair_distances"]


def test_nearest_is_best_k_of_rounded_scores(monkeypatch):
    """Whatever the tiles: with ties, copies, zero vectors and columns not to be taken, for the rows of one side and of both."""
    rng = np.random.default_rng(15)
    monkeypatch.setattr(blocks, "SLAB", 16)
    monkeypatch.setattr(blocks, "STRIP", 24)
    for m, n, d in [(40, 150, 5), (1, 30, 3), (50, 1, 2), (33, 100, 64)]:
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) * rng.random((len(v), 1)) for v in (rng.normal(size=(m, d)), rng.normal(size=(n, d))))
        if n > 90:
            b[5], b[80:90], a[3], a[7] = 0, b[20], b[20], 0
            b[40:60] = b[39] + rng.normal(size=(20, d)) * 1e-14  # rivals closer than a rounded digit
            b[60:70] = b[39] + rng.normal(size=(10, d)) * 1e-9  # and closer than float32 can tell
            a[8] = b[39]
        scores = np.round(a @ b.T, 12)
        at, best, up, best_up = blocks.nearest(a, b, both=True)
        assert at.tolist() == scores.argmax(axis=1).tolist() and up.tolist() == scores.argmax(axis=0).tolist()
        assert (best == scores.max(axis=1)).all() and (best_up == scores.max(axis=0)).all()
        same, off = rng.integers(-1, n, m), np.unique(rng.integers(0, n, n // 4))
        scores[np.flatnonzero(same >= 0), same[same >= 0]] = -np.inf
        scores[:, off] = -np.inf
        want = np.where(np.isfinite(scores.max(axis=1)), scores.argmax(axis=1), -1)
        assert blocks.nearest(a, b, same, off)[0].tolist() == want.tolist()


def test_tree_is_the_same_with_many_blocks_and_copies(spark, monkeypatch):
    v = np.random.default_rng(16).normal(size=(150, 4))
    v[20:40], v[41] = v[19], -v[19]
    table = spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>")
    tree = lambda: sorted(map(tuple, hac.hac(table, "id", "v")[1].selectExpr(
        "rank", "node", "left", "right", "round(height, 9)", "size", "round(spread, 9)").collect()))
    whole, met = tree(), []
    monkeypatch.setattr(blocks, "TASK_PAIRS", 300)
    monkeypatch.setattr(hac, "FINISH", 100 * 100 * 4)
    meet = blocks._meet_itself
    monkeypatch.setattr(blocks, "_meet_itself", lambda *x: met.append(meet(*x)) or met[-1])
    assert tree() == whole and len(whole) == 149
    # two blocks meet once, whichever side asks
    assert met[0].select("l_block", "r_block").distinct().count() == 10 and met[0].count() == 4 * 150


def test_tree_of_thousands_of_rows_has_few_jobs(spark, monkeypatch):
    """A round is worth jobs by its multiplications, not by its clusters."""
    jobs, cut = [], hac.cut_lineage
    monkeypatch.setattr(hac, "cut_lineage", lambda df: jobs.append(1) or cut(df))
    rows = list(enumerate(np.random.default_rng(17).normal(size=(6000, 3)).tolist()))
    merges = hac.hac(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")[1]
    assert merges.count() == 5999 and len(jobs) < 6
