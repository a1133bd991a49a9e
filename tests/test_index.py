"""The saved cell index through changes of its table, its placing and limited matching, and stored codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectab.operators import ann, cells, codes, search, stats
from vectab.sources.segments import SegmentLog


def planted(n, groups, dims, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")


def live(index):
    return sorted(((r.key, round(r.u[0], 9)) for r in index.entries.collect()), key=str)


def wanted(table):
    rows = table.filter("v IS NOT NULL").collect()
    return sorted(((r.id, round(r.v[0] / float(np.linalg.norm(r.v)), 9)) for r in rows if any(r.v)), key=str)


def exact(table, q, k=10):
    rows = [(r.id, np.array(r.v)) for r in table.collect() if r.v is not None and any(r.v)]
    sims = [(-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), i) for i, v in rows]
    return [i for _, i in sorted(sims)[:k]]


def test_index_follows_its_table(spark, tmp_path, monkeypatch):
    path, v = str(tmp_path / "ix"), planted(240, 6, 8, 1)
    old = frame(spark, v[:200]).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8)], "id int, v array<double>"))
    log = SegmentLog(spark, path)
    index = ann.ann_open(old, "id", "v", path, n_cells=12)
    assert live(index) == wanted(old) and log.versions() == [1]
    ann.ann_open(old.repartition(3), "id", "v", path)
    assert log.versions() == [1]  # the same rows in another order
    changed = F.transform("v", lambda x: -x)
    new = (
        frame(spark, v).filter("id % 7 <> 3").withColumn("v", F.when(F.col("id") % 5 == 0, changed).otherwise(F.col("v")))
        .unionByName(spark.createDataFrame([(None, [1.0] * 8), (500, [2.0] * 8), (500, [2.0] * 8)], "id int, v array<double>"))
    )
    index = ann.ann_open(new, "id", "v", path)
    assert live(index) == wanted(new) and log.versions() == [1, 2]
    assert len(index.state["segments"]) == 2 and len(index.state["removed"]) == 1
    assert live(ann.ann_load(spark, path, 1)) == wanted(old)  # older readers are not disturbed
    for q in (v[0], v[230], -v[10]):
        assert [r.key for r in ann.search_ann(index, q.tolist(), 10, 1).collect()] == exact(new.filter("id IS NOT NULL"), q)
    hits = ann.match_ann(frame(spark, v[:40], 1000), index, "id", "v").collect()
    assert {r.id: r.hit_key for r in hits} == {1000 + i: exact(new.filter("id IS NOT NULL"), v[i], 1)[0] for i in range(40)}
    # one copy less of a repeated row, and back to the old vectors
    for table in (new.filter("id <> 500").unionByName(spark.createDataFrame([(500, [2.0] * 8)], "id int, v array<double>")), old, new, old):
        index = ann.ann_open(table, "id", "v", path)
        assert live(index) == wanted(table)
    assert any(not SegmentLog(spark, path).read(n)["removed"] for n in log.versions()[2:])  # merged on the way
    before = log.versions()[-1]
    ann.ann_compact(spark, path)
    index = ann.ann_load(spark, path)
    assert len(index.state["segments"]) == 1 and live(index) == wanted(old)
    assert log.vacuum(keep=2) and live(ann.ann_load(spark, path, before)) == wanted(old)
    log.vacuum()
    assert live(ann.ann_load(spark, path)) == wanted(old) and not log.vacuum()


def test_a_dead_save_leaves_the_version_before(spark, tmp_path):
    path, v = str(tmp_path / "ix"), planted(90, 4, 6, 2)
    old, new = frame(spark, v[:80]), frame(spark, v)
    ann.ann_open(old, "id", "v", path)
    log = SegmentLog(spark, path)
    log.write(new)  # a folder that no version names, and a version without its mark
    (tmp_path / "ix" / "log" / "v00000002").mkdir()
    (tmp_path / "ix" / "log" / "v00000002" / "part-0.parquet").write_bytes(b"half")
    assert live(ann.ann_load(spark, path)) == wanted(old)
    assert live(ann.ann_open(new, "id", "v", path)) == wanted(new) and log.versions() == [1, 3]
    with pytest.raises(ValueError, match="no index"):
        ann.ann_load(spark, str(tmp_path / "none"))


def test_source_name_saves_the_look_at_the_table(spark, tmp_path):
    path, v = str(tmp_path / "ix"), planted(60, 3, 5, 3)
    ann.ann_open(frame(spark, v), "id", "v", path, source="docs/v1")
    gone = spark.createDataFrame([], "id int, v array<double>")
    assert live(ann.ann_open(gone, "id", "v", path, source="docs/v1")) == wanted(frame(spark, v))
    assert live(ann.ann_open(gone, "id", "v", path, source="docs/v2")) == []
    grown = frame(spark, planted(400, 3, 5, 4))
    index = ann.ann_open(grown, "id", "v", path)  # grown too far: new centres
    assert index.state["fit_rows"] == 400 and live(index) == wanted(grown)
    wider = frame(spark, planted(20, 3, 7, 5))
    assert live(ann.ann_open(wider, "id", "v", path)) == wanted(wider)


def test_rows_lie_where_the_centres_say(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 9)
    v = planted(200, 5, 6, 6)
    v[:70] = v[0]  # a third of the rows are copies
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    coarse, fine = u[100:104], u[110:140]
    rows = [(i % 4, 10 * i, c.tolist()) for i, c in enumerate(fine)]
    centres = cells.Centres(coarse, spark.createDataFrame(rows, "parent int, cell int, centre array<double>"))
    index = ann.ann_build(frame(spark, v), "id", "v", centres=centres)
    place = {}
    for i, x in enumerate(u):
        parent = int((coarse @ x).argmax())
        own = [(-(c @ x), 10 * j) for j, c in enumerate(fine) if j % 4 == parent]
        place[i] = (parent, min(own)[1], float(np.arccos(np.clip(-min(own)[0], -1, 1))))
    assert {r.key: (r.parent, r.cell) for r in index.entries.collect()} == {i: p[:2] for i, p in place.items()}
    for r in index.cells.collect():
        members = [p for p in place.values() if p[1] == r.cell]
        assert r.n == len(members) and abs(r.reach - cells.SLACK - max(p[2] for p in members)) < 1e-7
    for i in (0, 150):
        assert [r.key for r in ann.search_ann(index, v[i].tolist(), 10, 1).collect()] == exact(frame(spark, v), v[i])


def test_fit_is_the_same_for_any_partitioning(spark):
    table = frame(spark, planted(300, 5, 6, 7))
    one, two = (ann.ann_build(t, "id", "v", n_cells=20) for t in (table.coalesce(1), table.repartition(9)))
    assert np.allclose(one.centres.coarse, two.centres.coarse)
    assert sorted(map(tuple, one.cells.select("cell", "n").collect())) == sorted(map(tuple, two.cells.select("cell", "n").collect()))
    assert 12 <= one.cells.count() <= 25


@pytest.mark.parametrize("dims,groups,spread", [(64, 40, 0.3), (16, 1, 1.0)])
def test_recall_of_limited_matching(spark, dims, groups, spread):
    v = planted(3000, groups, dims, 8, spread)
    index = ann.ann_build(frame(spark, v[:2700]), "id", "v")
    asked = v[2700:] if groups > 1 else v[:300] + 0.1 * v[300:600]
    u, a = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v[:2700], asked))
    best = dict(enumerate(np.round(a @ u.T, 12).argmax(axis=1).tolist()))
    hits = {r.id: r for r in ann.match_ann(frame(spark, asked), index, "id", "v", n_probe=8).collect()}
    assert len(hits) == 300
    assert sum(hits[i].hit_key == j for i, j in best.items()) / 300 >= 0.9
    assert all(abs(hits[i]._raw - a[i] @ u[hits[i].hit_key]) < 1e-9 for i in hits)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_stored_codes_find_what_the_scan_finds(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(codes, "FOLDER_ROWS", 100)
    v = planted(800, 12, 21, 9, spread)
    table = frame(spark, v).unionByName(frame(spark, v[:5])).unionByName(
        spark.createDataFrame([(2000, None), (2001, [1.0])], "id int, v array<double>"))
    mean, std = stats.sbq_fit(table.filter("size(v) = 21"), "v")
    codes.save_codes(table, "id", "v", mean, std, str(tmp_path / "codes"))
    index = codes.load_codes(spark, str(tmp_path / "codes"))
    assert index.head_bits == 4
    for q in (v[0], v[77], -v[5], np.zeros(21)):
        for k in (1, 10, 900):
            scan = search.search_sbq(table, q.tolist(), "id", "v", mean, std, k).select("id", "score").collect()
            got = codes.search_codes(index, q.tolist(), k).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in scan]
    with pytest.raises(ValueError):
        codes.search_codes(index, [1.0])
