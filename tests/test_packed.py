"""Packed points: the same rows as a scan, out of few files."""

import random
from pathlib import Path

import pytest

from vectab.operators import packed, spatial


def points(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-1, 1), rng.gauss(0, 1), f"p{i}") for i in range(n)]
    rows += [(n + i, 0.25, 0.25, "same") for i in range(n // 3)]
    rows += [(-1, None, 0.0, "x"), (-2, 0.0, float("nan"), "y")]
    return spark.createDataFrame(rows, "id int, x double, y double, name string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_windows_and_neighbours(spark, tmp_path):
    table = points(spark, 900)
    packed.save_packed(table, "id", str(tmp_path / "p"), file_rows=40)
    plane = packed.open_packed(spark, str(tmp_path / "p"))
    there = table.filter("x IS NOT NULL AND NOT isnan(y)")
    assert plane.nodes.count() >= 20 and rows_of(plane.points.drop("file")) == rows_of(there)
    for window in ((-0.1, -0.1, 0.1, 0.2), (0.25, 0.25, 0.25, 0.25), (-9, -9, 9, 9), (5, 5, 6, 6)):
        assert rows_of(packed.window_packed(plane, *window)) == rows_of(spatial.window_query(there, *window))
    for q, k, most in (((0, 0), 8, None), ((0.25, 0.25), 20, None), ((40, 2), 3, None), ((0.5, 0.5), 30, 0.1), ((0, 0), 5000, None), ((9, 9), 4, 0.5)):
        got = packed.knn_packed(plane, *q, "id", k, most).collect()
        assert got == spatial.knn_2d(there, *q, "id", k, most).select(*there.columns, "d2").collect()


def test_far_files_are_not_read(spark, tmp_path):
    table = points(spark, 900).filter("name <> 'same'")
    packed.save_packed(table, "id", str(tmp_path / "p"), file_rows=30)
    plane = packed.open_packed(spark, str(tmp_path / "p"))
    window = (-0.3, -0.3, 0.0, 0.0)
    want, near = (rows_of(f()) for f in (lambda: packed.window_packed(plane, *window), lambda: packed.knn_packed(plane, 0.4, 0.4, "id", 5)))
    used = set()
    for r in plane.nodes.collect():
        gap = max(r.min_x - 0.4, 0.4 - r.max_x, 0) ** 2 + max(r.min_y - 0.4, 0.4 - r.max_y, 0) ** 2
        if (r.min_x <= 0 and r.max_x >= -0.3 and r.min_y <= 0 and r.max_y >= -0.3) or gap < 0.1:
            used.add(r.file)
    assert len(used) < plane.nodes.count() / 2
    for file in Path(tmp_path / "p" / "data").glob("*/file=*/*.parquet"):
        if int(file.parent.name[5:]) not in used:
            file.write_bytes(b"not a table")  # a scan that opened it would fail
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert rows_of(packed.window_packed(plane, *window)) == want
    assert rows_of(packed.knn_packed(plane, 0.4, 0.4, "id", 5)) == near
    with pytest.raises(Exception):
        plane.points.collect()


def test_nothing_to_pack(spark, tmp_path):
    packed.save_packed(points(spark, 0), "id", str(tmp_path / "p"))
    plane = packed.open_packed(spark, str(tmp_path / "p"))
    assert packed.window_packed(plane, -9, -9, 9, 9).collect() == [] == packed.knn_packed(plane, 0, 0, "id", 3).collect()
    with pytest.raises(ValueError):
        packed.open_packed(spark, str(tmp_path / "none"))
