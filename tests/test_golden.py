"""Small cases with answers worked out by hand."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vectab.functions import geo, quant, text, vector
from vectab.operators import ann, density, embed, hac, labels, search, spatial, stats, table
from vectab.plans.graph import greedy_independent_set
from vectab.sources import files, store


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_topk_ties(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7), ("d", 0.5)], "key string, score double")
    df = df.withColumn("g", F.lit(1))
    top = lambda k: [r[0] for r in values(search.topk_per_group(df, "g", "score", "key", k).orderBy("rank"), "key")]
    assert top(2) == ["b", "c"]
    assert top(3) == ["b", "c", "a"]


def test_rank_after_rounding(spark):
    angle = lambda c: [c, math.sqrt(1 - c * c)]
    df = spark.createDataFrame([("a", angle(0.8712)), ("b", angle(0.8749))], "key string, v array<double>")
    assert values(search.search_exact(df, [1.0, 0.0], "key", "v", 1), "key", "score") == [("a", 0.87)]
    assert values(search.search_exact(df, [1.0, 0.0], "key", "v", 1, rank_on="raw"), "key") == [("b",)]


def test_search_skips_unfit_rows(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "key int, v array<double>")
    assert values(search.search_exact(df, [1.0, 0.0], "key", "v"), "key") == [(1,)]


@pytest.mark.parametrize("given,want", [(0.8765, 0.88), (0.0123, 0.012), (-0.5, -0.5), (0.0, 0.0)])
def test_round_sig2(spark, given, want):
    assert spark.range(1).select(vector.round_sig2(F.lit(given)).alias("r")).first().r == pytest.approx(want)


def test_keyed_writes(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    batch = spark.createDataFrame([(2, "p", 0), (3, "q", 1), (3, "r", 2)], "k int, v string, pos int")
    assert dict(values(store.upsert(target, batch, "k", ["pos"]), "k", "v")) == {1: "x", 2: "p", 3: "r"}
    assert dict(values(store.insert_new(target, batch, "k", ["pos"]), "k", "v")) == {1: "x", 2: "y", 3: "r"}
    with pytest.raises(ValueError):
        store.append_strict(target, batch.drop("pos"), "k")
    skip = spark.createDataFrame([(2,)], "k int")
    assert dict(values(store.upsert(target, batch, "k", ["pos"], skip), "k", "v")) == {1: "x", 2: "y", 3: "r"}


def test_store_versions(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    db.write("t", spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "k")
    batch = spark.createDataFrame([(2, "p"), (3, "q")], "k int, v string")
    once = sorted(values(db.upsert("t", batch, ["v"]), "k", "v"))
    assert once == sorted(values(db.upsert("t", batch, ["v"]), "k", "v")) == [(1, "x"), (2, "p"), (3, "q")]
    assert db.key("t") == "k" and db.names() == ["t"]
    assert values(db.catalog(), "table_name", "key_column", "n_rows") == [("t", "k", 3)]
    with pytest.raises(ValueError):
        db.append_strict("t", batch)
    assert db.read("t").count() == 3


def test_composed_text(spark):
    df = spark.createDataFrame([("1", "z"), ("1", None)], "a string, b string")
    assert [r.t for r in df.select(text.compose_text(["b", "a"]).alias("t")).collect()] == ["z 1 ", "undefined 1 "]


def four_rows(spark):
    edges = [(0, 1, 0.1), (2, 3, 0.2), (0, 2, 0.9), (0, 3, 0.8), (1, 2, 0.7), (1, 3, 0.6)]
    return spark.createDataFrame(edges, "a long, b long, dist double")


def test_hac_on_edges(spark):
    merges = hac.hac_edges(four_rows(spark), 4)
    got = [(r.left, r.right, round(r.height, 9), r.size) for r in merges.orderBy("rank").collect()]
    assert got == [(0, 1, 0.1, 2), (2, 3, 0.2, 2), (4, 5, 0.75, 4)]
    rows = spark.range(4).select(F.col("id").alias("idx"), F.col("id").alias("key"))
    cut = dict(values(hac.cut_tree(rows, merges, 3), "key", "cluster"))
    assert cut == {0: 2, 1: 2, 2: 0, 3: 1}
    noise = stats.singletons_to_noise(hac.cut_tree(rows, merges, 3), "key", "cluster")
    assert dict(values(noise, "key", "cluster")) == {0: 2, 1: 2, 2: -1, 3: -1}
    assert [r.cluster for r in hac.cut_tree(rows, merges, 0).collect()] == [None] * 4
    assert [r.key for r in hac.leaf_order(rows, merges).orderBy("place").collect()] == [0, 1, 2, 3]
    single = hac.hac_edges(four_rows(spark), 4, "single").orderBy("rank").collect()
    assert round(single[-1].height, 9) == 0.6
    assert round(hac.hac_edges(four_rows(spark), 4, "complete").orderBy("rank").collect()[-1].height, 9) == 0.9


def test_k_from_curve(spark):
    curve = spark.createDataFrame([(1, 0.55), (2, 0.3), (3, 0.1)], "k long, spread double")
    assert stats.pick_k_peak(curve).first().k == 1
    assert stats.pick_k_peak(curve, compat=True).first().k == 0
    elbow = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 2.0), (4, 1.0), (5, 0.5)], "k long, spread double")
    assert stats.pick_k_elbow(elbow).first().k == 3


def chain(spark):
    return spark.createDataFrame([(i, i * 0.2, 0.0) for i in range(5)], "id long, x double, y double")


def test_density_chain(spark):
    label, members = density.density_ball(chain(spark), "id", "id", 0.3, 3)
    assert [r.cluster for r in label.orderBy("id").collect()] == [0, 0, 1, 1, 1]
    lists = {c: [r.id for r in members.filter(f"cluster = {c}").orderBy("list_pos").collect()] for c in (0, 1)}
    assert lists == {0: [1, 0, 2], 1: [3, 2, 4]}
    means = dict(values(stats.centroids(members), "cluster", "cx"))
    assert means == pytest.approx({0: 0.2, 1: 0.6})
    whole = density.dbscan(chain(spark), "id", "id", 0.3, 3)
    assert [r.cluster for r in whole.orderBy("id").collect()] == [0] * 5


def test_record_lows(spark):
    # centroid of these members is (0, 0); distances in list order are 5, 3, 4, 1 plus balancing rows
    pts = [(5.0, 0.0), (0.0, 3.0), (-4.0, 0.0), (0.0, -1.0), (-1.0, -2.0)]
    rows = [(i + 1, i, x, y, 0) for i, (x, y) in enumerate(pts)]
    members = spark.createDataFrame(rows, "id int, pos int, x double, y double, cluster int")
    lows = stats.record_lows(members, "id", "pos")
    assert sorted(r.id for r in lows.filter("center").collect()) == [1, 2, 4]
    near = stats.nearest_to_centroid(members, "id", "pos")
    assert [r.id for r in near.filter("center").collect()] == [4]


def test_quantisation(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [0.0]), (4, [4.0])], "k int, v array<double>")
    mean, std = stats.sbq_fit(df, "v")
    assert mean == [1.0] and std[0] == pytest.approx(math.sqrt(3))
    codes = [r.c for r in df.orderBy("k").select(quant.sbq_code("v", mean, std).alias("c")).collect()]
    assert codes == [[0], [0], [0], [3]]
    row = spark.createDataFrame([([3, 1, 0, 3, 1], [0, 1, 0, 0, 1])], "a array<int>, b array<int>")
    packed = row.select(
        quant.sbq_bytes("a", 5).alias("p"),
        quant.hamming(quant.sbq_words("a", 5), quant.sbq_words("b", 5)).alias("h")).first()
    assert packed.p == "D340" and packed.h == 4
    flat = spark.createDataFrame([([2.0],), ([2.0],)], "v array<double>")
    assert [r.c for r in flat.select(quant.sbq_code("v", *stats.sbq_fit(flat, "v")).alias("c")).collect()] == [[0], [0]]


def test_declutter_and_overlap(spark):
    cols = "id long, min_x double, max_x double, min_y double, max_y double"
    boxes = [(0, 0.0, 10.0, 0.0, 1.0), (1, 5.0, 15.0, 0.0, 1.0), (2, 12.0, 20.0, 0.0, 1.0)]
    df = spark.createDataFrame(boxes, cols)
    assert sorted(r.id for r in labels.declutter(df, "id").collect()) == [0, 2]
    touch = spark.createDataFrame([(0, 0.0, 10.0, 0.0, 1.0), (1, 10.0, 20.0, 0.0, 1.0)], cols)
    assert [r.id for r in labels.declutter(touch, "id").collect()] == [0]
    assert spatial.overlap_join(touch, "id", 5).count() == 1
    assert spatial.overlap_join(touch, "id", 5, strict=True).count() == 0


def test_colour_rules(spark):
    rules = [text.Rule("lang", "/^D/i", "red"), text.Rule("lang", "e", "blue"), text.Rule("lang", "/(/", "bad")]
    df = spark.createDataFrame([("de",), ("DK",), ("fr",), (None,)], "lang string")
    assert [r.t for r in df.select(text.rule_tags(rules).alias("t")).collect()] == ["blue", "red", "#a9a9a9", "#a9a9a9"]
    assert df.filter(text.matches("lang", ".", literal=True)).count() == 0


def test_gaussian_border(spark):
    grid = spark.createDataFrame([(0, 0, 1)], "gx long, gy long, n long")
    total = sum(math.exp(-(x * x + y * y) / 8) for x in range(-6, 7) for y in range(-6, 7))
    assert spatial.density_blur(grid, 2, 1, 1).first().value == pytest.approx(1 / total)


def test_csv_rows_and_errors(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,txt\n1,"a,b ""q"""\n , \n\n2,x\n3\n4,y,z\n')
    rows = files.read_csv(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.txt) for r in rows] == [("1", 'a,b "q"'), ("2", "x"), ("3", None), ("4", "y")]
    errors = files.csv_errors(spark, str(path)).orderBy("raw").collect()
    assert [(e.kind, e.expected, e.parsed) for e in errors] == [("TooFewFields", 2, 1), ("TooManyFields", 2, 3)]
    assert files.csv_report(spark, str(path)).first() == Row(n_rows=4, n_errors=2)


def test_delimiter_guess(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a;b;c\n1,5;2;3\n4;5,5;6\n")
    assert files.guess_delimiter(spark, str(path)) == ";"
    assert files.read_csv(spark, str(path)).columns == ["a", "b", "c"]


def test_json_array_and_lines(spark, tmp_path):
    import gzip
    import json

    rows = [{"id": 1, "embeddings": {"m": [0.5, 1.5]}}, {"id": 2, "embeddings": {"m": [1.0, 2.0]}}]
    for name in ("cats.v1.json.gz", "dogs.json.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            json.dump(rows, f)
    df = files.read_json_array(spark, str(tmp_path / "*.json.gz"))
    assert df.schema["embeddings"].dataType.simpleString() == "map<string,array<float>>"
    assert sorted(values(df, "table_name", "id")) == [("cats", 1), ("cats", 2), ("dogs", 1), ("dogs", 2)]


def test_csv_sink_drops_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, {"m": [1.0]}, [1.0, 2.0])], "id int, embeddings map<string,array<float>>, coordinates array<double>")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert back.columns == ["id", "coordinates"] and back.first().coordinates == "[1.0,2.0]"


def test_pair(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 9), (2, [2.0, 1.0], 9), (3, None, 9)], "k int, v array<double>, score int")
    row = search.compare_pair(df, "k", "v", [1, 2]).first()
    assert (row.score, row.k, row.k2) == (0.8, 1, 2)
    for selected in ([1], [1, 2, 3], [1, 3]):
        assert search.compare_pair(df, "k", "v", selected).count() == 0


def test_best_match_tie(spark, tmp_path):
    a = spark.createDataFrame([("a", [1.0, 0.0]), ("x", None)], "key string, v array<double>")
    b = spark.createDataFrame([("p", [1.0, 1.0]), ("q", [2.0, 2.0]), ("r", [0.0, 1.0])], "id string, v array<double>")
    assert values(search.compare(a, b, "key", "v", "id"), "key", "score", "bestMatch-id") == [("a", 0.707, "p")]
    got = ann.compare_ann(a, b, "key", "v", "id", str(tmp_path / "index"))
    assert values(got, "key", "score", "bestMatch-id") == [("a", 0.707, "p")]
    assert ann.compare_ann(a.limit(0), b, "key", "v", "id", str(tmp_path / "none")).count() == 0


def test_medoid(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    df = spark.createDataFrame([(0, at(0), 1), (1, at(10), 1), (2, at(90), 1)], "k int, v array<double>, c int")
    assert values(stats.medoid(df, "k", "v", "c").filter("central"), "k") == [(1,)]


def test_euclid(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([0.0, 0.0, 9.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(vector.euclidean_distance("a", "b").alias("d"), vector.euclidean_similarity("a", "b").alias("s")).collect()
    assert [r.d for r in got] == [5.0, 5.0] and got[0].s == pytest.approx(1 / 6)


def test_hilbert_corners(spark):
    top = geo.HILBERT_MAX
    df = spark.createDataFrame([(0, 0), (0, top), (top, top), (top, 0)], "x int, y int")
    assert [r.h for r in df.select(geo.hilbert("x", "y").alias("h")).collect()] == [0, 0x55555555, 0xAAAAAAAA, 0xFFFFFFFF]


def test_hilbert_neighbours(spark):
    side = 16
    df = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    walk = df.select("x", "y", geo.hilbert("x", "y").alias("h")).orderBy("h").collect()
    steps = {abs(a.x - b.x) + abs(a.y - b.y) for a, b in zip(walk, walk[1:])}
    assert steps == {1}


def test_table_sort(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, "b"), (4, None), (5, "a")], "k int, v string")
    assert [r.k for r in table.table_sort(df, "v", "k", descending=False).collect()] == [2, 1, 4, 5, 3]


def test_failed_batch_keeps_rows(spark):
    def broken():
        def fn(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("provider")
            return [[1.0, 2.0]] * len(texts)
        return fn

    embed.register_model("prov", broken)
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "k int, text string").coalesce(1)
    out = embed.embed(df, ["text"], "prov/m", batch=1)
    assert sorted(values(embed.filter_unembedded(out, "prov/m"), "k")) == [(2,)]
    again = embed.embed(out, ["text"], "prov/m", batch=1)
    assert again.count() == 3
    with pytest.raises(ValueError):
        embed.embed(df, ["text"], "nobody")


def test_independent_set_order(spark):
    items = spark.range(5).select(F.col("id").alias("pos"))
    pairs = [(i, i + 1) for i in range(4)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    assert sorted(r.pos for r in greedy_independent_set(items, edges).collect()) == [0, 2, 4]


def test_search_by_text(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "red fish")], "k int, text string")
    stored = embed.embed(df, ["text"])
    assert values(search.search_text(stored, " red fox ", "k", embed.HASH_MODEL, 1), "k") == [(1,)]
    assert search.search_text(stored, "  ", "k", embed.HASH_MODEL).count() == 0


def test_nothing_to_cluster(spark):
    far = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 9.0)], "id long, x double, y double")
    assert [r.cluster for r in density.dbscan(far, "id", "id").collect()] == [None, None]
    label, members = density.density_ball(far, "id", "id")
    assert [r.cluster for r in label.collect()] == [None, None] and members.count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0]), (8, [0.0, 0.0])], "id long, v array<double>")
    assert [(r.id, r.clusterNumber) for r in hac.auto_cluster(one, "id", "v").collect()] == [(7, 0)]
    none = spark.createDataFrame([], "id long, min_x double, max_x double, min_y double, max_y double")
    assert labels.declutter(none, "id").count() == 0


def test_stream_embed_is_incremental(spark, tmp_path):
    from vectab.streaming.jobs import stream_embed

    calls = []

    def flaky():
        def fn(texts):
            if any("late" in t for t in texts) and not (tmp_path / "ready").exists():
                raise RuntimeError("provider")
            return [[1.0, float(len(t))] for t in texts]
        return fn

    embed.register_model("flaky", flaky)
    schema, source = "id long, text string", tmp_path / "in"
    db = store.Store(spark, str(tmp_path / "db"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_embed(stream, db, "t", "id", ["text"], "text", str(tmp_path / "ck"), "flaky").awaitTermination()
        calls.append(len(calls))
        return sorted(values(db.read("t"), "id", "text"))

    assert arrive([(1, "a"), (2, "b")]) == [(1, "a"), (2, "b")]
    assert arrive([(2, "changed"), (3, "late")]) == [(1, "a"), (2, "b"), (3, "late")]
    assert values(embed.filter_unembedded(db.read("t"), "flaky"), "id") == [(3,)]
    (tmp_path / "ready").touch()
    assert arrive([(4, "d"), (4, "e")]) == [(1, "a"), (2, "b"), (3, "late"), (4, "e")]
    assert embed.filter_unembedded(db.read("t"), "flaky").count() == 0


def test_nearest_boxes_and_filters(spark):
    boxes = spark.createDataFrame(
        [(1, 0.0, 2.0, 0.0, 2.0), (2, 5.0, 6.0, 1.0, 2.0), (3, 3.0, 4.0, 5.0, 6.0)],
        "id int, min_x double, max_x double, min_y double, max_y double")
    got = spatial.knn_boxes(boxes, 1.0, 1.0, "id", 2)
    assert values(got, "id", "d2") == [(1, 0.0), (2, 16.0)]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 6.0, 8.0)], "id int, x double, y double")
    assert values(spatial.knn_2d(pts, 0, 0, "id", max_dist=5), "id") == [(1,), (2,)]
    assert values(spatial.knn_2d(pts, 0, 0, "id", where=F.col("id") > 1), "id") == [(2,), (3,)]
    assert values(spatial.window_query(pts, 0, 0, 3, 4), "id") == [(1,), (2,)]


def test_vectors_without_direction_match_nothing(spark):
    """NaN, infinite and null elements neither win a place nor push a row out."""
    from vectab.operators.search import knn_graph, search_exact

    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r["id"] for r in search_exact(table, [1.0, 0.0], "id", "v").collect()] == [1, 2, 3]
    near = knn_graph(table, "id", "v", 2).collect()
    assert len(near) == 6 and not {4, 5, 6} & {v for r in near for v in r.asDict().values()}


def test_delimiter_uses_all_records(spark, tmp_path):
    """A steady look of the first lines does not decide; equal candidates are an error."""
    from vectab.sources.files import csv_errors, guess_delimiter, read_csv

    path = tmp_path / "late.csv"
    lines = ["a,x;b"] + ["1,2;3"] * 12 + ["plain;4"] * 20
    path.write_text("\n".join(lines) + "\n")
    assert guess_delimiter(spark, str(path)) == ";"
    (tmp_path / "tie.csv").write_text("a,b;c\n1,2;3\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "tie.csv"))
    (tmp_path / "long.csv").write_text('a,b\n"' + "x" * 20_000 + '""y",2,3\n')
    found = csv_errors(spark, str(tmp_path / "long.csv"), ",").collect()
    assert [(r["kind"], r["parsed"]) for r in found] == [("TooManyFields", 3)]
