"""Nothing is lost: columns that come later, files with other headers, rows on which a model fails."""

import pytest
from pyspark.sql import functions as F

from vectab.operators import embed
from vectab.plans.cluster_map import FOUND, save_cluster_map
from vectab.sources import files
from vectab.sources.store import Store, upsert
from vectab.streaming.jobs import ERRORS, stream_embed


def test_upsert_widens(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, t int")
    batch = spark.createDataFrame([(2, "c", True), (3, "d", False)], "k int, x string, new boolean")
    want = [(1, "a", 1, None), (2, "c", None, True), (3, "d", None, False)]
    got = upsert(target, batch, "k", ["x"]).orderBy("k")
    assert got.columns == ["k", "x", "t", "new"] and [tuple(r) for r in got.collect()] == want
    store = Store(spark, str(tmp_path))
    store.write("t", target, "k")
    assert [tuple(r) for r in store.upsert("t", batch, ["x"]).orderBy("k").collect()] == want
    more = spark.createDataFrame([(3, 9), (4, 7)], "k int, other int")
    rows = store.insert_new("t", more, ["other"]).orderBy("k").collect()
    assert [(r.k, r.x, r.other) for r in rows] == [(1, "a", None), (2, "c", None), (3, "d", None), (4, None, 7)]
    assert store.key("t") == "k"


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x;y\n1;p;q\n2;r\n")
    (tmp_path / "b.csv").write_text("y;id\nq;3\n\ns;4;5\n")
    (tmp_path / "c.csv").write_text("id;x;y\n6;\"a;\nb\";c\n")
    (tmp_path / "d.csv").write_text("")
    rows = files.read_csv(spark, str(tmp_path), ";").collect()
    assert sorted((r.id, r.x, r.y) for r in rows if r.id not in ("2",)) == [
        ("1", "p", "q"), ("3", None, "q"), ("4", None, "s"), ("6", "a;\nb", "c")]
    errors = sorted((r.kind, r.expected, r.parsed) for r in files.csv_errors(spark, str(tmp_path)).collect())
    assert errors == [("TooFewFields", 3, 2), ("TooManyFields", 2, 3)]
    assert tuple(files.csv_report(spark, str(tmp_path)).first()) == (5, 2)


def picky():
    def factory():  # inside, so that workers need not import this file
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

        return model

    return factory


def test_failures_are_kept_and_counted(spark):
    embed.register_model("picky", picky())
    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(1, 40)], "id int, text string").coalesce(1)
    once = embed.embed(df, ["text"], "picky", errors="e")
    rows = {r.id: r for r in once.collect()}
    assert rows[7].embeddings == {} and rows[7].e["picky"].tries == 1 and rows[7].e["picky"].message == "RuntimeError: no"
    assert all(rows[i].embeddings["picky"][0] > 0 and rows[i].e == {} for i in rows if i != 7)
    twice = embed.embed(once, ["text"], "picky", errors="e")
    assert {r.id: r.e["picky"].tries for r in twice.filter("size(e) > 0").collect()} == {7: 2}
    assert embed.filter_unembedded(twice, "picky", errors="e", tries=2).count() == 0
    assert embed.filter_unembedded(twice, "picky", errors="e", tries=3).count() == 1
    embed.register_model("picky", lambda: lambda texts: [[1.0] for _ in texts])
    mended = embed.embed(twice, ["text"], "picky", errors="e").filter("id = 7").first()
    assert mended.e == {} and mended.embeddings["picky"] == [1.0]
    assert "e" not in embed.embed(df, ["text"], "picky").columns


def test_stream_gives_up_after_some_tries(spark, tmp_path):
    embed.register_model("picky", picky())
    store, source = Store(spark, str(tmp_path / "tables")), str(tmp_path / "in")
    for number in range(5):
        spark.createDataFrame([(10 * number + i, "bad" if (number, i) == (0, 1) else "fine", number) for i in range(3)],
                              "id int, text string, n int").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("id int, text string, n int").json(source)
        stream_embed(stream, store, "t", "id", ["text"], "n", str(tmp_path / "check"), "picky", tries=3).awaitTermination()
    rows = {r.id: r for r in store.read("t").collect()}
    assert len(rows) == 15 and rows[1][ERRORS]["picky"].tries == 3
    assert all(len(rows[i].embeddings["picky"]) == 1 for i in rows if i != 1)
    assert len(store._children(f"{tmp_path}/tables/t")) <= 4  # the table is rewritten for two more tries only


def test_cluster_map_is_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(i, [1.0 + i % 2, 0.1 * i, 1.0], f"n{i}") for i in range(8)]
    store.write("a", spark.createDataFrame(rows[:5], "id int, v array<double>, name string"), "id")
    store.write("b", spark.createDataFrame(rows[3:], "id int, v array<double>, name string"), "id")
    for _ in range(2):  # a second run replaces what the first has found
        mapped = save_cluster_map(store, ["a", "b"], "v", eps=0.5)
        for name, ids in (("a", range(5)), ("b", range(3, 8))):
            kept = store.read(name)
            assert kept.columns == ["id", "v", "name", *FOUND] and store.key(name) == "id"
            own = mapped.filter(F.col("table_name") == name).select("id", *FOUND).orderBy("id")
            assert [r.id for r in own.collect()] == list(ids)
            assert kept.select("id", *FOUND).orderBy("id").collect() == own.collect()
    store.write("c", spark.createDataFrame([("x",)], "k string"), "k")
    with pytest.raises(ValueError, match="different keys"):
        save_cluster_map(store, ["a", "c"], "v")
