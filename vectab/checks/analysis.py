"""Registered queries: search, matching, clustering, planar operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vector import cosine, lit_vector, unit
from ..operators import ann, cells, codes, density, descent, hac, labels, packed, projection, search, spatial, stats, table as ops
from ..plans.cluster_map import cluster_map
from ..plans.graph import greedy_independent_set
from ..plans.scaling import cut_lineage, scratch_path
from .common import (
    MATCH_SQL, PLANE_SQL, Q_SQL, hashed, plane, query_vector, r6, table, tree, vectors,
)
from .scalars import HAMMING_SQL, HILBERT_SQL

QUERIES: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


SIM_SQL = f"""sims AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {Q_SQL}) AS s FROM embeddings),
    sig AS (SELECT vec_id, label, CASE WHEN s = 0 THEN 0 ELSE round(s * pow(10.0::DOUBLE, 1 - floor(log10(abs(s)))))
            / pow(10.0::DOUBLE, 1 - floor(log10(abs(s)))) END AS score FROM sims)"""


@_q("search_exact", f"WITH {SIM_SQL} SELECT vec_id, label, score FROM sig ORDER BY score DESC, vec_id LIMIT 10")
def search_exact(spark, sf):
    return search.search_exact(vectors(spark, sf), query_vector(spark, sf), "vec_id", "embedding")


@_q("search_sbq", f"WITH {HAMMING_SQL} SELECT vec_id, -distance AS score FROM far ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "embedding")
    mean, std = stats.sbq_fit(rows, "embedding")
    found = search.search_sbq(rows, query_vector(spark, sf), "vec_id", "embedding", mean, std)
    return found.select("vec_id", F.col("score").cast("long").alias("score"))


@_q("topk_per_group", f"""WITH {SIM_SQL} SELECT vec_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank
    FROM sig QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5""")
def _(spark, sf):
    from ..functions.vector import round_sig2

    q = lit_vector(query_vector(spark, sf))
    scored = vectors(spark, sf).select("vec_id", "label", cosine("embedding", q).alias("s")).select(
        "vec_id", "label", round_sig2("s").alias("score"))
    return search.topk_per_group(scored, "label", "score", "vec_id", 5)


@_q("search_ann", f"""SELECT vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], {Q_SQL}), 6) AS score FROM embeddings
    ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {Q_SQL}), 12) DESC, vec_id LIMIT 10""")
def _(spark, sf):
    index = ann.ann_build(vectors(spark, sf), "vec_id", "embedding")
    return ann.search_ann(index, query_vector(spark, sf)).select("key", r6("score").alias("score"))


@_q("ann_build")
def _(spark, sf):
    index = ann.ann_build(vectors(spark, sf), "vec_id", "embedding")
    return index.cells.select("cell", "n", r6("reach").alias("reach"))


@_q("ann_load", SQL["search_ann"])
def _(spark, sf):
    path = scratch_path(spark, "index")
    index = ann.ann_open(vectors(spark, sf), "vec_id", "embedding", path)
    return ann.search_ann(index, query_vector(spark, sf)).select("key", r6("score").alias("score"))


# The table as it is now, for an index that was saved when a third of its rows had not come yet: some rows have gone
# since, some have turned round.
NOW_SQL = """now AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 5 = 0 THEN -x ELSE x END) AS v
    FROM embeddings WHERE vec_id % 7 <> 3)"""


def _followed(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "embedding")
    path = scratch_path(spark, "index")
    ann.ann_open(rows.filter("vec_id % 3 <> 0"), "vec_id", "embedding", path)
    turned = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    return ann.ann_open(rows.filter("vec_id % 7 <> 3").withColumn("embedding", turned), "vec_id", "embedding", path)


@_q("ann_follow", f"WITH {NOW_SQL} SELECT vec_id AS key, round(list_cosine_similarity(v, {Q_SQL}), 6) AS score FROM now")
def _(spark, sf):
    query = query_vector(spark, sf)
    return _followed(spark, sf).entries.select("key", r6(cosine("u", lit_vector(query))).alias("score"))


@_q("ann_follow_search", f"""WITH {NOW_SQL} SELECT vec_id AS key, round(list_cosine_similarity(v, {Q_SQL}), 6) AS score FROM now
    ORDER BY round(list_cosine_similarity(v, {Q_SQL}), 12) DESC, vec_id LIMIT 10""")
def _(spark, sf):
    return ann.search_ann(_followed(spark, sf), query_vector(spark, sf)).select("key", r6("score").alias("score"))


# Given centres: the first rows, 4 coarse ones and 32 fine ones dealt to them.
@_q("ann_cells_given", """WITH c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS p, embedding::DOUBLE[] AS v FROM embeddings QUALIFY p < 36),
    top AS (SELECT vec_id, e.embedding::DOUBLE[] AS v, arg_max(p, list_cosine_similarity(e.embedding::DOUBLE[], c.v)) AS parent
            FROM embeddings e JOIN c ON p < 4 GROUP BY 1, 2),
    placed AS (SELECT vec_id, parent, arg_max(p, list_cosine_similarity(top.v, c.v)) AS cell, max(list_cosine_similarity(top.v, c.v)) AS s
               FROM top JOIN c ON p >= 4 AND p % 4 = parent GROUP BY 1, 2)
    SELECT parent::INT AS parent, cell::INT AS cell, count(*) AS n, round(max(acos(least(s, 1))) + 1e-6, 5) AS reach FROM placed GROUP BY 1, 2""")
def _(spark, sf):
    first = vectors(spark, sf).orderBy("vec_id").limit(36).select(unit("embedding").alias("u")).collect()
    given = [[float(x) for x in r["u"]] for r in first]
    fine = spark.createDataFrame([(p % 4, p, c) for p, c in enumerate(given) if p >= 4], "parent int, cell int, centre array<double>")
    index = ann.ann_build(vectors(spark, sf), "vec_id", "embedding", centres=cells.Centres(np.array(given[:4]), fine))
    return index.cells.select("parent", "cell", "n", F.round("reach", 5).alias("reach"))


@_q("search_sbq_stored", SQL["search_sbq"])
def _(spark, sf):
    rows, path = vectors(spark, sf), scratch_path(spark, "codes")
    codes.save_codes(rows, "vec_id", "embedding", *stats.sbq_fit(rows, "embedding"), path)
    found = codes.search_codes(codes.load_codes(spark, path), query_vector(spark, sf))
    return found.select(F.col("key").alias("vec_id"), "score")


MATCH_OUT = MATCH_SQL + """
    SELECT doc_id, lang, round(s, 3) AS score, b2.item_id AS "bestMatch-item_id", b2.text AS "bestMatch-text"
    FROM best JOIN documents USING (doc_id) JOIN benchmark b2 ON b2.item_id = best.item_id"""


def _sides(spark, sf):
    """Two stored tables with their vectors, as an earlier embed job leaves them."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return cut_lineage(hashed(docs, "doc_id", "lang")), cut_lineage(hashed(bench, "item_id", "text"))


@_q("best_match_exact", MATCH_OUT)
def _(spark, sf):
    return search.compare(*_sides(spark, sf), "doc_id", "v", "item_id")


@_q("best_match_ann", MATCH_OUT)
def _(spark, sf):
    return search_ann_compare(spark, sf)


@_q("best_match_probe")  # a better row outside the four nearest cells may be missed
def _(spark, sf):
    return ann.compare_ann(*_sides(spark, sf), "doc_id", "v", "item_id", scratch_path(spark, "index"), n_probe=4)


def search_ann_compare(spark, sf):
    return ann.compare_ann(*_sides(spark, sf), "doc_id", "v", "item_id", scratch_path(spark, "index"))


@_q("compare_pair", """WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings),
    a AS (SELECT * FROM r WHERE p = 1), b AS (SELECT * FROM r WHERE p = (SELECT max(p) FROM r))
    SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS score,
           a.vec_id, a.label, b.vec_id AS vec_id2, b.label AS label2 FROM a, b""")
def _(spark, sf):
    rows = vectors(spark, sf)
    ends = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    return search.compare_pair(rows, "vec_id", "embedding", list(ends))


PAIR_SQL = """pairs AS (SELECT a.vec_id AS i, b.vec_id AS j,
      round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"""


@_q("pair_distances", f"WITH {PAIR_SQL} SELECT i, j, round(1 - s, 6) AS dist FROM pairs WHERE i < j")
def _(spark, sf):
    return search.pair_distances(vectors(spark, sf), "vec_id", "embedding", 2.0).select("i", "j", r6("dist").alias("dist"))


@_q("knn_graph", f"""WITH {PAIR_SQL} SELECT i, j, round(1 - s, 6) AS dist, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank
    FROM pairs QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 5""")
def _(spark, sf):
    return search.knn_graph(vectors(spark, sf), "vec_id", "embedding", 5).select("i", "j", r6("dist").alias("dist"), "rank")


@_q("knn_graph_descent")  # a neighbour may be missed; tests hold its recall against the exact graph
def _(spark, sf):
    found = descent.knn_graph_descent(vectors(spark, sf), "vec_id", "embedding", 5)
    return found.select("i", "j", r6("dist").alias("dist"), "rank")


@_q("cluster_spread", """SELECT a.label, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS spread
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def _(spark, sf):
    return stats.cluster_spread(vectors(spark, sf), "embedding", "label").select("label", r6("spread").alias("spread"))


@_q("linkage_avg", """SELECT a.label AS a, b.label AS b, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS dist
    FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY 1, 2""")
def _(spark, sf):
    return stats.linkage_average(vectors(spark, sf), "embedding", "label").select("a", "b", r6("dist").alias("dist"))


@_q("medoid", """WITH p AS (SELECT a.vec_id, a.label, sum(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)
    SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) = 1 AS central FROM p""")
def _(spark, sf):
    return stats.medoid(vectors(spark, sf), "vec_id", "embedding", "label").select("vec_id", "label", "central")


_BINS = "(floor(embedding[1]::DOUBLE * 40))::INT"


@_q("singletons_to_noise", f"""WITH b AS (SELECT vec_id, {_BINS} AS bin FROM embeddings)
    SELECT vec_id, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN -1 ELSE bin END AS bin FROM b""")
def _(spark, sf):
    rows = vectors(spark, sf).select("vec_id", F.floor(F.col("embedding")[0].cast("double") * 40).cast("int").alias("bin"))
    return stats.singletons_to_noise(rows, "vec_id", "bin")


# A curve to pick K from: the spread of each label's rows.
CURVE_SQL = """curve AS (SELECT a.label + 1 AS k, avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS spread
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)"""


def _curve(spark, sf):
    return stats.cluster_spread(vectors(spark, sf), "embedding", "label").select((F.col("label") + 1).alias("k"), "spread")


@_q("pick_k_peak", f"WITH {CURVE_SQL} SELECT greatest(k - 1, 1)::BIGINT AS k FROM curve ORDER BY round(spread, 12) DESC, k LIMIT 1")
def _(spark, sf):
    return stats.pick_k_peak(_curve(spark, sf))


@_q("pick_k_elbow", f"""WITH {CURVE_SQL}, e AS (SELECT min(k) ak, max(k) zk, arg_min(spread, k) asp, arg_max(spread, k) zsp FROM curve)
    SELECT k::BIGINT AS k FROM curve, e
    ORDER BY round(abs((zsp - asp) * k - (zk - ak) * spread + (zk * asp - zsp * ak)) / sqrt((zk - ak) ** 2 + (zsp - asp) ** 2), 12) DESC, k LIMIT 1""")
def _(spark, sf):
    return stats.pick_k_elbow(_curve(spark, sf))


# --- hierarchical clustering ---

@_q("hac")
def _(spark, sf):
    return tree(spark, sf)[1].select("rank", "node", "left", "right", r6("height").alias("height"), "size")


@_q("spread_by_k")
def _(spark, sf):
    rows, merges = tree(spark, sf)
    return stats.spread_by_k(merges, rows.count()).select("k", r6("spread").alias("spread"))


@_q("cut_tree")
def _(spark, sf):
    return hac.cut_tree(*tree(spark, sf), 10)


@_q("leaf_order")
def _(spark, sf):
    return hac.leaf_order(*tree(spark, sf))


@_q("auto_cluster")
def _(spark, sf):
    return hac.auto_cluster(vectors(spark, sf), "vec_id", "embedding")


@_q("cluster_map")
def _(spark, sf):
    mapped = cluster_map([vectors(spark, sf)], "vec_id", "embedding", eps=0.05)
    return mapped.select("vec_id", "clusterNumber", "dbscanCluster", "center")


@_q("project_2d")
def _(spark, sf):
    return projection.project_2d(vectors(spark, sf), "vec_id", "embedding").select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


# --- the plane ---

@_q("extent", f"WITH {PLANE_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts")
def _(spark, sf):
    return spatial.extent(plane(spark, sf))


@_q("window_query", f"WITH {PLANE_SQL} SELECT vec_id FROM pts WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.05 AND 0.2")
def _(spark, sf):
    return spatial.window_query(plane(spark, sf), -0.1, -0.05, 0.15, 0.2).select("vec_id")


@_q("knn_2d", f"""WITH {PLANE_SQL} SELECT vec_id, round(x * x + y * y, 9) AS d2 FROM pts WHERE x * x + y * y <= 0.0025
    ORDER BY x * x + y * y, vec_id LIMIT 8""")
def _(spark, sf):
    return spatial.knn_2d(plane(spark, sf), 0, 0, "vec_id", 8, 0.05).select("vec_id", F.round("d2", 9).alias("d2"))


def _packed(spark, sf):
    path = scratch_path(spark, "packed")
    packed.save_packed(plane(spark, sf), "vec_id", path, file_rows=64)
    return packed.open_packed(spark, path)


@_q("window_query_packed", SQL["window_query"])
def _(spark, sf):
    return packed.window_packed(_packed(spark, sf), -0.1, -0.05, 0.15, 0.2).select("vec_id")


@_q("knn_2d_packed", SQL["knn_2d"])
def _(spark, sf):
    return packed.knn_packed(_packed(spark, sf), 0, 0, "vec_id", 8, 0.05).select("vec_id", F.round("d2", 9).alias("d2"))


@_q("hilbert_sort", f"WITH RECURSIVE {HILBERT_SQL} SELECT vec_id, h FROM curve")
def _(spark, sf):
    return spatial.hilbert_sort(spatial.point_boxes(plane(spark, sf)), "vec_id").select("vec_id", "h")


@_q("node_bbox", f"""WITH RECURSIVE {HILBERT_SQL},
    placed AS (SELECT (row_number() OVER (ORDER BY h, vec_id) - 1) // 16 AS block, x, y FROM curve JOIN pts USING (vec_id))
    SELECT block, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n FROM placed GROUP BY 1""")
def _(spark, sf):
    blocks = spatial.hilbert_blocks(spatial.point_boxes(plane(spark, sf)), "vec_id")
    return spatial.node_bbox(blocks)


SCREEN_SQL = f"""{PLANE_SQL}, e AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pts),
    screen AS (SELECT vec_id, label, 20 + (x - x0) * 760.0::DOUBLE / (x1 - x0) AS sx, 580 + (y - y0) * (-560.0::DOUBLE) / (y1 - y0) AS sy FROM pts, e)"""


def _screen(spark, sf):
    return spatial.scale_to_screen(plane(spark, sf), 800, 600, 20)


@_q("density_grid", f"WITH {SCREEN_SQL} SELECT floor(sx / 3)::BIGINT AS gx, floor(sy / 3)::BIGINT AS gy, count(*) AS n FROM screen GROUP BY 1, 2")
def _(spark, sf):
    return spatial.density_grid(_screen(spark, sf), 3, "sx", "sy")


@_q("density_blur", f"""WITH {SCREEN_SQL}, g AS (SELECT floor(sx / 3)::BIGINT AS gx, floor(sy / 3)::BIGINT AS gy, count(*) AS n FROM screen GROUP BY 1, 2),
    o AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / (2 * 1.5::DOUBLE * 1.5)) AS w
          FROM (SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-5, 6)) AS dy)),
    t AS (SELECT sum(w) AS total FROM o)
    SELECT gx + dx AS gx, gy + dy AS gy, round(sum(n * w) / (SELECT total FROM t), 6) AS value FROM g, o
    WHERE gx + dx BETWEEN 0 AND 266 AND gy + dy BETWEEN 0 AND 199 GROUP BY 1, 2""")
def _(spark, sf):
    grid = spatial.density_grid(_screen(spark, sf), 3, "sx", "sy")
    return spatial.density_blur(grid, 1.5, 267, 200).select("gx", "gy", r6("value").alias("value"))


def adj_sql(eps: float) -> str:
    return f"""adj AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS dist FROM pts a, pts b
      WHERE sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) < {eps})"""


@_q("eps_join", f"WITH {PLANE_SQL}, {adj_sql(0.03)} SELECT i, j, round(dist, 6) AS dist FROM adj")
def _(spark, sf):
    return spatial.eps_join(plane(spark, sf), 0.03, "vec_id").select("i", "j", r6("dist").alias("dist"))


BALL_SQL = f"""{PLANE_SQL}, {adj_sql(0.05)},
    near AS (SELECT i, list(j) AS nb FROM adj GROUP BY i),
    core AS (SELECT row_number() OVER (ORDER BY i) AS k, i, nb FROM near WHERE len(nb) >= 3),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS f
      UNION ALL SELECT core.k, CASE WHEN list_has_any(core.nb, walk.f) THEN walk.f ELSE list_append(walk.f, core.i) END
      FROM walk JOIN core ON core.k = walk.k + 1),
    founders AS (SELECT unnest(f) AS founder, generate_subscripts(f, 1) - 1 AS cluster FROM (SELECT f FROM walk ORDER BY k DESC LIMIT 1)),
    members AS (SELECT cluster, founder, p.vec_id, p.x, p.y, CASE WHEN p.vec_id = founder THEN -1 ELSE p.vec_id END AS list_pos
                FROM founders JOIN adj ON i = founder JOIN pts p ON p.vec_id = j),
    means AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS size FROM members GROUP BY 1),
    far AS (SELECT *, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 9) AS dist FROM members JOIN means USING (cluster))"""


def _ball(spark, sf):
    lab, members = density.density_ball(plane(spark, sf), "vec_id", "vec_id", 0.05, 3)
    return lab, members


@_q("density_ball", f"""WITH RECURSIVE {BALL_SQL}
    SELECT vec_id, max(cluster)::INT AS cluster FROM pts LEFT JOIN members USING (vec_id) GROUP BY 1""")
def _(spark, sf):
    return _ball(spark, sf)[0].select("vec_id", "cluster")


@_q("founder_rank", f"WITH RECURSIVE {BALL_SQL} SELECT vec_id, cluster::INT AS cluster FROM members WHERE list_pos = -1")
def _(spark, sf):
    return _ball(spark, sf)[1].filter("list_pos = -1").select("vec_id", "cluster")


@_q("centroid", f"WITH RECURSIVE {BALL_SQL} SELECT cluster::INT AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy, size FROM means")
def _(spark, sf):
    return stats.centroids(_ball(spark, sf)[1]).select("cluster", r6("cx").alias("cx"), r6("cy").alias("cy"), "size")


@_q("record_lows", f"""WITH RECURSIVE {BALL_SQL} SELECT cluster::INT AS cluster, vec_id, dist < least(65535.0::DOUBLE, coalesce(min(dist) OVER (
      PARTITION BY cluster ORDER BY list_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 65535.0::DOUBLE)) AS center FROM far""")
def _(spark, sf):
    members = cut_lineage(_ball(spark, sf)[1])
    return stats.record_lows(members, "vec_id", "list_pos").select("cluster", "vec_id", "center")


@_q("nearest_to_centroid", f"""WITH RECURSIVE {BALL_SQL} SELECT cluster::INT AS cluster, vec_id,
      row_number() OVER (PARTITION BY cluster ORDER BY dist, list_pos) = 1 AS center FROM far""")
def _(spark, sf):
    members = cut_lineage(_ball(spark, sf)[1])
    return stats.nearest_to_centroid(members, "vec_id", "list_pos").select("cluster", "vec_id", "center")


@_q("centers_only", f"""WITH RECURSIVE {BALL_SQL} SELECT cluster::INT AS cluster, vec_id FROM far
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY dist, list_pos) = 1""")
def _(spark, sf):
    members = cut_lineage(_ball(spark, sf)[1])
    return ops.centers_only(stats.nearest_to_centroid(members, "vec_id", "list_pos")).select("cluster", "vec_id")


@_q("dbscan", f"""WITH RECURSIVE {PLANE_SQL}, {adj_sql(0.02)},
    core AS (SELECT i FROM adj GROUP BY i HAVING count(*) >= 3),
    link AS (SELECT a.i, a.j FROM adj a JOIN core c ON c.i = a.i JOIN core d ON d.i = a.j),
    reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, link.j FROM reach JOIN link ON link.i = reach.j),
    comp AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    ranked AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM comp),
    rim AS (SELECT a.i, min(r.cluster) AS cluster FROM adj a JOIN ranked r ON r.i = a.j WHERE a.i NOT IN (SELECT i FROM core) GROUP BY 1)
    SELECT vec_id, coalesce(ranked.cluster, rim.cluster)::INT AS cluster FROM pts LEFT JOIN ranked ON ranked.i = vec_id LEFT JOIN rim ON rim.i = vec_id""")
def _(spark, sf):
    return density.dbscan(plane(spark, sf), "vec_id", "vec_id", 0.02, 3).select("vec_id", "cluster")


@_q("greedy_independent_set", f"""WITH RECURSIVE {PLANE_SQL}, {adj_sql(0.04)},
    near AS (SELECT row_number() OVER (ORDER BY i) AS k, i, list(j) AS nb FROM adj GROUP BY i),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS f
      UNION ALL SELECT near.k, CASE WHEN list_has_any(near.nb, walk.f) THEN walk.f ELSE list_append(walk.f, near.i) END
      FROM walk JOIN near ON near.k = walk.k + 1)
    SELECT unnest(f) AS vec_id FROM (SELECT f FROM walk ORDER BY k DESC LIMIT 1)""")
def _(spark, sf):
    def edges(probes, others):
        return spatial.eps_join(probes, 0.04, "pos", others=others).select(F.col("i").alias("a"), F.col("j").alias("b"))

    points = spatial.clique_cells(plane(spark, sf), 0.04).select(F.col("vec_id").alias("pos"), "x", "y", "cx", "cy")
    return greedy_independent_set(points, edges, ["cx", "cy"]).select(F.col("pos").alias("vec_id"))


BOX_SQL = f"{SCREEN_SQL}, box AS (SELECT vec_id, sx AS x0, sx + (label + 1) * 7.0::DOUBLE AS x1, sy AS y0, sy + 14.0::DOUBLE AS y1 FROM screen)"


def _boxes(spark, sf):
    points = _screen(spark, sf).withColumn("length", F.col("label") + 1)
    return labels.label_boxes(points, "length", "sx", "sy")


@_q("overlap_join", f"""WITH {BOX_SQL} SELECT a.vec_id AS i, b.vec_id AS j FROM box a JOIN box b ON a.vec_id < b.vec_id
    AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def _(spark, sf):
    return spatial.overlap_join(_boxes(spark, sf), "vec_id", 40)


@_q("declutter_labels", f"""WITH RECURSIVE {BOX_SQL},
    hit AS (SELECT a.vec_id AS i, list(b.vec_id) AS nb FROM box a JOIN box b
            ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY 1),
    near AS (SELECT row_number() OVER (ORDER BY i) AS k, i, nb FROM hit),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS f
      UNION ALL SELECT near.k, CASE WHEN list_has_any(near.nb, walk.f) THEN walk.f ELSE list_append(walk.f, near.i) END
      FROM walk JOIN near ON near.k = walk.k + 1)
    SELECT unnest(f) AS vec_id FROM (SELECT f FROM walk ORDER BY k DESC LIMIT 1)""")
def _(spark, sf):
    return labels.declutter(_boxes(spark, sf), "vec_id").select("vec_id")
