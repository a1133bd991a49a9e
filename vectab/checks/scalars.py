"""Registered queries: scalar expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, vector
from ..functions.quant import hamming, sbq_bytes, sbq_code, sbq_words
from ..operators.spatial import extent_values, scale_to_screen
from ..operators.stats import dim_stats, sbq_encode, sbq_fit
from .common import PLANE_SQL, Q_SQL, plane, query_vector, r6, table, vectors

QUERIES: dict = {}
SQL: dict = {}


def vector_query(name: str, expression, sql: str) -> None:
    """A query that applies ``expression(vector, query)`` to every row of ``embeddings``."""

    def run(spark, sf):
        q = vector.lit_vector(query_vector(spark, sf))
        return vectors(spark, sf).select("vec_id", r6(expression(F.col("embedding"), q)).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"SELECT vec_id, round({sql.format(v='embedding::DOUBLE[]', q=Q_SQL)}, 6) AS value FROM embeddings"


COS = "list_cosine_similarity({v}, {q})"
vector_query("dot", vector.dot, "list_dot_product({v}, {q})")
vector_query("norm", lambda v, q: vector.norm(v), "sqrt(list_dot_product({v}, {v}))")
vector_query("cosine", vector.cosine, COS)
vector_query("cosine_distance", vector.cosine_distance, f"1 - {COS}")
vector_query("euclidean_distance", vector.euclidean_distance, "list_distance({v}, {q})")
vector_query("euclidean_similarity", vector.euclidean_similarity, "1 / (1 + list_distance({v}, {q}))")
vector_query("round_fixed3", lambda v, q: vector.round_fixed3(vector.cosine(v, q)), f"round({COS}, 3)")
_sig = "(CASE WHEN {c} = 0 THEN 0 ELSE round({c} * pow(10.0::DOUBLE, 1 - floor(log10(abs({c}))))) / pow(10.0::DOUBLE, 1 - floor(log10(abs({c})))) END)"
vector_query("round_sig2", lambda v, q: vector.round_sig2(vector.cosine(v, q)), _sig.replace("{c}", COS))


def _q(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


@_q("distance_2d", f"WITH {PLANE_SQL} SELECT vec_id, round(sqrt(x * x + y * y), 6) AS value FROM pts")
def _(spark, sf):
    return plane(spark, sf).select("vec_id", r6(geo.distance_2d(F.lit(0.0), F.lit(0.0), "x", "y")).alias("value"))


@_q("axis_distance", f"WITH {PLANE_SQL} SELECT vec_id, round(greatest(-0.1 - x, 0, x - 0.1), 6) AS value FROM pts")
def _(spark, sf):
    return plane(spark, sf).select("vec_id", r6(geo.axis_distance("x", F.lit(-0.1), F.lit(0.1))).alias("value"))


@_q("linear_scale", f"""WITH {PLANE_SQL}, e AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pts)
    SELECT vec_id, round(20 + (x - x0) * 760 / (x1 - x0), 6) AS sx, round(580 + (y - y0) * (-560) / (y1 - y0), 6) AS sy
    FROM pts, e""")
def _(spark, sf):
    return scale_to_screen(plane(spark, sf), 800, 600, 20).select("vec_id", r6("sx").alias("sx"), r6("sy").alias("sy"))


HILBERT_SQL = f"""{PLANE_SQL}, e AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pts),
    grid AS (SELECT vec_id, x, y, floor(65535 * (x - x0) / (x1 - x0))::BIGINT AS gx,
                    floor(65535 * (y - y0) / (y1 - y0))::BIGINT AS gy FROM pts, e),
    walk AS (
      SELECT vec_id, 15 AS l, 0::BIGINT AS d, gx AS a, gy AS b FROM grid
      UNION ALL
      SELECT vec_id, l - 1, d + s * s * CASE WHEN r THEN (CASE WHEN u THEN 2 ELSE 3 END) ELSE (CASE WHEN u THEN 1 ELSE 0 END) END,
             CASE WHEN u THEN a % s WHEN r THEN s - 1 - b % s ELSE b % s END,
             CASE WHEN u THEN b % s WHEN r THEN s - 1 - a % s ELSE a % s END
      FROM (SELECT *, (1::BIGINT << l) AS s, a >= (1::BIGINT << l) AS r, b >= (1::BIGINT << l) AS u FROM walk WHERE l >= 0)),
    curve AS (SELECT vec_id, d AS h FROM walk WHERE l = -1)"""


@_q("hilbert", f"WITH RECURSIVE {HILBERT_SQL} SELECT vec_id, h FROM curve")
def _(spark, sf):
    points = plane(spark, sf)
    x0, x1, y0, y1 = extent_values(points)
    return points.select(
        "vec_id", geo.hilbert(geo.hilbert_cell("x", x0, x1), geo.hilbert_cell("y", y0, y1)).alias("h"))


DIM_SQL = """el AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
    fit AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM el GROUP BY dim)"""
CODE_SQL = f"""{DIM_SQL},
    codes AS (SELECT vec_id, dim, CASE WHEN s <= 0 THEN 0 WHEN v - m > s THEN 3 WHEN v > m THEN 1 ELSE 0 END AS c
              FROM el JOIN fit USING (dim))"""


@_q("dim_mean", f"WITH {DIM_SQL} SELECT dim, round(m, 6) + 0.0 AS value FROM fit")
def _(spark, sf):
    one = dim_stats(vectors(spark, sf), "embedding")
    return one.select(F.posexplode("mean").alias("dim", "v")).select(F.col("dim").cast("long").alias("dim"), r6("v").alias("value"))


@_q("dim_std", f"WITH {DIM_SQL} SELECT dim, round(s, 6) AS value FROM fit")
def _(spark, sf):
    one = dim_stats(vectors(spark, sf), "embedding")
    return one.select(F.posexplode("std").alias("dim", "v")).select(F.col("dim").cast("long").alias("dim"), r6("v").alias("value"))


@_q("sbq_fit", f"WITH {DIM_SQL} SELECT count(*) AS dims, round(sum(m), 6) + 0.0 AS mean_sum, round(sum(s), 6) AS std_sum FROM fit")
def _(spark, sf):
    return dim_stats(vectors(spark, sf), "embedding").select(
        F.size("mean").cast("long").alias("dims"), r6(vector.fold_sum(F.col("mean"))).alias("mean_sum"),
        r6(vector.fold_sum(F.col("std"))).alias("std_sum"))


@_q("sbq_code", f"WITH {CODE_SQL} SELECT vec_id, string_agg(c::VARCHAR, '' ORDER BY dim) AS codes FROM codes GROUP BY 1")
def _(spark, sf):
    mean, std = sbq_fit(vectors(spark, sf), "embedding")
    return vectors(spark, sf).select(
        "vec_id", F.array_join(sbq_code("embedding", mean, std).cast("array<string>"), "").alias("codes"))


@_q("sbq_pack", f"""WITH {CODE_SQL},
    bytes AS (SELECT vec_id, dim // 4 AS b, sum(c * pow(4, 3 - dim % 4))::BIGINT AS v FROM codes GROUP BY 1, 2)
    SELECT vec_id, string_agg(printf('%02X', v), '' ORDER BY b) AS packed FROM bytes GROUP BY 1""")
def _(spark, sf):
    mean, std = sbq_fit(vectors(spark, sf), "embedding")
    return vectors(spark, sf).select("vec_id", sbq_bytes(sbq_code("embedding", mean, std), len(mean)).alias("packed"))


HAMMING_SQL = f"""{CODE_SQL},
    q AS (SELECT dim, c AS qc FROM codes WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    far AS (SELECT vec_id, sum(bit_count(xor(c, qc)))::BIGINT AS distance FROM codes JOIN q USING (dim) GROUP BY 1)"""


@_q("hamming", f"WITH {HAMMING_SQL} SELECT vec_id, distance FROM far")
def _(spark, sf):
    mean, std = sbq_fit(vectors(spark, sf), "embedding")
    code = lambda v: sbq_words(sbq_code(v, mean, std), len(mean))
    q = vector.lit_vector(query_vector(spark, sf))
    return vectors(spark, sf).select("vec_id", hamming(code("embedding"), code(q)).cast("long").alias("distance"))


@_q("sbq_encode", f"""WITH {CODE_SQL}
    SELECT vec_id, label, sum(bit_count(c))::BIGINT AS bits, sum(CASE WHEN c = 3 THEN 1 ELSE 0 END)::BIGINT AS high
    FROM codes JOIN embeddings USING (vec_id) GROUP BY 1, 2""")
def _(spark, sf):
    mean, std = sbq_fit(vectors(spark, sf), "embedding")
    coded = sbq_encode(vectors(spark, sf), "embedding", mean, std)
    bits = F.aggregate("code", F.lit(0), lambda s, w: s + F.bit_count(w))
    pairs = F.lit(0x1555555555555555).cast("long")  # the low bit of each of 31 codes
    high = F.aggregate(
        "code", F.lit(0), lambda s, w: s + F.bit_count(w.bitwiseAND(F.shiftright(w, 1)).bitwiseAND(pairs)))
    return coded.select("vec_id", "label", bits.cast("long").alias("bits"), high.cast("long").alias("high"))


def _mapped(spark, sf):
    key = F.concat(F.lit("model-"), F.col("label").cast("string"))
    return vectors(spark, sf).select("vec_id", "label", F.create_map(key, F.col("embedding")).alias("embeddings"))


@_q("get_vector", """SELECT vec_id, CASE WHEN label = 3 THEN round(list_sum(embedding::DOUBLE[]), 6) END AS total,
    CASE WHEN label = 3 THEN len(embedding)::BIGINT END AS dims FROM embeddings""")
def _(spark, sf):
    v = vector.get_vector("embeddings", "model-3")
    total = F.when(v.isNotNull(), vector.fold_sum(F.transform(v, lambda x: x.cast("double"))))
    return _mapped(spark, sf).select("vec_id", r6(total).alias("total"), F.when(v.isNotNull(), F.size(v)).cast("long").alias("dims"))


@_q("put_vector", """SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 2 END::BIGINT AS n_models, 2::BIGINT AS dims FROM embeddings""")
def _(spark, sf):
    new = F.array(F.lit(1.0), F.lit(2.0))
    put = vector.put_vector("embeddings", "model-3", new)
    return _mapped(spark, sf).withColumn("m", put).select(
        "vec_id", F.size("m").cast("long").alias("n_models"),
        F.size(vector.get_vector("m", "model-3")).cast("long").alias("dims"))


@_q("cast_vectors", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(spark, sf):
    wide = _mapped(spark, sf).select("vec_id", "label", vector.plain_vectors("embeddings").alias("embeddings"))
    back = wide.select("vec_id", vector.cast_vectors("embeddings").alias("embeddings"))
    v = F.transform(F.map_values("embeddings")[0], lambda x: x.cast("double"))
    return back.select("vec_id", r6(vector.fold_sum(v)).alias("total"))


@_q("to_json", """SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars})::VARCHAR AS js FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("js"))


@_q("from_json", "SELECT doc_id, text, n_chars FROM documents")
def _(spark, sf):
    js = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text", "n_chars")).alias("js"))
    return js.select(F.from_json("js", "doc_id long, text string, n_chars long").alias("r")).select("r.*")


@_q("compose_text", "SELECT doc_id, concat(lang, ' ', coalesce(quality::VARCHAR, 'undefined'), ' ', source, ' ') AS composed FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select("doc_id", text.compose_text(["lang", "quality", "source"]).alias("composed"))


@_q("token_count", "SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda t: t <> ''))::BIGINT AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_count("text").cast("long").alias("n"))


@_q("sanitize_id", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '', 'g') AS id FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_id("url").alias("id"))


@_q("url_filename", "SELECT page_id, string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1] AS file FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_filename("url").alias("file"))


@_q("model_key", "SELECT page_id, regexp_extract(url, 'example\\.(?:com|net|org)/([^/]+/[^/]+)', 1) AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.model_key("url", r"example\.(?:com|net|org)").alias("name"))
