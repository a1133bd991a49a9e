"""Registered queries: sources, sinks, keyed tables, projections, simple joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import Rule, matches, rule_tags
from ..functions.vector import has_dim
from ..operators import table as ops
from ..operators.embed import HASH_MODEL, embed, filter_unembedded
from ..operators.stats import cluster_sizes
from ..plans.scaling import scratch_path
from ..sources import files, store
from ..streaming.jobs import stream_embed, stream_search
from .common import MAP_TYPE, TABLES, hash_sql, table, vectors

QUERIES: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


def docs(spark, sf):
    return table(spark, sf, "documents")


@_q("table_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    return ops.scan(docs(spark, sf), "doc_id")


@_q("count_rows", "SELECT count(*) AS n_rows FROM lineitem")
def _(spark, sf):
    return ops.count_rows(table(spark, sf, "lineitem"))


@_q("key_scan", "SELECT doc_id FROM documents")
def _(spark, sf):
    return ops.keys(docs(spark, sf), "doc_id")


@_q("first_row", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 1")
def _(spark, sf):
    return ops.first_row(docs(spark, sf).select("doc_id", "lang", "n_chars"), "doc_id")


@_q("scan_by_keys", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return ops.scan_by_keys(docs(spark, sf).select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"), "doc_id")


@_q("multi_scan", """SELECT 'documents' AS table_name, doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents
    UNION ALL SELECT 'conversations', conv_id, text, NULL, role FROM conversations""")
def _(spark, sf):
    a = docs(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang")
    b = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return ops.scan_many([a, b], ["documents", "conversations"])


def _first_columns(spark, sf):
    return {n: (table(spark, sf, n), table(spark, sf, n).columns[0]) for n in TABLES}


_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id",
}


@_q("catalog_list", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{k}' AS key_column, count(*) AS n_rows FROM {n}" for n, k in _KEYS.items()))
def _(spark, sf):
    return store.catalog(_first_columns(spark, sf))


@_q("catalog_models", """SELECT concat('model-', label) AS model, count(*) AS n_rows, min(len(embedding))::INT AS min_dim,
    max(len(embedding))::INT AS max_dim FROM embeddings GROUP BY 1""")
def _(spark, sf):
    key = F.concat(F.lit("model-"), F.col("label").cast("string"))
    return store.models(vectors(spark, sf).select("vec_id", F.create_map(key, "embedding").alias("embeddings")))


_BATCH = """batch AS (SELECT doc_id + 100 * quality AS doc_id, 'upd' || toxic AS lang, (toxic + 1)::BIGINT AS n_chars, doc_id AS seq FROM labels),
    newest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)"""


def _target(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", "n_chars")


def _batch(spark, sf):
    """Changed rows, some keys new to the target, some twice in the batch."""
    return table(spark, sf, "labels").select(
        (F.col("doc_id") + 100 * F.col("quality")).alias("doc_id"),
        F.concat(F.lit("upd"), F.col("toxic").cast("string")).alias("lang"),
        (F.col("toxic") + 1).cast("long").alias("n_chars"), F.col("doc_id").alias("seq"),
    )


@_q("upsert", f"""WITH {_BATCH} SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM newest)
    UNION ALL SELECT doc_id, lang, n_chars FROM newest""")
def _(spark, sf):
    return store.upsert(_target(spark, sf), _batch(spark, sf), "doc_id", ["seq"])


@_q("insert_new", f"""WITH {_BATCH} SELECT doc_id, lang, n_chars FROM documents
    UNION ALL SELECT doc_id, lang, n_chars FROM newest WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    return store.insert_new(_target(spark, sf), _batch(spark, sf), "doc_id", ["seq"]).drop("seq")


@_q("append_strict", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark")
def _(spark, sf):
    target = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    batch = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    return store.append_strict(target, batch, "id")


@_q("union_last_wins", """WITH u AS (SELECT doc_id AS id, text, 0 AS s FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark
    UNION ALL SELECT page_id, url, 2 FROM pages)
    SELECT id, text FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1""")
def _(spark, sf):
    parts = [
        docs(spark, sf).select(F.col("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")),
    ]
    return store.union_last_wins(parts, "id", "text")


@_q("csv_sink", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, sum(length(text))::BIGINT AS chars FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(docs(spark, sf), path)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.sum(F.length("text")).alias("chars"))


@_q("csv_scan", "SELECT doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(docs(spark, sf), path)
    return files.read_csv(spark, path, ",")


@_q("csv_errors", """SELECT kind, 2 AS expected, parsed, count(*) AS n FROM (
      SELECT CASE WHEN lang = 'de' THEN 'TooFewFields' ELSE 'TooManyFields' END AS kind,
             CASE WHEN lang = 'de' THEN 1 ELSE 3 END AS parsed FROM documents WHERE lang IN ('de', 'fr')) GROUP BY ALL""")
def _(spark, sf):
    # German rows lose a field, French rows get one too many; a quoted comma must not count
    line = (
        F.when(F.col("lang") == "de", F.col("doc_id").cast("string"))
        .when(F.col("lang") == "fr", F.concat_ws(",", "doc_id", "lang", "source"))
        .otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(',"'), "lang", F.lit(','), "source", F.lit('"')))
    )
    path = scratch_path(spark, "broken")
    docs(spark, sf).select(line.alias("doc_id,lang")).write.options(header=True, sep="\x01", quote="").csv(path)
    return files.csv_errors(spark, path, ",").groupBy("kind", "expected", "parsed").agg(F.count(F.lit(1)).alias("n"))


def _with_map(spark, sf):
    return vectors(spark, sf).select("vec_id", "label", F.create_map(F.lit("m"), "embedding").alias("embeddings"))


_VEC_SQL = "SELECT vec_id, label::BIGINT AS label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"


def _vec_result(df):
    total = F.aggregate(df["embeddings"]["m"], F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("vec_id", F.col("label").cast("long").alias("label"), F.round(total, 6).alias("total"))


@_q("json_scan", _VEC_SQL)
def _(spark, sf):
    path = scratch_path(spark, "json")
    files.write_json_gz(_with_map(spark, sf), path)
    return _vec_result(files.read_json_array(spark, path, multiline=False))


@_q("json_array_scan", _VEC_SQL)
def _(spark, sf):
    # arrays of about a thousand rows, a file each
    rows, path = _with_map(spark, sf), scratch_path(spark, "json")
    arrays = -(-rows.count() // 1000)
    texts = rows.select(F.struct(*rows.columns).alias("r"), F.pmod(F.xxhash64("vec_id"), F.lit(arrays)).alias("file")).groupBy("file").agg(
        F.to_json(F.collect_list("r")).alias("value"))
    texts.write.partitionBy("file").text(path)
    return _vec_result(files.read_json_array(spark, path))


@_q("csv_scan_mixed", """SELECT doc_id::VARCHAR AS doc_id, text, lang, CASE WHEN lang = 'de' THEN NULL ELSE source END AS source,
      CASE WHEN lang = 'de' THEN n_chars::VARCHAR END AS n_chars FROM documents""")
def _(spark, sf):
    # two sets of files, their columns in another order and not the same
    rows, path = docs(spark, sf), scratch_path(spark, "csv")
    files.write_csv(rows.filter("lang = 'de'").select("n_chars", "text", "lang", "doc_id"), f"{path}/a")
    files.write_csv(rows.filter("lang <> 'de' OR lang IS NULL").select("doc_id", "lang", "text", "source"), f"{path}/b")
    return files.read_csv(spark, f"{path}/*", ",").select("doc_id", "text", "lang", "source", "n_chars")


@_q("json_gz_sink", _VEC_SQL)
def _(spark, sf):
    path = scratch_path(spark, "json")
    files.write_json_gz(_with_map(spark, sf), path)
    schema = f"vec_id long, label int, embeddings {MAP_TYPE}"
    return _vec_result(spark.read.schema(schema).json(path))


@_q("jsonl_sink", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(docs(spark, sf), path)
    return spark.read.json(path).select("doc_id", "text", "lang", "source", "n_chars")


@_q("model_inventory", """SELECT name, sum(size)::BIGINT AS size, arg_max(quantized, url) AS quantized FROM (
      SELECT regexp_extract(url, 'example\\.(?:com|net|org)/([^/]+/[^/]+)', 1) AS name, url, length(html) AS size, '' AS quantized
      FROM pages) WHERE name <> '' GROUP BY name""")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn("size", F.length("html"))
    return files.model_inventory(pages, "url", "size", r"example\.(?:com|net|org)")


@_q("drop_system_cols", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    full = docs(spark, sf).select("doc_id", "lang", "n_chars").withColumn("order", F.lit(1)).withColumn("center", F.lit(True))
    return ops.drop_system_columns(full)


@_q("suffix_merge", "SELECT doc_id AS doc_id2, lang AS lang2, n_chars AS n_chars2 FROM documents")
def _(spark, sf):
    return ops.suffix_columns(docs(spark, sf).select("doc_id", "lang", "n_chars"))


@_q("prefix_project", 'SELECT item_id AS "bestMatch-item_id", text AS "bestMatch-text" FROM benchmark')
def _(spark, sf):
    return ops.prefix_columns(table(spark, sf, "benchmark").withColumn("score", F.lit(0.5)))


@_q("column_union", """SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'conv_id', 'turn', 'role', 'quality', 'toxic']) AS name""")
def _(spark, sf):
    # every field that some row of some table fills, found in the rows themselves
    parts = [docs(spark, sf), table(spark, sf, "conversations"), table(spark, sf, "labels")]
    rows = ops.drop_system_columns(ops.scan_many(parts))
    filled = rows.select(F.map_filter(
        F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()
    ).alias("m"))
    return ops.map_keys_union(filled, "m")


@_q("detail_project", "SELECT lang AS title, source AS description, doc_id AS id, n_chars > 1000 AS clicked, '#a9a9a9' AS color FROM documents")
def _(spark, sf):
    return ops.detail(docs(spark, sf), "lang", "source", "doc_id", F.col("n_chars") > 1000, F.lit("#a9a9a9"))


@_q("filter_unembedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    # rows rated good carry a vector already
    rated = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    have = F.when(F.col("quality") == 1, F.create_map(F.lit(HASH_MODEL), F.array(F.lit(1.0)))).cast(MAP_TYPE)
    stored = rated.withColumn("embeddings", F.coalesce(have, F.create_map().cast(MAP_TYPE)))
    return filter_unembedded(stored, HASH_MODEL).select("doc_id")


@_q("filter_dim", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def _(spark, sf):
    return vectors(spark, sf).filter(has_dim("embedding", 64)).select("vec_id", "label")


@_q("filter_regex", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)^the|tion[.,]')")
def _(spark, sf):
    return docs(spark, sf).filter(matches("text", "/^the|tion[.,]/i")).select("doc_id", "lang")


@_q("rule_tags", """SELECT doc_id, CASE WHEN regexp_matches(source, '1$') THEN 'blue' WHEN regexp_matches(n_chars::VARCHAR, '^9') THEN 'green'
    WHEN regexp_matches(lang, '(?i)^D') THEN 'red' ELSE '#a9a9a9' END AS color FROM documents""")
def _(spark, sf):
    rules = [Rule("lang", "/^D/i", "red"), Rule("lang", "/[/", "broken"), Rule("n_chars", "^9", "green"), Rule("source", " 1$ ", "blue")]
    return docs(spark, sf).select("doc_id", rule_tags(rules).alias("color"))


@_q("label_join", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return ops.label_join(docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@_q("lookup_join", """SELECT doc_id, hit, item_id AS "bestMatch-item_id", b.text AS "bestMatch-text"
    FROM (SELECT doc_id, n_chars % 50 AS hit FROM documents) LEFT JOIN benchmark b ON hit = item_id""")
def _(spark, sf):
    hits = docs(spark, sf).select("doc_id", (F.col("n_chars") % 50).alias("hit"))
    return ops.lookup_join(hits, table(spark, sf, "benchmark"), "hit", "item_id")


@_q("cluster_members", """SELECT vec_id, label, vec_id = (SELECT min(vec_id) FROM embeddings) AS clicked FROM embeddings
    WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1)""")
def _(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "label")
    clicked = ops.first_row(rows, "vec_id").first()["vec_id"]
    return ops.cluster_members(rows, "vec_id", "label", clicked)


@_q("cluster_sizes", "SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def _(spark, sf):
    return cluster_sizes(vectors(spark, sf), "label")


@_q("table_sort", "SELECT doc_id, source, n_chars FROM documents ORDER BY source DESC, doc_id")
def _(spark, sf):
    return ops.table_sort(docs(spark, sf).select("doc_id", "source", "n_chars"), "source", "doc_id")


@_q("table_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 100")
def _(spark, sf):
    return ops.table_page(docs(spark, sf).select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], 1)


_EMBED_SQL = f"WITH {hash_sql('documents', 'doc_id', 'h')} SELECT doc_id, bucket, v AS value FROM h WHERE v <> 0"


def _long_vectors(df):
    v = df.select("doc_id", F.posexplode(F.col("embeddings")[HASH_MODEL]).alias("bucket", "value"))
    return v.filter("value <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("value").cast("double").alias("value"))


@_q("embed", _EMBED_SQL)
def _(spark, sf):
    return _long_vectors(embed(docs(spark, sf), ["text"]))


def _arriving(spark, sf, name):
    """The table as a stream, be it one file or a folder of part files, partitioned or not.

    A plain path must be a folder for the stream's reader, a pattern may match either. Below a
    pattern, columns that only the folders' names hold are found where a base path is named.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("basePath", sf).parquet(f"{sf}/{name}.[p]arquet")


@_q("stream_embed", _EMBED_SQL)
def _(spark, sf):
    root = scratch_path(spark, "stream")
    db = store.Store(spark, f"{root}/tables")
    run = stream_embed(
        _arriving(spark, sf, "documents"), db, "documents", "doc_id", ["text"], "doc_id", f"{root}/checkpoint")
    run.awaitTermination()
    return _long_vectors(db.read("documents"))


@_q("stream_search", """SELECT a.vec_id AS query, b.vec_id AS hit, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a, embeddings b QUALIFY row_number() OVER (PARTITION BY a.vec_id
      ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) <= 3""")
def _(spark, sf):
    root = scratch_path(spark, "stream")
    run = stream_search(
        _arriving(spark, sf, "embeddings"), vectors(spark, sf), "vec_id", "embedding", "vec_id", "embedding", 3,
        f"{root}/hits", f"{root}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{root}/hits").select("query", "hit", F.round("score", 6).alias("score"))
