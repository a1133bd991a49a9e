"""The registered queries of the operators, each over its whole table, and the SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embed_dedup, hard_negatives, html_extract, langid, lattice, minhash, packing, pii, piece_codec, quality, sharding, token_count, whitening,
)

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf), public_tokenizers.path(WORD_BPE), keep_ids=False)


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    out = pii.pseudonymise(docs, counts="found")
    return out.select("doc_id", "text", *[F.col(f"found.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS])


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return langid.identify(docs, langid.fit_model(docs))


def op5_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf), size=2)


def op6_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def unigram_pieces(name: str = PIECES) -> list[tuple[str, float]]:
    """The vocabulary and scores of a model file, as a unigram vocabulary."""
    return [(p, s) for p, s, _ in piece_codec.read_pieces(public_tokenizers.path(name))]


def op7_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf), unigram_pieces())


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf))


def op9_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    return piece_codec.encode_texts(_documents(spark, sf), public_tokenizers.path(PIECES), keep=False)


def op10_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_texts(_documents(spark, sf), piece_codec.read_pieces(public_tokenizers.path(PIECES)))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_text(spark.read.parquet(f"{sf}/pages.parquet"), html_extract.fit())


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 change to the next of the ten labels first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_packing, op3_pii, op4_language, op5_minhash, op6_embedding_dedup, op7_token_count,
        op8_sharding, op9_piece_codec, op10_lattice_score, op11_whitening,
        op12_html_extraction, op13_hard_negatives, pipeline,
    )
}

_DOC_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _gram_cte(n: int) -> str:
    """rep{n}(r, p): word places inside n-word windows found twice or more in their text."""
    return f"""g{n} AS (SELECT r, i, array_to_string(w[i:i + {n - 1}], ' ') AS g
               FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)),
        rep{n} AS (SELECT DISTINCT r, unnest(range(i, i + {n})) AS p FROM (
               SELECT r, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY r, g) > 1))"""


QUALITY_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_DOC_WORDS} AS w FROM documents),
      {', '.join(_gram_cte(n) for n in sorted({quality.BASE_GRAM, *quality.GRAM_SHARES}))},
      words AS (SELECT r, p, len(w[p]) AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
      lines AS (SELECT r, len(line) AS c, row_number() OVER (PARTITION BY r, line) > 1 AS again
                FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
                WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
      m AS (SELECT doc_id, len(w) AS n_words,
        coalesce((SELECT sum(c) FROM words x WHERE x.r = d.r), 0)::BIGINT AS word_chars,
        len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        (SELECT count(*) FROM lines x WHERE x.r = d.r AND again) AS n_dup_lines,
        (SELECT count(*) FROM rep{quality.BASE_GRAM} x WHERE x.r = d.r) AS n_repeat_words,
        {''.join(f'''coalesce((SELECT sum(c) FROM words x JOIN rep{n} y ON x.r = y.r AND x.p = y.p WHERE x.r = d.r), 0)::BIGINT
        AS gram_chars_{n}, ''' for n in quality.GRAM_SHARES)}
        coalesce((SELECT sum(c) FROM lines x WHERE x.r = d.r), 0)::BIGINT AS line_chars,
        coalesce((SELECT sum(c) FROM lines x WHERE x.r = d.r AND again), 0)::BIGINT AS dup_line_chars
        FROM d),
      b AS (SELECT *, n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {round(100 * quality.BASE_SHARE)} * n_words AS base_failed
            FROM m)
      SELECT *, NOT base_failed AND dup_line_chars * 100 <= {round(100 * quality.LINE_SHARE)} * line_chars
        {' '.join(f'AND gram_chars_{n} * 100 <= {round(100 * s)} * word_chars' for n, s in quality.GRAM_SHARES.items())} AS kept
      FROM b"""

_COMPONENTS = """reach AS (SELECT id, id AS other FROM nodes UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.other)"""

MINHASH_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x20\x09-\x0D]+') AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
      links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
                JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                GROUP BY ALL HAVING 100 * count(*) >= 80 * (max(na.n) + max(nb.n) - count(*))),
      nodes AS (SELECT doc_id AS id FROM d), {_COMPONENTS}
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
      FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.id = d.doc_id"""

VECTORS_SQL = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b
                ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
      nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
      SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE u = n.id) AS n_links, c.component_id, n.id = c.component_id AS kept
      FROM nodes n JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY 1) c USING (id)"""

NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label)),
      pos AS (SELECT a, b, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
      SELECT pos.a AS anchor_id, pos.b AS positive_id, (row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b))::INT AS rank,
        n.b AS negative_id, pos.s AS positive_score, n.s AS negative_score
      FROM pos JOIN p n ON n.a = pos.a AND NOT n.same AND 80 * pos.s <= 100 * n.s AND n.s <= pos.s
      QUALIFY row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) <= 5"""

SQL = {
    "op13_hard_negatives": NEGATIVES_SQL,
    "op1_quality_rules": QUALITY_SQL, "op5_minhash": MINHASH_SQL, "op6_embedding_dedup": VECTORS_SQL,
}
