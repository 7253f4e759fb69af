"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, langid, lmscore, minhash, packing, pages, pii, sharding, toxicity
from .common import read


def op1_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op3_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), leaves=40)


def op4_latent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(read(spark, sf_dir, "documents"))


def op6_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read(spark, sf_dir, "pages"))


def op8_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_boosted_candidates, op2_superminhash, op3_kd_tree, op4_latent_semantic, op5_brown_classes, op6_epsilon_grid, op7_host_consensus, op8_rank_order, op9_best_fit, op10_pattern_grammar)
    return {f.__name__: f for f in own}


#: Every pair of documents that shares a shingle is counted, and components are followed link by link.
NEAR_SQL = """WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
sized AS (SELECT doc_id, len(g) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(g) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM sized UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.to_id = b.x)
SELECT s.doc_id, s.n AS n_shingles, min(r.to_id) AS component_id, s.doc_id = min(r.to_id) AS kept FROM sized s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n"""
VECTOR_SQL = """WITH RECURSIVE
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
valid AS (SELECT * FROM vectors WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS to_id FROM vectors UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.to_id = l.x),
counted AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.to_id) AS component_id, v.vec_id = min(r.to_id) AS kept FROM vectors v JOIN reach r USING (vec_id) LEFT JOIN counted c USING (vec_id) GROUP BY v.vec_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators hold fitted models, trees of packed bins or parsers, which SQL can't express."""
    return {"op2_superminhash": NEAR_SQL, "op6_epsilon_grid": VECTOR_SQL}
