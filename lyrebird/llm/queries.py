"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lyrebird.llm import vectors
from lyrebird.llm.balltree import exact_top_k
from lyrebird.llm.bpe import round_trip
from lyrebird.llm.conversations import prefix_trie
from lyrebird.llm.huffman import huffman_ids
from lyrebird.llm.licenses import license_scan
from lyrebird.llm.mixing import mix
from lyrebird.llm.packing import pack, pieces
from lyrebird.llm.pii import find_pii
from lyrebird.llm.quality import quality_scores
from lyrebird.llm.resampling import resample
from lyrebird.llm.sharding import hilbert_shards
from lyrebird.llm.simhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(_table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (op1_sharding, op2_huffman, op3_bpe, op4_licenses, op5_embeddings, op6_simhash, op7_quality, op8_packing, op9_topk, op10_pii, op11_trie, op12_mixing, op13_resampling)
    return {f.__name__: f for f in known}


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

_LINKS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_USABLE}),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 't') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 AS turn FROM d GROUP BY k),
w AS (SELECT k, source_size, CAST(CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, k) AS i FROM w),
b AS (
  SELECT o.i - 1 AS stopped, w, source_size, 1.5 * (SELECT CAST(sum(source_size) AS BIGINT) FROM o) - 2 * coalesce((SELECT CAST(sum(source_size) AS BIGINT) FROM o p WHERE p.i < o.i), 0) AS budget,
    (SELECT sum(w) FROM o p WHERE p.i >= o.i) AS rest FROM o),
l AS (SELECT budget, rest FROM b WHERE w * CAST(budget AS DOUBLE) / rest <= 2 * source_size ORDER BY stopped LIMIT 1),
t AS (
  SELECT k, source_size, CASE WHEN w * CAST(budget AS DOUBLE) / rest > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * CAST(budget AS DOUBLE) / rest END AS target
  FROM w CROSS JOIN l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT k, h, sum(size) AS size FROM d GROUP BY k, h),
r AS (SELECT g.k, h, size, sum(size) OVER (PARTITION BY g.k ORDER BY h) AS reached, target - whole * source_size AS need FROM g JOIN n ON n.k = g.k),
c AS (SELECT k, min(CASE WHEN reached - need < need - (reached - size) THEN h + 1 ELSE h END) AS below FROM r WHERE need > 0 AND reached > need GROUP BY k),
m AS (
  SELECT d.*, source_size, target, CASE WHEN size = 0 THEN 0 WHEN h < coalesce(below, 0) THEN whole + 1 ELSE whole END AS repeats
  FROM d JOIN n ON n.k = d.k LEFT JOIN c ON c.k = d.k)
SELECT doc_id, source, size, source_size, target, CAST(repeats AS BIGINT) AS repeats, CAST(size * repeats AS BIGINT) AS taken FROM m
"""

_TRIE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t),
i AS (SELECT conv_id, count(*) AS n_own, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS name FROM o GROUP BY conv_id),
h AS (
  SELECT conv_id, n_own, base, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda k: CAST(ord(substr(name, CAST(k AS INTEGER), 1)) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
    )) % 4 AS h FROM i),
r AS (
  SELECT h.conv_id, o.place AS depth, role, text FROM h JOIN o ON o.conv_id = h.base AND o.place <= h.h
  UNION ALL
  SELECT h.conv_id, o.place - h.h + least(h.h, coalesce(f.n_own, 0)) AS depth, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.place > h.h LEFT JOIN h f ON f.conv_id = h.base),
p AS (
  SELECT conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM h),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) AS words FROM p GROUP BY path, depth),
k AS (SELECT substr(path, 1, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
s AS (
  SELECT p.path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM g JOIN p ON p.conv_id = g.conv_id AND p.depth <= g.depth GROUP BY p.path),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY path)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, g.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM g JOIN s ON s.path = g.path LEFT JOIN n u ON g.depth > 0 AND u.path = substr(g.path, 1, length(g.path) - 64) LEFT JOIN e ON e.path = g.path
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; tests hold the other operators against plain versions."""
    return {"op5_embeddings": _LINKS, "op9_topk": _TOP_K, "op11_trie": _TRIE, "op12_mixing": _MIX}
