"""The operators applied to whole tables of a folder, under their registered names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recon.llm import (decontamination, jaccard_join, kd_search, kd_sharding, mixing, packing, pii, prefix_trie, spotsigs,
                       substring_dedup, token_counts, toxicity, whitening)
from recon.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) r
WHERE rank <= 5"""

#: Unsigned CRC-32 of a number's digits, bit by bit: the reflected polynomial, all ones before and after.
_CRC32 = """xor(list_reduce([CAST(ord(substr(CAST({0} AS VARCHAR), k, 1)) AS BIGINT) FOR k IN range(1, length(CAST({0} AS VARCHAR)) + 1)],
    lambda crc, byte: list_reduce(range(8), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295)"""
_BLANK = r"[^\x20\x09-\x0D]+"

PREFIX_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
plans AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h, max(pos) AS n FROM turns GROUP BY conv_id),
placed AS (
  SELECT p.conv_id, t.pos AS part, 0 AS own, t.said FROM plans p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.h
  UNION ALL SELECT p.conv_id, t.pos, 1, t.said FROM plans p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h),
lists AS (
  SELECT p.conv_id, coalesce(list(said ORDER BY own, part) FILTER (WHERE said IS NOT NULL), []) AS said
  FROM plans p LEFT JOIN placed USING (conv_id) GROUP BY p.conv_id),
members AS (
  SELECT conv_id, depth, said[1:depth] AS prefix, depth = len(said) AS ends
  FROM lists, (SELECT unnest(range(0, (SELECT max(len(said)) + 1 FROM lists))) AS depth) WHERE depth <= len(said)),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM members),
nodes AS (
  SELECT node, depth, any_value(prefix) AS prefix, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM named GROUP BY node, depth),
linked AS (
  SELECT n.*, up.node AS parent,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '{_BLANK}')) END AS saved
  FROM nodes n LEFT JOIN named up ON up.conv_id = n.node AND up.depth = n.depth - 1),
fanned AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
known AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN fanned USING (node, depth)),
sums AS (
  SELECT above.node, above.depth, sum(CAST(k.n_children = 0 AS BIGINT)) AS n_leaves, sum(k.saved) AS saved_tokens
  FROM known k JOIN named above ON above.conv_id = k.node AND above.depth <= k.depth GROUP BY 1, 2)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM known JOIN sums USING (node, depth)"""

_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}')"

WINNOWING_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
passages AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, words[begins : begins + least(10, len(words)) - 1] AS passage
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS begins FROM items WHERE len(words) > 0)),
places AS (SELECT place, size, words, unnest(range(1, len(words) - size + 2)) AS begins FROM docs, (SELECT DISTINCT size FROM passages)),
hits AS (
  SELECT DISTINCT place, begins, p.size, item_id
  FROM (SELECT place, size, begins, words[begins : begins + size - 1] AS passage FROM places) w JOIN passages p USING (size, passage)),
marked AS (
  SELECT place, count(DISTINCT word) AS n_hit FROM (SELECT place, unnest(range(begins, begins + size)) AS word FROM hits) GROUP BY place),
named AS (
  SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT place, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY place)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (place) LEFT JOIN named USING (place)"""


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary(PIECE_MODEL))


def op4_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op6_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return kd_sharding.shard(table(spark, folder, "documents"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, folder, "documents"))


def op8_kd_search(spark: SparkSession, folder: str) -> DataFrame:
    return kd_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(WORD_MODEL))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    known = (op1_toxicity, op2_substring_dedup, op3_token_counts, op4_spotsigs, op5_pii, op6_kd_sharding,
             op7_jaccard_join, op8_kd_search, op9_mixing, op10_packing, op11_prefix_trie, op12_whitening, op13_winnowing)
    return {f.__name__: f for f in known} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_kd_search": TOP_K_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op13_winnowing": WINNOWING_SQL}
