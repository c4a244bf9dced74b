"""The corpus operators' queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.llm import bpe, embeddings, fim, langid, mixing, multisethash, pii, prefixtrie, simhash, substrings, topk, toxicity, urlfilter
from ranklane.llm.common import Scratch, table

#: The vocabulary file of op3 and of the pipeline's last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark)))


def op2_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, ids=False, remembered=160_000_000)


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark)))


def op6_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"), Scratch(spark))
    return planned.select("row.doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), "_mix.copies")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("row.doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisethash.compare_edits(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")), Scratch(spark))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embedding_tiles": op2_embedding_tiles,
    "op3_bpe": op3_bpe,
    "op4_fm_index": op4_fm_index,
    "op5_pii": op5_pii,
    "op6_url_words": op6_url_words,
    "op7_compression_toxicity": op7_compression_toxicity,
    "op8_pareto_mix": op8_pareto_mix,
    "op9_langid": op9_langid,
    "op10_multiset_hash": op10_multiset_hash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_topk": op13_exact_topk,
}

# crc32 as bits: each byte goes through eight shifts
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1), lambda k: ascii(s[k])::BIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)),
turns AS (SELECT ids.c, 0 AS part, t.i, t.k, t.b FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND t.i < ids.h UNION ALL SELECT ids.c, 1, t.i, t.k, t.b FROM ids JOIN t ON t.c = ids.c AND t.i >= ids.h),
lists AS (SELECT ids.c, coalesce(list(k ORDER BY part, i) FILTER (WHERE k IS NOT NULL), []) AS ks, list(b ORDER BY part, i) FILTER (WHERE k IS NOT NULL) AS bs FROM ids LEFT JOIN turns USING (c) GROUP BY ids.c),
m AS (SELECT c, unnest(range(0, len(ks) + 1)) AS d, ks, bs FROM lists),
p AS (SELECT c, d, array_to_string(ks[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, d = len(ks) AS ended FROM m),
n AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '') AS ends FROM p GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
sums AS (SELECT p.node, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.b) AS saved FROM full_n f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY p.node)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_n f JOIN sums s USING (node) LEFT JOIN full_n u ON u.node = f.up""",
    "op12_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op13_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
