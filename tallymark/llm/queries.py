"""The registered query of each operator and its DuckDB twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, fuzzylines, hardneg, mixing, neardup, packing, quality, substrings, suffixes, tokenfile, topk, urls

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY).drop("ids")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(spark, tokenfile.write_tokens(_table(spark, sf_dir, "documents"), VOCABULARY))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_conversations(rows))


URL_RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the pages whose number ``labels`` calls toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return urls.judge(pages, pages.join(toxic, "page_id", "left_semi").select("url"), URL_RULES).drop("url")


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE WHEN host <> '' THEN concat(regexp_replace(host, '^www\.|:\d*$', '', 'g'), regexp_replace(path, '(\.html?|/+)$', '')) END AS key FROM cut),
listed AS (SELECT DISTINCT key FROM ruled WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND key IS NOT NULL)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
  WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON l.key = r.key
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzylines.remove_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Domains of the labelled table and their share of the mixture.
MIXTURE = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", named.alias("domain")).where("domain is not null")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), domains(_table(spark, sf_dir, "labels")), MIXTURE).drop("text")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(c.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *quality.FIGURES, "kept")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(substring(h, 2 * i - 1, 400)) AS k FROM (SELECT r, h, unnest(range(1, length(h) // 2 - 198)) AS i FROM d) AS places),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM m) AS marked),
s AS (SELECT r, g, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY r, g),
p AS (SELECT r, g, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY g), 0) AS done FROM s),
k AS (SELECT p.r, sum(b - a + 1) AS n_removed, count(*) AS n_spans, concat(string_agg(substring(text_hex, 2 * done + 1, 2 * (a - done - 1)), '' ORDER BY g), substring(any_value(text_hex), 2 * max(b) + 1)) AS kept
  FROM (SELECT p.*, d.h AS text_hex FROM p JOIN d ON d.r = p.r) AS p GROUP BY p.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, w[i:i + k - 1] AS p FROM starts, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 100),
c AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
cuts AS (SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, total.n,
    CAST((1000 * CAST(c.a AS HUGEINT) * CAST(total.n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN total ON total.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, p[s:s + m - 1] AS p, max(a) AS longer FROM f, range(2, 5) AS t(m), range(1, 5) AS u(s) WHERE m < len(p) AND s + m - 1 <= len(p) GROUP BY ALL),
kept AS (SELECT z.* FROM lowest z LEFT JOIN subs ON subs.lang = z.lang AND subs.p = z.p WHERE subs.longer IS NULL OR subs.longer < z.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
  array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept QUALIFY rank <= 2000
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.c, c.c) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_substrings": op2_substrings,
    "op3_token_file": op3_token_file,
    "op4_chat": op4_chat,
    "op5_urls": op5_urls,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_suffixes": op11_suffixes,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op5_urls": OP5_SQL, "op9_topk": OP9_SQL, "op11_suffixes": OP11_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
