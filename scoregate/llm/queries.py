"""One query for each operator of this subpackage, over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoregate.llm import bpe, gam, html_text, merkle, mixing, quality_rules, warc
from scoregate.llm.collocations import collocations
from scoregate.llm.common import Scratch
from scoregate.llm.embedding_dedup import near_duplicates
from scoregate.llm.language_model import language_scores
from scoregate.llm.license_scan import license_scan
from scoregate.llm.ngram_jaccard import ngram_jaccard_groups
from scoregate.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM sym UNION SELECT reach.doc_id, sym.y FROM reach JOIN sym ON sym.x = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""


@query("op1_ngram_jaccard", OP1_SQL)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, vocabulary(), keep_text=False)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=512)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"), source="source", weights=(5, 2, 1), repeats=3)


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, sha256(payload) AS k FROM p),
o AS (SELECT k, max(page_id) AS owner FROM f GROUP BY k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM f JOIN o USING (k)
"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_facts(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98::DOUBLE),
reach AS (SELECT x AS vec_id, y AS r FROM links UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id),
many AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(many.n, 0)::BIGINT AS n_links, coalesce(least(r, e.vec_id), e.vec_id) AS component_id, coalesce(least(r, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN many ON many.vec_id = e.vec_id LEFT JOIN least ON least.vec_id = e.vec_id
"""


@query("op4_embedding_dedup", OP4_SQL)
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


@query("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
d AS (
  SELECT doc_id, source, text,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_transform(range(len(doc_id::VARCHAR)), lambda i: unicode(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 0 AS tampered
  FROM documents, crc),
f AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM f),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, any_value(level) AS level, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM nodes WHERE n > 1 GROUP BY tree, pos // 16)),
roots AS (
  SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos, h, count(*) OVER () FROM (
    SELECT any_value(level) AS level, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM roots WHERE n > 1 GROUP BY pos // 16)),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
steps AS (
  SELECT l.doc_id, l.leaf, l.tree, l.pos AS leaf_pos, s.level,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (16 ** s.level)::BIGINT), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (16 ** s.level)::BIGINT), '') AS after
  FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n > 1 AND s.pos // 16 = l.pos // (16 ** (s.level + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.leaf, l.tree, l.pos, g.height + s.level,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.tree // (16 ** s.level)::BIGINT), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.tree // (16 ** s.level)::BIGINT), '')
  FROM leaves l JOIN heights g ON g.tree = l.tree JOIN roots s ON s.n > 1 AND s.pos // 16 = l.tree // (16 ** (s.level + 1))::BIGINT
  GROUP BY ALL),
ways AS (
  SELECT tree, leaf_pos, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a FROM steps GROUP BY tree, leaf_pos),
root AS (SELECT h AS root FROM roots WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.root,
  sha256(coalesce(array_to_string(list_transform(w.b, lambda x, i: x || w.a[i]), ''), '')) AS proof_sha256,
  list_reduce(coalesce(list_transform(range(len(w.b)), lambda i: i::VARCHAR), []::VARCHAR[]), lambda h, i: sha256(w.b[i::INT + 1] || h || w.a[i::INT + 1]), coalesce(l.changed, l.leaf)) AS folded_root,
  folded_root = r.root AS verified
FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n = 1 CROSS JOIN root r LEFT JOIN ways w ON w.tree = l.tree AND w.leaf_pos = l.pos
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = (merkle.is_tampered(F.col("doc_id")), "text", merkle.lowered_text())
    out = merkle.merkle_manifest(table(spark, sf_dir, "documents"), tampered=changed)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: struct_pack(p := array_to_string(w[i:i + k - 1], ' '), b := (i > 1)::INT, e := (i + k - 1 < len(w))::INT))) AS g
  FROM words, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, g.p AS phrase, count(*) AS a, sum(g.b)::BIGINT AS n_before, sum(g.e)::BIGINT AS n_after FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cuttable AS (
  SELECT lang, k, phrase, a, n_before, n_after,
    unnest(list_transform(range(1, k), lambda i: struct_pack(cut := i, lp := array_to_string(w[1:i], ' '), rp := array_to_string(w[i + 1:], ' ')))) AS c
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10)),
parted AS (SELECT lang, phrase, a, n_before, n_after, c.cut AS cut, c.lp AS lp, c.rp AS rp FROM cuttable),
cuts AS (
  SELECT p.*, l.a AS l, r.a AS r, ((1000000::HUGEINT * p.a * p.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM parted p JOIN f l ON l.lang = p.lang AND l.phrase = p.lp JOIN f r ON r.lang = p.lang AND r.phrase = p.rp),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM f WHERE k = 3 AND a >= 10)),
covered AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
left_over AS (SELECT c.* FROM lowest c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase AND 100 * v.most >= 50 * c.a WHERE v.phrase IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score, n_before, n_after FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, covered_percent=50, most=2000)
