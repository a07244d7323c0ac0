"""The opN queries: each operator over its whole table, in the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .exact_dedup import exact_groups
from .fingerprints import next_fingerprints
from .mixing import mix_sources
from .ngram_join import jaccard_classes
from .packing import pack
from .secret_scan import secret_report
from .token_counts import token_counts
from .token_files import token_files


def vocabulary(name: str) -> str:
    """A public vocabulary file; it is read where it is installed and never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more. Texts without words link with nothing; see ``jaccard_classes`` for null and repeated ids."""
    return jaccard_classes(documents(spark, sf_dir), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts, one row per document; null counts as empty. See ``exact_groups``."""
    groups = exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 tokens; a null text is its end token. See ``pack``."""
    pieces = pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document; null and empty texts count zero. See ``token_counts``."""
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to bit-packed files and read back; a null text is its end id. See ``token_files``."""
    files = token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2, with_ids=False)
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; null counts as empty. See ``next_fingerprints``."""
    return next_fingerprints(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document with corpus-wide ownership; null counts as empty. See ``secret_report``."""
    return secret_report(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document by a model that never saw the held-out ones; a text without letters is ``und``. See ``identify``."""
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a model that never saw the held-out labels; null is scored as empty. See ``quality_scores``."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, quality.train(docs, labels))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at the same share of as many rows as there are, in the order of a global shuffle. See ``mix_sources``."""
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "copy", "copies", "order_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_token_files": op8_token_files,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_secret_scans": op10_secret_scans,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id""",
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t""",
    "op7_mixing_sources": r"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE / n::DOUBLE AS mean FROM n),
k AS (SELECT source, j, exp(-mean) * CASE WHEN j = 0 THEN 1 ELSE list_product(list_transform(range(1, j + 1), lambda i: mean / i)) END AS chance
      FROM r, range(0, 200) t(j)),
c AS (SELECT source, j, sum(chance) OVER (PARTITION BY source ORDER BY j) AS cum FROM k),
u AS (SELECT doc_id, source, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
m AS (SELECT doc_id, u.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cum <= u.u) AS copies FROM u),
x AS (SELECT doc_id, source, copies, unnest(range(0, copies)) AS copy FROM m)
SELECT doc_id, source, copy, copies, md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || copy || '|order') AS order_key FROM x""",
    "op10_secret_scans": r"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS rid, coalesce(source, '') AS owner, coalesce(text, '') AS x FROM documents),
m AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, 6 AS fewest, string_split_regex(x, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') AS g, regexp_extract_all(x, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') AS w,
         regexp_extract_all(x, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM t
  UNION ALL SELECT rid, 'access', 1, 20, string_split_regex(x, 'AKIA[A-Z0-9]+'), regexp_extract_all(x, 'AKIA[A-Z0-9]+'), regexp_extract_all(x, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT rid, 'hex', 2, 24, string_split_regex(x, '[0-9a-f]{24,}'), regexp_extract_all(x, '[0-9a-f]{24,}'), regexp_extract_all(x, '[0-9a-f]{24,}') FROM t
  UNION ALL SELECT rid, 'live', 3, 32, string_split_regex(x, '[A-Za-z0-9+/_-]{32,}'), regexp_extract_all(x, '[A-Za-z0-9+/_-]{32,}'), regexp_extract_all(x, '[A-Za-z0-9+/_-]{32,}') FROM t),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
p AS (
  SELECT rid, kind, rank, v[i] AS value, (list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(w[1:i], lambda y: length(y))))::BIGINT AS stop, length(w[i]) AS size
  FROM i WHERE length(v[i]) >= fewest),
q AS (SELECT rid, kind, rank, value, stop - size AS start, stop FROM p
      WHERE kind <> 'live' OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')),
c AS (SELECT DISTINCT rid, value, stop - length(value) AS start, stop FROM q),
o AS (SELECT value FROM c JOIN t USING (rid) GROUP BY value HAVING count(DISTINCT owner) <= 1 AND count(DISTINCT rid) <= 3),
s AS (SELECT rid, kind, rank, start, stop FROM q WHERE kind <> 'live' UNION ALL SELECT rid, 'live', 3, start, stop FROM c WHERE value IN (SELECT value FROM o)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (kind <> 'live') AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)""",
}
