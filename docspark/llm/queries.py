"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, line_dedup, mixing, ngram_join, packing, pieces, quality, suffix_dedup, token_counts, toxicity, url_reputation, whitening
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 4).alias("target"), F.round("rate", 6).alias("rate"), "copies", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents")).drop("row")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(read(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge_urls(read(spark, sf_dir, "pages"), outcomes)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents")).drop("path_words")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS c FROM r GROUP BY 1) m USING (doc_id)
"""

_OP4 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(content) AS text_sha256,
       chars::BIGINT AS n_chars
FROM n WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id)
"""

#: Shared by op5's oracle and the pipeline's.
QUALITY_SQL = r"""
q_words AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), q_grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words)
), q_hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_grams) WHERE c > 1
), q_repeat AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q_hits) GROUP BY 1
), q_lines AS (
  SELECT doc_id, host, text, l, len(lw) AS nw, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT doc_id, host, text, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM q_words))
  WHERE len(lw) > 0
), q_dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM q_lines GROUP BY 1
), q_boiler AS (
  SELECT host, norm FROM q_lines GROUP BY 1, 2 HAVING count(DISTINCT text) > 8
), q_removed AS (
  SELECT doc_id, sum(nw)::BIGINT AS n FROM q_lines JOIN q_boiler USING (host, norm) GROUP BY 1
), q_counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS removed_words
  FROM q_words d LEFT JOIN q_dup u USING (doc_id) LEFT JOIN q_repeat r USING (doc_id) LEFT JOIN q_removed x USING (doc_id)
), q_verdict AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, removed_words,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - removed_words) * 100 < n_words * 30) AS kept
  FROM q_counts
)
"""

_OP8 = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), l AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, CASE WHEN regexp_matches(name, 'SECOND') THEN 2 ELSE 1 END AS k, string_split(name, '.') AS parts FROM h0),
h AS (SELECT host, n, good, array_to_string(parts[greatest(1, len(parts) - k + 1):], '.') AS suffix, array_to_string(parts[greatest(1, len(parts) - k):], '.') AS domain FROM h1),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY 1),
s AS (SELECT suffix, (k * m + good) / (k + n) AS suffix_mean FROM s0, (SELECT STRENGTH AS k FROM s0 WHERE n > 0)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(suffix_mean) AS m FROM h JOIN s USING (suffix) GROUP BY 1, 2),
d AS (SELECT domain, suffix, (k * m + good) / (k + n) AS domain_mean FROM d0, (SELECT STRENGTH AS k FROM d0 WHERE n > 0)),
g0 AS (SELECT host, n, good, domain_mean AS m FROM h JOIN d USING (domain, suffix)),
g AS (SELECT host, (k * m + good) / (k + n) AS mean, k + n AS total FROM g0, (SELECT STRENGTH AS k FROM g0 WHERE n > 0)),
v AS (SELECT page_id, host, path, mean, greatest(0.0, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1))) AS lower, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM h) AS top,
  CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN g USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower < 0.8 * top THEN 'block' ELSE 'allow' END AS verdict,
       round(mean, 6) AS good_rate, round(lower, 6) AS lower_bound FROM v
"""
_STRENGTH = """CASE WHEN sum(n * m * (1 - m)) > sum(m * (1 - m)) THEN greatest(1.0, least(1000.0, 1 / greatest((sum(n * pow(good / n - m, 2)) - sum(m * (1 - m))) / (sum(n * m * (1 - m)) - sum(m * (1 - m))), 1e-6) - 1)) ELSE 1000.0 END"""

_OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, 4)) AS k FROM s),
f AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f FROM g WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
d AS (
  SELECT DISTINCT x.lang, x.g FROM c x JOIN (
    SELECT lang, g[1:2] AS part, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3
  ) y ON x.lang = y.lang AND x.g = y.part WHERE 100 * y.a >= 50 * x.a
), e AS (
  SELECT c.lang, c.g, c.k, c.a, j, unnest([c.g[1:j]]) AS lg, unnest([c.g[j + 1:]]) AS rg
  FROM (SELECT lang, g, k, a, unnest(range(1, k)) AS j FROM c) c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.g = c.g)
), v AS (
  SELECT e.lang, e.g, e.a, l.f AS l, r.f AS r, ((1000000::HUGEINT * e.a * e.a) // (l.f::HUGEINT * r.f))::BIGINT AS score, j
  FROM e JOIN f l ON l.lang = e.lang AND l.g = e.lg JOIN f r ON r.lang = e.lang AND r.g = e.rg
), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {
    "op3_ngram_join": _OP3,
    "op4_exact_dedup": _OP4,
    "op5_quality": f"WITH {QUALITY_SQL} SELECT * FROM q_verdict",
    "op13_collocations": _OP13,
    "op8_url_filter": _OP8.replace("SECOND", url_reputation.TWO_LABELS).replace("STRENGTH", _STRENGTH),
}
