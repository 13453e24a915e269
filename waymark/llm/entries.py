"""The registered queries of the text operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import token_counts

    return token_counts.section_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import quality_model

    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"), html_text.fit(spark))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import rules

    return rules.rule_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import licenses

    return licenses.license_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import decontam

    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import spelling

    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm import ngram_join

    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_warc, op3_best_fit_packing, op4_quality_classifier, op5_html_text, op6_quality_rules, op7_simhash, op8_license_scan, op9_language_id, op10_decontamination,
        op11_spelling_variants, op12_embedding_whitening, op13_ngram_jaccard,
        pipeline,
    )
}

#: Operator 6. Every threshold is a comparison of whole numbers, so both engines give the same verdict.
OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] || chr(31) || w[i+3] || chr(31) || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM again) GROUP BY doc_id),
doubled AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d WHERE len(w) >= 2)
  WHERE w[i] = w[i-1] GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_shouts,
    length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(d.text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
    coalesce(lines.n_lines, 0) AS n_lines, coalesce(doubled.n, 0) AS n_doubled
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN doubled USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
    OR 10 * n_symbols > n_words OR 5 * n_shouts > n_words OR 10 * n_upper > 3 * n_letters OR 10 * n_letters < 6 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_doubled > n_words) AS kept
FROM s
"""

#: Operator 2: what the archives must give back, from the pages alone.
OP2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the reversed polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


#: Operator 11: words by hashed runs, near words by what is left when a code point is taken out, roots by following forms.
OP11 = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
bytes AS (SELECT r, c, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT r, c, hex(encode(doc_id || ':' || r)) AS h FROM runs)),
hashed AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, (TABLE)[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM bytes),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
apart AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.k = b.k AND a.word <> b.word UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.gap = w.word UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.gap = w.word),
near AS (SELECT word, count(*) AS n_near, min({'m': -m, 'o': other}) AS best FROM (SELECT apart.word, other, words.n AS m FROM apart JOIN words ON words.word = apart.other) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.o END AS form, CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS root, 1 AS k FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r ON r.word = f.word
""".replace("TABLE", f"{_crc_table()}::BIGINT[]")

#: Operator 13: sets of shingles, pairs by common shingles of different sets, components by what can be reached.
OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i+3], ' '))) END AS l FROM d),
one AS (SELECT doc_id, len(l) AS n, unnest(l) AS g FROM s),
sets AS (SELECT doc_id, n, md5(array_to_string(list_sort(l), chr(10))) AS h FROM (SELECT doc_id, len(l) AS n, l FROM s) WHERE n > 0),
first AS (SELECT h, min(doc_id) AS doc_id FROM sets GROUP BY h),
rare AS (SELECT one.doc_id, n, g FROM one JOIN first USING (doc_id)),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS both_n, count(*) AS k FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * k >= 85 * (both_n - k) UNION ALL SELECT f.doc_id, sets.doc_id FROM sets JOIN first f USING (h) WHERE sets.doc_id <> f.doc_id),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT s.doc_id, len(l)::BIGINT AS n_shingles, coalesce(least(s.doc_id, r.root), s.doc_id) AS component_id FROM s LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_warc": OP2, "op6_quality_rules": OP6, "op11_spelling_variants": OP11, "op13_ngram_jaccard": OP13}
