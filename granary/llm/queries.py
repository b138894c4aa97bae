"""The queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_mincut, langid, lexical, mixing, pieces, pii, quality, repeats, sharding, simhash, token_files, whitening
from .common import table

#: Production parameters.
MIX = {"weights": {"src0": 4.0}, "default_weight": 1.0, "epochs": 1.0, "seed": "mix"}
PII_KEY = b"replace with the site's key"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenised(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), **MIX)
    return mixed.select("doc_id", "source", F.col("copy_no").cast("long").alias("copy_no"), "mix_key", F.md5("text").alias("text_md5"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; round_trip: whether that gave the text back."""
    model = vocabulary("piece_bpe_32k.model")
    return pieces.round_trips(table(spark, sf_dir, "documents", "doc_id", "text"), model)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents", "doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_files, op2_mix_sources, op3_quality_rules, op4_rendezvous_shards, op5_html_mincut, op6_sentencepiece, op7_language_id, op8_pii_feistel, op9_exact_dedup, op10_simhash, op11_whitening, op12_suffix_dedup, op13_lexical, pipeline)
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH RECURSIVE per AS (
  SELECT source, count(*)::DOUBLE AS mass, CASE WHEN source = 'src0' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source),
total AS (SELECT sum(mass) AS mass, sum(weight) AS weight FROM per),
rate AS (SELECT per.source, per.weight / total.weight * total.mass / per.mass AS rate FROM per, total),
part AS (SELECT source, greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS parts, rate / greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS lam FROM rate),
cdf AS (
  SELECT source, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM part
  UNION ALL
  SELECT source, lam, k + 1, p * lam / (k + 1)::DOUBLE, c + p * lam / (k + 1)::DOUBLE FROM cdf WHERE k < 79),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
draws AS (
  SELECT d.doc_id, d.source, d.text, s.cs,
    list_transform(range(1, p.parts + 1), lambda j: (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS us
  FROM documents d JOIN part p ON d.source IS NOT DISTINCT FROM p.source JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (SELECT doc_id, source, text, list_sum(list_transform(us, lambda u: len(list_filter(cs, lambda c: c < u))))::BIGINT AS n FROM draws),
copies AS (SELECT doc_id, source, text, unnest(range(n)) AS copy_no FROM counted)
SELECT doc_id, source, copy_no, md5('mix:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS mix_key, md5(text) AS text_md5 FROM copies
"""

OP3_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
cut AS (
  SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^.!?]+', '', 'g')) AS n_stops
  FROM texts),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (
  SELECT cut.r, doc_id, len(words)::BIGINT AS n_words, coalesce(length(list_aggregate(words, 'string_agg', '')), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    n_capitals, n_stops, len(list_distinct(words)) AS n_distinct, len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_lettered
  FROM cut LEFT JOIN repeated USING (r)),
voted AS (
  SELECT *, [
    CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 50 * n_symbols <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_dup_lines = 0 AND n_lines > 1 THEN 1 ELSE 0 END,
    CASE WHEN 100 * n_capitals > 30 * word_chars THEN -1 WHEN 100 * n_capitals <= 12 * word_chars THEN 1 ELSE 0 END,
    CASE WHEN 10 * word_chars > 75 * n_words OR 10 * word_chars < 35 * n_words THEN -1 WHEN 10 * word_chars >= 40 * n_words AND 10 * word_chars <= 65 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 100 * n_distinct < 25 * n_words THEN -1 WHEN 100 * n_distinct >= 40 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 2 * n_stops > n_words OR (200 * n_stops < n_words AND n_words >= 100) THEN -1 WHEN 100 * n_stops >= 3 * n_words AND 100 * n_stops <= 30 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 100 * n_lettered < 75 * n_words THEN -1 WHEN 100 * n_lettered >= 90 * n_words THEN 1 ELSE 0 END] AS v
  FROM counted),
pattern AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
ps AS (SELECT list(v ORDER BY v) AS vs, list(n ORDER BY v) AS ns, sum(n) AS total FROM pattern),
em AS (
  SELECT 0 AS it, list_transform(vs, lambda v: 0.95::DOUBLE * pow(0.4::DOUBLE, len(list_filter(v, lambda x: x < 0)))) AS q FROM ps
  UNION ALL
  SELECT it + 1, list_transform(vs, lambda v: 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, 9), lambda j: CASE WHEN v[j] > 0 THEN ln(g[j] / b[j]) WHEN v[j] < 0 THEN ln((1 - g[j]) / (1 - b[j])) ELSE 0.0::DOUBLE END))))))
  FROM (
    SELECT it, vs,
      (list_sum(list_transform(range(1, len(ns) + 1), lambda i: ns[i] * q[i])) + 1) / (total + 2) AS good,
      list_transform(range(1, 9), lambda j: (list_sum(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN vs[i][j] > 0 THEN ns[i] * q[i] ELSE 0.0::DOUBLE END)) + 1) / (list_sum(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN vs[i][j] <> 0 THEN ns[i] * q[i] ELSE 0.0::DOUBLE END)) + 2)) AS g,
      list_transform(range(1, 9), lambda j: (list_sum(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN vs[i][j] > 0 THEN ns[i] * (1 - q[i]) ELSE 0.0::DOUBLE END)) + 1) / (list_sum(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN vs[i][j] <> 0 THEN ns[i] * (1 - q[i]) ELSE 0.0::DOUBLE END)) + 2)) AS b
    FROM em, ps WHERE it < 25)),
solved AS (SELECT unnest(vs) AS v, unnest(q) AS p FROM em, ps WHERE it = 25)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5) AS kept,
  round(p, 6) AS p_good, array_to_string(v, ',') AS votes
FROM voted JOIN solved USING (v)
"""

OP9_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM norm
"""

OP12_SQL = r"""
WITH texts AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, hex(encode(coalesce(text, ''))) AS t FROM documents),
windows AS (SELECT r, i, substr(t, 2 * i + 1, 200) AS w FROM (SELECT r, t, unnest(range(len(t) // 2 - 99)) AS i FROM texts WHERE len(t) >= 200)),
again AS (SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY r, i) > 1),
marked AS (SELECT r, i, sum(step) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 THEN 0 ELSE 1 END AS step FROM again)),
spans AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM marked GROUP BY r, run),
cut AS (SELECT r, sum(b - a) AS n, count(*) AS k, [0] || list(b ORDER BY a) AS starts, list(a ORDER BY a) AS stops FROM spans GROUP BY r)
SELECT doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  CASE WHEN k IS NULL THEN sha256(unhex(t)) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda j: substr(t, 2 * starts[j] + 1, 2 * (coalesce(stops[j], len(t) // 2) - starts[j]))), ''))) END AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""

OP13_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT doc_id, r, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, s.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weight USING (term) JOIN postings p USING (term) JOIN sized s ON p.r = s.r, total GROUP BY item_id, doc_id, s.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express it: XXH64, CRC-32, tokenizers, suffix automata and permutations it can't."""
    return {"op2_mix_sources": OP2_SQL, "op3_quality_rules": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op12_suffix_dedup": OP12_SQL, "op13_lexical": OP13_SQL}
