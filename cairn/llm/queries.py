"""Queries op1 to op10 over the driver tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, exact_dedup, html_text, mixing, pii, secret_scan, simhash, substring_dedup, token_files, toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: pattern spans, and terms whose disclosure passes the threshold."""
    return pii.digest(pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, by suffix arrays."""
    found = decontaminate.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def tokenizer_path() -> str:
    """The public vocabulary file that op3 encodes with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_files.read(token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels outside the held-out fold."""
    return toxicity.predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents by the stateful stream."""
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of their links."""
    found = simhash.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", simhash.hexadecimal(found.fp).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: pattern spans, and spans of the conditional random field."""
    return secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto order sampling of all documents to the sources' targets."""
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that stood earlier, by the log-structured window index."""
    return substring_dedup.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_files": op3_token_files,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL = {
    "op9_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS stop FROM s0
), s2 AS (
  SELECT *, stop / w AS r, 1.5::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS stopped,
    sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s1
), s3 AS (
  SELECT *, (total - stopped) / open_w AS level FROM s2
), s4 AS (
  SELECT *, (SELECT level FROM s3 x WHERE x.w * x.level < x.stop ORDER BY x.r, x.source NULLS LAST LIMIT 1) AS fixed FROM s3
), s AS (
  SELECT source, source_size, CASE WHEN fixed IS NULL THEN stop ELSE least(stop, w * fixed) END AS target FROM s4
), t AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) AS BIGINT) AS certain FROM s
), f AS (
  SELECT source, arg_max(need / squares, size) AS factor, max(size) AS most, arg_max(need, size) AS need FROM (
    SELECT d.source, d.size, t.target - t.certain * t.source_size AS need_all,
      t.target - t.certain * t.source_size - coalesce((SELECT sum(b.size) FROM d b WHERE b.source IS NOT DISTINCT FROM d.source AND b.size > d.size), 0)::DOUBLE AS need,
      (SELECT sum(b.size * b.size) FROM d b WHERE b.source IS NOT DISTINCT FROM d.source AND b.size <= d.size)::DOUBLE AS squares
    FROM (SELECT DISTINCT source, size FROM d WHERE size > 0) d JOIN t ON t.source IS NOT DISTINCT FROM d.source
  ) WHERE need_all > 0 AND need / squares * size < 1 GROUP BY source
), x AS (
  SELECT d.*, t.source_size, t.target, t.certain, f.need,
    CASE WHEN f.factor IS NULL OR d.size = 0 THEN 0.0::DOUBLE WHEN d.size > f.most THEN 1.0::DOUBLE ELSE f.factor * d.size END AS p,
    (CAST('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id) AS n FROM x WHERE p > 0 AND p < 1
), step AS (
  SELECT source, doc_id, n, CASE WHEN size <= need THEN size ELSE 0 END AS extra, need - CASE WHEN size <= need THEN size ELSE 0 END AS room FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.source, r.doc_id, r.n, CASE WHEN r.size <= s.room THEN r.size ELSE 0 END, s.room - CASE WHEN r.size <= s.room THEN r.size ELSE 0 END FROM step s JOIN ranked r ON r.n = s.n + 1 AND r.source IS NOT DISTINCT FROM s.source
)
SELECT x.doc_id, x.size, x.source_size, x.target, CAST(x.certain * x.size + CASE WHEN x.p = 1 THEN x.size ELSE coalesce(step.extra, 0) END AS BIGINT) AS taken FROM x LEFT JOIN step ON step.doc_id = x.doc_id
""",
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS k FROM win
), later AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), flat AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT f.doc_id, string_agg(x, ' ' ORDER BY f.i) AS t, count(*) AS n FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.i = f.i WHERE g.i IS NULL GROUP BY f.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op2_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM bw WHERE len(w) > 0
), needles AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS t FROM win
), lengths AS (SELECT DISTINCT m FROM needles
), places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, lengths WHERE len(w) >= m
), grams AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS t FROM places
), found AS (
  SELECT g.doc_id, g.m, g.p, n.item_id FROM grams g JOIN needles n ON n.m = g.m AND n.t = g.t
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM found)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
""",
}
