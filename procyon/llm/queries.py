"""The registered queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the archived pages in which a few records are changed, missing or extra."""
    from . import merkle

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    full = merkle.archive(pages)
    good = full.where("page_id IS NULL OR page_id % 401 != 9")
    flipped = F.sha2(F.concat("digest", F.lit("#")), 256)
    other = full.where("page_id IS NULL OR page_id % 389 != 7").withColumn("digest", F.when(F.col("page_id") % 97 == 5, flipped).otherwise(F.col("digest")))
    return merkle.audit(good, other)


OP1_SQL = """
WITH r AS (SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS file_id,
  CAST(octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS BIGINT) AS rec_length
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(rec_length) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset FROM r)
SELECT page_id, file_id, rec_offset, rec_length,
  CASE WHEN page_id % 401 = 9 THEN 'extra' WHEN page_id % 389 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE (page_id % 401 = 9 AND page_id % 389 <> 7) OR (page_id % 389 = 7 AND page_id % 401 <> 9) OR (page_id % 97 = 5 AND page_id % 401 <> 9 AND page_id % 389 <> 7)
"""


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told("base"), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "linked"))).alias("spans"), F.size("linked").cast("bigint").alias("n_linked"))


def op3_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import matroska

    media = matroska.mux_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return matroska.media_features(media, keep=("n_bytes",))


def op4_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import subspace_join

    return subspace_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def word_bpe() -> str:
    """The path of the tokenizer's file, a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    coded = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe(), decoded=True)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _outcomes(pages: DataFrame) -> DataFrame:
    """Labelled outcomes: a page is bad when its text carries runs of three symbols (keyboard junk)."""
    from .url_reputation import host_of

    return pages.select(host_of(F.col("url")).alias("host"), F.col("html").rlike(r"[%#$*]{3}").cast("int").alias("bad"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_reputation

    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge(pages, _outcomes(pages))


OP6_SQL = """
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN regexp_matches(html, '[%#$*]{3}') THEN 1 ELSE 0 END AS bad FROM pages),
h AS (SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM p GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
kh AS (SELECT sum(q - bp * bp / np) AS a, sum((c - 1) * (bp / np) * (1 - bp / np)) AS b, sum((bp / np) * (1 - bp / np) * (np - nn / np - (c - 1))) AS d FROM (SELECT sum(n) AS np, sum(bad) AS bp, count(*) AS c, sum(bad * bad / n) AS q, sum(n * n) AS nn FROM h GROUP BY domain)),
kd AS (SELECT sum(q - bp * bp / np) AS a, sum((c - 1) * (bp / np) * (1 - bp / np)) AS b, sum((bp / np) * (1 - bp / np) * (np - nn / np - (c - 1))) AS d FROM (SELECT sum(n) AS np, sum(bad) AS bp, count(*) AS c, sum(bad * bad / n) AS q, sum(n * n) AS nn FROM d GROUP BY suffix)),
ks AS (SELECT sum(q - bp * bp / np) AS a, sum((c - 1) * (bp / np) * (1 - bp / np)) AS b, sum((bp / np) * (1 - bp / np) * (np - nn / np - (c - 1))) AS d FROM (SELECT sum(n) AS np, sum(bad) AS bp, count(*) AS c, sum(bad * bad / n) AS q, sum(n * n) AS nn FROM s)),
k AS (SELECT
  (SELECT CASE WHEN d > 0 AND a > b THEN least(greatest((1 - (a - b) / d) / ((a - b) / d), 1.0), 10000.0) ELSE 10000.0 END FROM kh) AS kh,
  (SELECT CASE WHEN d > 0 AND a > b THEN least(greatest((1 - (a - b) / d) / ((a - b) / d), 1.0), 10000.0) ELSE 10000.0 END FROM kd) AS kd,
  (SELECT CASE WHEN d > 0 AND a > b THEN least(greatest((1 - (a - b) / d) / ((a - b) / d), 1.0), 10000.0) ELSE 10000.0 END FROM ks) AS ks,
  (SELECT sum(bad) / sum(n) FROM s) AS m),
ms AS (SELECT suffix, (bad + ks * m) / (n + ks) AS m_suffix FROM s, k),
md AS (SELECT domain, (bad + kd * m_suffix) / (n + kd) AS m_domain FROM d JOIN ms USING (suffix), k),
mh AS (SELECT host, bad + kh * m_domain AS a, n - bad + kh * (1 - m_domain) AS b FROM h JOIN md USING (domain), k),
v AS (SELECT host, CASE WHEN a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.035 THEN 'block' ELSE 'allow' END AS by_host FROM mh),
f AS (SELECT page_id, p.host, path, by_host,
  CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (p.host = 'com' OR p.host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p JOIN v ON v.host = p.host)
SELECT page_id, host, path, rule, CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' WHEN 'com/' THEN 'allow' ELSE by_host END AS verdict FROM f
"""


def op8_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_jaccard

    return ngram_jaccard.components_of(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def symbol_quality() -> Column:
    """Texts with runs of three symbols weigh a quarter."""
    return F.when(F.col("text").rlike(r"[%#$*]{3}"), 0.25).otherwise(1.0)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_table(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), symbol_quality())


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN regexp_matches(text, '[%#$*]{3}') THEN 0.25 ELSE 1.0 END AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), *paths)
    told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    kept = save(aligned.withColumn("groups_sha256", told).drop("groups"))
    return alignment.score_links(kept, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language, toxicity

    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_audit": op1_merkle_audit,
    "op2_secret_linking": op2_secret_linking,
    "op3_matroska_columns": op3_matroska_columns,
    "op4_subspace_pigeonhole": op4_subspace_pigeonhole,
    "op5_forced_boundary_bpe": op5_forced_boundary_bpe,
    "op6_host_reputation": op6_host_reputation,
    "op7_nb_toxicity": op7_nb_toxicity,
    "op8_grouped_prefix_join": op8_grouped_prefix_join,
    "op9_fm_substring_dedup": op9_fm_substring_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_language_crf": op13_language_crf,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op1_merkle_audit": OP1_SQL, "op6_host_reputation": OP6_SQL, "op10_source_mix": OP10_SQL}
