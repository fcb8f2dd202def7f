"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator to the whole intended table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, fingerprints, html_text, importance, language_id, license_scan, mixing, piece_sampling, recurrent_lm, sharding, simhash, url_filter, whitening
from skein.llm.common import documents


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_samples(documents(spark, sf_dir))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=40)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_fingerprint": op9_fingerprint,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_importance": op12_importance,
    "op13_html_text": op13_html_text,
}

ORACLE: dict[str, str] = {
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   list_unique(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS different,
                   length(coalesce(text, ''))::DOUBLE AS n, length(regexp_replace(coalesce(text, ''), '[\x00-@\[-`{-\x7F]+', '', 'g'))::DOUBLE AS letters,
                   (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 13))::BIGINT::DOUBLE + 0.5e0) / 4503599627370496e0 AS u
            FROM documents
        ), k AS (
            SELECT *, -ln(u) / CASE WHEN size > 0 THEN 1e0 / (1e0 + abs(n / size::DOUBLE - 6e0) / 2e0) * (0.1e0 + 0.9e0 * (letters / n)) * (ln(1e0 + different) / ln(1e0 + size)) ELSE 1e0 END AS key FROM d
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
            FROM d GROUP BY source
        ), f AS (
            SELECT *, source_size * 2e0 AS most, source_size * 2e0 / weight AS full_at, sum(source_size) OVER ()::DOUBLE AS total FROM s
        ), l AS (
            SELECT *, row_number() OVER w AS place,
                   (total * 1.5e0 - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                   / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST)
        ), c AS (
            SELECT place AS from_place, level AS lam FROM l WHERE level <= full_at ORDER BY place LIMIT 1
        ), t AS (
            SELECT source, source_size, CASE WHEN from_place IS NULL OR place < from_place THEN most ELSE lam * weight END AS target
            FROM l LEFT JOIN c ON true
        ), g AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
        ), r AS (
            SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS budget,
                   sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) AS upto
            FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN upto - size / 2e0 <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_importance": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), goal AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), f AS (
            SELECT rid, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS feature FROM docs
        ), g AS (
            SELECT unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS feature FROM goal
        ), h AS (
            SELECT feature, hex(encode(feature)) AS x FROM (SELECT feature FROM f UNION SELECT feature FROM g)
        ), c AS (
            -- CRC-32, half a byte at a time; fixed values: the CRCs of the sixteen half bytes.
            SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b:
                xor(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) >> 4, t[(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) & 15) + 1])), 4294967295::BIGINT) % 10000 AS bucket
            FROM h, (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t)
        ), n AS (
            SELECT bucket, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM (SELECT feature, true AS doc FROM f UNION ALL SELECT feature, false FROM g) JOIN c USING (feature) GROUP BY bucket
        ), m AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n
        ), v AS (
            SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (feature) JOIN m USING (bucket) GROUP BY rid
        ), r AS (
            SELECT d.rid, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5e0) / 4294967296e0)))::BIGINT AS score
            FROM docs d LEFT JOIN v ON d.rid = v.rid
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS fits FROM r
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= fits * 5 // 100 THEN place END AS rank FROM o
    """,
}
