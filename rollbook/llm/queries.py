"""The registered query of every operator of this subpackage: the operator on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import edits, fertility, licenses, lm, neardup, packing, secrets, substrings, tiling, warc
from rollbook.sources.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 10 != 0")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = written(fertility.measure(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "measured")
    return fertility.judged(measured, fertility.learn(measured, _table(spark, sf_dir, "labels").where("quality = 1")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.recount(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tiles")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    chunks = warc.read_chunks(warc.write_archives(pages, warc.new_folder(pages)))
    return chunks.where("last").select("page_id", "payload_bytes", F.col("sha256").alias("payload_digest"), "record_type", "refers_to")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("lines")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_table(spark, sf_dir, "documents"), percent=85, width=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_substring_dedup, op3_quality_rules, op4_best_fit_packing, op5_token_counts,
        op6_benchmark_decontamination, op7_warc, op8_secret_scans, op9_license_scans, op10_ngram_jaccard_join,
    )
}

#: Words of a text by DuckDB; a null text has none.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS words FROM documents),
        runs AS (SELECT r, i, words[i : i + 34] AS run FROM texts, unnest(range(1, len(words) - 33)) AS t(i)),
        again AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM runs JOIN again USING (run))),
        word AS (SELECT r, p, words[p] AS word FROM texts, unnest(range(1, len(words) + 1)) AS t(p)),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
        lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)""",
    "op7_warc": """
        WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        copied AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM page)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
            CASE WHEN octet_length(payload) >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN octet_length(payload) >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM copied""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s FROM texts, unnest(range(1, len(words) - 2)) AS t(i)
            UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND 3),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
        reach AS (SELECT a AS doc_id, a AS least FROM links UNION SELECT links.b, least FROM reach JOIN links ON links.a = reach.doc_id WHERE least < links.b)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(component, doc_id), doc_id) AS component_id
        FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(least) AS component FROM reach GROUP BY doc_id) USING (doc_id)""",
}
