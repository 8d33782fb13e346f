"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontaminate, jpeg, langid, license, packing, secrets, simhash, suffix, toxicity, warc
from lakeloom.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items of ``benchmark`` in all ``documents``, a row for each pair.  Null and empty texts and items match nothing; repeated rows repeat; either table empty: no rows."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as JPEG and read back, a row for each document.  Null and empty texts are 64 zero bytes; repeated rows repeat; an empty table: no rows."""
    return jpeg.media_features(jpeg.store_media(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of each document.  Null and empty texts have fingerprint zero and link like others; of equal fingerprints the smallest id names the group; repeated rows repeat; an empty table: no rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document.  Null and letterless texts are ``und``; ties go to the first language by name; repeated rows repeat; an empty table: no rows."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived records of each page.  Null URLs and pages count as empty; repeated pages share ids; an empty table: no rows."""
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return records.selectExpr("page_id", "kind", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_payload_digest", "block_digest", "block_bytes", "sha2(record, 256) AS record_sha256", "error")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of each document.  Null and empty texts keep nothing and lose nothing; repeated rows are copies; an empty table: no rows."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents.  Null and empty texts are the end id alone; repeated rows are packed each; an empty table: no rows."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of each document.  Null and empty texts have no words and empty labels; repeated rows repeat; an empty table: no rows."""
    return license.license_scan(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score.  Null and empty texts have none; repeated rows repeat; an empty table: no rows."""
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document.  Null and empty texts score as texts without hits; documents without labels are scored alike; repeated rows repeat; an empty table: no rows."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2_jpeg`` that SQL can make: sizes, and the digest of the payload read back."""
    return op2_jpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_license`` that SQL can make: words and places of the base phrases."""
    return op8_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jpeg": op2_jpeg,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_suffix": op6_suffix,
    "op7_pack": op7_pack,
    "op8_license": op8_license,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "media_payload": media_payload,
    "license_base": license_base,
}

#: What SQL can express; tests hold the other queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "media_payload": """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
 p AS (SELECT doc_id, raw, octet_length(raw) AS n, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END AS z FROM t)
 SELECT doc_id, n AS n_bytes, n + z AS payload_bytes, sha256(raw || unhex(repeat('00', z))) AS payload_sha256 FROM p""",
    "license_base": r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, w, [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'cc' AND w[i + 1] = 'by'] AS a,
  [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'] AS b,
  [i - 1 FOR i IN range(1, len(w) + 1) IF w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved'] AS c FROM t)
 SELECT doc_id, len(w) AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM p""",
}
