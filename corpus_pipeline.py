"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir); between stages the driver of a run writes and rereads Parquet.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, langid, neardedup, packing, secrets
from lakeloom.llm.common import remainder, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; rejected ones go.

    Texts that are null or have no letter go.  Repeated rows stay or go together, null ids and
    languages are no reason to go, an empty table stays empty.
    """
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies (five-word shingles, similarity 0.8 or more).

    The smallest id stays.  Null and empty texts are copies of each other, documents without an id
    stay, repeated rows of one id stay or go together, an empty table stays empty.
    """
    return neardedup.keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item of 20 normalised characters or more.

    Null and empty texts hold none, documents without an id stay, rows that share an id go together,
    an empty table, or benchmark, drops nothing.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets; every document stays.

    Null and empty texts stay as they are; ``n_chars`` is that of the new text, null for a null text;
    repeated rows are redacted alike; an empty table stays empty.
    """
    cut = secrets.redact(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences.

    A null or empty text is the end id alone, repeated rows are packed each, an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("pack", packed),
]

#: A forest, character models and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet in the shared folder and reread.

    A stage's files go once the next stage's are written; those of the last stage written stay, as the result reads them.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
