"""The corpus pipeline: toxic texts, near duplicates and contaminated texts go, personal data is replaced, token ids come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import bpe, decontaminate, jaccard, pii, toxicity
from fieldspark.llm.common import written
from fieldspark.llm.queries import PII_KEY, table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every component of the Jaccard join."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers, dates and addresses replaced by pseudonyms."""
    return pii.pseudonymised(docs, PII_KEY).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of the decoded text."""
    return bpe.encoded(docs, tokenizer("word_bpe_49k.json"), keep=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
          ("personal_data", replace_personal_data), ("tokens", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each is written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Fitted models and components over many rounds have no short SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
