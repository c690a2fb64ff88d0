"""The registered queries of the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import bpe, decontaminate, jaccard, licences, mixing, pii, quality, repair, shards, tokencount, toxicity, voronoi, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("n_near_items")


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.quality(table(spark, sf_dir, "documents")))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.held_out()))


#: The key of the registered query; a real run takes its own from a secret store.
PII_KEY = "public-test-key"


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), PII_KEY)


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.scores(table(spark, sf_dir, "documents"), ~mixing.held_out()))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.jaccard_groups(table(spark, sf_dir, "documents")))


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.digest(repair.damaged(conversations), conversations)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_quality_outliers, op4_bpe_transducer, op5_histogram_sort, op6_toxicity, op7_token_counts, op8_feistel_pseudonyms, op9_context_mixing, op10_jaccard_join,
                                  op11_conversation_repair, op12_embedding_whitening, op13_exact_top_k)}
ORACLES = {"op2_decontamination": decontaminate.SQL, "op5_histogram_sort": shards.SQL, "op10_jaccard_join": jaccard.SQL, "op11_conversation_repair": repair.SQL,
           "op13_exact_top_k": voronoi.SQL}
