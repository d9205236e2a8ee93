"""The queries of the operators, and their SQL where there is some. Parameters are those of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import bpe, embeddings, fim, fingerprints, lm, merkle, mixing, quality, rules, secrets, simhash, suffixes, token_counts
from tamarack.llm.common import read


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer())


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mixed(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    return rules.judged(read(spark, sf_dir, "documents"), trusted)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.report(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_secrets, op3_fingerprints, op4_bpe, op5_lm, op6_simhash, op7_suffixes, op8_token_counts, op9_mixing, op10_quality_rules, op11_fim, op12_merkle, op13_embeddings,
    )
}
ORACLES: dict[str, str] = {"op11_fim": fim.ORACLE, "op12_merkle": merkle.ORACLE, "op13_embeddings": embeddings.ORACLE}
