"""A training-data pipeline over documents: quality filter, near-duplicate removal, secret redaction, source mix, token digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import bpe, mixing, quality, secrets, simhash
from tamarack.llm.common import dropped, passing, read, written
from tamarack.llm.queries import tokenizer

#: Texts link where sets of five-word shingles are so similar and one of so many keys is shared. Fingerprints only sort out beforehand what
#: differs in more than so many bits: similarity 0.8 means about 10, with a standard deviation of 3.
SHINGLE, BITS, KEYS, LEAST = 5, 24, 6, 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from the labels of sf_dir.

    Null texts are scored as empty ones, very long ones whole. Repeated rows get one score and stay or go together. An empty table gives an empty one, and so
    does one without labels. All columns stay, whatever their names."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Null texts and those without a word are one group, and of equal rows one stays. Of a group's rows of null doc_id, one stays if there is no other. Long texts count whole. An
    empty table gives an empty one. All columns stay, whatever their names. SimHash and its trie sort out, after shared keys; the shingle sets decide (see README)."""
    return simhash.deduplicated(docs, SHINGLE, BITS, KEYS, LEAST)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts; other documents stay as they are.

    Null texts stay null, empty ones empty; long ones are searched whole; repeated rows and nulls in other columns stay as they are. An empty table gives an empty one. All columns stay,
    whatever their names."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source's words come near its target.

    Null and empty texts have no words and are not taken. The null source is a source. Rows of one doc_id, source and size share their repetitions, rows of null doc_id too. The same table gives the
    same mix. An empty table gives an empty one. All columns stay, whatever their names."""
    return mixing.applied(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty, with no tokens. Long texts are encoded whole. A row for each row, repeated ones and those of null doc_id too. An empty table gives an empty one."""
    return bpe.digests(docs, tokenizer())


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("secret scans", redact_secrets), ("mixing", mix_sources), ("BPE encoding and decoding", tokenize)]

#: A fitted classifier and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with passing() as own:  # what a stage wrote for itself goes with the table it read
            before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
            own.keep(docs)
        dropped(before)
