"""From raw documents to token ids: five stages, each over all that the one before kept.

Documents that the quality classifier rejects go; repeated lines go; of near-duplicates one stays; sources
are mixed to their target weights; texts become tokens, whose decoding is hashed beside them.

Every stage takes any rows of the columns of documents: a null text counts as an empty one and stays null, texts of
any length are read whole, and an empty table gives an empty one. All but the last stage return the columns they
get, further ones too, in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.llm import bpe, lines, minhash, mixing, quality
from chronoview.llm.common import cut, free, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
GOOD = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is GOOD or more, as they are; repeated rows stay or go together."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= GOOD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones (by doc_id, null last, and place); n_chars follows the
    text. Rows that are equal are treated alike, so a repeated row keeps what its first keeps."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id; of repeated rows one stays."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never; a null source is a source."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with hashes of the ids and of what they decode to; copies of a row stay apart."""
    texts = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(texts, RANKS, public_tokenizers.PATTERN, keep_text=False, decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("bpe", tokenize),
]

#: The first stage learns its weights, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        following = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(docs)
        docs = following
    return docs
