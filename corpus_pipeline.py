"""A training-data pipeline over `documents`: each stage works on all that the stage before it kept.

A null text is scored and read as an empty one. Rows with a null doc_id pass the stages that compare documents and are numbered first in their source. Of
repeated rows with one doc_id all stay or none does. Equal texts are one group, of which the smallest doc_id stays. Texts of any length are read whole. Extra
columns, whatever their names, stay up to the last stage, which returns its own columns. Without labels of both kinds no document is rejected; an empty table
gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import mixing, near_dup, piece_bpe, quality, repeats
from ledgerline.llm.common import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.scorer(spark, model)(F.col("text")) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    copies = near_dup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document has; a character cut in two goes as a whole."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = repeats.remove_repeats(docs, carry=rest, as_text=True).withColumn("text", F.col("kept"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mixture of their sources."""
    return mixing.mixed_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the position that the mixture of `docs` gives the row.

    A table's rows have no order once it is read again, so the position is computed natively from this stage's input; the
    texts are not shuffled for it.
    """
    model, carry = public_tokenizers.path("piece_bpe_32k.model"), ("source", "_hash")
    tokens = piece_bpe.digests(piece_bpe.encode(docs.withColumn("_hash", F.xxhash64("text")), model, decoded=True, carry=carry), carry)
    return mixing.mix(cut(tokens, "tokens"), tie="_hash").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, hashing and tokenization are not expressible in SQL.
ORACLE_SQL = None
