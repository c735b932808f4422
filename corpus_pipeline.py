"""The corpus pipeline: language, near duplicates, secrets, mix and packing, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, mixing, ngram_join, packing, secrets
from tesserae.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents without a recognised language, or with an ambiguous one, go.

    The codes are learned from the rows of the stage's own input that carry a label. Null and empty texts, and
    texts without letters, have no language and go. Where no row carries a label nothing can be learned, and every
    text with a letter stays. Repeated rows, repeated or null ids are decided each by its own text; there are no
    ties, since an even decision is ambiguous. An empty table stays empty; further columns are dropped.
    """
    model = langid.train(docs, F.col("doc_id").isNotNull())
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}")).select(*COLUMNS)
    own = docs.withColumn("_own", langid.labeller(model)(F.col("text").cast("string")))
    return own.where((F.col("_own.lang_pred") != langid.UNKNOWN) & ~F.col("_own.ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of documents joined by a Jaccard similarity of 0.8 or more on five-word shingles the one with the
    smallest id stays.

    Of rows with one id and one text, one stays; of one id with several texts in a group, the one with the smallest
    hash. Null and empty texts have no shingles and stay, rows with a null id only where their group has no other.
    An empty table stays empty; further columns are dropped.
    """
    found = ngram_join.near_sets(docs, 5, (80, 100)).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    own = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("own")
    kept = own.join(found.distinct().alias("kept"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("own._hash") == F.col("kept._hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: found secrets are replaced by a mark; every document stays. ``n_chars`` follows the new text.

    Null and empty texts, and texts without findings, are left as they are. Overlapping findings are one mark.
    Repeated rows get the same text. Where too few rows hold a base match, only base matches are found. An empty
    table stays empty; further columns are dropped.
    """
    net = secrets.train(docs)
    own = docs.withColumn("_spans", secrets.scanner(net)(F.col("text").cast("string")))
    clean = own.withColumn("text", secrets.redacted(F.col("text"), F.col("_spans")))
    return clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: a sample of nine tenths of the tokens whose sources, languages and topics lean to their small values.

    Each row is drawn by a hash of its id, so repeated ids are drawn together and null ids all alike. Null sources
    and languages are a value of their own. Null and empty texts have no tokens and are drawn by their cell. An
    empty table stays empty; further columns are dropped.
    """
    drawn = mixing.mix(docs, share=0.9, power=0.9, keep=tuple(COLUMNS))
    return drawn.where("kept").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: sequences of 2048 tokens along the curve, a row for each piece.

    Null and empty texts are one token. Repeated rows and ids are packed each on their own; equal keys follow in
    the order of the rows. An empty table gives no rows. Workers remember fewer words than op1's, as executors still
    hold what earlier stages needed.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1, cached=120_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL cannot express the trained stages or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
