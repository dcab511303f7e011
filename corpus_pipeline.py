"""The corpus pipeline: language, exact duplicates, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of `documents`; the last returns packed
pieces. `run` writes each stage's result to the shared folder and reads it again for the next.

In the near-duplicate stage a row is known by its doc_id and the digest of its text, so rows that share a doc_id, or have none, each go
their own way; of rows that agree in both, one stays at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mendline.llm import exact, language, packing, pii, simhash
from mendline.llm.common import id_fold, table
from mendline.sources.io import stored

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. `lang` becomes the language found."""
    found = language.learn_and_identify(docs.select(*COLUMNS), id_fold(F.col("doc_id"), 3) == 1)
    return (found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact.exact_duplicates(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id, rows without one after all others."""
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    found = stored(simhash.near_duplicates(docs.select(name.alias("row"), "text"), words=3, radius=3, id_col="row")
                   .select("row", (F.col("row") == F.col("component_id")).alias("stays")), "near-groups")
    named = docs.select(*COLUMNS).withColumn("row", name)
    kept = named.join(found.where(~F.col("stays")), "row", "left_anti")
    # Rows equal in id and text: none where the exact stage went before.
    repeated = stored(found.where("stays").groupBy("row").count().where("count > 1").select("row"), "near-repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "row", "left_anti").unionByName(kept.join(repeated, "row", "left_semi").dropDuplicates(["row"]))
    return kept.drop("row")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows."""
    return pii.extract(docs.select(*COLUMNS), mask=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), width=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

#: Near duplicates, language models and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
