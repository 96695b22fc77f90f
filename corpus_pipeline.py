"""A corpus pipeline made of the training-data operators.

Quality rules drop what they reject, near-duplicate removal keeps one document of each group, substring removal takes
out passages that occur more than once, mixing draws documents to target weights (some more than once), and packing
cuts the result into windows of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.llm import minhash, mixing, packing, quality, substring
from veristra.llm.common import cut_lineage
from veristra.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle and a similarity of 0.8."""
    return minhash.keep_first(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring.drop_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("near-duplicates", unique),
    ("substring dedup", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages fit models and hash; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage by stage; each but the last is written to the shared folder and read again, as its successor reads it often."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
