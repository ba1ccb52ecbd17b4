"""A training corpus from raw documents: rules, near-duplicates, repeated passages, source weights, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklog.llm import fair_mix, line_dedup, packing, quality_ledger, queries, simhash
from sparklog.llm.common import remove, run_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy that weighs repeated lines by their characters."""
    return quality_ledger.apply_policy(docs, "v3")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.distinct_documents(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return line_dedup.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return fair_mix.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences, with their token ids."""
    return packing.pack(docs, queries.token_file(), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixing),
    ("packing", sequences),
]
#: Tokenizers are outside SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next. A stage's intermediate tables and
    the table it read are removed when its result is written; the last result stays."""
    queries.ship(spark)
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{number}")
        with run_folder(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
