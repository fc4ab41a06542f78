"""A corpus through five stages: quality rules, near-dedup, substring dedup, source mix, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``. No stage can be told in SQL as a whole (near-dedup and packing cannot), so there is no oracle.

Edge cases: null, empty and blank texts fail the base rules and go in the first stage; null ids, sources and languages pass through all
stages; rows that repeat an id with other texts stay apart, equal ones are one class; an empty table gives an empty result of the same
columns; very long texts are judged, compared and packed whole; extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import mixing, near, packing, quality, store, substring

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the lines that fail."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id."""
    return near.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 go, and documents of which nothing is left."""
    return substring.keep(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives for ``documents``. A stage's own tables go as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = store.folder(spark, f"stage-{name}")
        with store.scope():
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
