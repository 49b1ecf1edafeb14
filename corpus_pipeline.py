"""The corpus pipeline: documents to packed training sequences, stage by stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as
the next stage's docs. Every stage works on all rows that the one before it kept. A stage that gets docs from such a
table deletes the scratch tables of the stages before it, whose results have been written; one that gets the result of
another as it is leaves them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, language_id, mixing, near_dedup, packing
from folio.llm.common import discard, made, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [path.rsplit("/", 1)[-1] for path in _scratch]
        if _scratch and not any(name in file for file in docs.inputFiles() for name in names):
            discard(_scratch)
            _scratch.clear()
        before = set(made())
        out = f(spark, docs, sf_dir)
        _scratch.extend(path for path in made() if path not in before)
        return out

    return work


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier finds in a language that was learned; those without a letter and those of which
    no language has the larger share are rejected."""
    model = language_id.train(docs.filter(~language_id.is_held_out()))
    return language_id.keep_identified(docs, model)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id."""
    return near_dedup.keep_one_of_each_group(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a document is there as often as its source's target says."""
    return mixing.mixed_rows(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document of the mix, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no BagMinHash and no tokenizer; tests/llm compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = materialize(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
