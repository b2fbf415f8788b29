"""The corpus pipeline: quality rules, near dedup, decontamination, mixing to target weights, token shards.

Each stage takes what its predecessor kept, whole, and acts on its own decisions: rejected documents,
all but one of near-duplicates, contaminated documents go; mixing repeats and leaves out documents by
their copies; the last stage writes token shards and returns their digest. All but the last return
the columns of documents, whatever they are. Nulls, empty texts, repeated rows and empty tables are
treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.llm.common import Scratch, pack, table, unpack
from chainfold.llm.decontamination import drop_contaminated
from chainfold.llm.mixing import mix
from chainfold.llm.near_dedup import keep_one
from chainfold.llm.quality import keep_good
from chainfold.llm.tokens import tokenize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(pack(docs, "text", "doc_id", "source"), keep=("text", "_row")).where("copies > 0")
    return unpack(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

#: MinHash, pivotal rounding and tokenizer ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
