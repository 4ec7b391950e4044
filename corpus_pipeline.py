"""A training-text pipeline over `documents`: each stage keeps what it should and hands it on as Parquet.

Clean documents stay. Rows with a null doc_id can be rejected for toxicity; no later stage names them, so they stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, decontaminate, prefix_join, toxicity
from quillspark.llm.util import Tables, rows_of, ship, sized


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the multiple-instance model finds toxic; it learns from the labels of documents of this stage."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    with Tables(spark) as own:
        return toxicity.reject(docs, toxicity.train(docs, labels, tables=own))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id. Rows with equal doc_ids are one document, of which the first by text stays."""
    tables = Tables(ship(spark))
    with Tables(spark) as own:
        groups = own.write(prefix_join.join(docs, tables=own), "groups")
        copies = tables.write(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
        repeated = tables.write(groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    kept = docs.join(sized(copies), "doc_id", "left_anti")
    n = rows_of(repeated)
    if n:
        few = sized(repeated, n)
        first = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
        again = kept.join(few, "doc_id", "left_semi").withColumn("_place", first).where("_place = 1").drop("_place")
        kept = kept.join(few, "doc_id", "left_anti").unionByName(again)
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark passages are a twentieth of the words or more."""
    tables = Tables(ship(spark))
    with Tables(spark) as own:
        found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tables=own)
        bad = tables.write(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(sized(bad), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of what is left."""
    ship(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("prefix_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: A trained model decides in the first stage, which SQL can't express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written and read again; a stage's output goes once the next one's is written."""
    tables = Tables(ship(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        after = tables.write(stage(spark, docs, sf_dir), name)
        if i:
            tables.drop(docs)
        docs = after
    return docs
