"""A corpus pipeline of five stages over `documents`; every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievecraft.llm.common import files_for, remove_path, scope, table, written
from sievecraft.llm.exact_dedup import exact_dedup
from sievecraft.llm.mixing import apply_mix
from sievecraft.llm.packing import pack_documents
from sievecraft.llm.simhash import drop_near_duplicates
from sievecraft.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score as texts without features; without labels all stay."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the smallest doc_id stays, one row of it; null doc_ids lose to any other."""
    return exact_dedup(docs, keep="smallest", carry=True).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the smallest doc_id of a group stays. Rows with null doc_id stay."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whole copies, 0 to 2, so that sources, null among them, meet their target weights; texts without words come once."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy in one slot of one batch; null texts have length 0."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier, SimHash components and Newton's method have no SQL form here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table and scratch go as soon as the next stage's table is written; the last stage reads the one that is left."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", files=files_for(docs))
        for path in [*before, *made[:-1]]:
            remove_path(spark, path)
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
