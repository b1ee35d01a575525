"""Helpers shared by the training-data operators: shared storage, bounded broadcasts, text units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.plans.storage import broadcast_within, files_for, move_path, path_exists, path_names, remove_path, scope, scratch, shared_dir, shuffle_partitions, written

__all__ = [
    "broadcast_within", "files_for", "move_path", "path_exists", "path_names", "remove_path", "scope", "scratch", "shared_dir", "shuffle_partitions", "written",
    "table", "let", "ascii_lower", "word_count", "internal",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to value, which is computed once however often body refers to it, even inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def internal(name: str) -> str:
    """A column name that callers' columns do not clash with."""
    return f"__sc_{name}"
