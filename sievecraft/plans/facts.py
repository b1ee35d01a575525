"""Results of many small figures as rows: section, field, key (null for a single figure) and value; and their nested form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "section string, field string, key string, value double"


def single(section: str, field: str, value: Column) -> Column:
    """A fact of one row's value; booleans count 0 or 1."""
    return F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("key"), value.cast("double").alias("value"))


def from_row(one_row: DataFrame, section: str, fields: list[str]) -> DataFrame:
    """Facts of the columns of a table of one row."""
    return one_row.select(F.explode(F.array(*(single(section, f, F.col(f)) for f in fields))).alias("f")).select("f.*")


def counts(rows: DataFrame, entries: list[tuple[str, str, Column]]) -> DataFrame:
    """Histograms of all entries (section, field, value) in one pass; null values are not counted."""
    keyed = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.cast("string").alias("key")) for s, f, v in entries))
    return rows.select(F.explode(keyed).alias("e")).select("e.*").where(F.col("key").isNotNull()).groupBy("section", "field", "key").agg(F.count(F.lit(1)).cast("double").alias("value"))


def union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def nested(facts: DataFrame, flags: tuple[str, ...] = (), histograms: tuple[tuple[str, str], ...] = ()) -> dict:
    """{section: {field: value or {key: value}}}; whole values as int, the fields in `flags` as bool. histograms are there even if nothing was counted.

    The rows are figures and the bars of histograms, so their number does not follow the table's.
    """
    plain = lambda f, v: None if v is None else bool(v) if f in flags else int(v) if v == int(v) else v
    out: dict = {}
    for section, field in histograms:
        out.setdefault(section, {})[field] = {}
    for r in sorted(facts.collect(), key=lambda r: (r.section, r.field, r.key or "")):
        here = out.setdefault(r.section, {})
        if r.key is None:
            here[r.field] = plain(r.field, r.value)
        else:
            here.setdefault(r.field, {})[r.key] = plain(r.field, r.value)
    return out
