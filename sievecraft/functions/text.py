"""String building blocks that agree with full Unicode rules where Java's defaults do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body applied to value, which is computed once however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def casefold(c: Column) -> Column:
    """Lower case with the two foldings that lower() lacks in the texts at hand: sharp s and final sigma."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def strip(c: Column, chars: str = r"\s") -> Column:
    """Removes the characters of a regex class from both ends."""
    return F.regexp_replace(c, rf"(?U)\A[{chars}]+|[{chars}]+\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(name: Column) -> Column:
    """Without the last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def first_match(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first rule whose condition holds, else null."""
    return F.coalesce(*(F.when(condition, F.lit(code)) for condition, code in rules))


def literal_pattern(text: str) -> str:
    """A case-insensitive regex for the text itself."""
    return r"(?iu)\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def fixed(value: Column, digits: int) -> Column:
    """A number from 0 on with so many decimals by its exact value, and a tie to even, as printf writes it; format_string rounds the shortest decimal form half up.

    The number's upper and lower 26 bits are scaled apart, so that the distance from the middle between two results has an exact sign.
    """
    big = value * F.lit(134217729.0)  # 2^27 + 1
    upper, scale, whole = big - (big - value), F.lit(float(10**digits)), 10**digits
    low = F.floor(value * scale)
    over = (upper * scale - (low + F.lit(0.5))) + (value - upper) * scale
    n = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / whole).cast("string"), F.lit("."), F.lpad((n % whole).cast("string"), digits, "0"))
