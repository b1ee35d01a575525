"""Perceptual hashes as longs, and configuration versions."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def covering_masks(radius: int, bits: int = 64, seed: int = 5) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs such that two longs that differ in at most `radius` bits agree under one of them.

    Every bit has a vector of radius+1 binary digits, and each non-zero vector v gives a mask of the bits whose vector has an odd product with v. Some
    v is orthogonal to the vectors of any `radius` bits. Vectors are dealt evenly, so that masks keep about half the bits. Where there are more vectors than
    bits, they have the first digit set: dealt from 1 on, few bits would have it, and a mask of those alone would let almost all pairs through. At a radius
    of 6 every mask of 64 bits keeps 32 or all.
    """
    top = (1 << (radius + 1)) - 1
    if 1 << radius >= bits:
        vectors = random.Random(seed).sample(range(1 << radius, top + 1), bits)
    else:
        vectors = [1 + i % top for i in range(bits)]
        random.Random(seed).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def rising_bits(signal: Column) -> Column:
    """A long with a bit for each neighbouring pair that rises, the first pair highest."""
    bits = F.zip_with(F.slice(signal, F.lit(1), F.size(signal) - 1), F.slice(signal, F.lit(2), F.size(signal) - 1), lambda a, b: F.when(b > a, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(b))


def config_version(config: dict, secret: tuple[str, ...] = (), ascii_only: bool = False) -> str:
    """First 16 hex digits of the SHA-256 of a configuration's canonical JSON, secrets left out."""
    kept = {k: v for k, v in config.items() if k not in secret}
    return hashlib.sha256(json.dumps(kept, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
