"""Deterministic uniforms from row keys: the same row gives the same number everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: modulus and coefficients of the test-data derivation
MODULUS = 1000003


def u2(key: Column) -> Column:
    k = key % MODULUS
    return ((F.lit(31) * k * k + F.lit(7919) * k) % MODULUS) / F.lit(1000003.0)


def u3(key: Column) -> Column:
    k = key % MODULUS
    return (((k * k % MODULUS) * 17 * k + F.lit(104729) * k) % MODULUS) / F.lit(1000003.0)


def u4(key: Column) -> Column:
    k = key % MODULUS
    return ((((k * k % MODULUS) * k % MODULUS) * 13 * k + F.lit(611953) * k) % MODULUS) / F.lit(1000003.0)


def uniform(seed: int | Column, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from 53 bits of a 64-bit hash of (seed, keys)."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    bits = F.shiftrightunsigned(F.xxhash64(seed, *[F.col(k) if isinstance(k, str) else k for k in keys]), 11)
    return bits / F.lit(9007199254740992.0)


def normal(seed: int | Column, *keys: Column | str) -> Column:
    """Standard normal by Box-Muller from two independent hashes of the same keys."""
    first = F.lit(1.0) - uniform(seed, F.lit("radius"), *keys)
    second = uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(2 * F.pi() * second)
