"""Deterministic randomness: hashes in place of a generator's state, equal on every engine and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A key to sort by: an arbitrary but fixed order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number above 0 and at most 1 from the first 13 hexadecimal digits of a hash."""
    digits = F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double")
    return (digits + 1) / F.lit(float(16**13))


def race(seed: int | str, weight: Column, *keys: Column) -> Column:
    """An exponential waiting time; the smallest of a group is a choice with chances in proportion to the weights."""
    return F.when(weight > 0, -F.log(uniform(seed, *keys)) / weight)
