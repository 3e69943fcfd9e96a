"""Hashes whose values must agree everywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of SplitMix64.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def mixed(key: Column) -> Column:
    """SplitMix64 of a long, as a long of the same order as the unsigned value (its top bit flipped)."""

    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(x.to_numpy(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))

    return of(key)


def bucket_and_sign(key: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket (low bits) and sign (the bit above them) of SplitMix64 of a key; buckets is a power of two."""
    h = mixed(key)
    bits = buckets.bit_length() - 1
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int"), (F.shiftright(h, bits).bitwiseAND(F.lit(1)) * 2 - 1).cast("int")


def priority(seed: int, salt: int, feature: Column, row: Column) -> Column:
    """Reservoir priority: mixed(seed ^ salt ^ (feature << 27 | row))."""
    return mixed(F.lit(seed ^ salt).cast("long").bitwiseXOR(F.shiftleft(feature.cast("long"), 27).bitwiseOR(row.cast("long"))))


def stable_id(namespace: str, text: Column, digits: int = 24) -> Column:
    """First hex digits of sha1 of namespace, zero character, text."""
    return F.substr(F.sha1(F.concat(F.lit(namespace), F.lit("\0"), text).cast("binary")), F.lit(1), F.lit(digits))
