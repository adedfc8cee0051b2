"""A Bloom filter of bounded size over 64-bit keys, built by tasks and held as packed bits.

It keeps rows that cannot take part in a join where they are read; a false member only costs the
exact join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import mix

#: Least and largest size in bits (at most 16 MB).
BITS = (1 << 20, 1 << 27)


def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    x = mix(keys.astype(np.int64).view(np.uint64))
    return x & np.uint64(bits - 1), mix(x + np.uint64(1)) & np.uint64(bits - 1)


def build(keys: DataFrame, count: int) -> tuple[bytes, int]:
    """``(bitmap, bits)`` of the one bigint column of ``keys``; each of at most 32 tasks returns
    one bitmap, and nulls are left out."""
    bits = BITS[0]
    while bits < 16 * count and bits < BITS[1]:
        bits *= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(batch["key"].to_numpy(np.int64), bits):
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"bitmap": [held.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    known = keys.select(F.col(keys.columns[0]).cast("bigint").alias("key")).where("key is not null")
    for row in known.coalesce(32).mapInPandas(run, "bitmap binary").toLocalIterator():
        out |= np.frombuffer(row["bitmap"], np.uint8)
    return out.tobytes(), bits


def members(bitmap: bytes, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    held, out = np.frombuffer(bitmap, np.uint8), np.ones(len(keys), bool)
    for at in places(keys, bits):
        out &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def maybe_in(bitmap, bits: int):
    """``members`` as a column function of a bigint column without nulls; ``bitmap`` is a broadcast."""

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(members(bitmap.value, bits, keys.to_numpy()))

    return held
