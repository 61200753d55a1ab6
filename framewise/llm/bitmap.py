"""A bitmap of fixed size over hashed keys: small enough for every task,
whatever the number of keys.  It may let too much through, never too little,
so an exact join always follows it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768            # bits of one bitmap_construct_agg row


def build(keys: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """The bitmap of ``slot`` (0 .. 2**bits - 1) over all rows; at most
    2**bits / 32768 rows of 4 KB reach the driver."""
    pages = (keys.select((slot + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("page"))
                 .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for p in pages:
        a = (p["page"] - 1) * PAGE // 8
        out[a:a + PAGE // 8] = np.frombuffer(bytes(p["bits"]), np.uint8)
    return out


def test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
