"""A filter for 64-bit keys: it may let others pass, never stops a member.

Tasks use it to send on only what an exact join will want. It has 32 bits or
more for each key up to ``LARGEST`` (32 MB), so it may go to every executor
whatever the input's size. Eight million keys have that many; with more it lets
more pass, at 30 million one other in nine, at some hundreds of millions nearly
all, and the join then shuffles everything it is given. Results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the least and the largest number of bits.
LEAST, LARGEST = 17, 28


class KeyFilter:
    def __init__(self, keys: DataFrame, key: str, n: int):
        """``keys``: rows with a bigint ``key``, some ``n`` of them; at most ``2**(LARGEST - 6)`` words reach the driver."""
        self.size = min(max((32 * n).bit_length(), LEAST), LARGEST)
        bit = F.col(key).bitwiseAND(F.lit((1 << self.size) - 1))
        word = F.shiftright(bit, 6)
        got = keys.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
        self.words = np.zeros(1 << (self.size - 6), np.int64)
        self.words[got.column("w").to_numpy()] = got.column("b").to_numpy()

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.astype(np.int64) & ((1 << self.size) - 1)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1
