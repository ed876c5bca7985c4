"""Arithmetic of the memory fill, modulo 2^64.

The products wrap around, which bigint under ANSI does not, so these are Arrow
functions over numpy's unsigned integers. Addresses travel as signed bigint with
the same bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the fill.
GOLDEN = 0x9E3779B97F4A7C15
GOLDEN_INVERSE = pow(GOLDEN, -1, 1 << 64)
PAGE = 4096
GAMMA = 1021 * PAGE
WORD = 8
REACH = 1024


def fill_word(offset: np.ndarray, seed: int) -> np.ndarray:
    """The word of the fill at an offset into its block."""
    return offset.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(seed & ((1 << 64) - 1))


def fill_bytes(page: int, seed: int) -> np.ndarray:
    """The bytes of a fresh page: a window of the block that its address chooses."""
    start = page % GAMMA
    return fill_word(np.arange(start, start + PAGE, WORD, dtype=np.uint64), seed).astype("<u8").view(np.uint8)


def origin_of(address: np.ndarray, constant: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """The offset of the word of the fill that an address is near, and how far past
    it the address lies; -1 and 0 if it is near none. Nearer words count first,
    and of equally near ones that below."""
    address, constant = address.astype(np.uint64), constant.astype(np.uint64)
    found, apart = np.full(len(address), -1, np.int64), np.zeros(len(address), np.int64)
    for distance in range(reach + 1):
        for displacement in (distance, -distance) if distance else (0,):
            offset = (address - np.uint64(displacement % (1 << 64)) - constant) * np.uint64(GOLDEN_INVERSE)
            hit = (found < 0) & (offset < GAMMA) & (offset % np.uint64(WORD) == 0)
            found[hit], apart[hit] = offset[hit].astype(np.int64), displacement
    return found, apart


_ORIGIN = T.StructType([T.StructField("offset", T.LongType()), T.StructField("displacement", T.LongType())])


@F.pandas_udf(_ORIGIN)
def fill_origin(address: pd.Series, constant: pd.Series) -> pd.DataFrame:
    offset, apart = origin_of(address.to_numpy(np.int64).view(np.uint64), constant.to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"offset": offset, "displacement": apart})


@F.pandas_udf(T.LongType())
def fill_value(offset: pd.Series, seed: pd.Series) -> pd.Series:
    words = offset.to_numpy(np.int64).view(np.uint64) * np.uint64(GOLDEN) + seed.to_numpy(np.int64).view(np.uint64)
    return pd.Series(words.view(np.int64))
