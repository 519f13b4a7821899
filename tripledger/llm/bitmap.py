"""A filter of fixed size before a shuffle: rows that cannot find a partner stay where they are.

The wanted whole numbers mark bits at their remainders, 16 MB in all whatever their number. A value whose
bit is not set is not wanted; of the others a few are not either, and fall out in the join that
follows. With very many wanted values the filter lets all rows pass and costs one look-up each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from tripledger.llm.common import at_rest

BITS = 1 << 27
#: Bits of one row of the aggregate, fixed by Spark's bitmap functions.
ROW_BITS = 32_768


def marked(wanted: DataFrame, column: str) -> np.ndarray:
    """The bits, as bytes; at most ``BITS / ROW_BITS`` rows of 4 KB reach the driver."""
    place = F.pmod(F.col(column), F.lit(BITS))
    rows = wanted.select(F.floor(place / ROW_BITS).cast("int").alias("row"), (place % ROW_BITS).alias("bit"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row, found in rows.groupBy("row").agg(F.bitmap_construct_agg("bit")).collect():
        part = np.frombuffer(bytes(found), np.uint8)
        bits[row * (ROW_BITS // 8) :][: len(part)] = part
    return bits


def _hits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.int64) & (BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def may_be_wanted(wanted: DataFrame, column: str, value: Column) -> Column:
    """Whether a value (not null) may be among the wanted."""
    shared = wanted.sparkSession.sparkContext.broadcast(marked(wanted, column))

    @F.pandas_udf(BooleanType())
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(_hits(shared.value, values.to_numpy()))
        at_rest()

    return test(value)


def those_maybe_wanted(wanted: DataFrame, column: str, values: Column) -> Column:
    """Of an array (not null) the values that may be among the wanted."""
    shared = wanted.sparkSession.sparkContext.broadcast(marked(wanted, column))

    @F.pandas_udf(ArrayType(LongType()))
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield pd.Series([a[_hits(shared.value, a)] if len(a) else a for a in arrays], dtype=object)
        at_rest()

    return kept(values)
