"""Membership filters over keys: tables of bits that say "certainly not among them" without a shuffle.

A filter has a row per block with eight 64-bit words; a key sets one bit in each word of its block.
Rows merge by bitwise OR, so a filter is an ordinary aggregate with map-side combining, and a task
that is run again changes nothing. It has at most ``blocks`` rows of some 70 bytes whatever the number of keys, so it
may be broadcast. A filter that is too full only lets more keys pass, which an exact join then settles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from plumbline.specs import ticked

#: Rows of a filter: 65,536 blocks of 512 bits, about 4 MB, serve some three million keys at one false pass in 100.
BLOCKS = 1 << 16
WORDS = 8
_EXACT = (BinaryType, BooleanType, DateType, DecimalType, IntegralType, TimestampNTZType, TimestampType)


def _hashable(kind: DataType) -> bool:
    """Whether equal values of the type always have equal hashes; text under a collation doesn't."""
    if isinstance(kind, StringType):
        return "collate" not in kind.simpleString().lower()
    return isinstance(kind, _EXACT)


def shared_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys that a filter of one frame can be asked for by the other: same type, equal means same hash.

    Keys left out make the filter coarser, never wrong.
    """
    a = {f.name: f.dataType for f in left.schema.fields}
    b = {f.name: f.dataType for f in right.schema.fields}
    return [k for k in keys if a[k] == b[k] and _hashable(a[k])]


def _block(columns: Sequence[str], blocks: int) -> Column:
    """Where a key stands; a NULL counts as a value of its own."""
    nulls = [F.col(ticked(c)).isNull() for c in columns]
    return F.pmod(F.xxhash64(F.lit(1), *[F.col(ticked(c)) for c in columns], *nulls), F.lit(blocks)).cast("int")


def _bits(columns: Sequence[str]) -> list[Column]:
    """The one bit in each word, six bits of a second hash apiece."""
    second = F.xxhash64(F.lit(2), *[F.col(ticked(c)) for c in columns])
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def key_filter(keys: DataFrame, columns: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """The filter of a frame's keys: ``_block`` and ``_w0`` to ``_w7``, at most ``blocks`` rows.

    Repeated keys and nulls are as good as any; no keys give no rows.
    """
    bits = [b.alias(f"_w{i}") for i, b in enumerate(_bits(columns))]
    rows = keys.select(_block(columns, blocks).alias("_block"), *bits)
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def with_membership(
    rows: DataFrame, filter_: DataFrame, columns: Sequence[str], blocks: int = BLOCKS, name: str = "_maybe"
) -> DataFrame:
    """All rows with a flag: false if the key is certainly not in the filter.

    A join by block with a table of at most ``blocks`` rows, which is why it may be broadcast; rows stay where they are.
    """
    marked = rows.withColumn("_block", _block(columns, blocks)).join(F.broadcast(filter_), "_block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(columns)):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    flagged = marked.withColumn(name, F.coalesce(hit, F.lit(False)))
    return flagged.drop("_block", *[f"_w{i}" for i in range(WORDS)])
