"""Bytes, hashes and integer codecs as native columns.

Bytes are BINARY columns; functions whose name ends in ``hex`` give lower-case
hex strings, in which byte order can be turned (``reverse`` of a binary column
works on characters, not bytes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U56 = (1 << 53) - 1
#: The largest value that the nine-byte compact size may hold.
MAX_COMPACT = 4_000_000


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def reversed_hex(digits: Column) -> Column:
    """Hex digits with their bytes the other way round."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def sha256d(data: Column) -> Column:
    """SHA-256 of the SHA-256, as BINARY."""
    return F.unhex(F.sha2(F.unhex(F.sha2(data, 256)), 256))


def display_hash(data: Column) -> Column:
    """A hash as it is shown: bytes reversed, in hex."""
    return reversed_hex(to_hex(data))


def from_display_hash(digits: Column) -> Column:
    return F.unhex(reversed_hex(F.lower(digits)))


def checksum(data: Column) -> Column:
    """The first four bytes of sha256d."""
    return F.substring(sha256d(data), 1, 4)


def big_endian_hex(n: Column, size: int) -> Column:
    """n in size bytes, most significant first; an error outside the range (and above 2^53-1)."""
    most = min((1 << 8 * size) - 1, MAX_U56)
    digits = F.lower(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))
    return F.when(n.isNull(), None).when((n < 0) | (n > most), F.raise_error(F.lit(f"out of the range of {size} bytes"))).otherwise(digits)


def little_endian_hex(n: Column, size: int) -> Column:
    return reversed_hex(F.lower(F.lpad(F.hex(n.cast("long")), 2 * size, "0")))


def from_big_endian(digits: Column) -> Column:
    """Up to seven bytes of hex as LONG."""
    return F.conv(digits, 16, 10).cast("long")


def from_little_endian(digits: Column) -> Column:
    return F.conv(reversed_hex(digits), 16, 10).cast("decimal(20,0)")


def compact_size_hex(n: Column) -> Column:
    """Variable-length counts: one byte, or a mark and two, four or eight, least significant first."""
    n = n.cast("long")
    return (
        F.when(n < 0xFD, little_endian_hex(n, 1))
        .when(n <= 0xFFFF, F.concat(F.lit("fd"), little_endian_hex(n, 2)))
        .when(n <= 0xFFFFFFFF, F.concat(F.lit("fe"), little_endian_hex(n, 4)))
        .otherwise(F.concat(F.lit("ff"), little_endian_hex(n, 8)))
    )


def from_compact_size(digits: Column) -> Column:
    """The count at the start of hex digits; null if it isn't in its shortest form or is too large."""
    mark = F.substring(digits, 1, 2)
    value = lambda size: F.conv(reversed_hex(F.substring(digits, 3, 2 * size)), 16, 10).cast("decimal(20,0)")
    return (
        F.when(mark < "fd", F.conv(mark, 16, 10).cast("decimal(20,0)"))
        .when((mark == "fd") & (value(2) >= 0xFD), value(2))
        .when((mark == "fe") & (value(4) > 0xFFFF), value(4))
        .when((mark == "ff") & (value(8) > 0xFFFFFFFF) & (value(8) <= MAX_COMPACT), value(8))
        .cast("long")
    )


def script_num_hex(n: Column) -> Column:
    """Sign and magnitude, least significant byte first, in the fewest bytes; nothing for zero."""
    n = n.cast("long")
    digits = F.hex(F.abs(n))
    even = F.lower(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))
    first = F.conv(F.substring(even, 1, 2), 16, 10).cast("int")
    # The sign is the highest bit: a byte more where that is taken.
    signed = (
        F.when(first >= 128, F.concat(F.when(n < 0, F.lit("80")).otherwise(F.lit("00")), even))
        .when(n < 0, F.concat(F.lower(F.lpad(F.hex((first + 128).cast("long")), 2, "0")), F.substring(even, 3, 16)))
        .otherwise(even)
    )
    return F.when(n == 0, F.lit("")).otherwise(reversed_hex(signed))


def from_script_num(digits: Column) -> Column:
    turned = reversed_hex(digits)
    first = F.conv(F.substring(turned, 1, 2), 16, 10).cast("long")
    rest = F.conv(F.concat(F.lpad(F.hex(first.bitwiseAND(F.lit(127))), 2, "0"), F.substring(turned, 3, 16)), 16, 10).cast("long")
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.when(first >= 128, -rest).otherwise(rest))


def height_push_hex(height: Column) -> Column:
    """What a coinbase script of this height starts with: the push of its script number."""
    number = script_num_hex(height)
    return F.concat(little_endian_hex((F.length(number) / 2).cast("long"), 1), number)


def _pairs(level: Column) -> Column:
    """Hashes of pairs, the last one with itself where it stands alone."""
    pair = lambda i: F.concat(F.element_at(level, (2 * i + 1).cast("int")), F.element_at(level, F.least(2 * i + 2, F.size(level)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: sha256d(pair(i)))


def merkle_fold(leaves: Column, levels: Column, whole: Column) -> Column:
    """STRUCT<node, bad> of a tree's top after some levels over one leaf or more: bad if real siblings are equal at any of them.

    whole: the leaves are all of the tree, which then ends where one node is
    left; else they are a part of it, and a last node alone is paired with itself
    up to the top.
    """
    twins = lambda level: F.exists(F.sequence(F.lit(1), F.greatest(F.size(level) - 1, F.lit(1)), F.lit(2)), lambda i: F.coalesce(F.get(level, i - 1) == F.get(level, i), F.lit(False)))
    start = F.struct(leaves.alias("level"), F.lit(False).alias("bad"))
    more = lambda level: (F.size(level) > 1) | ~whole
    step = lambda s, _: F.struct(F.when(more(s["level"]), _pairs(s["level"])).otherwise(s["level"]).alias("level"), (s["bad"] | twins(s["level"])).alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, step, lambda s: F.struct(F.element_at(s["level"], 1).alias("node"), s["bad"].alias("bad")))


def _levels(leaves: Column) -> Column:
    return F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int")


def merkle_root(leaves: Column) -> Column:
    """The root over an array of 32-byte hashes; 32 zero bytes for none. For trees of one row; validate.merkle_roots takes any."""
    return F.when(F.size(leaves) == 0, F.unhex(F.lit("00" * 32))).otherwise(merkle_fold(leaves, _levels(leaves), F.lit(True))["node"])


def merkle_mutated(leaves: Column) -> Column:
    """Whether two real siblings are equal at any level, so that another list of leaves has the same root."""
    return F.when(F.size(leaves) == 0, False).otherwise(merkle_fold(leaves, _levels(leaves), F.lit(True))["bad"])
