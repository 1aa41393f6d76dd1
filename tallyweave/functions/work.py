"""Targets, proof of work and subsidies.

256-bit targets are 64 hex digits, most significant first, so that they compare
as strings. Work and difficulty need 256-bit division: they come from a table
of the distinct values of ``bits`` (one row an epoch), made by exact integers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EASIEST = 0xFFFF << 208
HALVING, EPOCH, FIRST_SUBSIDY = 210_000, 2016, 5_000_000_000
#: The largest value of DECIMAL(38,0).
MOST_WORK = 10**38 - 1


def target(bits: int) -> int:
    mantissa, exponent = bits & 0x7FFFFF, bits >> 24
    return mantissa << 8 * (exponent - 3) if exponent >= 3 else 0


def work(bits: int) -> int:
    """Expected hashes for a header of these bits; 0 for target 0, at most MOST_WORK."""
    t = target(bits)
    return min((1 << 256) // (t + 1), MOST_WORK) if t else 0


def difficulty(bits: int) -> Decimal:
    """How much harder than the easiest target, cut after six decimals."""
    t = target(bits)
    return Decimal(min(EASIEST * 10**6 // t, MOST_WORK)).scaleb(-6) if t else Decimal(0)


def target_hex(bits: Column) -> Column:
    """The target of bits; zeros where the exponent is below 3, null where it goes over 256 bits."""
    bits = bits.cast("long")
    exponent = F.shiftright(bits, 24).cast("int")
    mantissa = F.hex(bits.bitwiseAND(F.lit(0x7FFFFF).cast("long")))
    return F.when(exponent < 3, F.lit("0" * 64)).when(exponent <= 32, F.lower(F.lpad(F.concat(mantissa, F.repeat(F.lit("00"), exponent - 3)), 64, "0")))


def meets_target(display_hash: Column, target: Column) -> Column:
    """Both as 64 hex digits, most significant first."""
    return F.coalesce(display_hash <= target, F.lit(False))


def work_table(headers: DataFrame, bits: str = "bits") -> DataFrame:
    """(bits, work, difficulty) of the distinct bits, in executors."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            values = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()), pa.array([Decimal(work(x)) for x in values], pa.decimal128(38, 0)), pa.array([difficulty(x) for x in values], pa.decimal128(38, 6))],
                names=["bits", "work", "difficulty"],
            )

    distinct = headers.select(F.col(bits).cast("long").alias("bits")).where("bits is not null").distinct()
    return distinct.mapInArrow(rows, "bits long, work decimal(38,0), difficulty decimal(38,6)")


def subsidy(height: Column) -> Column:
    halvings = F.floor(height / HALVING).cast("int")
    return F.when(halvings >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.lit(FIRST_SUBSIDY).cast("long"), halvings))


def halving_epoch(height: Column) -> Column:
    return F.floor(height / HALVING).cast("long")


def difficulty_epoch(height: Column) -> Column:
    return F.floor(height / EPOCH).cast("long")
