"""Absolute and relative time locks, decoded from and encoded to unsigned 32-bit values (LONG)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lock times from here on are seconds, below it heights.
TIME_FROM = 500_000_000
FINAL, DISABLED, BY_TIME = 0xFFFFFFFF, 1 << 31, 1 << 22
UNIT = 512


def lock_time(value: Column) -> Column:
    """STRUCT<kind, height, seconds>: none, block or time."""
    kind = F.when(value == 0, "none").when(value < TIME_FROM, "block").otherwise("time")
    return F.struct(kind.alias("kind"), F.when(kind == "block", value).alias("height"), F.when(kind == "time", value).alias("seconds"))


def lock_time_value(lock: Column) -> Column:
    return F.coalesce(lock["height"], lock["seconds"], F.lit(0).cast("long"))


def sequence(value: Column) -> Column:
    """STRUCT<kind, lock_kind, blocks, seconds, unused>: final, disable or enable."""
    value = value.cast("long")
    bits = lambda shift, mask: F.shiftright(value, shift).bitwiseAND(F.lit(mask).cast("long"))
    kind = F.when(value == FINAL, "final").when(bits(31, 1) == 1, "disable").otherwise("enable")
    enabled, timed = kind == "enable", bits(22, 1) == 1
    return F.struct(
        kind.alias("kind"),
        F.when(enabled, F.when(timed, "time").otherwise("block")).alias("lock_kind"),
        F.when(enabled & ~timed, bits(0, 0xFFFF)).alias("blocks"),
        F.when(enabled & timed, bits(0, 0xFFFF) * UNIT).alias("seconds"),
        F.when(kind == "disable", bits(0, 0x7FFFFFFF)).when(enabled, bits(23, 0xFF) * 64 + bits(16, 0x3F)).alias("unused"),
    )


def sequence_value(lock: Column) -> Column:
    """The unsigned value of a sequence struct."""
    unused = F.coalesce(lock["unused"], F.lit(0).cast("long"))
    amount = F.when(lock["lock_kind"] == "time", (lock["seconds"] / UNIT).cast("long") + BY_TIME).otherwise(lock["blocks"])
    spare = unused.bitwiseAND(F.lit(0x3F).cast("long")) * (1 << 16) + F.shiftright(unused, 6) * (1 << 23)
    return F.when(lock["kind"] == "final", F.lit(FINAL).cast("long")).when(lock["kind"] == "disable", unused + DISABLED).otherwise(amount + spare)


def version_lock_tag(version: Column, value: Column) -> Column:
    """0: both in full; 1, 2: that version without a lock; 3, 4: version 1 or 2 with one."""
    none = value == 0
    return F.when(none & (version == 1), 1).when(none & (version == 2), 2).when(version == 1, 3).when(version == 2, 4).otherwise(0)


def version_lock_size(tag: Column) -> Column:
    """Bytes of the packed form."""
    return F.when(tag.isin(1, 2), 1).when(tag.isin(3, 4), 5).otherwise(9)


def format_lock_time(value: Column) -> Column:
    lock = lock_time(value)
    at = F.date_format(F.timestamp_seconds(lock["seconds"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(lock["kind"] == "none", "none").when(lock["kind"] == "block", F.concat(F.lit("block "), lock["height"].cast("string"))).otherwise(F.concat(F.lit("time "), at))


def format_sequence(value: Column) -> Column:
    lock = sequence(value)
    raw = F.lower(F.hex(value.cast("long")))
    return (
        F.when(lock["kind"] == "final", "final (0xffffffff)")
        .when(lock["kind"] == "disable", F.concat(F.lit("disabled (raw: 0x"), raw, F.lit(")")))
        .when(lock["lock_kind"] == "block", F.concat(F.lit("relative lock: "), lock["blocks"].cast("string"), F.lit(" blocks")))
        .otherwise(F.concat(F.lit("relative lock: "), lock["seconds"].cast("string"), F.lit("s")))
    )
