"""Display formats as native columns (English, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, from the smallest, and the sizes of those of time.
BINARY_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
DECIMAL_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
PLAIN_UNITS = ("", "K", "M", "G", "T", "P", "E", "Z")
DAY = 86_400
#: Seconds of the units of relative time: months of 28 days, 13 of which and 1.2425 days are a year.
RELATIVE = (("year", 31_556_952), ("month", 28 * DAY), ("week", 7 * DAY), ("day", DAY), ("hour", 3600), ("minute", 60), ("second", 1))


def _short(value: Column) -> Column:
    """At most two decimals, with groups of thousands; exact halves away from zero."""
    tie = F.when(value * 8 == F.floor(value * 8), F.signum(value) * 1e-7).otherwise(0.0)
    text = F.format_number(value + tie, 2)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def scaled(value: Column, base: int, units: tuple[str, ...], separator: str = " ") -> Column:
    """value in the largest unit that keeps it at 1 or more; a dash if it isn't a finite number."""
    value = value.cast("double")
    size, out = F.abs(value), None
    for i, unit in enumerate(units):
        text = F.concat(_short(value / float(base**i)), F.lit(f"{separator if unit else ''}{unit}"))
        last = i == len(units) - 1
        out = F.when(size < float(base ** (i + 1)), text) if out is None else (out.otherwise(text) if last else out.when(size < float(base ** (i + 1)), text))
    return F.when(value.isNull(), None).when(F.isnan(value) | size.isin(float("inf")), "—").otherwise(out)


def bytes_binary(value: Column) -> Column:
    return scaled(value, 1024, BINARY_UNITS)


def bytes_decimal(value: Column) -> Column:
    return scaled(value, 1000, DECIMAL_UNITS)


def difficulty(value: Column) -> Column:
    return scaled(value, 1000, PLAIN_UNITS, "")


#: Hashes a second are shown as difficulties are, without a unit of their own.
hash_rate = difficulty


def hues(digits: Column) -> Column:
    """The hues of a hash's stripe, one for each byte of its hex digits: 0 to 360 degrees."""
    return F.transform(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda x: F.floor(F.conv(x, 16, 10).cast("double") / 255 * 360 + 0.5).cast("int"))


def height(value: Column) -> Column:
    return F.format_number(value, 0)


def version(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(value.cast("long")), 8, "0")))


def date(ts: Column) -> Column:
    return F.date_format(ts, "M/d/yyyy")


def coins(sats: Column) -> Column:
    """Whole and part coins from the smallest unit, two decimals."""
    return F.concat(F.when(sats < 0, "-").otherwise(""), F.lit("BTC "), F.format_number((F.abs(sats) / F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(38,8)"), 2))


def relative_time(seconds: Column) -> Column:
    """Signed whole units of the first unit that fits, as in 'in 3 days' or '2 hours ago'."""
    out = None
    for unit, size in RELATIVE:
        n = F.floor(seconds / size + 0.5).cast("long")
        many = F.when(F.abs(n) == 1, unit).otherwise(f"{unit}s")
        text = F.when(n < 0, F.concat(F.abs(n).cast("string"), F.lit(" "), many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit(" "), many))
        out = F.when(F.abs(seconds) >= size, text) if out is None else out.when(F.abs(seconds) >= size, text)
    return F.when(seconds.isNull(), None).otherwise(out.otherwise("now"))


def duration(milliseconds: Column) -> Column:
    """Days, hours, minutes and seconds, those that are zero left out; '0s' for nothing or less."""
    s = F.floor(F.when(milliseconds > 0, milliseconds).otherwise(0) / 1000).cast("long")
    parts = [(F.floor(s / DAY), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    text = F.concat(*[F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit))).otherwise("") for n, unit in parts])
    return F.when(text == "", "0s").otherwise(text)


def fill_ratio(size: Column, most: int = 4_000_000) -> Column:
    return F.least(size / most, F.lit(1.0))


def script_text(data: Column) -> Column:
    """Bytes as UTF-8, bad ones as U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))
