"""Payloads of the messages that carry headers, hashes and handshakes, as native columns over hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import compact_size_hex, from_compact_size, from_little_endian, little_endian_hex
from ..functions.network import address_hex, address_text

MOST_HEADERS = 2000
# Kinds of inventory entries.
BLOCK, WITNESS_BLOCK = 2, 0x40000002


def _after_count(digits: Column) -> Column:
    mark = F.substring(digits, 1, 2)
    size = F.when(mark < "fd", 2).when(mark == "fd", 6).when(mark == "fe", 10).otherwise(18)
    return F.substr(digits, size + F.lit(1))


def _records(digits: Column, size: int, one) -> Column:
    """The counted records of size bytes each; null if the length doesn't fit the count."""
    n, body = from_compact_size(digits), _after_count(digits)
    listed = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), lambda i: one(F.substr(body, ((i - 1) * 2 * size + 1).cast("int"), F.lit(2 * size))))
    return F.when(F.length(body) == n * 2 * size, F.when(n == 0, F.slice(listed, F.lit(1), F.lit(0))).otherwise(listed))


def headers(payload: Column) -> Column:
    """Array of 80-byte headers (hex) of a headers message: each is followed by a zero count; null for more than MOST_HEADERS."""
    return F.when(from_compact_size(payload) <= MOST_HEADERS, _records(payload, 81, lambda x: F.substring(x, 1, 160)))


def headers_message(listed: Column) -> Column:
    return F.concat(compact_size_hex(F.size(listed)), F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("00"))), ""))


def inventory(payload: Column) -> Column:
    """Array of STRUCT<kind, hash> of a getdata or inv message."""
    return _records(payload, 36, lambda x: F.struct(from_little_endian(F.substring(x, 1, 8)).cast("long").alias("kind"), F.substring(x, 9, 64).alias("hash")))


def getdata_message(hashes: Column, kind: int = WITNESS_BLOCK) -> Column:
    return F.concat(compact_size_hex(F.size(hashes)), F.array_join(F.transform(hashes, lambda h: F.concat(little_endian_hex(F.lit(kind), 4), h)), ""))


def getheaders_message(version: Column, locator: Column, stop: Column) -> Column:
    return F.concat(little_endian_hex(version, 4), compact_size_hex(F.size(locator)), F.array_join(locator, ""), stop)


#: The message without a payload that answers a version.
VERACK = ""


def ping_message(nonce: Column) -> Column:
    """A ping's payload, and that of the pong that answers it. nonce: a long, whose bits are taken as unsigned."""
    return little_endian_hex(nonce, 8)


def ping_nonce(payload: Column) -> Column:
    """The nonce as DECIMAL; null for another length."""
    return F.when(F.length(payload) == 16, from_little_endian(payload))


# Fields of a version message before its user agent (name, kind, bytes); ports alone have the most significant byte first.
VERSION_FIELDS = (
    ("version", "int", 4),
    ("services", "unsigned", 8),
    ("time", "long", 8),
    ("to_services", "unsigned", 8),
    ("to_host", "host", 16),
    ("to_port", "port", 2),
    ("from_services", "unsigned", 8),
    ("from_host", "host", 16),
    ("from_port", "port", 2),
    ("nonce", "unsigned", 8),
)


def _signed(digits: Column) -> Column:
    n = from_little_endian(digits).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def version_message(payload: Column) -> Column:
    """STRUCT of a version message's fields; null if it ends before the user agent, whose fields and later ones are null where they lack."""
    read = {
        "int": _signed,
        "unsigned": from_little_endian,
        "long": lambda x: from_little_endian(x).cast("long"),
        "host": address_text,
        "port": lambda x: F.conv(x, 16, 10).cast("int"),
    }
    fields, at = [], 1
    for name, kind, size in VERSION_FIELDS:
        fields.append(read[kind](F.substring(payload, at, 2 * size)).alias(name))
        at += 2 * size
    agent = F.conv(F.substring(payload, at, 2), 16, 10).cast("int") * 2
    rest = F.substr(payload, agent + F.lit(at + 2))
    fields.append(F.make_valid_utf8(F.unhex(F.substr(payload, F.lit(at + 2), agent)).cast("string")).alias("user_agent"))
    fields.append(F.when(F.length(rest) >= 8, _signed(F.substring(rest, 1, 8))).alias("height"))
    fields.append(F.when(F.length(rest) >= 10, F.substring(rest, 9, 2) != "00").alias("relay"))
    return F.when(F.length(payload) >= at - 1, F.struct(*fields))


def version_payload(fields: dict[str, Column], user_agent: Column, height: Column, relay: Column) -> Column:
    """The payload of a version message from the fields that VERSION_FIELDS names."""
    write = {
        "int": lambda x, n: little_endian_hex(F.pmod(x.cast("long"), F.lit(1 << 32)), n),
        "unsigned": little_endian_hex,
        "long": little_endian_hex,
        "host": lambda x, n: address_hex(x),
        "port": lambda x, n: F.lower(F.lpad(F.hex(x.cast("long")), 2 * n, "0")),
    }
    agent = F.lower(F.hex(user_agent.cast("binary")))
    head = [write[kind](fields[name], size) for name, kind, size in VERSION_FIELDS]
    return F.concat(*head, little_endian_hex(F.length(agent) / 2, 1), agent, write["int"](height, 4), F.when(relay, "01").otherwise("00"))
