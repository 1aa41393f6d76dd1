"""Hosts, addresses of peers and page fragments, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _octets(host: Column) -> Column:
    """The four parts of a dotted address, each of one to three digits; null for anything else."""
    parts = F.split(host, r"\.", -1)
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^[0-9]{1,3}$")), parts)


def valid_host(host: Column) -> Column:
    """Whether host is an IPv4 address with octets to 255, or an IPv6 address with one '::' at most (eight groups without); names aren't."""
    octets = _octets(host)
    groups = F.filter(F.split(host, ":"), lambda x: x != "")
    hex_groups = F.forall(groups, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$"))
    gaps = F.size(F.split(host, "::", -1)) - 1
    # A single ':' at an edge, or three in a row, leaves an empty group beside the gap.
    torn = host.rlike("^:[^:]|[^:]:$|:::") | (host == ":")
    v6 = hex_groups & ~torn & ((gaps == 1) | ((gaps == 0) & (F.size(F.split(host, ":", -1)) == 8)))
    out = F.when(host.isNull() | (host == "") | host.endswith(".onion"), False).when(octets.isNotNull(), F.forall(octets, lambda x: x.cast("int") <= 255)).when(F.contains(host, F.lit(":")), v6)
    return F.coalesce(out.otherwise(False), F.lit(False))


def address_hex(host: Column) -> Column:
    """The sixteen bytes of a valid host: IPv4 as ::ffff:a.b.c.d."""
    octets = _octets(host)
    v4 = F.array_join(F.transform(octets, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    sides = F.split(host, "::", -1)
    listed = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda x: x != "")
    head, tail = listed(F.get(sides, F.lit(0))), listed(F.get(sides, F.lit(1)))
    fill = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
    groups = F.array_join(F.transform(F.concat(head, fill, tail), lambda x: F.lpad(x, 4, "0")), "")
    return F.lower(F.when(octets.isNotNull(), F.concat(F.lit("0" * 20 + "ffff"), v4)).otherwise(groups))


def address_text(digits: Column) -> Column:
    """The host of sixteen bytes in hex; the first run of zero groups of an IPv6 address is '::'."""
    number = lambda i, n: F.conv(F.substring(digits, i, n), 16, 10)
    v4 = F.concat_ws(".", *[number(25 + 2 * i, 2) for i in range(4)])
    v6 = F.concat_ws(":", *[F.lower(F.conv(F.substring(digits, 1 + 4 * i, 4), 16, 16)) for i in range(8)])
    return F.when(digits.startswith("0" * 20 + "ffff"), v4).otherwise(F.regexp_replace(v6, "^(.*?)(?:^|:)0(?::0)+(?::|$)", "$1::"))


def fragment(value: Column) -> Column:
    """STRUCT<kind, height, hash> of '/block/<height or hash>' or '/tx/<id>': home, block.height, block.hash or tx; what isn't valid is home.

    Hashes are given in wire order.
    """
    parts = F.split(F.regexp_replace(value, "^#", ""), "/")
    view, key = F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    is_hash = key.rlike("^[0-9a-fA-F]{64}$")
    kind = F.when((view == "block") & is_hash, "block.hash").when((view == "block") & key.rlike("^[0-9]{1,15}$"), "block.height").when((view == "tx") & is_hash, "tx").otherwise("home")
    wire = F.array_join(F.reverse(F.regexp_extract_all(F.lower(key), F.lit("(..)"), F.lit(1))), "")
    return F.struct(kind.alias("kind"), F.when(kind == "block.height", F.try_to_number(key, F.lit("9" * 15)).cast("long")).alias("height"), F.when(kind.isin("block.hash", "tx"), wire).alias("hash"))
