"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is a multiset of paragraphs (its lines). Each paragraph hashes to a wide
vector, and a text's fingerprint is the sum of its paragraphs' vectors, each
lane modulo 2^32: their order doesn't matter, and inserting or deleting a
paragraph adds or subtracts its vector. A vector has eight lanes from four
64-bit hashes of the whole paragraph, which tell different multisets apart, and
64 lanes that count the set bits of hashes of its neighbouring words. The latter
are a tug-of-war sketch: the squared distance of two fingerprints estimates how
many word pairs differ, and so their likeness.
"""

from __future__ import annotations

from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

#: Seeds of the paragraph's hashes, each giving two lanes.
SEEDS = (11, 23, 37, 53)
#: Shifts that take two lanes, 32 bits apart, from a word pair's hash at a time.
SHIFTS = range(32)
_TWO = (1 << 32) + 1
_LOW = (1 << 32) - 1


def _vectors(frame: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Sums over each group of keys, which name single texts: p0.. (paragraph lanes), b0.. (two bit lanes each), pairs."""
    lines = frame.select(*keys, F.explode(F.split(text, "\n")).alias("line")).select("*", F.split("line", " ").alias("w"))
    pairs = F.zip_with("w", F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.size("w") - 1)), lambda w, before: F.xxhash64(before, w))
    each = lines.select(*keys, "line", F.posexplode(pairs).alias("at", "e"))
    once = F.col("at") == 0
    sums = []
    for i, seed in enumerate(SEEDS):
        h = F.xxhash64(F.lit(seed), F.col("line"))
        sums += [F.sum(F.when(once, h.bitwiseAND(F.lit(_LOW))).otherwise(0)).alias(f"p{2 * i}"), F.sum(F.when(once, F.shiftrightunsigned(h, 32)).otherwise(0)).alias(f"p{2 * i + 1}")]
    sums += [F.sum(F.shiftright("e", i).bitwiseAND(F.lit(_TWO))).alias(f"b{i}") for i in SHIFTS]
    return each.groupBy(*keys).agg(*sums, F.count("*").alias("pairs"))


def _hex(low: Column, high: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))), 16, "0"))


def _fingerprint() -> Column:
    """The lanes of _vectors as hex digits, eight a lane."""
    lanes = [_hex(F.col(f"p{2 * i}"), F.col(f"p{2 * i + 1}")) for i in range(len(SEEDS))]
    lanes += [F.lower(F.lpad(F.hex(f"b{i}"), 16, "0")) for i in SHIFTS]
    return F.concat(*lanes, F.lower(F.lpad(F.hex("pairs"), 8, "0")))


def _signed() -> Column:
    """The bit lanes as set less unset bits."""
    return F.array(*[(2 * x - F.col("pairs")).cast("double") for i in SHIFTS for x in (F.col(f"b{i}").bitwiseAND(F.lit(_LOW)), F.shiftright(f"b{i}", 32))])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the common part of two multisets of word pairs against their sizes, as their sketches estimate it."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    apart = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    size = total(F.zip_with(a, b, lambda x, y: x * x + y * y))
    return F.when(apart == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / size)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint (hex) of the union of two multisets of paragraphs, or of a without b for sign -1, from theirs."""
    lanes = []
    for i in range(2 * len(SEEDS) + 2 * len(SHIFTS) + 1):
        x, y = (F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long") for c in (a, b))
        lanes.append(F.lower(F.lpad(F.hex((x + sign * y).bitwiseAND(F.lit(_LOW))), 8, "0")))
    return F.concat(*lanes)


def fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint) of each group of rows that share a key, as one multiset of paragraphs; null texts are empty."""
    return _vectors(docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("t")), "t", ["key"]).select(F.col("key").alias(key), _fingerprint().alias("fingerprint"))


def _bucket(column: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below column, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    heads = F.array(*[F.lit(x) for x in cuts[::step]])
    block = F.greatest(F.size(F.filter(heads, lambda x: x < column)) - 1, F.lit(0))
    within = F.slice(F.array(*[F.lit(x) for x in cuts]), block * step + 1, F.lit(step))
    return block * step + F.size(F.filter(within, lambda x: x < column))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is the one after in ascending doc_id, the first after the
    last; null doc_ids come first and equal ones in the order of a hash of their
    texts; rows with one doc_id, or none, may be many. Very long texts count
    whole. Null texts are empty; a text under four characters is its own edit;
    a table of one row is followed by itself; an empty one gives an empty result.
    """
    parts = shuffle_parts(docs.sparkSession)
    bits = max(1, (parts - 1).bit_length())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = source.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    # A doc_id that is several of the quantiles is in many rows; those and null ones go on by the hash that orders them.
    often = [x for x, n in Counter(cuts or []).items() if n > 1]
    line_of = _bucket(F.col("doc_id"), sorted(set(cuts or []))).cast("long")
    by_hash = F.shiftright(F.xxhash64("text"), 64 - bits) + F.lit(1 + (1 << bits - 1))
    many = F.col("doc_id").isNull() | (F.col("doc_id").isin(often) if often else F.lit(False))
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(line_of) * F.lit(2 << bits) + F.when(many, by_hash).otherwise(F.lit(0))
    rows = source.select("doc_id", "text", place.alias("bucket"), F.xxhash64("text").alias("h"), F.lit(False).alias("ghost"))
    # The first row of each bucket follows the last one of the bucket before it, where it stands as a ghost: at most a row for each partition.
    least = source.select("doc_id", place.alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("least"))
    firsts = rows.join(F.broadcast(least), "bucket").where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("bucket").agg(F.min_by("text", "h").alias("text"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    ghosts = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", before.alias("bucket"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("ghost"))
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    placed = rows.unionByName(ghosts).select("bucket", "ghost", "doc_id", "text", F.row_number().over(line).alias("rank"), F.lead("text").over(line).alias("next"), F.length("text").cast("long").alias("n_chars"))
    edited = placed.select("*", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"), F.expr("substring(next, 1, cast(floor(n_chars / 4) as int))")).alias("edited"))
    kinds = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    both = edited.select("bucket", "rank", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.inline(kinds))
    sums = _vectors(both, "t", ["bucket", "rank", "kind", "ghost", "doc_id", "n_chars", "sha"])
    lanes = sums.select("bucket", "rank", "kind", "ghost", "doc_id", "n_chars", "sha", _fingerprint().alias("f"), _signed().alias("v"))
    then = Window.partitionBy("bucket").orderBy("rank", "kind")
    found = lanes.select("*", F.lead("f").over(then).alias("f1"), F.lead("v").over(then).alias("v1"), F.lead("v", 2).over(then).alias("v2")).where("kind = 0 and not ghost")
    return found.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"), likeness(F.col("v"), F.col("v1")).alias("near_edited"), likeness(F.col("v"), F.col("v2")).alias("near_next"))
