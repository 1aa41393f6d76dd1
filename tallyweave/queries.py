"""Registered queries over the driver's tables, and their SQL.

The tables are a star schema, so each query shows its operator on an analogue:
``lineitem`` rows are outputs (``l_orderkey`` the transaction, ``l_partkey`` the
script), the next output of a script spends the one before; ``orders`` are
transactions; ``events`` are a chain of headers by ``event_id``; texts of
``documents`` are payloads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import binary as B
from .functions import formats as FM
from .functions import locks as L
from .functions import scripts as S
from .functions import work as W
from .operators import chain as C
from .operators import index as I
from .operators import validate as V
from .operators.prefix import with_rank
from .plans import api
from .streaming import ingest as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- outputs

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LINE = ", ".join(LINE)
_OUT = f"""out AS (SELECT l_orderkey AS tx, l_partkey AS script, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
 row_number() OVER (ORDER BY {_LINE}) - 1 AS output_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS vout FROM lineitem)"""
_SPENDS = """spends AS (SELECT * FROM (SELECT tx AS prev_tx, vout AS prev_vout, lead(tx) OVER (PARTITION BY script ORDER BY output_index) AS tx FROM out) WHERE tx IS NOT NULL)"""
#: Orders in a bucket of the two-level prefix sums.
_ORDERS = 4096


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("script"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), *LINE)
    indexed = I.with_output_index(rows, F.floor(F.col("tx") / _ORDERS), ["tx", *LINE[1:]], LINE[1:])
    return indexed.select("tx", "script", "value", "vout", "output_index")


def inputs(found: DataFrame) -> DataFrame:
    return I.spent_by_next(found)


@query(f"WITH {_OUT} SELECT * FROM out")
def global_output_index(spark, sf_dir):
    return outputs(spark, sf_dir)


@query(f"""WITH {_OUT}, tx AS (SELECT o_orderkey AS tx, count(out.tx) AS outputs FROM orders LEFT JOIN out ON out.tx = o_orderkey GROUP BY 1)
SELECT tx, outputs, CAST(coalesce(sum(outputs) OVER (ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_output_index FROM tx""")
def first_output_index(spark, sf_dir):
    held = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.count("*").alias("outputs"))
    txs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx")).join(held, "tx", "left").select("tx", F.coalesce("outputs", F.lit(0)).alias("outputs"))
    return I.first_output_index(txs, F.col("outputs"), F.floor(F.col("tx") / _ORDERS), ["tx"])


@query(f"""WITH {_OUT} SELECT output_index, script, lag(output_index) OVER w AS prev_same_script, lead(output_index) OVER w AS next_same_script
FROM out WINDOW w AS (PARTITION BY script ORDER BY output_index)""")
def same_script_prev_output(spark, sf_dir):
    return I.with_same_script_links(outputs(spark, sf_dir)).select("output_index", "script", "prev_same_script", "next_same_script")


@query(f"""WITH {_OUT}, s AS (SELECT script, min(output_index) AS first_output_index, max(output_index) AS last_output_index, count(*) AS outputs FROM out GROUP BY script)
SELECT *, row_number() OVER (ORDER BY first_output_index) - 1 AS script_id FROM s""")
def script_dictionary(spark, sf_dir):
    return I.script_dictionary(outputs(spark, sf_dir))


@query(f"WITH {_OUT}, {_SPENDS} SELECT out.tx, vout, output_index, spends.tx AS spender FROM out LEFT JOIN spends ON prev_tx = out.tx AND prev_vout = vout")
def spender_index(spark, sf_dir):
    found = outputs(spark, sf_dir)
    return I.spenders(found, inputs(found)).select("tx", "vout", "output_index", "spender")


@query(f"WITH {_OUT}, {_SPENDS} SELECT output_index, script, value FROM out WHERE NOT EXISTS (SELECT 1 FROM spends WHERE prev_tx = out.tx AND prev_vout = vout)")
def utxo_set(spark, sf_dir):
    found = outputs(spark, sf_dir)
    return I.unspent(found, inputs(found)).select("output_index", "script", "value")


@query(f"""WITH {_OUT}, {_SPENDS}, u AS (SELECT script, value, spends.tx AS spender FROM out LEFT JOIN spends ON prev_tx = out.tx AND prev_vout = vout)
SELECT script, count(*) AS outputs, count(*) FILTER (WHERE spender IS NULL) AS unspent, CAST(coalesce(sum(value) FILTER (WHERE spender IS NULL), 0) AS BIGINT) AS unspent_value FROM u GROUP BY script""")
def utxo_value_by_script(spark, sf_dir):
    found = outputs(spark, sf_dir)
    spent = I.spenders(found, inputs(found))
    free = F.col("spender").isNull()
    return spent.groupBy("script").agg(F.count("*").alias("outputs"), F.count_if(free).alias("unspent"), F.coalesce(F.sum(F.when(free, F.col("value"))), F.lit(0)).alias("unspent_value"))


@query("SELECT l_orderkey AS prev_tx, l_linenumber AS prev_vout, count(*) AS spends FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def double_spend_check(spark, sf_dir):
    return I.double_spends(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prev_tx"), F.col("l_linenumber").alias("prev_vout")))


@query("SELECT o_orderkey AS tx, CAST(0 AS BIGINT) AS prev_vout, o_orderkey AS prev_tx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_prevout(spark, sf_dir):
    asked = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_orderkey").alias("prev_tx"), F.lit(0).cast("long").alias("prev_vout"))
    return I.missing_prevouts(asked, outputs(spark, sf_dir)).select("tx", "prev_tx", "prev_vout")


@query("SELECT DISTINCT l_partkey AS script FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unknown_scripts_anti(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("script"))
    return I.new_scripts(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("script")), known)


@query("SELECT l_partkey AS script, count(*) AS outputs FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def known_scripts_semi(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return _t(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("script")).agg(F.count("*").alias("outputs"))


@query(f"""WITH {_OUT}, {_SPENDS}, h AS (SELECT max(tx) // 2 AS m FROM out)
SELECT spends.tx, prev_tx, prev_vout, output_index, CASE WHEN prev_tx <= m THEN 'committed' ELSE 'batch' END AS pass
FROM spends JOIN out ON out.tx = prev_tx AND out.vout = prev_vout, h WHERE spends.tx > m""")
def two_pass_prevout_resolution(spark, sf_dir):
    found = outputs(spark, sf_dir)
    half = _t(spark, sf_dir, "lineitem").agg(F.floor(F.max("l_orderkey") / 2).alias("m"))  # one row
    marked = found.join(F.broadcast(half))
    # Committed outputs and those of the batch are one relation, so each input is looked up once.
    batch = inputs(found).join(F.broadcast(half)).where("tx > m").drop("m")
    return I.resolve_prevouts(batch, marked).join(F.broadcast(half)).select("tx", "prev_tx", "prev_vout", "output_index", F.when(F.col("prev_tx") <= F.col("m"), "committed").otherwise("batch").alias("pass"))


@query("SELECT md5(text) AS key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text")
def newest_wins_dedup(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("key"))
    return I.newest(docs, "key", "doc_id").select("key", "doc_id", "source")


@query(f"WITH {_OUT}, {_SPENDS}, d AS (SELECT out.tx, sum(p.value) AS paid_in FROM spends AS out JOIN out AS p ON p.tx = prev_tx AND p.vout = prev_vout GROUP BY 1), o AS (SELECT tx, sum(value) AS paid_out FROM out GROUP BY 1) SELECT o.tx, CAST(coalesce(paid_in, 0) AS BIGINT) AS paid_in, CAST(paid_out AS BIGINT) AS paid_out FROM o LEFT JOIN d USING (tx)")
def tx_in_out_value(spark, sf_dir):
    found = outputs(spark, sf_dir)
    paid = I.resolve_prevouts(inputs(found), found).groupBy("tx").agg(F.sum("value").alias("paid_in"))
    made = found.groupBy("tx").agg(F.sum("value").alias("paid_out"))
    return made.join(paid, "tx", "left").select("tx", F.coalesce("paid_in", F.lit(0)).alias("paid_in"), "paid_out")


@query(f"""WITH {_OUT}, {_SPENDS}, o AS (SELECT tx, string_agg(script || ':' || value, ',' ORDER BY vout) AS outputs FROM out GROUP BY tx),
i AS (SELECT tx, string_agg(sha256('tx' || prev_tx) || ':' || prev_vout, ',' ORDER BY prev_tx, prev_vout) AS inputs, CASE WHEN count(*) FILTER (WHERE prev_tx % 2 = 0) > 0 THEN count(*) ELSE 0 END AS stacks FROM spends GROUP BY tx)
SELECT tx, sha256('tx' || tx) AS txid, coalesce(inputs, repeat('00', 32) || ':4294967295') AS inputs, outputs, coalesce(stacks, 0) AS stacks FROM o LEFT JOIN i USING (tx)""")
def stored_to_wire(spark, sf_dir):
    """Stored transactions, whose inputs name transactions and whose outputs name scripts by surrogate, with real ids and scripts."""
    found = outputs(spark, sf_dir)
    dictionary = I.script_dictionary(found).select("script", "script_id")
    stored = found.join(dictionary, "script").select("tx", "vout", "script_id", "value")
    txs = found.select("tx").distinct().withColumn("txid", F.sha2(F.concat(F.lit("tx"), F.col("tx").cast("string")), 256))
    item = F.when(F.col("prev_tx") % 2 == 0, F.array(F.col("prev_vout").cast("string"))).otherwise(F.array().cast("array<string>"))
    vin = F.row_number().over(Window.partitionBy("tx").orderBy("prev_tx", "prev_vout")) - 1
    spent = inputs(found).select("tx", vin.alias("vin"), "prev_tx", "prev_vout", item.alias("witness"))
    none = F.lit(None).cast("long")
    coinbases = txs.join(spent, "tx", "left_anti").select("tx", F.lit(0).alias("vin"), none.alias("prev_tx"), none.alias("prev_vout"), F.array().cast("array<string>").alias("witness"))
    wire = I.wire_transactions(txs, spent.unionByName(coinbases), stored, dictionary)
    shown = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), ",")
    return wire.select("tx", "txid", shown("inputs", "prev_txid", "prev_vout").alias("inputs"), shown("outputs", "script", "value").alias("outputs"), F.size("witness").cast("long").alias("stacks"))


@query(f"WITH {_OUT}, d AS (SELECT script, row_number() OVER (ORDER BY min(output_index)) - 1 AS script_id FROM out GROUP BY script) SELECT script_id, script FROM d WHERE script_id % 3 = 0")
def surrogate_lookup(spark, sf_dir):
    """Surrogates back to what they stand for: every third id of the dictionary."""
    dictionary = I.script_dictionary(outputs(spark, sf_dir)).select("script_id", "script")
    asked = dictionary.where("script_id % 3 = 0").select("script_id")
    return I.with_scripts(asked, dictionary)


@query(f"WITH {_OUT}, {_SPENDS}, a AS (SELECT tx, prev_tx FROM spends UNION ALL SELECT DISTINCT tx, CAST(NULL AS BIGINT) FROM out WHERE tx NOT IN (SELECT tx FROM spends)) SELECT tx // 8 // 100 * 100 AS first, count(prev_tx) AS spends FROM a GROUP BY 1")
def spends_by_height(spark, sf_dir):
    found = outputs(spark, sf_dir)
    spent = inputs(found).select("tx", "prev_tx")
    coinbases = found.select("tx").distinct().join(spent, "tx", "left_anti").select("tx", F.lit(None).cast("long").alias("prev_tx"))
    return I.spends_by_height(spent.unionByName(coinbases).select(F.floor(F.col("tx") / 8).alias("height"), "prev_tx"), 100)


@query(f"""SELECT o_orderkey AS tx, string_agg(l_partkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT), ',' ORDER BY {_LINE}) AS outputs, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_tx_build(spark, sf_dir):
    value = F.round(F.col("l_extendedprice") * 100).cast("long")
    held = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*LINE, value.alias("value")))).alias("outs"))
    built = _t(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey")
    text = F.array_join(F.transform("outs", lambda x: F.concat(x["l_partkey"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",")
    return built.select(F.col("o_orderkey").alias("tx"), text.alias("outputs"), S.total_out(F.transform("outs", lambda x: x["value"])).alias("total"))


@query(f"""WITH l AS (SELECT l_orderkey AS tx, list(l_partkey ORDER BY {_LINE}) AS a, list(l_suppkey ORDER BY {_LINE}) AS b FROM lineitem GROUP BY 1)
SELECT tx, array_to_string(list_transform(list_zip(a, b), lambda x: x[1] || '/' || x[2]), ' ') AS zipped FROM l""")
def witness_zip(spark, sf_dir):
    held = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("l"))
    zipped = F.arrays_zip(F.transform("l", lambda x: x["l_partkey"]).alias("a"), F.transform("l", lambda x: x["l_suppkey"]).alias("b"))
    return held.select("tx", zipped.alias("z")).select("tx", F.array_join(F.transform("z", lambda x: F.concat(x["a"].cast("string"), F.lit("/"), x["b"].cast("string"))), " ").alias("zipped"))


# ---------------------------------------------------------------- chain

# nBits of the analogue chain's headers, by user_id mod 4.
BITS = (0x1D00FFFF, 0x1C0AE493, 0x1B0404CB, 0x1A05DB8B)
_SQL_BITS = "(CASE user_id % 4 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BITS)) + " END)"
_SHA = "sha256(unhex(sha256(event_id || '|' || event_type || '|' || user_id)))"
_CHAIN = f"""chain AS (SELECT event_id AS height, {_SHA} AS hash, coalesce(lag({_SHA}) OVER (ORDER BY event_id), repeat('00', 32)) AS prev_hash, {_SQL_BITS} AS bits, ts, user_id, event_type FROM events)"""
_MANTISSA, _EXPONENT = "(bits & 8388607)", "(bits >> 24)"
_WORK = f"(CAST(1 AS HUGEINT) << (256 - 8 * ({_EXPONENT} - 3))) // {_MANTISSA}"


def _name(height, kind: str, user: str):
    return B.to_hex(B.sha256d(F.concat_ws("|", height.cast("string"), kind, F.col(user).cast("string")).cast("binary")))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain without its pointers."""
    bits = F.get(F.array(*[F.lit(b).cast("long") for b in BITS]), (F.col("user_id") % 4).cast("int"))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"), _name(F.col("event_id"), "event_type", "user_id").alias("hash"), bits.alias("bits"), "ts", "user_id", "event_type")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Hashes are made where they are needed: what they are made of is shorter, and moves in place of them.
    below = _t(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("height"), F.col("event_id").alias("__at"), F.col("event_type").alias("__kind"), F.col("user_id").alias("__user"))
    rows = _t(spark, sf_dir, "events").withColumnRenamed("event_id", "height").select("height", "ts", "user_id", "event_type").join(below, "height", "left")
    bits = F.get(F.array(*[F.lit(b).cast("long") for b in BITS]), (F.col("user_id") % 4).cast("int"))
    prev = F.when(F.col("__at").isNull(), "00" * 32).otherwise(_name(F.col("__at"), "__kind", "__user"))
    return rows.select("height", _name(F.col("height"), "event_type", "user_id").alias("hash"), bits.alias("bits"), "ts", "user_id", "event_type", prev.alias("prev_hash"))


def broken(headers: DataFrame) -> DataFrame:
    """Headers with a wrong link at each 1,000th height from 2,500 on."""
    return headers.withColumn("prev_hash", F.when((F.col("height") >= 2500) & (F.col("height") % 1000 == 0), F.lit("ff" * 32)).otherwise(F.col("prev_hash")))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS txs, CAST(sum(length(props)) AS BIGINT) AS wire_size, min(event_id) AS first_tx, max(event_id) AS last_tx FROM events GROUP BY 1")
def block_rollup(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("txs"), F.sum(F.length("props")).cast("long").alias("wire_size"), F.min("event_id").alias("first_tx"), F.max("event_id").alias("last_tx"))


@query(f"WITH {_CHAIN} SELECT height, NOT (height >= 2500 AND height % 1000 = 0) AS linked FROM chain")
def header_link_check(spark, sf_dir):
    return C.with_link(broken(chain(spark, sf_dir))).select("height", "linked")


@query(f"WITH {_CHAIN} SELECT height, hash FROM chain WHERE height < coalesce((SELECT min(height) FROM chain WHERE height >= 2500 AND height % 1000 = 0), 1000000000)")
def valid_prefix(spark, sf_dir):
    return C.valid_prefix(broken(chain(spark, sf_dir))).select("height", "hash")


@query(f"WITH {_CHAIN} SELECT DISTINCT CAST(bits AS BIGINT) AS bits, CAST({_WORK} AS DECIMAL(38,0)) AS work, CAST(((CAST(65535000000 AS HUGEINT) << (208 - 8 * ({_EXPONENT} - 3))) // {_MANTISSA}) AS DECIMAL(38,0)) AS difficulty_millionths FROM chain")
def work_by_bits(spark, sf_dir):
    table = W.work_table(chain(spark, sf_dir).select("bits"))
    return table.select("bits", "work", (F.col("difficulty") * 1_000_000).cast("decimal(38,0)").alias("difficulty_millionths"))


@query(f"WITH {_CHAIN} SELECT height, CAST(sum({_WORK}) OVER (ORDER BY height) AS DECIMAL(38,0)) AS cumulative_work FROM chain")
def cumulative_work(spark, sf_dir):
    return C.with_cumulative_work(chain(spark, sf_dir)).select("height", F.col("cumulative_work").cast("decimal(38,0)").alias("cumulative_work"))


_BRANCH = f"""{_CHAIN}, s AS (SELECT max(height) - 50 AS split FROM chain), w AS (SELECT sum({_WORK}) FILTER (WHERE height > split) AS ours, 40 * ((CAST(1 AS HUGEINT) << (256 - 8 * ((436591499 >> 24) - 3))) // (436591499 & 8388607)) AS theirs FROM chain, s),
best AS (SELECT height, hash FROM chain, s, w WHERE height <= split OR ours >= theirs
UNION ALL SELECT split + 1 + i AS height, sha256('branch' || i) AS hash FROM range(40) AS r(i), s, w WHERE theirs > ours)"""


def branch_from(ours: DataFrame, below: int, length: int, bits: int, name: str) -> DataFrame:
    """A branch of so many headers that leaves ours so far below the tip; heights count from 0."""
    top = ours.agg(F.max("height")).first()[0]
    root = ours.where(F.col("height") == top - below).select(F.col("hash").alias("root"))  # one row
    text = lambda i: F.sha2(F.concat(F.lit(name), i.cast("string")), 256)
    names = ours.sparkSession.range(length).select(F.col("id").alias("height"), text(F.col("id")).alias("hash"), F.when(F.col("id") > 0, text(F.col("id") - 1)).alias("p"))
    return names.join(F.broadcast(root)).select("height", "hash", F.coalesce("p", "root").alias("prev_hash"), F.lit(bits).cast("long").alias("bits"))


@query(f"WITH {_BRANCH} SELECT height, hash FROM best")
def most_work_branch(spark, sf_dir):
    ours = hashes(spark, sf_dir).select("height", "hash", "bits")
    return C.choose_branch(ours, branch_from(ours, 50, 40, BITS[3], "branch")).select("height", "hash")


@query(f"WITH {_BRANCH} SELECT height, hash FROM best")
def stream_reorganisation(spark, sf_dir):
    """Headers stream in without heights: the chain, a branch of 40 from 50 below its tip, then one of two light headers that isn't taken."""
    into, root = _store(spark, "reorganisation")
    ours = chain(spark, sf_dir).select("hash", "prev_hash", "bits", "height")
    schema = ours.drop("height").schema
    for rows in (ours, branch_from(ours, 50, 40, BITS[3], "branch"), branch_from(ours, 60, 2, BITS[0], "light")):
        rows.select(*schema.names).write.mode("append").option("compression", "zstd").parquet(f"{root}/source")  # a digit of a hash is half a byte
        T.ingest(spark, f"{root}/source", schema, into, f"{root}/checkpoint", None, files_each=1000)
    return into.read(T.HEADERS).select("height", "hash")


@query(f"WITH {_CHAIN} SELECT hash, height FROM chain")
def order_from_pointers(spark, sf_dir):
    """Heights of headers that come without, from their pointers alone."""
    origin = spark.createDataFrame([("00" * 32, -1)], "hash string, height long")
    return C.with_heights(chain(spark, sf_dir).select("hash", "prev_hash"), origin).select("hash", "height")


@query(f"""WITH {_CHAIN}, t AS (SELECT height, hash, lpad(format('{{:x}}', {_MANTISSA}) || repeat('00', CAST({_EXPONENT} - 3 AS BIGINT)), 64, '0') AS target FROM (SELECT height, hash, CASE WHEN height % 2 = 0 THEN 545259519 ELSE bits END AS bits FROM chain))
SELECT height, target, hash <= target AS meets FROM t""")
def pow_check(spark, sf_dir):
    rows = chain(spark, sf_dir).select("height", "hash", W.target_hex(F.when(F.col("height") % 2 == 0, F.lit(0x207FFFFF)).otherwise(F.col("bits"))).alias("target"))
    return rows.select("height", "target", W.meets_target(F.col("hash"), F.col("target")).alias("meets"))


@query(f"WITH {_CHAIN} SELECT height, hash FROM chain WHERE height < coalesce((SELECT min(height) FROM chain WHERE user_id = 7 AND height > 500), 1000000000)")
def blacklist_cut(spark, sf_dir):
    headers = chain(spark, sf_dir)
    return C.without_listed(headers.select("height", "hash"), headers.where("user_id = 7 and height > 500").select("hash"))


@query(f"WITH {_CHAIN} SELECT height, hash FROM chain WHERE height >= 100 AND height < 310")
def page_from(spark, sf_dir):
    first, end = api.block_range_from(100, 500)
    return chain(spark, sf_dir).where((F.col("height") >= first) & (F.col("height") < end)).select("height", "hash")


def ledger(spark: SparkSession, sf_dir: str) -> api.Ledger:
    """Headers from events; the bodies of all but the last hundred blocks: an order and its lines are a transaction, eight orders a block."""
    columns = F.struct(*LINE)
    empty = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in _t(spark, sf_dir, 'lineitem').select(*LINE).dtypes)}>>")

    def bodies(first: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Blocks and transactions, of a range of heights by a plain range of the tables' own keys."""
        within = lambda key: F.lit(True) if first is None else (F.col(key) >= 8 * first) & (F.col(key) < 8 * end)
        lines = _t(spark, sf_dir, "lineitem").where(within("l_orderkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(columns)).alias("outputs"))
        orders = _t(spark, sf_dir, "orders").where(within("o_orderkey")).select("o_orderkey", F.floor(F.col("o_orderkey") / 8).alias("height"), (F.col("o_orderkey") % 8).cast("int").alias("tx_index"))
        name = F.sha2(F.concat(F.lit("tx"), F.col("o_orderkey").cast("string")), 256)
        held = F.coalesce("outputs", empty)
        txs = orders.join(lines, "o_orderkey", "left").select("height", "tx_index", name.alias("txid"), F.sha2(name, 256).alias("wtxid"), F.array(F.struct(F.lit("00").alias("script"))).alias("inputs"), held.alias("outputs"), (F.lit(80) + F.size(held) * 34).cast("long").alias("wire_size"))
        return txs.groupBy("height").agg(F.count("*").alias("tx_count"), (F.sum("wire_size") + 80).alias("wire_size")), txs

    return api.Ledger(chain(spark, sf_dir).select("height", "hash", "bits"), *bodies(), bodies)


_LEDGER = f"""{_CHAIN}, l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), txs AS (SELECT o_orderkey // 8 AS height, o_orderkey % 8 AS tx_index, sha256('tx' || o_orderkey) AS txid, coalesce(n, 0) AS outputs, 80 + 34 * coalesce(n, 0) AS wire_size FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
blocks AS (SELECT height, count(*) AS tx_count, sum(wire_size) + 80 AS wire_size, bool_or(tx_index = 0) AS cb FROM txs GROUP BY 1)"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("height", "hash", F.col("info.tx_count").alias("tx_count"), F.col("info.wire_size").alias("wire_size"))


@query(f"WITH {_LEDGER} SELECT chain.height, hash, CASE WHEN cb THEN tx_count END AS tx_count, CAST(CASE WHEN cb THEN wire_size END AS BIGINT) AS wire_size FROM chain LEFT JOIN blocks USING (height) WHERE chain.height = (SELECT max(height) FROM chain)")
def tip(spark, sf_dir):
    return _flat(ledger(spark, sf_dir).tip())


@query(f"WITH {_LEDGER} SELECT chain.height, hash, CASE WHEN cb THEN tx_count END AS tx_count, CAST(CASE WHEN cb THEN wire_size END AS BIGINT) AS wire_size FROM chain LEFT JOIN blocks USING (height) WHERE chain.height BETWEEN 60 AND 269")
def blocks_page(spark, sf_dir):
    return _flat(ledger(spark, sf_dir).blocks_from(60, 210))


@query(f"WITH {_LEDGER} SELECT chain.height, hash, CASE WHEN cb THEN tx_count END AS tx_count, CAST(CASE WHEN cb THEN wire_size END AS BIGINT) AS wire_size FROM chain LEFT JOIN blocks USING (height) WHERE chain.height = 77")
def block_lookup(spark, sf_dir):
    return _flat(ledger(spark, sf_dir).block("77"))


_SHOWN = "chain.height, hash, CASE WHEN cb THEN tx_count END AS tx_count, CAST(CASE WHEN cb THEN wire_size END AS BIGINT) AS wire_size FROM chain LEFT JOIN blocks USING (height)"


@query(f"WITH {_LEDGER} SELECT {_SHOWN} WHERE chain.height BETWEEN 81 AND 120")
def page_to(spark, sf_dir):
    return _flat(ledger(spark, sf_dir).blocks_to(120, 40))


@query(f"WITH {_LEDGER} SELECT {_SHOWN} WHERE chain.height = 91")
def block_by_hash(spark, sf_dir):
    """The block of a hash as displayed."""
    row = _t(spark, sf_dir, "events").where("event_id = 91").select("event_id", "event_type", "user_id").first()
    body = "|".join(map(str, row)).encode()
    return _flat(ledger(spark, sf_dir).block(hashlib.sha256(hashlib.sha256(body).digest()).digest()[::-1].hex()))


_REVERSED = "array_to_string(list_reverse(regexp_extract_all({0}, '..')), '')"


@query(f"WITH {_LEDGER} SELECT CAST(tx_index AS INTEGER) AS tx_index, {_REVERSED.format('txid')} AS txid, {_REVERSED.format('sha256(txid)')} AS wtxid, CAST(1 AS INTEGER) AS inputs, CAST(outputs AS INTEGER) AS outputs, wire_size FROM txs WHERE height = 33 AND tx_index BETWEEN 2 AND 5")
def block_txs_page(spark, sf_dir):
    return ledger(spark, sf_dir).block_txs(33, 2, 4)


@query(f"WITH {_LEDGER} SELECT height, CAST(tx_index AS INTEGER) AS tx_index, CAST(outputs AS INTEGER) AS outputs FROM txs WHERE txid = sha256('tx' || 133)")
def tx_lookup(spark, sf_dir):
    shown = hashlib.sha256(b"tx133").digest()[::-1].hex()
    return ledger(spark, sf_dir).tx(shown).select("height", "tx_index", F.size("outputs").alias("outputs"))


@query(f"""WITH {_CHAIN}, k AS (SELECT CASE WHEN height % 3 = 0 THEN {_REVERSED.format('hash')} ELSE CAST(height AS VARCHAR) END AS key FROM chain)
SELECT key, CASE WHEN length(key) = 64 THEN NULL ELSE CAST(key AS BIGINT) END AS height, CASE WHEN length(key) = 64 THEN {_REVERSED.format('key')} END AS hash FROM k""")
def parse_block_keys(spark, sf_dir):
    headers = hashes(spark, sf_dir)
    keys = headers.select(F.when(F.col("height") % 3 == 0, B.reversed_hex(F.col("hash"))).otherwise(F.col("height").cast("string")).alias("key"))
    return keys.select("key", api.parse_block_key(F.col("key")).alias("p")).select("key", "p.height", "p.hash")


@query(f"WITH {_CHAIN} SELECT height, hash FROM chain WHERE height <= 800 UNION ALL SELECT height, sha256('new' || height) FROM chain WHERE height > 800 AND height <= 900")
def reorg_suffix_replace(spark, sf_dir):
    headers = chain(spark, sf_dir).select("height", "hash")
    suffix = headers.where("height > 800 and height <= 900").select("height", F.sha2(F.concat(F.lit("new"), F.col("height").cast("string")), 256).alias("hash"))
    return C.replace_suffix(headers, suffix, 800)


@query(f"WITH {_CHAIN} SELECT hash, height FROM chain WHERE height % 5 <> 0")
def verified_hash_lookup(spark, sf_dir):
    headers = chain(spark, sf_dir).select("height", "hash")
    stale = headers.select(F.when(F.col("height") % 5 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"), "height")
    return C.verified_lookup(stale, headers).select("hash", "height")


@query("SELECT p_partkey, sha256('k' || p_partkey) AS hashed FROM part WHERE p_partkey % 4 = 1")
def hashed_key_lookup(spark, sf_dir):
    """Keys looked up by their hash alone."""
    keys = _t(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256).alias("hashed"))
    return keys.join(keys.where("p_partkey % 4 = 1").select("hashed"), "hashed", "left_semi").select("p_partkey", "hashed")


@query(f"""WITH RECURSIVE {_CHAIN}, r(n, height, step) AS (SELECT 1, (SELECT max(height) FROM chain), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, height - CASE WHEN n >= 10 THEN step * 2 ELSE step END, CASE WHEN n >= 10 THEN step * 2 ELSE step END FROM r WHERE height > 0),
p AS (SELECT n, height FROM r WHERE height > 0), q AS (SELECT CAST(n - 1 AS INTEGER) AS position, height FROM p UNION ALL SELECT CAST((SELECT max(n) FROM p) AS INTEGER), 0)
SELECT position, q.height, hash FROM q JOIN chain USING (height)""")
def locator_heights(spark, sf_dir):
    return C.locator(chain(spark, sf_dir).select("height", "hash"))


_DONE = "done AS (SELECT event_id * 32 AS first, event_id * 32 + 32 AS \"end\" FROM events WHERE event_id < 200 OR event_id % 7 <> 3)"


@query(f"WITH {_DONE} SELECT min(\"end\") AS frontier FROM done WHERE \"end\" NOT IN (SELECT first FROM done)")
def contiguous_frontier(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_id < 200 or event_id % 7 <> 3")
    return C.frontier(e.select((F.col("event_id") * 32).alias("first"), (F.col("event_id") * 32 + 32).alias("end")))


@query("SELECT event_id AS height FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def want_set(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"))
    return C.want_set(e, e.where("height % 3 = 0"), e.where("height % 5 = 0"))


@query("SELECT place, CAST((row_number() OVER (ORDER BY place) - 1) % 6 AS INTEGER) AS slot FROM (SELECT event_id * 3 + event_id % 2 AS place FROM events)")
def round_robin_assignment(spark, sf_dir):
    """In turn by an order that has gaps."""
    return C.round_robin(_t(spark, sf_dir, "events").select((F.col("event_id") * 3 + F.col("event_id") % 2).alias("place")), 6, "place")


_IN_FLIGHT = "f AS (SELECT l_suppkey AS peer, count(*) FILTER (WHERE l_linestatus = 'O' AND l_orderkey % 4 = 0) AS in_flight FROM lineitem GROUP BY 1)"


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = (F.col("l_linestatus") == "O") & (F.col("l_orderkey") % 4 == 0)
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("peer")).agg(F.count_if(held).alias("in_flight"))


@query(f"""WITH {_IN_FLIGHT}, slots AS (SELECT peer, row_number() OVER (ORDER BY r, peer) - 1 AS message FROM f, range(0, 16) AS t(r) WHERE r < greatest(256 - in_flight, 0) // 16),
w AS (SELECT event_id AS height, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS message FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0) SELECT height, peer, message FROM w JOIN slots USING (message)""")
def peer_requests(spark, sf_dir):
    """What is asked next of whom: 16 heights a message, 256 in flight with a peer at most."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"))
    return C.requests(C.want_set(e, e.where("height % 3 = 0"), e.where("height % 5 = 0")), in_flight(spark, sf_dir))


@query(f"WITH {_IN_FLIGHT} SELECT CAST(sum(greatest(256 - in_flight, 0)) AS BIGINT) AS spare FROM f")
def spare_capacity(spark, sf_dir):
    return C.spare_room(in_flight(spark, sf_dir))


@query("SELECT l_suppkey AS peer, count(*) FILTER (WHERE l_linestatus = 'O') AS in_flight, greatest(256 - count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS spare FROM lineitem GROUP BY 1")
def inflight_per_peer(spark, sf_dir):
    n = F.count_if(F.col("l_linestatus") == "O")
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("peer")).agg(n.alias("in_flight"), F.greatest(256 - n, F.lit(0)).alias("spare"))


@query("SELECT user_id AS peer, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) FILTER (WHERE event_type = 'error') AS last_failed FROM events GROUP BY 1")
def peer_failures(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("peer")).agg(F.count_if(bad).alias("failures"), F.max(F.when(bad, F.col("ts"))).alias("last_failed"))


@query("SELECT s_suppkey AS peer FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2000 = 0)")
def available_peers(spark, sf_dir):
    busy = _t(spark, sf_dir, "lineitem").where("l_orderkey % 2000 = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey").join(busy, "s_suppkey", "left_anti").select(F.col("s_suppkey").alias("peer"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r(source, n, doc_id, chunk, fill) AS (SELECT source, n, doc_id, CAST(0 AS BIGINT), n_chars FROM d WHERE n = 1
 UNION ALL SELECT d.source, d.n, d.doc_id, CASE WHEN fill + n_chars > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN fill + n_chars > 20000 THEN n_chars ELSE fill + n_chars END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)
SELECT doc_id, chunk FROM r""")
def byte_budget_packing(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return C.pack_by_budget(docs, "source", "doc_id", "n_chars", 20_000).select("doc_id", "chunk")


# ---------------------------------------------------------------- hashes, codecs and locks

_REV = "array_to_string(list_reverse(regexp_extract_all({0}, '..')), '')"


@query("SELECT doc_id, sha256(unhex(sha256(text))) AS hash FROM documents")
def sha256d_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", B.to_hex(B.sha256d(F.col("text").cast("binary"))).alias("hash"))


@query(f"SELECT doc_id, {_REV.format('sha256(unhex(sha256(text)))')} AS shown, substr(sha256(unhex(sha256(text))), 1, 8) AS checksum FROM documents")
def hash_display_order(spark, sf_dir):
    data = F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", B.display_hash(B.sha256d(data)).alias("shown"), B.to_hex(B.checksum(data)).alias("checksum"))


def _leaves(docs: DataFrame) -> DataFrame:
    return docs.select("source", F.col("doc_id").alias("tx_index"), B.sha256d(F.col("text").cast("binary")).alias("txid"))


_MERKLE = """WITH RECURSIVE leaf AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, sha256(unhex(sha256(text))) AS h FROM documents),
lists AS (SELECT source, list(h ORDER BY i) AS l, false AS bad FROM leaf GROUP BY source),
up(source, l, bad, depth) AS (SELECT source, l, bad, 0 FROM lists
 UNION ALL SELECT source, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(unhex(sha256(unhex(l[2 * i + 1] || l[least(2 * i + 2, len(l))]))))),
  bad OR len(list_filter(range(0, len(l) // 2), lambda i: l[2 * i + 1] = l[2 * i + 2])) > 0, depth + 1 FROM up WHERE len(l) > 1)"""


@query(f"{_MERKLE} SELECT source, l[1] AS root FROM up WHERE len(l) = 1")
def merkle_root_by_source(spark, sf_dir):
    return V.merkle_roots(_leaves(_t(spark, sf_dir, "documents")), "source").select("source", "root")


@query(f"{_MERKLE} SELECT source, bad AS mutated FROM up WHERE len(l) = 1")
def merkle_mutation_flag(spark, sf_dir):
    return V.merkle_roots(_leaves(_t(spark, sf_dir, "documents")), "source").select("source", "mutated")


_HEXN = "lpad(lower(to_hex(CAST({0} AS BIGINT))), {1}, '0')"


def _sql_le(n: str, size: int) -> str:
    return _REV.format(_HEXN.format(n, 2 * size))


@query(f"""WITH n AS (SELECT event_id, event_id * event_id * 43 AS n FROM events) SELECT event_id, CASE WHEN n < 253 THEN {_sql_le('n', 1)} WHEN n <= 65535 THEN 'fd' || {_sql_le('n', 2)} WHEN n <= 4294967295 THEN 'fe' || {_sql_le('n', 4)} ELSE 'ff' || {_sql_le('n', 8)} END AS encoded,
CASE WHEN n <= 4294967295 THEN n END AS decoded FROM n""")
def compact_size_encode(spark, sf_dir):
    n = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * F.col("event_id") * 43).alias("n"))
    coded = n.select("event_id", B.compact_size_hex(F.col("n")).alias("encoded"))
    return coded.select("event_id", "encoded", B.from_compact_size(F.col("encoded")).alias("decoded"))


@query(f"SELECT event_id, {_HEXN.format('event_id % 16777216', 6)} AS u24, {_HEXN.format('event_id * 7919', 10)} AS u40, {_HEXN.format('event_id * 1234567', 12)} AS u48, {_HEXN.format('event_id * 12345678', 14)} AS u56, event_id * 1234567 AS back FROM events")
def u48_be_encode(spark, sf_dir):
    i = F.col("event_id")
    coded = _t(spark, sf_dir, "events").select("event_id", *[B.big_endian_hex(n, size).alias(f"u{8 * size}") for n, size in ((i % 16777216, 3), (i * 7919, 5), (i * 1234567, 6), (i * 12345678, 7))])
    return coded.select("*", B.from_big_endian(F.col("u48")).alias("back"))


def _sql_script_num(n: str) -> str:
    digits = f"to_hex(CAST(abs({n}) AS BIGINT))"
    even = f"lower(CASE WHEN length({digits}) % 2 = 1 THEN '0' || {digits} ELSE {digits} END)"
    high = f"substr({even}, 1, 1) >= '8'"
    neg = f"format('{{:02x}}', 128 + CAST('0x' || substr({even}, 1, 2) AS INTEGER)) || substr({even}, 3)"
    return f"CASE WHEN {n} = 0 THEN '' ELSE {_REV.format(f'''(CASE WHEN {high} THEN (CASE WHEN {n} < 0 THEN '80' ELSE '00' END) || {even} WHEN {n} < 0 THEN {neg} ELSE {even} END)''')} END"


@query(f"WITH n AS (SELECT event_id, event_id * (CASE WHEN event_id % 3 = 0 THEN -113 ELSE 271 END) AS n FROM events) SELECT event_id, {_sql_script_num('n')} AS encoded, n AS decoded FROM n")
def scriptnum_height(spark, sf_dir):
    n = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * F.when(F.col("event_id") % 3 == 0, -113).otherwise(271)).alias("n"))
    coded = n.select("event_id", B.script_num_hex(F.col("n")).alias("encoded"))
    return coded.select("event_id", "encoded", B.from_script_num(F.col("encoded")).alias("decoded"))


@query(f"""WITH n AS (SELECT event_id + 222931 AS height, event_id FROM events), p AS (SELECT *, {_sql_script_num('height')} AS s FROM n), q AS (SELECT *, lpad(lower(to_hex(length(s) // 2)), 2, '0') || s AS push FROM p)
SELECT height, push FROM q WHERE height >= 227931 AND event_id % 11 = 0""")
def bip34_prefix(spark, sf_dir):
    """Coinbases from the height of the rule on, every eleventh of which begins with something else."""
    rows = _t(spark, sf_dir, "events").select((F.col("event_id") + 222931).alias("height"), "event_id")
    push = B.height_push_hex(F.col("height"))
    made = rows.select("height", push.alias("push"), F.when(F.col("event_id") % 11 == 0, "00").otherwise(F.concat(push, F.lit("beef"))).alias("script"))
    return V.bad_coinbase_heights(made).select("height", "push")


_U32 = "(o_orderkey * 2654435761) % 4294967296"


def _u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned 32-bit values from order keys, with the special ones among them."""
    value = F.pmod(F.col("o_orderkey") * 2654435761, F.lit(1 << 32))
    special = F.when(F.col("o_orderkey") % 10 == 0, 0).when(F.col("o_orderkey") % 10 == 1, 0xFFFFFFFF).when(F.col("o_orderkey") % 10 == 2, F.col("o_orderkey")).otherwise(value)
    return _t(spark, sf_dir, "orders").select("o_orderkey", special.cast("long").alias("v"), (F.col("o_orderkey") % 4).alias("version"))


_SQL_U32 = f"u AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 4294967295 WHEN 2 THEN o_orderkey ELSE {_U32} END AS v, o_orderkey % 4 AS version FROM orders)"
_SQL_UTC = "strftime(make_timestamp(v * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


@query(f"""WITH {_SQL_U32} SELECT o_orderkey, CASE WHEN v = 0 THEN 'none' WHEN v < 500000000 THEN 'block' ELSE 'time' END AS kind, CASE WHEN v > 0 AND v < 500000000 THEN v END AS height, CASE WHEN v >= 500000000 THEN v END AS seconds, v AS back,
CASE WHEN v = 0 THEN 'none' WHEN v < 500000000 THEN 'block ' || v ELSE 'time ' || {_SQL_UTC} END AS shown FROM u""")
def locktime_decode(spark, sf_dir):
    rows = _u32(spark, sf_dir).select("o_orderkey", "v", L.lock_time(F.col("v")).alias("l"))
    return rows.select("o_orderkey", "l.*", L.lock_time_value(F.col("l")).alias("back"), L.format_lock_time(F.col("v")).alias("shown"))


_ENABLED = "v <> 4294967295 AND (v >> 31) & 1 = 0"
_TIMED = "(v >> 22) & 1 = 1"


@query(f"""WITH {_SQL_U32} SELECT o_orderkey, CASE WHEN v = 4294967295 THEN 'final' WHEN (v >> 31) & 1 = 1 THEN 'disable' ELSE 'enable' END AS kind, CASE WHEN {_ENABLED} THEN CASE WHEN {_TIMED} THEN 'time' ELSE 'block' END END AS lock_kind,
CASE WHEN {_ENABLED} AND NOT {_TIMED} THEN v & 65535 END AS blocks, CASE WHEN {_ENABLED} AND {_TIMED} THEN (v & 65535) * 512 END AS seconds,
CASE WHEN v = 4294967295 THEN NULL WHEN (v >> 31) & 1 = 1 THEN v & 2147483647 ELSE ((v >> 23) & 255) * 64 + ((v >> 16) & 63) END AS unused, v AS back,
CASE WHEN v = 4294967295 THEN 'final (0xffffffff)' WHEN (v >> 31) & 1 = 1 THEN 'disabled (raw: 0x' || lower(to_hex(v)) || ')' WHEN {_TIMED} THEN 'relative lock: ' || ((v & 65535) * 512) || 's' ELSE 'relative lock: ' || (v & 65535) || ' blocks' END AS shown FROM u""")
def sequence_decode(spark, sf_dir):
    rows = _u32(spark, sf_dir).select("o_orderkey", "v", L.sequence(F.col("v")).alias("l"))
    return rows.select("o_orderkey", "l.*", L.sequence_value(F.col("l")).alias("back"), L.format_sequence(F.col("v")).alias("shown"))


@query(f"WITH {_SQL_U32}, t AS (SELECT o_orderkey, CASE WHEN v = 0 AND version IN (1, 2) THEN version WHEN version IN (1, 2) THEN version + 2 ELSE 0 END AS tag FROM u) SELECT o_orderkey, CAST(tag AS INTEGER) AS tag, CAST(CASE WHEN tag IN (1, 2) THEN 1 WHEN tag IN (3, 4) THEN 5 ELSE 9 END AS INTEGER) AS bytes FROM t")
def locktime_version_tag(spark, sf_dir):
    tag = L.version_lock_tag(F.col("version"), F.col("v"))
    return _u32(spark, sf_dir).select("o_orderkey", tag.alias("tag"), L.version_lock_size(tag).alias("bytes"))


@query("SELECT event_id, CASE WHEN event_id * 1000 // 210000 >= 64 THEN 0 ELSE CAST(5000000000 AS BIGINT) >> CAST(event_id * 1000 // 210000 AS INTEGER) END AS subsidy FROM events")
def block_subsidy(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", W.subsidy(F.col("event_id") * 1000).alias("subsidy"))


@query("SELECT event_id * 100 // 210000 AS halving_epoch, event_id * 100 // 2016 AS difficulty_epoch, count(*) AS blocks FROM events GROUP BY 1, 2")
def halving_epoch(spark, sf_dir):
    h = F.col("event_id") * 100
    return _t(spark, sf_dir, "events").groupBy(W.halving_epoch(h).alias("halving_epoch"), W.difficulty_epoch(h).alias("difficulty_epoch")).agg(F.count("*").alias("blocks"))


@query("SELECT event_id, (SELECT max(event_id) FROM events) - event_id + 1 AS confirmations FROM events")
def confirmations(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id")
    return e.join(F.broadcast(e.agg(F.max("event_id").alias("top")))).select("event_id", (F.col("top") - F.col("event_id") + 1).alias("confirmations"))


@query("SELECT md5(text) AS txid, count(*) AS txs FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_txids(spark, sf_dir):
    """Ids of all documents, and one that two blocks bear of which one may repeat it."""
    txs = _t(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("txid"), F.col("doc_id").alias("height"))
    twice = spark.createDataFrame([("twice", -1, "00"), ("twice", *V.MAY_REPEAT[0])], "txid string, height long, hash string")
    # Documents are numbered as blocks from 200,000 on, beyond the blocks that may repeat.
    numbered = txs.withColumn("height", F.col("height") + 200_000)
    headers = numbered.select("height", F.lit("").alias("hash")).unionByName(twice.select("height", "hash"))
    return V.repeated_txids(numbered.unionByName(twice.select("txid", "height")), headers)


# ---------------------------------------------------------------- scripts and witnesses

_H = "sha256('k' || p_partkey)"
_SCRIPT = f"""(CASE p_partkey % 10 WHEN 0 THEN '76a914' || substr({_H}, 1, 40) || '88ac' WHEN 1 THEN 'a914' || substr({_H}, 1, 40) || '87' WHEN 2 THEN '0014' || substr({_H}, 1, 40) WHEN 3 THEN '0020' || {_H} WHEN 4 THEN '5120' || {_H}
 WHEN 5 THEN '2102' || {_H} || 'ac' WHEN 6 THEN '4104' || {_H} || {_H} || 'ac' WHEN 7 THEN '6a20' || {_H} WHEN 8 THEN '5121' || {_H} || '51ae' ELSE '76a914' || substr({_H}, 1, 40) END)"""
_KINDS = ("p2pkh", "p2sh", "p2wpkh", "p2wsh", "p2tr", "p2pk", "p2pkUncompressed", "opreturn", "raw", "raw")
_SQL_KIND = "(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END)"
_CUTS = ((7, 40), (5, 40), (5, 40), (5, 64), (5, 64), (3, 66), (3, 130), None, None, None)
_SQL_PAYLOAD = "(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {'s' if c is None else f'substr(s, {c[0]}, {c[1]})'}" for i, c in enumerate(_CUTS)) + " END)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256)
    short, lit = F.substring(h, 1, 40), F.lit
    made = (
        F.concat(lit("76a914"), short, lit("88ac")),
        F.concat(lit("a914"), short, lit("87")),
        F.concat(lit("0014"), short),
        F.concat(lit("0020"), h),
        F.concat(lit("5120"), h),
        F.concat(lit("2102"), h, lit("ac")),
        F.concat(lit("4104"), h, h, lit("ac")),
        F.concat(lit("6a20"), h),
        F.concat(lit("5121"), h, lit("51ae")),
        F.concat(lit("76a914"), short),
    )
    return _t(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*made), (F.col("p_partkey") % 10).cast("int")).alias("script"))


@query(f"WITH k AS (SELECT p_partkey, {_SCRIPT} AS s, {_SQL_KIND} AS kind FROM part) SELECT p_partkey, kind, {_SQL_PAYLOAD} AS payload FROM k")
def script_kind(spark, sf_dir):
    return scripts(spark, sf_dir).select("p_partkey", S.script_kind(F.col("script")).alias("kind"), S.script_payload(F.col("script")).alias("payload"))


@query(f"SELECT p_partkey, {_SCRIPT} AS script, true AS same FROM part")
def script_roundtrip(spark, sf_dir):
    rows = scripts(spark, sf_dir).select("p_partkey", "script", S.script_kind(F.col("script")).alias("k"), S.script_payload(F.col("script")).alias("p"))
    back = S.script_of(F.col("k"), F.col("p"))
    return rows.select("p_partkey", back.alias("script"), (back == F.col("script")).alias("same"))


_SIG = "repeat('30', 71 + CAST(p_partkey % 3 AS INTEGER))"
_SIG_COL = lambda: F.repeat(F.lit("30"), (71 + F.col("p_partkey") % 3).cast("int"))
#: Witness kinds of the analogue, by p_partkey mod 11: kind and items ('S' a signature, 'K' a key, else hex).
_WITNESSES = (
    ("none", ()),
    ("p2wpkh", ("S", "02" + "ab" * 32)),
    ("p2trKeyPath", ("cd" * 64,)),
    ("p2wsh1of1", ("", "S", "51" + "11" * 31 + "51ae")),
    ("p2wsh2of2", ("", "S", "S", "52" + "11" * 68 + "52ae")),
    ("p2wsh2of3", ("", "S", "S", "52" + "11" * 102 + "53ae")),
    ("p2wsh3of3", ("", "S", "S", "S", "53" + "11" * 102 + "53ae")),
    ("p2wsh1of2", ("", "S", "51" + "11" * 68 + "52ae")),
    ("p2wsh1of3", ("", "S", "51" + "11" * 102 + "53ae")),
    ("p2wshTimelock", ("S", "11" * 10 + "b1" + "22" * 28)),
    ("raw", ("00", "6300036f72640101aa", "c0")),
)


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.array(*[_SIG_COL() if x == "S" else F.lit(x) for x in items]).cast("array<string>") for _, items in _WITNESSES]
    return _t(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*made), (F.col("p_partkey") % 11).cast("int")).alias("items"))


_SQL_WITNESS = "(CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN [" + ", ".join(_SIG if x == "S" else f"'{x}'" for x in items) + "]::VARCHAR[]" for i, (_, items) in enumerate(_WITNESSES)) + " END)"


@query("SELECT p_partkey, CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(_WITNESSES)) + f" END AS kind, array_to_string({_SQL_WITNESS}, ' ') AS items FROM part")
def witness_kind(spark, sf_dir):
    rows = witnesses(spark, sf_dir).select("p_partkey", S.witness_kind(F.col("items")).alias("kind"), S.witness_fields(F.col("items")).alias("fields"))
    return rows.select("p_partkey", "kind", F.array_join(S.witness_of(F.col("kind"), F.col("fields")), " ").alias("items"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output and witness each, block = p_partkey / 10, place = p_partkey mod 10."""
    rows = scripts(spark, sf_dir).join(witnesses(spark, sf_dir), "p_partkey")
    key = F.col("p_partkey")
    zero = key % 13 == 0  # a first input that spends nothing
    tags = S.tx_features(key % 10, F.when(zero, "00" * 32).otherwise("11" * 32), F.when(zero, 0xFFFFFFFF).otherwise(0), F.array((F.lit(0xFFFFFFFD) + key % 3)), F.array("script"), F.array("items"), F.when(key % 4 == 0, key).otherwise(0))
    return rows.select(F.floor(key / 10).alias("block"), (key % 10).alias("place"), tags.alias("tags"))


_TAGS = """tags AS (SELECT p_partkey // 10 AS block, p_partkey % 10 AS place, list_filter([CASE WHEN p_partkey % 10 = 0 OR p_partkey % 13 = 0 THEN 'coinbase' END, CASE WHEN p_partkey % 11 > 0 THEN 'segwit' END, CASE WHEN p_partkey % 10 = 4 THEN 'taproot' END, CASE WHEN p_partkey % 10 = 7 THEN 'data' END,
 CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 3 = 0 THEN 'rbf' END, CASE WHEN p_partkey % 4 = 0 AND p_partkey <> 0 THEN 'locktime' END, CASE WHEN p_partkey % 11 = 10 THEN 'inscription' END, CASE WHEN p_partkey % 10 = 8 THEN 'multisig' END], lambda x: x IS NOT NULL) AS t FROM part)"""


@query(f"WITH {_TAGS} SELECT block, place, array_to_string(t, ' ') AS tags FROM tags")
def tx_feature_tags(spark, sf_dir):
    return transactions(spark, sf_dir).select("block", "place", F.array_join("tags", " ").alias("tags"))


@query(f"WITH {_TAGS}, u AS (SELECT block, list_distinct(flatten(list(t))) AS t FROM tags GROUP BY block) SELECT block, array_to_string(list_filter([{', '.join(repr(x) for x in S.BLOCK_FEATURES)}], lambda x: list_contains(t, x)), ' ') AS features FROM u")
def block_feature_union(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("block").agg(S.block_features(F.col("tags")).alias("features")).select("block", F.array_join("features", " ").alias("features"))


@query()
def script_addresses(spark, sf_dir):
    """base58 and bech32 addresses; not in SQL, held by golden vectors in the tests."""
    return scripts(spark, sf_dir).select("p_partkey", S.script_kind(F.col("script")).alias("kind"), S.address(F.col("script")).alias("address"))


@query(f"""WITH k AS (SELECT p_partkey, {_H} AS h, p_partkey % 10 AS m FROM part) SELECT p_partkey, CASE m WHEN 0 THEN 'OP_DUP OP_HASH160 <' || substr(h, 1, 40) || '> OP_EQUALVERIFY OP_CHECKSIG' WHEN 1 THEN 'OP_HASH160 <' || substr(h, 1, 40) || '> OP_EQUAL' WHEN 2 THEN 'OP_0 <' || substr(h, 1, 40) || '>' WHEN 3 THEN 'OP_0 <' || h || '>' WHEN 4 THEN 'OP_1 <' || h || '>'
 WHEN 5 THEN '<33b:02' || substr(h, 1, 62) || '…> OP_CHECKSIG' WHEN 6 THEN '<65b:04' || substr(h, 1, 62) || '…> OP_CHECKSIG' WHEN 7 THEN 'OP_RETURN <' || h || '>' WHEN 8 THEN 'OP_1 <33b:' || h || '…> OP_CHECKMULTISIG' ELSE 'OP_DUP OP_HASH160 <' || substr(h, 1, 40) || '>' END AS text FROM k""")
def script_disassembly(spark, sf_dir):
    return scripts(spark, sf_dir).select("p_partkey", S.disassemble(F.col("script")).alias("text"))


# ---------------------------------------------------------------- wire formats

_SQL_HEADER = f"{_sql_le('version', 4)} || {_REV.format('hash')} || hash || {_sql_le('t', 4)} || {_sql_le('bits', 4)} || {_sql_le('nonce', 4)}"


@query(f"""WITH {_CHAIN}, h AS (SELECT height, 1 + height % 4 AS version, hash, CAST(floor(epoch(ts)) AS BIGINT) AS t, bits, (height * 2654435761) % 4294967296 AS nonce FROM chain)
SELECT height, version, {_REV.format('hash')} AS prev_hash, hash AS merkle_root, t AS time, CAST(bits AS BIGINT) AS bits, nonce, sha256(unhex(sha256(unhex({_SQL_HEADER})))) AS hash FROM h""")
def wire_header_decode(spark, sf_dir):
    from .sources.wire import decode_header, encode_header

    rows = chain(spark, sf_dir).select("height", encode_header(1 + F.col("height") % 4, B.reversed_hex(F.col("hash")), F.col("hash"), F.unix_timestamp("ts"), F.col("bits"), F.pmod(F.col("height") * 2654435761, F.lit(1 << 32))).alias("raw"))
    return rows.select("height", decode_header(F.col("raw")).alias("h")).select("height", "h.*")


@query(f"""WITH k AS (SELECT p_partkey, {_SCRIPT} AS s, {_SQL_WITNESS} AS w, p_partkey % 2 + 1 AS version FROM part),
b AS (SELECT p_partkey, version, '01' || {_H} || '00000000' || '00' || 'ffffffff' || '01' || {_sql_le('p_partkey * 1000', 8)} || {_sql_le('length(s) // 2', 1)} || s AS body, len(w) AS n,
 {_sql_le('len(w)', 1)} || array_to_string(list_transform(w, lambda x: {_sql_le('length(x) // 2', 1)} || x), '') AS stack FROM k)
SELECT p_partkey, sha256(unhex(sha256(unhex({_sql_le('version', 4)} || body || '00000000')))) AS txid,
 sha256(unhex(sha256(unhex({_sql_le('version', 4)} || CASE WHEN n > 0 THEN '0001' ELSE '' END || body || CASE WHEN n > 0 THEN stack ELSE '' END || '00000000')))) AS wtxid, p_partkey * 1000 AS value, n AS witness_items FROM b""")
def wire_tx_decode(spark, sf_dir):
    from .sources.wire import INPUT, OUTPUT, decode_txs, encode_tx

    h = F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256)
    rows = scripts(spark, sf_dir).join(witnesses(spark, sf_dir), "p_partkey")
    ins = F.array(F.struct(h.alias("prev_txid"), F.lit(0).cast("long").alias("prev_vout"), F.lit("").alias("script"), F.lit(0xFFFFFFFF).alias("sequence"))).cast(f"array<{INPUT}>")
    outs = F.array(F.struct((F.col("p_partkey") * 1000).alias("value"), F.col("script"))).cast(f"array<{OUTPUT}>")
    raw = rows.select("p_partkey", encode_tx(F.col("p_partkey") % 2 + 1, ins, outs, F.array("items"), F.lit(0)).alias("raw"))
    items = F.coalesce(F.size(F.get("witness", F.lit(0))), F.lit(0))
    return decode_txs(raw, "raw", "p_partkey").select("p_partkey", "txid", "wtxid", F.get("outputs", F.lit(0))["value"].alias("value"), F.when(F.size("witness") == 0, 0).otherwise(items).cast("long").alias("witness_items"))


@query(f"""WITH k AS (SELECT p_partkey, {_SCRIPT} AS s, p_partkey % 2 + 1 AS version FROM part),
b AS (SELECT p_partkey, {_sql_le('version', 4)} || '01' || {_H} || '00000000' || '00' || 'ffffffff' || '01' || {_sql_le('p_partkey * 1000', 8)} || {_sql_le('length(s) // 2', 1)} || s || '00000000' AS body FROM k)
SELECT p_partkey // 300 AS block, CAST(row_number() OVER (PARTITION BY p_partkey // 300 ORDER BY p_partkey) - 1 AS INTEGER) AS tx_index, sha256(unhex(sha256(unhex(body)))) AS txid, CAST(NULL AS VARCHAR) AS error FROM b
UNION ALL SELECT -1, CAST(NULL AS INTEGER), NULL, '32 bytes wanted at 6 of 9'""")
def wire_block_decode(spark, sf_dir):
    """The transactions of blocks' bytes, some 300 to a block, and one that ends too soon."""
    from .sources.wire import INPUT, OUTPUT, decode_txs, encode_tx

    h = F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256)
    ins = F.array(F.struct(h.alias("prev_txid"), F.lit(0).cast("long").alias("prev_vout"), F.lit("").alias("script"), F.lit(0xFFFFFFFF).alias("sequence"))).cast(f"array<{INPUT}>")
    outs = F.array(F.struct((F.col("p_partkey") * 1000).alias("value"), F.col("script"))).cast(f"array<{OUTPUT}>")
    rows = scripts(spark, sf_dir).join(witnesses(spark, sf_dir), "p_partkey")
    raw = rows.select("p_partkey", F.hex(encode_tx(F.col("p_partkey") % 2 + 1, ins, outs, F.array("items"), F.lit(0))).alias("raw"))
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "raw")))
    blocks = raw.groupBy(F.floor(F.col("p_partkey") / 300).alias("block")).agg(listed.alias("l")).select("block", F.unhex(F.concat(B.compact_size_hex(F.size("l")), F.array_join(F.transform("l", lambda x: x["raw"]), ""))).alias("raw"))
    torn = spark.createDataFrame([(-1, bytes.fromhex("010100000001abcdef"))], "block long, raw binary")
    return decode_txs(blocks.unionByName(torn), "raw", "block", counted=True).select("block", "tx_index", "txid", "error")


# ---------------------------------------------------------------- formats


def _sql_scaled(v: str, base: int, units: tuple[str, ...], sep: str = " ") -> str:
    def text(i: int) -> str:
        d = f"CAST({v} AS DOUBLE) / {base**i}"
        x = f"format('{{:,.2f}}', {d} + CASE WHEN {d} * 8 = floor({d} * 8) THEN 1e-7 ELSE 0 END)"
        return f"regexp_replace(regexp_replace({x}, '0+$', ''), '\\.$', '') || '{sep if units[i] else ''}{units[i]}'"

    return "CASE " + " ".join(f"WHEN abs({v}) < {base ** (i + 1)} THEN {text(i)}" for i in range(len(units) - 1)) + f" ELSE {text(len(units) - 1)} END"


@query(f"WITH v AS (SELECT event_id, event_id * event_id * 37 AS v FROM events) SELECT event_id, {_sql_scaled('v', 1024, FM.BINARY_UNITS)} AS binary_size, {_sql_scaled('v', 1000, FM.DECIMAL_UNITS)} AS decimal_size, {_sql_scaled('v', 1000, FM.PLAIN_UNITS, '')} AS difficulty FROM v")
def format_bytes(spark, sf_dir):
    v = F.col("event_id") * F.col("event_id") * 37
    return _t(spark, sf_dir, "events").select("event_id", FM.bytes_binary(v).alias("binary_size"), FM.bytes_decimal(v).alias("decimal_size"), FM.difficulty(v).alias("difficulty"))


def _sql_relative(s: str) -> str:
    def text(unit: str, size: int) -> str:
        n = f"CAST(floor({s} / {size}.0 + 0.5) AS BIGINT)"
        many = f"CASE WHEN abs({n}) = 1 THEN '{unit}' ELSE '{unit}s' END"
        return f"CASE WHEN {n} < 0 THEN abs({n}) || ' ' || {many} || ' ago' ELSE 'in ' || {n} || ' ' || {many} END"

    return "CASE " + " ".join(f"WHEN abs({s}) >= {size} THEN {text(unit, size)}" for unit, size in FM.RELATIVE) + " ELSE 'now' END"


@query(f"WITH v AS (SELECT event_id, (event_id - 300) * abs(event_id - 300) AS s FROM events) SELECT event_id, {_sql_relative('s')} AS shown FROM v")
def relative_time(spark, sf_dir):
    i = F.col("event_id") - 300
    return _t(spark, sf_dir, "events").select("event_id", FM.relative_time(i * F.abs(i)).alias("shown"))


@query("""WITH v AS (SELECT event_id, (event_id * event_id * 977) // 1000 AS s FROM events), p AS (SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd' ELSE '' END || CASE WHEN s // 3600 % 24 > 0 THEN s // 3600 % 24 || 'h' ELSE '' END || CASE WHEN s // 60 % 60 > 0 THEN s // 60 % 60 || 'm' ELSE '' END || CASE WHEN s % 60 > 0 THEN s % 60 || 's' ELSE '' END AS t FROM v)
SELECT event_id, CASE WHEN t = '' THEN '0s' ELSE t END AS shown FROM p""")
def format_duration(spark, sf_dir):
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", FM.duration(i * i * 977).alias("shown"))


@query("SELECT o_orderkey, 'BTC ' || format('{:,.2f}', CAST(o_orderkey * 25000000 AS DOUBLE) / 100000000) AS coins, format('{:,}', o_orderkey) AS height, '0x' || lpad(lower(to_hex(o_orderkey % 4294967296)), 8, '0') AS version, CAST(month(o_orderdate) AS VARCHAR) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS day, CAST(least(o_orderkey / 4000000.0, 1) AS DOUBLE) AS fill FROM orders")
def format_coins(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", FM.coins(k * 25_000_000).alias("coins"), FM.height(k).alias("height"), FM.version(k).alias("version"), FM.date(F.col("o_orderdate")).alias("day"), FM.fill_ratio(k).alias("fill"))


@query(f"WITH {_CHAIN} SELECT height, array_to_string(list_transform(regexp_extract_all(hash, '..'), lambda x: CAST(floor(CAST('0x' || x AS INTEGER) / 255.0 * 360 + 0.5) AS INTEGER)), ' ') AS hues FROM chain")
def hash_hues(spark, sf_dir):
    return hashes(spark, sf_dir).select("height", F.array_join(FM.hues(F.col("hash")).cast("array<string>"), " ").alias("hues"))


@query("SELECT doc_id, text || chr(65533) || 'x' AS shown FROM documents")
def script_texts(spark, sf_dir):
    """Bytes that aren't UTF-8 as text."""
    data = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("ff78")))
    return _t(spark, sf_dir, "documents").select("doc_id", FM.script_text(data).alias("shown"))


# ---------------------------------------------------------------- streams

_BUCKET = "make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) // {0} * {0} * 1000000)"


@query(f"SELECT {_BUCKET.format(3600)} AS start, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def throughput_window(spark, sf_dir):
    return T.tumbling(_t(spark, sf_dir, "events"), "ts", 3600, F.col("user_id"))


@query(f"SELECT user_id, {_BUCKET.format(7200)} AS start, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2")
def throttle_first_last(spark, sf_dir):
    return T.throttled(_t(spark, sf_dir, "events"), "ts", 7200, "user_id", "event_id")


@query("""WITH g AS (SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later, ts FROM events) SELECT user_id, event_id AS last FROM g WHERE later IS NULL OR later >= ts + INTERVAL 3600 SECOND""")
def debounce_last(spark, sf_dir):
    return T.debounced(_t(spark, sf_dir, "events"), "ts", 3600, "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_wins(spark, sf_dir):
    return T.latest(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def _store(spark: SparkSession, what: str):
    """A new folder for snapshots and files in the shared folder that the session names."""
    from .plans.shared import new_dir
    from .plans.snapshot import Snapshots

    root = new_dir(spark, what)
    return Snapshots(spark, root), root


_STREAMED = "frontier AS (SELECT coalesce(min(event_id), 1000000000) AS f FROM events WHERE event_type = 'error' AND event_id > 600)"


@query(f"WITH {_STREAMED} SELECT event_id AS height, event_type, user_id FROM events, frontier WHERE event_id < f")
def stream_ingest_available_now(spark, sf_dir):
    """Events stream in four files, out of order and partly twice; 'error' rows after 600 are bad, so the frontier stops at the first."""
    into, root = _store(spark, "ingest")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"), "event_type", "user_id")
    part = F.pmod(F.col("height"), F.lit(4))
    twice = rows.where("height % 10 = 0").withColumn("part", F.pmod(F.col("height") + 1, F.lit(4)))
    rows.withColumn("part", part).unionByName(twice).repartition(4, "part").drop("part").write.parquet(f"{root}/source")
    valid = (F.col("event_type") != "error") | (F.col("height") <= 600)
    T.ingest(spark, f"{root}/source", rows.schema, into, f"{root}/checkpoint", valid, files_each=1)
    return T.committed(into)


@query("WITH f AS (SELECT coalesce(min(event_id), 1000000000) AS f FROM events WHERE event_type = 'error') SELECT event_id AS height, event_type, CASE WHEN event_type = 'error' THEN 'quarantine' WHEN event_id < f THEN 'rows' ELSE 'waiting' END AS held FROM events, f")
def bad_record_quarantine(spark, sf_dir):
    """Bad rows are set aside for good: when their heights come again, as good ones, they are dropped."""
    into, _ = _store(spark, "quarantine")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"), "event_type")
    again = rows.where("event_type = 'error'").withColumn("event_type", F.lit("mended"))
    for batch, given in enumerate((rows, again)):
        T.ingest_batch(given, batch, into, F.col("event_type") != "error")
    return T.quarantined(into).withColumn("held", F.lit("quarantine")).unionByName(into.read(T.ROWS).withColumn("held", F.lit("rows"))).unionByName(into.read(T.WAITING).withColumn("held", F.lit("waiting")))


@query("SELECT event_id AS height, event_type, user_id FROM events WHERE event_id <= 700 UNION ALL SELECT event_id, event_type, user_id + 1 FROM events WHERE event_id > 700 AND event_id <= 750")
def snapshot_truncate_recover(spark, sf_dir):
    """Two commits, a repeated one, one that a crash cut short, a step back to height 700, and another branch above it."""
    into, root = _store(spark, "snapshot")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"), "event_type", "user_id")
    into.commit({"blocks": rows.where("height < 500")}, batch="a")
    into.commit({"blocks": rows.where("height >= 500")}, batch="b")
    into.commit({"blocks": rows.where("height >= 500")}, batch="b")
    rows.where("height > 900").write.parquet(f"{root}/data/blocks/crashed")
    into.truncate(700)
    into.commit({"blocks": rows.where("height > 700 and height <= 750").withColumn("user_id", F.col("user_id") + 1)}, batch="c")
    into.vacuum()
    return into.read("blocks")


@query("SELECT event_id AS height, event_type, user_id FROM events")
def snapshot_compaction(spark, sf_dir):
    """Eight commits, then one part in place of theirs, and what is no more named removed."""
    into, _ = _store(spark, "compaction")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("height"), "event_type", "user_id")
    for i in range(8):
        into.commit({"blocks": rows.where(F.pmod("height", F.lit(8)) == i)}, batch=("blocks", i))
    into.compact("blocks")
    into.vacuum()
    assert len(into.manifest()["tables"]["blocks"]["parts"]) == 1
    return into.read("blocks")


@query("SELECT event_id, ts, user_id, event_type, props FROM events")
def zstd_archive_roundtrip(spark, sf_dir):
    _, root = _store(spark, "archive")
    _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props").write.option("compression", "zstd").parquet(f"{root}/archive")
    return spark.read.parquet(f"{root}/archive")


# ---------------------------------------------------------------- network and views


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '10.0.' || s_suppkey % 256 || '.7' WHEN 1 THEN '10.300.' || s_suppkey || '.7' WHEN 2 THEN 'fe80::' || lower(to_hex(s_suppkey)) WHEN 3 THEN 'a:b:c' ELSE 'node' || s_suppkey || '.onion' END AS host, s_suppkey % 5 IN (0, 2) AS valid FROM supplier")
def peer_hosts(spark, sf_dir):
    from .functions.network import valid_host

    k = F.col("s_suppkey")
    text = k.cast("string")
    host = F.when(k % 5 == 0, F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".7"))).when(k % 5 == 1, F.concat(F.lit("10.300."), text, F.lit(".7"))).when(k % 5 == 2, F.concat(F.lit("fe80::"), F.lower(F.hex(k)))).when(k % 5 == 3, "a:b:c").otherwise(F.concat(F.lit("node"), text, F.lit(".onion")))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", host.alias("host")).select("s_suppkey", "host", valid_host(F.col("host")).alias("valid"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '20010db8' || repeat('0', 20) || lpad(lower(to_hex(s_suppkey % 65535 + 1)), 4, '0') ELSE '00000000000000000000ffff' || lower(format('{:02X}{:02X}{:02X}{:02X}', 10, 0, CAST(s_suppkey % 256 AS INTEGER), 7)) END AS digits,
CASE WHEN s_suppkey % 3 = 0 THEN '2001:db8::' || lower(to_hex(s_suppkey % 65535 + 1)) ELSE '10.0.' || s_suppkey % 256 || '.7' END AS host FROM supplier""")
def peer_addresses(spark, sf_dir):
    from .functions.network import address_hex, address_text

    k = F.col("s_suppkey")
    host = F.when(k % 3 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 65535 + 1)))).otherwise(F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".7")))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", address_hex(host).alias("digits"))
    return rows.select("s_suppkey", "digits", address_text(F.col("digits")).alias("host"))


@query("""SELECT s_suppkey, CAST(70016 AS BIGINT) AS version, CAST(s_suppkey AS DECIMAL(20,0)) AS services, 1700000000 + s_suppkey AS time, '10.0.0.' || s_suppkey % 256 AS to_host, CAST(s_suppkey % 65536 AS INTEGER) AS to_port, '2001:db8::' || lower(to_hex(s_suppkey % 65535 + 1)) AS from_host, CAST(8333 AS INTEGER) AS from_port,
CAST(s_suppkey * 1000003 AS DECIMAL(20,0)) AS nonce, '/node:' || s_suppkey || '/' AS user_agent, s_suppkey - 5 AS height, s_suppkey % 2 = 0 AS relay, CAST(s_suppkey * 1000003 AS DECIMAL(20,0)) AS pong FROM supplier""")
def handshakes(spark, sf_dir):
    """Version messages and pings, written and read back."""
    from .sources import messages as M

    k, lit = F.col("s_suppkey").cast("long"), F.lit
    fields = {"version": lit(70016), "services": k, "time": k + 1_700_000_000, "to_services": lit(0), "to_host": F.concat(lit("10.0.0."), (k % 256).cast("string")), "to_port": k % 65536, "from_services": lit(9), "from_host": F.concat(lit("2001:db8::"), F.lower(F.hex(k % 65535 + 1))), "from_port": lit(8333), "nonce": k * 1000003}
    payload = M.version_payload(fields, F.concat(lit("/node:"), k.cast("string"), lit("/")), k - 5, k % 2 == 0)
    read = _t(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("p"), M.ping_nonce(M.ping_message(k * 1000003)).alias("pong")).withColumn("v", M.version_message(F.col("p")))
    return read.select("s_suppkey", *[F.col(f"v.{n}").alias(n) for n in ("version", "services", "time", "to_host", "to_port", "from_host", "from_port", "nonce", "user_agent", "height", "relay")], "pong")


@query(f"""WITH {_CHAIN}, f AS (SELECT height, CASE height % 5 WHEN 0 THEN '#/block/' || height WHEN 1 THEN '#/block/' || hash WHEN 2 THEN '#/tx/' || hash WHEN 3 THEN '#/tx/' || height ELSE '#/block/-' || height END AS fragment, hash FROM chain)
SELECT fragment, CASE height % 5 WHEN 0 THEN 'block.height' WHEN 1 THEN 'block.hash' WHEN 2 THEN 'tx' ELSE 'home' END AS kind, CASE WHEN height % 5 = 0 THEN height END AS height, CASE WHEN height % 5 IN (1, 2) THEN {_REV.format('hash')} END AS hash FROM f""")
def url_fragments(spark, sf_dir):
    from .functions.network import fragment

    h = F.col("height")
    text = h.cast("string")
    made = F.when(h % 5 == 0, F.concat(F.lit("#/block/"), text)).when(h % 5 == 1, F.concat(F.lit("#/block/"), F.col("hash"))).when(h % 5 == 2, F.concat(F.lit("#/tx/"), F.col("hash"))).when(h % 5 == 3, F.concat(F.lit("#/tx/"), text)).otherwise(F.concat(F.lit("#/block/-"), text))
    return chain(spark, sf_dir).select(made.alias("fragment")).select("fragment", fragment(F.col("fragment")).alias("f")).select("fragment", "f.*")


@query(f"WITH {_CHAIN}, t AS (SELECT max(height) AS top FROM chain) SELECT top - i AS height, hash FROM t, range(60, 112) AS r(i) LEFT JOIN chain ON chain.height = top - i AND chain.height % 7 <> 0")
def timeline_window(spark, sf_dir):
    """The rows on show, newest first, with a gap where a block isn't there yet: position 70 of pages of 32 with 4 more on either side."""
    top = chain(spark, sf_dir).agg(F.max("height").alias("top"))
    start, take = api.window_bounds(position=70, visible=12, total=1000)
    wanted = spark.range(start, start + take).join(F.broadcast(top)).select((F.col("top") - F.col("id")).alias("height"))
    return wanted.join(chain(spark, sf_dir).where("height % 7 <> 0").select("height", "hash"), "height", "left")


@query(f"WITH {_OUT}, b AS (SELECT tx // 100 AS block, min(output_index) AS first FROM out GROUP BY 1) SELECT block, first, coalesce(lead(first) OVER (ORDER BY block), (SELECT count(*) FROM out)) AS \"end\" FROM b")
def tx_region_bounds(spark, sf_dir):
    """Where each block's outputs begin and the next one's: a block's range is [first, end)."""
    found = outputs(spark, sf_dir).groupBy(F.floor(F.col("tx") / 100).alias("block")).agg(F.min("output_index").alias("first"))
    return I.region_bounds(found, _t(spark, sf_dir, "lineitem").count())


@query("SELECT sha256('h' || event_id) AS hash FROM events")
def record_file(spark, sf_dir):
    """Hashes in files of 32-byte records, each of which ends in a part of one that a crash cut short."""
    from .sources.records import register

    _, root = _store(spark, "records")

    def write(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(f"{root}/files")
        fs.create_dir(path, recursive=True)
        name, n = f"{path}/.{os.urandom(8).hex()}", 0
        with fs.open_output_stream(name) as f:
            for b in batches:
                for digits in b.column(0).to_pylist():
                    f.write(bytes.fromhex(digits))
                    n += 1
            f.write(b"torn")
        fs.move(name, name.replace("/.", "/"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    _t(spark, sf_dir, "events").select(F.sha2(F.concat(F.lit("h"), F.col("event_id").cast("string")), 256).alias("hash")).repartition(4).mapInArrow(write, "n long").collect()
    register(spark)
    got = spark.read.format("ledger_records").option("rangeBytes", 64_000).load(f"{root}/files")
    return got.select(F.lower(F.hex("record")).alias("hash"))


@query("SELECT sha256('h' || event_id) AS hash FROM events WHERE event_id < 400 UNION SELECT sha256('h' || event_id) FROM events WHERE event_type = 'error'")
def blacklist_append(spark, sf_dir):
    """A list of rejected hashes, and what is new to it once each."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.sha2(F.concat(F.lit("h"), F.col("event_id").cast("string")), 256).alias("hash"))
    listed = e.where("event_id < 400").select("hash")
    bad = e.where("event_type = 'error'").select("hash").distinct()
    return listed.unionByName(bad.join(listed, "hash", "left_anti"))


@query(f"""WITH {_CHAIN}, n AS (SELECT user_id, count(*) AS n FROM chain GROUP BY 1) SELECT user_id AS peer, n AS headers, true AS same FROM n""")
def headers_messages(spark, sf_dir):
    """Messages of at most MOST_HEADERS of each peer's headers, read back, and their sums by peer."""
    from .sources import messages

    raw = F.concat(F.lit("01000000"), F.col("hash"), F.col("hash"), F.lit("00" * 12))
    rows = chain(spark, sf_dir).select(F.col("user_id").alias("peer"), "height", raw.alias("raw"))
    held = _numbered(rows, messages.MOST_HEADERS).groupBy("peer", "message").agg(F.transform(F.array_sort(F.collect_list(F.struct("height", "raw"))), lambda x: x["raw"]).alias("l"))
    read = held.select("peer", "l", messages.headers(messages.headers_message(F.col("l"))).alias("back"))
    same = F.coalesce(F.col("back") == F.col("l"), F.lit(False))
    return read.groupBy("peer").agg(F.sum(F.size("back").cast("long")).alias("headers"), F.min(same).alias("same"))


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """rows (peer, height) with a message number: each peer's in order of height, at most so many a message."""
    return with_rank(rows, "rank", "peer", "height").withColumn("message", F.floor(F.col("rank") / most)).drop("rank")


@query("SELECT event_id, event_type AS command, sha256(props) AS payload FROM events")
def frame_source(spark, sf_dir):
    """Frames written to files and read through the data source."""
    return _framed(spark, _t(spark, sf_dir, "events").repartitionByRange("event_id"))


def _framed(spark: SparkSession, events: DataFrame) -> DataFrame:
    from .sources.frames import MAGIC, register

    _, root = _store(spark, "frames")
    rows = events.select("event_id", "event_type", "props")

    def write(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs as pafs

        from .sources.wire import framed

        fs, path = pafs.FileSystem.from_uri(f"{root}/files")
        fs.create_dir(path, recursive=True)
        for b in batches:
            if b.num_rows:
                name = f"{path}/{b.column(0)[0].as_py():08d}"
                own = f"{path}/.{os.urandom(8).hex()}"
                with fs.open_output_stream(own) as f:
                    for i, command, props in zip(*(b.column(k).to_pylist() for k in range(3))):
                        f.write(b"noise" + framed(bytes.fromhex(MAGIC), command, i.to_bytes(8, "little") + props.encode()))
                fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.sortWithinPartitions("event_id").mapInArrow(write, "n long").count()
    register(spark)
    got = spark.read.format("ledger_frames").load(f"{root}/files")
    number = F.conv(B.reversed_hex(F.lower(F.hex(F.substring("payload", 1, 8)))), 16, 10).cast("long")
    return got.select(number.alias("event_id"), "command", F.sha2(F.expr("substring(payload, 9)"), 256).alias("payload"))


@query("SELECT CAST(0 AS BIGINT) AS height, '000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f' AS hash, '4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b' AS merkle_root, CAST(1231006505 AS BIGINT) AS time, CAST(486604799 AS BIGINT) AS bits, CAST(2083236893 AS BIGINT) AS nonce, '4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b' AS txid, CAST(5000000000 AS BIGINT) AS value, true AS meets_target")
def genesis_block(spark, sf_dir):
    """The constant first block, decoded."""
    from .sources import genesis

    tx = genesis.transactions(spark).select("height", B.reversed_hex(F.col("txid")).alias("txid"), F.get("outputs", F.lit(0))["value"].alias("value"))
    h = genesis.header(spark).join(tx, "height")
    shown = B.reversed_hex(F.col("hash"))
    return h.select("height", shown.alias("hash"), B.reversed_hex(F.col("merkle_root")).alias("merkle_root"), "time", "bits", "nonce", "txid", "value", W.meets_target(shown, W.target_hex(F.col("bits"))).alias("meets_target"))
