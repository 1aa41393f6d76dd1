"""Header chains: links, valid prefixes, heaviest branches, locators, reorganisations.

Headers have (height, hash, prev_hash, bits, ...). Links are self-joins on
height, so a chain of any length is checked in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.work import EPOCH, meets_target, target_hex, work_table
from ..plans.shared import checkpoint, remove, stored, sweep, work_dir
from .prefix import with_index, with_running_sum


def with_link(headers: DataFrame) -> DataFrame:
    """Headers with linked: whether prev_hash is the hash at the height below (true at the lowest height)."""
    below = headers.select((F.col("height") + 1).alias("height"), F.col("hash").alias("__below"))
    lowest = headers.agg(F.min("height").alias("__low"))
    joined = headers.join(below, "height", "left").join(F.broadcast(lowest))  # one row
    return joined.withColumn("linked", F.coalesce(F.col("prev_hash") == F.col("__below"), F.col("height") == F.col("__low"))).drop("__below", "__low")


def prefix_until(rows: DataFrame, bad: Column, order: str) -> DataFrame:
    """The rows before the first bad one."""
    first = rows.where(bad).agg(F.min(order).alias("__first"))
    return rows.join(F.broadcast(first)).where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__first")


def valid_prefix(headers: DataFrame, check_work: bool = False) -> DataFrame:
    """Headers up to the first that isn't linked (or, if asked, whose hash doesn't meet its target)."""
    linked = with_link(headers)
    bad = ~F.col("linked")
    if check_work:
        bad = bad | ~meets_target(F.col("hash"), target_hex(F.col("bits")))
    return prefix_until(linked, bad, "height").drop("linked")


def without_listed(headers: DataFrame, listed: DataFrame) -> DataFrame:
    """A batch of headers cut before the first whose hash is listed."""
    marked = headers.join(listed.select("hash").distinct().withColumn("__listed", F.lit(True)), "hash", "left")
    return prefix_until(marked, F.col("__listed").isNotNull(), "height").drop("__listed")


def with_work(headers: DataFrame) -> DataFrame:
    """Headers with work and difficulty of their bits: a join with the distinct values."""
    return headers.join(work_table(headers), "bits", "left")


def with_cumulative_work(headers: DataFrame) -> DataFrame:
    return with_running_sum(with_work(headers), "cumulative_work", F.col("work").cast("decimal(38,0)"), F.floor(F.col("height") / EPOCH), ["height"])


def _reach(headers: DataFrame, weight: Column) -> list[DataFrame]:
    """By round, where each header's pointers lead: (hash, up, far, weight), far headers on, these weighing so much with itself.

    Each round doubles how far that is, until it is out of the headers, so a
    chain of n takes about log2(n) rounds; equal headers count once.
    """
    reach = checkpoint(headers.select("hash", F.col("prev_hash").alias("up"), F.lit(1).cast("long").alias("far"), weight.cast("decimal(38,0)").alias("weight")).dropDuplicates(["hash"]))
    rounds = [reach]
    for _ in range(max(1, reach.count()).bit_length() + 1):  # more would be a circle
        on = reach.select(F.col("hash").alias("up"), F.col("up").alias("further"), F.col("far").alias("more"), F.col("weight").alias("heavier"))
        met = reach.join(on, "up", "left")
        grown = [F.coalesce("further", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), (F.col("weight") + F.coalesce("heavier", F.lit(0))).cast("decimal(38,0)").alias("weight")]
        new = checkpoint(met.select("hash", *grown, F.col("further").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        reach = new.drop("moved")
        rounds.append(reach)
    return rounds


#: Links that are followed in one task.
REST = 1 << 16
#: Ends of links that are looked up where the headers are, at most.
FEW = 10_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, up, far) of REST rows at most as (id, top, far): where the pointers lead out of them, or onto a circle."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    links = {i: (up, far) for i, up, far in zip(*(c.to_pylist() for c in table.columns))}
    ends: dict[int, tuple[int, int]] = {}
    for i in links:
        path, on = [], set()
        while i in links and i not in ends and i not in on:
            path.append(i)
            on.add(i)
            i = links[i][0]
        top, far = ends.get(i, (i, 0))
        for x in reversed(path):
            far += links[x][1]
            ends[x] = top, far
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*((i, *end) for i, end in ends.items()))], names=["id", "top", "far"])


def _tops(links: DataFrame, folder: str) -> DataFrame:
    """(id, top, far) of links (id, up, far): the first pointer that leads out of them, or onto a circle, and how far that is.

    A round takes out each link with a coin of 0 whose pointer has a 1, about a
    quarter; those that pointed at one point past it. So each round has fewer
    rows, until few enough are left for one task; then those taken out find
    where their pointers lead, the last first.
    """
    spark, live, out, k = links.sparkSession, links, [], 0
    while live.where("id <> up").limit(REST + 1).count() > REST:  # what points at itself is a circle
        coin = lambda c: F.xxhash64(F.lit(k), F.col(c)).bitwiseAND(F.lit(1))  # noqa: B023, E731
        apart = (coin("id") == 0) & (coin("up") == 1)
        out.append(stored(live.where(apart), f"{folder}/out-{k}"))
        past = out[-1].select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("far").alias("__far"))
        moved = live.where(coin("up") == 0).join(past, "up", "left").select("id", F.coalesce("__up", "up").alias("up"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"))
        live = stored(live.where((coin("up") == 1) & (coin("id") == 1)).unionByName(moved), f"{folder}/live-{k}")
        remove(f"{folder}/live-{k - 1}" if k else f"{folder}/links")
        k += 1
        sweep(spark)
    schema = "id long, top long, far long"
    circles = live.where("id = up").select("id", F.col("up").alias("top"), "far")
    found = stored(live.where("id <> up").coalesce(1).mapInArrow(_followed, schema).unionByName(circles), f"{folder}/found")
    while out:
        k -= 1
        on = found.select(F.col("id").alias("up"), "top", F.col("far").alias("__far"))
        met = out.pop().join(on, "up", "left").select("id", F.coalesce("top", "up").alias("top"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"))
        found = found.unionByName(stored(met, f"{folder}/found-{k}"))
        remove(f"{folder}/out-{k}")
        sweep(spark)
    return found


def with_heights(headers: DataFrame, known: DataFrame) -> DataFrame:
    """Headers (hash, prev_hash, ...) in any order, with the height that their pointers give them above known ones (hash, height).

    Headers whose pointers lead to no known one have a null height, as have
    those on a circle. Pointers are followed by 64-bit hashes of the hashes; if
    two of those have one (a second hash tells them apart), by themselves.
    """
    spark = headers.sparkSession
    folder = work_dir(spark, "heights")
    name, other = (lambda c: F.xxhash64(F.col(c))), (lambda c: F.xxhash64(F.lit("other"), F.col(c)))
    named = headers.where("hash is not null").select(F.explode(F.array(
        F.struct(name("hash").alias("id"), other("hash").alias("o"), name("prev_hash").alias("up")),
        F.struct(name("prev_hash").alias("id"), other("prev_hash").alias("o"), F.lit(None).cast("long").alias("up")),
    )).alias("x")).select("x.*")
    listed = stored(named.groupBy("id").agg(F.min("up").alias("up"), (F.min("o") != F.max("o")).alias("clash"), F.lit(1).cast("long").alias("far")), f"{folder}/links")
    if listed.where("clash").limit(1).count():
        return _with_heights_by_hash(headers, known)
    found = _tops(listed.where("up is not null").select("id", "up", "far"), folder)
    tops = stored(found.select("top").distinct(), f"{folder}/tops")
    near = F.broadcast if tops.limit(FEW + 1).count() <= FEW else (lambda x: x)
    ends = headers.select(name("prev_hash").alias("top"), F.col("prev_hash").alias("hash")).join(near(tops), "top", "left_semi").distinct()
    bases = stored(known.select("hash", F.col("height").alias("__base")).join(near(stored(ends, f"{folder}/ends")), "hash").select("top", "__base"), f"{folder}/bases")
    placed = found.join(near(bases), "top", "left").select(F.col("id").alias("__id"), (F.col("__base") + F.col("far")).alias("height"))
    sweep(spark)
    more = [c for c in headers.columns if c not in ("hash", "height")]
    return headers.drop("height").where("hash is not null").withColumn("__id", name("hash")).join(placed, "__id").select("hash", *more, "height")


def _with_heights_by_hash(headers: DataFrame, known: DataFrame) -> DataFrame:
    base = known.select(F.col("hash").alias("up"), F.col("height").alias("__base"))
    placed = _reach(headers, F.lit(0))[-1].join(base, "up", "left").select("hash", (F.col("__base") + F.col("far")).alias("height"))
    return headers.drop("height").join(placed, "hash")


def heaviest(headers: DataFrame) -> DataFrame:
    """Of headers (hash, prev_hash, bits, ...), the branch of most work that leads to one of them, from where it leaves all of them on."""
    rounds = _reach(with_work(headers), F.col("work"))
    best = rounds[-1].orderBy(F.desc("weight"), "hash").select("hash").limit(1)
    on_branch = checkpoint(best)
    for reach in reversed(rounds):
        further = reach.join(on_branch, "hash", "left_semi").select(F.col("up").alias("hash"))
        on_branch = checkpoint(on_branch.unionByName(further).distinct())
    return headers.join(on_branch, "hash", "left_semi")


def choose_branch(ours: DataFrame, branch: DataFrame) -> DataFrame:
    """The canonical headers after branch, a batch linked to one of ours, is offered.

    The valid prefix of branch is taken if it extends our tip, or has strictly
    more work than ours above the height it leaves from; else, and if it
    attaches nowhere, ours stay. Heights of branch count from 0 on input order
    and are set here. Only where it leaves and the tip are looked for in all of
    ours; work is summed above the split alone.
    """
    split, take, placed = weighed(ours, branch)
    if not take:
        return ours
    return ours.where(F.col("height") <= split).unionByName(placed.select(*ours.columns))


def weighed(ours: DataFrame, branch: DataFrame) -> tuple[int | None, bool, DataFrame | None]:
    """The height that branch leaves from, whether it is taken, and its valid prefix with heights above that."""
    branch = checkpoint(branch)  # what is offered is a message or some, and is looked at several times
    first = branch.agg(F.min_by("prev_hash", "height").alias("hash"), F.min("height").alias("base")).first()
    split, tip = ours.agg(F.max(F.when(F.col("hash") == F.lit(first["hash"]), F.col("height"))), F.max("height")).first()
    if split is None:
        return None, False, None
    placed = checkpoint(valid_prefix(branch).withColumn("height", F.col("height") - first["base"] + split + 1))
    if split == tip:
        return split, True, placed
    theirs = with_work(placed).agg(F.sum("work")).first()[0] or 0
    mine = with_work(ours.where(F.col("height") > split)).agg(F.sum("work")).first()[0] or 0
    return split, theirs > mine, placed


def replace_suffix(rows: DataFrame, suffix: DataFrame, split: int, height: str = "height") -> DataFrame:
    """rows up to the split height, then suffix."""
    return rows.where(F.col(height) <= split).unionByName(suffix)


def locator_heights(tip: int) -> list[int]:
    """Heights of a locator from tip: ten in a row, then in steps that double, then the genesis block."""
    out, step, at = [], 1, tip
    while at > 0:
        out.append(at)
        step = step * 2 if len(out) >= 10 else step
        at -= step
    return [*out, 0]


def locator(headers: DataFrame) -> DataFrame:
    """(position, height, hash) of the locator: about log2 of the chain's length rows."""
    tip = headers.agg(F.max("height")).first()[0]
    heights = locator_heights(tip) if tip is not None else []
    wanted = headers.sparkSession.createDataFrame(list(enumerate(heights)), "position int, height long")
    return headers.join(F.broadcast(wanted), "height").select("position", "height", "hash")


def verified_lookup(index: DataFrame, headers: DataFrame) -> DataFrame:
    """(hash, height) rows of an index of hashes that the header at that height still bears."""
    return index.join(headers.select("height", "hash"), ["height", "hash"], "left_semi")


def frontier(ranges: DataFrame) -> DataFrame:
    """One row: the end of what is done without a gap from the least start. ranges: (first, end), end excluded, which don't overlap."""
    starts = ranges.select(F.col("first").alias("at"))
    ends = ranges.select(F.col("end").alias("at"))
    gaps = ends.join(starts, "at", "left_anti")  # ends where no range goes on
    return gaps.agg(F.min("at").alias("frontier"))


def want_set(headers: DataFrame, bodies: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Heights whose body is neither there nor asked for."""
    return headers.select("height").join(bodies.select("height"), "height", "left_anti").join(in_flight.select("height"), "height", "left_anti")


def requests(wanted: DataFrame, peers: DataFrame, batch: int = 16, most: int = 256) -> DataFrame:
    """(height, peer, message) of what is asked next of whom: peers (peer, in_flight) in turn, no more than most in flight with each.

    The lowest heights go first, in messages of batch heights; what no peer has
    room for is left out, to be asked later.
    """
    room = peers.select("peer", F.floor(F.greatest(most - F.col("in_flight"), F.lit(0)) / batch).cast("int").alias("rounds"))
    # Peers take turns: a round gives a message to each that still has room.
    slots = room.where("rounds > 0").select("peer", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"))
    slots = with_index(slots, "message", F.col("round"), ["round", "peer"]).select("message", "peer")
    bucket = F.floor(F.col("height") / (1 << 16))
    listed = with_index(wanted.select("height"), "__at", bucket, ["height"])
    return listed.select("height", F.floor(F.col("__at") / batch).alias("message")).join(slots, "message").select("height", "peer", "message")


def spare_room(peers: DataFrame, most: int = 256) -> DataFrame:
    """One row: how much more all peers (peer, in_flight) may be asked for."""
    return peers.agg(F.coalesce(F.sum(F.greatest(most - F.col("in_flight"), F.lit(0))), F.lit(0)).alias("spare"))


def round_robin(rows: DataFrame, slots: int, order: str, width: int = 1 << 16) -> DataFrame:
    """rows with slot 0 to slots - 1 in turn. order: integers, which may have gaps."""
    placed = with_index(rows, "__at", F.floor(F.col(order) / width), [order])
    return placed.withColumn("slot", F.pmod("__at", F.lit(slots)).cast("int")).drop("__at")


def _next_chunks(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sizes before each row (and all), and for each row that begins a chunk, the one that begins the next."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return sums, np.maximum(np.searchsorted(sums[1:], sums[:-1] + budget, side="right"), at + 1)


def pack_by_budget(rows: DataFrame, group: str, order: str, size: str, budget: int, width: int = 1 << 16) -> DataFrame:
    """rows with chunk: each group's rows in order fill chunks up to budget; one that is larger stands alone.

    Where a chunk ends depends on all rows before, but only by how full the open
    chunk is. So each range of the order (integers, width of them) first tells,
    for every row that may be its first to begin a chunk, how many chunks follow
    and how full the last one is; these few numbers are folded along each group,
    and then every range is filled by itself. Null sizes count as 0.
    """
    kinds = dict(rows.dtypes)
    listed = rows.select(F.col(group).alias("g"), F.floor(F.col(order) / width).alias("b"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))

    def sorted_by(table: pa.Table, column: str) -> pa.Table:
        return table.sort_by([(column, "ascending")])

    def summary(table: pa.Table) -> pa.Table:
        table = sorted_by(table, "o")
        sums, after = _next_chunks(table.column("s").to_numpy(), budget)
        n = len(after)
        chunks, fill = np.ones(n, np.int64), sums[n] - sums[:-1]
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                chunks[i], fill[i] = 1 + chunks[after[i]], fill[after[i]]
        firsts = min(n, int(np.searchsorted(sums[1:], budget, side="right")) + 1)  # rows that may be the first to begin a chunk
        held = [("sums", sums[1 : firsts + 1]), ("chunks", chunks[:firsts]), ("fills", fill[:firsts])]
        return pa.table([table.column("g").slice(0, 1), table.column("b").slice(0, 1), pa.array([int(sums[n])]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for _, x in held]], names=["g", "b", "total", *[k for k, _ in held]])

    def fold(table: pa.Table) -> pa.Table:
        table = sorted_by(table, "b")
        chunk, fill, out = -1, budget + 1, []
        for total, sums, chunks, fills in zip(*(table.column(c).to_pylist() for c in ("total", "sums", "chunks", "fills"))):
            out.append((chunk, fill))
            first = 0 if chunk < 0 else int(np.searchsorted(sums, budget - fill, side="right"))
            if first < len(sums):
                chunk, fill = chunk + chunks[first], fills[first]
            else:
                fill += total
        return pa.table([table.column("g"), table.column("b"), pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["g", "b", "chunk", "fill"])

    def fill(table: pa.Table, state: pa.Table) -> pa.Table:
        table = sorted_by(table, "o")
        sums, after = _next_chunks(table.column("s").to_numpy(), budget)
        chunk, held, n = state.column("chunk")[0].as_py(), state.column("fill")[0].as_py(), len(after)
        at = 0 if chunk < 0 else int(np.searchsorted(sums[1:], budget - held, side="right"))
        begins = np.zeros(n, np.int64)
        while at < n:
            begins[at] = 1
            at = int(after[at])
        return pa.table([table.column("g"), table.column("o"), pa.array(chunk + np.cumsum(begins), pa.int64())], names=["g", "o", "chunk"])

    told = listed.groupBy("g", "b").applyInArrow(summary, f"g {kinds[group]}, b bigint, total bigint, sums array<bigint>, chunks array<bigint>, fills array<bigint>")
    states = told.groupBy("g").applyInArrow(fold, f"g {kinds[group]}, b bigint, chunk bigint, fill bigint")
    filled = listed.groupBy("g", "b").cogroup(states.groupBy("g", "b")).applyInArrow(fill, f"g {kinds[group]}, o {kinds[order]}, chunk bigint")
    placed = filled.select(F.col("g").alias("__g"), F.col("o").alias("__o"), "chunk")
    return rows.join(placed, rows[group].eqNullSafe(F.col("__g")) & (rows[order] == F.col("__o"))).drop("__g", "__o")
