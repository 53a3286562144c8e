"""Trie of conversation prefixes by vertical bitmaps.

Conversations are cut into segments of at most SEGMENT turns, and segments, in the order of their ids, into
shards of bounded size. In a shard, (position, turn) is indexed to a bitset of segments. A node is a bitset:
its children are found depth first, each as the intersection of the node's bitset, less the children found so
far, with the posting of the turn that its lowest segment has at the next position. Popcounts and the ids that
end at a node are read from the bitsets. A node is named by a hash of its turns, so the shards' nodes
are added up by name, and no first turn, however common, comes together in one task.

Sums over subtrees double their reach: each node knows the sums over its descendants nearer than 2^k and its
ancestor 2^k above; adding to it what the nodes exactly 2^k below know doubles k. The rounds are the logarithm
of the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import cut

#: Turns of a segment, segments and turns of a shard, and rows ranked together.
SEGMENT, SEGMENTS, TURNS, BLOCK = 512, 4096, 1 << 16, 4096
#: Bytes of a node's name.
NAME = 16
LOCAL = "name binary, up binary, depth long, n long, low long, bytes long, ends string, n_ends long"


def name_of(*parts: Column) -> Column:
    """A 128-bit name of byte strings put together."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NAME)


def hashed(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:NAME]


ROOT = hashed()


# ---- turns in order ----------------------------------------------------------------------------------------

def ranked(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, name, bytes) with `rank` from 1 within the conversation: by turn, null first, then by
    name. Turn numbers are ranked in blocks and the blocks' sizes added up, so the rows of a
    conversation do not meet in one task, but for those that have one block of turn numbers."""
    block = F.floor(F.col("turn") / BLOCK)
    blocked = turns.withColumn("block", block)
    sizes = blocked.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0)))
    later = sizes.where("skip > 0").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "skip")
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "name")
    own = blocked.withColumn("place", F.row_number().over(within))
    return own.join(later, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left").select(
        "conv_id", "name", "bytes", (F.col("place") + F.coalesce("skip", F.lit(0))).alias("rank"))


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            every: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, place, name, bytes): conversation c starts with the first h turns of conversation c - c % every, and
    goes on with its own turns after its first h, h being the unsigned CRC-32 of c's decimals modulo most + 1.
    Turnless conversations have one row with a null place. Only the names of turns (equal for equal role and
    text) and the bytes of their texts go on from here."""
    plain = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(out) for c, out in ((role, "role"), (text, "text"))])
    head = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"))
    plain = plain.select("conv_id", "turn", name_of(F.encode(head, "utf-8"), F.encode("text", "utf-8")).alias("name"),
                         F.octet_length("text").cast("long").alias("bytes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    order = cut(ranked(plain))
    ids = order.select("conv_id").distinct().select("conv_id", h, base)
    given = order.where(F.col("rank") <= most).select(F.col("conv_id").alias("base"), "rank", "name", "bytes")
    firsts = ids.join(given, "base").where(F.col("rank") <= F.col("h")).select("conv_id", F.col("rank").alias("place"), "name", "bytes")
    # a base that is absent or shorter than h moves the conversation's own turns forward
    long_ = given.groupBy("base").agg(F.max("rank").alias("has"))
    shift = ids.join(long_, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    rest = order.join(shift, "conv_id").where(F.col("rank") > F.col("h")).select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("place"), "name", "bytes")
    whole = firsts.unionByName(rest)
    bare = ids.join(whole.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in (("place", "long"), ("name", "binary"), ("bytes", "long"))])
    return whole.unionByName(bare)


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, start, last, turns) from (conv_id, place, name, bytes): runs of at most `segment` turns, the name
    of the node that each starts from, whether it ends the conversation, and its turns in order as (name, bytes)."""
    named = turns.withColumn("part", F.coalesce(F.floor((F.col("place") - 1) / segment), F.lit(0)))
    entry = F.when(F.col("place").isNotNull(), F.struct("place", "name", "bytes"))
    parts = named.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    own = F.aggregate("turns", F.lit(b""), lambda done, t: name_of(done, t["name"]))
    parts = cut(parts.withColumn("own", own))
    # a conversation's segments meet as one short row each
    chain = parts.groupBy("conv_id").agg(F.max("part").alias("end"), F.array_sort(F.collect_list(F.struct("part", "own"))).alias("owns"))
    first = F.array(F.lit(ROOT))
    starts = F.aggregate("owns", first, lambda done, o: F.concat(done, F.array(name_of(F.element_at(done, -1), o["own"]))))
    begun = chain.where("end > 0").select("conv_id", "end", F.posexplode(starts).alias("part", "start")).where("part > 0")
    return parts.join(begun, ["conv_id", "part"], "left").join(
        chain.where("end > 0").select("conv_id", F.col("end").alias("final")), "conv_id", "left").select(
        "conv_id", "part", F.coalesce("start", F.lit(ROOT)).alias("start"),
        (F.col("part") == F.coalesce("final", F.lit(0))).alias("last"), F.transform("turns", lambda t: F.struct(t["name"], t["bytes"])).alias("turns"))


# ---- a shard's nodes -----------------------------------------------------------------------------------------

def shard(rows: list[tuple], segment: int) -> Iterator[tuple]:
    """The nodes of the segments (conv_id, part, start, last, turns), which are in order: their names, those above,
    depths, segments through them, smallest conversations, bytes of the last turn and ids of the
    conversations that end there."""
    posting: dict[tuple[int, bytes], int] = {}
    stops: dict[int, int] = {}
    begins: dict[tuple[int, bytes], int] = {}
    for i, (_, part, start, _, turns) in enumerate(rows):
        bit = 1 << i
        begins[part, start] = begins.get((part, start), 0) | bit
        stops[len(turns)] = stops.get(len(turns), 0) | bit
        for place, (turn, _) in enumerate(turns):
            posting[place, turn] = posting.get((place, turn), 0) | bit

    def rows_of(bits: int) -> Iterator[tuple]:
        while bits:
            lowest = bits & -bits
            yield rows[lowest.bit_length() - 1]
            bits ^= lowest

    for (part, start), bits in begins.items():
        stack = [(start, None, 0, b"", bits, 0)]
        while stack:
            name, up, place, own, bits, size = stack.pop()
            done = bits & stops.get(place, 0)
            if place or not part:  # the node that a later segment starts from is the last of the one before
                yield name, up, part * segment + place, bits.bit_count(), next(rows_of(bits))[0], size, [str(r[0]) for r in rows_of(done) if r[3]]
            left = bits ^ done
            while left:
                turn, size = next(rows_of(left))[4][place]
                child = left & posting[place, turn]
                left ^= child
                below = hashed(own, turn)
                stack.append((hashed(start, below), name, place + 1, below, child, size))


def local_nodes(parts: DataFrame, segment: int = SEGMENT, at_once: int = SEGMENTS, turns_at_once: int = TURNS) -> DataFrame:
    """The nodes of each shard. Shards are stretches in the order of ids, so a node's ends in different shards do
    not interleave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def nodes() -> Iterator[pa.RecordBatch]:
            found = [(*node[:6], ",".join(node[6]) if node[6] else None, len(node[6])) for node in shard(rows, segment)]
            for at in range(0, len(found), 1 << 14):
                columns = zip(*found[at:at + (1 << 14)])
                kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 [f.split()[0] for f in LOCAL.split(", ")])

        for batch in batches:
            for conv, part, start, last, turns in zip(*(c.to_pylist() for c in batch.columns)):
                turns = [(t["name"], t["bytes"]) for t in turns]
                rows.append((conv, part, start, last, turns))
                held += len(turns)
                if len(rows) >= at_once or held >= turns_at_once:
                    yield from nodes()
                    rows.clear()
                    held = 0
        yield from nodes()

    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = parts.select("conv_id", "part", "start", "last", "turns").repartitionByRange(tasks, "conv_id", "part")
    return order.sortWithinPartitions("conv_id", "part").mapInArrow(run, LOCAL)


def end_hashes(local: DataFrame) -> DataFrame:
    """(name, ends_sha256): the SHA-256 of each node's comma-joined ends. One hash has to see its bytes in order, but
    a row here holds all that a shard knows of a node, and a task holds one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                              ["name", "ends_sha256"])

        for batch in batches:
            done = []
            for name, ends in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = name, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.as_py().encode())
            yield rows(done)
        yield rows([(key, digest.hexdigest())] if key is not None else [])

    first = F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("first")
    return local.where("ends is not null").select("name", "ends", first).repartition("name") \
        .sortWithinPartitions("name", "first").select("name", "ends").mapInArrow(run, "name binary, ends_sha256 string")


# ---- nodes and their subtrees --------------------------------------------------------------------------------

def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (low, depth, up_low, and the columns `sums`) with the sums over each node's subtree. A node is known by
    its smallest conversation and depth; up_low is that of its parent."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = nodes.select("low", "depth", F.col("up_low").alias("above"), *sums), 1
    while step <= deepest:
        below = now.where("above is not null").groupBy(F.col("above").alias("low"), (F.col("depth") - step).alias("depth")).agg(
            *[F.sum(c).alias(f"more_{c}") for c in sums])
        onward = now.where("above is not null").select(F.col("low").alias("above"), (F.col("depth") + step).alias("depth"), F.col("above").alias("next"))
        now = cut(now.join(below, ["low", "depth"], "left").join(onward, ["above", "depth"], "left").select(
            "low", "depth", F.col("next").alias("above"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]))
        step *= 2
    return now.drop("above")


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         segment: int = SEGMENT, at_once: int = SEGMENTS, turns_at_once: int = TURNS) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations, the textless root included:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Null roles and texts
    are empty, null turns come first, equal turns of a conversation are ordered by a hash of role and text and
    repeated rows count each; rows with a null conv_id belong to no conversation; texts of any length are hashed
    whole; other columns are not read; an empty table gives an empty result."""
    parts = segments(rebuilt(turns, conv_id, turn, role, text), segment)
    local = cut(local_nodes(parts, segment, at_once, turns_at_once))
    nodes = cut(local.groupBy("name").agg(
        F.max("up").alias("up"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("bytes").alias("bytes")))
    children = nodes.where("up is not null").groupBy(F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    parents = nodes.select(F.col("name").alias("up"), F.col("low").alias("up_low"))
    placed = cut(nodes.join(children, "name", "left").join(end_hashes(local), "name", "left").join(parents, "up", "left").select(
        "low", "depth", "up_low", "n", F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens")))
    sums = subtree_sums(placed, ["n_leaves", "saved_tokens"])
    return placed.drop("n_leaves", "saved_tokens").join(sums, ["low", "depth"]).select(
        F.col("low").alias("conv_id"), "depth", F.col("up_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", "ends_sha256")
