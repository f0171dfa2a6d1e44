"""Prefix trie of conversations from vertical bitmaps.

Conversations, sorted by id, are cut into shards of a bounded number of turns. A
shard holds a bitset of its conversations for every (position, turn). Depth-first,
a node's bitset is intersected with the posting of its lowest remaining member's
next turn: that is a child, and its members leave what remains. Popcounts are
members, and members without a next turn are the node's end list.

A prefix has one hash in all shards. Counts are added up by it; the shard that
holds a prefix's least member owns the node. Sums over subtrees then are sums
over each shard's own subtrees, in which a node counts only where it is owned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import kept

SHARD_TURNS = 1 << 15
SHARD_CONVERSATIONS = 1 << 12
FAMILY = 5
MOST_BORROWED = 9
ROOT = hashlib.md5(b"").digest()

FOUND = (
    "shard bigint, place bigint, up bigint, last bigint, node binary, depth bigint, bytes bigint, "
    "members bigint, least bigint, ends array<bigint>"
)
SUMMED = "node binary, depth bigint, n_convs bigint, conv_id bigint, parent_conv_id bigint, kids bigint, leaves bigint, saved bigint"
DIGESTS = "node binary, ends_sha256 string"


def turn_rows(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_key, bytes)`` of ``turns(conv_id, turn, role, text)``, positions from 0 in order of turn.

    Null turns come first, ties go by role, then by the text's digest; a null role
    or text is empty. Rows without a conversation id belong to no conversation and
    are left out. Texts do not move: a turn travels as its digest and its bytes.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("_turn"),
        role.alias("_role"),
        F.md5(text).alias("_digest"),
        key.alias("turn_key"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_digest")) - 1
    return rows.withColumn("pos", place.cast("bigint")).select("conv_id", "pos", "turn_key", "bytes")


def rebuilt(rows: DataFrame, family: int = FAMILY, borrowed: Column | None = None) -> DataFrame:
    """Conversations that begin with the first ``borrowed`` turns of their family's first, then go on with their own.

    The family's first conversation is ``conv_id - conv_id % family``; it lends what
    it has, nothing if it is absent. A conversation keeps its own turns after its
    first ``borrowed`` ones. One without any turn left is a row with ``pos`` -1.
    """
    if borrowed is None:
        borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED
    base = F.col("conv_id") - F.col("conv_id") % family
    own = Window.partitionBy("base", "conv_id")
    rows = rows.select(base.alias("base"), "*").repartition("base")
    rows = rows.withColumn("h", F.when(F.col("conv_id") == F.col("base"), 0).otherwise(borrowed).cast("bigint"))
    rows = rows.withColumn("n", F.count("*").over(own))
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))).over(Window.partitionBy("base"))
    rows = rows.withColumn("lent", F.least("h", F.coalesce(lent, F.lit(0))))
    kept_own = rows.where("pos >= h").select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), "turn_key", "bytes")
    takers = rows.where("pos = 0 and lent > 0").select("base", F.col("conv_id").alias("to"), "lent")
    lenders = rows.where(F.col("conv_id") == F.col("base")).select("base", F.col("pos").alias("at"), "turn_key", "bytes")
    taken = lenders.join(takers, "base").where("at < lent").select(F.col("to").alias("conv_id"), F.col("at").alias("pos"), "turn_key", "bytes")
    none = rows.where("pos = 0 and lent = 0 and n <= h").select(
        "conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("bytes")
    )
    return kept_own.unionByName(taken).unionByName(none)


class Shard:
    """Some conversations, each a list of (turn key, bytes), under their ids in ascending order."""

    def __init__(self, ids: list[int], turns: list[list[tuple[bytes, int]]]):
        self.ids, self.turns = ids, turns
        self.postings: dict[tuple[int, bytes], int] = {}
        self.alive: list[int] = [0] * max(map(len, turns), default=0)
        for bit, said in enumerate(turns):
            for pos, (key, _) in enumerate(said):
                self.postings[pos, key] = self.postings.get((pos, key), 0) | 1 << bit
                self.alive[pos] |= 1 << bit

    def nodes(self) -> list[tuple]:
        """Rows of ``FOUND`` in depth-first order; ``up`` is the parent's place, ``last`` the subtree's last place."""
        shard, out = self.ids[0], []
        todo = [(-1, ROOT, 0, 0, (1 << len(self.ids)) - 1)]
        while todo:
            up, node, depth, size, members = todo.pop()
            going = members & self.alive[depth] if depth < len(self.alive) else 0
            place = len(out)
            out.append([shard, place, up, place, node, depth, size, members.bit_count(), self.ids[_lowest(members)], self._ids(members ^ going)])
            while going:
                key, length = self.turns[_lowest(going)][depth]
                child = going & self.postings[depth, key]
                todo.append((place, hashlib.md5(node + key).digest(), depth + 1, length, child))
                going ^= child
        for row in reversed(out):
            if row[2] >= 0:
                out[row[2]][3] = max(out[row[2]][3], row[3])
        return out

    def _ids(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = _lowest(bits)
            found.append(self.ids[low])
            bits ^= 1 << low
        return found


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


FOUND_TYPES = [*[pa.int64()] * 4, pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def shard_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every shard (``FOUND``), from ``conversations(conv_id, pos, turn_key, bytes)``.

    A conversation is in one shard, whatever its length. A shard ends with the
    conversation that fills it; one that fills a shard by itself has its own.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        turns: list[list[tuple[bytes, int]]] = []
        held = 0
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "pos", "turn_key", "bytes"))
            for conv, pos, key, length in zip(*columns, strict=True):
                if not ids or conv != ids[-1]:
                    if held >= SHARD_TURNS or len(ids) >= SHARD_CONVERSATIONS:
                        yield _found(Shard(ids, turns))
                        ids, turns, held = [], [], 0
                    ids.append(conv)
                    turns.append([])
                if pos >= 0:
                    turns[-1].append((key, length))
                    held += 1
                if len(turns[-1]) == SHARD_TURNS and len(ids) > 1:
                    yield _found(Shard(ids[:-1], turns[:-1]))
                    ids, turns, held = ids[-1:], turns[-1:], SHARD_TURNS
        if ids:
            yield _found(Shard(ids, turns))

    ordered = conversations.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.select("conv_id", "pos", "turn_key", "bytes").mapInArrow(build, FOUND)


def _found(shard: Shard) -> pa.RecordBatch:
    columns = zip(*shard.nodes(), strict=True)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, FOUND_TYPES, strict=True)], names=FOUND_NAMES)


def _subtree_sums(shards: DataFrame) -> DataFrame:
    """Each shard's part of the sums of its nodes' subtrees (``SUMMED``).

    Rows come shard by shard, in depth-first order. A node counts where it is owned.
    """
    names = ["shard", "up", "last", "node", "depth", "bytes", "least", "n_convs", "conv_id", "inner"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards_ = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards_)) + 1).tolist(), len(shards_)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if held and last > first and held[-1].column("shard")[0].as_py() != int(shards_[first]):
                    yield _summed(pa.Table.from_batches(held))
                    held = []
                if last > first:
                    held.append(batch.slice(first, last - first))
        if held:
            yield _summed(pa.Table.from_batches(held))

    ordered = shards.repartition("shard").sortWithinPartitions("shard", "place")
    return ordered.select(*names).mapInArrow(add, SUMMED)


def _summed(rows: pa.Table) -> pa.RecordBatch:
    up, last, size, least, n_convs, conv_id = (rows.column(n).to_numpy() for n in ("up", "last", "bytes", "least", "n_convs", "conv_id"))
    inner = rows.column("inner").to_numpy()
    owned = least == conv_id
    kids = np.zeros(len(up), dtype=np.int64)
    mine = owned & (up >= 0)
    np.add.at(kids, up[mine], 1)
    leaves = _below(owned & ~inner, last)
    saved = _below(np.where(owned, (n_convs - 1) * size, 0), last)
    parent = pa.array(conv_id[np.maximum(up, 0)], pa.int64(), mask=~mine)
    columns = [
        rows.column("node").combine_chunks(), rows.column("depth").combine_chunks(),
        pa.array(n_convs), pa.array(conv_id), parent, pa.array(kids), pa.array(leaves), pa.array(saved),
    ]
    return pa.record_batch(columns, names=[part.split()[0] for part in SUMMED.split(", ")])


def _below(value: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums over subtrees: a node's subtree is the run of places from its own to ``last``."""
    total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
    return total[last + 1] - total[:-1]


def end_digests(shards: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of nodes where conversations end.

    Shards are ranges of ids, so a node's end lists follow each other by shard and
    its digest runs over them as they come, with a state of fixed size.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                text = ",".join(map(str, ends)).encode()
                if node == now:
                    running.update(b"," + text)
                else:
                    if running:
                        out.append((now, running.hexdigest()))
                    now, running = node, hashlib.sha256(text)
            yield _digests(out)
        if running:
            yield _digests([(now, running.hexdigest())])

    rows = shards.where(F.size("ends") > 0).select("node", "shard", "ends")
    ordered = rows.repartition("node").sortWithinPartitions("node", "shard").select("node", "ends")
    return ordered.mapInArrow(digest, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), ()]
    return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``conversations(conv_id, pos, turn_key, bytes)``.

    ``conv_id`` is the least member, ``parent_conv_id`` the parent's, null for the
    root; ``n_convs`` counts members, ``n_children`` children, ``n_leaves`` childless
    nodes of the subtree, ``saved_tokens`` sums ``(n_convs - 1)`` times the bytes of
    the last text over it. ``ends_sha256`` is over the ids of the conversations that
    end in the node, ascending and comma-joined. Equal conversations end in one
    node. Without conversations there is no node, not even the root.
    """
    shards = kept(shard_nodes(conversations))
    same = Window.partitionBy("node")
    shards = shards.withColumns(
        {
            "n_convs": F.sum("members").over(same),
            "conv_id": F.min("least").over(same),
            "inner": F.max(F.col("last") > F.col("place")).over(same),
        }
    )
    nodes = _subtree_sums(shards).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum("kids").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ended = nodes.join(end_digests(shards.select("node", "shard", "ends")), "node", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return ended.select(*columns, F.coalesce("ends_sha256", empty).alias("ends_sha256"))
