"""Merkle manifest of a table: a SHA-256 tree per source, one over the sources, and folds of changed rows.

Rows are numbered within their source by one sort. Every ``FAN_OUT`` consecutive
nodes become one; a task takes blocks of ``FAN_OUT ** STEPS`` nodes ``STEPS`` levels
up, so a source of any size is dealt over many tasks, and a few rounds reach its
top. Then paths go down the same rounds: one row per block carries what
stands beside its root at all levels above.

In a block each parent keeps copies of its running hash, one from before each
child. A fold resumes the copy of its slot with the replaced child and the right
siblings alone; the left siblings were absorbed when the parent was made. Above
the block, the left siblings of its path are absorbed once for all its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import kept

FAN_OUT = 3
STEPS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, place bigint, digest binary"
PATHS = "tree string, place bigint, lefts array<binary>, rights array<binary>, subroot binary, root binary"
FOLDED = "doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 over the values, each as ``<bytes>:<value>``, or ``-`` for null."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# --- places ------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within ``tree`` in ``order``, nulls first.

    The sorted rows are checkpointed; per partition one row says how many rows of
    its first tree lie in the partitions before. Rows equal in ``order`` are told
    apart by where they were read, so that the sort can split them too.
    """
    tie = "_read"
    ordered = rows.withColumn(tie, F.monotonically_increasing_id())
    ordered = ordered.sort(*[F.col(c).asc_nulls_first() for c in ("tree", *order, tie)]).drop(tie)
    ordered = kept(ordered).withColumn("_slot", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_slot", 33))
    parts = ordered.groupBy("_part").agg(
        F.min(F.struct("tree")).alias("_first"),
        F.max(F.struct("tree", -F.col("_slot"))).alias("_last"),
        F.max("_slot").alias("_end"),
    )
    parts = parts.select("_part", "_first.tree", F.col("_last.tree").alias("_to"), (F.col("_end") + F.col("_last.col2") + 1).alias("_n"))
    # Both windows are over one row per partition.
    parts = parts.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_to").orderBy("_part")))
    before = Window.orderBy("_part")
    goes_on = F.lag(F.struct("_to")).over(before) == F.struct(F.col("tree").alias("_to"))
    parts = parts.select("_part", F.when(goes_on, F.lag("_sum").over(before)).otherwise(0).alias("_carry"))
    joined = ordered.join(F.broadcast(parts), "_part").drop("_part", "_slot").select("_carry", *rows.columns)
    out = joined.drop("_carry").schema.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, begun = None, 0, False
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                if not begun:
                    now, place, begun = tree, batch.column("_carry")[0].as_py(), True
                elif tree != now:
                    now, place = tree, 0
                places.append(place)
                place += 1
            columns = batch.columns[1:] + [pa.array(places, pa.int64())]
            yield pa.record_batch(columns, names=batch.schema.names[1:] + ["place"])

    return joined.mapInArrow(number, out.removeprefix("struct<").removesuffix(">") + ",place bigint")


# --- one block in one task -----------------------------------------------------


class Block:
    """The levels above consecutive nodes; ``states[level][i]`` is the parent's hash from before child ``i``."""

    def __init__(self, digests: list[bytes], block: int, steps: int = STEPS):
        self.size = len(digests)
        self.lefts: list[list[bytes]] = []
        self.rights: list[list[bytes]] = []
        self.states: list[list] = []
        # a tree's only block ends at one node, others rise by the same number of levels
        alone = block == 0 and self.size < FAN_OUT**steps
        while (len(digests) > 1) if alone else (len(self.states) < steps):
            digests = self._raise(digests)
        self.root = digests[0]

    def _raise(self, digests: list[bytes]) -> list[bytes]:
        states, lefts, rights, parents = [], [], [], []
        for at in range(0, len(digests), FAN_OUT):
            run, running = digests[at : at + FAN_OUT], hashlib.sha256()
            for slot, child in enumerate(run):
                states.append(running.copy())
                lefts.append(b"".join(run[:slot]))
                rights.append(b"".join(run[slot + 1 :]))
                running.update(child)
            parents.append(running.hexdigest().encode())
        self.states.append(states)
        self.lefts.append(lefts)
        self.rights.append(rights)
        return parents

    def fold(self, place: int, child: bytes) -> bytes:
        """The block's root with ``child`` in place of the node at ``place``."""
        for states, rights in zip(self.states, self.rights, strict=True):
            child = resumed(states[place], child, rights[place])
            place //= FAN_OUT
        return child

    def path(self, place: int) -> tuple[list[bytes], list[bytes]]:
        """Left and right siblings at each level, lowest first."""
        lefts, rights = [], []
        for left, right in zip(self.lefts, self.rights, strict=True):
            lefts.append(left[place])
            rights.append(right[place])
            place //= FAN_OUT
        return lefts, rights


def resumed(state, child: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(child)
    state.update(right)
    return state.hexdigest().encode()


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of one block together and by place; ``place`` -1 is what stands above the block."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str | None, int, list[tuple]]]:
    """``(tree, block, rows)``; a block has at most ``FAN_OUT ** STEPS`` rows and what stands above it."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in names]
        for tree, block, row in zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), zip(*columns, strict=True), strict=True):
            if held and (tree, block) != key:
                yield *key, held
                held = []
            key = tree, block
            held.append(row)
    if held:
        yield *key, held


def _rows(schema: str, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


BINARIES = pa.list_(pa.binary())
BLOCKS_A_BATCH = 64


def _in_batches(rows: Iterator[list[tuple]], schema: str, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for number, some in enumerate(rows):
        held += some
        if number % BLOCKS_A_BATCH == BLOCKS_A_BATCH - 1:
            yield _rows(schema, held, types)
            held = []
    yield _rows(schema, held, types)


def _block_of(place: str = "place") -> Column:
    return F.floor(F.col(place) / FAN_OUT**STEPS).alias("block")


# --- up and down -----------------------------------------------------------------


def rounds_up(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, place, digest)``, the roots of their blocks, and so on to one node per tree."""
    steps = STEPS

    def raise_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = ([(tree, block, Block([d for (d,) in held], block, steps).root)] for tree, block, held in _grouped(batches, ["digest"]))
        yield from _in_batches(roots, NODES, [pa.string(), pa.int64(), pa.binary()])

    rounds = [nodes]
    while (rounds[-1].agg(F.max("place")).first()[0] or 0) > 0:
        blocks = _by_block(rounds[-1].select("tree", _block_of(), "place", "digest"))
        rounds.append(kept(blocks.mapInArrow(raise_all, NODES)))
    return rounds


def paths_down(rounds: list[DataFrame], tops: DataFrame, to: int) -> DataFrame:
    """Paths of the nodes of round ``to``, from the paths of the trees' roots, ``tops`` (``PATHS``)."""
    steps = STEPS

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[list[tuple]]:
            for tree, at, held in _grouped(batches, ["digest", "lefts", "rights", "subroot", "root"]):
                (_, lefts, rights, subroot, root), nodes = held[0], held[1:]
                block = Block([row[0] for row in nodes], at, steps)
                own = (block.path(i) for i in range(block.size))
                yield [(tree, at * FAN_OUT**steps + i, x + lefts, y + rights, subroot, root) for i, (x, y) in enumerate(own)]

        yield from _in_batches(blocks(), PATHS, [pa.string(), pa.int64(), BINARIES, BINARIES, pa.binary(), pa.binary()])

    paths = tops
    for nodes in rounds[to:-1][::-1]:
        rows = nodes.select("tree", _block_of(), "place", "digest")
        above = paths.withColumn("block", F.col("place")).withColumn("place", F.lit(-1).cast("bigint"))
        paths = _by_block(rows.unionByName(above, allowMissingColumns=True)).mapInArrow(hand_down, PATHS)
    return paths


def trees(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds over ``leaves(tree, place, digest)`` and the paths of the trees' roots up to the one root."""
    rounds = rounds_up(leaves)
    one = placed(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digest")), ["of"])
    one = kept(one)
    over = rounds_up(one.select("tree", "place", "digest"))
    none = F.array().cast("array<binary>")
    top = over[-1].select(
        "tree", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root")
    )
    paths = paths_down(over, top, 0).select("place", "lefts", "rights", "root")
    tops = one.join(paths, "place").select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights", F.col("digest").alias("subroot"), "root"
    )
    return rounds, kept(tops)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source", order: str = "doc_id") -> DataFrame:
    """``(source, n_leaves, subroot, root)``: what a reader needs to check a copy of the table, one row per source."""
    leaves = _numbered(docs.select(F.col(tree).cast("string").alias("tree"), F.col(order).alias("doc_id"), leaf_digest([F.col(c) for c in columns]).alias("leaf")))
    _, tops = trees(_nodes(leaves))
    counts = leaves.groupBy("tree").agg(F.count("*").alias("n_leaves"))
    joined = counts.join(tops, counts["tree"].eqNullSafe(tops["tree"])).select(counts["tree"].alias(tree), "n_leaves", "subroot", "root")
    return joined.withColumn("subroot", F.col("subroot").cast("string")).withColumn("root", F.col("root").cast("string"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Leaves in their place; digests travel as bytes."""
    narrow = rows.withColumn("leaf", F.unhex("leaf"))
    if "changed" in rows.columns:
        narrow = narrow.withColumn("changed", F.unhex("changed"))
    return kept(placed(narrow, ["doc_id", "leaf"]))


def _nodes(leaves: DataFrame) -> DataFrame:
    return leaves.select("tree", "place", F.lower(F.hex("leaf")).cast("binary").alias("digest"))


def audit(docs: DataFrame, tampered: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Every row's leaf, proof and the root that its tampered form would give.

    ``docs`` has ``doc_id, source`` and ``columns``; others are not read. A leaf is
    ``leaf_digest`` of ``columns``; ``tampered`` gives columns that replace some of
    them in a second digest, row by row. Returns ``doc_id, leaf, subroot, root,
    proof_sha256`` of the untouched table (the proof is all siblings from the leaf
    up to the root), ``folded_root`` of that row's second digest among the original
    siblings, and ``verified``: it is the root.

    Sources are ordered null first, then bytewise; rows by ``doc_id``, null first,
    then by leaf, so repeated rows and ids have a defined place (equal rows get
    equal leaves and neighbouring places). A null value is told from an empty one.
    No rows, no result. A row moves as its id, source and two digests.
    """
    tampered = tampered or {}
    first = leaf_digest([F.col(c) for c in columns])
    second = leaf_digest([tampered.get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col("source").cast("string").alias("tree"), "doc_id", first.alias("leaf"), second.alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    leaves = _numbered(rows)
    rounds, tops = trees(_nodes(leaves))
    above = paths_down(rounds, tops, 1) if len(rounds) > 1 else tops
    above = above.withColumn("block", F.col("place")).withColumn("place", F.lit(-1).cast("bigint"))
    both = leaves.select("tree", _block_of(), "place", "doc_id", "leaf", "changed").unionByName(above, allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _by_block(both).mapInArrow(_folder(), FOLDED.format(kind=kind))


def _folder() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema, steps = FOLDED.format(kind="any"), STEPS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        out: list[tuple] = []
        names = ["doc_id", "leaf", "changed", "lefts", "rights", "subroot", "root"]
        for number, (_, at, held) in enumerate(_grouped(seen(), names)):
            out += _folded(at, held, steps)
            if number % BLOCKS_A_BATCH == BLOCKS_A_BATCH - 1:
                yield _rows(schema, out, [kind, *[pa.string()] * 5, pa.bool_()])
                out = []
        if out:
            yield _rows(schema, out, [kind, *[pa.string()] * 5, pa.bool_()])

    return fold


def _folded(at: int, held: list[tuple], steps: int) -> list[tuple]:
    *_, lefts, rights, subroot, root = held[0]
    digests = [row[1].hex().encode() for row in held[1:]]
    block = Block(digests, at, steps)
    kept_above = [(hashlib.sha256(left), right) for left, right in zip(lefts, rights, strict=True)]
    siblings_above = b"".join(left + right for left, right in zip(lefts, rights, strict=True))
    subroot, root = subroot.decode(), root.decode()
    out = []
    for place, (doc_id, _, changed, *_) in enumerate(held[1:]):
        leaf = digests[place]
        proof = hashlib.sha256()
        for left, right in zip(*block.path(place), strict=True):
            proof.update(left)
            proof.update(right)
        proof.update(siblings_above)
        node = block.fold(place, changed.hex().encode() if changed else leaf)
        for state, right in kept_above:
            node = resumed(state, node, right)
        folded = node.decode()
        out.append((doc_id, leaf.decode(), subroot, root, proof.hexdigest(), folded, folded == root))
    return out
