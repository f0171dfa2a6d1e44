"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's documents are dealt to shards by a seeded hash, and a shard's
words, its documents end to end in seeded order, are cut into equal blocks.
Single words, the smallest equal blocks, are apportioned to sources and then to a
source's shards by highest quotients ``votes / (2 k + 1)``, so a source of any size
takes its target to the word. Each shard then fills its quota with whole rounds
and whole blocks, in the order of a seeded one-to-one map of block numbers; the
last block of that order is cut where the quota ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import words
from lexmill.llm.common import kept, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
MOST_SHARDS = 4096
SEED = "mix"
PRIME = 2147483647  # larger than any number of blocks in a shard, so it divides none


def document_sizes(docs: DataFrame, *keep: Column) -> DataFrame:
    """``(doc_id, source, ..., size)``: the number of words of each whole text, 0 for null, beside the ``keep``."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), *keep, "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("size", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                sizes = words.find_words(part.column("text")).counts.astype(np.int64)
                yield pa.record_batch([*part.columns[:-1], pa.array(sizes)], names=schema.names)

    return rows.mapInArrow(count, schema)


def _number(value: Column) -> Column:
    """60 bits of an md5, which other engines can follow."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``, one row per source, by code point with null last.

    The water level at which ``min(most * size, level * weight)`` sums to the
    wanted total: sources in order of size per weight reach their limit first.
    The windows here run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = by_source.withColumn("_rank", rank).withColumn("_w", weight.cast("bigint"))
    limit = F.col("source_size") * most
    before = Window.orderBy(limit / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wanted = F.sum("source_size").over(every) * F.lit(share)
    left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = (wanted - F.coalesce(F.sum(limit).over(before), F.lit(0))) / left
    leveled = ranked.withColumn("_level", level)
    open_ = leveled.withColumn("_level", F.when(F.col("_level") <= limit / F.col("_w"), F.col("_level")))
    first = F.min_by("_level", F.when(F.col("_level").isNotNull(), F.struct(limit / F.col("_w"), F.col("_rank")))).over(every)
    target = F.least(limit.cast("double"), F.coalesce(first * F.col("_w"), limit.cast("double")))
    return open_.withColumn("_first", first).select("source", "source_size", target.alias("target"), F.col("_rank").alias("source_rank"))


def apportion(units: DataFrame, group: list[str], order: str, votes: str, seats: str, name: str) -> DataFrame:
    """Adds ``name``: the seats of each unit when the ``seats`` of its group go to the highest quotients.

    With n units and V votes, no unit can get fewer seats than ``v (S - n) / V`` or
    more than ``v (S + n) / V + 1/2``. The first are given at once; only the
    quotients between the two, about four per unit, are ranked. Ties go by ``order``.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(votes).over(whole), F.count(F.lit(1)).over(whole)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    sure = F.floor(share * F.greatest(F.col(seats) - n, F.lit(0))).cast("bigint")
    possible = F.floor(share * (F.col(seats) + n) + 0.5).cast("bigint")
    marked = units.withColumn("_sure", sure).withColumn("_most", F.greatest(possible, "_sure"))
    marked = marked.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    k = F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k")
    quotients = marked.where((F.col("_most") > F.col("_sure")) & (F.col(votes) > 0)).select(*group, order, votes, "_open", k)
    place = F.row_number().over(
        Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), order, "_k")
    )
    won = quotients.withColumn("_place", place).where(F.col("_place") <= F.col("_open"))
    gained = won.groupBy(*group, order).agg(F.count("*").alias("_gained"))
    return (
        marked.join(gained, [*group, order], "left")
        .withColumn(name, F.col("_sure") + F.coalesce("_gained", F.lit(0)))
        .drop("_sure", "_most", "_open", "_gained")
    )


def _dealt(sizes: DataFrame, weights: tuple, share: float, most: int, block_words: int, shard_words: int, seed: str) -> DataFrame:
    """``sizes``, rows of ``_copies`` equal documents, with their source's target and their place in a shard's line.

    ``_start`` is the first copy's first word in the line, ``_words`` the line's
    length, ``_rounds`` how often the shard takes all of it and ``_more`` how many
    words it takes beyond, from blocks in the order ``(number * PRIME + _shift) % _n``.
    """
    held = F.col("size") * F.col("_copies")
    sources = source_targets(sizes.withColumn("size", held), weights, share, most)
    seats = F.round(F.sum("target").over(Window.partitionBy())).cast("bigint")
    sources = apportion(sources.withColumn("_all", F.lit(0)).withColumn("_seats", seats), ["_all"], "source_rank", "target", "_seats", "_quota")
    wanted = F.least(F.ceil(F.col("source_size") / shard_words), F.lit(MOST_SHARDS))
    sources = kept(sources.select("source_rank", "source", "source_size", "target", "_quota", F.greatest(wanted, F.lit(1)).cast("bigint").alias("_shards")))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = (
        sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_shard", _number(F.concat(F.lit(f"{seed}/shard/"), id_text)) % F.col("_shards"))
        .withColumn("_order", F.md5(F.concat(F.lit(f"{seed}/order/"), id_text)))
    )
    key = ["source_rank", "_shard"]
    line = Window.partitionBy(*key).orderBy("_order", "doc_id", "size", *(n for n in sizes.columns if n == "_row"))
    upto = F.sum(held).over(line.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_start", upto - held)
    shards = placed.groupBy(*key, "_quota").agg(F.sum(held).alias("_words"))
    shards = apportion(shards, ["source_rank"], "_shard", "_words", "_quota", "_won").drop("_quota")
    blocks = F.ceil(F.col("_words") / block_words).cast("bigint")
    shards = (
        shards.where("_words > 0")
        .withColumn("_n", blocks)
        .withColumn("_take", F.least("_won", F.col("_words") * most))
        .withColumn("_rounds", F.floor(F.col("_take") / F.col("_words")).cast("bigint"))
        .withColumn("_more", F.col("_take") % F.col("_words"))
        .withColumn("_shift", _number(F.concat_ws("/", F.lit(f"{seed}/blocks"), "source_rank", "_shard")) % F.col("_n"))
        .select(*key, "_n", "_words", "_rounds", "_more", "_shift")
    )
    return placed.drop("_order", "_shards", "_quota").join(shards, key, "left")


def _taken(copy: Column, block_words: int) -> Column:
    """Words the mix takes of the ``copy``-th, from 0, of a row's equal documents."""
    start = F.col("_start") + copy * F.col("size")
    end = start + F.col("size")

    def place(block: Column) -> Column:
        return (block * F.lit(PRIME) + F.col("_shift")) % F.col("_n")

    def overlap(total: Column, block: Column) -> Column:
        # the line's last block may be short; those behind it in the order begin earlier by what it lacks
        short = F.when(place(block) > place(F.col("_n") - 1), F.col("_n") * block_words - F.col("_words")).otherwise(0)
        inside = F.least(F.lit(block_words), F.col("_more") - place(block) * block_words + short)
        return total + F.greatest(F.lit(0), F.least(end, block * block_words + inside) - F.greatest(start, block * block_words))

    blocks = F.sequence(F.floor(start / block_words).cast("bigint"), F.floor((end - 1) / block_words).cast("bigint"))
    extra = F.aggregate(blocks, F.lit(0).cast("bigint"), overlap)
    return F.when(F.col("size") > 0, F.col("_rounds") * F.col("size") + extra).otherwise(F.lit(0).cast("bigint"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` of all documents.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words, none more than ``most`` times its own. ``taken`` is
    the number of the document's words in the selected blocks, repeats counted,
    never above ``most`` times its size. A null or empty text has size 0 and takes
    nothing. Repeated rows and ids are documents of their own. Results depend on
    ids, sizes, sources and the seed only. One rule holds for sources of all sizes.

    A source is split into shards of about ``shard_words`` (up to 4096, which
    then grow); a task orders one shard's ids and sizes, never texts.
    """
    sizes = kept(document_sizes(docs)).withColumn("_copies", F.lit(1).cast("bigint"))
    dealt = _dealt(sizes, weights, share, most, block_words, shard_words, seed)
    return dealt.select("doc_id", "size", "source", "source_size", "target", _taken(F.lit(0).cast("bigint"), block_words).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """The documents the mix takes words of: all columns of ``docs`` and ``size, source_size, target, taken``.

    The new names are lengthened where ``docs`` has such a column. ``taken`` is as
    in ``mix_sources``. Rows are told apart by the id and a hash of all columns but
    maps; rows equal in these are counted as one row first and numbered again beside
    their texts, so which of them takes more is open, but not how many take how
    much. Texts move once, to meet what is taken of them.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row, copy, same, *names = unused(docs, "_row", "_copy", "_same", "size", "source_size", "target", "taken")
    marked = docs.withColumn(row, F.xxhash64(*hashed))
    sizes = document_sizes(marked, F.col(row).alias("_row"))
    sizes = kept(sizes.groupBy("doc_id", "source", "_row", "size").agg(F.count("*").alias("_copies")))
    dealt = _dealt(sizes, weights, share, most, block_words, shard_words, seed)
    places = ["_start", "_n", "_words", "_rounds", "_more", "_shift"]
    dealt = dealt.select(F.struct("doc_id", "_row").alias(same), F.struct("size", "source_size", "target", *places).alias(copy))
    met = marked.withColumn(same, F.struct("doc_id", F.col(row).alias("_row"))).join(dealt, same)
    number = (F.row_number().over(Window.partitionBy(same).orderBy(F.lit(0))) - 1).cast("bigint")
    inner = met.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"), number.alias("_number"), f"{copy}.*")
    out = inner.withColumn("_taken", _taken(F.col("_number"), block_words)).where("_taken > 0")
    new = zip(names, ("size", "source_size", "target", "_taken"), strict=True)
    return out.select("_document.*", *(F.col(old).alias(name) for name, old in new))
