"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is cut into blocks by a hash of its documents' ids; there are more blocks where there are more rows. A
source's target is met exactly, to the word, by whole passes over all its blocks and one partial pass. The blocks of a
pass are dealt to output shards by a tree: a node with k shards and N blocks gives its left half N * (k / 2) / k of them,
and how many of these each source and pass provides is a multivariate hypergeometric draw: the node's blocks, of all sources
and passes, are drawn without replacement, in the order of a hash, so reruns agree. The order is one for all nodes, as what a
node has of it is in random order too; a block's place in it, counted by slices, tells its way down the tree. Leaves are exact
quotas; a source's permuted blocks go to shards by their quotas, disjoint. In the partial pass a shard draws from the blocks that the tree gave it: its share of the source's words left,
in a permuted order; the block on the edge is cut by its documents in a permuted order, and there one document's share
may be a part of it. So the tree decides which documents are taken, and the targets how many words. Inside a shard a
hashed order shuffles: every draw has its place in it, from 0.

Sources are compared as strings. Null sources are a source of their own, ranked last. Null texts and texts without words
have size 0 and are taken 0 times. Null ids are dealt by their text. Repeated rows count each. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.col(text_col)
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed)))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        key.alias("key"), F.xxhash64(key, F.lit(seed + 1)).alias("turn"), F.monotonically_increasing_id().alias("row"), *([F.struct(*carry).alias("carried")] if carry else []),
    )


def blocks_for(rows: int, block_rows: int = 4096) -> int:
    return max(1024, min(1 << 18, rows // block_rows))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> target. Weights repeat over sources by code point, null last. Targets share the sum of
    the sizes by weight; those above `most` times their size stop there and the rest is shared again: in order of
    most * size / weight, the level is the first that leaves no later source above."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", w.alias("w")).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    ahead, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("w").over(on)).withColumn("nth", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nth", "level"))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("at", first["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def candidates(blocks: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, block, block_size) -> a row a block and pass: source, block, block_size, pass, whole, key (of source and
    pass), and the words that the source has (source_size) and lacks after its whole passes (rest)."""
    g = goals.select(F.col("source").alias("s"), F.least(F.round("target").cast("long"), F.floor(F.lit(3) * F.col("source_size"))).alias("goal"), "source_size")
    b = blocks.where("block_size > 0").join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    b = b.withColumn("passes", F.expr("int(goal div source_size)")).withColumn("rest", F.expr("goal % source_size"))
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    b = b.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    key = F.concat_ws(":", F.col("pass").cast("string"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    return b.select("source", "block", "block_size", "source_size", "rest", "pass", (F.col("pass") < F.col("passes")).alias("whole"), key.alias("key"))


def leaf(at: Column, blocks: Column, lo: int, k: int) -> Column:
    """The tree: the shard, of k from `lo` on, of the draw in place `at` of a node's `blocks`."""
    if k == 1:
        return F.lit(lo)
    left = F.floor(blocks * (k // 2) / k).cast("long")
    return F.when(at < left, leaf(at, left, lo, k // 2)).otherwise(leaf(at - left, blocks - left, lo + k // 2, k - k // 2))


def split_quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, n) -> (source, shard, n): the leaves' quotas. source: a source, or a source and a pass; n: its blocks, each a row here."""
    drawn = counts.where("n > 0").select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("i"))
    drawn = drawn.withColumn("order", F.xxhash64("source", "i", F.lit(seed)))
    blocks = counts.agg(F.sum("n")).first()[0] or 0
    bits = max(4, min(20, (blocks >> 16).bit_length()))
    drawn = drawn.withColumn("slice", F.shiftright("order", 64 - bits))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^bits rows
    starts = drawn.groupBy("slice").agg(F.count(F.lit(1)).alias("in_slice")).withColumn("start", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("order", "source", "i")) - 1
    placed = drawn.withColumn("rank", rank).join(starts, "slice").select("source", (F.col("start") + F.col("rank")).alias("place"))
    shard = leaf(F.col("place"), F.lit(blocks).cast("long"), 0, shards).cast("int")
    return placed.groupBy("source", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def deal(cands: DataFrame, shards: int, seed: int, tree_seed: int) -> DataFrame:
    """Candidates with their shard and the words that they give: a key's blocks go, in their permuted order, to shards by
    its leaf quotas. A whole pass gives all words; in the partial one a shard has its share of the rest, exact over the
    shards, and takes it from its own blocks in a permuted order."""
    quotas = split_quotas(cands.groupBy(F.col("key").alias("source")).agg(F.count("*").alias("n")), shards, tree_seed)
    upto = Window.partitionBy("source").orderBy("shard")
    ends = quotas.withColumn("end", F.sum("n").over(upto)).groupBy(F.col("source").alias("k")).agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    order = lambda *more: (F.xxhash64("key", "block", F.lit(seed + 3), *more), "block")
    c = cands.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order())))
    c = c.join(ends, F.col("key") == F.col("k")).withColumn("shard", F.element_at(F.filter("ends", lambda e: e["end"] >= F.col("nth")), 1)["shard"]).drop("k", "ends", "nth")
    lane = c.where(~F.col("whole")).groupBy("key", "shard").agg(F.sum("block_size").alias("lane"), F.first("rest").alias("rest"), F.first("source_size").alias("all"))
    lane = lane.withColumn("upto", F.sum("lane").over(Window.partitionBy("key").orderBy("shard")))
    part = lambda x: F.expr(f"cast(rest as decimal(19, 0)) * cast({x} as decimal(19, 0)) div cast(all as decimal(19, 0))")
    lane = lane.select(F.col("key").alias("k"), F.col("shard").alias("t"), (part("upto") - part("upto - lane")).alias("share"))
    c = c.join(lane, (F.col("key") == F.col("k")) & (F.col("shard") == F.col("t")) & ~F.col("whole"), "left")
    own = Window.partitionBy("key", "shard").orderBy(*order(F.col("shard"))).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("share") - F.coalesce(F.sum("block_size").over(own), F.lit(0))
    words = F.when(F.col("whole"), F.col("block_size")).otherwise(F.greatest(F.lit(0), F.least("block_size", left)))
    return c.select("source", "block", "pass", "whole", "shard", words.alias("words")).where("words > 0")


def places(mixed: DataFrame, seed: int) -> DataFrame:
    """(row, size, turn, shards), materialised -> row, places: of each draw its place in its shard by a hashed order. The order
    is cut into slices by its leading bits, 256 a shard or, of more than 2^24 rows, as many as rows need; a place is the draws of
    earlier slices and the rank inside its own."""
    bits = max(8, min(20, (mixed.count() >> 16).bit_length()))
    draw = mixed.select("row", "size", "turn", F.posexplode("shards").alias("pass", "shard"))
    draw = draw.withColumn("order", F.xxhash64("turn", "pass", F.lit(seed + 4))).withColumn("slice", F.shiftright("order", 64 - bits))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^bits rows a shard
    starts = draw.groupBy("shard", "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("order", "size", "row")) - 1
    placed = draw.withColumn("rank", rank).join(starts, ["shard", "slice"]).select("row", "pass", (F.col("start") + F.col("rank")).alias("place"))
    return placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"]).alias("places"))


def mix(
    docs: DataFrame, shards: int = 16, blocks: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    carry: tuple[str, ...] = (), tree_seed: int | None = None,
) -> DataFrame:
    """One row a document: id, size, source_size, target, taken, shards (of each of its draws, in order of passes), places (of each in its shard).

    blocks: of a source, by its number of rows if None; carry: more columns to hand through, no names that the result has."""
    tree_seed, held = seed if tree_seed is None else tree_seed, ["carried"] if carry else []
    d = materialise(sizes(docs, id_col, text_col, source_col, seed, carry), "sizes")
    d = d.withColumn("block", F.pmod("key", F.lit(blocks or blocks_for(d.count())))).drop("key")
    by_block = d.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    goals = targets(by_block.groupBy("source").agg(F.sum("block_size").alias("source_size")))
    dealt = deal(candidates(by_block, goals), shards, seed, tree_seed)
    drawn = dealt.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.count_if("whole").alias("passes"), F.sum(F.when(~F.col("whole"), F.col("words")).otherwise(0)).alias("quota"),
        F.array_sort(F.collect_list(F.struct("pass", "whole", "shard"))).alias("dealt"),
    )
    own = Window.partitionBy("source", "block").orderBy("turn", "id", "size")
    d = d.withColumn("ahead", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    d = d.join(goals.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")), "left")
    part = F.greatest(F.lit(0), F.least("size", F.coalesce("quota", F.lit(0)) - F.col("ahead")))
    d = d.withColumn("part", part)
    used = F.filter("dealt", lambda x: (x["whole"] | (F.col("part") > 0)) & (F.col("size") > 0))
    mixed = d.select(
        "row", "turn", "id", "size", "source_size", "target", (F.coalesce("passes", F.lit(0)) * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.transform(F.coalesce(used, F.array().cast("array<struct<pass:int,whole:boolean,shard:int>>")), lambda x: x["shard"]).alias("shards"), *held,
    )
    mixed = materialise(mixed, "mixed")
    placed = places(mixed, seed).withColumnRenamed("row", "p")
    return mixed.join(placed, F.col("row") == F.col("p"), "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "shards", F.coalesce("places", F.array().cast("array<long>")).alias("places"), *(f"{c}.*" for c in held),
    )


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slice_rows: int = 2048, most: int = 1 << 16) -> DataFrame:
    """The documents' rows as the mix takes them, once a draw, by `__shard` and inside it by their place `__turn`: partitions
    hold `slice_rows` places of one shard each, or as many more as keep them at `most`, sorted, and follow one another in that order.

    Rows that repeat id and text are one row, taken as often as they are together."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    taken = mix(whole.select("i", "text_hash", "t", "s"), shards, seed=seed, id_col="i", text_col="t", source_col="s", carry=("text_hash",))
    taken = taken.groupBy(F.col("i").alias("own"), F.col("text_hash").alias("hash")).agg(F.flatten(F.collect_list(F.arrays_zip("shards", "places"))).alias("draws"), F.count("*").alias("n"))
    taken = materialise(taken.where(F.size("draws") > 0), "taken")
    if not taken.where("n > 1").isEmpty():
        whole = whole.dropDuplicates(["i", "text_hash"])
    last = taken.agg(F.max(F.array_max(F.transform("draws", lambda x: x["places"])))).first()[0]
    slice_rows = max(slice_rows, -(-((last or 0) + 1) // max(1, most // shards)))
    slices = (last or 0) // slice_rows + 1  # of a shard
    out = whole.join(taken, F.col("i").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("hash")))
    out = out.select("doc", F.explode("draws").alias("draw"))
    to = F.col("draw.shards") * slices + F.floor(F.col("draw.places") / slice_rows)
    out = out.repartitionById(shards * slices, to.cast("int")).sortWithinPartitions("draw")
    return out.select("doc.*", F.col("draw.shards").alias("__shard"), F.col("draw.places").alias("__turn"))
