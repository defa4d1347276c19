"""Mixing sources to target weights, by DataFrame operations only.

1. Every document has a size in words and a block, one of `blocks` per source, by a
   hash of its id. Only (source, block) sums are handled from here on.
2. Targets: sources share `share` times all words by their weights; a target stops at
   `most` times its source's words and the excess goes to the others by weight.
3. A source gives whole passes of its blocks, then further blocks in an order of
   hashes while they fit, then single documents of the first block that did not fit.
4. Splitting tree: the quotas of block copies of all sources are divided between the
   two halves of the shards, again and again. Each division permutes the copies of a
   node and cuts the order in the middle, which draws the halves' quotas per source
   from the multivariate hypergeometric distribution.
5. Each source's block copies are permuted anew and dealt to the shards by the quotas,
   so the draws are disjoint. Within a shard rows are ordered by a hash.

All orders come from hashes of ids and the seed: reruns agree, whatever the layout of
the input. The tables of steps 2 to 5 hold `blocks` rows a source and copy; nothing
per document is sorted but the documents of one block a source.

Defined results: null text has size 0; a null source is a source of its own and sorts
last; documents that share source and id are drawn together; an empty table gives an
empty mix. Extra columns stay in the struct `doc`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.sizing import is_small
from stockyard.session import store

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds in which a remainder is filled up with what comes later in the order.
FILL_ROUNDS = 8


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # of the sources in order, repeating
    share: float = 1.5  # words of the mix over words there are
    most: float = 2.0  # words a source may give over words it has
    blocks: int = 256  # per source
    levels: int = 4  # of the tree; 2**levels shards
    seed: int = 20


@dataclass(frozen=True)
class Plan:
    settings: Settings
    sources: DataFrame  # source, source_size, target
    blocks: DataFrame  # source, block, passes, extra, partial, shards, source_size, target
    singles: DataFrame  # source, id: documents of partial blocks that are drawn once more


def _hash(settings: Settings, step: str, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(settings.seed), F.lit(step), *columns)


def measure(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows as a struct `doc`, with id, source, size in words and block."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(_hash(settings, "block", "doc_id"), F.lit(settings.blocks)).cast("int").alias("block"),
    )


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source and source_size, one row per source, to these and target.

    With the sources in order of size over weight, a prefix of them stops at its
    limit; the level that the others share is known from prefix sums.
    """
    size = F.col("source_size").cast("double")
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    rows = sizes.select(
        "source",
        "source_size",
        place.alias("place"),
        F.get(weights, place % len(settings.weights)).alias("weight"),
        (settings.most * size).alias("limit"),
    )
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.lit(settings.share) * F.sum(F.col("source_size")).over(everything)
        - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("rank", F.row_number().over(filling))
    rows = rows.withColumn(
        "first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("rank"))).over(everything)
    )
    rows = rows.withColumn("shared", F.min(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything))
    open_target = F.least(F.col("shared") * F.col("weight"), F.col("limit"))
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("rank") < F.col("first"), F.col("limit")).otherwise(F.coalesce(open_target, F.col("limit"))).alias("target"),
    )


def _fill(rows: DataFrame, size: str, amount: str, *order: Column | str) -> DataFrame:
    """Per source, take rows in order while they fit into `amount`; rows too large are passed over.

    Adds `got` (taken), `first_over` (the first that did not fit) and `left` (what remains).
    """
    group = Window.partitionBy("source")
    running = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"got": F.lit(False), "over": F.lit(False), "first_over": F.lit(False), "left": F.col(amount).cast("double")}
    )
    for turn in range(FILL_ROUNDS):
        free = ~F.col("got") & ~F.col("over") & ((F.col(size) <= F.col("left")) | F.lit(turn == 0)) & (F.col(amount) > 0)
        rows = rows.withColumn("sum", F.sum(F.when(free, F.col(size)).otherwise(0)).over(running))
        fits = free & (F.col("sum") <= F.col("left"))
        crosses = free & (F.col("sum") > F.col("left")) & (F.col("sum") - F.col(size) <= F.col("left"))
        rows = rows.withColumns({"fits": fits, "crosses": crosses})
        rows = rows.withColumns(
            {
                "got": F.col("got") | F.col("fits"),
                "over": F.col("over") | F.col("crosses"),
                "first_over": F.col("crosses") if turn == 0 else F.col("first_over"),
                "left": F.col("left") - F.coalesce(F.max(F.when(F.col("fits"), F.col("sum"))).over(group), F.lit(0)),
            }
        )
    return rows.drop("sum", "fits", "crosses", "over")


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _shards(copies: DataFrame, settings: Settings) -> DataFrame:
    """source, block, copy to these and shard."""
    of_source = Window.partitionBy("source")
    tokens = copies.select("source", F.row_number().over(of_source.orderBy("block", "copy")).alias("token"))
    tokens = tokens.withColumn("node", F.lit(0))
    for level in range(settings.levels):
        node = Window.partitionBy("node")
        rank = F.row_number().over(node.orderBy(_hash(settings, f"split {level}", "node", "source", "token"), "source", "token"))
        odd = F.pmod(_hash(settings, f"odd {level}", "node"), F.lit(2))
        half = F.floor((F.count(F.lit(1)).over(node) + odd) / 2)
        tokens = tokens.withColumn("node", F.col("node") * 2 + (rank > half).cast("int"))
    quotas = tokens.groupBy("source", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))
    upto = F.sum("quota").over(of_source.orderBy("shard"))
    quotas = quotas.withColumn("upto", upto)
    drawn = copies.withColumn(
        "draw", F.row_number().over(of_source.orderBy(_hash(settings, "draw", "source", "block", "copy"), "block", "copy"))
    )
    within = (F.col("d.draw") <= F.col("q.upto")) & (F.col("d.draw") > F.col("q.upto") - F.col("q.quota"))
    joined = drawn.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & within)
    return joined.select("d.source", "d.block", "d.copy", "q.shard")


def plan(measured: DataFrame, settings: Settings = Settings()) -> Plan:
    """Which blocks and documents are drawn how often, and to which shards."""
    sums = store(measured.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-sums")
    sources = store(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), settings), "mix-sources")
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    blocks = sums.alias("b").join(F.broadcast(sources).alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    blocks = blocks.select("b.source", "block", "words", "source_size", "target", passes.alias("passes"))
    blocks = blocks.withColumn("rest", F.col("target") - F.col("passes") * size)
    filled = store(_fill(blocks, "words", "rest", _hash(settings, "extra", "source", "block"), "block"), "mix-filled")
    copies = filled.select(
        "source",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("passes") + (F.col("got") | F.col("first_over")).cast("int"))).alias("copy"),
    ).where("copy > 0")
    shards = _shards(copies, settings)
    shards = shards.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    planned = filled.alias("f").join(
        shards.alias("x"), F.col("f.source").eqNullSafe(F.col("x.source")) & (F.col("f.block") == F.col("x.block")), "left"
    )
    planned = planned.select(
        "f.source",
        "f.block",
        "passes",
        F.col("got").alias("extra"),
        F.col("first_over").alias("partial"),
        F.coalesce(F.col("shards.shard"), F.array().cast("array<int>")).alias("shards"),
        "source_size",
        "target",
    )
    open_blocks = filled.where("first_over").select("source", "block", "left")
    inside = measured.join(
        F.broadcast(open_blocks), _same_source(measured, open_blocks) & (measured["block"] == open_blocks["block"])
    )  # one block a source
    inside = inside.groupBy(measured["source"].alias("source"), "id").agg(
        F.sum("size").alias("size"), F.first("left").alias("room")
    )
    singles = _fill(inside, "size", "room", _hash(settings, "single", "id"), "id").where("got").select("source", "id")
    return Plan(settings, sources, store(planned, "mix-blocks"), store(singles, "mix-singles"))


def assign(measured: DataFrame, mix: Plan) -> DataFrame:
    """Every row with `shards`, the shards that a copy of it goes to, and its source's figures.

    The block table goes to every task if it is small, which a few sources with
    `blocks` rows each are; documents are shuffled only if it is not.
    """
    small = is_small(mix.blocks)
    blocks = F.broadcast(mix.blocks) if small else mix.blocks
    joined = measured.alias("m").join(
        blocks.alias("b"), F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.block") == F.col("b.block"))
    )
    rows = joined.select("m.*", "passes", "extra", "partial", "shards", "source_size", "target")
    closed = rows.where("not partial")
    single = mix.singles.select(F.col("source").alias("s_source"), F.col("id").alias("s_id")).withColumn("single", F.lit(True))
    opened = rows.where("partial").join(
        single, F.col("source").eqNullSafe(F.col("s_source")) & F.col("id").eqNullSafe(F.col("s_id")), "left"
    )
    opened = opened.withColumn("extra", F.coalesce("single", F.lit(False)))
    rows = closed.unionByName(opened.drop("single", "s_source", "s_id"))
    taken = F.col("passes") + F.col("extra").cast("int")
    return rows.select(
        "doc", "id", "source", "size", "source_size", "target", F.slice("shards", F.lit(1), taken).alias("shards")
    )


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix: one row per drawn copy, with its shard and its place in the order of the shard."""
    measured = measure(docs, settings)
    sizes = store(measured.select("id", "source", "size", "block"), "mix-sizes")
    rows = assign(measured, plan(sizes, settings))
    copies = rows.select("doc", "id", F.posexplode("shards").alias("copy", "shard"))
    return copies.select("doc", "copy", "shard", _hash(settings, "order", "shard", "id", "copy").alias("position"))


def write_shards(mix: DataFrame, path: str) -> None:
    """One folder per shard, rows in the shard's order in each of its files."""
    mix.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
