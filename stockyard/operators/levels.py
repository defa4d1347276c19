"""Stock levels where a reserve takes a whole quantity or nothing.

Whether a reserve fits depends on the level before it, and no prefix sum says that.
But rows are a function from the level before them to the level after them: up to the
sum of their reserves a table, beyond it the level plus the net change, as nothing is
refused there. Tables of neighbouring rows compose.

* A task cuts the rows of each key into chunks of `CHUNK` rows and steps through all
  chunks at once: first for their tables, as arrays over all entry levels, then, when
  the tables have told every chunk's entry level, for the levels themselves.
* A key that crosses blocks needs the level its left neighbour ends with. Each such
  block gives one table, all in one pass; the tables of a key are composed in order,
  one number going in and one coming out of a block. So there is one pass for the
  tables and one for the rows, however many blocks a key has.

A block's table has no more entries than the stock can have: what the key opened with
and all releases before the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockyard.operators.blocks import range_blocks
from stockyard.operators.replay import key_changes
from stockyard.schemas import struct
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

CHUNK = 32
#: Numbers that the tables of one step may hold.
CELLS = 1 << 22

_TABLES = "chain INT, block INT, net BIGINT, released BOOLEAN, table BINARY"
_ENTRIES = "block INT, level BIGINT, has BOOLEAN"
_OUT = "level INT, success BOOLEAN, reason STRING"

#: A level, and whether there is a counter at all.
Entry = tuple[int, bool]


def _stepped(levels: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The levels after one more row: a reserve that does not fit changes nothing."""
    after = levels + delta
    return np.where(after < 0, levels, after)


def _chunks(delta: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of keys as a matrix, a line per chunk, filled up with zeros; each chunk's key, and each row's cell."""
    sizes = np.diff(np.append(starts, len(delta)))
    of_key = -(-sizes // CHUNK)
    key = np.repeat(np.arange(len(starts)), of_key)
    first = np.cumsum(of_key) - of_key
    within = np.arange(len(delta)) - np.repeat(starts, sizes)
    cell = (np.repeat(first, sizes) + within // CHUNK) * CHUNK + within % CHUNK
    lines = np.zeros(len(key) * CHUNK, np.int64)
    lines[cell] = delta
    return lines.reshape(-1, CHUNK), key, cell


def _tables(lines: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """For each chunk the levels after it, by the level before it, up to the sum of its reserves or its bound."""
    widths = np.minimum(np.maximum(-lines, 0).sum(1), bound) + 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lines)
    order = np.argsort(widths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and widths[order[hi]] * (hi + 1 - lo) <= CELLS:
            hi += 1
        some = order[lo:hi]
        levels = np.broadcast_to(np.arange(widths[some[-1]]), (len(some), widths[some[-1]]))
        for k in range(CHUNK):
            levels = _stepped(levels, lines[some, k : k + 1])
        for at, own in zip(some.tolist(), levels, strict=True):
            out[at] = own[: widths[at]]
        lo = hi
    return out


def _through(table: np.ndarray, net: int, levels: np.ndarray) -> np.ndarray:
    inside = levels < len(table)
    return np.where(inside, table[np.where(inside, levels, 0)], levels + net)


def levels_after(delta: np.ndarray, starts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The level after each row; `starts` are the first rows of keys, `entry` their levels before that."""
    lines, key, cell = _chunks(delta, starts)
    before = entry[key].astype(np.int64)
    chunk_of = np.arange(len(key)) - np.searchsorted(key, key)
    followed = np.flatnonzero(np.append(key[1:] == key[:-1], False)) if len(key) else np.zeros(0, np.int64)
    if len(followed):
        gains = np.add.reduceat(np.maximum(delta, 0), starts)
        tables = dict(zip(followed.tolist(), _tables(lines[followed], (entry + gains)[key[followed]]), strict=True))
        net = lines.sum(1)
        for at in followed[np.argsort(chunk_of[followed], kind="stable")].tolist():
            before[at + 1] = _through(tables[at], int(net[at]), before[at : at + 1])[0]
    out = np.zeros(lines.shape, np.int64)
    levels = before
    for k in range(CHUNK):
        levels = _stepped(levels, lines[:, k])
        out[:, k] = levels
    return out.reshape(-1)[cell]


class BlockTable:
    """The table of all rows of one key in a block, taken in piece by piece."""

    def __init__(self, bound: int):
        # Entry levels that have come to one level go on as one.
        self.levels, self.of_entry, self.net, self.released, self.full = None, None, 0, False, bound + 1

    def add(self, delta: np.ndarray) -> None:
        if self.levels is None:
            self.levels, self.of_entry = np.arange(self.full), np.arange(self.full)
        lines, _, _ = _chunks(delta, np.zeros(1, np.int64))
        highest = int(self.levels.max()) + int(np.maximum(delta, 0).sum())
        net = lines.sum(1)
        for k, table in enumerate(_tables(lines, np.full(len(lines), highest))):
            self.levels = _through(table, int(net[k]), self.levels)
            if k % CHUNK == CHUNK - 1 or k == len(lines) - 1:
                self.levels, same = np.unique(self.levels, return_inverse=True)
                self.of_entry = same[self.of_entry]
        self.net += int(delta.sum())
        self.released |= bool((delta > 0).any())

    def table(self) -> np.ndarray:
        return self.levels[self.of_entry]


def _block_tables(bounds: dict[int, int], chains: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, BlockTable] = {}

        def told(block: int) -> pa.RecordBatch:
            t = made.pop(block)
            values = [[chains[block]], [block], [t.net], [t.released], [t.table().astype("<i8").tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, x) for v, x in zip(values, to_arrow_schema(struct(_TABLES)).types, strict=True)], names=struct(_TABLES).names
            )

        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            delta = batch.column("delta").to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else []
            for lo, hi in zip(cuts, cuts[1:]):
                block = int(blocks[lo])
                for other in [b for b in made if b != block]:
                    yield told(other)
                made.setdefault(block, BlockTable(bounds[block])).add(delta[lo:hi])
        for block in list(made):
            yield told(block)

    return run


def _composed(openings: dict[int, int | None], creates: bool):
    """Tables of chains in order of their blocks, to the level and counter after each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, level, has = None, 0, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["chain"] != chain:
                    chain, opening = row["chain"], openings[row["chain"]]
                    level, has = opening or 0, opening is not None
                table = np.frombuffer(row["table"], "<i8")
                level = int(_through(table, row["net"], np.array([level]))[0])
                has = has or (creates and row["released"])
                out.append((row["block"], level, has))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(columns, to_arrow_schema(struct(_ENTRIES)).types, strict=True)], names=struct(_ENTRIES).names
            )

    return run


def _all_rows(key: list[str], kept: list[str], schema: T.StructType, creates: bool, entries: dict[int, Entry]):
    """Per event row: the kept columns, the level after it, and whether it took place."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = last_key = None
        state: Entry = (0, False)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            delta = batch.column("delta").to_numpy(zero_copy_only=False).astype(np.int64)
            opened = batch.column("total_qty").is_valid().to_numpy(zero_copy_only=False)
            total = batch.column("total_qty").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            turned = blocks[1:] != blocks[:-1]
            starts = np.concatenate([[0], np.flatnonzero(key_changes(batch, key) | turned) + 1])
            entry, has = total[starts], opened[starts]
            for k in [0, *(np.flatnonzero(np.isin(starts[1:] - 1, np.flatnonzero(turned))) + 1).tolist()]:
                here = int(blocks[starts[k]])
                if k or here != block:
                    if here in entries:
                        entry[k], has[k] = entries[here]
                elif tuple(batch.column(c)[0].as_py() for c in key) == last_key:
                    entry[k], has[k] = state
            after = levels_after(delta, starts, entry)
            sizes = np.diff(np.append(starts, n))
            counter = np.repeat(has, sizes)
            if creates:
                place = np.where(delta > 0, np.arange(n), -1)
                counter |= np.maximum.accumulate(place) >= np.repeat(starts, sizes)
            before = np.concatenate([[0], after[:-1]])
            before[starts] = entry
            refused = (delta < 0) & (after == before)
            reasons = np.where(~counter & (delta < 0), "SALE_NOT_FOUND", np.where(counter & refused, "OUT_OF_STOCK", ""))
            said = [
                pa.array(after.astype(np.int32), mask=~counter),
                pa.array(counter & ~refused),
                pa.array(reasons.astype(object), pa.string(), mask=reasons == ""),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in kept] + said, schema=arrow)
            block, last_key = int(blocks[-1]), tuple(batch.column(c)[n - 1].as_py() for c in key)
            state = (int(after[-1]), bool(counter[-1]))

    return run


def quantity_levels(
    events: DataFrame, opening: DataFrame, key: Sequence[str], release_creates: bool = False, blocks: int | None = None
) -> DataFrame:
    """The level after each event (key, ts, id, delta) from `opening` (key, total_qty); see `ledger.stock_ledger`."""
    key = list(key)
    kept = [*key, "ts", "id", "delta"]
    opened = events.select(*kept).join(opening.select(*key, "total_qty"), key, "left").select(*kept, "total_qty")
    blocked = range_blocks(opened, key, ["ts", "id"], blocks)
    spark = events.sparkSession
    schema = T.StructType([*[blocked.schema[c] for c in kept], *struct(_OUT).fields])

    def final(entries: dict[int, Entry]) -> DataFrame:
        return blocked.select("block", "total_qty", *kept).mapInArrow(_all_rows(key, kept, schema, release_creates, entries), schema)

    if blocked.rdd.getNumPartitions() == 1:
        return final({})
    # One row of border keys per block.
    whole = F.struct(*key)
    borders = {
        r.block: (r.first, r.last)
        for r in blocked.groupBy("block").agg(F.min_by(whole, "pos").alias("first"), F.max_by(whole, "pos").alias("last")).collect()
    }
    in_order = sorted(borders)
    left_of = {b: a for a, b in zip(in_order, in_order[1:]) if borders[a][1] == borders[b][0]}
    if not left_of:
        return final({})
    tails = sorted(set(left_of.values()))
    tail_schema = T.StructType([T.StructField("_block", T.IntegerType()), *[T.StructField(f"_{c}", blocked.schema[c].dataType) for c in key]])
    tail_keys = spark.createDataFrame([(b, *borders[b][1]) for b in tails], tail_schema)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], F.col("block") == F.col("_block"))
    crossing = blocked.join(F.broadcast(tail_keys), same, "left_semi")  # at most one row per block is broadcast
    gain, loss = F.sum(F.greatest("delta", F.lit(0))), F.sum(F.greatest(-F.col("delta"), F.lit(0)))
    sums = {r.block: r for r in crossing.groupBy("block").agg(gain.alias("gain"), loss.alias("loss"), F.first("total_qty").alias("total")).collect()}
    chains: dict[int, int] = {}
    bounds: dict[int, int] = {}
    most = 0
    for b in tails:  # a chain begins where the key does
        a = left_of.get(b)
        whole_block = a is not None and borders[b][0] == borders[b][1]
        chains[b] = chains[a] if whole_block else b
        most = most if whole_block else max(0, sums[b].total or 0)
        bounds[b] = min(most, sums[b].loss)
        most += sums[b].gain
    openings = {b: sums[b].total for b in set(chains.values())}
    made = crossing.select("block", "delta").mapInArrow(_block_tables(bounds, chains), struct(_TABLES))
    dealt = store(made, "level-tables").repartition("chain").sortWithinPartitions("chain", "block")
    ends = {r.block: (r.level, r.has) for r in dealt.mapInArrow(_composed(openings, release_creates), struct(_ENTRIES)).collect()}
    return final({b: ends[a] for b, a in left_of.items()})
