"""Ordered replay of per-key state that a window expression cannot express.

Rows are laid out by `range_blocks`. One small fold runs over each block in
order. Only a key that crosses a border needs the state its left neighbour ended
with. So the rows of such keys are first folded from an empty state, and blocks
whose true entry state turns out different are folded again until nothing
changes. The first block of a key starts right, so every round settles at least
one more block and the fixpoint is the sequential result. Blocks that hold
several keys never take part in the rounds.

Where a key's state forgets how it began, two rounds do. Where it does not (a
limiter that is never idle), guesses stop paying, and the rounds walk along the
key, a bounded number of blocks per task.

The driver sees the border keys and one digest per block. States are handed to
the blocks as a broadcast while their measured size is small, else as rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockyard.operators.blocks import range_blocks
from stockyard.schemas import struct
from stockyard.session import pin
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

# States are JSON-serialisable lists, [] when new.
# A step: (state, args of one row) -> output tuple, changing the state in place.
Step = Callable[[list, tuple], tuple]
# A run: (state, args as Arrow arrays, starts of keys) -> (output columns, state of the last key).
# The state belongs to the first key; the other keys start new.
Run = Callable[[list, list, np.ndarray], tuple[list, list]]

# States of all blocks together, as text, that may be broadcast.
BROADCAST_STATE_BYTES = 64 << 20
# Neighbouring blocks that one task walks when guessing does not pay.
WALK_BLOCKS = 8

_ENDS = struct("block INT, digest STRING, state STRING")
_EMPTY = "[]"


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def row_by_row(step: Step) -> Run:
    def run(state: list, args: list, starts: np.ndarray) -> tuple[list, list]:
        rows = list(zip(*(a.to_pylist() for a in args)))
        bounds = [*starts.tolist(), len(rows)]
        out = []
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if i:
                state = []
            out.extend(step(state, r) for r in rows[lo:hi])
        return list(zip(*out)), state

    return run


def key_changes(batch: pa.RecordBatch, key: Sequence[str]) -> np.ndarray:
    """Whether each row after the first has another key than the row before it."""
    changed = np.zeros(batch.num_rows - 1, dtype=bool)
    for c in key:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return changed


def _walk(batches, key, args, run: Run, begin: Callable, visit: Callable) -> Iterator:
    """Feed the rows, in pieces of one block, to `run`, and its results to `visit`.

    `begin(block, left, state)` gives the entry state of a block that follows
    block `left` in this task. An entry row replaces it.
    """
    block = last_key = None
    state: list = []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        entry = batch.column("entry")
        leads = set(np.flatnonzero(entry.is_valid().to_numpy(zero_copy_only=False)).tolist())
        cuts = {0, n, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), *leads, *(i + 1 for i in leads)}
        changed = key_changes(batch, key)
        first_key = tuple(batch.column(c)[0].as_py() for c in key)
        bounds = sorted(cuts)
        for lo, hi in zip(bounds, bounds[1:]):
            same_key = not changed[lo - 1] if lo else first_key == last_key
            if blocks[lo] != block:
                state = begin(int(blocks[lo]), block, state)
                block, same_key = int(blocks[lo]), True
            if lo in leads:
                state = json.loads(entry[lo].as_py())
                continue
            if not same_key:
                state = []
            starts = np.concatenate(([0], np.flatnonzero(changed[lo : hi - 1]) + 1))
            out, state = run(state, [batch.column(c).slice(lo, hi - lo) for c in args], starts)
            yield from visit(block, batch, lo, hi, out, state)
        last_key = tuple(batch.column(c)[n - 1].as_py() for c in key)


def _end_states(run: Run, args: list[str], entries, follows: dict[int, int]):
    """Per block of rows of one key: the state after its last row.

    A block in `follows` goes on from the block it names, which is in the same task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = entries.value if entries is not None else {}
        done: dict[int, str] = {}

        def begin(block, left, state):
            if left is not None:
                done[left] = json.dumps(state)
            if block in follows and follows[block] == left:
                return state
            return json.loads(given.get(block, _EMPTY))

        def visit(block, batch, lo, hi, out, state):
            done[block] = state
            return ()

        for _ in _walk(batches, [], args, run, begin, visit):
            pass
        if done:
            texts = [s if isinstance(s, str) else json.dumps(s) for s in done.values()]
            columns = [list(done), [_digest(t) for t in texts], texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, to_arrow_schema(_ENDS).types)], names=_ENDS.fieldNames()
            )

    return fold


def _all_rows(run: Run, key: list[str], args: list[str], kept: list[str], schema: T.StructType, entries):
    """Per event row: the kept input columns and what the fold says of it."""
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = entries.value if entries is not None else {}

        def begin(block, left, state):
            return json.loads(given.get(block, _EMPTY))

        def visit(block, batch, lo, hi, out, state):
            own = [batch.column(c).slice(lo, hi - lo).cast(arrow.field(c).type) for c in kept]
            said = [pa.array(c, type=t) for c, t in zip(out, arrow.types[len(kept) :])]
            yield pa.RecordBatch.from_arrays(own + said, schema=arrow)

        yield from _walk(batches, key, args, run, begin, visit)

    return fold


def replay(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    args: Sequence[str],
    run: Run,
    output: str,
    blocks: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Fold `run` over the rows of each key in `order`.

    `args` are the columns handed to `run`, `carry` further ones to keep. The
    result has all these and the columns of the DDL text `output`. Order columns
    must make rows unique within a key.
    """
    key, args = list(key), list(args)
    kept = list(dict.fromkeys([*key, *order, *args, *carry]))
    narrow = df.select(*kept)
    blocked = range_blocks(narrow, key, order, blocks).withColumn("entry", F.lit(None).cast("string"))
    spark = df.sparkSession
    out_schema = T.StructType([*narrow.schema.fields, *struct(output).fields])

    def final(rows: DataFrame, entries=None) -> DataFrame:
        fold = _all_rows(run, key, args, kept, out_schema, entries)
        return rows.select("block", "entry", *kept).mapInArrow(fold, out_schema)

    if blocked.rdd.getNumPartitions() == 1:
        return final(blocked)

    # One row of border keys per block.
    whole_key = F.struct(*key)
    borders = {
        r.block: (r.first, r.last)
        for r in blocked.groupBy("block")
        .agg(F.min_by(whole_key, "pos").alias("first"), F.max_by(whole_key, "pos").alias("last"))
        .collect()
    }
    in_order = sorted(borders)
    left_of = {b: a for a, b in zip(in_order, in_order[1:]) if borders[a][1] == borders[b][0]}
    if not left_of:
        return final(blocked)

    tails = sorted(set(left_of.values()))
    spanning = [b for b in tails if b in left_of and borders[b][0] == borders[b][1]]
    tail_schema = [T.StructField("_block", T.IntegerType())]
    tail_schema += [T.StructField(f"_{c}", blocked.schema[c].dataType) for c in key]
    tail_keys = spark.createDataFrame([(b, *borders[b][1]) for b in tails], T.StructType(tail_schema))
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], F.col("block") == F.col("_block")
    )
    # At most one row per block, so broadcasting keeps the blocks in place.
    crossing = blocked.join(F.broadcast(tail_keys), same, "left_semi")

    def with_entry_rows(rows: DataFrame, ends: DataFrame, wanted: Iterable[int]) -> DataFrame:
        """Rows of the blocks, each wanted one led by a row with its entry state."""
        link = spark.createDataFrame([(left_of[b], b) for b in wanted], "left INT, block INT")
        entry = ends.select(F.col("block").alias("left"), F.col("state").alias("entry")).join(
            F.broadcast(link), "left"
        ).select("block", "entry")
        lead = rows.filter("pos = 0").drop("entry").join(entry, "block").withColumn("pos", F.lit(-1))
        return rows.unionByName(lead.select(*rows.columns))

    def small_states(ends: DataFrame):
        """The entry states by block, when all of them together are small."""
        size = ends.agg(F.coalesce(F.sum(F.length("state")), F.lit(0))).first()[0]
        if size > BROADCAST_STATE_BYTES:
            return None
        held = {r.block: r.state for r in ends.select("block", "state").collect()}
        return spark.sparkContext.broadcast({b: held[a] for b, a in left_of.items()})

    def end_fold(rows: DataFrame, states=None, follows: dict | None = None) -> DataFrame:
        fold = _end_states(run, args, states, follows or {})
        return rows.select("block", "entry", *args).mapInArrow(fold, _ENDS)

    def fold_again(ends: DataFrame, walks: list[list[int]]) -> DataFrame:
        """New end states of the blocks; each walk is a run of neighbours for one task."""
        states = small_states(ends)
        todo = F.broadcast(
            spark.createDataFrame([(b, w[0]) for w in walks for b in w], "block INT, walk INT")
        )
        rows = blocked.join(todo, "block")
        if not states:
            rows = with_entry_rows(rows, ends, [w[0] for w in walks])
        follows = {b: left_of[b] for w in walks for b in w[1:]}
        if follows or not states:
            rows = rows.repartition("walk").sortWithinPartitions("walk", "block", "pos")
        again = end_fold(rows, states, follows)
        return pin(ends.join(todo, "block", "left_anti").unionByName(again))

    right_of = {a: b for b, a in left_of.items()}
    ends = pin(end_fold(crossing))
    used = {b: _digest(_EMPTY) for b in spanning}
    followed: list[int] = []
    before = None
    while True:
        digest = {r.block: r.digest for r in ends.select("block", "digest").collect()}
        used.update({b: digest[left_of[b]] for b in followed})
        changed = [b for b in spanning if used[b] != digest[left_of[b]]]
        if not changed:
            break
        if before is None or 2 * len(changed) <= before:
            walks = [[b] for b in changed]
        else:
            # The leftmost changed block of each key has its true entry state.
            open_blocks, walks = set(changed), []
            unsure: dict[int, bool] = {}
            for b in spanning:
                a = left_of[b]
                unsure[b] = a in open_blocks or unsure.get(a, False)
                if b not in open_blocks or unsure[b]:
                    continue
                walk = [b]
                while len(walk) < WALK_BLOCKS and right_of.get(walk[-1]) in used:
                    walk.append(right_of[walk[-1]])
                walks.append(walk)
        before = len(changed)
        used.update({w[0]: digest[left_of[w[0]]] for w in walks})
        followed = [b for w in walks for b in w[1:]]
        ends = fold_again(ends, walks)

    states = small_states(ends)
    if states:
        return final(blocked, states)
    rows = with_entry_rows(blocked, ends, left_of).repartition("block").sortWithinPartitions("block", "pos")
    return final(rows)
