"""Exact deduplication by Patricia tries that know the owner of every text.

1. Each task inserts its texts into a trie and hands on one row per distinct text
   (text, owner, rows), so a text with a third of all rows costs one row per task.
   When the strings held exceed `HELD_BYTES`, the largest subtree spills: its
   terminals are handed on early and meet their equals in step 2.
2. Rows go to partitions by length and content hash, sorted by their bytes there.
   A second trie takes the full byte strings; as they come in order, subtrees before
   the current string are complete and leave the trie when it holds too much.
3. Every row finds its owner over the SHA-256 of its text. The trie has compared all
   bytes; two texts of one SHA-256 would come out as two owners.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; all empty texts are equal to each other. Rows with a null
doc_id belong to their group but never own one that has a doc_id. Of repeated rows
of the owner (same doc_id and text) exactly one stays. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kernels import lean
from stockyard.llm.trie import Node, PatriciaTrie
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Bytes of text that one trie holds before subtrees leave it.
HELD_BYTES = 16 << 20
#: Bytes of text in a batch handed on.
BATCH_BYTES = 4 << 20

_LOCAL = "length int, hash binary, text binary, owner long, copies long, size long"
_OWNERS = "text_sha256 string, keep_id long, keep_copies long, group_size long"


def normalised(text: str | Column = "text") -> Column:
    """A-Z lower-cased, null as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), ascii_uppercase, ascii_lowercase)


def _handed_on(nodes: Iterable[Node], largest: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("length", "hash", "text", "owner", "copies", "size")
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for node in nodes:
        text = node.text[: node.end]
        rows.append((len(text), hashlib.sha256(text).digest(), text, node.owner, node.owner_copies, node.size))
        held += len(text)
        if held > BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _local_owners(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for text, owner in zip(batch.column("text"), batch.column("doc_id"), strict=True):
                trie.insert(text.as_buffer().to_pybytes(), owner.as_py())
                if trie.held > HELD_BYTES:
                    yield from _handed_on(trie.spill_largest(), largest)
        yield from _handed_on(trie.spill_all(), largest)

    return run


def _owners(largest: bool):
    def result(nodes: Iterable[Node]) -> Iterator[pa.RecordBatch]:
        rows = [(hashlib.sha256(n.text[: n.end]).hexdigest(), n.owner, n.owner_copies, n.size) for n in nodes]
        if rows:
            sha, owner, copies, size = zip(*rows, strict=True)
            yield pa.record_batch(
                {
                    "text_sha256": pa.array(sha, pa.string()),
                    "keep_id": pa.array(owner, pa.int64()),
                    "keep_copies": pa.array(copies, pa.int64()),
                    "group_size": pa.array(size, pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(largest), b""
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("text", "owner", "copies", "size")]
            for text, owner, copies, size in zip(*columns, strict=True):
                if trie.held > HELD_BYTES and text != last:
                    yield from result(trie.spill_before(text))
                trie.insert(text, owner, copies, size)
                last = text
        yield from result(trie.spill_all())

    return run


def owners(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per distinct text: its hash, the doc_id that stays, its rows and the group's rows."""
    largest = {"smallest": False, "largest": True}[keep]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().cast("binary").alias("text"))
    local = texts.mapInArrow(lean(_local_owners(largest)), _LOCAL)
    dealt = local.repartition("length", "hash").sortWithinPartitions("text")
    return dealt.mapInArrow(lean(_owners(largest)), _OWNERS)


def members(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = store(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
        ),
        "dedup-keys",
    )
    heads = store(owners(docs, keep), "dedup-owners")
    joined = keys.join(heads, "text_sha256")
    # Repeated rows of an owner: the first of them stays.
    again = (
        joined.where("keep_copies > 1 and doc_id <=> keep_id")
        .groupBy(F.col("text_sha256").alias("again"))
        .agg(F.min("row").alias("first_row"))
    )
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.join(again, F.col("text_sha256") == F.col("again"), "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        (own & ((F.col("keep_copies") == 1) | (F.col("row") == F.col("first_row")))).alias("kept"),
        "text_sha256",
    )
