"""Documents as token ids in files of Re-Pair shards, in ascending doc_id order.

Writing: rows are range-partitioned on (doc_id, hash of the text, place of the row), so
neither a repeated id nor a repeated row keeps its rows in one task, and sorted. A task
encodes its texts, cuts them at document ends into shards of about `SHARD_IDS` ids, and
compresses each one (`repair.py`). A shard is one record of bytes; the records lie in
Parquet files, so that Spark commits them and any store of Spark's can hold them, with
the least and greatest doc_id and the number of ids beside them.

Reading: a part of the range partitioning begins where the ids of the parts before it
end; these sums, one number per part, go to every task. `read` decodes whole shards,
`fetch` only the symbols that cover the wanted documents.

Encoding: the vocabulary used here splits texts into letters, digits and other signs before
it merges anything, so the library encodes each distinct unit once, and a text is the ids of
its units. `by_units` says for which tokenizers that holds; others get whole texts.

Defined results: null and empty texts have the end id alone; rows without a doc_id come
first; rows of one doc_id follow each other in the order of their texts' hashes, repeated
rows each count; a very long text makes a longer shard; an empty table has no shard.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm.kernels import lean, runs, utf8, word_spans, worker_memory
from stockyard.llm.repair import Shard
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Ids of a shard; the last document may exceed it.
SHARD_IDS = 1 << 16
#: Distinct units whose ids a worker remembers.
REMEMBERED = 1_000_000

#: Bytes of text whose distinct units are looked up together.
RUN_BYTES = 16 << 20

_SHARDS = "part int, place int, first_id long, last_id long, n_docs long, base long, n_ids long, doc_ids binary, shard binary"
_NO_ID = -(1 << 63)


#: Fixed value: how the tokenizer file must split texts for units to be encoded apart.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLANK, _OTHER, _DIGIT, _LETTER, _WIDE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _WIDE


#: Fixed value: the character that stands for a byte in such files, for bytes that are no visible character of Latin-1.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def by_units(tokenizer: str) -> bool:
    """Whether this tokenizer file splits texts as `unit_starts` says, lower-cases them, and takes each part by itself."""
    with open(tokenizer, encoding="utf-8") as f:
        parts = json.load(f)
    steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    norms = (parts.get("normalizer") or {}).get("normalizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or [x["type"] for x in norms] != ["NFC", "Replace", "Lowercase"]:
        return False
    split, byte_level = steps
    return (
        (split["pattern"].get("Regex"), split["behavior"], split["invert"]) == (_SPLIT, "Removed", True)
        and not (byte_level["add_prefix_space"] or byte_level["use_regex"])
        and (norms[1]["pattern"].get("Regex"), norms[1]["content"]) == (r"\s+", " ")
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in parts["added_tokens"])
        and not parts["model"].get("dropout")
    )


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units: words, cut further between ASCII letters, digits and other signs.

    Nothing is cut next to bytes beyond ASCII, since marks there join the letter before,
    or after an apostrophe, which may take letters along.
    """
    starts, _, _ = word_spans(data, offsets)
    kind = _CLASS[data]
    p, q = kind[:-1], kind[1:]
    cut = ((p == _LETTER) & (q == _OTHER)) | ((p == _OTHER) & (q == _LETTER) & (data[:-1] != 39))
    cut |= ((p == _DIGIT) & (q != _WIDE) & (q != _BLANK)) | ((q == _DIGIT) & (p != _WIDE) & (p != _BLANK))
    marked = np.zeros(len(data), bool)
    marked[1:] = cut
    marked[starts] = True
    return np.flatnonzero(marked)


class Encoder:
    """Texts to their ids, all in one array."""

    def __init__(self, tokenizer: str, units: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.units = Tokenizer.from_file(tokenizer), units
        self.model = self.library.model
        self.known: dict[bytes, bytes] = {}
        special = [(k, t.content) for k, t in self.library.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.mark = min(special, default=None)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit. A special token between units keeps them apart, which costs less than a call for each."""
        if self.mark is None or any(self.mark[1] in u for u in units):
            return self._library(units)
        out, joined = [], [self.mark[1].join(units[k : k + 64]) for k in range(0, len(units), 64)]
        for ids in self._library(joined):
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            out += [ids[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
        return out

    def learned(self, units: list[bytes]) -> list[bytes]:
        """The ids of units with white space after them, as bytes."""
        out, rest, tokenize = [b""] * len(units), [], self.model.tokenize
        # Lower-case Latin letters in composed form go to the model as they are: there is nothing to normalise or to split.
        for k, unit in enumerate(units):
            unit = unit.rstrip()
            if not (unit.isalpha() and unit.islower()):
                text = unit.decode()
                if not text.isalpha() or max(text) > "\u024f" or text.lower() != text:
                    rest.append((k, text))
                    continue
            out[k] = array("I", [t.id for t in tokenize(unit.decode("latin-1").translate(_BYTES))]).tobytes()
        for lo in range(0, len(rest), 8192):
            places, texts = zip(*rest[lo : lo + 8192], strict=True)
            for k, ids in zip(places, self._apart(list(texts)), strict=True):
                out[k] = ids.tobytes()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and how many each row has."""
        if not self.units:
            ids = self._library([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)
        if b"<|" in data.tobytes():  # there may be special tokens; they count as they are written
            starts, _, _ = word_spans(data, offsets)
        else:
            starts = unit_starts(data, offsets)
            # A letter is lower-cased here unless something beyond ASCII follows, which may join it.
            big = np.flatnonzero((data >= 65) & (data <= 90))
            big = big[data[np.minimum(big + 1, len(data) - 1)] < 128]
            data = data.copy()
            data[big] += 32
            data[(data >= 9) & (data <= 13)] = 32
        # A unit with the white space up to the next one; no text is copied to find the distinct ones.
        cuts = np.append(starts, len(data)).astype(np.int64)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        units = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, units))
        new = [k for k, x in enumerate(ids) if x is None]
        for k, found in zip(new, self.learned([units[k] for k in new]), strict=True):
            ids[k] = found
        if len(self.known) + len(new) > REMEMBERED:  # forget all but the units of this run
            self.known = dict(zip(units, ids, strict=True))
        else:
            self.known.update((units[k], ids[k]) for k in new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        which = coded.indices.to_numpy()
        each = sizes[which]
        stops = np.cumsum(each)
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - (stops - each), each) + np.arange(stops[-1] if len(stops) else 0)
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]
        return flat[places], np.diff(bounds)


def loaded(tokenizer: str, units: bool) -> Encoder:
    """One tokenizer and its memory per Python worker, kept for the worker's next tasks."""
    memory = worker_memory("tokenfiles")
    if (tokenizer, units) not in memory:
        memory.clear()
        memory[tokenizer, units] = Encoder(tokenizer, units)
    return memory[tokenizer, units]


class _Packer:
    """Collects documents and gives a record for each full shard."""

    def __init__(self, part: int, end_id: int):
        self.part, self.place, self.base = part, 0, 0
        self.end = np.array([end_id], np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.doc_ids, self.data, self.ends, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(_NO_ID if doc_id is None else doc_id)
        self.data += (ids, self.end)
        self.held += len(ids) + 1
        self.ends.append(self.held)

    def record(self) -> pa.RecordBatch:
        shard = Shard.of(np.concatenate(self.data), np.array(self.ends)).to_bytes()
        doc_ids = np.array(self.doc_ids, "<i8")
        named = doc_ids[doc_ids != _NO_ID]
        values = [
            pa.array([self.part], pa.int32()),
            pa.array([self.place], pa.int32()),
            pa.array([int(named[0]) if len(named) else None], pa.int64()),
            pa.array([int(named[-1]) if len(named) else None], pa.int64()),
            pa.array([len(doc_ids)], pa.int64()),
            pa.array([self.base], pa.int64()),
            pa.array([self.held], pa.int64()),
            pa.array([doc_ids.tobytes()], pa.binary()),
            pa.array([shard], pa.binary()),
        ]
        self.place, self.base = self.place + 1, self.base + self.held
        self._clear()
        return pa.RecordBatch.from_arrays(values, [f.split()[0] for f in _SHARDS.split(", ")])


def _pack(tokenizer: str, units: bool, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, _Packer(TaskContext.get().partitionId(), end_id)
        for batch in batches:
            encoder = encoder or loaded(tokenizer, units)
            data, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in runs(offsets, RUN_BYTES):
                ids, sizes = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(sizes)
                for doc_id, a, b in zip(doc_ids[lo:hi], (ends - sizes).tolist(), ends.tolist(), strict=True):
                    packer.add(doc_id, ids[a:b])
                    if packer.held >= shard_ids:
                        yield packer.record()
        if packer.held:
            yield packer.record()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode the texts, each followed by `end_id`, and write them to `path` in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text"), "_place"]
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = rows.select("doc_id", "text").mapInArrow(lean(_pack(tokenizer, by_units(tokenizer), end_id, shard_ids), "tokenfiles"), _SHARDS)
    packed.write.parquet(path)


def _starts(shards: DataFrame) -> dict[int, int]:
    """Where each part's ids begin: one number per partition of the writing job."""
    sums = sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect())
    out, total = {}, 0
    for part, n in sums:
        out[part], total = total, total + n
    return out


_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(starts: dict[int, int], with_ids: bool, wanted: set[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, base, names, data = (batch.column(c)[k] for c in ("part", "base", "doc_ids", "shard"))
                shard = Shard.from_bytes(data.as_buffer())
                doc_ids = np.frombuffer(names.as_buffer(), "<i8")
                begins = np.concatenate([[0], shard.ends[:-1]])
                if wanted is None:
                    picked, whole = range(len(doc_ids)), shard.ids().astype("<u4")
                    ids = [whole[a:b] for a, b in zip(begins, shard.ends, strict=True)]
                else:
                    picked = [j for j, d in enumerate(doc_ids.tolist()) if d in wanted]
                    ids = [shard.document(j).astype("<u4") for j in picked]
                columns = [
                    pa.array([None if doc_ids[j] == _NO_ID else int(doc_ids[j]) for j in picked], pa.int64()),
                    pa.array([starts[part.as_py()] + base.as_py() + int(begins[j]) for j in picked], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                if with_ids:
                    cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))
                names_of = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names_of[: len(columns)])

    return run


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if wanted, ids."""
    shards = spark.read.parquet(path)
    rows = shards.select("part", "base", "doc_ids", "shard")
    return rows.mapInArrow(_documents(_starts(shards), with_ids, None), _ROWS + (", ids array<int>" if with_ids else ""))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of the given ids; of other shards nothing is read, of their own only the needed symbols are expanded."""
    shards, wanted = spark.read.parquet(path), sorted(set(doc_ids))
    holds = F.lit(False)
    for lo in range(0, len(wanted), 64):
        some = wanted[lo : lo + 64]
        holds |= (F.col("first_id") <= some[-1]) & (F.col("last_id") >= some[0])
    rows = shards.where(holds).select("part", "base", "doc_ids", "shard")
    return rows.mapInArrow(_documents(_starts(shards), True, set(wanted)), _ROWS + ", ids array<int>")
