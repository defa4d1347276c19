"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece
they form and then from left to right, merges the best pair and puts the two new
pairs on the agenda, until no pair forms a piece. Symbols without a piece fall back
to bytes. If no piece of the vocabulary has a space mark after another character,
no merge crosses such a place, nor a character that occurs in no longer piece; texts
are cut there into units and each distinct unit is merged once per worker. The agendas
of all new units of a batch are arrays: every step takes the first pair of each unit's
agenda, merges it and looks up the new pairs, for all units at once. Long units have a
heap each.

In each Arrow batch the units met for the first time are also encoded and decoded by
the sentencepiece library, and `agreed` tells whether all units of a text came out
alike. The model file is a parameter and must be readable on every executor.

Defined results: null text counts as empty and gives no ids; texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard.llm.kernels import HashTable, give_back, lean, runs, utf8, worker_memory
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

SPACE = "▁"
#: Distinct units that a worker remembers.
REMEMBERED = 400_000
#: Rows and bytes of texts that are encoded together.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 22
#: Longer units are not remembered.
UNIT_CHARS = 40
#: Bits of a symbol's code: pieces and all characters of Unicode.
CODE_BITS = 21
#: The rank of pairs that form no piece; it stands last in the ranks, where a pair that is not found (-1) looks.
NEVER = 1 << 30

RESULT = "struct<ids: array<int>, n_tokens: bigint, ids_sha256: string, decoded: string, decoded_sha256: string, agreed: boolean>"


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids, self.id_bytes = {}, {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.id_bytes[i] = i, bytes([value])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, -lib.get_score(i)
        self.unknown = lib.unk_id()
        if any(lib.is_unused(i) for i in range(size)) or lib.normalize("  A ﬁ ") != SPACE + SPACE * 2 + "A ﬁ" + SPACE:
            raise ValueError("only vocabularies with identity normalisation, a space put in front and no unused pieces")
        merged = set("".join(p for p in self.ids if len(p) > 1))
        self.apart = "".join(c for c in "\n\t" if c not in merged)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.units = lambda marked: [marked]
        elif self.apart:
            self.units = re.compile(f"[{self.apart}]|{SPACE}*[^{SPACE}{self.apart}]+|{SPACE}+").findall
        else:
            self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.remembered = REMEMBERED
        self.known: dict[str, str] = {}  # unit to its ids, joined by commas
        self.odd: dict[str, str] = {}  # units whose ids do not spell them, and what they spell
        self.differing: set[str] = set()
        self.odd_codes: list[int] = []  # characters whose ids do not spell them
        self._pairs()

    def _pairs(self) -> None:
        """Symbols as codes, and the table of pairs of codes that form a piece.

        A piece has its id as code; other characters get codes when they are met.
        """
        self.code_of_character = np.full(0x110000, -1, np.int64)
        self.spelled = [str(i) for i in range(len(self.pieces))]
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values())))}
        keys, merged, ranks = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self._code(piece[:cut]), self._code(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << CODE_BITS | right)
                    merged.append(i)
                    ranks.append(order[self.scores[piece]])
        self.pairs = HashTable(np.array(keys, np.uint64))
        self.merged, self.ranks = np.array(merged, np.int64), np.array([*ranks, NEVER], np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.code_of_character[ord(piece)] = i

    def _code(self, symbol: str) -> int | None:
        if symbol in self.ids:
            return self.ids[symbol]
        if len(symbol) > 1:
            return None
        code = int(self.code_of_character[ord(symbol)])
        if code < 0:
            code = len(self.spelled)
            self.code_of_character[ord(symbol)] = code
            raw = symbol.encode("utf-8", "surrogatepass")
            ids = [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]
            self.spelled.append(",".join(map(str, ids)))
            self.texts.append(self.spell(ids))
            if self.texts[-1] != symbol.replace(SPACE, " "):
                self.odd_codes.append(code)
        return code

    def merge_all(self, units: list[str]) -> tuple[list[str], dict[str, str]]:
        """The ids of many units, joined by commas, and what those spell that do not spell the unit: one step merges the first pair of every agenda."""
        out, odd = [""] * len(units), {}
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(points[self.code_of_character[points] < 0]):
            self._code(chr(c))
        codes = self.code_of_character[points]
        rows = np.repeat(np.arange(len(units)), [len(u) for u in units])
        # For each symbol the pair that it begins, and the rank of the piece that the pair forms.
        at, rank = np.full(len(codes), -1, np.int32), np.full(len(codes), NEVER)
        redo = np.flatnonzero(rows[:-1] == rows[1:])
        while len(codes):
            at[redo] = found = self.pairs.find((codes[redo] << CODE_BITS | codes[redo + 1]).astype(np.uint64))
            rank[redo] = self.ranks[found]
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(codes)), heads)
            done = best >= NEVER << 32
            left = (best[~done] & 0xFFFFFFFF).astype(np.int64)
            sizes = np.diff(np.append(heads, len(codes)))
            keep = np.repeat(~done, sizes)
            if done.any():
                last, ends = codes[~keep], np.cumsum(sizes[done]).tolist()
                spelled = [self.spelled[c] for c in last.tolist()]
                strange = set(rows[~keep][np.isin(last, self.odd_codes)].tolist()) if self.odd_codes else ()
                for row, a, b in zip(rows[heads[done]].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[row] = ",".join(spelled[a:b])
                    if row in strange:
                        odd[units[row]] = "".join([self.texts[c] for c in last[a:b]])
            codes[left] = self.merged[at[left]]
            keep[left + 1] = False
            # Only the pairs on either side of a merged one are new.
            at[left] = -1
            rank[left] = NEVER
            left = np.cumsum(keep)[left] - 1
            codes, rows, at, rank = codes[keep], rows[keep], at[keep], rank[keep]
            begun = left[left + 1 < len(codes)]
            begun = begun[rows[begun] == rows[begun + 1]]
            before = left[left > 0] - 1
            redo = np.concatenate([begun, before[rows[before] == rows[before + 1]]])
        return out, odd

    def merge(self, unit: str) -> list[int]:
        """The ids of a unit, by its agenda of adjacent pairs."""
        ids = self.ids
        if unit in ids and len(unit) == 1:
            return [ids[unit]]
        scores, symbols, n = self.scores, list(unit), len(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if right < 0 or symbols[left] is None or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = pair, None
            follower = after[left] = after[right]
            if follower >= 0:
                before[follower] = left
                new = pair + symbols[follower]
                if new in scores:
                    heappush(agenda, (scores[new], left, new))
            leader = before[left]
            if leader >= 0:
                new = symbols[leader] + pair
                if new in scores:
                    heappush(agenda, (scores[new], leader, new))
        out: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            i = ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def spell(self, ids: list[int]) -> str:
        """The text of ids, with the space that was put in front."""
        parts = []
        for i in ids:
            byte = self.id_bytes.get(i)
            if byte is not None:
                parts.append(byte)
            elif i == self.unknown:
                parts.append(" ⁇ ".encode())
            elif not self.library.is_control(i):
                parts.append(self.pieces[i].replace(SPACE, " ").encode())
        return b"".join(parts).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text

    def learn(self, units: list[str]) -> None:
        """Merge units not yet known and hold them against the library, all in one call."""
        if not units:
            return
        short = [u for u in units if len(u) <= UNIT_CHARS]
        joined, odd = self.merge_all(short)
        found = dict(zip(short, joined, strict=True))
        if len(short) < len(units):
            for unit in [u for u in units if len(u) > UNIT_CHARS]:
                ids = self.merge(unit)
                found[unit] = ",".join(map(str, ids))
                if (text := self.spell(ids)) != unit.replace(SPACE, " "):
                    odd[unit] = text
        # The library puts a space mark in front; what it gives for a character apart is dropped again.
        lead = self.apart[:1]
        drop = 1 + len(self.merge(lead)) if lead else 0
        asked = [u for u in units if len(u) > 1 and (u[0] == SPACE or lead)]
        given = self.library.encode([u[1:] if u[0] == SPACE else lead + u for u in asked], num_threads=1)
        spelled = self.spelled
        for unit, ids in zip(asked, given, strict=True):
            ids = ids if unit[0] == SPACE else ids[drop:]
            if ",".join([spelled[i] for i in ids]) != found[unit]:
                self.differing.add(unit)
        self.odd.update(odd)
        self.known.update(found)

    def encode_batch(self, texts: list[str | None], with_ids: bool) -> Iterator[tuple]:
        marked = [(SPACE + t).replace(" ", SPACE) if t else "" for t in texts]
        cut = [self.units(m) if m else [] for m in marked]
        own = set().union(*cut)
        long = {u for u in own if len(u) > UNIT_CHARS}
        own -= long
        new = own - self.known.keys()
        if len(self.known) + len(new) > self.remembered:  # forget all, but learn what this batch needs
            self.known.clear()
            self.odd.clear()
            self.differing.clear()
            new = own
        self.learn(list(new))
        for mark, units in zip(marked, cut, strict=True):
            rest = long.intersection(units) if long else ()
            if rest:
                self.learn(list(rest))
            csv = ",".join(map(self.known.__getitem__, units))
            for u in rest:
                self.known.pop(u, None)
            # Every unit's ids spell it again, or it is among the odd ones.
            if self.odd and not self.odd.keys().isdisjoint(units):
                decoded = "".join([self.odd.get(u, u.replace(SPACE, " ")) for u in units])
            else:
                decoded = mark.replace(SPACE, " ")
            decoded = decoded[1:] if decoded.startswith(" ") else decoded
            yield (
                [int(i) for i in csv.split(",")] if with_ids and csv else ([] if with_ids else None),
                csv.count(",") + 1 if csv else 0,
                hashlib.sha256(csv.encode()).hexdigest(),
                decoded if with_ids else None,
                hashlib.sha256(decoded.encode()).hexdigest(),
                not self.differing or self.differing.isdisjoint(units),
            )


def loaded(model_file: str) -> Pieces:
    """One vocabulary and its memory per Python worker, shared by the tasks that it runs."""
    memory = worker_memory("pieces")
    if model_file not in memory:
        memory.clear()
        memory[model_file] = Pieces(model_file)
    return memory[model_file]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in slices of a bounded number of rows and bytes, or of one row."""
    _, offsets = utf8(texts)
    for lo, hi in runs(offsets, SLICE_BYTES):
        for at in range(lo, hi, SLICE_ROWS):
            yield texts.slice(at, min(SLICE_ROWS, hi - at))


def encode(model_file: str, text: str | Column = "text", with_ids: bool = True, remembered: int | None = None) -> Column:
    """A struct column: ids, n_tokens, ids_sha256, decoded, decoded_sha256, agreed.

    Without `with_ids` the ids and the decoded text themselves are left out. `remembered`
    distinct units (`REMEMBERED` by default) are kept per worker; fewer take less memory
    and more time. With it given, memory also goes back to the system after every slice.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(model_file)
        pieces.remembered = remembered or REMEMBERED
        types = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        names = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256", "agreed")
        for texts in batches:
            for part in slices(texts):  # results go on at once, not as one large batch
                columns = zip(*pieces.encode_batch(part.to_pylist(), with_ids), strict=True)
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                if remembered:
                    give_back()

    encoded = F.arrow_udf(lean(run, "pieces"), RESULT)
    return encoded(F.col(text) if isinstance(text, str) else text)
