"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

An agenda holds the adjacent symbol pairs whose union is a piece, best score first, leftmost among equals; the top pair
is merged and its new neighbours enter, until none is left. Symbols that are no piece become their bytes. The agendas of
many segments are worked off abreast, in arrays: a round takes the top pair of each. Segments over WIDE characters have
one agenda each, a heap; the two give the same ids.

No piece of such a vocabulary crosses certain places: before a word mark that follows another character, and around a
line feed that no piece holds. A text is cut there, cuts cannot change the result, and each different segment goes
through the agenda once in a worker. Whatever enters that memory is compared, in the same Arrow batch, with what the
sentencepiece library makes of it; a text with a segment that differs is encoded by the library instead and counted
in ``n_differing``. Texts are decoded with the library.

Nulls: a null text is the empty text, with no ids. Long texts are worked through whole. The memory holds MEMORY to twice
as many bytes (as ``weight`` reckons them); segments over LONG characters, as in scripts without blanks, are worked out anew in
each chunk and not remembered. Between tasks of ``encode`` a worker keeps CARRIED bytes at most. Repeated rows come out as often as they come in; extra columns pass through ``encode``. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add, itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from .common import fresh

MARK, MEMORY, LONG, CHARS_AT_ONCE = "▁", 192 << 20, 200, 1_000_000
#: Bytes of segments that ``encode`` leaves in a worker between tasks: the worker stays for the stages of others.
CARRIED = 32 << 20
#: Segments up to WIDE characters are worked off abreast, in ABREAST cells (a character each, and two a segment) at a time.
WIDE, ABREAST = 64, 1 << 16
#: Fixed values of the model format.
BPE, NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message; 32-bit values as floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = data[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


NO_RANK = 2**31 - 1  # of a pair whose union is no piece


class Unions:
    """The piece that two symbols make, for arrays of pairs. A pair whose place in the first table is taken stands in the next."""

    def __init__(self, pairs: np.ndarray):
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        self.tables: list[tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]] = []
        factor = 0x9E3779B97F4A7C15
        while not self.tables or len(keys):
            bits = (4 * len(keys) + 15).bit_length()
            table = np.full(1 << bits, -1), np.full(1 << bits, -1), np.uint64(factor), np.uint64(64 - bits)
            place = self.places(keys, *table[2:])
            _, first = np.unique(place, return_index=True)
            table[0][place[first]], table[1][place[first]] = keys[first], values[first]
            self.tables.append(table)
            keys, values = np.delete(keys, first), np.delete(values, first)
            factor = factor * 0xD1342543DE82EF95 % 2**64

    @staticmethod
    def places(keys: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * factor >> shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the unions, -1 where there is none."""
        return self.looked_up(left << 32 | right, 0)

    def looked_up(self, keys: np.ndarray, k: int) -> np.ndarray:
        there, values, *hashing = self.tables[k]
        place = self.places(keys, *hashing)
        met = there[place]
        out = np.where(met == keys, values[place], -1)
        others = np.flatnonzero((met != keys) & (met >= 0))
        if len(others) and k + 1 < len(self.tables):
            out[others] = self.looked_up(keys[others], k + 1)
        return out


class Vocabulary:
    """Pieces, scores and settings of a merge-type model."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}  # scores with the sign turned, the best first
        self.octets = [-1] * 256
        self.unknown, kinds, n = 0, set(), 0
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {3: 1, 4: 1, 5: 1}
        for field, value in _fields(model):
            if field == 1:
                piece = {3: NORMAL, 2: 0.0} | dict(_fields(value))
                text, kind = piece[1].decode(), piece[3]
                kinds.add(kind)
                if kind == BYTE:
                    self.octets[int(text[1:-1], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind == NORMAL:
                    self.ids[text], self.costs[text] = n, -piece[2]
                n += 1
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer |= dict(_fields(value))
        if trainer.get(3, 1) != BPE or kinds & {USER_DEFINED, UNUSED} or trainer.get(24) or normalizer.get(2) or normalizer[4] or not normalizer[5] or not normalizer[3]:
            raise ValueError("only BPE models with an identity normalizer, a word mark in front and no user-defined or unused pieces")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross word marks")
        breaks = "" if any("\n" in p for p in self.ids) else "\n"
        self.segments = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" + "|\n" * bool(breaks))
        self.has_breaks = bool(breaks)
        self.size = n

    def segment(self, text: str) -> list[str]:
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, segment: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        symbols = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost = self.costs.get
        agenda = [(c, k, 2) for k, pair in enumerate(map(add, symbols, symbols[1:])) if (c := cost(pair)) is not None]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            right = after[left]
            own = symbols[left]
            if right < 0 or not own or len(own) + len(symbols[right]) != size:
                continue  # one of them has been merged meanwhile
            symbols[left] = own = own + symbols[right]
            symbols[right] = ""
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                pair = own + symbols[far]
                if (c := cost(pair)) is not None:
                    heappush(agenda, (c, left, len(pair)))
            if (near := before[left]) >= 0:
                pair = symbols[near] + own
                if (c := cost(pair)) is not None:
                    heappush(agenda, (c, near, len(pair)))
        return self.spelled(filter(None, symbols))

    def spelled(self, symbols: Iterable[str]) -> list[int]:
        out = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.octets[0] >= 0:
                out += [self.octets[x] for x in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment."""
        out: list[list[int]] = [[]] * len(segments)
        lengths = list(map(len, segments))
        order = sorted(range(len(segments)), key=lengths.__getitem__)
        short = bisect_right(order, WIDE, key=lengths.__getitem__)
        end = short
        while end:
            part = order[max(0, end - max(1, ABREAST // (lengths[order[end - 1]] + 2))) : end]
            end -= len(part)
            for k, ids in zip(part, self.abreast.encode([segments[k] for k in part]), strict=True):
                out[k] = ids
        for k in order[short:]:
            out[k] = self.encode(segments[k])
        return out

    @cached_property
    def abreast(self) -> Abreast:
        return Abreast(self)


class Abreast:
    """Agendas of many segments in arrays. A symbol is the id of a piece, or ``size`` and the code point of a character that is none."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, vocabulary.size
        self.edge = self.size + 0x110000  # the symbol that joins nothing
        self.symbols = np.arange(self.size, self.edge, dtype=np.int32)
        for text, number in vocabulary.ids.items():
            if len(text) == 1:
                self.symbols[ord(text)] = number
        self.numbers = np.arange(self.size).astype(object)
        self.ranks = np.full(self.size + 1, NO_RANK, np.int32)  # the last is that of id -1
        self.ranks[[vocabulary.ids[t] for t in vocabulary.costs]] = np.unique(list(vocabulary.costs.values()), return_inverse=True)[1]
        pairs = [(a, b, vocabulary.ids[t]) for t in vocabulary.costs for k in range(1, len(t)) if (a := self.symbol(t[:k])) >= 0 and (b := self.symbol(t[k:])) >= 0]
        self.unions = Unions(np.array(pairs, np.int64).reshape(-1, 3))

    def symbol(self, text: str) -> int:
        return self.vocabulary.ids.get(text, self.size + ord(text) if len(text) == 1 else -1)

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments by increasing length. A row of cells holds a segment, between cells that join nothing."""
        n, inner = len(segments), len(segments[-1])
        width, lengths = inner + 2, np.fromiter(map(len, segments), np.int64, n)
        points = np.frombuffer("".join([s.ljust(inner) for s in segments]).encode("utf-32-le"), np.uint32).reshape(n, inner)
        cells = np.full((n, width), self.edge)
        cells[:, 1:-1] = np.where(np.arange(inner) < lengths[:, None], self.symbols[points], self.edge)
        made = np.full((n, width), -1)
        made[:, :-1] = self.unions.find(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(n, -1)
        agendas = self.ranks[made]  # of the pair that begins in a cell
        symbols, made, ranks = cells.reshape(-1), made.reshape(-1), agendas.reshape(-1)
        before, after = np.arange(-1, n * width - 1), np.arange(1, n * width + 1)
        rows = np.arange(n)
        while True:
            left = agendas[rows].argmin(1) + rows * width  # the best, leftmost among equals
            live = ranks[left] < NO_RANK
            if not live.all():
                rows, left = rows[live], left[live]
                if not len(rows):
                    break
            own, right, near = made[left], after[left], before[left]
            far = after[right]
            symbols[left], symbols[right], ranks[right] = own, self.edge, NO_RANK
            after[left], before[far] = far, left
            pairs = np.concatenate((near, left))
            found = self.unions.find(np.concatenate((symbols[near], own)), np.concatenate((own, symbols[far])))
            made[pairs], ranks[pairs] = found, self.ranks[found]
        kept = cells != self.edge
        ends, flat = np.cumsum(kept.sum(1)).tolist(), cells[kept]
        strange = flat >= self.size
        numbers = self.numbers[np.where(strange, 0, flat)].tolist()
        if strange.any():
            spelled = {k: self.vocabulary.spelled(chr(flat[k] - self.size)) for k in np.flatnonzero(strange).tolist()}
            return [[x for k in range(a, b) for x in spelled.get(k) or (numbers[k],)] for a, b in zip([0, *ends], ends)]
        return [numbers[a:b] for a, b in zip([0, *ends], ends)]


IDS, DIGITS = itemgetter(0), itemgetter(1)
Known = tuple[tuple[int, ...], str] | None  # ids and their digits joined by commas; None where the agenda differs


def weight(segment: str, known: Known) -> int:
    """Bytes of a remembered segment, reckoned high: up to four for a character, a pointer for an id (the numbers themselves
    belong to the vocabulary), and the objects and their place in the dictionary."""
    return 300 + 4 * len(segment) + (8 * len(known[0]) + len(known[1]) if known else 0)


class Codec:
    """The agenda with a memory of segments, and the library beside it."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.memory: dict[str, Known] = {}
        self.older: dict[str, Known] = {}
        self.held = 0  # bytes of self.memory
        self.line = self.library.encode("\n")
        self.digits = list(map(str, range(self.vocabulary.size))).__getitem__

    def work_out(self, segments: list[str]) -> Iterator[tuple[str, Known]]:
        """Ids of segments, each compared with the library."""
        asked = [s[1:].replace(MARK, " ") if s[0] == MARK else "\n" + s for s in segments]
        for s, own, theirs in zip(segments, self.vocabulary.encode_all(segments), self.library.encode(asked, num_threads=1) if segments else (), strict=True):
            if s == MARK:  # the library sees an empty text, which has no ids
                theirs = own
            elif s[0] != MARK:
                theirs = theirs[len(self.line) :]
            yield s, (tuple(own), ",".join(map(self.digits, own))) if own == theirs else None

    def learn(self, segments: set[str]) -> dict[str, Known]:
        """Takes new segments into the memory; those too long for it are returned."""
        memory, older = self.memory, self.older
        new, long = [], []
        for s in segments.difference(memory):
            if len(s) > LONG:
                long.append(s)
            elif s in older:
                memory[s] = older[s]
                self.held += weight(s, older[s])
            else:
                new.append(s)
        for s, known in self.work_out(new):
            memory[s] = known
            self.held += weight(s, known)
        return dict(self.work_out(long))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        """For each text its ids, their decimal digits joined by commas, and whether the agenda differed."""
        cut = [self.vocabulary.segment(t) for t in texts]
        long = self.learn(set().union(*cut))
        known = self.memory.get
        out = []
        for text, segments in zip(texts, cut, strict=True):
            found = list(map(known, segments))
            if None in found:
                found = [x or long.get(s) for x, s in zip(found, segments, strict=True)]
            if None in found:
                ids = self.library.encode(text)
                out.append((ids, ",".join(map(str, ids)), True))
            else:
                out.append((list(chain.from_iterable(map(IDS, found))), ",".join(map(DIGITS, found)), False))
        if self.held > MEMORY:  # what is used again moves on, the rest is forgotten
            self.memory, self.older, self.held = {}, self.memory, 0
        return out

    def rest(self) -> None:
        """Forgets all segments if they are more than CARRIED."""
        if self.older or self.held > CARRIED:
            self.memory, self.older, self.held = {}, {}, 0


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model in a worker, so that its memory serves all tasks there."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHARS_AT_ONCE:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encoded(batches: Iterator[pa.RecordBatch], model: bytes, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = codec(model)
    try:
        for batch in batches:
            at = 0
            for chunk in _chunks(_texts(batch.column(text))):
                done = own.encode(chunk)
                ids = [x[0] for x in done]
                part = batch.slice(at, len(chunk))
                at += len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array([int(x[2]) for x in done], pa.int32()), pa.array(own.library.decode(ids), pa.string())],
                    names=[*part.schema.names, *names],
                )
    finally:
        own.rest()


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int>, n_tokens long, n_differing int and decoded string."""
    ready(docs.sparkSession)
    names = fresh(docs, "ids", "n_tokens", "n_differing", "decoded")

    kinds = ["array<int>", "bigint", "int", "string"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]
    return docs.mapInArrow(lambda batches: encoded(batches, model, text, names), ", ".join(fields))


def op7_sentencepiece(docs: DataFrame, model: bytes) -> DataFrame:
    """The digests of the contract; ids and texts stay in the batch."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            counts, tokens, decoded, differing = [], [], [], []
            for chunk in _chunks(_texts(batch.column("text"))):
                done = own.encode(chunk)
                counts += [len(x[0]) for x in done]
                tokens += [hashlib.sha256(x[1].encode()).hexdigest() for x in done]
                decoded += [hashlib.sha256(t.encode()).hexdigest() for t in own.library.decode([x[0] for x in done])]
                differing += [int(x[2]) for x in done]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(tokens), pa.array(decoded), pa.array(differing, pa.int32())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differing"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing int")
