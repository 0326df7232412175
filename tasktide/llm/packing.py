"""Best-fit packing of tokenized documents by sums of squares.

Each document becomes token ids and a final separator id; only documents longer than a sequence are cut. The pieces are
dealt by a hash into shards of about `shard` pieces, since a packing depends on lengths alone; the waste of a shard is
a few open sequences, whatever the size of the corpus. In a shard the longest piece is placed first, each where the sum
of the squared numbers of open sequences per residual gap becomes smallest: into an open sequence with room, or a new
one. Ties go to the smaller gap.

The tokenizer drops white space and never joins what stands on both sides of it; it takes runs of letters, single
digits and runs of other signs one by one, in lower case. So a text's ids are those of these units in order; a part
between white space that holds an apostrophe, "<" or characters beyond Latin-1 letters is one unit. A unit is encoded when
a Python worker first sees it and looked up afterwards, by its hash and then its bytes, in a table that keeps all it has
seen and is emptied when that is more than `parts` units.

Defined results: null and empty texts are one separator; repeated rows are packed as often as they occur; a null doc_id
stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import Workspace
from .words import LOWER, NOT_SPACE, Texts, mix, slices

#: Not to be cut at: white space that a tokenizer might see otherwise.
_PART = NOT_SPACE.copy()
_PART[[11, 12]] = True

#: Kinds of bytes: 0 white space, 1 letters, of ASCII or of two bytes with the lead C3, 2 digits, 3 other visible ASCII, 4
#: all else. An apostrophe can begin a suffix and "<" a special token, so parts with these aren't cut further.
_KIND = np.full(256, 4, np.uint8)
_KIND[~_PART] = 0
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 4
_KINDS, _LOWER = _KIND.tobytes(), LOWER.tobytes()

#: The first i bytes of a little-endian number of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SIZE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Units:
    """What the tokenizer looks at one by one: low[start:start + size]. head and more are the first and second eight bytes
    as numbers, filled up with zeros; not plain are parts that stay whole."""

    low: np.ndarray
    start: np.ndarray
    size: np.ndarray
    head: np.ndarray
    more: np.ndarray
    hash: np.ndarray
    plain: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Units:
        """Runs of letters, digits, runs of other signs, in lower case; parts with other characters stay whole."""
        data, n = texts.data, len(texts.data)
        raw = data.tobytes()
        kind = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8)
        low = np.zeros(n + 16, np.uint8)
        low[:n] = np.frombuffer(raw.translate(_LOWER), np.uint8)
        cut = texts.offsets[texts.offsets < n]
        odd = kind == 4
        trail = (data >= 0x80) & (data < 0xC0)
        if trail.any():
            lead = data == 0xC3
            after = np.append(False, lead[:-1])
            after[cut] = False
            after &= trail
            odd |= trail & ~after | (data == 0x97) | (data == 0xB7) | lead & ~np.append(after[1:], False)  # C3 may be cut off
            low[:n][after & (data <= 0x9E)] += 32
        if odd.any():
            s, e = texts.spans(_PART)
            whole = np.logical_or.reduceat(odd, s)
            change = np.zeros(n + 1, np.int8)
            change[s[whole]] += 1
            change[e[whole]] -= 1
            inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
            kind[inside] = 4
            low[:n][inside] = data[inside]
        edge = kind == 2
        edge[1:] |= kind[1:] != kind[:-1]
        edge[cut] = True
        start = np.flatnonzero(edge)
        kinds = kind[start]
        size, used = np.diff(start, append=n), kinds != 0
        return cls._keyed(low, start[used], size[used], kinds[used] != 4)

    @classmethod
    def _keyed(cls, low: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> Units:
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        head, more = eight[start] & _FIRST[np.minimum(size, 8)], np.zeros(len(start), np.uint64)
        code = mix(head + size.astype(np.uint64) * _SIZE)
        longer = np.flatnonzero(size > 8)
        if len(longer):
            more[longer] = eight[start[longer] + 8] & _FIRST[np.minimum(size[longer] - 8, 8)]
            code[longer] = mix(code[longer] ^ more[longer])
        units = cls(low, start, size, head, more, code, plain)
        longest = np.flatnonzero(size > 16)
        if len(longest):
            body, first = units.bytes(longest)
            code[longest] = words.byte_runs(body, first[:-1], first[1:])
        return units

    def bytes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some units, one behind the other, and where each's begin and the last's end."""
        size = self.size[at]
        first = np.append(0, np.cumsum(size))
        return self.low[np.repeat(self.start[at] - first[:-1], size) + np.arange(first[-1])], first

    def take(self, at: np.ndarray) -> Units:
        return Units(self.low, *(x[at] for x in (self.start, self.size, self.head, self.more, self.hash, self.plain)))


class PartTokenizer:
    """Token ids of many texts, through a table of parts already seen. A part has an entry, which has its hash, its bytes and
    its ids; the entry's number is in the first slot that was free when it came, from the one on that its hash names."""

    #: Most bytes, of parts of more than 16, that are remembered.
    BYTES = 1 << 26

    def __init__(self, path: str, parts: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's; threads would also keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), parts
        self.slots = 2 << parts.bit_length()
        self._empty()

    def _empty(self) -> None:
        """Entry i has ids[start[i]:start[i + 1]] and, of more than 16 bytes, bytes[byte[i]:byte[i + 1]]."""
        self.n, self.placed, self.slot = 0, 0, np.full(self.slots, -1, np.int32)
        self.hash, self.head, self.more = (np.zeros(1 << 14, np.uint64) for _ in range(3))
        self.size, self.start, self.byte = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.ids, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array, which grows where it has to."""
        held, end = getattr(self, name), at + len(values)
        if end > len(held):
            held = np.concatenate([held[:at], np.zeros(max(end, 2 * len(held)) - at, held.dtype)])
            setattr(self, name, held)
        held[at:end] = values

    def _ids(self, parts: Units) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the parts, in pieces, and how many each part has; plain parts come first. Of these each is one word of the
        tokenizer, so many are encoded as one text and told apart by their word numbers."""
        body, first = parts.bytes(np.arange(len(parts.size)))
        body, first = body.tobytes(), first.tolist()
        raw = [body[a:b] for a, b in zip(first, first[1:], strict=False)]
        plain, ids, sizes = int(parts.plain.sum()), [], []
        for k in range(0, plain, 4096):
            groups = [raw[j : min(j + 256, plain)] for j in range(k, min(k + 4096, plain), 256)]
            texts = [b" ".join(group).decode("utf-8", "replace") for group in groups]
            for group, x in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                sizes.append(np.bincount(np.array(x.word_ids, np.int64), minlength=len(group)))
                ids.append(np.array(x.ids, np.uint32))
        for x in self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in raw[plain:]], add_special_tokens=False):
            sizes.append(np.array([len(x.ids)]))
            ids.append(np.array(x.ids, np.uint32))
        return ids, sizes

    def _learn(self, parts: Units) -> None:
        """New entries n, n + 1, ... for the parts, plain ones first."""
        n, count, n_ids, n_bytes = self.n, len(parts.size), int(self.start[self.n]), int(self.byte[self.n])
        ids, sizes = self._ids(parts)
        for name in ("hash", "head", "more", "size"):
            self._put(name, n, getattr(parts, name))
        self._put("ids", n_ids, np.concatenate(ids))
        self._put("start", n + 1, n_ids + np.cumsum(np.concatenate(sizes)))
        self._put("bytes", n_bytes, parts.bytes(np.flatnonzero(parts.size > 16))[0])
        self._put("byte", n + 1, n_bytes + np.cumsum(np.where(parts.size > 16, parts.size, 0)))
        self.n = n + count

    def _place(self, first: int) -> None:
        """Slots for the entries from the first on, while at least half of the slots stay free."""
        todo = np.arange(first, min(self.n, first + len(self.slot) // 2 - self.placed), dtype=np.int32)
        self.placed += len(todo)
        at = self._first_slot(self.hash[todo])
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slot) - 1)

    def _first_slot(self, code: np.ndarray) -> np.ndarray:
        return (code & np.uint64(len(self.slot) - 1)).astype(np.int64)

    def _find(self, code: np.ndarray) -> np.ndarray:
        """Entries of the hashes; -1: none."""
        at = self._first_slot(code)
        where = self.slot[at].astype(np.int64)
        todo = np.flatnonzero((where >= 0) & (self.hash[where] != code))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            found = self.slot[at[todo]]
            where[todo] = found
            todo = todo[(found >= 0) & (self.hash[found] != code[todo])]
        return where

    def _others(self, parts: Units, where: np.ndarray) -> np.ndarray:
        """Numbers of the parts whose bytes aren't those of their entries."""
        other = (self.head[where] != parts.head) | (self.size[where] != parts.size) | (self.more[where] != parts.more)
        same = np.flatnonzero(~other & (parts.size > 16))
        if len(same):
            body, first = parts.bytes(same)
            place = np.arange(len(body)) + np.repeat(self.byte[where[same]] - first[:-1], parts.size[same])
            other[same] = np.logical_or.reduceat(body != self.bytes[place], first[:-1])
        return np.flatnonzero(other)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each row's begin and the last ends."""
        parts = Units.of(texts)
        if not len(parts.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts.valid) + 1, np.int64)
        if self.n > self.parts or self.byte[self.n] > self.BYTES:
            self._empty()
        where = self._find(parts.hash)
        miss = np.flatnonzero(where < 0)
        if len(miss):
            n = self.n
            _, first, index = np.unique(parts.hash[miss], return_index=True, return_inverse=True)
            order = np.argsort(~parts.plain[miss[first]], kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            self._learn(parts.take(miss[first[order]]))
            self._place(n)
            where[miss] = n + number[index]
        for i in self._others(parts, where).tolist():  # parts of equal hashes
            where[i] = self.n
            self._learn(parts.take(np.array([i])))
        start = self.start[where]
        size = self.start[where + 1] - start
        end = np.cumsum(size)
        ids = self.ids[np.arange(end[-1]) + np.repeat(start - (end - size), size)]
        return ids, np.append(0, end)[np.searchsorted(parts.start, texts.offsets)]


@cache
def _tokenizer(path: str, parts: int) -> PartTokenizer:
    """One for all tasks of a Python worker."""
    return PartTokenizer(path, parts)


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    open_, held = np.zeros(size + 1, np.int64), {}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        # A gap of g with open_[g] sequences becomes one of g - n; a gap of 0 is closed and not counted.
        cost = 2 * (open_[: size + 1 - n] - open_[n:]) + 2
        cost[0] = 1 - 2 * open_[n]
        cost = np.where(open_[n:] > 0, cost, np.iinfo(np.int64).max)
        cost[-1] = 2 * open_[size - n] + 1 if n < size else 0
        gap = n + int(cost.argmin())
        if gap == size:
            at, made = made, made + 1
        else:
            at = held[gap].pop()
            open_[gap] -= 1
        sequence[i], offset[i] = at, size - gap
        if gap > n:
            held.setdefault(gap - n, []).append(at)
            open_[gap - n] += 1
    return sequence, offset


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Packing:
    """size: tokens of a sequence. tokenizer: path of the tokenizer's file. separator: id behind each document. shard:
    pieces packed together. parts: most text parts that a worker remembers."""

    size: int = 4096
    tokenizer: str = field(default_factory=_vocabulary)
    separator: int = 1
    shard: int = 32_768
    parts: int = 400_000

    def pieces(self, docs: DataFrame) -> DataFrame:
        """doc_id, piece, start, length, ids_crc32 of each piece."""
        path, parts, size, end_id = self.tokenizer, self.parts, self.size, self.separator

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = _tokenizer(path, parts)
            for batch in batches:
                for begin, end, texts in slices(batch.column(1)):
                    ids, at = tokenizer.encode(texts)
                    n = np.diff(at) + 1
                    stop = np.cumsum(n)
                    all_ids = np.full(stop[-1], end_id, "<u4")
                    body = np.ones(stop[-1], bool)
                    body[stop - 1] = False
                    all_ids[body] = ids
                    count = -(-n // size)
                    row = np.repeat(np.arange(end - begin), count)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    start = piece * size
                    length = np.minimum(n[row] - start, size)
                    base = (stop - n)[row] + start
                    crc = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(base.tolist(), (base + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin).take(pa.array(row)), *(pa.array(np.asarray(x, np.int64)) for x in (piece, start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")

    def sequences(self, docs: DataFrame) -> DataFrame:
        """The pieces with sequence_id and offset."""
        work, size = Workspace(docs.sparkSession, "packing"), self.size
        pieces = work.keep(self.pieces(docs), "pieces")
        shards = max(1, -(-pieces.count() // self.shard))
        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
            sequence, offset = pack(pdf["length"].to_numpy(), size)
            return pdf.drop(columns="shard").assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

        return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
