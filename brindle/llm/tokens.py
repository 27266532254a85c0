"""Token ids of whole texts, by a bounded table of the ids of recurring chunks.

A chunk starts where spaces or newlines follow something else, and at an ASCII sign behind an ASCII or Latin-1 letter. The
tokenizer families that are used here start a new piece at such places in every text that has no other white space, so the
ids of a text are those of its chunks in order. A text with other white space (tabs, no-break spaces, control characters) or
with the beginning of a special token's string is one chunk as a whole.

Chunks are found, looked up and their ids put together for a slice of texts at a time, in numpy: a chunk of up to 23 bytes
and its length are three 64-bit numbers, compared exactly, so no chunk is known by a hash alone. Only chunks that aren't in
the table are encoded, each once, by the tokenizer's own library or by Merges, which does its merges for many words at a time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of a slice, slots of the table (a power of two), entries and ids from which it starts anew. They bound a worker's memory only.
SLICE, SLOTS, MOST_ENTRIES, MOST_IDS = 1 << 20, 1 << 21, 1_200_000, 1 << 23
#: Bytes of a chunk that the table holds.
HELD = 23
#: Encode chunks (bytes, starts, sizes; HELD + 1 bytes follow the last): their ids in order, and the number of each.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Fixed value: what special tokens' strings begin with in the files that are used here.
SPECIAL = b"<|"

_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: White space other than space and newline: 1 a byte that is such, 2 a byte that may lead such a character.
_ODD = np.zeros(256, dtype=np.uint8)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = 1
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_LETTER, _SIGN, _SECOND = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: The second byte of a Latin-1 letter, whose first is C3.
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def said(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [codes[s : s + k].tobytes() for s, k in zip(starts.tolist(), sizes.tolist())]


def _odd_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Places among the first n bytes of white space other than space and newline. Two more bytes must follow."""
    at = np.flatnonzero(_ODD[codes[:n]])
    if not len(at):
        return at
    a, b, c = codes[at], codes[at + 1], codes[at + 2]
    hit = _ODD[a] == 1
    hit |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[hit]


def _whole_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Places for whose sake a text is encoded as a whole."""
    special = np.flatnonzero((codes[: n - 1] == SPECIAL[0]) & (codes[1:n] == SPECIAL[1])) if n else np.empty(0, dtype=np.int64)
    return np.concatenate([_odd_places(codes, n), special])


def _hashed(lanes: np.ndarray) -> np.ndarray:
    h = lanes[:, 0] * _C1
    h ^= h >> np.uint64(29)
    h = (h + lanes[:, 1]) * _C2
    h ^= h >> np.uint64(32)
    h = (h ^ lanes[:, 2]) * _C3
    return h ^ (h >> np.uint64(30))


class ChunkTable:
    """Ids of whole texts by the ids of their chunks."""

    def __init__(self, encode: Encode, slots: int = SLOTS):
        self.encode, self.slots = encode, slots
        self.start_anew()

    def start_anew(self) -> None:
        # three lanes and, if taken, first << 24 | count of the ids
        self.table = np.zeros((self.slots, 4), dtype=np.uint64)
        self.arena, self.filled, self.entries = np.zeros(1 << 16, dtype=np.uint32), 1, 0

    def _store(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Put ids into the arena; the values that say where."""
        while self.filled + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), dtype=np.uint32)])
        first = self.filled + np.cumsum(counts) - counts
        self.arena[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        return (first.astype(np.uint64) << np.uint64(24)) | counts.astype(np.uint64)

    def _look_up(self, lanes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Values of the chunks, 0 where there is none."""
        out = np.zeros(len(lanes), dtype=np.uint64)
        mask, left, slot = np.uint64(self.slots - 1), None, hashes & np.uint64(self.slots - 1)
        while True:
            rows = self.table[slot]
            own = lanes if left is None else lanes[left]
            same = (rows[:, 0] == own[:, 0]) & (rows[:, 1] == own[:, 1]) & (rows[:, 2] == own[:, 2])
            value = np.where(same, rows[:, 3], np.uint64(0))
            if left is None:
                out = value
            else:
                out[left] = value
            on = np.flatnonzero(~same & (rows[:, 3] != 0))
            if not len(on):
                return out
            left, slot = on if left is None else left[on], (slot[on] + np.uint64(1)) & mask

    def _insert(self, lanes: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> None:
        mask, slot = np.uint64(self.slots - 1), hashes & np.uint64(self.slots - 1)
        left = np.arange(len(lanes))
        while len(left):
            free = np.flatnonzero(self.table[slot, 3] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.table[slot[won], :3], self.table[slot[won], 3] = lanes[left[won]], values[left[won]]
            on = np.ones(len(left), dtype=bool)
            on[won] = False
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        self.entries += len(lanes)

    def _slice(self, codes: np.ndarray, n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end) of the texts that end at ends in the first n bytes; 24 bytes must follow."""
        if self.entries > MOST_ENTRIES * self.slots // SLOTS or self.filled > MOST_IDS:
            self.start_anew()
        white = (codes[:n] == 32) | (codes[:n] == 10)
        first = white.copy()
        first[1:] &= ~white[:-1]
        sign = np.flatnonzero(_SIGN[codes[1:n]]) + 1
        before = codes[sign - 1]
        first[sign[_LETTER[before] | (_SECOND[before] & (sign > 1) & (codes[sign - 2] == 0xC3))]] = True
        begins = np.concatenate([[0], ends[:-1]])
        first[begins[begins < ends]] = True
        if len(odd := _whole_places(codes, n)):
            # the texts that hold such are one chunk each
            for t in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
                first[begins[t] + 1 : ends[t]] = False
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=n)
        eight = np.ndarray((len(codes) - 7,), dtype="<u8", buffer=codes.data, strides=(1,))
        lanes = np.zeros((len(starts), 3), dtype=np.uint64)
        lanes[:, 0] = eight[starts] & _FIRST[np.minimum(sizes, 8)]
        for lane, more in ((1, np.flatnonzero(sizes > 8)), (2, np.flatnonzero(sizes > 16))):
            lanes[more, lane] = eight[starts[more] + 8 * lane] & _FIRST[np.clip(sizes[more] - 8 * lane, 0, 8)]
        short = sizes <= HELD
        lanes[:, 2] |= np.where(short, sizes, 0).astype(np.uint64) << np.uint64(56)
        hashes = _hashed(lanes)
        values = self._look_up(lanes, hashes)
        values[~short] = 0
        miss = np.flatnonzero((values == 0) & short)
        while len(miss):
            _, one, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            new = miss[one]
            made = self._store(*self.encode(codes, starts[new], sizes[new]))
            self._insert(lanes[new], hashes[new], made)
            same = (lanes[miss] == lanes[new][back]).all(axis=1)
            values[miss[same]] = made[back[same]]
            miss = miss[~same]  # another chunk of the same hash
        if len(long := np.flatnonzero(~short)):
            values[long] = self._store(*self.encode(codes, starts[long], sizes[long]))
        counts = (values & np.uint64((1 << 24) - 1)).astype(np.int64)
        upto = np.cumsum(counts)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.arena[np.repeat((values >> np.uint64(24)).astype(np.int64) - (upto - counts), counts) + np.arange(total)]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, ends)]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit integers; a null text has none."""
        if texts.type != pa.large_string():
            texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, dtype=np.int64)
        held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            size = int(ends[to] - ends[at])
            codes = np.zeros(size + 24, dtype=np.uint8)
            codes[:size] = held[ends[at] : ends[to]]
            if size > SLICE and not len(_whole_places(codes, size)):
                yield np.concatenate(list(self._parts(codes, size)))
            else:
                found, upto = self._slice(codes, size, ends[at + 1 : to + 1] - ends[at])
                for a, b in zip([0, *upto[:-1].tolist()], upto.tolist()):
                    yield found[a:b]
            at = to

    def _parts(self, codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """The ids of one very long text, cut where a chunk starts."""
        at = 0
        while at < size:
            to = at + SLICE
            while to < size and not (codes[to] in (32, 10) and codes[to - 1] not in (32, 10)):
                to += 1
            to = min(to, size)
            part = np.zeros(to - at + 24, dtype=np.uint8)
            part[: to - at] = codes[at:to]
            yield self._slice(part, to - at, np.array([to - at]))[0]
            at = to


#: Byte-level BPE files write byte b as a printable character; these stand for themselves, and the others
#: are counted up from 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}

NO_MERGE = np.int32(2**31 - 1)


class Merges:
    """The merges of a byte-level BPE file, done for many pieces at a time: each round merges in every piece that still has
    one its leftmost pair of the lowest rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        name = [chr(BYTE_NAMES[b]) for b in range(256)]
        self.first = np.array([vocabulary[x] for x in name], dtype=np.int32)
        self.last = np.array([vocabulary[x + suffix] for x in name], dtype=np.int32)
        parts = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left, right = (np.array([vocabulary[p[i]] for p in parts], dtype=np.uint64) for i in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in parts], dtype=np.int32)
        # an open-addressing table from pair to rank; no token has the number 2^31 - 1
        self.keys, self.ranks = np.full(1 << 18, np.uint64(2**64 - 1)), np.full(1 << 18, NO_MERGE)
        pairs, rank = (left << np.uint64(32)) | right, np.arange(len(parts), dtype=np.int32)
        slot = self._slot(pairs)
        while len(pairs):
            free = np.flatnonzero(self.ranks[slot] == NO_MERGE)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.ranks[slot[won]] = pairs[won], rank[won]
            on = np.ones(len(pairs), dtype=bool)
            on[won] = False
            pairs, rank, slot = pairs[on], rank[on], (slot[on] + 1) & (len(self.keys) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _C1) >> np.uint64(64 - 18)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair; negative symbols, which stand for none, have no merge."""
        pairs = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot, shape = self._slot(pairs).ravel(), pairs.shape
        pairs = pairs.ravel()
        found = self.keys[slot]
        out = np.where(found == pairs, self.ranks[slot], NO_MERGE)
        on = np.flatnonzero((found != pairs) & (self.ranks[slot] != NO_MERGE))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[on]]
            hit = found == pairs[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (self.ranks[slot[on]] != NO_MERGE)]
        return out.reshape(shape)

    def encode(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a row of ids for each piece, -1 behind its last; their number). codes: a row of bytes for each; none is empty."""
        out, n = np.full(codes.shape, -1, dtype=np.int32), sizes.copy()
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 18), (18, codes.shape[1])):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(own):
                continue
            cols, had = np.arange(min(high, codes.shape[1])), codes[own, :high]
            last = sizes[own][:, None] - 1
            symbols = np.where(cols < last, self.first[had], np.where(cols == last, self.last[had], np.int32(-1)))
            out[own, : symbols.shape[1]], n[own] = self._merged(symbols, sizes[own])
        return out, n

    def _merged(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, counts = symbols.copy(), n.copy()
        if symbols.shape[1] < 2:
            return out, counts
        own, ranks = np.arange(len(symbols)), self.rank(symbols[:, :-1], symbols[:, 1:])
        none, cols = np.full((len(symbols), 1), -1, dtype=np.int32), np.arange(symbols.shape[1])
        while True:
            at = ranks.argmin(axis=1)
            row = np.arange(len(ranks))
            best = ranks[row, at]
            on = best != NO_MERGE
            if not on.all():
                out[own[~on]], counts[own[~on]] = symbols[~on], n[~on]
                symbols, ranks, own, n, at, best, row = symbols[on], ranks[on], own[on], n[on], at[on], best[on], row[: int(on.sum())]
                if not len(own):
                    return out, counts
            behind = cols > at[:, None]
            symbols = np.where(behind, np.concatenate([symbols[:, 1:], none[: len(own)]], axis=1), symbols)
            symbols[row, at] = self.made[best]
            n = n - 1
            ranks = np.where(behind[:, 1:], np.concatenate([ranks[:, 1:], np.full((len(own), 1), NO_MERGE)], axis=1), ranks)
            # the merged symbol with the one before and the one behind it
            here = symbols[row, at]
            next_ = np.where(at + 1 < symbols.shape[1], symbols[row, np.minimum(at + 1, symbols.shape[1] - 1)], -1)
            inner = at < ranks.shape[1]
            ranks[row[inner], at[inner]] = self.rank(here, next_)[inner]
            led = np.flatnonzero(at > 0)
            ranks[led, at[led] - 1] = self.rank(symbols[led, at[led] - 1], here[led])


def words(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which chunks are one word of ASCII and Latin-1 letters, a row of bytes for each of these pieces, their sizes).

    Such a word needs no pattern. Without lower a space may lead it, which is part of the piece; with lower spaces and
    newlines may lead it, which go, and it is written in small letters."""
    short = np.flatnonzero(sizes <= HELD)
    cols = np.arange(HELD + 1)
    rows = np.where(cols < sizes[short][:, None], codes[starts[short][:, None] + cols], 0).astype(np.uint8)
    if lower:
        white = (rows == 32) | (rows == 10)
        skip = np.where(white.all(axis=1), 0, (~white).argmax(axis=1))
        led = np.flatnonzero(skip)
        rows[led] = np.take_along_axis(rows[led], np.minimum(cols + skip[led][:, None], HELD), axis=1)  # a short row ends with 0
        n = sizes[short] - skip
    else:
        n = sizes[short]
    behind_c3 = np.zeros_like(rows, dtype=bool)
    behind_c3[:, 1:] = (rows[:, :-1] == 0xC3) & _SECOND[rows[:, 1:]]
    letter = _LETTER[rows] | behind_c3
    letter[:, :-1] |= behind_c3[:, 1:]
    fine = letter | (cols >= n[:, None])
    if not lower:
        fine[:, 0] |= (rows[:, 0] == 32) & (n > 1)
    own = np.flatnonzero(fine.all(axis=1))
    rows, n = rows[own], n[own]
    if lower:
        # Latin-1 letters differ from their small ones in the same bit; the sharp s and the small ones don't change
        second = behind_c3[own]
        rows = rows + (((rows >= 65) & (rows <= 90)) | (second & (rows < 0x9F))).astype(np.uint8) * np.uint8(32)
    return short[own], rows, n


@cache
def library_table(vocabulary: str) -> ChunkTable:
    """Of a tokenizers library file, once in each worker: ids as encode(text, add_special_tokens=False) gives them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, normalizer = spec["model"], spec["normalizer"]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
    kinds = [x["type"] for x in (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])]
    # words may go past the library only under the two layouts whose pieces are known
    plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "ignore_merges", "byte_fallback"))
    lower = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"]
    as_is = not kinds and [x["type"] for x in steps] == ["ByteLevel"] and not steps[0]["add_prefix_space"] and steps[0].get("use_regex", True)
    merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "") if plain_model and (lower or as_is) else None

    def encode(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, rest = np.zeros(len(starts), dtype=np.int64), np.ones(len(starts), dtype=bool)
        if merges:
            own, pieces, n = words(codes, starts, sizes, lower)
            rows, counts[own] = merges.encode(pieces, n)
            rest[own] = False
        at = np.flatnonzero(rest)
        ids = [x.ids for x in found.encode_batch([c.decode("utf-8", "replace") for c in said(codes, starts[at], sizes[at])], add_special_tokens=False)]
        counts[at] = [len(x) for x in ids]
        begins, flat = np.cumsum(counts) - counts, np.empty(int(counts.sum()), dtype=np.uint32)
        if merges:
            inside = rows >= 0
            flat[(begins[own][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        for i, x in zip(at.tolist(), ids):
            flat[begins[i] : begins[i] + len(x)] = x
        return flat, counts

    return ChunkTable(encode)


def forget() -> None:
    """Free this worker's tables."""
    library_table.cache_clear()
