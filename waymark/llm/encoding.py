"""Byte-pair encoding of whole tables with the tokenizers library, each distinct piece of text once per worker.

A text is cut where the encoding cannot reach across: before a single space or a line end between two
characters that are no white space, after that line end, and before a mark like a comma that follows an ASCII
letter. The pattern that splits texts before the merges has a border at each of these places whatever stands
around, so the ids of a text are the ids of its pieces one after the other. Pieces are hashed in numpy, new
ones are encoded by the library, and the ids of all others come from a table that the worker keeps between
batches (bounded: it starts anew when full). Texts with the string of a special token go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import texts

VOCABULARY = "byte_bpe_50k.json"
#: Ids are below 50257, so two bytes hold one.
ID = np.uint16
_LINE = 198  # the id of a line end, which no other piece contains
_SPECIAL = b"<|endoftext|>"
#: Most pieces and ids that a worker remembers.
_MOST_PIECES, _MOST_IDS = 3 << 20, 12 << 20

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that surely end a character that is no white space: ASCII that is not blank. See _solid for the others.
_plain = re.compile(r" ?\S+").fullmatch
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_mark = np.zeros(256, bool)
_mark[[33, 44, 46, 58, 59, 63]] = True  # ! , . : ; ?


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin, each document's start among them."""
    n = len(buf)
    # Two-byte characters from U+00C0 on are no white space; other characters beyond ASCII are taken as if they were.
    lead = (buf >= 0xC3) & (buf <= 0xDF)
    solid = (buf < 128) & ~_blank[buf]
    ends_solid = solid.copy()
    ends_solid[1:] |= lead[:-1] & (buf[1:] >= 0x80)
    begins_solid = solid | lead
    cut = np.zeros(n + 1, bool)
    if n > 2:
        gap = ((buf[1:-1] == 32) | (buf[1:-1] == 10)) & ends_solid[:-2] & begins_solid[2:]
        cut[1 : n - 1] = gap
        cut[2:n] |= gap & (buf[1:-1] == 10)
        cut[1 : n - 1] |= _mark[buf[1:-1]] & _letter[buf[:-2]]
    # What stands on either side of a document's end says nothing: such cuts are cuts anyway or must go.
    inner = off[1:-1]
    near = np.concatenate([inner - 1, inner, inner + 1])
    near = near[(near > 0) & (near < n)]
    cut[near] = False
    cut[off] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Table:
    """Pieces seen so far: an open-addressed hash table over numpy arrays, with each piece's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, ID)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 for unknown ones."""
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        slot = (key >> shift).astype(np.int64)
        seen = self.key[slot]
        out = np.where(seen == key, self.value[slot], -1)
        rest = np.flatnonzero((seen != key) & (seen != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            seen = self.key[slot[rest]]
            same = seen == key[rest]
            out[rest[same]] = self.value[slot[rest[same]]]
            rest = rest[~same & (seen != 0)]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while self.used + len(key) > (1 << self.bits) // 2:
            full = self.key != 0
            old, held = self.key[full], self.value[full]
            self.bits += 1
            self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.used = 0
            self._place(old, held)
        self._place(key, value)

    def _place(self, key: np.ndarray, value: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(key))
        while len(rest):
            free = rest[self.key[slot[rest]] == 0]
            self.key[slot[free]], self.value[slot[free]] = key[free], value[free]
            rest = rest[self.key[slot[rest]] != key[rest]]
            slot[rest] = (slot[rest] + 1) & mask
        self.used += len(key)

    def add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces: plain ones in one text, joined by line ends; those with other white space one by one."""
        plain = [_plain(p.decode()) is not None for p in pieces]
        joined = [k for k, is_plain in enumerate(plain) if is_plain]
        lone = [k for k, is_plain in enumerate(plain) if not is_plain]
        counts = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = []
        for lo in range(0, len(joined), 4096):
            own = joined[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode(b"\n".join(pieces[k] for k in own).decode(), add_special_tokens=False).ids, ID)
            line = ids == _LINE
            ends = np.concatenate([np.flatnonzero(line), [len(ids)]])
            assert len(ends) == len(own)
            counts[own] = np.diff(ends, prepend=-1) - 1
            parts.append(ids[~line])
        for k in lone:
            ids = np.array(self.tokenizer.encode(pieces[k].decode(), add_special_tokens=False).ids, ID)
            counts[k] = len(ids)
            parts.append(ids)
        order = np.array(joined + lone, np.int64)
        new = np.concatenate(parts)
        total = self.n + len(pieces)
        self.begin, self.count = _room(self.begin, total), _room(self.count, total)
        self.ids = _room(self.ids, self.used_ids + len(new))
        self.count[self.n : total] = counts[order]
        self.begin[self.n : total] = self.used_ids + np.cumsum(counts[order]) - counts[order]
        self.ids[self.used_ids : self.used_ids + len(new)] = new
        self.put(keys[order], np.arange(self.n, total, dtype=np.int32))
        self.n = total

    @property
    def used_ids(self) -> int:
        return int(self.begin[self.n - 1] + self.count[self.n - 1]) if self.n else 0

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a run, and the number of ids of each."""
        docs = len(off) - 1
        begin = cuts(buf, off)
        if not len(begin):
            return np.zeros(0, ID), np.zeros(docs, np.int64)
        end = np.append(begin[1:], len(buf))
        key = texts.hashes(buf, begin, end) | np.uint64(1)
        if self.n > _MOST_PIECES or self.used_ids > _MOST_IDS:
            self.clear()
        piece = self.find(key)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            at = missing[at]
            raw = buf.tobytes()
            self.add(new, [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())])
            piece[missing] = self.find(key[missing])
        count = self.count[piece].astype(np.int64)
        total = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[piece] - (total - count), count) + np.arange(total[-1])]
        edge = np.concatenate([[0], total])
        return ids, np.diff(edge[np.searchsorted(begin, off)])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


@lru_cache(maxsize=2)
def table(path: str) -> Table:
    """The worker's table; it lives as long as the worker."""
    return Table(path)


def encoded(column: pa.Array, path: str, end: int | None = None):
    """For runs of documents: first document, ids of the run, ids of each document; each with `end` appended."""
    buf, off = texts.buffer(column)
    t = table(path)
    for lo, hi in texts.slices(off):
        own = off[lo : hi + 1] - off[lo]
        part = buf[off[lo] : off[hi]]
        if _SPECIAL in part.tobytes():
            raw = part.tobytes()
            each = [np.array(t.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, ID) if _SPECIAL in raw[a:b] else t.encode(part[a:b], np.array([0, b - a]))[0] for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
            ids, count = np.concatenate([np.zeros(0, ID), *each]), np.array([len(x) for x in each], np.int64)
        else:
            ids, count = t.encode(part, own)
        if end is not None:
            ids = np.insert(ids, np.cumsum(count), end)
            count = count + 1
        yield lo, ids, count
