"""Two-stage suffix sorting in numpy, to a bounded depth, with the common prefixes of neighbours.

Stage one sorts only the suffixes that are smaller than their successors (type B), by their first DEPTH
symbols. Stage two induces the others (type A): the buckets of first symbols are scanned in ascending order,
and each suffix scanned puts the one that begins a symbol before it, if that is of type A, at the next free
place of its bucket. A bucket is scanned as a whole: what it induces is dealt to buckets by one stable sort,
and what it induces into itself (runs of one symbol) follows level by level.

Where only some suffixes are wanted, stage one takes those of type B among them, and those in which the wanted
ones of type A end up: a suffix of type A needs its successor's place, and no more than that.
"""

from __future__ import annotations

import numpy as np

DEPTH = 50
_PER = 7  # symbols of 9 bits in a word of 64


def words(sym: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each position its next 7 symbols in one integer whose order is theirs; zeros follow the end."""
    n = len(sym)
    padded = np.zeros(n + depth + 2 * _PER, np.uint64)
    padded[:n] = sym
    out = np.zeros(n + depth + _PER, np.uint64)
    for k in range(_PER):
        out |= padded[k : k + len(out)] << np.uint64(9 * (_PER - 1 - k))
    return out


def is_b(sym: np.ndarray) -> np.ndarray:
    """Suffixes smaller than their successors; equal first symbols ask the next suffix. The last one is of type A."""
    n = len(sym)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    less, at = sym[:-1] < sym[1:], np.flatnonzero(sym[:-1] != sym[1:])
    if len(at):
        nxt = np.searchsorted(at, np.arange(n - 1))
        inside = nxt < len(at)
        out[:-1][inside] = less[at[nxt[inside]]]
    return out


def direct(at: np.ndarray, word: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in the order of their first `depth` symbols: ties of one word are refined by the next."""
    at = at[np.argsort(word[at], kind="stable")]
    key = word[at]
    group = np.zeros(len(at), np.int64)
    if len(at):
        group[1:] = np.cumsum(key[1:] != key[:-1])
    for k in range(_PER, depth, _PER):
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        key = word[at[tied] + k]
        order = np.lexsort((key, group[tied]))
        at[tied], key = at[tied[order]], key[order]
        # Groups keep their numbers' order: a group's first number is its first place.
        new = np.ones(len(tied), bool)
        new[1:] = (group[tied[1:]] != group[tied[:-1]]) | (key[1:] != key[:-1])
        first = np.zeros(len(at), np.int64)
        first[:] = np.arange(len(at))
        start = tied[np.flatnonzero(new)]
        first[tied] = np.repeat(start, np.diff(np.append(np.flatnonzero(new), len(tied))))
        group = first
    return at


def closed(wanted: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The wanted positions, and after each one of type A those up to the next of type B."""
    n = len(wanted)
    at = np.flatnonzero(wanted & ~b)
    if not len(at):
        return wanted
    ends = np.append(np.flatnonzero(b), n - 1)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(ends[np.searchsorted(ends[:-1], at)] + 1, minlength=n + 1)
    return wanted | (np.cumsum(edge[:n]) > 0)


def order(sym: np.ndarray, word: np.ndarray, depth: int = DEPTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes (all, or the wanted ones and those that they need) in the order of their first `depth` symbols.
    Symbols are below 512."""
    n = len(sym)
    small = sym.astype(np.uint16)
    b = is_b(sym)
    need = np.ones(n, bool) if wanted is None else closed(wanted, b)
    sorted_b = direct(np.flatnonzero(b & need), word, depth)
    edges_b = np.searchsorted(sym[sorted_b], np.arange(int(sym.max(initial=0)) + 2)) if n else [0, 0]
    pending: list[list[np.ndarray]] = [[] for _ in range(int(sym.max(initial=0)) + 1)]
    if n and need[n - 1]:
        pending[sym[n - 1]].append(np.array([n - 1]))  # before the end there is nothing to scan
    out = []
    for c in range(len(pending)):
        level = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        bucket = [level]
        while len(level):
            level = level[level > 0] - 1
            level = level[(small[level] == c) & need[level]]
            bucket.append(level)
        bucket.append(sorted_b[edges_b[c] : edges_b[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(small[before] > c) & need[before]]
        if len(before):
            key = small[before]
            before = before[np.argsort(key, kind="stable")]
            found, at = np.unique(small[before], return_index=True)
            for f, part in zip(found.tolist(), np.split(before, at[1:])):
                pending[f].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def prefixes(at: np.ndarray, word: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Common prefix of each position with the one before it, `depth` at most; 0 for the first."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(1, len(at))
    for k in range(0, depth, _PER):
        x = word[at[live] + k] ^ word[at[live - 1] + k]
        same = x == 0
        part, x = live[~same], x[~same]
        for s in range(1, _PER):
            out[part] += (x >> np.uint64(9 * (_PER - s))) == 0
        live = live[same]
        out[live] += _PER
    return np.minimum(out, depth)
