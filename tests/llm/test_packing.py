"""Packing: the plan against exhaustive search, whole results against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from waymark.llm import packing

SCHEMA = "doc_id long, text string, part int, ids string, `length` int"


def used(bins, capacity):
    total = Counter()
    for n, held in bins:
        assert n > 0 and sum(s * k for s, k in held) <= capacity
        for s, k in held:
            total[s] += n * k
    return total


def fewest(sizes, capacity):
    """Bins of a best packing of a few pieces, by trying each piece in each open bin."""
    best = len(sizes)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for gap in {g for g in free if g >= sizes[k]}:
            rest = list(free)
            rest.remove(gap)
            go(k + 1, [*rest, gap - sizes[k]])
        go(k + 1, [*free, capacity - sizes[k]])

    go(0, [])
    return best


def test_plan_holds_every_piece_once():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 64, 1024])
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        bins = packing.plan(dict(sizes), capacity)
        assert used(bins, capacity) == sizes
        total = sum(s * n for s, n in sizes.items())
        assert sum(n for n, _ in bins) <= 1.25 * total / capacity + sum(n for s, n in sizes.items() if 2 * s > capacity) + 2


def test_large_pieces_are_matched_as_often_as_possible():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(21, 60) for _ in range(rng.randint(1, 7))), reverse=True)
        bins = packing.plan(dict(Counter(sizes)), 60)
        assert sum(n for n, _ in bins) == fewest(sizes, 60)


def test_plan_is_near_the_best():
    rng = random.Random(3)
    over = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 8))), reverse=True)
        n, best = sum(n for n, _ in packing.plan(dict(Counter(sizes)), 60)), fewest(sizes, 60)
        assert n <= best + 1
        over += n - best
    assert over <= 4


def test_plan_does_not_grow_with_counts():
    rng = random.Random(4)
    sizes = {s: rng.randint(1, 10**9) for s in range(1, 1025)}
    bins = packing.plan(sizes)
    assert used(bins, 1024) == Counter(sizes)
    assert len(bins) < 6000
    total = sum(s * n for s, n in sizes.items())
    assert sum(n for n, _ in bins) <= 1.05 * total / 1024


@pytest.mark.parametrize("many_parts", [False, True])
def test_sequences(spark, monkeypatch, many_parts):
    from tokenizers import Tokenizer

    if many_parts:
        monkeypatch.setattr(packing, "BROADCAST_PARTS", 1)
        monkeypatch.setattr(packing, "PARTITION_BYTES", 2000)
    rng = random.Random(5)
    words = ["the", "river", "ran", "çé", "日本", "over", "stones", "\n", "  ", "<|endoftext|>"]
    texts = [None, "", "x", *(" ".join(rng.choices(words, k=rng.choice([1, 5, 100, 300, 900, 3000]))) for _ in range(60)), "long text " * 200_000]
    rows = [(k, t, 1, "i", 2) for k, t in enumerate(texts)] + [(3, texts[3], 1, "i", 2), (None, "no number", None, None, None)]
    packed = packing.sequences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = packing.digest(packed).collect()
    tok = Tokenizer.from_file(packing.encoding.vocabulary())
    want, total = Counter(), 0
    for k, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for piece, at in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[at : first if piece == 0 else at + 1024]
            want[k, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    best = sum(n for n, _ in packing.plan(dict(Counter(length for _, _, _, length, _ in want.elements()))))
    assert len(bins) == packed.count() == best <= 1.02 * total / 1024


def test_no_documents(spark):
    assert packing.digest(packing.sequences(spark.createDataFrame([], SCHEMA))).count() == 0
