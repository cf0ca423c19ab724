"""The numpy parts, against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import decontamination, encoding, near_duplicates, nearest, quality, suffixes, texts, token_files, toxicity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 60))
def test_suffixes_are_sorted_to_the_depth(symbols, times):
    s = np.repeat(np.array(symbols, np.uint16), 1 + np.arange(len(symbols)) % times)[:400]
    word = suffixes.words(s)
    order = suffixes.order(s, word)
    padded = s.tolist() + [0] * 60
    keys = [padded[i : i + 50] for i in order]
    assert sorted(order.tolist()) == list(range(len(s)))
    assert keys == sorted(keys)
    some = np.arange(len(s)) % 3 == 1
    part = suffixes.order(s, word, wanted=some)
    assert [i for i in part.tolist() if some[i]] == sorted(np.flatnonzero(some).tolist(), key=part.tolist().index)
    assert [keys[order.tolist().index(i)] for i in part] == sorted(keys[order.tolist().index(i)] for i in part)
    assert set(np.flatnonzero(some).tolist()) <= set(part.tolist())
    common = suffixes.prefixes(order, word)
    for a, b, n in zip(keys, keys[1:], common[1:].tolist()):
        assert n == next((k for k in range(50) if a[k] != b[k]), 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_code_lengths_are_prefix_free_and_limited(counts, limit):
    counts = np.array(counts)
    long = token_files.code_lengths(counts, limit)
    assert long.max() <= limit and (long > 0).all()
    assert sum(2.0 ** -int(x) for x in long) <= 1
    if len(counts) > 1 and limit == 16:
        import heapq

        heap, cost = [(c, i) for i, c in enumerate(counts.tolist())], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1]))
        depth_fits = int((counts * long).sum()) == cost
        assert depth_fits or long.max() == limit


def test_huffman_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = (rng.zipf(1.3, n) % 50257).astype(np.uint16)
        lengths = token_files.code_lengths(np.bincount(np.append(ids, 2), minlength=1 << 16))
        checkpoints, payload = token_files.pack(ids, token_files.canonical(lengths), lengths)
        assert (token_files.unpack(payload, checkpoints, n, token_files.decoding_table(lengths)) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t,.'aZé日1\xa0　\x85ß!stmrev-", max_size=60), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts_do(rows):
    path = encoding.vocabulary()
    got = [part for _, ids, n in encoding.encoded(pa.array(rows), path) for part in np.split(ids, np.cumsum(n)[:-1])]
    whole = encoding.table(path).tokenizer
    assert [g.tolist() for g in got] == [whole.encode(r, add_special_tokens=False).ids for r in rows]


def test_special_strings_null_and_empty_are_encoded():
    rows = ["a <|endoftext|> b", None, "", "x" * 5000]
    path = encoding.vocabulary()
    whole = encoding.table(path).tokenizer
    counts = [int(c) for _, _, n in encoding.encoded(pa.array(rows, pa.string()), path, 2) for c in n]
    assert counts == [len(whole.encode(r or "", add_special_tokens=False).ids) + 1 for r in rows]


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        items, w = rng.integers(1, 2**60, 200).astype("u8"), rng.integers(1, 6, 200)
        v = np.where(rng.random(200) < 0.3, rng.integers(1, 6, 200), w)
        names = near_duplicates.signatures(np.repeat([0, 1], 200), np.tile(items, 2), np.concatenate([w, v]), 2)
        errors.append((names[0] == names[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(errors)) < 0.02


def test_marginals_equal_step_by_step_recursion():
    rng = np.random.default_rng(2)
    first, e, a = np.array([0, 3, 3, 40, 200]), rng.normal(0, 3, 200), rng.normal(0, 1, (2, 2))
    got, pairs = toxicity.marginals(e, first, a, pairs=True)
    for lo, hi in zip(first[:-1], first[1:]):
        forward, v = [], np.array([1.0, 0.0])
        for t in range(lo, hi):
            v = (v @ np.exp(a)) * [1, np.exp(e[t])]
            v /= v.sum()
            forward.append(v)
        back = np.ones(2)
        for t in range(hi - 1, lo - 1, -1):
            p = forward[t - lo] * back
            assert got[t] == pytest.approx(p[1] / p.sum(), abs=1e-9)
            back = np.exp(a) @ (np.array([1, np.exp(e[t])]) * back)
            back /= back.sum()
    assert pairs.sum() == pytest.approx(200)


def test_machine_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    total = (1 << quality.BITS) + quality.BINS * 2
    m = quality.Machine(np.zeros((2, quality.BINS - 1)), 0.1, rng.normal(0, 1, total), rng.normal(0, 1, (total, quality.RANK)), np.array([0, 1.0]))
    words, bins = np.array([5, 9, 11]), np.array([[(1 << quality.BITS) + 1, (1 << quality.BITS) + 14]])
    got = m.raw(words, np.array([0, 3]), bins)[0][0]
    idx, x = np.append(words, bins[0]), np.array([3**-0.5] * 3 + [1, 1])
    want = 0.1 + (m.weights[idx] * x).sum() + sum(m.vectors[idx[i]] @ m.vectors[idx[j]] * x[i] * x[j] for i in range(5) for j in range(i))
    assert got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.", max_size=40), min_size=1, max_size=8), st.lists(st.text(alphabet="ab ", min_size=1, max_size=6), min_size=1, max_size=5))
def test_matcher_finds_all_windows(rows, items):
    patterns: dict[bytes, set[int]] = {}
    for n, item in enumerate(items):
        for w in decontamination.windows_of(item, 2):
            patterns.setdefault(w, set()).add(n)
    _, _, n_items, _ = decontamination._digests(pa.array(rows), decontamination.Patterns(patterns))
    for row, n in zip(rows, n_items.tolist()):
        words = " " + " ".join(row.replace(",", " ").replace(".", " ").split()) + " "
        assert n == len({i for w, own in patterns.items() if w.decode() in words for i in own})


def test_word_hashes_do_not_depend_on_place():
    buf, off = texts.buffer(pa.array(["one two", "two  one", None, ""]))
    low, starts, ends, first = texts.words(buf, off)
    h = texts.hashes(low, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert first.tolist() == [0, 2, 4, 4, 4]


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(4).normal(size=(400, 6))
    tree = nearest.Tree(x)
    order, far = tree.visits(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves))
    assert order[0] == tree.assign(x[:1])[0]
    # A leaf's distance is that of its own center, whatever way led to it.
    center = {-1 - child: c for node in range(len(tree.children)) for child, c in zip(tree.children[node], tree.centers[node]) if child < 0}
    assert far == pytest.approx([float(((center[leaf] - x[0]) ** 2).sum()) for leaf in order])


def _jaccard(a: str, b: str) -> float:
    bags = []
    for t in (a, b):
        w = t.split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    return sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())


@pytest.mark.parametrize("bits", [5, 32])
def test_links_of_dense_groups_are_confirmed_on_texts(spark, bits):
    """Texts from far under 0.8 to just over it, with hashes of few bits, so that nearly all of them seem alike."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    made = []
    for changed in (0, 1, 2, 3, 4, 5, 5, 6, 9, 60):
        words = list(base)
        for k, at in enumerate(rng.choice(np.arange(6, 114), changed, replace=False)):
            words[at] = f"x{changed}y{k}"
        made.append(" ".join(words))
    want = {(j, i) for i in range(len(made)) for j in range(i + 1, len(made)) if _jaccard(made[i], made[j]) >= near_duplicates.THRESHOLD}
    sims = [_jaccard(made[i], made[j]) for i in range(len(made)) for j in range(i)]
    assert any(0.72 < s < 0.8 for s in sims)  # pairs just under the threshold
    texts_of = spark.createDataFrame(list(enumerate(made)), "node long, text string")
    dense = spark.createDataFrame([(7, 0, 0, i, i, False) for i in range(len(made))], "key long, r int, x int, node long, label long, right boolean")
    got = {(r.a, r.b) for r in near_duplicates.compared(dense, texts_of, near_duplicates.THRESHOLD, bits).collect()}
    assert got <= want

    def parts(links):
        own = list(range(len(made)))
        for a, b in links:
            own = [own[b] if v == own[a] else v for v in own]
        return [own.index(v) for v in own]

    assert parts(sorted(got)) == parts(sorted(want))
