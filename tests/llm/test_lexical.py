"""Ranked lexical search against a direct evaluation, with blocks, bundles and passes of many sizes."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from waymark.llm import lexical

DOCS = "doc_id long, text string, `block` int, item_id string, term string"
ITEMS = "item_id string, text string, owner int, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", *(f"w{k}" for k in range(60)), "Ünï", "日本", "ab1"]
    weights = [40, 30, *(60 / (k + 1) for k in range(60)), 1, 1, 1]
    line = lambda k: " ".join(rng.choices(vocabulary, weights, k=k))
    docs = [(k, line(rng.choice([1, 3, 20, 60])) + rng.choice(["", "!", " --", "THE"])) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, line(30_000)), (n + 4, "the"), (n + 5, "the"), (7, docs[7][1]), (7, docs[7][1]), (None, line(20)), (-4, "of")]
    items = [(f"i{k}", line(rng.choice([1, 4, 15]))) for k in range(30)] + [("i3", "w1 W2 w2"), ("none", None), ("empty", ""), ("absent", "xyzzy"), (None, "w3 w4"), ("i5", "the of"), ("i5", "the of")]
    return docs, items


@pytest.mark.parametrize("block_docs, bundle, pass_bytes, best", [(4096, 256, 32 << 20, 50), (40, 5, 2000, 50), (100, 40, 32 << 20, 3), (7, 1, 32 << 20, 1)])
def test_equals_direct_evaluation(spark, block_docs, bundle, pass_bytes, best):
    docs, items = corpus(block_docs)
    df = spark.createDataFrame([(d, t, 1, "x", None) for d, t in docs], DOCS).repartition(3)
    wanted = spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS)
    found = lexical.index(df, block_docs=block_docs)
    assert found.blocks.count() >= -(-len(docs) // block_docs)
    got = lexical.search(found, wanted, best=best, bundle=bundle, pass_bytes=pass_bytes).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == brute(docs, items, best)


def test_blocks_by_bytes(spark):
    docs = [(k, "word " * 1000) for k in range(20)] + [(99, "long " * 300_000), (100, "end")]
    found = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_bytes=10_000)
    sizes = [len(r.doc_ids) for r in found.blocks.collect()]
    assert sum(sizes) == 22 and max(sizes) == 2
    assert (found.n, found.total) == (22, 20_000 + 300_000 + 1)
    assert {(r.term, r.df) for r in found.terms.collect()} == {("word", 20), ("long", 1), ("end", 1)}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "the")], "item_id string, text string")
    assert lexical.search(lexical.index(none), items).count() == 0
    some = lexical.index(spark.createDataFrame([(1, "the cat", 1, "x", "y"), (2, "a dog", 1, "x", "y")], DOCS))
    assert lexical.search(some, items.limit(0)).count() == 0
    assert lexical.search(some, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_what_is_left_out_cannot_come_back():
    import numpy as np
    import pyarrow as pa

    # 3 documents are kept for the best 2: the fourth cannot reach the second's score with what is still to come.
    own = pa.table({"slots": [1], "n_docs": [5], "weights": [[2]], "many": [[4]], "docs": [np.array([0, 1, 2, 4], "<u2").tobytes()], "value": [np.array([50, 40, 35, 9], "<u4").tobytes()], "n_items": [[1]], "items": [[0]], "after": [[20]], "doc_ids": [[]]})
    own = own.set_column(own.schema.get_field_index("doc_ids"), "doc_ids", pa.array([[]], pa.list_(pa.int64())))
    out = lexical._stage(2)((pa.scalar(1), pa.scalar(2)), pa.table({"many": pa.array([], pa.list_(pa.int32())), "docs": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())}), own)
    assert np.frombuffer(out["docs"][0].as_py(), "<u2").tolist() == [0, 1, 2]
    assert np.frombuffer(out["scores"][0].as_py(), "<i8").tolist() == [100, 80, 70]
