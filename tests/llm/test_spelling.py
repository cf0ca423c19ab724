"""Spelling variants against direct comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, `key` int"


def brute_words(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    k = next((k for k in range(len(u)) if u[k] != v[k]), len(u))
    return u[k + (len(u) == len(v)) :] == v[k + 1 :]


def brute_pairs(words):
    words = list(words)
    return {(u, v) for u in words for v in words if one_edit(u, v)}


def variants(rng, n, letters="abé", length=(7, 12)):
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(letters, k=rng.randint(*length)))
        out.add(w)
        for _ in range(3):
            k = rng.randrange(len(w))
            out.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return {w: rng.randint(2, 5000) for w in sorted(out) if len(w) >= 7}


@pytest.mark.parametrize("most, window, share", [(20_000, 64, 100_000), (30, 3, 50), (4, 8, 7)])
def test_all_pairs_once(spark, monkeypatch, most, window, share):
    rng = random.Random(most)
    known = variants(rng, 250) | variants(rng, 60, "abcdÿx÷×", (7, 9)) | {"a" * k: k for k in range(7, 30)}
    table = spark.createDataFrame([(w, n) for w, n in known.items()], "word string, n long")
    rows = spelling.lists(table, most)
    if most < 100:
        assert rows.where("length(window) - longer > 1").groupBy("key").count().where(f"count > {most}").isEmpty()
    out = spelling.neighbours(table, most).collect()
    assert len(out) == len({(r.word, r.near) for r in out})
    assert {(r.word, r.near) for r in out} == brute_pairs(known)
    assert all(r.near_n == known[r.near] for r in out)
    # What a task does, with short windows and small shares, on batches of all sizes.
    monkeypatch.setattr(spelling, "SHARE", share)
    monkeypatch.setattr(spelling, "WINDOW", window)
    whole = rows.sort("key", "window").toArrow()
    made = [(u, v) for b in spelling._near(iter(whole.to_batches(max_chunksize=17))) for u, v in zip(b["word"].to_pylist(), b["near"].to_pylist())]
    assert len(made) == len(out) and set(made) == {(r.word, r.near) for r in out}


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_scan_of_sorted_lists(at_once):
    rng = random.Random(at_once)
    for _ in range(40):
        rows = set()
        for g in range(rng.randint(1, 5)):
            k = rng.randint(1, 5)
            rows |= {(g, "".join(rng.choices("ab", k=k + more)), more) for more in (0, 1) for _ in range(rng.randint(0, 20))}
        rows = sorted(rows)
        if not rows:
            continue
        raw = [r[1].encode() for r in rows]
        off = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        x, y, tail = spelling.scan(np.frombuffer(b"".join(raw), np.uint8), off, np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), at_once)
        want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and not a[2] and one_edit(a[1], b[1])}
        assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want
        assert all(t == rows[j][1].startswith(rows[i][1]) for i, j, t in zip(x, y, tail))


def test_long_words(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefg", k=3000))
    known = {base: 500, base[:1500] + base[1501:]: 3, base[:10] + "z" + base[10:]: 4, base[:-1] + "q": 5, base + "h": 6, "z" * 40_000: 900, "z" * 39_999: 2, "z" * 100 + "y" + "z" * 39_899: 2, base[:1500] + "é" + base[1501:]: 7}
    known |= {base[:300] + "".join(rng.choices("xy", k=200)): 2 for _ in range(60)}
    table = spark.createDataFrame([(w, n) for w, n in known.items()], "word string, n long")
    got = {(r.word, r.near) for r in spelling.neighbours(table).collect()}
    assert got == brute_pairs(known) and len(got) > 10


@pytest.mark.parametrize("most", [20_000, 50])
def test_groups(spark, most):
    rng = random.Random(11)
    known = list(variants(rng, 120, "abcé"))
    weights = [1 / (k + 1) for k in range(len(known))]
    docs = [(k, rng.choice([" ", "-", "1"]).join(rng.choices([w.title() if k % 3 else w.upper() for w in known], weights, k=150))) for k in range(80)]
    docs += [(200, None), (201, ""), (202, "short 123"), (None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (500, "abcabcabc " * 200_000), (300, "qqqqqqqq " * 400), (301, "qqqqqqqr " * 40), (303, "qqqqqqrr " * 2)]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA).repartition(3)
    n = brute_words(docs)
    near = {w: [] for w in n}
    for u, v in brute_pairs(n):
        near[u].append(v)
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs and max(n[v] for v in vs) >= 10 * n[w] else None for w, vs in near.items()}
    want = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    got = spelling.groups(df, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of more than one form


def test_no_words(spark):
    assert spelling.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.groups(spark.createDataFrame([(1, None, "x", 1, 1), (2, "only short", "x", 1, 1)], SCHEMA)).count() == 0
