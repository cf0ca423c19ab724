"""Spelling variants: each word's neighbours at one edit, and the frequent form that it is a variant of.

Neighbours come from sorted lists by dynamic programming. A list is scanned for many words at once, depth by depth: words of
the list with a common prefix are one range (the common prefixes of neighbours in the list say where ranges part), and a
range has one row of the banded edit matrix for each word that is looked up. A row is made from the row of the
range it is part of by one more letter; a range whose row is above one edit everywhere is skipped with all its words.
A list holds words as long as the one looked up or longer by one, so that the band has two diagonals.

Lists are parts of the vocabulary. Two words within one edit agree on the first half of the shorter one or on as
many last letters as its other half has: words meet on (length, half), and the list is sorted by what is left. The pair's
first different letter says which of the halves counts, so that no pair is found twice. A list of more than MOST
words is parted again in the same way, by the halves of what is left, until it has fewer or one letter is left; so no
list outgrows a task, whatever the words are.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the checksum; repeated rows count each;
a word of no neighbour has n_near 0 and is its own root; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import sized
from . import work

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and occurrences of a word at least.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: One run in so many loses a letter, by its checksum.
EVERY = 31
#: A form occurs so many times as often as its variant.
TIMES = 10
#: Words of a list at most; words of one task's share, about; words that are scanned for at once.
MOST, SHARE, AT_ONCE = 20_000, 100_000, 20_000
#: Letters of a window that is scanned; longer ones are parted in the task first.
WINDOW = 64

PAIRS = "word string, near string, near_n long"


def words(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the corpus's words with their occurrences; shorter runs are never words and are not taken."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{letters},}})"), 1))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    each = each.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    each = each.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    each = each.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    found = each.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return work.written(found.where(F.col("n") >= count), "words")


def halved(rows: DataFrame) -> DataFrame:
    """Rows of (key, window, longer, open, ...) parted by both halves of their windows: the half joins the key, the other
    one is the new window. `longer` is 1 for words with a letter more than the key's; `open` says that a letter
    may follow the window's end."""
    h = F.floor((F.length("window") - F.col("longer")) / 2).cast("int")
    longer = F.col("longer")
    rest = [c for c in rows.columns if c not in ("key", "window", "open")]
    first = F.struct(F.concat("key", F.lit("<"), F.substring("window", F.lit(1), h)).alias("key"), F.substring("window", h + 1, F.length("window")).alias("window"), F.col("open").alias("open"))
    last = F.struct(F.concat("key", F.lit(">"), F.substring("window", h + longer + 1, F.length("window"))).alias("key"), F.substring("window", F.lit(1), h + longer).alias("window"), F.lit(False).alias("open"))
    return rows.select(F.explode(F.array(first, last)).alias("part"), *rest).select("part.*", *rest)


def lists(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """key, window, open, longer, word, n: the lists that the vocabulary is looked up in, of `most` words at most while more
    than one letter is left."""
    short = vocabulary.select(F.length("word").cast("string").alias("key"), F.col("word").alias("window"), F.lit(True).alias("open"), F.lit(0).alias("longer"), "word", "n")
    longer = vocabulary.select((F.length("word") - 1).cast("string").alias("key"), F.col("word").alias("window"), F.lit(True).alias("open"), F.lit(1).alias("longer"), "word", "n")
    rows, done = halved(short.unionByName(longer)), None
    while True:
        rows = work.written(rows, "lists")
        large = rows.where(F.length("window") - F.col("longer") > 1).groupBy("key").count().where(F.col("count") > most).select("key")
        large = work.written(large, "large-lists")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(sized(large), "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = halved(rows.join(sized(large), "key", "left_semi"))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a column's strings, a byte each, and where the strings begin. No letter is above U+00FF."""
    raw = [s.encode("latin-1") for s in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in raw])]).astype(np.int64)


def common(letters: np.ndarray, off: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each string the length of the prefix that it has in common with the one before it; -1 for a group's first."""
    long = np.diff(off)
    out = np.full(len(long), -1, np.int64)
    at = np.flatnonzero(group[1:] == group[:-1]) + 1
    out[at] = 0
    depth = 0
    while len(at):
        at = at[(long[at] > depth) & (long[at - 1] > depth)]
        at = at[letters[off[at] + depth] == letters[off[at - 1] + depth]]
        out[at] += 1
        depth += 1
    return out


def scan(letters: np.ndarray, off: np.ndarray, group: np.ndarray, longer: np.ndarray, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y, tail) of strings of one group at exactly one edit, x as long as the group's key says and y as long or
    longer by one; `tail` says that y is x and one more letter. Groups are sorted and hold no string twice."""
    long = np.diff(off)
    lcp = common(letters, off, group)
    order = np.argsort(lcp, kind="stable")
    by_depth = np.searchsorted(lcp[order], np.arange(int(lcp.max(initial=0)) + 2))
    begins = np.flatnonzero(lcp < 0)
    number = np.cumsum(lcp < 0) - 1
    ends = np.append(begins[1:], len(long))
    many = (ends - begins)[number]
    asked, found = np.flatnonzero((longer == 0) & (many > 1)), []
    for k in range(0, len(asked), at_once):
        x = asked[k : k + at_once]
        lo, hi = begins[number[x]], ends[number[x]]
        same, behind = np.zeros(len(x), np.int8), np.full(len(x), 2, np.int8)  # the row: as many letters of x, one fewer
        depth = 0
        while len(x):
            # Ranges part where neighbours have no more than `depth` letters in common.
            parts = order[by_depth[depth] : by_depth[depth + 1]] if depth + 1 < len(by_depth) else order[:0]
            a, b = np.searchsorted(parts, lo, "right"), np.searchsorted(parts, hi)
            n = b - a + 1
            of = np.repeat(np.arange(len(x)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            if len(parts):
                start = np.where(nth == 0, lo[of], parts[np.minimum(a[of] + nth - 1, len(parts) - 1)])
                end = np.where(nth == n[of] - 1, hi[of], parts[np.minimum(a[of] + nth, len(parts) - 1)])
            else:
                start, end = lo, hi
            # One more letter; a string that ends here has none.
            goes_on = long[start] > depth
            of, start, end = of[goes_on], start[goes_on], end[goes_on]
            x, old_same, old_behind = x[of], same[of], behind[of]
            letter, size = letters[off[start] + depth], long[x]
            here = letters[np.minimum(off[x] + depth, len(letters) - 1)]
            before = letters[off[x] + max(depth - 1, 0)]
            behind = np.minimum(old_same + 1, old_behind + ((letter != before) | (depth == 0)))
            same = np.where(depth < size, np.minimum(old_same + (letter != here), behind + 1), 2).astype(np.int8)
            behind = np.where(depth <= size, behind, 2).astype(np.int8)
            depth += 1
            last = np.where(size == depth, same, np.where(size == depth - 1, behind, 2))
            hit = (long[start] == depth) & (last == 1) & (start != x)
            if hit.any():
                found.append((x[hit], start[hit], (size[hit] == depth - 1) & (old_same[hit] == 0)))
            kept = np.minimum(same, behind) <= 1
            x, lo, hi, same, behind = x[kept], start[kept], end[kept], same[kept], behind[kept]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found))


def parted(rows: list[tuple[tuple, str, bool, int, int]]) -> list[tuple[tuple, str, bool, int, int]]:
    """Rows (group, window, open, longer, number) of long windows, parted by halves until the windows are short; what meets
    nothing is left out."""
    out, todo = [], rows
    while todo:
        groups = defaultdict(list)
        for row in todo:
            groups[row[0]].append(row)
        todo = []
        for own in groups.values():
            if len(own) < 2 or all(r[3] for r in own):
                continue
            if len(own[0][1]) - own[0][3] <= WINDOW:
                out += own
                continue
            for group, window, is_open, longer, number in own:
                h = (len(window) - longer) // 2
                todo.append(((group, "<", window[:h]), window[h:], is_open, longer, number))
                todo.append(((group, ">", window[h + longer :]), window[: h + longer], False, longer, number))
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all lists of a task, which come one after the other, sorted by window."""
    columns = ["key", "window", "open", "longer", "word", "n"]

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        code = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        longer, is_open = table["longer"].to_numpy(), table["open"].to_numpy()
        number = np.arange(len(code))
        windows = table["window"].combine_chunks()
        size = pc.utf8_length(windows).to_numpy()
        wide = size - longer > WINDOW
        if wide.any():
            at = np.flatnonzero(wide).tolist()
            own = parted([((int(code[k]),), windows[k].as_py(), bool(is_open[k]), int(longer[k]), k) for k in at])
            names = {g: int(code.max()) + 1 + i for i, g in enumerate({r[0] for r in own})}
            own = sorted((names[g], w, o, more, k) for g, w, o, more, k in own)
            plain = np.flatnonzero(~wide)
            windows = pa.concat_arrays([windows.take(pa.array(plain)), pa.array([r[1] for r in own], pa.string())])
            code, is_open, longer, number = (np.concatenate([c[plain], np.array([r[k] for r in own], c.dtype)]) for c, k in ((code, 0), (is_open, 2), (longer, 3), (number, 4)))
        letters, off = _letters(windows)
        if not len(letters):
            return
        x, y, tail = scan(letters, off, code, longer)
        kept = ~tail | is_open[y]
        x, y = x[kept], y[kept]
        more = longer[y] == 1  # the other way round, the longer word is not looked up
        one, two = np.concatenate([number[x], number[y[more]]]), np.concatenate([number[y], number[x[more]]])
        for k in range(0, len(one), SHARE):
            a, b = pa.array(one[k : k + SHARE]), pa.array(two[k : k + SHARE])
            yield from pa.table({"word": table["word"].take(a), "near": table["word"].take(b), "near_n": table["n"].take(b)}).combine_chunks().to_batches()

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.select(columns))
        rows += batch.num_rows
        if rows >= SHARE:
            table = pa.Table.from_batches(held)
            last = pc.equal(table["key"], table["key"][-1]).to_numpy()
            upto = int(np.argmax(last))
            if upto:
                yield from made(table.slice(0, upto))
            held, rows = table.slice(upto).combine_chunks().to_batches(), len(table) - upto
    if held:
        yield from made(pa.Table.from_batches(held))


def neighbours(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: all pairs of words of `vocabulary` (word, n) at exactly one edit, in both directions."""
    rows = lists(vocabulary, most)
    tasks = max(1, -(-rows.count() // SHARE))
    return rows.repartition(tasks, "key").sortWithinPartitions("key", "window").mapInArrow(_near, PAIRS)


def forms(vocabulary: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n for each word of `vocabulary`."""
    near = neighbours(vocabulary, most)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))  # strings are compared by their bytes, as code points
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = vocabulary.join(near.hint("merge"), "word", "left")
    is_form = F.coalesce(-F.col("best.n") >= times * F.col("n"), F.lit(False))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last form of the chain, by doubling. Forms are `times` as
    frequent as their variants, so chains are short and have an end."""
    chain = work.written(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "chains")
    while chain.where("moved").limit(1).count():
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = chain.drop("moved").join(sized(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        chain = work.written(chain, "chains")
    return chain.drop("moved")


def groups(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: the variants of all words of `docs` (doc_id, text)."""
    work.prepare(docs.sparkSession)
    found = work.written(forms(words(docs, letters, count), times, most), "forms")
    out = found.join(sized(roots(found)), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(work.documents(spark, sf_dir))
