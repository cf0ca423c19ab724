"""Suffix-array dedup: bytes covered by a 50-byte string that a document with a smaller doc_id also holds.

No machine can sort the suffixes of the whole corpus, and equal strings must meet, so strings are dealt by
what they hold. Each 50-byte window has one anchor: the 24-byte string inside it with the least hash. Equal
windows have equal anchors, and consecutive windows mostly share one, so a text is cut into pieces, the bytes
of a run of windows with one anchor. Steps:

1. Anchors. Every text sends its anchors' hashes, and hears which of them another text holds too. Anchors that
   a sample of documents shows to be frequent are not asked for: they count as shared. This step only leaves
   out text that can't repeat.
2. Sorting. The pieces of shared anchors, each distinct piece once per block of documents with the smallest
   doc_id that has it, are dealt by anchor. Each task sorts the suffixes of its pieces by the two-stage method
   (suffixes.py) and takes common prefixes of neighbours: a run of 50 or more is a group of equal windows, whose
   smallest doc_id is where the string occurs first. Anchors that the sample shows with many different pieces
   are dealt window by window, by the window's hash, so that no anchor fills a task.
3. Removal. Blocks hear, for each of their pieces, the runs of windows that occur first in another document,
   and remove their bytes from each document behind that one.

Equal texts are one text: the copies behind the first one are covered from end to end.

Defined cases: a null text is empty; a text under 50 bytes loses nothing; rows with equal doc_id are never
"smaller" for each other, and each has a result; a null doc_id is behind all others, and such rows are not
behind each other; an empty table gives no rows; other columns are ignored. Hashes of 64 bits stand for pieces
of one block and for anchors; windows themselves are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixes, texts, work

WINDOW, ANCHOR = suffixes.DEPTH, 24
#: The sample that shows frequent anchors: documents, and the documents or different pieces that make one frequent.
SAMPLE_ROWS, FREQUENT = 20_000, 20
#: Bytes of text whose anchors one bucket takes; bytes of shared texts whose pieces one bucket takes.
ASK_BYTES, SORT_BYTES, LEAST_BUCKETS = 48 << 20, 4 << 20, 24
#: Bytes of texts in a block.
BLOCK_BYTES = 3 << 20
U = np.uint64
_LAST = np.iinfo(np.int64).max


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all documents: anchor hash, document, first and last window start."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < WINDOW:
        return none.astype(U), none, none, none
    up, down = texts.powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[:n], out=total[1:])
    least = texts.mixed((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    width, span = WINDOW - ANCHOR + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    size = np.diff(off)
    some = np.flatnonzero(size >= WINDOW)
    count = size[some] - WINDOW + 1
    doc = np.repeat(some, count)
    start = np.arange(len(doc)) + np.repeat(off[some] - (np.cumsum(count) - count), count)
    h = least[start]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1 if len(at) else at
    return h[at], doc[at], start[at], start[last]


def _within(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors that FREQUENT or more documents of a sample hold, and those of them with as many different
    pieces there. The sample is bounded, so both lists are; they change how work is dealt, never results."""
    many = rows.count()
    share = max(1, -(-many // SAMPLE_ROWS))
    some = rows.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(share)) == 0)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = texts.buffer(batch.column("text"))
            for lo, hi in texts.slices(off):
                part = buf[off[lo] : off[hi]]
                h, doc, first, last = anchors(part, off[lo : hi + 1] - off[lo])
                piece = texts.hashes(part, first, last + WINDOW)
                once = np.unique(np.stack([h, doc.astype(U), piece], 1), axis=0) if len(h) else np.zeros((0, 3), U)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(once[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(once[:, 2]).view(np.int64))], names=["h", "piece"])

    seen = some.select("text").mapInArrow(make, "h long, piece long").groupBy("h", "piece").count()
    seen = seen.groupBy("h").agg(F.sum("count").alias("docs"), F.count(F.lit(1)).alias("pieces")).where(F.col("docs") >= FREQUENT).toPandas()
    hot = np.sort(seen["h"].to_numpy(np.int64).view(U))
    diverse = np.sort(seen.loc[seen["pieces"] >= FREQUENT, "h"].to_numpy(np.int64).view(U))
    return hot, diverse


def _deltas(x: np.ndarray) -> bytes:
    gap = np.diff(x, prepend=0)
    return gap.astype("<u2" if gap.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _undelta(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64))


def shared(rows: DataFrame, hot, buckets: int) -> DataFrame:
    """row, places: the pieces of a text, by number, whose anchor another text holds; [] asks for the text alone."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("row").to_numpy(), batch.column("tag").to_numpy()
            buf, off = texts.buffer(batch.column("text"))
            for lo, hi in texts.slices(off, 3 << 20):
                h, doc, _, _ = anchors(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                count = np.bincount(doc, minlength=hi - lo).astype("<u4")
                known = _within(h, hot.value)
                bucket = np.where(known, buckets, ((h >> U(32)) % U(buckets)).astype(np.int64)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [(b, order[a:z]) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if z > a]
                used = np.unique(doc[known])
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array((-1 - ids[lo + used] % buckets).astype(np.int32)), *[pa.nulls(len(used), pa.binary())] * 5, pa.array(ids[lo + used])], names=[*_ASK, "row"])
                for b, own in out:
                    docs = np.unique(doc[own])
                    # Places count within the documents named here.
                    base = np.cumsum(count) - count
                    short = np.zeros(hi - lo, np.int64)
                    short[docs] = np.cumsum(count[docs]) - count[docs]
                    place = own - base[doc[own]].astype(np.int64) + short[doc[own]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids[lo + docs].tobytes(), tags[lo + docs].tobytes(), count[docs].tobytes(), _deltas(place), (h[own] & U(0xFFFFFFFF)).astype("<u4").tobytes())), pa.nulls(1, pa.int64())], names=[*_ASK, "row"])

    def answer(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            n = table.num_rows
            return pa.table({"row": table.column("row"), "places": pa.array([[]] * n, pa.list_(pa.int32()))})
        ids, tags, where, hs, docs = [], [], [], [], 0
        for k, (r, t, c, p, h) in enumerate(zip(*(table.column(n).to_pylist() for n in _ASK[1:]))):
            n = len(h) // 4
            count = np.frombuffer(c, "<u4").astype(np.int64)
            begin = np.cumsum(count) - count
            place = _undelta(p, n)
            doc = np.searchsorted(begin, place, "right") - 1
            ids.append(np.frombuffer(r, np.int64)), tags.append(np.frombuffer(t, np.int64))
            hs.append(np.frombuffer(h, "<u4")), where.append(np.stack([docs + doc, place - begin[doc]]).astype(np.int32))
            docs += len(count)
        ids, tags, hs, where = np.concatenate(ids), np.concatenate(tags), np.concatenate(hs), np.concatenate(where, 1)
        order = np.argsort(hs, kind="stable")
        key, tag = hs[order], tags[where[0][order]]
        first = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
        several = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
        own = order[np.repeat(several, np.diff(np.append(first, len(key))))]
        doc, place = where[0][own], where[1][own]
        by = np.lexsort((place, doc))
        doc, place = doc[by], place[by]
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)).astype(np.int32)), pa.array(place))
        return pa.table({"row": ids[doc[cut]], "places": lists})

    asked = rows.select("row", "tag", "text").mapInArrow(ask, "bucket int, rows binary, tags binary, counts binary, places binary, hashes binary, row long")
    found = asked.groupBy("bucket").applyInArrow(answer, "row long, places array<int>")
    return found.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))


_ASK = ["bucket", "rows", "tags", "counts", "places", "hashes"]
_BLOCK = "block long, rows binary, docs binary, sizes binary, flags binary, text binary"


def blocks(rows: DataFrame, places: DataFrame, hot) -> DataFrame:
    """Texts with shared anchors in blocks of BLOCK_BYTES: their pieces' flags are bits, in the order of the pieces."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("row").to_numpy()
            docs = batch.column("doc_id").fill_null(_LAST).to_numpy()
            buf, off = texts.buffer(batch.column("text"))
            asked, cut = batch.column("places").flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column("places").value_lengths().to_numpy())])
            for lo, hi in texts.slices(off, BLOCK_BYTES):
                part = buf[off[lo] : off[hi]]
                h, doc, _, _ = anchors(part, off[lo : hi + 1] - off[lo])
                flag = _within(h, hot.value)
                count = np.bincount(doc, minlength=hi - lo)
                own = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                flag[asked[cut[lo] : cut[hi]] + (np.cumsum(count) - count)[own]] = True
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[lo:hi], docs[lo:hi], np.diff(off[lo : hi + 1]), np.packbits(flag), part))], names=["block", "rows", "docs", "sizes", "flags", "text"])
                number += 1

    met = rows.join(places.hint("merge"), "row")
    return work.written(met.select("row", "doc_id", "text", "places").mapInArrow(make, _BLOCK), "blocks", compression="zstd")


class Pieces:
    """The flagged pieces of one block: `diverse` anchors give a piece for each window."""

    def __init__(self, row: dict, diverse: np.ndarray):
        self.text = np.frombuffer(row["text"], np.uint8)
        self.rows, self.docs = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["docs"], np.int64)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        h, doc, first, last = anchors(self.text, self.off)
        flag = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(h)).astype(bool)
        h, doc, first, last = h[flag], doc[flag], first[flag], last[flag]
        wide = _within(h, diverse)
        n = np.where(wide, last - first + 1, 1)
        each = np.repeat(np.arange(len(h)), n)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        self.doc, self.first = doc[each], first[each] + inner
        self.last = np.where(wide[each], self.first, last[each])
        self.hash = texts.hashes(self.text, self.first, self.last + WINDOW)
        self.route = np.where(wide[each], texts.mixed(self.hash), h[each])
        # Distinct pieces: the number of each occurrence's piece, one occurrence, first and last doc_id of each.
        _, self.some, self.piece = np.unique(self.hash, return_index=True, return_inverse=True)
        at = np.argsort(self.piece, kind="stable")
        cut = np.flatnonzero(np.diff(self.piece[at], prepend=-1))
        own = self.docs[self.doc[at]]
        self.least = np.minimum.reduceat(own, cut) if len(cut) else own
        self.most = np.maximum.reduceat(own, cut) if len(cut) else own


_ROW = ("block", "rows", "docs", "sizes", "flags", "text")
_SEND = ["bucket", "block", "numbers", "sizes", "least", "most", "text"]


def repeats(cut: DataFrame, diverse, buckets: int) -> DataFrame:
    """block, runs of windows of its pieces, each with the smallest doc_id that holds them: where that is smaller
    than some document's that has the piece in this block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in _ROW}
                p = Pieces(row, diverse.value)
                bucket = ((p.route[p.some] >> U(20)) % U(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    first, size = p.first[p.some[own]], (p.last - p.first)[p.some[own]] + WINDOW
                    total = np.cumsum(size)
                    data = p.text[np.repeat(first - (total - size), size) + np.arange(total[-1])]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (own.astype("<u4"), size.astype("<u4"), p.least[own], p.most[own], data))], names=_SEND)

    def sort(table: pa.Table) -> pa.Table:
        block, number, sizes, least, most, data = [], [], [], [], [], []
        for b, n, s, a, z, d in zip(*(table.column(c).to_pylist() for c in _SEND[1:])):
            number.append(np.frombuffer(n, "<u4")), sizes.append(np.frombuffer(s, "<u4").astype(np.int64))
            block.append(np.full(len(number[-1]), b)), least.append(np.frombuffer(a, np.int64))
            most.append(np.frombuffer(z, np.int64)), data.append(np.frombuffer(d, np.uint8))
        block, number, sizes, least, most, data = (np.concatenate(x) for x in (block, number, sizes, least, most, data))
        # Equal pieces of several blocks are sorted once.
        end = np.cumsum(sizes)
        begin = end - sizes
        _, some, piece = np.unique(texts.hashes(data, begin, end), return_index=True, return_inverse=True)
        small = np.full(len(some), _LAST)
        np.minimum.at(small, piece, least)
        size = sizes[some]
        total = np.cumsum(size + 1)
        start = total - size - 1
        sym = np.zeros(int(total[-1]), np.uint16)
        spot = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        sym[spot] = data[np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.uint16) + 1
        word = suffixes.words(sym)
        # Windows alone: suffixes with 50 symbols before their piece's end.
        owner = np.repeat(np.arange(len(size)), size + 1)
        is_window = np.arange(len(sym)) - start[owner] + WINDOW <= size[owner]
        at = suffixes.order(sym, word, wanted=is_window)
        at = at[is_window[at]]
        group = np.flatnonzero(suffixes.prefixes(at, word) < WINDOW)
        first = np.repeat(np.minimum.reduceat(small[owner[at]], group), np.diff(np.append(group, len(at))))
        earliest = np.full(len(sym), _LAST)
        earliest[at] = first
        # Runs of windows with one first document, for each piece; then for each block that has the piece.
        windows = size - WINDOW + 1
        flat = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        own, value = owner[flat], earliest[flat]
        new = np.ones(len(flat), bool)
        new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
        run = np.flatnonzero(new)
        run_piece, run_value = own[run], value[run]
        run_first = flat[run] - start[run_piece]
        run_last = flat[np.append(run[1:], len(flat)) - 1] - start[run_piece]
        per = np.searchsorted(run_piece, np.arange(len(size) + 1))
        count = np.diff(per)[piece]
        entry = np.repeat(np.arange(len(piece)), count)
        r = per[piece][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        ok = run_value[r] < most[entry]
        entry, r = entry[ok], r[ok]
        by = np.argsort(block[entry], kind="stable")
        entry, r = entry[by], r[by]
        cut = np.flatnonzero(np.diff(block[entry], prepend=np.iinfo(np.int64).min)) if len(entry) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(entry))
        pack = lambda x, t: pa.array([x[a:z].astype(t).tobytes() for a, z in zip(cut, ends)], pa.binary())
        return pa.table([pa.array(block[entry[cut]] if len(cut) else [], pa.int64()), pack(number[entry], "<u4"), pack(run_first[r], "<u4"), pack(run_last[r], "<u4"), pack(run_value[r], np.int64)], names=["block", "numbers", "firsts", "lasts", "values"])

    sent = cut.mapInArrow(send, "bucket int, block long, numbers binary, sizes binary, least binary, most binary, text binary")
    return sent.groupBy("bucket").applyInArrow(sort, "block long, numbers binary, firsts binary, lasts binary, values binary")


def removed(cut: DataFrame, found: DataFrame, diverse) -> DataFrame:
    """row, n_removed, n_spans, kept_sha256, starts, ends of the texts in blocks that lose bytes."""
    lists = found.groupBy("block").agg(F.collect_list(F.struct("numbers", "firsts", "lasts", "values")).alias("runs"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = Pieces({c: batch.column(c)[k].as_py() for c in _ROW}, diverse.value)
                runs = batch.column("runs")[k].as_py()
                number, first, last, value = (np.concatenate([np.frombuffer(r[c], t).astype(np.int64) for r in runs]) for c, t in (("numbers", "<u4"), ("firsts", "<u4"), ("lasts", "<u4"), ("values", np.int64)))
                # Runs of a piece for each of its occurrences in documents behind the first.
                at = np.argsort(p.piece, kind="stable")
                begin = np.searchsorted(p.piece[at], np.arange(len(p.some) + 1))
                count = np.diff(begin)[number]
                r = np.repeat(np.arange(len(number)), count)
                o = at[begin[number][r] + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)]
                ok = p.docs[p.doc[o]] > value[r]
                r, o = r[ok], o[ok]
                edge = np.bincount(p.first[o] + first[r], minlength=len(p.text) + 1) - np.bincount(p.first[o] + last[r] + WINDOW, minlength=len(p.text) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                starts, ends = texts.runs(gone, p.off)
                doc = np.searchsorted(p.off, starts, "right") - 1
                hit = np.unique(doc)
                out = []
                for d in hit.tolist():
                    a, z = p.off[d], p.off[d + 1]
                    own = doc == d
                    lost = gone[a:z]
                    out.append((int(p.rows[d]), int(lost.sum()), int(own.sum()), hashlib.sha256(p.text[a:z][~lost].tobytes()).hexdigest(), (starts[own] - a).tolist(), (ends[own] - a).tolist()))
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["row", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return cut.join(lists.hint("merge"), "block").select(*_ROW, "runs").mapInArrow(apply, "row long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>")


def dedup(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (removed spans, in bytes) of every row."""
    spark = docs.sparkSession
    work.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    doubled = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if doubled:
        # doc_id does not name rows: they are numbered, and written so that the numbers hold.
        rows = work.written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered", compression="zstd")
    else:
        rows = rows.withColumn("row", F.col("doc_id"))
    digests = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.md5("text")).alias("md5"), F.sha2("text", 256).alias("sha"))
    digests = work.written(digests, "digests", compression="zstd")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row")
    firsts = work.written(digests.groupBy("md5").agg(F.min(order).alias("first")), "firsts", compression="zstd")
    size = digests.agg(F.sum("n_bytes")).first()[0] or 0
    hot, diverse = (spark.sparkContext.broadcast(x) for x in frequent(rows))
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    places = shared(tagged, hot, max(LEAST_BUCKETS, -(-size // ASK_BYTES)))
    places = places.join(firsts.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi")
    cut = blocks(rows, places, hot)
    size = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeats(cut, diverse, max(LEAST_BUCKETS, -(-size // SORT_BYTES)))
    lost = work.written(removed(cut, found, diverse), "removed", compression="zstd")
    every = digests.join(firsts.hint("merge"), "md5").join(lost.withColumnRenamed("row", "first_row").hint("merge"), F.col("first.row") == F.col("first_row"), "left")
    behind = (F.coalesce("doc_id", F.lit(_LAST)) > F.col("first.doc")) & (F.col("n_bytes") >= WINDOW)
    none = F.expr("cast(array() as array<int>)")
    return every.select(
        "row", "doc_id", "n_bytes",
        F.when(behind, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(behind, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(behind, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(behind, F.array(F.lit(0))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(behind, F.array(F.col("n_bytes").cast("int"))).otherwise(F.coalesce("ends", none)).alias("ends"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(work.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
