"""Secret scans: three patterns, and a battery of randomness tests for what patterns do not name.

Only DataFrame functions run here. Matches are found by regexp_extract_all with \\G, which yields each match and
what stands before it; running sums of their lengths are the places, in code points.

The battery takes runs of 20 or more characters of [A-Za-z0-9+/_=-] and infers their encoding (hex, base 32,
base 36, base 62, base 64 and its URL form; decimal numbers are none). Under randomness in that encoding three
tests give p-values: chi-squared uniformity over the alphabet (with the statistic's exact first three moments, since
tokens are shorter than their alphabets), runs about the alphabet's middle, and serial correlation of neighbours.
The last two look at the same order of characters, so the smaller of them, doubled, stands for both, and Fisher's
method combines it with the first. The Benjamini-Hochberg procedure over the combined p-values of all tokens, weighted by
length, tells which tokens are not random: of those that it rejects at most FDR are random after all. A longer token
has a larger weight, since the tests see more of it. What it leaves is random, or too short to tell, so a second
control decides what is reported: how far a token is from ordinary text is the likelihood ratio of the uniform
alphabet against the character distribution of the rejected tokens; under "ordinary text" 1 / ratio is a valid
p-value by Markov's inequality, and longer tokens can reach smaller ones. The same procedure over the tokens left,
weighted by length, keeps the rate of false findings under FDR. Its step needs ranks over all tokens: both times they
are taken from a histogram of p-values, which has a bounded number of bins at any size of the corpus.

Defined cases: a null or empty text has no spans; findings that overlap a pattern's span are not added; rows
are told apart by a row number, so repeated documents keep a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import work

FDR = 1e-3
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern, a cheap test for texts that can't match, and the least length of the match or of its group 1.
_PATTERNS = (
    (_ASSIGN, r"(?i:password|passwd|secret|token|api_?key)", 12),
    (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 18),
    (r"[0-9a-f]+", r"[0-9a-f]{16}", 16),
    (r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}", 20),
)
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: pattern and alphabet.
_ENCODINGS = (
    ("[0-9]+", None),
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[a-z0-9]+", _DIGITS + _LOWER),
    ("[A-Z0-9]+", _DIGITS + _UPPER),
    ("[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)
_SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/_-="
#: Characters of a token that are taken apart at once.
_PIECE = 4096
#: Sums over a token's codes and over pairs of neighbours, in one pass that goes on from piece to piece.
_SUMS = f"""
aggregate(
  regexp_extract_all(body, '(?s).{{1,{_PIECE}}}', 0),
  named_struct('last', -1D, 'total', 0D, 'square', 0D, 'product', 0D, 'turns', 0D, 'above', 0D),
  (so_far, piece) -> aggregate(
    transform(filter(split(piece, ''), c -> c <> ''), c -> cast(instr(alphabet, c) - 1 as double)),
    so_far,
    (a, c) -> named_struct(
      'last', c,
      'total', a.total + c,
      'square', a.square + c * c,
      'product', a.product + if(a.last < 0, 0D, a.last * c),
      'turns', a.turns + if(a.last >= 0 and (a.last >= size / 2) <> (c >= size / 2), 1D, 0D),
      'above', a.above + if(c >= size / 2, 1D, 0D))))
"""
#: Bytes of a token while one symbol after the other is taken out of it: before each, and at the end.
_LENGTHS = f"""
aggregate(
  filter(split('{_SYMBOLS}', ''), c -> c <> ''),
  named_struct('rest', value, 'sizes', cast(array() as array<int>)),
  (a, c) -> named_struct('rest', replace(a.rest, c), 'sizes', concat(a.sizes, array(octet_length(a.rest)))),
  a -> concat(a.sizes, array(octet_length(a.rest))))
"""
#: Histogram of p-values: bins for each power of ten, and the last bin.
_PER_TEN, _LAST = 20, 20 * 300


def found(docs: DataFrame) -> DataFrame:
    """row, doc_id and for each kind an array of (before, long, value): what precedes a match, its length, and the
    length of its value (for the battery, the token itself)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = []
    for kind, (pattern, test, _) in zip(KINDS, _PATTERNS):
        # Only the battery's and the hex pattern repeat a class, so their short runs may be passed over at once.
        own = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}.get(kind, pattern)
        whole = F.lit(rf"\G(?s:(.*?))({own})")
        before = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), lambda s: F.length(s))
        match = F.regexp_extract_all(text, whole, F.lit(2))
        value = F.regexp_extract_all(text, whole, F.lit(3)) if kind == "assign" else match
        columns.append(F.when(text.rlike(test), F.arrays_zip(before.alias("before"), F.transform(match, lambda s: F.length(s)).alias("long"), value.alias("value"))).alias(kind))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), *columns)


def spans(rows: DataFrame) -> DataFrame:
    """row, kind, start, end, value: one row per match that is long enough; places in code points."""
    out = None
    for number, (kind, (_, _, least)) in enumerate(zip(KINDS, _PATTERNS)):
        each = rows.where(F.col(kind).isNotNull()).select("row", F.lit(number).alias("kind"), F.posexplode(kind).alias("k", "m"))
        each = each.select("row", "kind", "k", F.col("m.before").alias("before"), F.col("m.long").alias("long"), F.col("m.value").alias("value"), F.lit(least).alias("least"))
        out = each if out is None else out.unionByName(each)
    up_to = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("end", F.sum(F.col("before") + F.col("long")).over(up_to))
    out = out.where(F.length("value") >= F.col("least"))
    return out.select("row", "kind", (F.col("end") - F.col("long")).alias("start"), "end", "value")


def _upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution: a rational approximation good to 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def _gamma_tail(y: Column, skew: Column) -> Column:
    """Upper tail of a gamma distribution with mean 0, variance 1 and this skewness: Wilson and Hilferty's cube root."""
    a = 4 / (skew * skew)
    root = F.cbrt(F.greatest(F.lit(0.0), 1 + y / F.sqrt(a)))
    return _upper_tail((root - (1 - 1 / (9 * a))) * 3 * F.sqrt(a))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds size (of the alphabet, null if no encoding fits), n, counts (of each of _SYMBOLS), chi, runs, serial
    (p-values) and random (combined). Tokens are read in pieces, so one of many megabytes is never an array of characters."""
    body = F.regexp_replace("value", "=+$", "")
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(_ENCODINGS):
        alphabet = F.when(F.col("body").rlike(f"^(?:{pattern})$"), F.lit(letters).cast("string")).otherwise(alphabet)
    t = tokens.withColumn("body", body).withColumn("alphabet", alphabet)
    t = t.withColumn("size", F.length("alphabet").cast("double")).withColumn("n", F.length("body").cast("double"))
    t = t.withColumn("counts", F.expr(_LENGTHS)).withColumn("counts", F.expr("zip_with(slice(counts, 1, size(counts) - 1), slice(counts, 2, size(counts) - 1), (a, b) -> a - b)"))
    # A body holds no "=", the last of the symbols.
    t = t.withColumn("squares", F.aggregate(F.slice("counts", 1, len(_SYMBOLS) - 1), F.lit(0.0), lambda a, c: a + F.pow(c, F.lit(2))))
    t = t.withColumn("sums", F.when(F.col("alphabet").isNotNull(), F.expr(_SUMS))).withColumn("first", F.expr("cast(instr(alphabet, left(body, 1)) - 1 as double)"))
    t = t.select("*", *[F.col(f"sums.{c}").alias(c) for c in ("last", "total", "square", "product", "turns", "above")])
    n, k = F.col("n"), F.col("size")
    # The statistic counts pairs of equal characters, each pair of places equal with chance 1 / k: their number's
    # mean, variance and third moment are known, and it moves by whole numbers.
    equal, share = (F.col("squares") - n) / 2, 1 / k
    places = n * (n - 1) / 2
    variance = places * share * (1 - share)
    third = variance * (1 - 2 * share) + n * (n - 1) * (n - 2) * share * share * (1 - share)
    chi = _gamma_tail((equal - 0.5 - places * share) / F.sqrt(variance), third / F.pow(variance, 1.5))
    below = n - F.col("above")
    mean_runs = 1 + 2 * F.col("above") * below / n
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    # All on one side: as many runs too few as there can be.
    z_runs = F.when(var_runs > 0, (F.col("turns") + 1 - mean_runs) / F.sqrt(var_runs)).otherwise(-F.sqrt(n))
    # Sums about the mean, times n, from plain sums of whole numbers.
    total = F.col("total")
    spread = n * F.col("square") - total * total
    product = n * F.col("product") - total * (2 * total - F.col("first") - F.col("last")) + (n - 1) / n * total * total
    z_serial = F.when(spread > 0, (product / spread + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    t = t.withColumn("chi", chi).withColumn("runs", F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z_runs)))).withColumn("serial", F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z_serial))))
    order = F.least(F.lit(1.0), 2 * F.least("runs", "serial"))
    half = -(F.log("chi") + F.log(order))
    t = t.withColumn("random", F.when(F.col("alphabet").isNotNull(), F.exp(-half) * (1 + half)))
    return t.drop("alphabet", "squares", "sums", "first", "last", "total", "square", "product", "turns", "above")


def rejected(tested: DataFrame, log10_p: Column, rate: float = FDR) -> tuple[DataFrame, int]:
    """tested with `bin` (of its p-value, null where there is none), and the least bin that the weighted
    Benjamini-Hochberg procedure rejects at `rate`. Weights are lengths, with mean 1, so that it keeps its bound;
    p-values are rounded up to their bin's edge."""
    mean = tested.where(log10_p.isNotNull()).agg(F.avg("n")).first()[0]
    if mean is None:
        return tested.withColumn("bin", F.lit(None).cast("int")), _LAST + 1
    scaled = F.least(F.lit(0.0), log10_p - F.log10(F.col("n") / mean))
    binned = tested.withColumn("bin", F.least(F.lit(_LAST), F.floor(-scaled * _PER_TEN)).cast("int"))
    counts = dict(binned.where("bin is not null").groupBy("bin").count().collect())  # at most _LAST + 1 rows, whatever the input
    many, rank, least = sum(counts.values()), 0, _LAST + 1
    for edge in sorted(counts, reverse=True):
        rank += counts[edge]
        if 10 ** (-edge / _PER_TEN) * many <= rate * rank:
            least = edge
    return binned, least


def ordinary(plain: DataFrame) -> dict[str, float]:
    """Character frequencies of tokens that are not random: one row per symbol returns. A prior that expects
    letters stands in for what a small corpus does not show."""
    sums = plain.agg(*[F.sum(F.element_at("counts", k + 1).cast("long")).alias(f"c{k}") for k in range(len(_SYMBOLS))]).first()
    seen = {c: n or 0 for c, n in zip(_SYMBOLS, sums)}
    prior = {c: 50.0 if c in _LOWER else 2.0 for c in _SYMBOLS}
    total = sum(seen.values()) + sum(prior.values())
    return {c: (seen[c] + prior[c]) / total for c in _SYMBOLS}


def findings(tested: DataFrame) -> DataFrame:
    """The rows of `battery` that are found to be secrets: not rejected as random, and far from ordinary text."""
    binned, least = rejected(tested, F.log10("random"))
    plain = binned.where(F.col("bin").isNull() | (F.col("bin") >= least))
    logs = F.array(*[F.lit(math.log(q) if c != "=" else 0.0) for c, q in ordinary(plain).items()])
    own = binned.where(F.col("bin") < least).drop("bin")
    log_ratio = -F.col("n") * F.log("size") - F.aggregate(F.zip_with("counts", logs, lambda c, q: c * q), F.lit(0.0), lambda a, x: a + x)
    binned, least = rejected(own, -log_ratio / math.log(10))
    return binned.where(F.col("bin") >= least).drop("bin")


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans: array of (start, kind, end) by start, then kind, of patterns and findings."""
    rows = work.written(found(docs), "secret-rows")
    every = work.written(spans(rows), "secret-spans")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") < 3
    marked = every.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    free = marked.where("kind = 3 and coalesce(reach, 0) <= start and coalesce(next, end) >= end")
    tested = work.written(battery(free.select("row", "kind", "start", "end", "value")), "secret-battery")
    kept = every.where(base).select("row", "kind", "start", "end").unionByName(findings(tested).select("row", "kind", "start", "end"))
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return rows.select("row", "doc_id").join(lists.hint("merge"), "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(work.documents(spark, sf_dir)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
        count(3).alias("n_random"),
    )
