"""Index statistics, freshness, latency summaries and the country x city x query quality matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars, text
from ..sources.store import sized, written


def terms_count(docs: DataFrame, field: str, size: int = 20) -> DataFrame:
    return docs.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(size)


def breakdown(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, count for several fields in one pass, as grouping sets; null values are left out."""
    sets = docs.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    n = len(fields)
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, f in enumerate(fields):
        own = F.col("g") == (1 << n) - 1 - (1 << (n - 1 - k))
        field, value = F.when(own, f).otherwise(field), F.when(own, F.col(f).cast("string")).otherwise(value)
    return sets.select(field.alias("field"), value.alias("value"), "count").where("value is not null")


def category_counts(docs: DataFrame, ids: DataFrame, category: str = "category_ids") -> DataFrame:
    """Documents of each id in ids.category_id, 0 if none: one pass for all."""
    n = docs.select(F.explode(F.array_distinct(category)).alias("category_id")).groupBy("category_id").agg(F.count(F.lit(1)).alias("count"))
    return ids.select("category_id").join(n.hint("merge"), "category_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def status_counts(docs: DataFrame, field: str) -> DataFrame:
    return docs.groupBy(F.coalesce(field, F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def sample(docs: DataFrame, by: str, n: int, order: str = "_id") -> DataFrame:
    return docs.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= n)


#: Bins of one round of a selection.
BINS = 1 << 14


def percentiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """by and one column for each quantile: nearest-rank percentiles of the finite values of each group that has some.

    Found by selection, without a group's values in one place: a group's range is cut into bins that are counted where
    the rows are; the bin with the wanted rank gives the next range, from its least to its largest value, until these
    are equal. A round's state is a row for each group and bin that it has values in.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    key = F.to_json(F.struct(*by)).alias("g")  # one key that is never null
    each = written(rows.where(finite).select(F.struct(*by).alias("by"), key, F.col(value).cast("double").alias("v")))
    ranges = each.groupBy("g").agg(F.first("by").alias("by"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()]))
    ranges = ranges.select("g", "by", "low", "high", "n", names.alias("t")).select("g", "by", "t.name", "low", "high", F.greatest(F.lit(1), F.ceil(F.col("t.q") * F.col("n"))).cast("long").alias("nth"))
    ranges = written(ranges)
    while not ranges.where("low < high").isEmpty():
        # Quantiles of a group that have one range still are counted together.
        open_ = ranges.where("low < high").select("g", "low", "high").distinct()
        met = each.drop("by").join(sized(open_), "g").where(F.col("v").between(F.col("low"), F.col("high")))
        at = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)).cast("int")
        bins = met.groupBy("g", "low", "high", at.alias("bin")).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        found = ranges.join(bins.hint("merge"), ["g", "low", "high"]).where((F.col("nth") <= F.col("upto")) & (F.col("nth") > F.col("upto") - F.col("n")))
        found = found.select("g", "by", "name", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("nth") - F.col("upto") + F.col("n")).alias("nth"))
        ranges = written(ranges.where("low >= high").unionByName(found))
    out = ranges.groupBy("g").agg(F.first("by").alias("by"), *[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in quantiles])
    return out.select("by.*", *quantiles)


def latency(requests: DataFrame, by: list[str], value: str = "latency_ms", where: Column | None = None) -> DataFrame:
    """count, p50, p95, p99, max: nearest-rank percentiles, 0 for an empty group."""
    on = F.lit(True) if where is None else where
    r = requests.withColumn("__v", F.when(on, F.col(value)))
    all_ = r.groupBy(*by).agg(F.count("__v").alias("count"), F.max("__v").alias("max"))
    found = percentiles(r, by, "__v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*[F.col(c).alias(f"__{c}") for c in by], "p50", "p95", "p99")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return all_.join(found.hint("merge"), same, "left").select(*by, "count", zero("p50"), zero("p95"), zero("p99"), zero("max"))


def phases(requests: DataFrame) -> DataFrame:
    """latency by endpoint for all counted, cold, warm and warm-up requests."""
    views = {"all": F.col("counted"), "cold": F.col("counted") & F.col("cold_start"), "warm": F.col("counted") & ~F.col("cold_start"), "warm_up": ~F.col("counted")}
    each = requests.select("endpoint", "latency_ms", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("on")) for k, v in views.items()])).alias("v"))
    return latency(each.select("endpoint", "latency_ms", "v.view", "v.on"), ["endpoint", "view"], where=F.col("on"))


def cold_start(requests: DataFrame, seq: str) -> DataFrame:
    """Adds cold_start: the request is its endpoint's first. One row for each endpoint is joined back."""
    first = requests.groupBy("endpoint").agg(F.min(seq).alias("__first"))
    return requests.join(sized(first), "endpoint", "left").withColumn("cold_start", F.col(seq).eqNullSafe(F.col("__first"))).drop("__first")


def slowest(requests: DataFrame, n: int = 10, id_: str = "event_id") -> DataFrame:
    return requests.orderBy(F.desc("latency_ms"), id_).limit(n)


def per_query(samples: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """Requests, failures, requests without results, first successful top hit and the first mismatches of each query.
    Sums are taken in every task first; mismatches are ranked with a limit that Spark applies before the exchange."""
    ok = F.col("ok")
    bad = ok & ~F.col("top_country").eqNullSafe(F.col("country"))
    empty = ok & (F.col("result_count") == 0) if "result_count" in samples.columns else F.lit(False)
    sums = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~ok).alias("failures"), F.count_if(empty).alias("empty"), F.min_by(F.when(ok, F.col("top_label")), F.when(ok, F.col("seq"))).alias("top_label"), F.count_if(bad).alias("mismatches"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    few = samples.where(bad).select(*by, "seq", "top_country").withColumn("nth", nth).where(F.col("nth") <= most)
    shown = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "top_country"))).alias("first_mismatches"))
    none = F.array().cast("array<struct<seq:bigint,top_country:string>>")
    return sums.join(shown.hint("merge"), by, "left").withColumn("first_mismatches", F.coalesce("first_mismatches", none))


def missing_ratio(docs: DataFrame, field: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(field).isNull()).alias("missing")).withColumn("ratio", F.coalesce(F.col("missing") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def stale(state: DataFrame, thresholds: DataFrame, as_of: Column, default: int = 86400) -> DataFrame:
    """Adds age_seconds, threshold and stale: no success, or older than the source's threshold."""
    s = state.join(thresholds, "source", "left").withColumn("threshold", F.coalesce("stale_after_seconds", F.lit(default)))
    s = s.withColumn("age_seconds", scalars.staleness(as_of, F.col("last_success")))
    return s.withColumn("stale", F.col("last_success").isNull() | F.coalesce(F.col("age_seconds") > F.col("threshold"), F.lit(False))).drop("stale_after_seconds")


def tasks(countries: DataFrame) -> DataFrame:
    """country, city, query, endpoint: all combinations of each country's cities and queries."""
    out = countries.select("country", F.explode("cities").alias("city"), "queries")
    out = out.select("country", "city", F.explode("queries").alias("query"))
    return out.select("*", F.explode(F.array(F.lit("search"), F.lit("autocomplete"))).alias("endpoint"))


def run_tasks(tasks: DataFrame, index, dims: tuple, size: int = 5) -> DataFrame:
    """tasks (query_id, country, city, query, endpoint) with result_count, top_country and top_label of their searches:
    each query is asked for in its city and filtered by its country, by search or by autocomplete."""
    from . import geocode

    words = text.normalize(tasks.select("query_id", "endpoint", "country", F.concat_ws(" ", "query", "city").alias("text")), "text")
    asked = written(words.select("query_id", "endpoint", "normalized", "tokens", "country"))
    found = None
    for endpoint, run in (("search", geocode.find), ("autocomplete", geocode.complete)):
        hits = run(asked.where(F.col("endpoint") == endpoint).drop("endpoint"), index, dims, size)
        one = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"), F.min_by("country_a", "rank").alias("top_country"), F.min_by("name", "rank").alias("top_label"))
        found = one if found is None else found.unionByName(one)
    out = tasks.join(found.hint("merge"), "query_id", "left")
    return out.withColumn("result_count", F.coalesce("result_count", F.lit(0)))


def failures(per: DataFrame, summary: DataFrame, limits: dict[str, float], missing: DataFrame | None = None, most_missing: float = 0.05) -> DataFrame:
    """code, endpoint, detail: failed requests, requests without results, mismatches, 95th percentiles over the
    endpoints' limits (0 is none), and a share of documents without a country (missing_ratio) over its limit."""
    out = [
        per.where("empty > 0 and failures < requests").select(F.lit("zero_results").alias("code"), "endpoint", F.col("empty").cast("double").alias("detail")),
        per.where("failures > 0").select(F.lit("request_failed").alias("code"), "endpoint", F.col("failures").cast("double").alias("detail")),
        per.where("mismatches > 0").select(F.lit("country_filter_mismatch").alias("code"), "endpoint", F.col("mismatches").cast("double").alias("detail")),
    ]
    for endpoint, most in limits.items():
        over = summary.where((F.col("endpoint") == endpoint) & (F.col("p95") > most) & F.lit(most > 0))
        out.append(over.select(F.lit(f"{endpoint}_p95_latency_exceeded").alias("code"), "endpoint", F.col("p95").cast("double").alias("detail")))
    if missing is not None:
        over = missing.where(F.col("ratio") > most_missing)
        out.append(over.select(F.lit("missing_country_ratio_exceeded").alias("code"), F.lit("index-stats").alias("endpoint"), F.col("ratio").alias("detail")))
    return reduce(lambda a, b: a.unionByName(b), out)


def index_stats(docs: DataFrame, layers: tuple[str, ...], by: list[str], reason: str = "admin_enrichment_reason", indexed: str = "indexed_at") -> DataFrame:
    """field, value, count: documents by layer (0 where a layer has none) and by each of `by`, the total, those with and
    without a country, why these have none, and the time of the last one indexed (as seconds)."""
    counts = breakdown(docs, ["layer", *by])
    zero = docs.sparkSession.createDataFrame([(x,) for x in layers], "value string").select(F.lit("layer").alias("field"), "value", F.lit(0).cast("long").alias("count"))
    counts = counts.unionByName(zero).groupBy("field", "value").agg(F.sum("count").alias("count"))
    lacks = F.col("country_a").isNull()
    last = F.unix_seconds(F.max(F.col(indexed).cast("timestamp"))) if indexed in docs.columns else F.lit(None).cast("long")
    sums = docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(~lacks).alias("with_country"), F.count_if(lacks).alias("missing_country"), last.alias("last_indexed"))
    sums = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit("all").alias("value"), F.col(c).alias("count")) for c in ("total", "with_country", "missing_country", "last_indexed")])).alias("x")).select("x.*")
    why = docs.where(lacks).groupBy(F.coalesce(reason, F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("count")) if reason in docs.columns else None
    out = counts.unionByName(sums)
    return out if why is None else out.unionByName(why.select(F.lit("missing_country_reason").alias("field"), "value", "count"))


def validated(queries: DataFrame, op: str = "search", size: int = 40, text_most: int = 256, field_most: int = 128, radius_most: float = 50_000.0) -> DataFrame:
    """Adds error (invalid_request or null) and parameter, the first one that is wrong, for columns of raw strings."""
    raw = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) if c in queries.columns else F.lit(None).cast("string")

    def number(c: str, low: float, high: float, whole: bool = False):
        x = raw(c).try_cast("double")
        good = x.isNotNull() & ~F.isnan(x) & x.between(low, high) & ((x == F.floor(x)) if whole else F.lit(True))
        return raw(c).isNotNull() & ~F.coalesce(good, F.lit(False))

    checks: list[tuple[Column, str]] = []
    some = lambda *cs: reduce(lambda a, b: a | b, [raw(c).isNotNull() for c in cs])
    every = lambda *cs: reduce(lambda a, b: a & b, [raw(c).isNotNull() for c in cs])
    if op in ("reverse", "nearby"):
        for c, m in (("point.lat", 90.0), ("point.lon", 180.0)):
            checks += [(raw(c).isNull(), c), (number(c, -m, m), c)]
    if op != "reverse":
        rect, circle = ("rect.min_lon", "rect.max_lon", "rect.min_lat", "rect.max_lat"), ("circle.lat", "circle.lon", "circle.radius")
        checks += [(number(c, *((-180.0, 180.0) if "lon" in c else (-90.0, 90.0))), c) for c in rect] + [(some(*rect) & ~every(*rect), "boundary.rect")]
        f = lambda c: raw(c).try_cast("double")
        checks += [(F.coalesce((f(rect[0]) > f(rect[1])) | (f(rect[2]) > f(rect[3])), F.lit(False)), "boundary.rect")]
        checks += [(number(circle[0], -90.0, 90.0), circle[0]), (number(circle[1], -180.0, 180.0), circle[1]), (number(circle[2], 0.001, 5e7), circle[2]), (some(*circle) & ~every(*circle), "boundary.circle")]
    if op in ("search", "structured"):
        checks += [(raw("focus.lat").isNull() != raw("focus.lon").isNull(), "focus.point"), (number("focus.lat", -90.0, 90.0), "focus.lat"), (number("focus.lon", -180.0, 180.0), "focus.lon")]
    checks += [(number("size", 1, size, True), "size")]
    if op == "search":
        checks += [(F.coalesce(F.length(raw("text")) > text_most, F.lit(False)), "text"), (F.coalesce(F.trim(raw("text")) == "", F.lit(True)), "text")]
    if op in ("reverse", "nearby"):
        checks += [(number("radius", 0.001, radius_most), "radius")]
    if op == "nearby":
        checks += [(F.coalesce(~raw("sort").isin("distance", "relevance", "hybrid"), F.lit(False)), "sort"), (F.coalesce(~raw("category_mode").isin("any", "all"), F.lit(False)), "category_mode"), (F.coalesce(~F.lower(raw("include_distance")).isin("true", "1", "yes", "false", "0", "no"), F.lit(False)), "include_distance")]
    if op == "structured":
        fields = [c for c in ("address", "neighbourhood", "borough", "locality", "county", "region", "postalcode", "country", "street", "housenumber") if c in queries.columns]
        blank = [F.coalesce(F.trim(raw(c)) == "", F.lit(True)) for c in fields]
        checks += [(reduce(lambda a, b: a & b, blank, F.lit(True)), "fields")] + [(F.coalesce(F.length(raw(c)) > field_most, F.lit(False)), c) for c in fields]
    first = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        first = F.when(bad, name).otherwise(first)
    return queries.withColumn("parameter", first).withColumn("error", F.when(F.col("parameter").isNotNull(), "invalid_request"))


def clean_parameters(parameters: Column, allowed: list[str]) -> Column:
    return F.map_filter(parameters, lambda k, v: k.isin(*allowed) & v.isNotNull() & (v != ""))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each section of a report."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
