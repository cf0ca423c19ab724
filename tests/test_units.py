"""Operators on small inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import dedupe, enrich, geocode, intent, places, quality, rank, search, spatial, sync
from waymark.sources.spec import SourceSpec
from waymark.sources.store import written

NORMAL = [
    ("مُحَمَّد", "ar", "محمد"),
    ("مدينة", "ar", "مدينة"),
    ("أحمد إبراهيم آمنة", "ar", "احمد ابراهيم امنة"),
    ("مصطفى", "ar", "مصطفي"),
    ("مؤسسة شاطئ", "ar", "موسسة شاطي"),
    ("كـــرادة", "ar", "كرادة"),
    ("شارع ١٢٣", "ar", "شارع 123"),
    ("شارع ۱۲۳", "ar", "شارع 123"),
    ("گەڕەک", "ckb", "كەڕەك"),
    ("الكراده", "ar", "الكرادة"),
    ("Baghdad  CITY!", "en", "baghdad city!"),
    ("ﬁne ＡＢＣ", "en", "fine abc"),
    ("٪50", "ar", "50"),
    ("", "en", ""),
    (None, "en", ""),
    ("   ", "en", ""),
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(NORMAL)], "i int, text string, lang string, want string")
    for r in text.normalize(df, "text", "lang").collect():
        assert r.normalized == r.want
        assert r.tokens == r.want.split()
    rules = {r.i: r.applied_rules for r in text.normalize(df, "text", "lang").collect()}
    assert "remove_tatweel" in rules[5] and "arabic_digits_to_latin" in rules[6] and rules[10] == ["lowercase"]


def test_three_forms_differ(spark):
    one = spark.createDataFrame([("گَ Ab٣",)], "t string").select(text.index_term(F.col("t")).alias("a"), text.alias_form(F.col("t")).alias("b")).first()
    assert (one.a, one.b) == ("گ ab3", "گ ab٣")


def test_radius_join_finds_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(60, 61, 150), rng.uniform(179.5, 180.5, 150)))]
    p = [(i, a, b - 360 if b > 180 else b) for i, a, b in p]
    q = [(i, a, b, 20_000.0) for i, (_, a, b) in enumerate(p[:25])] + [(99, float("nan"), 0.0, 100.0), (98, None, 0.0, 100.0)]
    docs, asks = spark.createDataFrame(p, "_id string, lat double, lon double"), spark.createDataFrame(q, "query_id int, q_lat double, q_lon double, radius double")
    got = {(r.query_id, r._id) for r in spatial.radius_join(asks, docs).collect()}
    d = geo.haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    want = {(r.query_id, r._id) for r in asks.where("query_id < 98").crossJoin(docs).where(d <= F.col("radius")).collect()}
    assert got == want and len(want) > 25


def test_polygons(spark):
    sq = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    areas = spark.createDataFrame(
        [(1, [sq(0.0, 0.0, 1.0, 1.0)]), (2, [sq(2.0, 0.0, 6.0, 4.0), sq(3.0, 1.0, 5.0, 3.0)]), (3, [[(0.0, 5.0), (4.0, 5.0), (4.0, 9.0), (2.0, 6.0), (0.0, 9.0)]]), (4, [sq(10.0, 0.0, 11.0, 1.0), sq(12.0, 0.0, 13.0, 1.0)])],
        "area_id int, rings array<array<struct<x: double, y: double>>>",
    )
    pts = {"in": (0.5, 0.5, 1), "edge": (1.0, 0.5, 1), "corner": (0.0, 0.0, 1), "out": (1.5, 0.5, None), "hole": (4.0, 2.0, None), "rim": (2.5, 2.0, 2), "hole edge": (3.0, 2.0, 2), "notch": (2.0, 7.0, None), "leg": (0.5, 7.0, 3), "two": (12.5, 0.5, 4), "gap": (11.5, 0.5, None)}
    points = spark.createDataFrame([(k, x, y) for k, (x, y, _) in pts.items()], "_id string, lon double, lat double")
    for size in (0.3, 7.0):
        got = {r._id: r.area_id for r in spatial.point_in_polygon(points, areas, size).collect()}
        assert got == {k: a for k, (_, _, a) in pts.items() if a}


def test_snaps_to_a_vertex_and_a_line_of_no_length(spark):
    roads = spark.createDataFrame([(1, [(44.0, 33.0), (44.01, 33.0), (44.01, 33.01)]), (2, [(45.0, 33.0)])], "road_id int, line array<struct<x: double, y: double>>")
    docs = spark.createDataFrame([("a", 33.0005, 44.005, "venue"), ("b", 33.0, 45.0001, "venue"), ("c", 40.0, 44.0, "venue"), ("d", 33.0, 44.0, "region")], "_id string, lat double, lon double, layer string")
    snapped = spatial.nearest_line(docs, spatial.segments(roads), 200.0)
    out = {r._id: r for r in enrich.routable(docs, snapped).collect()}
    assert out["a"].routable_status == "snapped" and out["a"].routable_lat == pytest.approx(33.0)
    assert out["b"].routable_status == "snapped" and out["b"].routable_lon == pytest.approx(45.0)
    assert (out["c"].routable_status, out["c"].routable_reason) == ("centroid_fallback", "no_road_found")
    assert out["d"].routable_status == "not_applicable"
    assert {r.routable_reason for r in enrich.routable(docs, None).collect()} == {"roads_source_not_configured", "layer_not_eligible"}


def test_rows_become_documents_or_quarantine(spark):
    spec = SourceSpec(name="osm_pois", layer="venue", id_field="osm_id", name_fields=("name", "name_en"), category_fields=("amenity",), layer_field="admin_level", layer_map={"8": "locality"})
    rows = spark.createDataFrame([("12345", " Naranj ", "Naranj R", "restaurant", None, 33.0, 44.0), (None, "x", None, None, None, 33.0, 44.0), ("7", "x", None, None, None, float("nan"), 44.0), ("8", None, "only en", None, None, 33.0, 44.0), ("9", "Town", None, None, "8", 33.0, 44.0)], "osm_id string, name string, name_en string, amenity string, admin_level string, _lat double, _lon double")
    good, bad = places.split(places.documents(rows, spec))
    docs = {r._id: r for r in places.index_documents(good).collect()}
    assert docs["postgis:osm_pois:12345"].name == {"default": "Naranj", "en": "Naranj R"}
    assert docs["postgis:osm_pois:12345"].category_ids == ["restaurant"]
    assert docs["postgis:osm_pois:9"].locality == "Town"
    assert sorted(r.error for r in places.quarantine(bad).collect()) == ["invalid_coordinates", "missing_id", "missing_name"]


TAXONOMY = {
    "intent_groups": {"food": {"names": {"en": "Food", "ar": "طعام"}, "aliases": {"en": ["eat"]}}},
    "categories": [
        {"id": "restaurant", "intent_groups": ["food"], "importance": 0.9, "names": {"en": "Restaurant", "ar": "مطعم"}, "aliases": {"en": ["dining room"]}, "osm_tags": [{"key": "amenity", "value": "restaurant"}]},
        {"id": "pharmacy", "parent": "health", "importance": 0.8, "names": {"en": "Pharmacy"}, "aliases": {}, "osm_tags": {"amenity": "pharmacy"}},
    ],
    "place_variants": [{"id": "baghdad", "terms": ["Baghdad", "Bagdad", "بغداد"]}],
}


def test_intent(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TAXONOMY))
    dims = intent.load_taxonomy(spark, str(tmp_path / "t.json"))
    asked = ["Bagdad restaurant", "naranj rest baghdad", "the dining room", "eat", "nothing here"]
    q = text.normalize(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), "text")
    got = {r.query_id: r for r in intent.resolve(q, dims["dim_term"], dims["dim_category"], dims["dim_place"]).collect()}
    assert got[0].category_ids == ["restaurant"] and set(got[0].place_terms) == {"baghdad", "bagdad", "بغداد"} and got[0].unmatched == "" and got[0].confidence == 1
    assert got[1].category_ids == ["restaurant"] and got[1].unmatched == "naranj rest"  # a token that only begins a term stays
    assert got[2].category_ids == ["restaurant"] and got[2].unmatched == "the"
    assert got[3].intent_groups == ["food"] and got[3].confidence == 0.65
    assert got[4].confidence == 0 and got[4].unmatched == "nothing here"
    docs = spark.createDataFrame([("a", {"amenity": "restaurant"}), ("b", {"amenity": "pharmacy", "shop": "toys"})], "_id string, source_tags map<string,string>")
    out = {r._id: r for r in intent.enrich_categories(docs, dims["dim_tag"], dims["dim_category"]).collect()}
    assert out["a"].category_ids == ["restaurant"] and out["b"].category_ids == ["pharmacy", "toys"] and out["b"].intent_groups == ["health"]


def test_wikidata_labels(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"id": "Q1", "labels": {"en": {"value": "Restaurant"}}, "aliases": {"en": [{"value": "dining"}, {"value": "Q123"}]}}))
    rows = intent.wikidata_labels(spark, str(tmp_path / "q.json"))
    assert rows.count() == 3
    safe = intent.safe_aliases(rows.select(F.lit("restaurant").alias("category_id"), F.col("value").alias("alias")), spark.createDataFrame([("restaurant", "restaurant")], "category_id string, alias string"))
    assert sorted(r.alias for r in safe.collect()) == ["dining", "restaurant"]


def test_fuzzy_tokens_equal_all_pairs(spark):
    words = ["baghdad", "bagdad", "bagdda", "cafe", "caffe", "caf", "ab", "abc", "restaurant", "restorant", "x"]
    long = ["internationale", "internationals", "nternational", "internatonals", "xinternationaley", "international" * 20, "international" * 19 + "internatonl", "twelveletter", "twelvelettersx", "elveletters"]
    words += long
    known = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r.token, r.match, r.edits) for r in search.fuzzy_tokens(known, known).collect()}
    pairs = known.crossJoin(known.withColumnRenamed("token", "match")).withColumn("edits", F.levenshtein("token", "match"))
    assert got == {(r.token, r.match, r.edits) for r in pairs.where(F.col("edits") <= search.allowed_edits(F.col("token"))).collect()}


def _hits(spark):
    rows = [(1, "g1", "s", "1", "venue", 33.0, 44.0, "Baghdad City", "a"), (2, "g1", "s", "9", "venue", 40.0, 44.0, "Other", "b"), (3, "g3", "s", "3", "venue", 33.0001, 44.0, "Baghdad", "c"), (4, "g4", "s", "4", "venue", 33.3, 44.0, "Baghdad", "d"), (5, "g5", "s", "5", "street", 33.00025, 44.0, "Baghdad", "e"), (6, "g6", "s", "6", "venue", 33.0, 44.0, "Different", "f")]
    return spark.createDataFrame([(1, *r) for r in rows], "query_id int, rank int, gid string, source string, source_id string, layer string, lat double, lon double, name string, _id string")


def test_duplicates_among_results(spark):
    out = dedupe.results(_hits(spark)).collect()
    assert [r._id for r in sorted(out, key=lambda r: r["rank"])] == ["a", "d", "e", "f"] and out[0].deduped_count == 2


def test_duplicate_classes(spark):
    docs = _hits(spark).withColumns({"confidence": F.lit(1.0), "has_routable": F.col("_id") == "c", "n_categories": F.lit(1), "distance": F.lit(0.0)})
    links = dedupe.pairs(docs)
    assert {(r.a, r.b) for r in links.collect()} == {("a", "b"), ("a", "c")}
    kept = dedupe.table(docs, links, written, dedupe.better(["name"]))
    assert sorted(r._id for r in kept.collect()) == ["c", "d", "e", "f"]
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "a string, b string")
    assert {r.label for r in dedupe.classes(chain, written).collect()} == {"n000"}


def test_versions(spark, tmp_path):
    v = sync.Versions(spark, f"file://{tmp_path}/index", "places_read")
    one = spark.createDataFrame([("a",), ("b",)], "_id string")
    assert v.current() is None and v.rollback("2024-01-01") is None
    first = v.write(one)
    assert v.publish(first, 2, 0, "2024-01-01T00:00:00")["valid"] and spark.table("places_read").count() == 2
    bad = v.write(one.where("false"))
    assert v.publish(bad, 2, 0, "2024-01-02T00:00:00")["problems"] == ["empty", "fewer_than_expected"] and v.current() == first
    third = v.write(one.limit(1))
    assert v.publish(third, 1, 0, "2024-01-03T00:00:00", F.col("_id") == "none")["problems"] == ["sample_query_without_hit"]
    assert v.publish(third, 1, 0, "2024-01-04T00:00:00")["valid"] and v.current() == third
    assert v.rollback("2024-01-05T00:00:00", dry_run=True) == first and v.current() == third
    assert v.rollback("2024-01-05T00:00:00") == first and v.current() == first and spark.table("places_read").count() == 2
    assert v.verify(one, lambda df: df.count()) == 2 and v.numbers() == [1, 2, 3]


def test_guards(spark):
    c = spark.createDataFrame([("a", 200, 99, None, None), ("b", 200, 100, None, None), ("c", 99, 0, None, None), ("d", 200, 0, None, True), ("e", 200, 150, 0.2, None)], "source string, previous int, current int, max_drop_ratio double, allow_count_drop boolean")
    assert [r.source for r in sync.count_drop(c).where("violation is not null").collect()] == ["a", "e"]
    f = spark.createDataFrame([("a", 100, 1), ("b", 100, 2), ("c", 0, 0), ("d", 0, 1)], "source string, read int, failed int")
    assert [r.source for r in sync.failure_ratio(f).where("violation is not null").collect()] == ["b", "d"]


def test_nearest_rank_percentiles(spark):
    r = spark.createDataFrame([("search", float(x)) for x in (5, 10, 20)] + [("none", None)], "endpoint string, latency_ms double")
    got = {x.endpoint: x for x in quality.latency(r, ["endpoint"]).collect()}
    assert (got["search"].p50, got["search"].p95, got["none"].p95, got["none"]["count"]) == (10.0, 20.0, 0.0, 0)


def test_validation(spark):
    q = spark.createDataFrame([(1, "cafe", None, None, None), (2, " ", None, None, None), (3, "x", "41", None, None), (4, "x", "5", "33", None), (5, "x" * 257, None, None, None), (6, "x", "1.5", None, None), (7, "x", "NaN", "95", "44")], "query_id int, text string, size string, `focus.lat` string, `focus.lon` string")
    assert {r.query_id: r.parameter for r in quality.validated(q).collect()} == {1: None, 2: "text", 3: "size", 4: "focus.point", 5: "text", 6: "size", 7: "focus.lat"}


def test_radius_join_of_any_radius(spark):
    docs = spark.createDataFrame([("a", 33.0, 44.0), ("b", 33.5, 44.0), ("c", 40.0, 60.0), ("d", -33.0, -136.0)], "_id string, lat double, lon double")
    asks = spark.createDataFrame([(1, 33.0, 44.0, 1000.0), (2, 33.0, 44.0, 60_000.0), (3, 33.0, 44.0, 3_000_000.0), (4, 33.0, 44.0, 2.1e7), (5, 33.0, 44.0, 0.0)], "query_id int, q_lat double, q_lon double, radius double")
    got = sorted((r.query_id, r._id) for r in spatial.radius_join(asks, docs).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (4, "d"), (5, "a")]


def test_nearby_by_categories(spark):
    hits = spark.createDataFrame([(1, "a", "venue", 5.0, ["x", "y"]), (1, "b", "venue", 2.0, ["x"]), (1, "c", "venue", 1.0, ["z"]), (1, "d", "venue", 9.0, None)], "query_id int, _id string, layer string, distance double, category_ids array<string>")
    wanted = F.array(F.lit("x"), F.lit("y"))
    ids = lambda **k: [r._id for r in sorted(rank.nearby(hits, categories=wanted, **k).collect(), key=lambda r: r["rank"])]
    assert ids() == ["b", "a"] and ids(mode="all") == ["a"] and ids(sort="relevance") == ["a", "b"]


def test_terms_and_places_of_several_words(spark):
    term = spark.createDataFrame([("category", "shop", "very old book and record shop of the town"), ("category", "hotel", "grand hotel"), ("category", "sea", "sea")], "type string, id string, term string")
    place = spark.createDataFrame([("ny", "new york"), ("ny", "nyc"), ("er", "erbil")], "variant string, term string")
    asked = ["hotel new york", "a very old book and record shop of the town here", "the grand hotels", "nyc", "newyork", "erbil"]
    q = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(asked)], "query_id int, normalized string, tokens array<string>")
    assert {(r.query_id, r.id) for r in intent.matched_terms(q, term).collect()} == {(1, "shop"), (2, "hotel")}
    assert sorted((r.query_id, r.term) for r in intent.place_terms(q, place).collect()) == [(0, "new york"), (0, "nyc"), (3, "new york"), (3, "nyc"), (5, "erbil")]


def test_prefixes_longer_than_the_join_key(spark):
    known = spark.createDataFrame([("a" * 30,), ("a" * 25 + "b",), ("ab",)], "token string")
    asked = spark.createDataFrame([("a" * 30,), ("a" * 22,), ("a",)], "token string")
    assert sorted((len(r.token), len(r.match)) for r in search.prefix_tokens(asked, known).collect()) == [(1, 2), (1, 26), (1, 30), (22, 26), (22, 30), (30, 30)]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("a", "Baghdad Mall", "baghdad", "venue", "mall", 33.3, 44.4, 5.0), ("b", "Mansour Mall", "baghdad", "venue", "mall", 33.31, 44.35, 9.0), ("c", "Majidi Mall", "erbil", "venue", "mall", 36.2, 44.0, 1.0), ("d", "Mall Street", "erbil", "street", None, 36.2, 44.01, 0.0), ("e", "Central Pharmacy", "baghdad", "venue", "pharmacy", 33.32, 44.41, 2.0)]
    docs = spark.createDataFrame(rows, "_id string, name string, locality string, layer string, category string, lat double, lon double, popularity double")
    docs = docs.withColumns({"category_ids": F.when(F.col("category").isNotNull(), F.array("category")), "intent_groups": F.when(F.col("category") == "mall", F.array(F.lit("shopping"))), "country_a": F.lit("IQ"), "source": F.lit("osm"), "source_id": F.col("_id")})
    words = lambda c: text.tokenize(F.lower(F.coalesce(c, F.lit(""))))
    fields = {"name.default": words(F.col("name")), "label": words(F.concat_ws(" ", "name", "locality")), "locality": words(F.col("locality")), "parent.locality": words(F.col("locality")), "category": words(F.col("category")), "address_parts.street": words(F.when(F.col("layer") == "street", F.col("name")))}
    return docs, geocode.build(docs, fields)


@pytest.fixture(scope="module")
def dims(spark):
    term = spark.createDataFrame([("category", "pharmacy", "pharmacy"), ("category", "pharmacy", "chemist"), ("intent_group", "shopping", "shopping")], "type string, id string, term string")
    cat = spark.createDataFrame([("pharmacy", ["health"], 0.5)], "category_id string, intent_groups array<string>, importance double")
    return term, cat, spark.createDataFrame([("e", "erbil"), ("e", "arbil"), ("b", "baghdad"), ("b", "bagdad")], "variant string, term string")


def _asked(spark, texts, schema="", more=()):
    rows = [(i, t, t.split(), *(more[i] if more else ())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"query_id int, normalized string, tokens array<string>{schema}")


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r._id)
    return out


def test_search_finds_misspelt_words_categories_and_places(spark, index, dims):
    got = _found(geocode.find(_asked(spark, ["mansuor mall", "majidi mall arbil", "mall erbil", "chemist", "chemist arbil", "shopping bagdad", "nowhere", ""]), index[1], dims))
    assert got[0] == ["b"] and got[1] == ["c"] and set(got[2]) == {"c", "d"} and got[3] == ["e"] and set(got[5]) == {"a", "b"}
    assert set(got) == {0, 1, 2, 3, 5}


def test_search_filters_and_focus(spark, index, dims):
    more = [(36.2, 44.0, None, None, None), (None, None, ["street"], None, None), (None, None, None, "iq", (44.38, 33.2, 44.5, 33.4)), (None, None, None, "TR", None)]
    q = _asked(spark, ["mall"] * 4, ", q_lat double, q_lon double, layers array<string>, country string, rect struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>", more)
    got = _found(geocode.find(q, index[1], dims))
    assert set(got[0][:2]) == {"c", "d"} and got[1] == ["d"] and got[2] == ["a"] and 3 not in got


def test_autocomplete(spark, index, dims):
    got = _found(geocode.complete(_asked(spark, ["mansour ma", "central ph", "erbil maj"]), index[1], dims))
    assert got[0][0] == "b" and got[1][0] == "e" and got[2][0] == "c"


def test_structured_and_batches(spark, index, dims):
    q = spark.createDataFrame([(1, ["mall", "street"], None, None), (2, None, ["baghdad"], None), (3, None, None, ["pharmacy"])], "query_id int, street array<string>, locality array<string>, other array<string>")
    got = geocode.structured(q, index[1]).collect()
    assert {(r.query_id, r._id, r.match_type) for r in got} == {(1, "d", "street_only"), (2, "a", "locality_match"), (2, "b", "locality_match"), (2, "e", "locality_match"), (3, "e", "partial_match")}
    raw = spark.createDataFrame([(1, "central pharmacy", None), (2, " ", None), (3, "mall", "99")], "query_id int, text string, size string")
    run = lambda ok: geocode.find(text.normalize(ok, "text"), index[1], dims)
    out, summary = geocode.batch(raw, "search", run)
    assert {(r.query_id, r.status, r.parameter, tuple(r.ids)) for r in out.collect()} == {(1, "ok", None, ("e",)), (2, "error", "text", ()), (3, "error", "size", ())}
    assert tuple(summary.first()) == (3, 1, 2)
    near = geocode.reverse(spark.createDataFrame([(1, 33.3, 44.4, 500.0), (2, 0.0, 0.0, None)], "query_id int, q_lat double, q_lon double, radius double"), index[0])
    assert [(r.query_id, r._id) for r in near.collect()] == [(1, "a")]
