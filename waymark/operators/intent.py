"""Query intent from a taxonomy: terms resolved to categories, groups and places; category tags of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..sources.store import sent, sized

# Words too broad to name a category, as terms of a taxonomy and as aliases of labels.
BROAD = ("place", "point", "service", "building", "office")
BROAD_ALIASES = ("place", "point", "service", "services", "building", "business", "company", "organization", "location", "facility")
LONGEST = 20


def safe_term(term: Column) -> Column:
    return (F.length(term) >= 2) & ~term.rlike(r"^q\d+$") & ~term.isin(*BROAD)


def safe_aliases(aliases: DataFrame, manual: DataFrame, broad: tuple[str, ...] = BROAD_ALIASES) -> DataFrame:
    """category_id, alias of a table with (category_id, alias): normalised, distinct, of 2 characters at least; broad
    words and entity ids only if they are in `manual` (category_id, alias: manual aliases, labels and the id)."""
    # Equal aliases are brought to their form once, and one grouping finds what is distinct and what is named.
    form = lambda df, named: df.select("category_id", "alias").distinct().select("category_id", text.alias_form(F.col("alias")).alias("alias"), F.lit(named).alias("named"))
    rows = form(aliases, False).unionByName(form(manual, True)).groupBy("category_id", "alias").agg(F.max(~F.col("named")).alias("given"), F.max("named").alias("named"))
    doubtful = F.col("alias").isin(*broad) | F.col("alias").rlike(r"^q\d+$")
    return rows.where(F.col("given") & (F.length("alias") >= 2) & (~doubtful | F.col("named"))).select("category_id", "alias")


def load_taxonomy(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """dim_category, dim_tag, dim_term, dim_place of a taxonomy file: {intent_groups: {id: {names, aliases}},
    categories: [{id, intent_groups, importance, names, aliases, osm_tags}], place_variants: [{id, terms}]}.

    osm_tags may be a list of {key, value} or an object; maps are read as JSON, so keys need no schema. With `lines`
    each line is such an object, and they are taken together: a taxonomy of any size need not be one value.
    """
    doc = spark.read.text(path, wholetext=not lines)
    cat = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.categories"), "array<string>")).alias("c"))
    get = lambda f: F.get_json_object("c", f"$.{f}")
    groups = F.coalesce(F.from_json(get("intent_groups"), "array<string>"), F.array(get("parent")))
    tags = F.when(F.substring(get("osm_tags"), 1, 1) == "{", F.transform(F.map_entries(F.from_json(get("osm_tags"), "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(F.from_json(get("osm_tags"), "array<struct<key:string,value:string>>"))
    cats = cat.select(get("id").alias("category_id"), groups.alias("intent_groups"), get("importance").cast("double").alias("importance"), tags.alias("tags"), F.from_json(get("names"), "map<string,string>").alias("names"), F.from_json(get("aliases"), "map<string,array<string>>").alias("aliases"))
    grp = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.intent_groups"), "map<string,string>")).alias("group", "g"))
    grp = grp.select("group", F.from_json(F.get_json_object("g", "$.names"), "map<string,string>").alias("names"), F.from_json(F.get_json_object("g", "$.aliases"), "map<string,array<string>>").alias("aliases"))
    none = F.array().cast("array<string>")
    spoken = lambda df, id_: df.select(id_, F.explode(F.concat(F.array(id_), F.coalesce(F.map_values("names"), none), F.coalesce(F.flatten(F.map_values("aliases")), none))).alias("term"))
    place = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.place_variants"), "array<struct<id:string,terms:array<string>>>")).alias("p"))
    term = spoken(cats, "category_id").select(F.lit("category").alias("type"), F.col("category_id").alias("id"), "term").unionByName(spoken(grp, "group").select(F.lit("intent_group").alias("type"), F.col("group").alias("id"), "term"))
    term = term.withColumn("term", text.clean(text.index_term(F.col("term")))).where(safe_term(F.col("term"))).distinct()
    return {
        "dim_category": cats,
        "dim_tag": cats.select("category_id", F.explode("tags").alias("t")).select("category_id", "t.key", "t.value"),
        "dim_term": term,
        "dim_place": place.select(F.col("p.id").alias("variant"), F.explode("p.terms").alias("term")).withColumn("term", text.clean(text.index_term(F.col("term")))).distinct(),
    }


def wikidata_labels(spark: SparkSession, path: str) -> DataFrame:
    """qid, lang, kind, value of entity files: {id, labels: {lang: {value}}, aliases: {lang: [{value}]}}."""
    doc = spark.read.text(path, wholetext=True)
    qid = F.get_json_object("value", "$.id").alias("qid")
    labels = doc.select(qid, F.explode(F.from_json(F.get_json_object("value", "$.labels"), "map<string,struct<value:string>>")).alias("lang", "v")).select("qid", "lang", F.lit("label").alias("kind"), F.col("v.value").alias("value"))
    aliases = doc.select(qid, F.explode(F.from_json(F.get_json_object("value", "$.aliases"), "map<string,array<struct<value:string>>>")).alias("lang", "vs")).select("qid", "lang", F.lit("alias").alias("kind"), F.explode("vs.value").alias("value"))
    return labels.unionByName(aliases)


def enrich_categories(docs: DataFrame, dim_tag: DataFrame, dim_category: DataFrame, tags: str = "source_tags", id_: str = "_id") -> DataFrame:
    """Adds category_ids, intent_groups, category_aliases, importance from a map of tags; a tag that the taxonomy
    does not know gives its value as a category."""
    each = docs.select(id_, F.explode(tags).alias("key", "value"))
    known = sized(dim_tag.join(dim_category.select("category_id", "intent_groups", "importance"), "category_id"))
    met = each.join(known, ["key", "value"], "left")
    arrays = met.groupBy(id_).agg(
        F.array_sort(F.collect_set(F.coalesce("category_id", "value"))).alias("category_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("intent_groups", F.array().cast("array<string>")))))).alias("intent_groups"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("key", "value", F.concat_ws(":", "key", "value")))))).alias("category_aliases"),
        F.max("importance").alias("importance"),
    )
    return docs.join(arrays.hint("merge"), id_, "left")


def _counted(dim: DataFrame) -> tuple[int, int | None]:
    """Rows of a dimension with a column term, and the longest second word of its terms (None: all are single words)."""
    second = F.when(F.instr("term", " ") > 0, F.length(F.split_part("term", F.lit(" "), F.lit(2))))
    n, longest = dim.agg(F.count(F.lit(1)), F.max(second)).first()
    return n, longest


def _held(queries: DataFrame, dim: DataFrame, longest: int | None, normalized: str, tokens: str) -> DataFrame | None:
    """query_id and the rows of dim (with a column term of several words) whose term is held in the text, wherever it
    begins and ends. The second word of such a term begins a word of the text, and is one if the term goes on: text
    and term meet on that word, or what a word of the text begins with, and are compared afterwards."""
    if longest is None:
        return None
    several = dim.where("instr(term, ' ') > 0").withColumn("second", F.split_part("term", F.lit(" "), F.lit(2)))
    parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("t"))), lambda k: F.substring(F.col("t"), F.lit(1), k))
    each = queries.select("query_id", F.col(normalized).alias("held_in"), F.explode(F.array_distinct(tokens)).alias("t")).where("t <> ''")
    each = each.select("query_id", "held_in", F.explode(parts).alias("second")).distinct()
    return each.join(several, "second").where(F.contains("held_in", "term")).drop("second", "held_in").distinct()


def matched_terms(queries: DataFrame, dim_term: DataFrame, normalized: str = "normalized", tokens: str = "tokens") -> DataFrame:
    """query_id, type, id, term: equal to the text, equal to a token, begun by a token of 3 characters or more, or of
    several words and held in the text. All are equi-joins."""
    n, longest = _counted(dim_term)
    dim = sent(dim_term, n)
    q = queries.select("query_id", F.col(normalized).alias("n"), F.col(tokens).alias("ts"))
    named = q.select("query_id", F.explode(F.array_union(F.coalesce("ts", F.array().cast("array<string>")), F.array("n"))).alias("term"))
    equal = named.join(dim, "term")
    edges = dim_term.withColumn("token", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(LONGEST), F.length("term")))), lambda k: F.substring(F.col("term"), F.lit(1), k))))
    one = q.select("query_id", F.explode("ts").alias("token")).distinct()
    begun = one.where(F.length("token") >= 3).join(sent(edges, n * LONGEST), "token").drop("token")
    several = _held(q, dim, longest, "n", "ts")
    columns = ["query_id", "type", "id", "term"]
    found = equal.select(*columns).unionByName(begun.select(*columns))
    return (found if several is None else found.unionByName(several.select(*columns))).distinct()


def place_terms(queries: DataFrame, dim_place: DataFrame, tokens: str = "tokens", normalized: str = "normalized") -> DataFrame:
    """query_id, variant, term: all spellings of the places of which a query names one: a spelling of one word is a
    token of the text, one of several words is held in the text, any is the text."""
    n, longest = _counted(dim_place)
    dim = sent(dim_place, n)
    named = [F.explode(F.array_union(F.coalesce(tokens, F.array().cast("array<string>")), F.array(normalized))).alias("term")]
    found = queries.select("query_id", *named).join(dim, "term").select("query_id", "variant")
    held = _held(queries, dim, longest, normalized, tokens)
    found = found if held is None else found.unionByName(held.select("query_id", "variant"))
    return found.distinct().join(dim, "variant").select("query_id", "variant", "term").distinct()


def resolve(queries: DataFrame, dim_term: DataFrame, dim_category: DataFrame, dim_place: DataFrame, autocomplete: bool = False, dim_tag: DataFrame | None = None) -> DataFrame:
    """query_id, category_ids, intent_groups, query_terms, place_terms, source_tags (key:value), unmatched, confidence:
    arrays are sorted; without dim_tag there are no tags. What is found is gathered in one grouping."""
    none = F.array().cast("array<string>")
    category = dim_category.select(F.lit("category").alias("type"), F.col("category_id").alias("id"), F.col("intent_groups").alias("groups"))
    met = matched_terms(queries, dim_term).join(sized(category), ["type", "id"], "left")
    if dim_tag is not None:
        tags = dim_tag.groupBy(F.lit("category").alias("type"), F.col("category_id").alias("id")).agg(F.collect_set(F.concat_ws(":", "key", "value")).alias("tags"))
        met = met.join(sized(tags), ["type", "id"], "left")
    as_kind = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    is_category, is_group = F.col("type") == "category", F.col("type") == "intent_group"
    values = [
        as_kind("category_ids", F.when(is_category, F.array("id")).otherwise(none)), as_kind("intent_groups", F.when(is_category, F.coalesce("groups", none)).when(is_group, F.array("id")).otherwise(none)),
        as_kind("query_terms", F.array("term", "id")), as_kind("words", F.split("term", " ")), as_kind("source_tags", F.coalesce("tags", none) if dim_tag is not None else none),
    ]
    found = met.select("query_id", F.explode(F.concat(*values)).alias("v"))
    named = F.concat(as_kind("place_terms", F.array("term")), as_kind("words", F.split("term", " ")))
    found = found.unionByName(place_terms(queries, dim_place).select("query_id", F.explode(named).alias("v")))
    kinds = ("category_ids", "intent_groups", "query_terms", "place_terms", "source_tags", "words")
    gathered = found.groupBy("query_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("v.kind") == k, F.col("v.value")))).alias(f"__{k}") for k in kinds])
    out = queries.select("query_id", "normalized", "tokens").join(gathered.hint("merge"), "query_id", "left")
    out = out.select("query_id", "normalized", "tokens", *[F.coalesce(f"__{k}", none).alias(k if k != "words" else "__words") for k in kinds])
    rest = F.filter("tokens", lambda t: ~F.array_contains(F.col("__words"), t))
    sure = scalars.confidence(F.size("category_ids") > 0, F.size("intent_groups") > 0, F.size("query_terms") > 0, F.lit(autocomplete))
    return out.withColumn("unmatched", F.array_join(rest, " ")).withColumn("confidence", sure).drop("__words")


def category_filter(wanted: DataFrame, dim_term: DataFrame, dim_category: DataFrame) -> DataFrame:
    """query_id, category, resolved for (query_id, category): a category's id, else what the term names, else itself."""
    ids = dim_category.select(F.col("category_id").alias("category"), F.col("category_id").alias("direct"))
    named = dim_term.where("type = 'category'").groupBy(F.col("term").alias("key")).agg(F.min("id").alias("named"))
    out = wanted.join(sized(ids), "category", "left").withColumn("key", text.clean(F.lower("category"))).join(sized(named), "key", "left")
    return out.select("query_id", "category", F.coalesce("direct", "named", "category").alias("resolved"))


def label_merge(dim_category: DataFrame, generated: DataFrame) -> DataFrame:
    """Aliases of each category: its own and the generated ones (category_id, aliases), distinct and sorted."""
    none = F.array().cast("array<string>")
    return dim_category.join(generated, "category_id", "left").withColumn("all_aliases", F.array_sort(F.array_union(F.coalesce(F.flatten(F.map_values("aliases_by_lang")), none), F.coalesce("generated", none))))


def categories_report(dim_category: DataFrame, counts: DataFrame, lang: str = "en", q: str = "") -> DataFrame:
    """category_id, name in a language, first group, available_count (0 if none); `q` selects by any of its words."""
    get = lambda k: F.try_element_at("names", F.lit(k))
    name = F.coalesce(get(lang), get("en"), get("ar"), F.try_element_at(F.map_values("names"), F.lit(1)))
    out = dim_category.join(counts, "category_id", "left").withColumn("name", name).withColumn("available_count", F.coalesce("count", F.lit(0)))
    if q:
        none = F.array().cast("array<string>")
        hay = F.lower(F.array_join(F.concat(F.array("category_id"), F.coalesce(F.map_values("names"), none), F.coalesce("intent_groups", none)), " "))
        out = out.where(F.contains(hay, F.lit(q.lower())))
    return out.select("category_id", "name", F.try_element_at("intent_groups", F.lit(1)).alias("parent"), "available_count")
