"""Scores and orders: proximity, popularity, boosts, the final score, and ranked hits per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import search
from .spatial import nearest_join, radius_join, top_k

# Weights of the published scoring formula.
LAYER_WEIGHTS = {"street": 0.8, "locality": 0.6, "localadmin": 0.5, "neighbourhood": 0.5, "county": 0.4, "region": 0.4, "country": 0.2}
DISTANCE_WEIGHT, DISTANCE_SCALE, DISTANCE_OFFSET = 15.0, 3000.0, 200.0
CATEGORY_BOOST, INTENT_BOOST = 1.3, 1.15
POPULARITY_FACTOR, IMPORTANCE_FACTOR = 0.1, 1.0


def factor(value: Column, weight: float) -> Column:
    return F.log10(1 + weight * F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def layer_boost(layer: Column) -> Column:
    """The layer's weight where it is not the neutral 1."""
    out = F.lit(0.0)
    for name, weight in LAYER_WEIGHTS.items():
        out = F.when(layer == name, weight).otherwise(out)
    return out


def components(distance: Column, popularity: Column, importance: Column, layer: Column, category_hit: Column, intent_hit: Column) -> dict[str, Column]:
    """The parts of the score beside text; `distance` is null without a focus."""
    near = distance.isNotNull()
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return {
        "focus_decay": F.when(near, DISTANCE_WEIGHT * geo.gauss(distance, DISTANCE_SCALE, DISTANCE_OFFSET)).otherwise(0.0),
        "proximity": F.when(near, geo.steps(distance)).otherwise(0.0),
        "popularity_boost": factor(popularity, POPULARITY_FACTOR),
        "importance_boost": factor(importance, IMPORTANCE_FACTOR),
        "category_boost": yes(category_hit, CATEGORY_BOOST),
        "intent_boost": yes(intent_hit, INTENT_BOOST),
        "layer_boost": layer_boost(layer),
    }


def final_score(text: Column, parts: list[Column], distance: Column) -> Column:
    """With a focus the functions multiply the text score, without one they are added."""
    total = sum(parts[1:], parts[0])
    return F.when(distance.isNotNull(), text * total).otherwise(text + total)


def nearby(hits: DataFrame, sort: str = "distance", layers: tuple[str, ...] | None = ("venue",), size: int = 10, relevance: Column | None = None, categories: Column | None = None, mode: str = "any", held: str = "category_ids") -> DataFrame:
    """Hits of a radius join, ranked by distance, relevance, or relevance with a decay of distance. `categories`, an
    array, keeps hits that hold one or, with mode "all", all of them; none or null keeps all. Without a relevance of
    its own a hit's is the number of wanted categories that it holds."""
    if categories is not None:
        wanted = F.coalesce(categories, F.array().cast("array<string>"))
        hits = hits.where(search.in_categories(F.col(held), wanted, mode))
        relevance = F.size(F.array_intersect(F.coalesce(held, F.array().cast("array<string>")), wanted)).cast("double") if relevance is None else relevance
    if layers:
        hits = hits.where(F.col("layer").isin(*layers))
    text = F.lit(0.0) if relevance is None else relevance
    if sort == "distance":
        return top_k(hits.withColumn("score", text), size, F.col("distance"), F.desc("score"), F.col("_id"))
    if sort == "relevance":
        return top_k(hits.withColumn("score", text), size, F.desc("score"), F.col("distance"), F.col("_id"))
    if sort == "hybrid":
        scored = hits.withColumn("score", text + 2 * geo.gauss(F.col("distance"), 1000.0, 100.0))
        return top_k(scored, size, F.desc(F.round("score", 9)), F.col("_id"))
    raise ValueError(f"no sort {sort!r}")


def nearby_join(queries: DataFrame, places: DataFrame, sort: str = "distance", layers: tuple[str, ...] | None = ("venue",), size: int = 10, relevance: Column | None = None, most: float = 50_000.0) -> DataFrame:
    """What `nearby` does to a radius join, for a relevance that depends on the place alone: smaller radii first, which
    are enough where `size` hits come before all that a farther place can be."""
    places = places.where(F.col("layer").isin(*layers)) if layers else places
    relevance = F.lit(0.0) if relevance is None else relevance
    top = None if sort == "distance" else places.agg(F.max(F.when(~F.isnan(relevance), relevance)), F.max(F.isnan(relevance))).first()
    first = None
    if top is not None and (top[0] is None or top[1]):  # no largest relevance to bound by
        return nearby(radius_join(queries, places, most), sort, layers, size, relevance)
    if sort == "relevance":
        first = lambda _: relevance >= top[0]
    elif sort == "hybrid":
        # Orders are those of scores rounded to nine digits.
        first = lambda bound: relevance + 2 * geo.gauss(F.col("distance"), 1000.0, 100.0) > top[0] + 2 * geo.gauss(F.lit(bound), 1000.0, 100.0) + 1e-8
    return nearby(nearest_join(queries, places, size, most, first), sort, layers, size, relevance)


def reverse(hits: DataFrame, radius: float = 1000.0, size: int | Column = 1, layers: tuple[str, ...] = ("venue", "address", "street")) -> DataFrame:
    near = hits.where((F.col("distance") <= radius) & F.col("layer").isin(*layers))
    return top_k(near, size, F.col("distance"), F.col("_id"))
