"""Spatial joins as equi-joins on grid cells with arithmetic residuals: radius, nearest line, point in polygon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..sources.store import sent, written


#: Rows of a cell's large side in one part, at most on average.
DENSE = 50_000


def spread(large: DataFrame, small: DataFrame, keys: list[str], id_: str, most: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `keys` with a further key `part`: rows of the large side that share a key with more than
    `most` others are dealt to parts by their ids, as many as their counted rows need, and the small side's rows
    are copied into all parts of their keys. Everything meets that met before."""
    dense = written(large.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts")))
    n = dense.count()
    if not n:
        return large.withColumn("part", F.lit(0)), small.withColumn("part", F.lit(0))
    number = F.coalesce(F.pmod(F.xxhash64(id_), F.col("parts")), F.lit(0)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = large.join(sent(dense, n), keys, "left").withColumn("part", number).drop("parts")
    return dealt, small.join(sent(dense, n), keys, "left").withColumn("part", copies).drop("parts")


def radius_join(queries: DataFrame, places: DataFrame, most: float = 50_000.0, cell_m: float | None = None) -> DataFrame:
    """Places within `radius` metres of a query's (q_lat, q_lon), with distance.

    Queries are the side that is put into several cells: a place has one cell, so large place tables are not
    multiplied. Cells span `most`; queries with a larger radius are joined by themselves, on cells four, sixteen, ...
    times as large. Columns of both sides are kept. Invalid coordinates never match.
    """
    # Half of the earth's girth is 20,038 km: no more classes than up to there.
    classes, bound = [], most
    while bound < 20_100_000.0:
        classes.append(bound)
        bound *= 4
    level = F.lit(len(classes))
    for n, b in reversed(list(enumerate(classes))):
        level = F.when(F.col("radius") <= b, n).otherwise(level)
    q = queries.where(geo.valid_point(F.col("q_lat"), F.col("q_lon")) & (F.col("radius") >= 0))
    there = sorted(r[0] for r in q.select(level.alias("level")).distinct().collect())  # a few numbers
    out = None
    for n in there or [0]:
        cell = most * 4**n if n else cell_m or most
        one = _radius_join(q.where(level == n), places, min(most * 4**n, 20_100_000.0), min(cell, 20_100_000.0))
        out = one if out is None else out.unionByName(one)
    return out


#: Hits of a radius join for each query, up to which its nearest are chosen from all of them.
HITS = 500


def nearest_join(queries: DataFrame, places: DataFrame, k: int, most: float = 50_000.0, first: Callable[[float], Column] | None = None) -> DataFrame:
    """Of the radius join, at least the k nearest places of each query and all that are as near as its k-th.

    Where more than HITS places a query are near on average, half of the radius is tried first, and half of that: a
    query with k places nearer than a smaller radius needs no others, and the rest go on to the next larger one. For
    another order than distance, `first(bound)` says of a hit that no place farther than `bound` comes before it.
    """
    queries, stages = written(queries), [most]
    n = queries.count()
    if n:
        size = most / 111000.0
        cells = lambda t, lat, lon, c: t.where(geo.valid_point(F.col(lat), F.col(lon))).groupBy(geo.cell(F.col(lat), size).alias("cy"), geo.cell(F.col(lon), size).alias("cx")).agg(F.count(F.lit(1)).cast("double").alias(c))
        met = cells(queries, "q_lat", "q_lon", "a").join(cells(places, "lat", "lon", "b").hint("merge"), ["cy", "cx"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
        while 3 * met / n > HITS and stages[0] > 1.0:  # a circle has the area of some three such cells
            stages.insert(0, stages[0] / 2)
            met /= 4
    out = None
    for bound in stages:
        if bound == most:
            hits = radius_join(queries, places, most)
            return hits if out is None else out.unionByName(hits)
        own = F.col("radius")
        hits = written(radius_join(queries.withColumns({"whole": own, "radius": F.least(own, F.lit(bound))}), places, bound).withColumn("radius", F.col("whole")).drop("whole"))
        # Strictly nearer: places at the bound itself may tie with others beyond rounding. Short radii are done as they are.
        sure = F.col("distance") < bound if first is None else (F.col("distance") < bound) & first(bound)
        done = hits.where(sure).groupBy("query_id").count().where(F.col("count") >= k).select("query_id").unionByName(queries.where(own < bound).select("query_id")).distinct()
        done = written(done)
        one = hits.join(done.hint("merge"), "query_id", "left_semi")
        out = one if out is None else out.unionByName(one)
        queries = written(queries.join(done.hint("merge"), "query_id", "left_anti"))
    return out


def _radius_join(q: DataFrame, places: DataFrame, most: float, cell_m: float) -> DataFrame:
    size = geo.lat_rows(cell_m)
    reach = geo.lon_cells(F.col("q_lat"), most, size)
    rows_of = F.ceil(F.least(F.col("radius"), F.lit(most)) / 111000.0 / size).cast("long")
    around = int(360 / size) + 1
    q = q.withColumn("cy", F.explode(F.sequence(geo.cell(F.col("q_lat"), size) - rows_of, geo.cell(F.col("q_lat"), size) + rows_of)))
    q = q.withColumn("cx", F.explode(F.sequence(geo.cell(F.col("q_lon"), size) - reach, geo.cell(F.col("q_lon"), size) + reach)))
    # Columns past the date line come in again on the other side.
    low, high = F.floor(F.lit(-180 / size)).cast("long"), F.floor(F.lit(180 / size)).cast("long")
    q = q.withColumn("cx", F.when(F.col("cx") < low, F.col("cx") + around).when(F.col("cx") > high, F.col("cx") - around).otherwise(F.col("cx"))).dropDuplicates(["query_id", "cx", "cy"])
    p = places.where(geo.valid_point(F.col("lat"), F.col("lon"))).withColumn("cy", geo.cell(F.col("lat"), size)).withColumn("cx", geo.cell(F.col("lon"), size))
    distance = geo.haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    p, q = spread(p, q, ["cx", "cy"], "_id" if "_id" in p.columns else "lat")
    return p.join(q.hint("shuffle_hash"), ["cx", "cy", "part"]).drop("cx", "cy", "part").withColumn("distance", distance).where(F.col("distance") <= F.col("radius"))


def top_k(hits: DataFrame, k: int | Column, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k hits of each query in the given order, with their rank; limits are applied before the exchange."""
    ranked = hits.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def segments(lines: DataFrame, id_: str = "road_id", line: str = "line") -> DataFrame:
    """id, seg, x1, y1, x2, y2: the pieces of polylines; a line of one vertex is a piece of no length."""
    ends = F.when(F.size(line) > 1, F.slice(F.col(line), 2, F.size(line) - 1)).otherwise(F.col(line))
    pairs = F.arrays_zip(F.slice(F.col(line), 1, F.greatest(F.lit(1), F.size(line) - 1)).alias("a"), ends.alias("b"))
    out = lines.select(id_, F.posexplode(pairs).alias("seg", "s"))
    return out.select(id_, "seg", *[F.col(f"s.{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for c in ("x", "y")])


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The share of a segment, from its first end, at which it is nearest in the plane of its coordinates."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(F.lit(0.0))


def closest_point(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of a segment that is nearest in the plane of its coordinates."""
    t = along(px, py, x1, y1, x2, y2)
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


#: Pairs of points and segments in shared cells, up to which a nearest-line join is made in one step.
PAIRS = 20_000_000


def nearest_line(points: DataFrame, segs: DataFrame, radius_m: float, id_: str = "_id", line_id: str = "road_id", radius_mode: str = "meters", srid: int = 4326) -> DataFrame:
    """For each point the nearest line within a radius: id, line id, snap_lon, snap_lat, snap_distance (metres).

    radius_mode "source_units" bounds the distance in coordinate units, "meters" the distance on the ground.
    Segments are put into the cells of their boxes, widened by the radius; min_by keeps one row per point. Where that
    lets too many meet, a quarter of the radius is tried first, and a quarter of that: a line found within a smaller
    radius is the nearest of all, and only points without one go on to the next larger radius.
    """
    segs = segs.where(geo.finite(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    points = points.where(geo.valid_point(F.col("lat"), F.col("lon"))).select(id_, "lat", "lon")
    within = F.lit(None).cast("double") if radius_mode != "source_units" else geo.meters_to_units(F.lit(radius_m), srid)
    extent = None
    stages = [radius_m]
    while True:
        size = 2 * stages[0] / 111000.0 if extent is None else max(2 * stages[0] / 111000.0, extent)
        p, s = _in_cells(points, segs, stages[0], size)
        cells = [t.groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias(n)) for t, n in ((p, "a"), (s, "b"))]
        pairs = cells[0].join(cells[1].hint("merge"), ["cx", "cy"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
        if extent is None and pairs > PAIRS:  # cells no smaller than segments: they would be copied into many
            extent = segs.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 0.0
        # A radius that leaves cells no smaller leaves about as many pairs.
        if pairs <= PAIRS or stages[0] / 111000.0 * 4 < extent or stages[0] < 1.0:
            break
        stages.insert(0, stages[0] / 4)
    if len(stages) > 1:
        points, segs = written(points), written(segs)
    found = None
    for k, bound in enumerate(stages):
        size = 2 * bound / 111000.0 if extent is None else max(2 * bound / 111000.0, extent)
        last = bound == radius_m
        best = _nearest_line(points, segs, bound, size, id_, line_id, within, radius_mode == "source_units", last)
        if len(stages) == 1:
            return best
        best = written(best)
        found = best if found is None else found.unionByName(best)
        if not last:
            points = written(points.join(best.select(id_).hint("merge"), id_, "left_anti"))
            if points.isEmpty():
                break
    return found


def _widths(radius_m: float) -> tuple[float, Column]:
    """A radius in degrees of latitude, and of longitude at the latitude of a segment: a metre is more degrees away from
    the equator."""
    reach = radius_m / 111000.0
    return reach, reach / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("y1"), F.abs("y2"))))))


def _in_cells(points: DataFrame, segs: DataFrame, radius_m: float, size: float) -> tuple[DataFrame, DataFrame]:
    """Points with their cell, segments with all cells that their boxes, widened by the radius, touch."""
    reach, wide = _widths(radius_m)
    low = lambda a, b, w: geo.cell(F.least(a, b) - w, size)
    high = lambda a, b, w: geo.cell(F.greatest(a, b) + w, size)
    s = segs.withColumn("cx", F.explode(F.sequence(low("x1", "x2", wide), high("x1", "x2", wide)))).withColumn("cy", F.explode(F.sequence(low("y1", "y2", F.lit(reach)), high("y1", "y2", F.lit(reach)))))
    return points.withColumns({"cx": geo.cell(F.col("lon"), size), "cy": geo.cell(F.col("lat"), size)}), s


def _nearest_line(points: DataFrame, segs: DataFrame, radius_m: float, size: float, id_: str, line_id: str, within: Column, units: bool, last: bool) -> DataFrame:
    """The nearest line within `radius_m`; with `units` also within that many coordinate units, and at last in them alone."""
    p, s = _in_cells(points, segs, radius_m, size)
    p, s = spread(p, s, ["cx", "cy"], id_)
    met = p.join(s.hint("shuffle_hash"), ["cx", "cy", "part"])
    # Most pairs fail on the widened box; the share is exploded so that it is computed once and not inside each use.
    reach, wide = _widths(radius_m)
    near = F.col("lon").between(F.least("x1", "x2") - wide, F.greatest("x1", "x2") + wide) & F.col("lat").between(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach)
    met = met.where(near).withColumn("t", F.explode(F.array(along(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))))
    met = met.withColumn("snap_lon", F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).withColumn("snap_lat", F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")))
    met = met.withColumn("snap_distance", geo.haversine(F.col("lat"), F.col("lon"), F.col("snap_lat"), F.col("snap_lon")))
    if units:
        met = met.where(F.sqrt(F.pow(F.col("lon") - F.col("snap_lon"), 2) + F.pow(F.col("lat") - F.col("snap_lat"), 2)) <= within)
    if not (units and last):
        met = met.where(F.col("snap_distance") <= radius_m)
    best = F.min_by(F.struct(line_id, "seg", "snap_lon", "snap_lat", "snap_distance"), F.struct("snap_distance", line_id, "seg"))
    return met.groupBy(id_).agg(best.alias("s")).select(id_, "s.*")


def edges(polygons: DataFrame, id_: str = "area_id", rings: str = "rings") -> DataFrame:
    """id, x1, y1, x2, y2 of all rings (outer rings and holes alike: crossings are counted over all)."""
    ring = polygons.select(id_, F.explode(rings).alias("ring"))
    ring = ring.where(F.size("ring") >= 3).withColumn("next", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)))
    out = ring.select(id_, F.explode(F.arrays_zip(F.col("ring").alias("a"), F.col("next").alias("b"))).alias("e"))
    return out.select(id_, *[F.col(f"e.{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for c in ("x", "y")])


#: The grid of boundaries is moved by this much, so that round coordinates are on none of its lines.
SHIFT = 0.0013793471839
#: Edges are put into cells that they come this close to.
MARGIN = 1e-9


def cover(polygons: DataFrame, size: float, area: str = "area_id", rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """Grid cells of polygons. border: area, cx, cy, x1, y1, x2, y2, odd, a row for each edge in each cell that it touches;
    full: area, cx, cy of the cells that no edge touches and that are inside.

    `odd` says whether a cell's upper right corner is inside: a ray from there along the upper line to the east is cut
    an odd number of times, which is a running sum over the border cells of one row of the grid. Cells between two
    border cells of a row are all inside or all outside, as the corner of the left one is.
    """
    at = lambda v: geo.cell(v + SHIFT, size)
    line = lambda c: c * F.lit(size) - SHIFT
    e = edges(polygons, area, rings)
    e = e.withColumn("cy", F.explode(F.sequence(at(F.least("y1", "y2") - MARGIN), at(F.greatest("y1", "y2") + MARGIN))))
    low, high, top = F.greatest(F.least("y1", "y2"), line(F.col("cy"))), F.least(F.greatest("y1", "y2"), line(F.col("cy") + 1)), line(F.col("cy") + 1)
    where = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    inside = lambda x: F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2"))
    level = F.col("y1") == F.col("y2")
    ends = [F.when(level, F.col("x1")).otherwise(inside(where(low))), F.when(level, F.col("x2")).otherwise(inside(where(high)))]
    e = e.withColumn("cx", F.explode(F.sequence(at(F.least(*ends) - MARGIN), at(F.greatest(*ends) + MARGIN))))
    cut = (F.col("y1") > top) != (F.col("y2") > top)
    e = e.withColumn("cuts", F.coalesce((cut & (at(where(top)) == F.col("cx"))).cast("int"), F.lit(0)))
    cells = e.groupBy(area, "cy", "cx").agg(F.sum("cuts").alias("cuts"))
    row = Window.partitionBy(area, "cy").orderBy("cx")
    east = F.sum("cuts").over(Window.partitionBy(area, "cy").orderBy(F.desc("cx")).rowsBetween(Window.unboundedPreceding, -1))
    cells = written(cells.select(area, "cy", "cx", (F.coalesce(east, F.lit(0)) % 2 == 1).alias("odd"), F.lead("cx").over(row).alias("next")))
    between = cells.where(F.col("odd") & (F.col("next") > F.col("cx") + 1))
    full = between.select(area, F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy")
    return e.drop("cuts").join(cells.drop("next").hint("merge"), [area, "cy", "cx"]), full


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float, id_: str = "_id", area: str = "area_id", rings: str = "rings") -> DataFrame:
    """(id, area id) of points inside or on the edge of polygons.

    A point in a full cell is inside. In a border cell a path leads from the point east to the cell's side and up to its
    corner, of which it is known whether it is inside: only edges in the cell can cut the path. Counting and the
    edge test are sums, so no point's or polygon's edges have to meet in one row.
    """
    border, full = cover(polygons, size, area, rings)
    at = lambda v: geo.cell(v + SHIFT, size)
    p = points.where(geo.finite(F.col("lat"), F.col("lon"))).select(id_, F.col("lon").alias("px"), F.col("lat").alias("py"), at(F.col("lon")).alias("cx"), at(F.col("lat")).alias("cy"))
    within = p.join(full.hint("shuffle_hash"), ["cx", "cy"]).select(id_, area)
    met = p.join(border.hint("shuffle_hash"), ["cx", "cy"])
    side, top = (F.col("cx") + 1) * F.lit(size) - SHIFT, (F.col("cy") + 1) * F.lit(size) - SHIFT
    cross = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("px") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    inside_box = F.col("px").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("py").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on_edge = (F.abs(cross) <= 1e-12) & inside_box
    x = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    y = F.col("y1") + (side - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    east = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (x > F.col("px")) & (x <= side)
    up = ((F.col("x1") > side) != (F.col("x2") > side)) & (y > F.col("py")) & (y <= top)
    cuts = F.coalesce(east, F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int")
    found = met.groupBy(id_, area).agg((F.sum(cuts) + F.max(F.col("odd").cast("int"))).alias("cuts"), F.max(on_edge).alias("touches"))
    return within.unionByName(found.where(F.col("touches") | (F.col("cuts") % 2 == 1)).select(id_, area))


def representative_point(kind: Column, rings: Column) -> Column:
    """struct(x, y): a point itself, a line's middle vertex, the middle of a polygon's widest stretch on the
    line halfway up its first ring's box. `rings` is an array of arrays of struct(x, y)."""
    first = F.element_at(rings, 1)
    middle = F.element_at(first, ((F.size(first) + 1) / 2).cast("int"))
    y = (F.array_min(F.transform(first, lambda p: p["y"])) + F.array_max(F.transform(first, lambda p: p["y"]))) / 2
    nexts = lambda r: F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    cuts = lambda r: F.filter(
        F.transform(F.arrays_zip(r.alias("a"), nexts(r).alias("b")), lambda e: F.when((e["a"]["y"] > y) != (e["b"]["y"] > y), e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)))),
        lambda x: x.isNotNull(),
    )
    xs = F.array_sort(F.flatten(F.transform(rings, cuts)))
    stretch = F.transform(F.sequence(F.lit(1), F.floor(F.size(xs) / 2).cast("int")), lambda k: F.struct((F.element_at(xs, 2 * k) - F.element_at(xs, 2 * k - 1)).alias("wide"), ((F.element_at(xs, 2 * k) + F.element_at(xs, 2 * k - 1)) / 2).alias("x")))
    inside = F.when(F.size(xs) >= 2, F.struct(F.array_max(stretch)["x"].alias("x"), y.alias("y")))
    return F.when(kind == "polygon", F.coalesce(inside, middle)).otherwise(middle)
