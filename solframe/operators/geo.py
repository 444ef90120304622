"""Places: great-circle distance, nearest rows, radius search, grids and circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import held, settled

#: The earth's diameter in km, kilometres in a mile.
DIAMETER, MILE = 12742.0, 1.609344
#: Query points that are broadcast at most; more are joined by cells.
FEW = 10_000
#: Width of the first ring, and half the way around the earth.
RING, AROUND = 50.0, 20_100.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km on a sphere."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return DIAMETER * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2.0)) + F.pow(lon1 - lon2, F.lit(2.0)))


def nearest(points: DataFrame, grid: DataFrame, point_id: str, grid_id: str, within_km: float | None = None) -> DataFrame:
    """The grid row nearest to each point (ties: the least id): point_id, grid_id, km. Both have lat and lon.

    FEW points at most are broadcast, and each task keeps one candidate for each point. More points meet the grid in
    cells, in rings: points whose nearest row is not inside a ring meet it again in one four times as wide. Points
    without a row within `within_km`, if given, have no row.
    """
    p = points.select(F.col(point_id), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    g = grid.select(F.col(grid_id), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    if len(p.select(F.lit(1)).take(FEW + 1)) <= FEW:
        return _best(g.crossJoin(F.broadcast(p)), point_id, grid_id, within_km)
    ring, found = min(within_km or RING, RING), None
    while True:
        here = settled(_best(_cell_pairs(p, g, ring), point_id, grid_id, ring))
        found = here if found is None else found.unionByName(here)
        p = settled(p.join(here.select(point_id), point_id, "left_anti"))
        if ring >= (within_km or AROUND) or p.isEmpty():
            return found
        ring = min(4 * ring, within_km or AROUND)


#: Cells of one level lie SIDE x SIDE in a cell of the level above; a cell is split while it may hold more rows.
SIDE, CROWDED, LEVELS = 8, 256, 14


def nearest_in_degrees(points: DataFrame, grid: DataFrame, point_id: str, grid_id: str, few: int = FEW) -> DataFrame:
    """As `nearest`, by the plain distance of (lat, lon): point_id, grid_id, degrees.

    `few` points at most are broadcast. More descend a tree of cells, level by level: of the occupied cells below those a
    point still has, the farthest corner of the nearest one bounds its distance, and cells that begin beyond the bound
    are dropped. At the lowest level points meet rows. Points and rows without a place play no part.
    """
    p = points.select(F.col(point_id), F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"))
    g = grid.select(F.col(grid_id), F.col("lat").cast("double").alias("g_lat"), F.col("lon").cast("double").alias("g_lon"))
    placed = lambda df, *names: df.filter(_all_numbers(*names))
    p, g = placed(p, "p_lat", "p_lon"), placed(g, "g_lat", "g_lon")
    if len(p.select(F.lit(1)).take(few + 1)) <= few:
        pairs = g.crossJoin(F.broadcast(p))
    else:
        pairs = _descended(p, g, point_id)
    far = degrees_apart(F.col("p_lat"), F.col("p_lon"), F.col("g_lat"), F.col("g_lon"))
    best = pairs.groupBy(point_id).agg(F.min(F.struct(far.alias("d"), grid_id)).alias("b"))
    return best.select(point_id, F.col(f"b.{grid_id}").alias(grid_id), F.col("b.d").alias("degrees"))


def _all_numbers(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & (F.abs(F.col(n)) < float("inf")) & ~F.isnan(n)
    return out


def _descended(p: DataFrame, g: DataFrame, point_id: str) -> DataFrame:
    """Pairs of each point and the rows of those cells that may hold its nearest one. Each level is materialised."""
    span = g.agg(F.min("g_lat").alias("south"), F.min("g_lon").alias("west"), F.greatest(F.max("g_lat") - F.min("g_lat"), F.max("g_lon") - F.min("g_lon")).alias("width")).first()
    if span["south"] is None:
        return p.crossJoin(g)  # no rows at all
    south, west, width = span["south"], span["west"], max(span["width"] * (1 + 1e-9), 1e-9)
    size = lambda level: width / SIDE**level
    cell = lambda level: [F.floor((F.col("g_lat") - south) / size(level)).alias("r"), F.floor((F.col("g_lon") - west) / size(level)).alias("c")]
    depth = next((d for d in range(1, LEVELS) if g.groupBy(*cell(d)).count().filter(F.col("count") > CROWDED).isEmpty()), LEVELS)
    left = p.select(point_id, "p_lat", "p_lon", F.lit(0).cast("long").alias("up_r"), F.lit(0).cast("long").alias("up_c"))
    for level in range(1, depth + 1):
        taken = held(g.select(*cell(level)).distinct().withColumns({"up_r": F.floor(F.col("r") / SIDE), "up_c": F.floor(F.col("c") / SIDE)}))
        beyond = lambda v, at, low: F.greatest(low + at * size(level) - v, v - low - (at + 1) * size(level), F.lit(0.0))  # noqa: E731, B023
        reach = lambda v, at, low: F.greatest(F.abs(v - low - at * size(level)), F.abs(v - low - (at + 1) * size(level)))  # noqa: E731, B023
        met = left.join(taken, ["up_r", "up_c"]).drop("up_r", "up_c")
        lat, lon = (F.col("p_lat"), F.col("r"), F.lit(south)), (F.col("p_lon"), F.col("c"), F.lit(west))
        met = met.withColumn("near_", F.sqrt(beyond(*lat) ** 2 + beyond(*lon) ** 2)).withColumn("far_", F.sqrt(reach(*lat) ** 2 + reach(*lon) ** 2))
        bound = F.min("far_").over(Window.partitionBy(point_id))  # a handful of cells for each point
        kept = met.withColumn("bound_", bound).filter(F.col("near_") <= F.col("bound_") * (1 + 1e-9) + 1e-9)
        left = settled(kept.select(point_id, "p_lat", "p_lon", F.col("r").alias("up_r"), F.col("c").alias("up_c")))
    rows = g.withColumns(dict(zip(("up_r", "up_c"), cell(depth))))
    return left.join(rows, ["up_r", "up_c"])


def _best(pairs: DataFrame, point_id: str, grid_id: str, within_km: float | None) -> DataFrame:
    pairs = pairs.withColumn("km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("g_lat"), F.col("g_lon")))
    if within_km is not None:
        pairs = pairs.filter(F.col("km") <= within_km)
    best = pairs.groupBy(point_id).agg(F.min(F.struct("km", grid_id)).alias("b"))
    return best.select(point_id, F.col(f"b.{grid_id}").alias(grid_id), F.col("b.km").alias("km"))


def radius_join(centres: DataFrame, rows: DataFrame, centre_id: str, row_id: str, miles: float) -> DataFrame:
    """Pairs of a centre and a row at most `miles` apart: centre_id, row_id, km. They meet in cells of that size."""
    p = centres.select(F.col(centre_id), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    g = rows.select(F.col(row_id), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    pairs = _cell_pairs(p, g, miles * MILE).withColumn("km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("g_lat"), F.col("g_lon")))
    return pairs.filter(F.col("km") <= miles * MILE).select(centre_id, row_id, "km")


def _cell_pairs(p: DataFrame, g: DataFrame, km: float) -> DataFrame:
    """Pairs in the same or neighbouring latitude bands and, within them, longitude cells wide enough for km."""
    band = km / 111.0
    row = lambda c: F.floor(c / band)
    wide = lambda r: F.greatest(F.lit(1), F.floor(360 / (band / F.greatest(F.cos(F.radians(F.least(F.abs(r * band), F.abs((r + 1) * band)) + 2 * band)), F.lit(1e-6)))))
    cell = lambda lon, r: F.pmod(F.floor((lon + 180) / 360 * wide(r)), wide(r))
    g = g.withColumn("r", row(F.col("g_lat"))).withColumn("c", cell(F.col("g_lon"), F.col("r")))
    p = p.withColumn("r", F.explode(F.array(*(row(F.col("p_lat")) + i for i in (-1, 0, 1)))))
    p = p.withColumn("c", F.explode(F.array_distinct(F.array(*(F.pmod(cell(F.col("p_lon"), F.col("r")) + i, wide(F.col("r"))) for i in (-1, 0, 1))))))
    return p.join(g, ["r", "c"]).drop("r", "c")


def within_radius(df: DataFrame, lat: float, lon: float, miles: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Add `km` and `inside`. For rows inside only, filter(inside) after `bounding_box`, which reaches the scan."""
    km = haversine(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col))
    return df.withColumn("km", km).withColumn("inside", F.col("km") <= miles * MILE)


def bounding_box(df: DataFrame, lat: float, lon: float, miles: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows that can be within the radius, by plain comparisons; across the poles or +-180 only latitude counts."""
    import math

    up = miles * MILE / 111.0
    out = df.filter(F.col(lat_col).between(lat - up, lat + up))
    if abs(lat) + up < 89:
        side = up / math.cos(math.radians(abs(lat) + up))
        if -180 <= lon - side and lon + side <= 180:
            out = out.filter(F.col(lon_col).between(lon - side, lon + side))
    return out


def grid(spark, lat: tuple[float, float, float], lon: tuple[float, float, float]) -> DataFrame:
    """Cells of (start, end, step) in both directions, ends excluded, latitude first: cell, lat, lon."""
    box = spark.range(1).select(*(F.lit(float(x)).alias(f"{n}{k}") for n, t in (("a", lat), ("o", lon)) for k, x in enumerate(t)))
    cells = grid_cells(*(tuple(F.col(f"{n}{k}") for k in range(3)) for n in "ao"))
    return box.select(F.inline(cells))


def grid_cells(lat: tuple[Column, Column, Column], lon: tuple[Column, Column, Column]) -> Column:
    """The cells of a row's box as an array of (cell, lat, lon): (start, end, step) each, ends excluded, latitude first.

    A box without extent, or with a step that is not above 0, has none.
    """
    n, m = (F.greatest(F.coalesce(F.ceil(F.try_divide(end - start, F.when(step > 0, step))), F.lit(0)), F.lit(0)).cast("long") for start, end, step in (lat, lon))
    every = F.when(n * m > 0, F.sequence(F.lit(0).cast("long"), n * m - 1)).otherwise(F.array().cast("array<bigint>"))
    here = lambda k: F.struct(k.alias("cell"), (lat[0] + F.floor(k / m) * lat[2]).alias("lat"), (lon[0] + (k % m) * lon[2]).alias("lon"))
    return F.transform(every, here)


def circle(df: DataFrame, lat: Column, lon: Column, km: float, step: int = 5) -> DataFrame:
    """Points at all bearings from 0 to 360 at a distance: bearing, circle_lat, circle_lon."""
    d, b = F.lit(km / (DIAMETER / 2)), F.radians(F.col("bearing"))
    a, o = F.radians(lat), F.radians(lon)
    out = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    east = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(out))
    rows = df.withColumn("bearing", F.explode(F.sequence(F.lit(0), F.lit(360), F.lit(step))))
    wrapped = F.pmod(F.degrees(east) + 180, F.lit(360.0)) - 180
    return rows.withColumn("circle_lat", F.degrees(out)).withColumn("circle_lon", wrapped)


def zoom(miles: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(12.0), 8 - F.log2(miles * 0.7 / 10))), F.lit(6.0))
