"""A zoom pyramid of map markers: what a map shows at each zoom level where markers lie too close.

World positions are whole sixteenths of a pixel at the deepest zoom, so cells of a zoom level are unions of the cells
below it and sums are exact in any order. Markers are counted once, in the deepest cells; the other levels are sums of
cells. A layer with more than ``least`` markers shows a cluster for each 64-pixel cell of two or more. What is left are
single markers: those of all layers that share an 18-pixel cell are fanned out as petals, clockwise in time, and are
counted on a disc where they are more than eight. A marker at a position of its own stays where it is.

Stated cases: rows without a valid position, and positions beyond 85.05 degrees, are left out, resp. drawn at the map's
edge; markers of equal order come by ``tie``, then layer, then position; an empty table gives no rows; other columns are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X

#: World units in a pixel of the deepest zoom.
UNITS = 16
#: Rows of one key are dealt over so many tasks where a total is joined.
SALTS = 16


def world(lat: Column, lon: Column, top: int) -> tuple[Column, Column]:
    """Whole world units at the deepest zoom."""
    x, y = X.mercator(lat, lon, F.lit(float(top)))
    last = (256 << top) * UNITS - 1
    whole = lambda c: F.least(F.floor(c * UNITS), F.lit(last)).cast("bigint")
    return whole(x), whole(y)


def position(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    """(lat, lon) of a pixel at a zoom level."""
    size = 256 * F.pow(F.lit(2.0), zoom)
    return F.degrees(F.atan(F.sinh((0.5 - y / size) * (2 * 3.141592653589793)))), x / size * 360 - 180


def of_features(features: DataFrame, bottom: int = 3, top: int = 18) -> DataFrame:
    """The pyramid of a map's point features, as features of a layer '@<zoom>' for each zoom level."""
    prop = lambda k: F.get_json_object("props", f"$.{k}")
    at = F.from_json("coordinates", "array<double>")
    own = (F.col("layer") == "fixes") | F.coalesce(prop("placement") == "own", F.lit(False))
    m = features.where("geometry = 'Point'").select("capture_id", "layer", "seq", F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), F.coalesce(prop("offset_clock").cast("int"), F.lit(12)).alias("clock"), own.alias("own"))
    p = pyramid(m, ["capture_id"], "layer", "lat", "lon", "seq", F.col("clock"), F.col("own"), bottom=bottom, top=top)
    lat, lon = position(F.col("x"), F.col("y"), F.col("zoom"))
    props = F.to_json(F.struct("role", "layer", "seq", F.when(F.col("n") > 1, F.col("n")).alias("n"), "petal"))
    return p.select("capture_id", F.format_string("@%02d", "zoom").alias("layer"), "seq", F.lit("Point").alias("geometry"), F.to_json(F.array(F.round(lon, 6), F.round(lat, 6))).alias("coordinates"), props.alias("props"))


def _salted(df: DataFrame, totals: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """``df`` with its key's total; a hot key's rows go to several tasks."""
    spread = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [*keys, "__salt"]).drop("__salt")


def _coarser(c: str, zoom: str, top: int) -> Column:
    """A cell's number at a zoom above the deepest: its bits without the last ones."""
    return F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(top) - F.col(zoom))).cast("bigint")


def pyramid(
    markers: DataFrame, by: list[str], layer: str, lat: str, lon: str, order: str, tie: Column, own: Column, *,
    bottom: int = 0, top: int = 18, cell: int = 64, least: int = 500, petal: int = 18, most: int = 8,
) -> DataFrame:
    """(by, zoom, role, layer, seq, n, petal, x, y): roles are 'cluster' (n markers of a layer around x, y), 'petal' (marker
    ``seq`` is the petal-th of n around x, y), 'disc' (n markers around x, y) and 'marker' (alone at x, y); ``seq`` is the
    first marker's. x and y are pixels of the world at that zoom."""
    keys = [*by, "layer"]
    x, y = world(F.col(lat), F.col(lon), top)
    d = markers.where(X.valid_position(F.col(lat), F.col(lon))).select(
        *by, F.col(layer).alias("layer"), F.struct(F.col(order).cast("bigint").alias("seq"), tie.cast("bigint").alias("tie"), x.alias("x"), y.alias("y"), F.coalesce(own, F.lit(False)).alias("own")).alias("one")
    )
    side = cell * UNITS
    at = lambda c: F.floor(F.col(f"one.{c}") / side).cast("bigint")
    deepest = d.groupBy(*keys, at("x").alias("cx"), at("y").alias("cy")).agg(F.count("*").alias("n"), F.sum(F.col("one.x").cast("decimal(20,0)")).alias("sx"), F.sum(F.col("one.y").cast("decimal(20,0)")).alias("sy"), F.min("one").alias("one"))
    totals = deepest.groupBy(*keys).agg(F.sum("n").alias("total"))
    zooms = F.explode(F.sequence(F.lit(bottom), F.lit(top))).alias("zoom")
    crowded = _salted(deepest, totals.where(F.col("total") > least).drop("total"), keys, F.xxhash64("cx", "cy"))
    levels = crowded.select(*keys, "cx", "cy", "n", "sx", "sy", "one", zooms)
    levels = levels.withColumn("cx", _coarser("cx", "zoom", top)).withColumn("cy", _coarser("cy", "zoom", top))
    levels = levels.groupBy(*keys, "zoom", "cx", "cy").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.min("one").alias("one"))
    pixel = lambda total, n: total.cast("double") / n / (F.lit(float(UNITS)) * F.pow(F.lit(2.0), F.lit(top) - F.col("zoom")))
    clusters = levels.where("n > 1").select(
        *by, "zoom", F.lit("cluster").alias("role"), "layer", F.col("one.seq").alias("seq"), "n", F.lit(None).cast("int").alias("petal"), pixel(F.col("sx"), F.col("n")).alias("x"), pixel(F.col("sy"), F.col("n")).alias("y")
    )
    sparse = _salted(d, totals.where(F.col("total") <= least).drop("total"), keys, F.xxhash64("one"))
    alone = levels.where("n = 1").select(*keys, "zoom", "one").unionByName(sparse.select(*keys, "one", zooms))
    # a window holds at most ``least`` markers of each sparse layer and a few of each crowded one
    width = (F.lit(petal * UNITS) * F.pow(F.lit(2.0), F.lit(top) - F.col("zoom"))).cast("bigint")
    near = lambda c: F.when(~F.col("one.own"), F.floor((F.col(f"one.{c}") + width / 2) / width).cast("bigint"))
    own_key = F.when(F.col("one.own"), F.struct("layer", "one"))
    w = Window.partitionBy(*by, "zoom", "px", "py", "__own")
    g = alone.withColumn("px", near("x")).withColumn("py", near("y")).withColumn("__own", own_key)
    g = g.withColumn("n", F.count("*").over(w)).withColumn("sx", F.sum("one.x").over(w)).withColumn("sy", F.sum("one.y").over(w))
    g = g.withColumn("k", F.row_number().over(w.orderBy("one.seq", "one.tie", "layer", "one.x", "one.y")) - 1)
    g = g.withColumn("n", F.when(F.col("one.own"), 1).otherwise(F.col("n"))).where((F.col("n") <= most) | (F.col("k") == 0))
    role = F.when(F.col("n") == 1, "marker").when(F.col("n") <= most, "petal").otherwise("disc")
    mine = lambda s, c: pixel(F.when(F.col("one.own"), F.col(f"one.{c}")).otherwise(F.col(s)), F.col("n"))
    rest = g.select(*by, "zoom", role.alias("role"), "layer", F.col("one.seq").alias("seq"), F.col("n").cast("bigint").alias("n"), F.when(role == "petal", F.col("k")).cast("int").alias("petal"), mine("sx", "x").alias("x"), mine("sy", "y").alias("y"))
    return clusters.unionByName(rest)
