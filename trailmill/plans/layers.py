"""Map layers: position fixes, tracks, silences, launches and placed events as feature rows
(capture_id, layer, seq, ts, geometry, coordinates, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import aggregate as A
from ..operators import asof as J
from ..operators import scan
from ..operators import sequence as S
from . import enrich as E
from . import router

BY = ["capture_id"]
#: What stands in records that quote positions rather than report them; router.FENCE_QUOTED does too.
QUOTED = ["Trigger vs ", "Trigger=", "Stationary="]
#: Beginnings of a comparison's rows, which quote them too.
COMPARED = "(?m)^\\s*╟?─?\\s*[AB]:\\s*[-\\d]"


def fixes(m: DataFrame) -> DataFrame:
    """Reported positions (capture_id, seq, i, ts, lat, lon, speed, mock)."""
    locs = F.coalesce("structs.locations", F.array_compact(F.array("structs.location")))
    raw = F.col("raw")
    quotes = router.any_of(raw, [*QUOTED, *router.FENCE_QUOTED]) | raw.rlike("Ignoring \\w+ geofence") | raw.contains("Deferring geofence") | raw.rlike(COMPARED)
    d = m.where(~quotes).select("capture_id", "seq", "ts", F.posexplode(locs).alias("i", "l"))
    d = d.select("capture_id", "seq", "i", "ts", F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"), F.col("l.acc").alias("acc"), F.col("l.speed").alias("speed"), F.col("l.mock").alias("mock"))
    return d.where(X.valid_position(F.col("lat"), F.col("lon")))


def sessions(fix: DataFrame, gap_table: DataFrame, m: DataFrame) -> DataFrame:
    """Tracking outings with bounds, distance, record count and what ended them."""
    large = scan.segment_of(m, ["seq"]) is not None
    f = fix.where(F.col("ts").isNotNull())
    f = S.sessions(scan.deal(f, BY, ["ts", "seq", "i"]) if large else f, BY, "ts", ["seq", "i"], 1200.0)
    s = S.session_summary(f, BY, "ts", ["seq", "i"], "lat", "lon")
    capture = m.groupBy(*BY).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    s = S.session_bounds(s, BY, capture).withColumn("next_start", F.lead("start").over(S.window(BY, ["session"])))
    g = gap_table.select("capture_id", F.col("start").alias("g_start"), "gap_s", "kind")
    s = J.longest_in(s, g, BY, "session", F.col("end"), F.col("next_start"), "g_start", "gap_s", ["kind", "gap_s"], large)
    t = m.where(F.col("ts").isNotNull()).select("capture_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    n = J.count_between(s, t, BY, ["session"], "low_s", "high_s", "t", large).withColumnRenamed("n", "records")
    return s.join(n, ["capture_id", "session"], "left").withColumnRenamed("gap_kind", "ended_by").drop("next_start")


def track(fix: DataFrame, gap_table: DataFrame) -> DataFrame:
    """Track vertices; silences of records split a track too."""
    f = fix.where(F.col("ts").isNotNull())
    w = S.window(BY, ["ts", "seq", "i"])
    f = f.withColumn("kind", F.lit(1)).unionByName(gap_table.select("capture_id", F.col("start").alias("ts"), F.lit(0).alias("kind")), allowMissingColumns=True)
    # a gap that starts between two fixes: the last gap start seen is not before the fix before
    order = S.window(BY, ["ts", F.desc("kind"), "seq", "i"])
    f = f.withColumn("g", F.last(F.when(F.col("kind") == 0, F.col("ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 1")
    f = f.withColumn("prev", F.lag("ts").over(w)).withColumn("cut", F.coalesce((F.col("g") >= F.col("prev")) & (F.col("g") < F.col("ts")), F.lit(False)))
    return S.track(f.drop("kind", "g", "prev"), BY, "ts", ["seq", "i"], "lat", "lon", breaks=F.col("cut"))


def folded(m: DataFrame) -> list[DataFrame]:
    """What other records say about a marker: whether a dispatch arrived, how an upload ended."""

    def side(d, **kw):
        return d.groupBy("capture_id", "seq").agg(*(F.first(v.cast("string"), ignorenulls=True).alias(k) for k, v in kw.items())).select("capture_id", "seq", F.map_filter(F.create_map(*(x for k in kw for x in (F.lit(k), F.col(k)))), lambda k, v: v.isNotNull()).alias("extra"))

    sent = side(E.event_pairs(m).where("kind = 'fire'"), event=F.col("event"), delivered=F.col("delivered"))
    done = side(E.upload_outcomes(m), last_status=F.col("last_status"), success=F.col("success"), synced=F.col("synced"), duration_ms=F.col("duration_ms"))
    fence = side(E.fence_evidence(m), tint=F.col("tint"), verdict=F.col("verdict"), dist_m=F.col("dist_m"), radius_m=F.col("radius_m"))
    return [sent, fence, done, router.fence_episodes(m)[1]]


def placed_events(m: DataFrame, fix: DataFrame, rules: router.Rules | None = None) -> DataFrame:
    """One row per record and layer with a position: its own, else the nearest in time."""
    own = F.col("structs.location")
    d = router.with_context(router.without(m, router.told_elsewhere(m)))
    d = d.withColumn("layer_list", router.layer_list(rules or router.Rules(), d)).where(F.size("layer_list") > 0)
    e = router.decorate(d, ["capture_id", "seq"], *folded(m)).select(
        "capture_id", "seq", "ts", "platform", "raw", "extra", "severity", router.direction(F.col("raw")).alias("pace"), "transition", "layer_list", "shape", F.array_join(X.content_lines(F.concat(F.array("header_msg"), "body"), 2), "\n").alias("text"), own["lat"].alias("own_lat"), own["lon"].alias("own_lon"),
    )
    n = J.neighbours(e, fix.select("capture_id", "seq", "ts", "lat", "lon"), BY, "ts", ["seq"], ["lat", "lon"])
    n = J.locate(n, "ts", "lat", "lon")
    has = X.valid_position(F.col("own_lat"), F.col("own_lon"))
    n = n.withColumn("lat", F.when(has, F.col("own_lat")).otherwise(F.col("at_lat"))).withColumn("lon", F.when(has, F.col("own_lon")).otherwise(F.col("at_lon")))
    n = n.withColumn("placement", F.when(has, "own").otherwise(F.col("placement"))).where(F.col("lat").isNotNull() & F.col("ts").isNotNull())
    return n.select("capture_id", "seq", "ts", F.explode("layer_list").alias("layer"), "platform", "raw", "extra", "severity", "pace", "transition", "shape", F.left("text", F.lit(400)).alias("text"), "lat", "lon", "placement", "dt_s")


def markers(events: DataFrame, rules: router.Rules | None = None) -> DataFrame:
    """Placed events with repeats at one anchor merged, per layer; own positions are never merged."""
    key = F.left(F.regexp_replace("shape", "(?i)\\b(?:true|false)\\b", "?"), F.lit(90))
    own = F.when(F.col("placement") == "own", F.col("seq"))
    rules = rules or router.Rules()
    icon, tint = router.icon(rules, F.col("platform"), F.col("layer"), F.try_element_at("extra", F.lit("event")), F.col("raw"))
    clock = F.when(own.isNull(), router.layer_setting(rules, F.col("layer"), "clock", router.CLOCK))
    d = events.withColumn("key", key).withColumn("alone", own).withColumn("icon", icon).withColumn("tint", F.coalesce(F.try_element_at("extra", F.lit("tint")), tint)).withColumn("clock", clock)
    return A.marker_dedupe(d, ["capture_id", "layer", "lat", "lon", "key", "alone"], "seq", "ts", ["text", "severity", "placement", "dt_s", "pace", "extra", "icon", "tint", "clock"])


def features(m: DataFrame, gap_table: DataFrame, rules: router.Rules | None = None) -> DataFrame:
    """All layers as (capture_id, layer, seq, geometry, coordinates, props): JSON strings for the last two."""
    fix = fixes(m)
    point = lambda: F.to_json(F.array(F.round("lon", 6), F.round("lat", 6)))
    iso = lambda c: X.iso_text(F.col(c))

    def props(**kw):
        return F.to_json(F.struct(*(v.alias(k) for k, v in kw.items())))

    sent = m.where((E.event_name(F.col("tag_method"), F.col("raw")) == "location") & F.col("ts").isNotNull()).select("capture_id", "ts", "seq", "skull")
    stamped = E.stamp_fixes(fix, sent)
    parts = [stamped.select("capture_id", F.lit("fixes").alias("layer"), "seq", F.lit("Point").alias("geometry"), point().alias("coordinates"), props(t=iso("ts"), acc=F.col("acc"), speed=F.col("speed"), mock=F.col("mock"), delivered=F.when(F.col("delivered"), True), headless=F.when(F.col("headless"), True)).alias("props"))]
    v = track(fix, gap_table)
    line = v.groupBy("capture_id", "run").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("vertex", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "speed", "ts"))).alias("v"))
    coords = F.to_json(F.transform("v", lambda x: F.array(x["lon"], x["lat"])))
    parts.append(line.select("capture_id", F.lit("track").alias("layer"), "seq", F.lit("LineString").alias("geometry"), coords.alias("coordinates"), props(t=X.iso_text(F.get("v", F.lit(0))["ts"]), speed=F.transform("v", lambda x: x["speed"]), dt_s=F.transform("v", lambda x: F.round(X.seconds_between(F.get("v", F.lit(0))["ts"], x["ts"])).cast("int"))).alias("props")))
    f = fix.select("capture_id", "seq", "ts", "lat", "lon")
    g = J.backward(J.neighbours(gap_table.select("capture_id", "seq", F.col("start").alias("ts"), F.col("end"), "gap_s", "kind"), f, BY, "ts", ["seq"], ["lat", "lon"]), "ts", ["lat", "lon"])
    g = g.withColumn("lat", F.coalesce("at_lat", "next_lat")).withColumn("lon", F.coalesce("at_lon", "next_lon")).where(F.col("lat").isNotNull())
    parts.append(g.select("capture_id", F.lit("gaps").alias("layer"), "seq", F.lit("Point").alias("geometry"), point().alias("coordinates"), props(t=iso("ts"), gap_s=F.col("gap_s"), kind=F.col("kind")).alias("props")))
    span = g.where(F.col("at_lat").isNotNull() & F.col("next_lat").isNotNull() & ((F.col("at_lat") != F.col("next_lat")) | (F.col("at_lon") != F.col("next_lon"))))
    ends = F.to_json(F.array(F.array(F.round("at_lon", 6), F.round("at_lat", 6)), F.array(F.round("next_lon", 6), F.round("next_lat", 6))))
    parts.append(span.select("capture_id", F.lit("gaps").alias("layer"), "seq", F.lit("LineString").alias("geometry"), ends.alias("coordinates"), props(t=iso("ts"), role=F.lit("gap-span"), gap_s=F.col("gap_s"), kind=F.col("kind")).alias("props")))
    b = E.launches(m)
    b = J.nearest(J.neighbours(b, f, BY, "ts", ["seq"], ["lat", "lon"]), "ts", ["lat", "lon"]).withColumn("lat", F.col("near_lat")).withColumn("lon", F.col("near_lon")).where(F.col("lat").isNotNull())
    parts.append(b.select("capture_id", F.lit("launch").alias("layer"), "seq", F.lit("Point").alias("geometry"), point().alias("coordinates"), props(t=iso("ts"), **{k: F.col(k) for k in ["version", "build", "app_id", "device", "headless"]}, truncated=F.when(F.col("truncated"), True), anchor_dt_s=F.col("signed_s")).alias("props")))
    placed = placed_events(m, fix, rules)
    mk = E.compact(markers(placed, rules).withColumnRenamed("n", "count"))
    parts.append(mk.select("capture_id", "layer", F.col("first_seq").alias("seq"), F.lit("Point").alias("geometry"), point().alias("coordinates"), props(count=F.col("count"), times=F.transform("times", X.iso_text), last=X.iso_text(F.col("last_ts")), text=F.col("text"), severity=F.col("severity"), placement=F.col("placement"), anchor_dt_s=F.col("dt_s"), icon=F.col("icon"), tint=F.col("tint"), moving=F.col("pace"), offset_clock=F.col("clock"), folded=F.col("extra")).alias("props")))
    stands = placed.where(~F.coalesce("pace", F.lit(True)) & (F.col("layer") == "motionchange") & router.attribute(rules or router.Rules(), F.col("platform"), F.col("layer"), F.col("raw"), "stationary_region"))
    ring = stands.join(E.stationary_radius(m), BY)
    parts.append(ring.select("capture_id", "layer", "seq", F.lit("Polygon").alias("geometry"), F.to_json(F.array(X.circle("lat", "lon", "radius_m"))).alias("coordinates"), props(t=iso("ts"), role=F.lit("stationary-region"), radius_m=F.col("radius_m"), stated=F.col("stated")).alias("props")))
    legs = S.connectors(placed.where("layer = 'motionchange' and pace is not null"), BY, ["ts", "seq"], "pace", ["lat", "lon"])
    parts.append(legs.select("capture_id", F.lit("motionchange").alias("layer"), "seq", F.lit("LineString").alias("geometry"), F.to_json(F.array(F.array("from_lon", "from_lat"), F.array("lon", "lat"))).alias("coordinates"), props(t=iso("ts")).alias("props")))
    implied = E.implied_legs(E.fence_evidence(m), fix)
    leg = F.to_json(F.array(F.array("from_lon", "from_lat"), F.array("to_lon", "to_lat")))
    parts.append(implied.select("capture_id", F.lit("geofence").alias("layer"), "seq", F.lit("LineString").alias("geometry"), leg.alias("coordinates"), props(t=iso("ts"), role=F.lit("implied-leg")).alias("props")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
