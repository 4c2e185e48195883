"""Enrichment of map features: event names, deliveries, fence evidence, upload outcomes, launch context, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import asof as J
from ..operators import sequence as S
from ..sources.payloads import labelled_locations

BY = ["capture_id"]
#: The keys of a configuration worth showing.
NOTABLE = [
    "logLevel", "debug", "url", "autoSync", "autoSyncThreshold", "batchSync", "heartbeatInterval", "distanceFilter", "desiredAccuracy", "stopTimeout", "stopOnTerminate", "startOnBoot",
    "foregroundService", "enableHeadless", "preventSuspend", "useSignificantChangesOnly", "geofenceModeHighAccuracy", "minimumActivityRecognitionConfidence", "schedule", "maxRecordsToPersist",
]
#: Masked whatever the redaction setting.
SECRET = ["url", "authorization"]
#: Defaults that properties are left out at; "ts" and "layer" name another property.
DEFAULTS = {"slice_ts": ("from", "ts"), "category": ("from", "layer"), "placement": ("is", "placed"), "dt_s": ("is", 0.0), "own_position": ("is", False), "severity": ("is", "normal"), "count": ("is", 1)}
TINT = {"ENTER": "green", "EXIT": "red", "DWELL": "amber"}
#: The beginnings of records about transitions that are held back.
SUPPRESSED = ["Ignoring spurious geofence", "Ignoring duplicate geofence", "Ignoring deferred geofence", "Ignoring stationary geofence", "Deferring geofence transition"]
#: Names under which records state a fence's numbers, and whether a unit of metres has to follow.
FENCE_MEASURES = {"dist_m": (["dist", "distance"], True), "radius_m": (["radius"], True), "outside_by_m": (["outsideBy"], False), "required_speed_mps": (["requiredSpeed"], False)}


def event_name(method: Column, raw: Column) -> Column:
    """The name of a dispatched event, in either of its two wordings; null for other records."""
    method = F.coalesce(method, F.lit(""))
    fired = F.when(method.contains("fire") & raw.contains("⚡"), X.extract(raw, "(?m)⚡️?\\s*([a-z]+)\\s*$"))
    named = F.when(method.contains("HeadlessEvent") | raw.contains("onHeadlessEvent"), X.extract(raw, "\\bevent:\\s*([a-z]+)\\b"))
    return F.coalesce(fired, named)


def stamp_fixes(fixes: DataFrame, dispatches: DataFrame, within: float = 2.0) -> DataFrame:
    """``fixes`` with ``delivered`` and ``headless``: of the dispatches before and after a fix, in this order, the first
    within so many seconds."""
    d = J.neighbours(fixes, dispatches.select("capture_id", "ts", "seq", "skull"), BY, "ts", ["seq"], ["skull"])
    before, after = X.seconds_between(F.col("prev_ts"), F.col("ts")), X.seconds_between(F.col("ts"), F.col("next_ts"))
    b, a = F.coalesce(before <= within, F.lit(False)), F.coalesce(after <= within, F.lit(False))
    return d.withColumn("delivered", a | b).withColumn("headless", F.when(b, F.col("prev_skull")).when(a, F.col("next_skull")).otherwise(False)).drop("prev_ts", "next_ts", "prev_skull", "next_skull")


def measures(raw: Column) -> Column:
    """All name=number pairs of a text in order: (name, value, metres)."""
    hits = F.regexp_extract_all(raw, F.lit("[A-Za-z]+=[0-9.]+m?"), F.lit(0))
    value = lambda x: F.rtrim(F.substring_index(x, "=", -1), F.lit("m")).try_cast("double")
    return F.transform(hits, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), value(x).alias("value"), x.endswith("m").alias("metres")))


def measure(pairs: str, *names: str, metres: bool = False) -> Column:
    """The first value that ``pairs`` has under one of the names."""
    fits = lambda x: x["name"].isin(*names) & (x["metres"] if metres else F.lit(True))
    return F.get(F.filter(pairs, fits), F.lit(0))["value"]


def fence_evidence(m: DataFrame) -> DataFrame:
    """Fence records with what they measured: distances, verdict, tint, and the trigger's and anchor's positions."""
    raw = F.col("raw")
    held_back = F.coalesce(*[F.when(raw.contains(p), p) for p in SUPPRESSED])
    locs = F.coalesce("structs.locations", F.array_compact(F.array("structs.location")))
    d = m.where(F.col("transition").isNotNull() | F.col("spurious") | held_back.isNotNull()).withColumn("labels", labelled_locations(raw, locs)).withColumn("measures", measures(raw))
    at = lambda k: F.try_element_at("labels", F.lit(k))
    trigger, anchor = F.coalesce(at("Trigger"), at("trigger")), F.coalesce(at("Stationary"), at("stationary"), at("Last"), at("last"), at("B"), at("b"))
    dist, radius, outside, _ = (measure("measures", *names, metres=metres) for names, metres in FENCE_MEASURES.values())
    tint = F.lit(None).cast("string")
    for k, v in TINT.items():
        tint = F.when(F.upper("transition") == k, v).otherwise(tint)
    return d.select(
        "capture_id", "seq", "ts", F.col("structs.geofence.identifier").alias("identifier"), F.col("transition").alias("action"), tint.alias("tint"), held_back.alias("suppressed"),
        dist.alias("dist_m"), radius.alias("radius_m"), outside.alias("outside_by_m"), measure("measures", "minPossibleDist", "minPossibleDistance").alias("min_possible_m"), measure("measures", "accuracy", metres=True).alias("trigger_acc_m"),
        F.when((dist > 0) & (radius > 0), F.when(dist > radius, "outside fence").otherwise("inside fence")).alias("verdict"),
        trigger["lat"].alias("trigger_lat"), trigger["lon"].alias("trigger_lon"), anchor["lat"].alias("anchor_lat"), anchor["lon"].alias("anchor_lon"),
    )


def implied_legs(evidence: DataFrame, fixes: DataFrame) -> DataFrame:
    """The leg a suppressed exit would have meant: from the anchor it names, else the fix before it, to the trigger."""
    e = evidence.where(F.col("suppressed").isNotNull() & F.col("trigger_lat").isNotNull())
    n = J.backward(J.neighbours(e, fixes.select("capture_id", "seq", "ts", "lat", "lon"), BY, "ts", ["seq"], ["lat", "lon"]), "ts", ["lat", "lon"])
    lat, lon = F.coalesce("anchor_lat", "at_lat"), F.coalesce("anchor_lon", "at_lon")
    n = n.withColumn("from_lat", lat).withColumn("from_lon", lon).where(F.col("from_lat").isNotNull() & ((F.col("from_lat") != F.col("trigger_lat")) | (F.col("from_lon") != F.col("trigger_lon"))))
    return n.select("capture_id", "seq", "ts", "from_lat", "from_lon", F.col("trigger_lat").alias("to_lat"), F.col("trigger_lon").alias("to_lon"))


def stationary_radius(m: DataFrame, default: float = 150.0) -> DataFrame:
    """(capture_id, radius_m, stated): the radius that the first record states close behind the name of the standstill's
    fence, else the default."""
    behind = F.get(F.split(F.lower("raw"), "stationary\\s*(?=geofence|region)", 2), F.lit(1))
    d = m.where(F.lower("raw").contains("stationary")).withColumn("pairs", measures(F.left(behind, F.lit(190)))).withColumn("r", measure("pairs", "radius", metres=True))
    said = d.groupBy(*BY).agg(F.min_by("r", F.when(F.col("r").isNotNull(), F.col("seq"))).alias("r"))
    return m.select(*BY).distinct().join(said, BY, "left").select(*BY, F.coalesce("r", F.lit(default)).alias("radius_m"), F.col("r").isNotNull().alias("stated"))


def upload_outcomes(m: DataFrame) -> DataFrame:
    """One row per upload that did something, with the last status before it; no-op finishes are dropped."""
    raw = F.col("raw")
    h = F.col("structs.http")
    finish = raw.rlike("success=[01]") & raw.contains("finish")
    noop = h["success"] & (F.coalesce(h["synced"], F.lit(0)) == 0) & (F.coalesce(h["pages"], F.lit(0)) == 0)
    answer = (F.col("platform") == "android") & raw.rlike("Response:\\s*\\d{3}")
    out = S.flush_outcomes(m, BY, ["seq"], h["status"], finish, F.coalesce(noop, F.lit(False)), answer)
    return out.select("capture_id", "seq", "ts", "last_status", h["success"].alias("success"), h["synced"].alias("synced"), h["pages"].alias("pages"), h["duration_ms"].alias("duration_ms"))


def launches(m: DataFrame) -> DataFrame:
    """Start banners with version, build, application, device and whether the process came up without a UI; the mark
    for that stands near the banner, on either side."""
    raw = F.col("raw")
    said = F.regexp_extract(raw, "HeadlessMode\\?\\s*(true|false)|Booted in (background|foreground)|didLaunchInBackground=([01])", 0)
    marks = m.withColumn("said", said).where("said <> ''").select("capture_id", "seq", "ts", F.col("said").rlike("true$|background$|=1$").alias("bg"))
    b = m.where("banner")
    near = J.neighbour_within(b, marks, BY, "seq", "ts", 60, 15.0)
    near = near.join(marks.select("capture_id", F.col("seq").alias("mark_seq"), "bg"), ["capture_id", "mark_seq"], "left")
    return near.select(
        "capture_id", "seq", "ts", "version", X.extract(raw, "version:\\s*[\\d.]+\\s*\\((\\d+)\\)").alias("build"), X.extract(raw, "(?m)^╟─\\s*([A-Za-z][\\w.]*\\.[\\w.]+)\\s*$").alias("app_id"),
        X.extract(raw, "(?m)^╟─\\s*(.+?@\\s*\\d+.*)$").alias("device"), F.col("bg").alias("headless"), (~X.balanced(raw)).alias("truncated"),
    )


def event_pairs(m: DataFrame) -> DataFrame:
    """Dispatches and receipts of named events; a dispatch with a receipt within five seconds is delivered."""
    name = event_name(F.col("tag_method"), F.col("raw"))
    kind = F.when(F.coalesce("tag_method", F.lit("")).contains("fire"), "fire").otherwise("receipt")
    d = m.withColumn("event", name).where(F.col("event").isNotNull()).withColumn("kind", kind)
    return S.consume_pairs(d, ["capture_id", "event"], ["seq"], "ts", "kind", "fire", "receipt", 5.0).select("capture_id", "seq", "ts", "event", "kind", "paired_s", "delivered")


def notable_config(config: DataFrame, redact: bool = True) -> DataFrame:
    """Notable keys of ``config`` (capture_id, key, value), nested or not; the shallowest of a name wins."""
    leaf = F.regexp_extract("key", "([^.]+)$", 1)
    d = config.withColumn("name", leaf).where(F.col("name").isin(*NOTABLE, *SECRET)).withColumn("depth", F.size(F.split("key", "\\.")))
    g = d.groupBy("capture_id", "name").agg(F.min_by("value", F.struct("depth", "key")).alias("value"))
    hide = F.col("name").isin(*SECRET) & F.col("value").isNotNull()
    return g.withColumn("value", F.when(hide, F.when(F.col("name") == "url", F.concat(F.lit("«"), X.url_class(F.col("value")), F.lit("»"))).otherwise("«masked»")).otherwise(F.col("value")))


def effective_level(config: DataFrame, m: DataFrame) -> DataFrame:
    """The log level in force: stated, else the chattiest that occurs."""
    stated = config.where(F.col("key").rlike("(^|\\.)logLevel$")).groupBy(*BY).agg(F.min("value").alias("stated"))
    seen = m.groupBy(*BY).agg(F.max("level").alias("__any"), F.bool_or(F.col("level") == "DEBUG").alias("debug"), F.bool_or(F.col("level") == "INFO").alias("info"), F.bool_or(F.col("level") == "WARN").alias("warn"))
    inferred = F.when(F.col("debug"), "DEBUG").when(F.col("info"), "INFO").when(F.col("warn"), "WARN").when(F.col("__any").isNotNull(), "ERROR")
    return seen.join(stated, BY, "left").select("capture_id", F.coalesce("stated", inferred).alias("log_level"), F.col("stated").isNull().alias("inferred"))


def _default(key: str, props: dict[str, Column]) -> Column:
    how, v = DEFAULTS[key]
    return props[v] if how == "from" else F.lit(v)


def compact(df: DataFrame) -> DataFrame:
    """Null out the properties that hold their default, and the occurrence times of single markers."""
    have = {k: F.col(k) for k in df.columns}
    out = df
    if "times" in have and "count" in have:
        out = out.withColumn("times", F.when(F.col("count") > 1, F.col("times")))
    return out.withColumns({k: F.when(~F.col(k).eqNullSafe(_default(k, have)), F.col(k)) for k in DEFAULTS if k in have})


def inflate(df: DataFrame) -> DataFrame:
    """The inverse of ``compact``."""
    have = {k: F.col(k) for k in df.columns}
    return df.withColumns({k: F.coalesce(F.col(k), _default(k, have)) for k in DEFAULTS if k in have})


def petals(df: DataFrame, by: list[str], x: Column, y: Column, order: str, cell: float = 18.0, most: int = 8) -> DataFrame:
    """Markers that share a small cell, numbered to be fanned out; ``clustered`` where there are too many for that."""
    d = df.withColumn("cell_x", F.floor(x / cell)).withColumn("cell_y", F.floor(y / cell))
    w = Window.partitionBy(*by, "cell_x", "cell_y")
    return d.withColumn("petal", F.row_number().over(w.orderBy(order)) - 1).withColumn("clustered", F.count("*").over(w) > most)


def opening_window(m: DataFrame, sessions: DataFrame, minutes: float = 120.0, lead: float = 900.0, least_m: float = 100.0) -> DataFrame:
    """(capture_id, open_s, close_s): from a lead before the first moving record, not before its session; else the first
    session of some distance; else the whole capture, which also holds without times."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    g = m.groupBy(*BY).agg(F.min(F.when(F.col("pace"), sec("ts"))).alias("mv"), F.min(sec("ts")).alias("a"), F.max(sec("ts")).alias("z"))
    far = sessions.where(F.col("distance_m") >= least_m).groupBy(*BY).agg(F.min("low_s").alias("far"))
    own = sessions.join(g.select("capture_id", "mv"), BY).where("low_s <= mv").groupBy(*BY).agg(F.max("low_s").alias("own"))
    d = g.join(far, BY, "left").join(own, BY, "left")
    start = F.when(F.col("mv").isNotNull(), F.greatest(F.col("mv") - lead, F.coalesce("own", "a"), "a")).otherwise(F.coalesce("far", "a"))
    whole = F.col("mv").isNull() & F.col("far").isNull()
    return d.select("capture_id", start.alias("open_s"), F.when(whole, F.col("z")).otherwise(F.least(start + minutes * 60, F.col("z"))).alias("close_s"))
