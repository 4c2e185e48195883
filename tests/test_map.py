"""Routing, fence episodes, stamped fixes, directions, radii and nested payloads on invented logs of both grammars."""

import math

import pytest
from pyspark.sql import functions as F

from trailmill.functions import exprs as X
from trailmill.operators import sequence as S
from trailmill.operators.shared import written
from trailmill.plans import enrich, findings, layers, router
from trailmill.sources import payloads as P
from trailmill.sources import records as R


def android(spark, lines, capture="a"):
    text = "\n".join(f"01-02 10:00:{t:06.3f} {level} [{tag}] {msg}" for t, level, tag, msg in lines)
    return findings.marks(P.annotate(R.assemble(spark.createDataFrame([(capture, "android", 2024, text)], "capture_id string, platform string, year int, text string"))))


def ios(spark, lines, capture="i"):
    text = "\n".join(f"2024-01-02 10:00:{t:06.3f} {msg}" for t, msg in lines)
    return findings.marks(P.annotate(R.assemble(spark.createDataFrame([(capture, "ios", 2024, text)], "capture_id string, platform string, year int, text string"))))


def routed(m):
    d = router.with_context(m)
    return {r.seq: list(r.x) for r in d.select("seq", router.layer_list(router.Rules(), d).alias("x")).collect()}


PHRASES = [
    ("INFO", "Fence m", "Trigger vs Geofence center", ["geofence"]),
    ("INFO", "Fence m", "Trigger vs last location", ["geofence"]),
    ("INFO", "Fence m", "Synthesizing missed-ENTER for home", ["geofence"]),
    ("INFO", "Fence m", "Updated geofence state", ["geofence"]),
    ("WARN", "Fence m", "Ignoring stationary geofence", ["warnings", "geofence"]),
    ("WARN", "Fence m", "Ignoring stationary geofence EXIT", ["geofence"]),
    ("WARN", "Fence m", "Normalizing stale PENDING_EXIT", ["geofence"]),
    ("INFO", "Fence m", "║ Geofencing Event: EXIT", ["geofence"]),
    ("INFO", "Fence m", "an EXIT of a geofence", []),
    ("INFO", "Http m", "HTTP ERROR: 0 no route", ["http"]),
    ("INFO", "Http m", "Response: 204", []),
    ("INFO", "Http onResponse", "Response: 204", ["http"]),
    ("INFO", "Http m", "Response: 500", ["http"]),
    ("INFO", "PermissionManager m", "state: Restricted", ["warnings"]),
    ("ERROR", "PermissionManager m", "Authorization failed", ["errors"]),
    ("INFO", "PermissionManager m", "state: Always", []),
    ("INFO", "X m", "changePace", ["motionchange"]),
    ("INFO", "LifecycleManager m", "x", ["lifecycle"]),
]


def test_every_phrase_has_its_layers(spark):
    got = routed(android(spark, [(i, *p[:3]) for i, p in enumerate(PHRASES)]))
    assert [got[i] for i in range(len(PHRASES))] == [p[3] for p in PHRASES]


def test_fence_callbacks_of_the_other_grammar(spark):
    got = routed(ios(spark, [(0, "-[TSGeofenceManager locationManager:didEnterRegion:] x"), (1, "-[Other locationManager:didEnterRegion:] x"), (2, "📢 EXIT Geofence: Home")]))
    assert got == {0: ["geofence"], 1: [], 2: ["geofence"]}


def test_a_fence_transition_takes_its_bookkeeping(spark):
    lines = [
        (1, "INFO", "Fence m", "Updated geofence state distance=1.0m"), (2, "INFO", "Fence handleGeofencingEvent", "Updated geofence state x"), (3, "INFO", "Fence m", "Trigger vs Geofence center distance=7.5m outsideBy=3"),
        (4, "INFO", "Fence m", "Trigger vs last location dist=9m radius=200m requiredSpeed=1.5"), (9, "INFO", "Fence m", "Updated geofence state"), (10, "INFO", "Fence m", "Updated geofence state"),
    ]
    keys, extra = router.fence_episodes(android(spark, lines))
    assert sorted(r.seq for r in keys.collect()) == [2, 3]
    assert [(r.seq, dict(r.extra)) for r in extra.collect()] == [(1, {"dist_m": "7.5", "outside_by_m": "3.0", "radius_m": "200.0", "required_speed_mps": "1.5"})]


def test_episodes_without_times(spark):
    rows = [("k", 0, None, True), ("k", 1, 5, False), ("k", 2, 6, True), ("k", 3, None, False), ("k", 4, 8, False)]
    d = spark.createDataFrame(rows, "k string, seq int, s int, open boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = S.episodes(d, ["k"], ["seq"], "ts", F.col("open"), ~F.col("open"))
    assert {r.seq: r.folded for r in got.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True}


def test_directions(spark):
    d = spark.createDataFrame([("isMoving: true then isMoving: 0",), ("motionchange: false",), ("stopTimeout fired",)], "raw string")
    assert [r.x for r in d.select(router.direction(F.col("raw")).alias("x")).collect()] == [True, False, None]


def test_radius_is_the_stated_one(spark):
    m = android(spark, [(1, "INFO", "A m", "radius=10m"), (2, "INFO", "A m", "Stationary region at x, radius=77.5m"), (3, "INFO", "A m", "stationary geofence radius=99m")])
    assert tuple(enrich.stationary_radius(m).first()) == ("a", 77.5, True)
    assert tuple(enrich.stationary_radius(android(spark, [(1, "INFO", "A m", "x")])).first()) == ("a", 150.0, False)


@pytest.mark.parametrize("lat, lon", [(0.0, 0.0), (60.0, 179.9), (-45.0, -120.0)])
def test_circle_corners_lie_at_the_radius(spark, lat, lon):
    ring = spark.createDataFrame([(lat, lon, 150.0)], "lat double, lon double, r double").select(X.circle("lat", "lon", "r").alias("c")).first().c
    assert ring[0] == ring[-1] and len(ring) == 33
    for x, y in ring:
        a, b, c, d = map(math.radians, (lat, lon, y, x))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        assert abs(2 * 6371000 * math.asin(math.sqrt(h)) - 150) < 0.1


def test_map_has_one_circle_per_standstill_and_stamped_fixes(spark):
    lines = [
        (1, "INFO", "Loc m", "Location[fused 1.0,2.0 hAcc=5]"), (2, "DEBUG", "HeadlessEventTx fire", "💀⚡️ location"), (20, "INFO", "Loc m", "Location[fused 1.1,2.1 hAcc=5]"),
        (21, "INFO", "T m", "motionchange: false"), (30, "INFO", "T m", "isMoving: true changePace"), (31, "INFO", "T m", "stationary region radius=80m"),
    ]
    m = written(findings.with_state(findings.with_segments(android(spark, lines))), "records")
    rules = router.Rules(rules=[{"match": "motionchange: false", "layer": "motionchange", "stationary_region": True}])
    rows = layers.features(m, findings.gaps(m), rules).collect()
    import json

    circles = [json.loads(r.props) for r in rows if r.geometry == "Polygon"]
    assert [(c["radius_m"], c["stated"]) for c in circles] == [(80.0, True)]
    fixes = sorted((r.seq, json.loads(r.props).get("headless")) for r in rows if r.layer == "fixes")
    assert fixes == [(0, True), (2, None)]
    assert [json.loads(r.props).get("moving") for r in sorted(rows, key=lambda r: r.seq) if r.layer == "motionchange" and r.geometry == "Point"] == [False, True]
    assert sum(r.layer == "motionchange" and r.geometry == "LineString" for r in rows) == 1
    assert not any(r.layer == "motionchange" for r in layers.features(m, findings.gaps(m)).where("geometry = 'Polygon'").collect())


def test_positions_and_intents_nested_deep(spark):
    deep = "Location[fused 1,2 " + "[" * 50 + "x" + "]" * 50 + " hAcc=4], time: 9 " + "Location[gps 3,4]"
    inside = "Location[a 1,2 {Bundle[Location[b 3,4]]} acc=1]"
    intent = "Intent { act=go " + "{" * 30 + "}" * 30 + " cmp=x/.Y } cmp=outside"
    got = {r.i: r.structs for r in P.annotate(spark.createDataFrame([(0, deep), (1, inside), (2, intent), (3, "Intent { act=open {{ cmp=z")], "i int, raw string")).collect()}
    assert [(x.lat, x.acc, x.time_ms) for x in got[0].locations] == [(1.0, 4.0, 9), (3.0, None, None)]
    assert got[1].location.acc == 1.0 and got[1].locations is None
    assert got[2].intent.asDict() == {"act": "go", "dat": None, "cmp": "x/.Y"} and got[3].intent.act == "open"


def test_patterns_of_activity_and_errors(spark):
    m = ios(spark, [(0, "-[A onMotionActivityChange:] | walking/80 | isMoving: 1"), (1, 'Error Domain=NSURL Code=-1 "x" UserInfo={NSLocalizedDescription=Lost, or gone.}')])
    got = {r.seq: r for r in m.collect()}
    assert (got[0].activity, got[0].confidence) == ("walking", 80) and got[1].structs.nserror.desc == "Lost, or gone."
