import json
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from trailmill.plans import pyramid as Y

SCHEMA = "cap string, layer string, lat double, lon double, seq bigint, clock int, own boolean, n string, petal string"
TOP, LEAST = 4, 30


def world(lat, lon):
    size = 256 << TOP
    s = math.sin(math.radians(max(-85.05112878, min(85.05112878, lat))))
    x, y = (lon + 180) / 360 * size, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size
    return tuple(min(math.floor(v * 16), size * 16 - 1) for v in (x, y))


def brute(rows):
    out = []
    rows = [r for r in rows if r[2] is not None and r[3] is not None and abs(r[2]) <= 90 and abs(r[3]) <= 180]
    totals = defaultdict(int)
    for r in rows:
        totals[r[0], r[1]] += 1
    for zoom in range(TOP + 1):
        k = 2 ** (TOP - zoom)
        alone, cells = [], defaultdict(list)
        for r in rows:
            x, y = world(r[2], r[3])
            m = (r[4], r[5], r[1], x, y, bool(r[6]), r[0])
            if totals[r[0], r[1]] > LEAST:
                cells[r[0], r[1], x // (1024 * k), y // (1024 * k)].append(m)
            else:
                alone.append(m)
        for (cap, layer, _, _), g in cells.items():
            if len(g) == 1:
                alone.append(g[0])
            else:
                out.append((cap, zoom, "cluster", layer, min(g)[0], len(g), None, sum(m[3] for m in g) / len(g) / (16 * k), sum(m[4] for m in g) / len(g) / (16 * k)))
        near = defaultdict(list)
        for i, m in enumerate(alone):
            near[(m[6], "own", i) if m[5] else (m[6], (m[3] + 144 * k) // (288 * k), (m[4] + 144 * k) // (288 * k))].append(m)
        for g in near.values():
            g.sort()
            x, y = sum(m[3] for m in g) / len(g) / (16 * k), sum(m[4] for m in g) / len(g) / (16 * k)
            if len(g) > 8:
                out.append((g[0][6], zoom, "disc", g[0][2], g[0][0], len(g), None, x, y))
            else:
                out += [(m[6], zoom, "petal" if len(g) > 1 else "marker", m[2], m[0], len(g), i if len(g) > 1 else None, x, y) for i, m in enumerate(g)]
    return out


def result(spark, rows):
    d = Y.pyramid(spark.createDataFrame(rows, SCHEMA), ["cap"], "layer", "lat", "lon", "seq", F.col("clock"), F.col("own"), top=TOP, least=LEAST)
    assert d.columns == ["cap", "zoom", "role", "layer", "seq", "n", "petal", "x", "y"]
    return [tuple(r) for r in d.collect()]


def test_pyramid_equals_a_loop(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        spot = rnd.choice([(45.0, -72.0), (45.01, -72.02), (-10.0, 100.0)]) if i % 3 else (rnd.uniform(-88, 88), rnd.uniform(-180, 180))
        layer = rnd.choice(["fixes", "http", "http", "launch"]) if i % 40 else "lone"
        rows.append((rnd.choice("ab"), layer, *spot, i // 2, i % 12, rnd.random() < 0.2, None, None))
    rows += [("a", "http", None, 1.0, 1, 1, False, None, None), ("a", "http", 91.0, 1.0, 1, 1, False, None, None), ("b", "http", 1.0, float("nan"), 2, 1, None, None, None)]
    rows += [("c", "mock", 45.0, -72.0, i, 1, i == 3, None, None) for i in range(12)] + [("c", "gaps", 45.0, -72.0, 2, 1, None, None, None)]
    rows += [("hot", "http", 1.0, 1.0, 7, 12, False, None, None)] * 100 + [("edge", "http", 90.0, 180.0, 1, 1, False, None, None)]
    key = lambda t: tuple((v is None, v if v is not None else 0) for v in t)
    got, want = sorted(result(spark, rows), key=key), sorted(brute([r for r in rows if not (r[3] is not None and math.isnan(r[3]))]), key=key)
    assert {r[2] for r in want} == {"cluster", "disc", "petal", "marker"}
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(g[7] - w[7]) < 1e-9 and abs(g[8] - w[8]) < 1e-9 for g, w in zip(got, want))


def test_pyramid_of_nothing(spark):
    assert result(spark, []) == []


def test_levels_count_all_markers(spark):
    rows = [("a", "http", (i * 37 % 170) - 85.0, (i * 91 % 360) - 180.0, i, 0, False, None, None) for i in range(500)]
    got = result(spark, rows)
    for zoom in range(TOP + 1):
        assert sum(1 if r[2] == "petal" else r[5] for r in got if r[1] == zoom) == 500


def test_features_of_a_map(spark):
    rows = [("c", "http", i, "Point", "[10.0,50.0]", '{"offset_clock":2}') for i in range(3)] + [("c", "fixes", 9, "Point", "[10.0,50.0]", "{}"), ("c", "track", 9, "LineString", "[[10.0,50.0],[10.1,50.0]]", "{}")]
    d = Y.of_features(spark.createDataFrame(rows, "capture_id string, layer string, seq bigint, geometry string, coordinates string, props string"), 3, 5)
    got = d.collect()
    assert {r.layer for r in got} == {"@03", "@04", "@05"} and len(got) == 12
    at = [json.loads(r.props) | {"at": json.loads(r.coordinates)} for r in got if r.layer == "@05"]
    assert sorted((p["role"], p["layer"], p["seq"], p.get("petal")) for p in at if p["role"] == "petal") == [("petal", "http", i, i) for i in range(3)]
    assert [p["layer"] for p in at if p["role"] == "marker"] == ["fixes"]
    assert all(abs(p["at"][0] - 10) < 0.01 and abs(p["at"][1] - 50) < 0.01 for p in at)
