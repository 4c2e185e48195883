"""Queries of the router, enrichment and text functions on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import payloads as P
from ..sources import records as R
from . import enrich, findings, pyramid, router
from .event_queries import events

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Log lines per kind of event: (level, class, method, message); the SQL below names what each means.
LINES = {
    "error": ("ERROR", "SQLiteLocationDAO", "persist", "database is locked"),
    "purchase": ("WARN", "PermissionManager", "check", "Permission denied"),
    "signup": ("INFO", "PermissionManager", "check", "Permission granted"),
    "view": ("WARN", "TSGeofenceManager", "handle", "Ignoring spurious geofence EXIT"),
    "click": ("INFO", "LifecycleManager", "handleOnResume", "motionchange: true"),
}


def _records(spark, d, lines=LINES):
    """One capture per day: a line per event, in the first grammar."""
    e = events(spark, d)

    def text(i):
        out = F.lit(None).cast("string")
        for kind, parts in lines.items():
            out = F.when(F.col("event_type") == kind, parts[i]).otherwise(out)
        return out

    line = F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit(" "), text(0), F.lit(" ["), text(1), F.lit(" "), text(2), F.lit("] "), text(3))
    rec = e.select("day", F.struct("event_id", line.alias("x")).alias("s"))
    g = rec.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("s"))["x"], "\n").alias("text"))
    return findings.marks(P.annotate(R.assemble(g.select(F.col("day").alias("capture_id"), F.lit("android").alias("platform"), F.lit(2024).alias("year"), "text"))))


_SEQ = "CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS seq"


@query(f"""SELECT {_SEQ}, CASE event_type WHEN 'error' THEN 'errors' WHEN 'purchase' THEN 'warnings' WHEN 'signup' THEN '' WHEN 'view' THEN 'geofence' ELSE 'lifecycle,motionchange' END AS layers FROM events""")
def route_layers(spark, d):
    m = router.with_context(_records(spark, d))
    return m.select("capture_id", "seq", F.array_join(router.layer_list(router.Rules(), m), ",").alias("layers"))


@query(f"""SELECT {_SEQ}, CASE event_type WHEN 'signup' THEN 'routine permission state' WHEN 'error' THEN 'storage' WHEN 'click' THEN 'platform' END AS reason FROM events""")
def route_suppressed(spark, d):
    rules = router.Rules(suppress=[
        {"match": "Ignoring", "when": "mock_locations", "reason": "mock"}, {"match": "motionchange", "platform": "ios", "reason": "other platform"},
        {"classes": ["SQLiteLocationDAO"], "unless_match": "disk full", "reason": "storage"}, {"match": "motion.*true", "platform": "android", "reason": "platform"},
    ])
    m = router.with_context(_records(spark, d))
    reason = router.suppression(rules, F.col("platform"), F.col("tag_class"), F.col("raw"), {"mock_locations": F.col("mock_locations")})
    return m.select("capture_id", "seq", reason.alias("reason"))


@query(f"""SELECT {_SEQ}, event_type IN ('signup') AS noise FROM events""")
def auth_noise(spark, d):
    return _records(spark, d).select("capture_id", "seq", router.auth_noise(F.col("tag_class"), F.col("raw")).alias("noise"))


@query("""SELECT event_id FROM events WHERE event_id % 3 <> 0 AND NOT (event_type = 'error' AND event_id % 2 = 0)""")
def suppress_union(spark, d):
    e = events(spark, d)
    a, b = e.where("event_id % 3 = 0").select("event_id"), e.where("event_type = 'error' and event_id % 2 = 0").select("event_id")
    return router.without(e, router.either(a, b)).select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'second' WHEN event_id % 2 = 0 THEN 'first' END AS a, CASE WHEN event_id % 2 = 0 THEN event_type END AS b FROM events""")
def decorate_props(spark, d):
    e = events(spark, d)
    one = e.where("event_id % 2 = 0").select("event_id", F.create_map(F.lit("a"), F.lit("first"), F.lit("b"), F.col("event_type")).alias("extra"))
    two = e.where("event_id % 3 = 0").select("event_id", F.create_map(F.lit("a"), F.lit("second")).alias("extra"))
    x = router.decorate(e, ["event_id"], one, two)
    return x.select("event_id", *(F.try_element_at("extra", F.lit(k)).alias(k) for k in "ab"))


@query("""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, event_type AS layer, epoch_us(ts) / 1e6 AS t FROM events), b AS (SELECT capture_id, min(t) + 3600 AS o, min(t) + 36000 AS c FROM e GROUP BY 1)
SELECT capture_id, layer, count(*) AS n, count(*) FILTER (t BETWEEN o AND c) AS shown FROM e JOIN b USING (capture_id) GROUP BY 1, 2""")
def window_counts(spark, d):
    e = events(spark, d).select(F.col("day").alias("capture_id"), F.col("event_type").alias("layer"), "ts")
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    b = e.groupBy("capture_id").agg((first + 3600).alias("open_s"), (first + 36000).alias("close_s"))
    return router.window_counts(e, b)


@query("""WITH x AS (SELECT unnest(['track', 'fixes', 'rejections', 'launch', 'lifecycle', 'errors', 'warnings', 'geofence', 'motionchange', 'http', 'gaps', 'mock', 'other']) AS layer, unnest(range(13)) AS rank, unnest([12, 12, 7, 12, 6, 3, 9, 10, 5, 2, 12, 11, 12]) AS clock),
e AS (SELECT event_id, ['errors', 'gaps', 'http', 'mock', 'other', 'track', 'launch'][1 + event_id % 7] AS layer FROM events) SELECT event_id, layer, CAST(rank AS INTEGER) AS rank, CAST(clock AS INTEGER) AS clock FROM e JOIN x USING (layer)""")
def layer_order(spark, d):
    names = F.array(*map(F.lit, ("errors", "gaps", "http", "mock", "other", "track", "launch")))
    e = events(spark, d).select("event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("layer"))
    return e.withColumn("rank", router.layer_rank(router.Rules(), F.col("layer"))).withColumn("clock", router.layer_setting(router.Rules(), F.col("layer"), "clock", router.CLOCK))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'bolt' WHEN event_type IN ('view', 'click') AND user_id % 2 = 0 THEN 'own' WHEN event_type = 'view' THEN 'shared' ELSE 'layer' END AS icon,
CASE WHEN event_type = 'error' THEN 'red' WHEN event_type IN ('view', 'click') AND user_id % 2 = 0 THEN 'amber' END AS tint FROM events""")
def layer_icon(spark, d):
    rules = router.Rules(
        layers={"http": {"icon": "layer"}}, events={"error": {"icon": "bolt"}}, tints={"bolt": "red", "own": "green"},
        rules=[{"match": "view", "layer": "http", "icon": "shared"}, {"match": "view|click", "layer": "http", "platform": "ios", "icon": "own", "tint": "amber"}, {"match": ".", "layer": "mock", "icon": "never"}],
    )
    e = events(spark, d).withColumn("platform", F.when(F.col("user_id") % 2 == 0, "ios").otherwise("android"))
    # an event has its own icon; its rule still gives the tint
    event = F.when(F.col("event_type") == "error", "error")
    icon, tint = router.icon(rules, F.col("platform"), F.lit("http"), event, F.col("event_type"))
    return e.select("event_id", icon.alias("icon"), tint.alias("tint"))


@query("""WITH n AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS k, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT day, string_agg(k || '×' || n, ', ' ORDER BY n DESC, f) AS histogram FROM n GROUP BY 1""")
def histogram_text(spark, d):
    n = events(spark, d).groupBy("day", F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.groupBy("day").agg(F.collect_list(F.struct("key", "n", "first")).alias("c")).select("day", X.histogram_text(F.col("c")).alias("histogram"))


@query("""SELECT event_id, 'session ' || (event_id % 9) || ' of 9' || CASE WHEN user_id % 5000 >= 100 THEN ' · ' || printf('%.1f', ((user_id % 5000) + 0.5) / 1000) || ' km' ELSE '' END || CASE WHEN event_type <> 'view' THEN ' · ended by ' || event_type ELSE '' END AS label FROM events""")
def session_label(spark, d):
    i = (F.col("event_id") % 9).alias("i")
    # half a metre more, so that no distance lies between two tenths
    far = F.when(F.col("user_id") % 5000 >= 100, (F.col("user_id") % 5000) + 0.5).otherwise(0.0)
    return events(spark, d).select("event_id", X.session_label(i, F.lit(9), far, F.when(F.col("event_type") != "view", F.col("event_type"))).alias("label"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.2.3' WHEN 1 THEN '4.5' WHEN 2 THEN NULL END AS version FROM events""")
def build_version(spark, d):
    given = F.when(F.col("event_id") % 4 == 0, "1.2.3").when(F.col("event_id") % 4 == 1, "100").when(F.col("event_id") % 4 == 2, "101")
    return events(spark, d).select("event_id", X.resolve_version(given, {"100": "4.5"}).alias("version"))


@query("""WITH s AS (SELECT event_id, event_id % 20000 + 0.25 AS s FROM events) SELECT event_id, CASE WHEN s < 90 THEN printf('%.0f', s) || ' s' WHEN s < 5400 THEN printf('%.1f', s / 60) || ' min' ELSE printf('%.1f', s / 3600) || ' h' END AS said FROM s""")
def duration_words(spark, d):
    return events(spark, d).select("event_id", X.duration_text(F.col("event_id") % 20000 + F.lit(0.25)).alias("said"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN (event_id % 60) * 60000 + event_id % 1000 ELSE (event_id % 30) * 86400000 + (event_id % 24) * 3600000 + 5000 END AS ms FROM events""")
def duration_parsed(spark, d):
    n = lambda k: (F.col("event_id") % k).cast("string")
    text = F.when(F.col("event_id") % 3 == 2, "soon").when(F.col("event_id") % 3 == 1, F.concat(n(60), F.lit("m"), n(1000), F.lit("ms"))).otherwise(F.concat(n(30), F.lit("d"), n(24), F.lit("h5s")))
    return events(spark, d).select("event_id", X.duration_ms(text).alias("ms"))


@query("""WITH s AS (SELECT event_id, CAST(1 + event_id * 37 % 900000 AS DOUBLE) AS span FROM events), k AS (SELECT unnest([1, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800]) AS step)
SELECT event_id, CAST(coalesce(min(step) FILTER (span / step <= 9), 604800) AS INTEGER) AS step FROM s, k GROUP BY event_id""")
def axis_step(spark, d):
    return events(spark, d).select("event_id", X.axis_step_s((1 + F.col("event_id") * 37 % 900000).cast("double")).cast("int").alias("step"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN -1 ELSE CAST(least(7, floor(least(event_id % 40, 29.99) / 30 * 8)) AS INTEGER) END AS bucket FROM events""")
def speed_buckets(spark, d):
    return events(spark, d).select("event_id", X.speed_bucket(F.when(F.col("event_type") != "view", (F.col("event_id") % 40).cast("double"))).alias("bucket"))


@query("""WITH t AS (SELECT event_id, event_type || ' isMoving: ' || CASE WHEN event_id % 2 = 0 THEN 'true isMoving: false' ELSE 'false isMoving: true' END AS x, event_type = 'view' AS none FROM events) SELECT event_id, CASE WHEN none THEN NULL ELSE event_id % 2 = 0 END AS moving FROM t""")
def first_direction(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, " isMoving: true isMoving: false").otherwise(" isMoving: false isMoving: true")
    text = F.concat("event_type", F.when(F.col("event_type") == "view", "").otherwise(said))
    return events(spark, d).select("event_id", X.earliest_direction(text, ["isMoving: true", "isMoving: 1"], ["isMoving: false", "isMoving: 0"]).alias("moving"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, length(t) - length(replace(t, 'e', '')) = length(t) - length(replace(t, 'a', '')) AS same FROM d""")
def balanced_text(spark, d):
    t = F.translate(F.coalesce("text", F.lit("")), "{}ea", "  {}")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.balanced(F.translate(t, "╔╚", "")).alias("same"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'geofence' ELSE NULL END AS severity, event_type, user_id % 3 + 1 AS n FROM events)
SELECT event_id, event_type AS category, CASE WHEN n > 1 THEN n END AS n FROM s""")
def compact_round_trip(spark, d):
    """Properties at their defaults leave and come back: what is shown is what came back, and the counts that stayed."""
    e = events(spark, d).select("event_id", F.col("event_type").alias("layer"), F.col("event_type").alias("category"), (F.col("user_id") % 3 + 1).alias("count"))
    small = enrich.compact(e).withColumn("n", F.col("count"))
    return enrich.inflate(small).select("event_id", "category", "n")


#: Two kinds of persisted records for one of destroyed ones: about half of the days are out of balance.
LIFE = {
    "view": ("INFO", "SQLiteLocationDAO", "persist", "ok"), "purchase": ("INFO", "SQLiteLocationDAO", "persist", "more"), "click": ("INFO", "SQLiteLocationDAO", "destroy", "ok"),
    "error": ("INFO", "HttpService", "flush", "HTTP POST: a"), "signup": ("INFO", "Tasks", "run", "startBackgroundTask: 1"),
}


@query("""WITH g AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, count(*) FILTER (event_type IN ('view', 'purchase')) AS persisted, count(*) FILTER (event_type = 'error') AS posted, count(*) FILTER (event_type = 'click') AS destroyed,
count(*) FILTER (event_type = 'signup') AS task_start, CAST(0 AS BIGINT) AS task_stop FROM events GROUP BY 1)
SELECT *, persisted >= 10 AND 2 * destroyed < persisted AND capture_id NOT LIKE '%5' AS imbalance FROM g""")
def parity_by_config(spark, d):
    m = _records(spark, d, LIFE)
    cfg = m.select("capture_id").distinct().select("capture_id", F.lit("http.autoSync").alias("key"), F.when(F.col("capture_id").like("%5"), "false").otherwise("true").alias("value"))
    return findings.parity(m, cfg)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, 'v' || min(event_id) AS a, 'deep' AS b FROM events WHERE event_type = 'view' GROUP BY 1""")
def config_settings(spark, d):
    e = events(spark, d).where("event_type = 'view'").groupBy(F.col("day").alias("capture_id")).agg(F.min("event_id").alias("m"))
    given = {"a": F.concat(F.lit("v"), "m"), "x.a": F.lit("hidden"), "x.y.b": F.lit("deeper"), "x.b": F.lit("deep")}
    pairs = F.create_map(*(c for k, v in given.items() for c in (F.lit(k), v)))
    return findings.settings(e.select("capture_id", F.explode(pairs)), a="a", b="b")


_WORLD = "(SELECT user_id % 3 AS grp, event_type AS layer, event_id AS seq, CAST(event_id % 1700 AS DOUBLE) / 20 - 42 AS lat, CAST((event_id * 7) % 3000 AS DOUBLE) / 10 - 150 AS lon, user_id % 5 = 0 AS own FROM events)"
_TOP, _LEAST = 8, 150


@query(f"""WITH e AS {_WORLD},
p AS (SELECT *, CAST(floor((lon + 180) / 360 * {256 << _TOP} * 16) AS BIGINT) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {256 << _TOP} * 16) AS BIGINT) AS y,
  count(*) OVER (PARTITION BY grp, layer) AS total FROM e),
z AS (SELECT p.*, CAST(r.zoom AS INTEGER) AS zoom, CAST(1 << CAST({_TOP} - r.zoom AS INTEGER) AS BIGINT) AS k FROM p, range(0, {_TOP + 1}) r(zoom)),
c AS (SELECT *, count(*) OVER cell AS m, sum(x) OVER cell AS sx, sum(y) OVER cell AS sy, min(seq) OVER cell AS first FROM z WINDOW cell AS (PARTITION BY grp, layer, zoom, x // (1024 * k), y // (1024 * k))),
a AS (SELECT *, CASE WHEN own THEN -seq ELSE (x + 144 * k) // (288 * k) END AS px, CASE WHEN own THEN -seq ELSE (y + 144 * k) // (288 * k) END AS py FROM c WHERE total <= {_LEAST} OR m = 1),
g AS (SELECT *, count(*) OVER w AS n, sum(x) OVER w AS wx, sum(y) OVER w AS wy, row_number() OVER (PARTITION BY grp, zoom, px, py ORDER BY seq) - 1 AS i FROM a WINDOW w AS (PARTITION BY grp, zoom, px, py))
SELECT grp, zoom, 'cluster' AS role, layer, seq, m AS n, CAST(NULL AS INTEGER) AS petal, CAST(sx AS DOUBLE) / m / (16.0 * k) AS x, CAST(sy AS DOUBLE) / m / (16.0 * k) AS y FROM c WHERE total > {_LEAST} AND m > 1 AND seq = first
UNION ALL SELECT grp, zoom, CASE WHEN n = 1 THEN 'marker' WHEN n <= 8 THEN 'petal' ELSE 'disc' END, layer, seq, n, CASE WHEN n BETWEEN 2 AND 8 THEN CAST(i AS INTEGER) END, CAST(wx AS DOUBLE) / n / (16.0 * k), CAST(wy AS DOUBLE) / n / (16.0 * k) FROM g WHERE n <= 8 OR i = 0""")
def zoom_pyramid(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    m = e.select(
        (F.col("user_id") % 3).alias("grp"), F.col("event_type").alias("layer"), F.col("event_id").alias("seq"), ((F.col("event_id") % 1700).cast("double") / 20 - 42).alias("lat"),
        (((F.col("event_id") * 7) % 3000).cast("double") / 10 - 150).alias("lon"), (F.col("user_id") % 5 == 0).alias("own"),
    )
    return pyramid.pyramid(m, ["grp"], "layer", "lat", "lon", "seq", F.lit(0), F.col("own"), top=_TOP, least=_LEAST)
