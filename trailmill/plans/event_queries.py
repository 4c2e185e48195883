"""Sequence, join and aggregate operators on the ``events`` table: a capture is a day, event_id its order; errors,
purchases, views, clicks and signups play errors, warnings, position fixes, dispatches and process banners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregate as A
from ..operators import asof as J
from ..operators import scan
from ..operators import sequence as S

BY, ORDER = ["day"], ["event_id"]


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _kind(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _us(c: str, name: str | None = None) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")).alias(name or c)


def _positions(e: DataFrame) -> DataFrame:
    """Views as position fixes: made-up but deterministic coordinates."""
    lat = (F.col("event_id") % 1000).cast("double") / 10 - 50
    lon = ((F.col("event_id") * 7) % 3000).cast("double") / 10 - 150
    return e.where(_kind("view")).withColumn("lat", lat).withColumn("lon", lon)


E = "e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(ts) AS us FROM events)"
FIX = E + ", f AS (SELECT *, CAST(event_id % 1000 AS DOUBLE) / 10 - 50 AS lat, CAST((event_id * 7) % 3000 AS DOUBLE) / 10 - 150 AS lon FROM e WHERE event_type = 'view')"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {E}, g AS (SELECT *, lag(us) OVER (PARTITION BY day ORDER BY event_id) AS before FROM e)
SELECT day, event_id, before AS start_us, (us - before) / 1e6 AS gap_s FROM g WHERE (us - before) / 1e6 >= 900""")
def gap_detect(spark, d):
    g = S.gaps(events(spark, d), BY, ORDER, "ts", 900.0)
    return g.select("day", "event_id", _us("start", "start_us"), "gap_s")


_LOOK = " OR ".join(f"coalesce(t{i} AND {' AND '.join([f'coalesce(d{j} <= 60000000, true)' for j in range(i + 1)])}, false)" for i in range(8))


def _look_sql(kind: str) -> str:
    cols = ", ".join(f"lead(event_type = '{kind}', {i}) OVER w AS t{i}, lead(us, {i}) OVER w - us AS d{i}" for i in range(8))
    return f"SELECT day, event_id, {_LOOK} AS found FROM (SELECT day, event_id, {cols} FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id)) x"


@query(f"""WITH {E}, g AS (SELECT *, lag(us) OVER (PARTITION BY day ORDER BY event_id) AS before FROM e),
b AS ({_look_sql('signup')}), a AS ({_look_sql('click')})
SELECT g.day, g.event_id, (us - before) / 1e6 AS gap_s, CASE WHEN b.found THEN 'death' WHEN user_id % 2 = 0 AND a.found THEN 'scheduler-window' WHEN user_id % 2 = 1 THEN 'suspension' ELSE 'wedge-candidate' END AS kind
FROM g JOIN b USING (day, event_id) JOIN a USING (day, event_id) WHERE (us - before) / 1e6 >= 900""")
def gap_classify(spark, d):
    e = events(spark, d)
    e = e.withColumn("banner", S.lookahead(e, BY, ORDER, "ts", _kind("signup"))).withColumn("alarm", S.lookahead(e, BY, ORDER, "ts", _kind("click")))
    platform = F.when(F.col("user_id") % 2 == 0, "android").otherwise("ios")
    g = S.gaps(e, BY, ORDER, "ts", 900.0)
    return g.select("day", "event_id", "gap_s", S.classify_gap(F.col("banner"), F.col("alarm"), platform).alias("kind"))


@query(f"""WITH {E}, s AS (SELECT day, event_id, us, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY event_id) AS n,
min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY day) - min(event_id) OVER (PARTITION BY day) AS lead_in FROM e),
t AS (SELECT *, greatest(n - CASE WHEN coalesce(lead_in <= 3, false) THEN 1 ELSE 0 END, 0) AS segment FROM s)
SELECT day, CAST(segment AS BIGINT) AS segment, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n FROM t GROUP BY day, segment""")
def segments_from_banner(spark, d):
    e = events(spark, d)
    e = e.withColumn("segment", S.segments(e, BY, "event_id", _kind("signup")))
    return e.groupBy("day", "segment").agg(F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"), F.count("*").alias("n")).withColumn("segment", F.col("segment").cast("bigint"))


def _lane(spark, d) -> DataFrame:
    e = events(spark, d)
    first = F.lag("event_id").over(S.window(BY, ORDER)).isNull()
    e = e.withColumn("__first", first)
    reset = F.when(_kind("signup") & ~F.col("__first"), F.when(F.col("user_id") % 3 == 0, "headless").otherwise("unknown"))
    strong = F.when(_kind("view"), "foreground").when(_kind("error"), "background")
    return S.state_lane(e, BY, ORDER, reset, strong, F.col("value") > 90, _kind("click")).drop("__first")


_LANE = E + """, x AS (SELECT *, CASE WHEN event_type = 'signup' AND lag(event_id) OVER w IS NOT NULL THEN CASE WHEN user_id % 3 = 0 THEN 'headless' ELSE 'unknown' END END AS r,
CASE event_type WHEN 'view' THEN 'foreground' WHEN 'error' THEN 'background' END AS s FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id)),
y AS (SELECT *, coalesce(last_value(coalesce(s, r) IGNORE NULLS) OVER (PARTITION BY day ORDER BY event_id), 'unknown') AS base, count(coalesce(s, r)) OVER (PARTITION BY day ORDER BY event_id) AS isle FROM x),
z AS (SELECT *, bool_or(coalesce(value > 90, false)) OVER v AS weak, bool_or(event_type = 'click') OVER v AS conf FROM y WINDOW v AS (PARTITION BY day, isle ORDER BY event_id)),
l AS (SELECT *, CASE WHEN base IN ('foreground', 'headless') THEN base WHEN weak OR (base = 'unknown' AND conf) THEN 'headless' ELSE base END AS state FROM z),
m AS (SELECT *, lag(state) OVER (PARTITION BY day ORDER BY event_id) AS s0 FROM l),
n AS (SELECT *, s0 IS NULL OR coalesce(r, s0) <> s0 OR coalesce(s, r, s0) <> coalesce(r, s0) OR state <> coalesce(s, r, s0) AS boundary FROM m)"""


@query(f"WITH {_LANE} SELECT day, state, count(*) AS n, CAST(sum(CASE WHEN boundary THEN 1 ELSE 0 END) AS BIGINT) AS boundaries FROM n GROUP BY day, state")
def app_state_lane(spark, d):
    return _lane(spark, d).groupBy("day", "state").agg(F.count("*").alias("n"), F.count_if("boundary").alias("boundaries"))


@query(f"""WITH {_LANE}, i AS (SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY event_id) AS k FROM n)
SELECT day, CAST(k AS BIGINT) AS interval_no, arg_min(state, event_id) AS state, min(event_id) AS first_seq, max(event_id) AS last_seq, min(us) AS start_us, max(us) AS end_us FROM i GROUP BY day, k""")
def lane_intervals(spark, d):
    i = S.lane_intervals(_lane(spark, d), BY, "event_id", "us")
    return i.select("day", F.col("interval").alias("interval_no"), "state", "first_seq", "last_seq", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


_SESS = FIX + """, r AS (SELECT *, sum(CASE WHEN (us - before) / 1e6 >= 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY us, event_id) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY day ORDER BY us, event_id) AS before FROM f)),
k AS (SELECT *, count(*) OVER (PARTITION BY day, run) AS size FROM r),
s AS (SELECT *, dense_rank() OVER (PARTITION BY day ORDER BY run) - 1 AS session FROM k WHERE size >= 2),
h AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM s WINDOW w AS (PARTITION BY day, session ORDER BY us, event_id)),
q AS (SELECT day, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n, sum(CASE WHEN lat0 IS NULL THEN 0 ELSE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) END) AS distance_m FROM h GROUP BY day, session)"""


def _sessions(spark, d) -> DataFrame:
    f = S.sessions(_positions(events(spark, d)), BY, "ts", ORDER, 1200.0)
    return S.session_summary(f, BY, "ts", ORDER, "lat", "lon")


@query(f"WITH {_SESS} SELECT day, CAST(session AS BIGINT) AS session, start_us, end_us, n FROM q")
def tracking_sessions(spark, d):
    return _sessions(spark, d).select("day", *_long("session"), _us("start", "start_us"), _us("end", "end_us"), "n")


@query(f"WITH {_SESS} SELECT day, CAST(session AS BIGINT) AS session, round(distance_m / 1000, 0) AS distance_km FROM q")
def session_distance(spark, d):
    return _sessions(spark, d).select("day", *_long("session"), F.round(F.col("distance_m") / 1000, 0).alias("distance_km"))


@query(f"""WITH {_SESS}, c AS (SELECT day, min(us) / 1e6 AS f, max(us) / 1e6 AS l FROM e GROUP BY day),
b AS (SELECT q.day, session, start_us / 1e6 AS a, end_us / 1e6 AS z, f, l, lag(end_us / 1e6) OVER w AS before, lead(start_us / 1e6) OVER w AS after FROM q JOIN c ON q.day = c.day WINDOW w AS (PARTITION BY q.day ORDER BY session))
SELECT day, CAST(session AS BIGINT) AS session, greatest(a - 300, coalesce((before + a) / 2, f), f) AS low_s, least(z + 300, coalesce((z + after) / 2, l), l) AS high_s FROM b""")
def session_bounds(spark, d):
    e = events(spark, d)
    capture = e.groupBy("day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return S.session_bounds(_sessions(spark, d), BY, capture).select("day", *_long("session"), "low_s", "high_s")


@query(f"""WITH {_SESS}, g AS (SELECT * FROM (SELECT day, event_id, lag(us) OVER (PARTITION BY day ORDER BY event_id) AS start_g, us FROM e) WHERE (us - start_g) / 1e6 >= 900),
n AS (SELECT day, session, end_us, lead(start_us) OVER (PARTITION BY day ORDER BY session) AS next_us FROM q),
j AS (SELECT n.day, session, (us - start_g) / 1e6 AS gap_s, start_g, row_number() OVER (PARTITION BY n.day, session ORDER BY (us - start_g) DESC, start_g) AS r FROM n JOIN g ON n.day = g.day AND start_g >= end_us AND coalesce(start_g < next_us, true))
SELECT n.day, CAST(n.session AS BIGINT) AS session, gap_s, coalesce(start_g, -1) AS gap_start_us FROM n LEFT JOIN j ON n.day = j.day AND n.session = j.session AND r = 1""")
def session_ended_by(spark, d):
    g = S.gaps(events(spark, d), BY, ORDER, "ts", 900.0).select("day", _us("start", "start_us"), "gap_s")
    s = _sessions(spark, d).select("day", "session", _us("end", "end_us"), _us("start", "s_us"))
    s = s.withColumn("next_us", F.lead("s_us").over(S.window(BY, ["session"])))
    out = J.longest_in(s, g, BY, "session", F.col("end_us"), F.col("next_us"), "start_us", "gap_s", ["gap_s", "start_us"])
    return out.select("day", *_long("session"), F.col("gap_gap_s").alias("gap_s"), F.coalesce("gap_start_us", F.lit(-1)).alias("gap_start_us"))


# One stream: all events as a single capture, dealt in segments ----------------------------------------------------------

ONE = "e AS (SELECT *, 0 AS one, epoch_us(ts) AS us FROM events)"


def _one(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("one", F.lit(0)).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return scan.deal(e, ["one"], ["event_id"], 20_000)


@query(f"""WITH {ONE}, g AS (SELECT *, lag(us) OVER (ORDER BY event_id) AS before FROM e),
l AS (SELECT event_id, {_LOOK} AS found FROM (SELECT event_id, {", ".join(f"lead(event_type = 'signup', {i}) OVER w AS t{i}, lead(us, {i}) OVER w - us AS d{i}" for i in range(8))} FROM e WINDOW w AS (ORDER BY event_id)) x)
SELECT g.event_id, before AS start_us, (us - before) / 1e6 AS gap_s, found FROM g JOIN l ON g.event_id = l.event_id WHERE (us - before) / 1e6 >= 600""")
def one_stream_gaps(spark, d):
    e = S.look_ahead(_one(spark, d), ["one"], ORDER, "ts", {"found": _kind("signup")})
    return S.gaps(e, ["one"], ORDER, "ts", 600.0).select("event_id", _us("start", "start_us"), "gap_s", "found")


@query(f"""WITH {_LANE.replace(E, ONE).replace("PARTITION BY day, isle", "PARTITION BY isle").replace("PARTITION BY day ", "")}, i AS (SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS k FROM n)
SELECT CAST(k AS BIGINT) AS interval_no, arg_min(state, event_id) AS state, min(event_id) AS first_seq, max(event_id) AS last_seq, min(us) AS start_us, max(us) AS end_us FROM i GROUP BY k""")
def one_stream_lane(spark, d):
    e = scan.run(_one(spark, d), ["one"], ORDER, before=scan.previous(F.col("event_id")))
    reset = F.when(_kind("signup") & F.col("before").isNotNull(), F.when(F.col("user_id") % 3 == 0, "headless").otherwise("unknown"))
    strong = F.when(_kind("view"), "foreground").when(_kind("error"), "background")
    lane = S.state_lane(e, ["one"], ORDER, reset, strong, F.col("value") > 90, _kind("click"))
    i = S.lane_intervals(lane, ["one"], "event_id", "us")
    return i.select(F.col("interval").alias("interval_no"), "state", "first_seq", "last_seq", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


_ONE_SESS = _SESS.replace(E, ONE).replace("PARTITION BY day, ", "PARTITION BY ").replace("PARTITION BY day ", "").replace("SELECT day, ", "SELECT ").replace("GROUP BY day, ", "GROUP BY ").replace(">= 1200", ">= 300")


@query(f"""WITH {_ONE_SESS}, n AS (SELECT *, lead(start_us) OVER (ORDER BY session) AS next_us FROM q),
g AS (SELECT * FROM (SELECT us AS gap_at, (us - lag(us) OVER (ORDER BY us, event_id)) / 1e6 AS gap_s FROM e) WHERE gap_s >= 60),
j AS (SELECT session, gap_s, gap_at, row_number() OVER (PARTITION BY session ORDER BY gap_s DESC, gap_at) AS r FROM n JOIN g ON gap_at >= start_us AND coalesce(gap_at < next_us + 600000000, true)),
c AS (SELECT session, count(*) AS events FROM n JOIN e ON us BETWEEN start_us - 300000000 AND end_us + 300000000 GROUP BY session)
SELECT CAST(n.session AS BIGINT) AS session, start_us, end_us, n.n, events, coalesce(gap_s, -1) AS longest_s, coalesce(gap_at, -1) AS longest_at FROM n JOIN c ON c.session = n.session LEFT JOIN j ON j.session = n.session AND r = 1""")
def one_stream_sessions(spark, d):
    """Sessions, the events within five minutes of each, and the longest silence up to ten minutes into the next one: both
    kinds of intervals overlap."""
    e = _one(spark, d)
    order, one = ["ts", "event_id"], ["one"]
    s = S.session_summary(S.sessions(scan.deal(_positions(e), one, order, 5_000), one, "ts", ORDER, 300.0), one, "ts", ORDER, "lat", "lon")
    s = s.select("one", "session", _us("start", "start_us"), _us("end", "end_us"), "n").withColumnRenamed("n", "fixes")
    s = s.withColumn("next_us", F.lead("start_us").over(S.window(one, ["session"]))).withColumn("low", F.col("start_us") - 300_000_000).withColumn("high", F.col("end_us") + 300_000_000)
    silences = S.gaps(scan.deal(e, one, order, 20_000), one, order, "ts", 60.0).select("one", F.col("us").alias("at"), "gap_s")
    out = J.longest_in(s, silences, one, "session", F.col("start_us"), F.col("next_us") + 600_000_000, "at", "gap_s", ["gap_s", "at"], True)
    out = out.join(J.count_between(s, e, one, ["session"], "low", "high", "us", True).withColumnRenamed("n", "events"), [*one, "session"])
    return out.select(*_long("session"), "start_us", "end_us", F.col("fixes").alias("n"), "events", F.coalesce("gap_gap_s", F.lit(-1.0)).alias("longest_s"), F.coalesce("gap_at", F.lit(-1)).alias("longest_at"))


@query(f"""WITH {E}, x AS (SELECT day, CAST(event_type IN ('click', 'signup') AS INT) AS f, CAST(event_type IN ('purchase', 'signup') AS INT) AS s, sum(CAST(event_type IN ('click', 'signup') AS INT) - CAST(event_type IN ('purchase', 'signup') AS INT)) OVER (PARTITION BY day ORDER BY event_id) AS depth FROM e),
g AS (SELECT day, sum(f) AS firsts, sum(s) AS seconds, greatest(0, -min(depth)) AS orphans FROM x GROUP BY day)
SELECT day, CAST(firsts AS BIGINT) AS firsts, CAST(seconds AS BIGINT) AS seconds, CAST(orphans AS BIGINT) AS orphans, CAST(seconds - orphans AS BIGINT) AS paired, CAST(firsts - (seconds - orphans) AS BIGINT) AS unpaired FROM g""")
def pair_balance(spark, d):
    out = S.pair_balance(events(spark, d), BY, ORDER, _kind("click", "signup"), _kind("purchase", "signup"))
    return out.select("day", *_long("firsts", "seconds", "orphans", "paired", "unpaired"))


@query(f"""WITH {E}, x AS (SELECT *, lag(event_type) OVER w AS k0, lag(us) OVER w AS t0 FROM e WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' AND k0 = 'click' THEN (us - t0) / 1e6 END AS paired_s FROM x)
SELECT event_id, event_type, paired_s, coalesce(paired_s BETWEEN 0 AND 86400, false) AS delivered FROM y""")
def consume_pairs(spark, d):
    out = S.consume_pairs(events(spark, d), ["user_id"], ORDER, "ts", "event_type", "click", "purchase", 86400.0)
    return out.select("event_id", "event_type", "paired_s", "delivered")


@query(f"""WITH {E}, x AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS episode, last_value(CASE WHEN event_type = 'signup' THEN us END IGNORE NULLS) OVER w AS t FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id)),
y AS (SELECT *, event_type = 'error' AND coalesce(abs(us - t) / 1e6 > 600, false) AS far FROM x), z AS (SELECT *, bool_or(far) OVER (PARTITION BY day, episode ORDER BY event_id) AS ended FROM y)
SELECT day, event_id, CAST(episode AS BIGINT) AS episode, event_type = 'error' AND episode > 0 AND NOT ended AS folded FROM z WHERE event_type IN ('signup', 'error')""")
def episode_collapse(spark, d):
    out = S.episodes(events(spark, d), BY, ORDER, "ts", _kind("signup"), _kind("error"), 600.0).where(_kind("signup", "error"))
    return out.select("day", "event_id", *_long("episode"), "folded")


@query(f"""WITH {E}, x AS (SELECT *, event_type = 'purchase' AND value >= 50 AS eff FROM e), y AS (SELECT *, coalesce(sum(CAST(eff AS INT)) OVER (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isle FROM x),
z AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN user_id END IGNORE NULLS) OVER (PARTITION BY day, isle ORDER BY event_id) AS last_status FROM y) SELECT day, event_id, coalesce(last_status, -1) AS last_status FROM z WHERE eff""")
def flush_outcome(spark, d):
    out = S.flush_outcomes(events(spark, d), BY, ORDER, F.when(_kind("view"), F.col("user_id")), _kind("purchase"), F.col("value") < 50)
    return out.select("day", "event_id", F.coalesce("last_status", F.lit(-1)).alias("last_status"))


@query(f"""WITH {E}, x AS (SELECT day, event_type, (us - lag(us) OVER (PARTITION BY day, event_type ORDER BY event_id)) / 1e6 AS dt FROM e)
SELECT day, event_type, count(*) AS n, median(dt) AS median_s, max(dt) AS max_s FROM x GROUP BY day, event_type""")
def heartbeat_cadence(spark, d):
    return S.cadence(events(spark, d), ["day", "event_type"], ORDER, "ts")


@query(f"""WITH {E}, x AS (SELECT day, event_id, us, event_type = 'view' AS mv, lag(event_type = 'view') OVER w AS mv0, coalesce(lead(us) OVER w, max(us) OVER (PARTITION BY day)) AS nxt FROM e WHERE event_type IN ('view', 'error') WINDOW w AS (PARTITION BY day ORDER BY event_id))
SELECT day, CAST(sum(CASE WHEN mv <> mv0 THEN 1 ELSE 0 END) AS BIGINT) AS flips, round(sum(CASE WHEN mv THEN (nxt - us) / 1e6 ELSE 0 END), 3) AS on_s, round(sum((nxt - us) / 1e6), 3) AS span_s FROM x GROUP BY day""")
def dwell_ratio(spark, d):
    e = events(spark, d).where(_kind("view", "error")).withColumn("mv", _kind("view"))
    e = e.withColumn("end", F.max("ts").over(S.Window.partitionBy("day")))
    out = S.dwell_ratio(e, BY, ORDER, "ts", "mv", "end")
    return out.select("day", "flips", F.round("on_s", 3).alias("on_s"), F.round("span_s", 3).alias("span_s"))


@query(f"""WITH {E}, x AS (SELECT day, event_type, lag(event_type) OVER (PARTITION BY day ORDER BY event_id) AS before FROM e)
SELECT day, count(*) AS n, CAST(sum(CASE WHEN event_type <> before THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM x GROUP BY day""")
def pace_flips(spark, d):
    return S.change_count(events(spark, d), BY, ORDER, "event_type")


@query(f"""WITH {E} SELECT day, coalesce(arg_max(user_id, event_id) FILTER (event_type = 'view'), -1) AS last_viewer, coalesce(arg_max(user_id, event_id) FILTER (event_type = 'signup'), -1) AS last_signup, arg_max(value, event_id) FILTER (value > 90) AS last_high FROM e GROUP BY day""")
def last_known_state(spark, d):
    out = S.last_state(events(spark, d), BY, "event_id", {"last_viewer": F.when(_kind("view"), F.col("user_id")), "last_signup": F.when(_kind("signup"), F.col("user_id")), "last_high": F.when(F.col("value") > 90, F.col("value"))})
    return out.select("day", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("last_viewer", "last_signup")), "last_high")


_NEAR = FIX + """, u AS (SELECT day, us, event_id, 0 AS k, NULL AS f_us, NULL AS f_id, NULL AS lat, NULL AS lon FROM e WHERE event_type <> 'view' UNION ALL SELECT day, us, event_id, 1, us, event_id, lat, lon FROM f),
v AS (SELECT *, last_value(f_us IGNORE NULLS) OVER p AS p_us, last_value(f_id IGNORE NULLS) OVER p AS p_id, last_value(lat IGNORE NULLS) OVER p AS p_lat, last_value(lon IGNORE NULLS) OVER p AS p_lon,
first_value(f_us IGNORE NULLS) OVER n AS n_us, first_value(f_id IGNORE NULLS) OVER n AS n_id, first_value(lat IGNORE NULLS) OVER n AS n_lat, first_value(lon IGNORE NULLS) OVER n AS n_lon FROM u
WINDOW p AS (PARTITION BY day ORDER BY us, k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY day ORDER BY us, k, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
w AS (SELECT *, (us - p_us) / 1e6 AS b, (n_us - us) / 1e6 AS a FROM v WHERE k = 0)"""


def _neighbours(spark, d) -> DataFrame:
    e = events(spark, d)
    f = _positions(e).withColumn("fix_id", F.col("event_id"))
    return J.neighbours(e.where(~_kind("view")), f, BY, "ts", ["event_id"], ["fix_id", "lat", "lon"])


@query(f"""WITH {_NEAR}, t AS (SELECT *, coalesce(b <= a, a IS NULL) AS first FROM w), s AS (SELECT *, CASE WHEN first THEN b ELSE a END AS dt FROM t)
SELECT event_id, CASE WHEN dt <= 120 THEN 'placed' WHEN p_us IS NOT NULL OR n_us IS NOT NULL THEN 'tethered' END AS placement,
round(CASE WHEN dt <= 120 AND a + b > 0 AND a + b <= 600 THEN p_lat + (n_lat - p_lat) * (b / (b + a)) WHEN dt <= 120 THEN CASE WHEN first THEN p_lat ELSE n_lat END ELSE coalesce(p_lat, n_lat) END, 6) AS lat,
round(CASE WHEN dt <= 120 AND a + b > 0 AND a + b <= 600 THEN p_lon + (n_lon - p_lon) * (b / (b + a)) WHEN dt <= 120 THEN CASE WHEN first THEN p_lon ELSE n_lon END ELSE coalesce(p_lon, n_lon) END, 6) AS lon,
CASE WHEN dt <= 120 THEN dt ELSE coalesce(b, a) END AS dt_s FROM s""")
def locate_placed_tethered(spark, d):
    out = J.locate(_neighbours(spark, d), "ts", "lat", "lon")
    return out.select("event_id", "placement", F.round("at_lat", 6).alias("lat"), F.round("at_lon", 6).alias("lon"), "dt_s")


@query(f"WITH {_NEAR} SELECT event_id, coalesce(CASE WHEN coalesce(b <= a, a IS NULL) THEN p_id ELSE n_id END, -1) AS near_id, CASE WHEN coalesce(b <= a, a IS NULL) THEN -b ELSE a END AS signed_s FROM w")
def nearest_signed(spark, d):
    return J.nearest(_neighbours(spark, d), "ts", ["fix_id"]).select("event_id", F.coalesce("near_fix_id", F.lit(-1)).alias("near_id"), "signed_s")


@query(f"WITH {FIX} SELECT x.event_id, coalesce(y.event_id, -1) AS fix_id FROM (SELECT * FROM e WHERE event_type <> 'view') x ASOF LEFT JOIN f y ON x.day = y.day AND x.us >= y.us")
def asof_backward(spark, d):
    return J.backward(_neighbours(spark, d), "ts", ["fix_id"]).select("event_id", F.coalesce("at_fix_id", F.lit(-1)).alias("fix_id"))


@query(f"WITH {FIX} SELECT x.event_id, coalesce(y.event_id, -1) AS fix_id FROM (SELECT * FROM e WHERE event_type <> 'view') x ASOF LEFT JOIN f y ON x.day = y.day AND x.us <= y.us")
def asof_forward(spark, d):
    return J.forward(_neighbours(spark, d), "ts", ["fix_id"]).select("event_id", F.coalesce("at_fix_id", F.lit(-1)).alias("fix_id"))


@query(f"WITH {E} SELECT c.day, c.event_id, count(p.event_id) AS n FROM (SELECT * FROM e WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON c.day = p.day AND p.us > c.us AND p.us <= c.us + 60000000 GROUP BY c.day, c.event_id")
def range_count_60s(spark, d):
    e = events(spark, d)
    return J.count_within(e.where(_kind("click")), e.where(_kind("purchase")), BY, ["event_id"], "ts", 60.0)


@query(f"""WITH {E}, j AS (SELECT a.event_id, m.event_id AS mark_seq, row_number() OVER (PARTITION BY a.day, a.event_id ORDER BY abs(m.event_id - a.event_id), m.event_id) AS r
FROM (SELECT * FROM e WHERE event_type = 'error') a JOIN (SELECT * FROM e WHERE event_type = 'signup') m ON a.day = m.day AND abs(m.event_id - a.event_id) <= 60 AND abs(m.us - a.us) / 1e6 <= 900)
SELECT e.event_id, coalesce(mark_seq, -1) AS mark_seq FROM e LEFT JOIN j ON e.event_id = j.event_id AND r = 1 WHERE event_type = 'error'""")
def headless_neighbour(spark, d):
    e = events(spark, d)
    return J.neighbour_within(e.where(_kind("error")), e.where(_kind("signup")), BY, "event_id", "ts", 60, 900.0).select("event_id", F.coalesce("mark_seq", F.lit(-1)).alias("mark_seq"))


_TRACK = FIX + """, r AS (SELECT *, sum(CASE WHEN (us - before) / 1e6 >= 900 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY us, event_id) AS run FROM (SELECT day, us, event_id, floor(lat / 20) AS lat, floor(lon / 50) AS lon, lag(us) OVER (PARTITION BY day ORDER BY us, event_id) AS before FROM f)),
s AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM r WINDOW w AS (PARTITION BY day, run ORDER BY us, event_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY day, run ORDER BY us, event_id) - 1 AS vertex, count(*) OVER (PARTITION BY day, run) AS size FROM s WHERE NOT coalesce(lat = lat0 AND lon = lon0, false)), v AS (SELECT * FROM t WHERE size >= 2)"""


def _track(spark, d) -> DataFrame:
    f = _positions(events(spark, d)).withColumn("lat", F.floor(F.col("lat") / 20)).withColumn("lon", F.floor(F.col("lon") / 50))
    return S.track(f, BY, "ts", ORDER, "lat", "lon")


@query(f"WITH {_TRACK} SELECT day, CAST(run AS BIGINT) AS run, CAST(vertex AS BIGINT) AS vertex, event_id, CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon FROM v")
def track_polyline(spark, d):
    return _track(spark, d).select("day", *_long("run", "vertex"), "event_id", *_long("lat", "lon"))


@query(f"""WITH {_TRACK}, l AS (SELECT *, row_number() OVER (PARTITION BY day, run ORDER BY us, event_id) - 1 AS leg, lead(us) OVER (PARTITION BY day, run ORDER BY us, event_id) AS nxt FROM v),
c AS (SELECT * FROM l WHERE nxt IS NOT NULL AND us % 86400000000 <= 64800000000 AND us - us % 86400000000 + 21600000000 <= nxt),
p AS (SELECT *, lag(leg) OVER (PARTITION BY day, run ORDER BY us, event_id) AS leg0 FROM c)
SELECT day, CAST(run AS BIGINT) AS run, CAST(leg AS BIGINT) AS leg, CAST(sum(CASE WHEN leg - leg0 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY day, run ORDER BY us, event_id) AS BIGINT) AS piece FROM p""")
def clip_to_window(spark, d):
    midnight = F.col("us") - F.col("us") % 86_400_000_000
    out = S.clip_legs(_track(spark, d), ["day", "run"], ["us", "event_id"], "us", midnight + 21_600_000_000, midnight + 64_800_000_000)
    return out.select("day", *_long("run", "leg", "piece"))


@query(f"""WITH {E}, x AS (SELECT day, event_id, event_type = 'view' AS mv, lag(event_type = 'view') OVER w AS mv0, lag(event_id) OVER w AS from_event_id FROM e WHERE event_type IN ('view', 'error') WINDOW w AS (PARTITION BY day ORDER BY us, event_id))
SELECT day, event_id, from_event_id FROM x WHERE mv AND NOT mv0""")
def motion_connectors(spark, d):
    e = events(spark, d).withColumn("mv", F.when(_kind("view"), True).when(_kind("error"), False))
    return S.connectors(e, BY, ["us", "event_id"], "mv", ["event_id"]).select("day", "event_id", "from_event_id")


@query(f"WITH {E} SELECT day, event_type AS value, count(*) AS n FROM e GROUP BY day, event_type")
def level_histogram(spark, d):
    return A.histogram(events(spark, d), BY, F.col("event_type"))


@query(f"WITH {E}, s AS (SELECT CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 'error' WHEN event_type = 'purchase' OR user_id % 5 = 0 THEN 'warning' END AS severity FROM e) SELECT severity, count(*) AS n FROM s GROUP BY severity")
def severity_union(spark, d):
    level = F.when(_kind("error"), "ERROR").when(_kind("purchase"), "WARN").otherwise("INFO")
    icon = F.when(F.col("user_id") % 7 == 0, "‼️").when(F.col("user_id") % 5 == 0, "⚠️").otherwise("🔵")
    return events(spark, d).select(X.severity(level, icon).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT regexp_extract(props, '\"k\": *([0-9]+)', 1) AS value, count(*) AS n FROM e WHERE regexp_extract(props, '\"k\": *([0-9]+)', 1) <> '' GROUP BY 1")
def status_histogram(spark, d):
    return A.matches_histogram(events(spark, d), [], F.col("props"), '"k": *([0-9]+)')


@query(f"""WITH {E}, b AS (SELECT day, min(us) AS a, max(us) AS z FROM e GROUP BY day)
SELECT e.day, CAST(least(119, floor((us - a) / (z - a) * 120)) AS BIGINT) AS bin, count(*) AS weight, bool_or(event_type = 'error') AS has_error FROM e JOIN b USING (day) GROUP BY 1, 2""")
def activity_bins(spark, d):
    return A.activity_bins(events(spark, d), BY, "ts", 120, error=_kind("error")).select("day", *_long("bin", "weight"), "has_error")


@query(f"WITH {FIX} SELECT day, CAST(floor(lon * 10 / 64) AS BIGINT) AS cell_x, CAST(floor(lat * 10 / 64) AS BIGINT) AS cell_y, count(*) AS n FROM f GROUP BY 1, 2, 3")
def grid_cluster(spark, d):
    return A.grid_cluster(_positions(events(spark, d)), BY, F.col("lon") * 10, F.col("lat") * 10).select("day", "cell_x", "cell_y", "n")


@query(f"WITH {FIX} SELECT day, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM f GROUP BY day")
def bbox(spark, d):
    return A.bounding_box(_positions(events(spark, d)), BY, "lat", "lon")


@query(f"""WITH {E}, m AS (SELECT day, event_type, user_id, count(*) AS n, min(event_id) AS first_seq, arg_min(value, event_id) AS value, max(us) AS last_us, list_aggregate(list_sort(list(us))[1:3], 'sum') AS early FROM e GROUP BY day, event_type, user_id)
SELECT day, event_type, user_id, n, first_seq, value, last_us, CAST(early AS BIGINT) AS early FROM m""")
def marker_dedupe(spark, d):
    m = A.marker_dedupe(events(spark, d), ["day", "event_type", "user_id"], "event_id", "us", ["value"], 3)
    return m.select("day", "event_type", "user_id", "n", "first_seq", "value", F.col("last_ts").alias("last_us"), F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("early"))


@query(f"""WITH {E}, m AS (SELECT day, min(us) FILTER (event_type = 'view') AS mv, min(us) AS first_us FROM e GROUP BY day)
SELECT day, greatest(coalesce(mv - 900000000, first_us), first_us) AS open_us FROM m""")
def opening_window(spark, d):
    g = events(spark, d).groupBy("day").agg(F.min(F.when(_kind("view"), F.col("us"))).alias("mv"), F.min("us").alias("first_us"))
    return g.select("day", F.greatest(F.coalesce(F.col("mv") - 900_000_000, F.col("first_us")), F.col("first_us")).alias("open_us"))


@query(f"""WITH {E}, s AS (SELECT day, CASE WHEN event_type IN ('view', 'click') THEN 'matched' WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'signup' THEN 'drift' ELSE 'passthrough' END AS status FROM e)
SELECT day, count(*) AS total, count(*) FILTER (status IN ('matched', 'passthrough')) AS matched, count(*) FILTER (status = 'drift') AS drift, count(*) FILTER (status = 'unknown') AS unknown, (count(*) FILTER (status IN ('unknown', 'drift'))) / count(*) > 0.05 AS alarm FROM s GROUP BY day""")
def coverage_summary(spark, d):
    status = F.when(_kind("view", "click"), "matched").when(_kind("error"), "unknown").when(_kind("signup"), "drift").otherwise("passthrough")
    return A.coverage(events(spark, d).withColumn("status", status), BY, "status").drop("unknown_rate")


@query(f"""WITH {E}, g AS (SELECT day, event_id, (us - lag(us) OVER (PARTITION BY day ORDER BY event_id)) / 1e6 AS gap_s FROM e), h AS (SELECT day, event_id FROM g WHERE gap_s >= 1800),
w AS (SELECT day, event_id FROM e WHERE event_type = 'error' AND value > 95), b AS (SELECT day, max(event_id) AS event_id FROM e GROUP BY day HAVING count(*) FILTER (event_type = 'signup') > 60)
SELECT day, event_id AS seq, 'wedge-candidate-gap' AS kind, 'high' AS severity, 0 AS sev_rank, 0 AS rule_ord FROM h UNION ALL SELECT day, event_id, 'hot-error', 'warn', 1, 1 FROM w UNION ALL SELECT day, event_id, 'many-starts', 'info', 2, 2 FROM b""")
def anomalies_union(spark, d):
    e = events(spark, d)
    none = F.lit("").alias("detail")
    h = S.gaps(e, BY, ORDER, "ts", 1800.0).select("day", "event_id", none)
    w = e.where(_kind("error") & (F.col("value") > 95)).select("day", "event_id", none)
    b = e.groupBy("day").agg(F.max("event_id").alias("event_id"), F.count_if(_kind("signup")).alias("n")).where("n > 60").select("day", "event_id", none)
    return A.findings([("wedge-candidate-gap", "high", h), ("hot-error", "warn", w), ("many-starts", "info", b)], BY, "event_id").drop("detail")


@query(f"""WITH {E}, x AS (SELECT *, count(*) OVER (PARTITION BY day) AS total, row_number() OVER (PARTITION BY day ORDER BY event_id) AS a FROM e WHERE event_type = 'error')
SELECT day, event_id, total FROM x WHERE total <= 40 OR a <= 25 OR a > total - 15""")
def two_sided_cap(spark, d):
    return A.two_sided_cap(events(spark, d).where(_kind("error")), BY, ORDER, 25, 15).select("day", "event_id", "total")


@query(f"WITH {E}, g AS (SELECT user_id, count(*) AS n, min(event_id) AS first_seq FROM e WHERE event_type = 'error' GROUP BY user_id) SELECT * FROM g ORDER BY n DESC, first_seq LIMIT 20")
def top_groups(spark, d):
    g = events(spark, d).where(_kind("error")).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seq"))
    return A.top_groups(g, 20, F.desc("n"), F.col("first_seq"))


@query(f"WITH {E}, c AS (SELECT max(us) AS t FROM e WHERE event_id <= 500) SELECT event_id, event_type FROM e, c WHERE abs(us - t) <= 3600000000")
def slice_window(spark, d):
    e = events(spark, d)
    center = e.where("event_id <= 500").agg(F.max("us").alias("t"))
    return e.join(F.broadcast(center), F.abs(F.col("us") - F.col("t")) <= 3_600_000_000).select("event_id", "event_type")  # one row is broadcast


@query(f"""WITH {E} SELECT day, event_type, count(*) AS n, min(event_id) AS first_seq, arg_max(value, event_id) AS last_value,
count(*) FILTER (user_id % 2 = 0) AS even, count(*) FILTER (user_id % 2 = 1) AS odd FROM e GROUP BY day, event_type""")
def dedup_groups(spark, d):
    e = events(spark, d).withColumn("parity", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    g = A.dedup_groups(e, ["event_type"], "event_id", "ts", "value", "parity", by=["day"])
    last = S.last_state(e, ["day", "event_type"], "event_id", {"last_value": F.col("value")})
    zero = F.lit(0).cast("bigint")
    g = g.join(last, ["day", "event_type"])
    return g.select("day", "event_type", "n", "first_seq", "last_value", F.coalesce(F.try_element_at("by_state", F.lit("even")), zero).alias("even"), F.coalesce(F.try_element_at("by_state", F.lit("odd")), zero).alias("odd"))


@query("""SELECT n_name, o_orderstatus, grouping(n_name) AS all_nations, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)""")
def capture_rollup(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.rollup_summary(o, ["n_name", "o_orderstatus"], all_nations=F.grouping("n_name").cast("bigint"), n=F.count("*"))


@query("""WITH e AS (SELECT event_id, CAST(user_id % 3 AS VARCHAR) || '.' || CAST(event_id % 12 AS VARCHAR) || '.' || CAST(event_id % 5 AS VARCHAR) AS v FROM events),
k AS (SELECT event_id, CAST(split_part(v, '.', 1) AS INT) * 10000 + CAST(split_part(v, '.', 2) AS INT) * 100 + CAST(split_part(v, '.', 3) AS INT) AS n FROM e) SELECT event_id FROM k WHERE n BETWEEN 201 AND 10900""")
def version_range_join(spark, d):
    v = F.concat_ws(".", (F.col("user_id") % 3).cast("string"), (F.col("event_id") % 12).cast("string"), (F.col("event_id") % 5).cast("string"))
    return events(spark, d).where(X.version_in(v, F.lit("0.2.1"), F.lit("1.9"))).select("event_id")


@query("""SELECT event_id, CASE WHEN value < 5 AND event_type = 'error' THEN 2 WHEN event_type = 'error' THEN 0 WHEN props LIKE '%"k": 1%' OR props LIKE '%"k":1%' THEN 1 ELSE -1 END AS rule FROM events""")
def rule_chain(spark, d):
    rules = [{"pattern": "^error"}, {"pattern": '"k": ?1'}, {"pattern": "^error", "platform": "low"}]
    platform = F.when(F.col("value") < 5, "low").otherwise("high")
    text = F.concat_ws(" ", "event_type", "props")
    return events(spark, d).select("event_id", F.coalesce(A.presentation_rules(rules, platform, F.lit("x"), text), F.lit(-1)).alias("rule"))
