"""Findings of a capture: what the records say about process lifetimes, silences, errors, uploads, fences, motion, power.

``marks`` turns each record's text into typed columns once; every finding is then an aggregate or a window over these
narrow columns, and Catalyst reads only what a finding needs. All functions handle any number of captures at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import aggregate as A
from ..operators import scan
from ..operators import sequence as S

BY, ORDER = ["capture_id"], ["seq"]
GAP_S = 900.0

#: What the log grammars print.
BANNER = r"LocationManager version:|LocationManager \(build "
VERSION = r"LocationManager version: ?([0-9][\w.\-]*)"
BUILD = r"LocationManager \(build (\d+)\)"
ALARM = "Schedule alarm fired"
FG_ANDROID = r"\[LifecycleManager handleOn(?:Resume|Start)|onWindowFocusChanged: true"
BG_ANDROID = r"\[LifecycleManager handleOn(?:Pause|Stop)|onWindowFocusChanged: false"
FG_IOS, BG_IOS = "onEnterForeground|applicationDidBecomeActive", "onEnterBackground"
HEADLESS_BOOT = r"didLaunchInBackground: ?(?:1|true|YES)|launched in background"
PAIRS = {"GATE CLOSE/OPEN": ("🛃 GATE CLOSE", "🛃 GATE OPEN"), "EVENT_DELIVERY pause/resume": ("EVENT_DELIVERY_PAUSE", "EVENT_DELIVERY_RESUME")}
WATCHDOG_FIRED = r"[Ww]atchdog[^\n]{0,20}(?:fired|force)|force.?unlock"
TRANSITION = r"[Gg]eofence\s+(ENTER|EXIT|DWELL)"


def _n(raw: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(raw, pattern, group), F.lit("")).try_cast("bigint")


def _bool(raw: Column, pattern: str) -> Column:
    v = F.regexp_extract(raw, pattern, 1)
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def marks(records: DataFrame) -> DataFrame:
    """``records`` (with structs, if annotated) plus the columns that findings use."""
    raw, p = F.col("raw"), F.col("platform")
    ios, android = p == "ios", p == "android"
    c, m = F.coalesce("tag_class", F.lit("")), F.coalesce("tag_method", F.lit(""))
    has = raw.contains
    fence = F.col("structs.geofence") if "structs" in records.columns else F.lit(None).cast("struct<action:string,identifier:string>")
    act = F.col("structs.detected_activity") if "structs" in records.columns else F.lit(None).cast("struct<type:string,confidence:int>")
    fg = F.when(android, raw.rlike(FG_ANDROID)).otherwise(raw.rlike(FG_IOS))
    bg = F.when(android, raw.rlike(BG_ANDROID)).otherwise(raw.rlike(BG_IOS))
    depth = F.coalesce(
        F.when(_n(raw, r"queued_before=(\d+)").isNotNull() & _n(raw, r"synced=(\d+)").isNotNull(), F.greatest(_n(raw, r"queued_before=(\d+)") - _n(raw, r"synced=(\d+)"), F.lit(0))),
        _n(raw, r"HTTP Service \(count: (\d+)\)"),
    )
    flags = F.regexp_extract(raw, r"Network: \w+ \| Flags: (\S+)", 1)
    cols = {
        "severity": X.severity(F.col("level"), F.col("icon"), p),
        "banner": raw.rlike(BANNER),
        "version": F.coalesce(X.extract(raw, VERSION), X.extract(raw, BUILD)),
        "alarm": has(ALARM),
        "strong": F.when(fg, "foreground").when(bg, "background"),
        "skull": has("💀"),
        "headless_ok": android & has("headlessConfirmed=true"),
        "headless_boot": ios & raw.rlike(HEADLESS_BOOT),
        "shape": X.shape(F.array_join(X.content_lines(F.concat(F.array("header_msg"), "body"), 2), " ")),
        "persisted": F.when(android, (c == "SQLiteLocationDAO") & (m == "persist")).otherwise(raw.rlike("DataStore persist") & has("INSERT:")),
        "posted": F.when(android, has("HTTP POST:")).otherwise(has("schedulePost") & has("LOCKED:")),
        "destroyed": F.when(android, (c == "SQLiteLocationDAO") & (m == "destroy")).otherwise(has("DESTROY:")),
        "task_start": F.when(android, has("startBackgroundTask:")).otherwise(has("Created background task:")),
        "task_stop": F.when(android, has("stopBackgroundTask:")).otherwise(has("stopBackgroundTask") & ~has("Failed to find")),
        "flush_try": (android & (c == "HttpService") & (m == "flush")) | has("beginFlushWithCallback"),
        "post_try": has("HTTP POST:") | (has("schedulePost") & has("LOCKED:")),
        "watch_armed": has("armFlushWatchdog") | has("watchdog_armed"),
        "watch_fired": raw.rlike(WATCHDOG_FIRED),
        "queue_depth": depth,
        "connected": F.coalesce(_bool(raw, r"Connectivity change: connected\? (true|false)"), F.when(flags != "", flags.contains("R"))),
        "fence_add": has("Start monitoring geofences") | has("startMonitoringForRegion"),
        "fence_drop": has("Stop monitoring geofences") | has("stopMonitoringForRegion"),
        "fence_stale": has("eofence") & F.lower(raw).contains("stale"),
        "fence_max": F.greatest(_n(raw, r"monitoring \d+/(\d+)"), _n(raw, r"Found \d+ / (\d+) within")),
        "spurious": F.when(fence.isNotNull(), has("spurious")).otherwise(has("Ignoring spurious geofence")),
        "transition": F.coalesce(F.when(fence["action"].isin("ENTER", "EXIT", "DWELL"), fence["action"]), X.extract(raw, TRANSITION), F.when(ios & has("didEnterRegion"), "ENTER").when(ios & has("didExitRegion"), "EXIT")),
        "available": _bool(raw, r"Location availability: (true|false)"),
        "activity": F.coalesce(act["type"], X.extract(raw, r"onMotionActivityChange:\] \| (\w+)/\d+ \|")),
        "confidence": F.coalesce(act["confidence"].cast("bigint"), _n(raw, r"onMotionActivityChange:\] \| \w+/(\d+) \|")),
        "trigger_armed": has("startMotionTriggerTimer") | has("Motion-trigger timer engaged"),
        "trigger_reset": has("resetMotionTriggerTimer"),
        "stationary_exit": F.lower(raw).contains("exit stationary"),
        "stop_on": has("[stopTimeout] Starting timer") | has("Scheduled OneShot: STOP_TIMEOUT"),
        "stop_fired": has("stopTimeout fired") | has("OneShot event fired: STOP_TIMEOUT"),
        "stop_off": has("Cancel OneShot: STOP_TIMEOUT") | has("stop] ⏰ [stopTimeout]"),
        "pace": F.when(android, _bool(raw, r"(?:motionchange: |Acquired motionchange position, isMoving: )(true|false|1|0)")).otherwise(_bool(raw, r"changePace:\] isMoving: (1|0|true|false)")),
        "power_save": raw.rlike("PowerSaveMode|PowerSaveChangeReceiver"),
        "power_hint": F.when(has("🟢") | has("🎾"), True).when(has("🔴"), False),
        "prevent_suspend": has("onPreventSuspendTimer"),
        "heartbeat": has("onHeartbeat") & c.rlike("^\\w*HeartbeatService$"),
        "enabled": _bool(raw, r"[Ee]nabled: (true|false|1|0)"),
        "moving": _bool(raw, r"isMoving: (true|false|1|0)"),
        "mock": raw.rlike(r"\bmock[\]\s}]") | has("🐞"),
        "auth": (F.coalesce("icon", F.lit("")).contains("📌") & F.coalesce("icon", F.lit("")).contains("🔒")) | c.rlike("(?i)authorization|license") | F.lower(raw).contains("license"),
    }
    return records.withColumns({k: v for k, v in cols.items() if k not in records.columns})


def with_segments(m: DataFrame) -> DataFrame:
    return S.with_segments(m, BY, "seq", F.col("banner"))


def with_state(m: DataFrame) -> DataFrame:
    """App state; a new segment resets it, except on the capture's first record."""
    d = scan.run(m, BY, ORDER, __before=scan.previous(F.col("segment")))
    d = d.withColumn("__new", F.coalesce(F.col("segment") != F.col("__before"), F.lit(False)))
    d = scan.run(d, ["capture_id", "segment"], ORDER, __boot=scan.whole(F.col("headless_boot"), F.max))
    reset = F.when(F.col("__new"), F.when(F.col("__boot"), "headless").otherwise("unknown"))
    return S.state_lane(d, BY, ORDER, reset, F.col("strong"), F.col("skull"), F.col("headless_ok")).drop("__before", "__new", "__boot")


def segments(m: DataFrame) -> DataFrame:
    return m.groupBy("capture_id", "segment").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("version", F.when(F.col("version").isNotNull(), F.col("seq"))).alias("version"),
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("headless_boot").alias("launched_headless"), F.count("*").alias("records"),
    )


def gaps(m: DataFrame, at_least: float = GAP_S) -> DataFrame:
    seg = scan.segment_of(m, ORDER)
    d = m.select("capture_id", "platform", "seq", "ts", "banner", "alarm", "segment", *([seg] if seg else []))
    d = scan.run(d, BY, ORDER, __before=scan.previous(F.col("segment")))
    d = d.withColumn("__death", F.col("banner") | F.coalesce(F.col("segment") != F.col("__before"), F.lit(False)))
    d = S.look_ahead(d, BY, ORDER, "ts", {"look_death": F.col("__death"), "look_alarm": F.col("alarm")})
    g = S.gaps(d, BY, ORDER, "ts", at_least)
    return g.select("capture_id", "seq", "start", F.col("ts").alias("end"), "gap_s", S.classify_gap(F.col("look_death"), F.col("look_alarm"), F.col("platform")).alias("kind"))


def dedup(m: DataFrame, k: DataFrame | None = None) -> DataFrame:
    """Warning and error groups by site, severity and shape; with classified records ``k``, the sites that wrote them."""
    d = m.where(F.col("severity").isNotNull())
    none = F.array().cast("array<string>")
    d = d.withColumn("sites", none) if k is None else d.join(k.select("capture_id", "seq", F.coalesce("klass.sites", none).alias("sites")), ["capture_id", "seq"], "left")
    return A.dedup_groups(d, ["tag_class", "tag_method", "severity", "shape"], "seq", "ts", "raw", "state", by=BY, sites="sites")


def source_notes(groups: DataFrame, h: DataFrame, harvested: dict[str, str]) -> DataFrame:
    """(capture_id, note): at which release the lines of the shown sites are right; for captures that show a line of a file
    only. ``harvested`` has that release of each platform; a platform that isn't in it gets all."""
    lined = groups.where(F.exists("sites", lambda s: s.rlike("/.*:[0-9]+$"))).select("capture_id").distinct()
    each = [f"{k} {v}" for k, v in sorted(harvested.items())]
    at = A.rule_chain([(F.lower("platform") == k.lower(), f"{k} {v}") for k, v in sorted(harvested.items())] + [(F.lit(True), " / ".join(each))])
    own = F.when(F.size("versions") > 0, F.concat(F.lit(" This capture is of "), F.array_join("versions", " / "), F.lit("."))).otherwise("")
    d = h.join(lined, "capture_id", "left_semi")
    return d.select("capture_id", F.concat(F.lit("Lines of sources are right as of **"), at, F.lit("**."), own, F.lit(" In another release, look for the message near them.")).alias("note"))


def pairs(m: DataFrame) -> DataFrame:
    parts = []
    for name, (a, b) in PAIRS.items():
        parts.append(S.pair_balance(m, BY, ORDER, F.col("raw").contains(a), F.col("raw").contains(b)).withColumn("pair", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def _count(c: str) -> Column:
    return F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)


def settings(cfg: DataFrame, **names: str) -> DataFrame:
    """(capture_id, a column per keyword): the values of configuration keys, nested or not; the shallowest wins."""
    leaf, depth = F.regexp_extract("key", "([^.]+)$", 1), F.struct(F.size(F.split("key", "[.]")), F.col("key"))
    picked = [F.min_by("value", F.when(leaf == key, depth)).alias(name) for name, key in names.items()]
    return cfg.groupBy(*BY).agg(*picked)


def parity(m: DataFrame, cfg: DataFrame | None = None) -> DataFrame:
    """Counts of a position's life: persisted, posted, destroyed, background tasks. No imbalance where ``cfg`` turns
    automatic uploads off."""
    g = m.groupBy(*BY).agg(*map(_count, ["persisted", "posted", "destroyed", "task_start", "task_stop"]))
    uneven = (F.col("persisted") >= 10) & (F.col("destroyed") < 0.5 * F.col("persisted"))
    if cfg is None:
        return g.withColumn("imbalance", uneven)
    auto = F.lower(F.trim("__auto")).isin("true", "1", "yes")
    return g.join(settings(cfg, __auto="autoSync"), BY, "left").withColumn("imbalance", uneven & F.coalesce(auto, F.lit(True))).drop("__auto")


def http_health(m: DataFrame) -> DataFrame:
    return m.groupBy(*BY).agg(
        *map(_count, ["post_try", "flush_try", "watch_armed", "watch_fired"]), F.max_by("queue_depth", F.when(F.col("queue_depth").isNotNull(), F.col("seq"))).alias("final_queue_depth"),
        F.sum(F.size(F.filter(F.regexp_extract_all("raw", F.lit(r"\bretry=(\d+)"), F.lit(1)), lambda x: x.rlike("[1-9]")))).alias("retries"),
    )


def status_histogram(m: DataFrame) -> DataFrame:
    return A.matches_histogram(m, BY, F.col("raw"), r"Response: (\d+)", order="seq")


def connectivity(m: DataFrame) -> DataFrame:
    """Changes of connectivity, each with the flushes tried within a minute after a connection."""
    from ..operators.asof import count_within

    e = m.where(F.col("connected").isNotNull()).select("capture_id", "seq", "ts", "connected")
    n = count_within(e.where("connected and ts is not null"), m.where("flush_try"), BY, ["seq"], "ts", 60.0)
    return e.join(n, ["capture_id", "seq"], "left").withColumn("flushes", F.col("n")).drop("n")


def url_report(m: DataFrame, cap: int = 20) -> DataFrame:
    u = m.select("capture_id", "seq", F.posexplode(X.urls(F.col("raw"))).alias("pos", "url"))
    return A.capped_counts(u, BY, "url", ["seq", "pos"], cap).withColumn("class", X.url_class(F.col("url")))


def geofence_health(m: DataFrame) -> DataFrame:
    kinds = [F.count_if((F.col("transition") == k) & ~F.col("spurious")).alias(k.lower()) for k in ("ENTER", "EXIT", "DWELL")]
    g = m.groupBy(*BY).agg(*kinds, *map(_count, ["spurious", "fence_add", "fence_drop", "fence_stale"]), F.max("fence_max").alias("max_registered"))
    flips = S.change_count(m.where(F.col("available").isNotNull()), BY, ORDER, "available").select("capture_id", F.col("changes").alias("availability_flaps"))
    return g.join(flips, BY, "left")


def motion_health(m: DataFrame, min_confidence: int = 75, cfg: DataFrame | None = None) -> DataFrame:
    """``cfg`` can state another least confidence than ``min_confidence``."""
    least = F.lit(min_confidence)
    if cfg is not None:
        m = m.join(settings(cfg, __least="minimumActivityRecognitionConfidence"), BY, "left")
        least = F.coalesce(F.col("__least").try_cast("int"), least)
    g = m.groupBy(*BY).agg(
        F.median("confidence").alias("median_confidence"), F.count_if(F.col("confidence") < least).alias("low_confidence"),
        *map(_count, ["trigger_armed", "trigger_reset", "stationary_exit", "stop_on", "stop_fired", "stop_off"]),
    )
    last = m.groupBy(*BY).agg(F.max("ts").alias("__end"))
    p = m.where(F.col("pace").isNotNull() & F.col("ts").isNotNull()).select("capture_id", "seq", "ts", "pace").join(last, BY)
    pace = S.dwell_ratio(p, BY, ORDER, "ts", "pace", "__end").select("capture_id", "flips", F.col("ratio").alias("moving_ratio"))
    return g.join(pace, BY, "left")


def activity_histogram(m: DataFrame) -> DataFrame:
    return A.histogram(m, BY, F.col("activity"), "activity")


def power_events(m: DataFrame) -> DataFrame:
    return m.where("power_save or prevent_suspend").select("capture_id", "seq", "ts", F.when(F.col("power_save"), "power-save").otherwise("prevent-suspend").alias("kind"), "power_hint")


def heartbeats(m: DataFrame, expected_s: float | None = None, cfg: DataFrame | None = None) -> DataFrame:
    """Cadence per segment, against ``expected_s`` or, without it, the interval that ``cfg`` states."""
    d = S.cadence(m.where("heartbeat"), ["capture_id", "segment"], ORDER, "ts").join(m.groupBy(*BY).agg(F.first("platform").alias("__p")), BY)
    d = _with_interval(d, expected_s, cfg)
    d = d.withColumn("stretched", F.coalesce((F.col("interval_s") > 0) & (F.col("median_s") > 1.5 * F.col("interval_s")), F.lit(False)))
    return d.withColumn("expected", F.col("stretched") & (F.col("__p") == "ios") & (F.col("max_s") <= 450)).drop("__p")


def _with_interval(d: DataFrame, expected_s: float | None, cfg: DataFrame | None) -> DataFrame:
    if expected_s is not None or cfg is None:
        return d.withColumn("interval_s", F.lit(expected_s).cast("double"))
    return d.join(settings(cfg, __hb="heartbeatInterval"), BY, "left").withColumn("interval_s", F.col("__hb").try_cast("double")).drop("__hb")


def duty_cycle(m: DataFrame, gap_table: DataFrame) -> DataFrame:
    """Span, active hours, positions per active hour."""
    g = m.groupBy(*BY).agg((X.seconds_between(F.min("ts"), F.max("ts")) / 3600).alias("span_h"), _count("persisted"))
    q = gap_table.groupBy(*BY).agg((F.sum("gap_s") / 3600).alias("gap_h"))
    d = g.join(q, BY, "left").withColumn("active_h", F.greatest(F.col("span_h") - F.coalesce("gap_h", F.lit(0.0)), F.lit(0.01)))
    return d.withColumn("fixes_per_h", F.col("persisted") / F.col("active_h")).drop("gap_h")


def auth_timeline(m: DataFrame) -> DataFrame:
    """Authorization records: all of at most 40, else the first 25 and the last 15."""
    return A.two_sided_cap(m.where("auth").select("capture_id", "seq", "ts", F.left("raw", F.lit(200)).alias("line")), BY, ORDER, 25, 15)


def end_state(m: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"last_{c}")
    d = m.withColumn("auth_line", F.when(F.col("auth"), F.left("raw", F.lit(200))))
    return d.groupBy(*BY).agg(
        last("enabled"), last("moving"), last("connected"), last("queue_depth"), last("auth_line"),
        F.max_by(~X.balanced(F.col("raw")), "seq").alias("abrupt_end"), F.max_by(F.right("raw", F.lit(1000)), "seq").alias("tail"),
    )


def header(m: DataFrame) -> DataFrame:
    v = F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("seq", "version"))))["version"])
    dev, app = X.extract(F.col("raw"), r"(?m)^╟─ ?(?:Device|Model): ?(.+?)\s*$"), X.extract(F.col("raw"), r"(?m)^╟─ ?(?:App|Bundle|Package)[^:\n]*: ?(\S+)")
    d = m.withColumn("__d", F.when(F.col("banner"), dev)).withColumn("__a", F.when(F.col("banner"), app))
    return d.groupBy(*BY).agg(
        F.first("platform").alias("platform"), F.min_by("__d", F.when(F.col("__d").isNotNull(), F.col("seq"))).alias("device"), F.min_by("__a", F.when(F.col("__a").isNotNull(), F.col("seq"))).alias("app_id"),
        v.alias("versions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("records"),
    )


def config(m: DataFrame) -> DataFrame:
    """(capture_id, key, value): scalars of a capture's first configuration dump, flattened by '.'."""
    d = m.where(F.col("structs.config_dump").isNotNull()).groupBy(*BY).agg(F.min_by("structs.config_dump", "seq").alias("c"))
    flat = d.select("capture_id", F.col("c.truncated").alias("truncated"), F.explode(F.from_json("c.data", "map<string,string>")).alias("key", "value"))
    inner = flat.where(F.col("value").startswith("{")).select("capture_id", "truncated", "key", F.explode(F.from_json("value", "map<string,string>")).alias("k2", "value"))
    return flat.where(~F.col("value").startswith("{") | F.col("value").isNull()).unionByName(inner.select("capture_id", "truncated", F.concat_ws(".", "key", "k2").alias("key"), "value"))


def coverage(classified: DataFrame) -> DataFrame:
    return A.coverage(classified.withColumn("status", F.col("klass.status")), BY, "status")


def unknown_examples(classified: DataFrame, n: int = 5) -> DataFrame:
    d = classified.where(F.col("klass.status").isin("drift", "unknown")).select("capture_id", "seq", F.col("klass.status").alias("status"), F.left("raw", F.lit(200)).alias("line"))
    w = Window.partitionBy("capture_id", "status").orderBy("seq")
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def anomalies(m: DataFrame, gap_table: DataFrame, coverage_table: DataFrame | None = None, heartbeat_s: float | None = None, excerpt: bool = False, cfg: DataFrame | None = None) -> DataFrame:
    """Rule results, in the order high, warn, info and then by rule; an excerpt has no wedge-candidate gaps."""
    at = lambda d, detail: d.select("capture_id", F.lit(-1).cast("bigint").alias("seq"), detail.alias("detail"))
    s = lambda c: F.col(c).cast("string")
    par, web = parity(m, cfg), http_health(m)
    parts = []
    if not excerpt:
        parts.append(("wedge-candidate-gap", "high", gap_table.where("kind = 'wedge-candidate'").select("capture_id", "seq", s("gap_s").alias("detail"))))
    parts.append(("sync-backlog", "high", at(par.where("imbalance"), s("persisted"))))
    parts.append(("http-watchdog", "warn", at(web.where("watch_fired > 0"), s("watch_fired"))))
    p = pairs(m).where("unpaired > 0 or orphans > 0")
    for name in PAIRS:
        parts.append((f"unpaired-{name.split()[0].lower()}", "warn", at(p.where(F.col("pair") == name), F.concat_ws("/", "unpaired", "orphans"))))
    parts.append(("bg-task-unpaired", "info", at(par.where("task_start > task_stop"), (F.col("task_start") - F.col("task_stop")).cast("string"))))
    mocks = m.groupBy(*BY).agg(_count("mock")).where("mock > 0")
    parts.append(("mock-locations", "info", at(mocks, s("mock"))))
    if coverage_table is not None:
        parts.append(("vocabulary-drift", "warn", at(coverage_table.where("alarm"), s("unknown_rate"))))
    if heartbeat_s is not None or cfg is not None:
        known = _with_interval(segments(m), heartbeat_s, cfg).where("interval_s > 0").drop("interval_s")
        segs = known.join(heartbeats(m, heartbeat_s, cfg), ["capture_id", "segment"], "left").join(header(m).select("capture_id", "platform"), BY)
        absent = segs.where(F.col("n").isNull() & (X.seconds_between(F.col("start"), F.col("end")) >= 1800))
        parts.append(("heartbeat-absent", "info", at(absent, s("segment"))))
        parts.append(("heartbeat-cadence", "warn", at(segs.where("stretched and not expected and platform = 'android'"), s("median_s"))))
    parts.append(("abrupt-end", "info", at(end_state(m).where("abrupt_end"), F.lit("the last record is cut"))))
    return A.findings(parts, BY, "seq")


def missing_evidence(h: DataFrame, cfg: DataFrame, seg: DataFrame) -> DataFrame:
    """What a capture lacks for a full reading: no version, no configuration, one lifetime only, short span."""
    has_cfg = cfg.select("capture_id").distinct().withColumn("has_cfg", F.lit(True))
    n = seg.groupBy(*BY).agg(F.count("*").alias("segments"))
    d = h.join(has_cfg, BY, "left").join(n, BY, "left")
    asks = F.array_compact(F.array(
        F.when(F.size("versions") == 0, "a start banner with the version"), F.when(F.col("has_cfg").isNull(), "a configuration dump"), F.when(F.col("segments") <= 1, "a log across a restart"),
        F.when(X.seconds_between(F.col("first_ts"), F.col("last_ts")) < 3600, "at least an hour of log"), F.when(F.col("first_ts").isNull(), "records with times"),
        F.when(F.col("device").isNull(), "the device model"), F.when(F.col("app_id").isNull(), "the application id"), F.when(F.col("records") < 50, "more records"),
    ))
    return d.select("capture_id", F.explode(asks).alias("ask"))
