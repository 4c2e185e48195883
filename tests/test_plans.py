import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmill.functions import exprs as X
from trailmill.operators import aggregate as A
from trailmill.operators import asof
from trailmill.plans import bench_inputs, enrich, findings, redact, sinks, vocabulary
from trailmill.plans.vocabulary import Entry, Matcher
from trailmill.sources import captures as C
from trailmill.sources import payloads as P
from trailmill.sources import records as R
from trailmill.streaming import events as stream

T0 = datetime(2024, 1, 1)


def one(spark, **cols):
    r = spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()
    return r.asDict()


def test_expressions(spark):
    L = F.lit
    got = one(
        spark, shape=X.shape(L("id 01234567-89ab-cdef-0123-456789abcdef  took 12.5 ms\n at -3")), lan=X.url_class(L("http://192.168.1.4:80/x")), clear=X.url_class(L("http://a.example/x")), https=X.url_class(L("https://a.example")), other=X.url_class(L("ftp://a")),
        host172=X.url_class(L("http://172.32.0.1/")), ms=X.duration_ms(L("1d23h40m16s428ms")), none=X.duration_ms(L("x")), a=X.alias_letters(L(1)), z=X.alias_letters(L(26)), aa=X.alias_letters(L(27)), zz=X.alias_letters(L(702)), aaa=X.alias_letters(L(703)),
        v=X.version_in(L("1.10"), L("1.9"), L("1.10.0")), v2=X.version_in(L("1.10.1"), L(None), L("1.10.0")), vn=X.version_in(L(None).cast("string"), L("1"), L("2")), bad=X.balanced(L("{ ╔")), ok=X.balanced(L("{} ╔╚")),
        s1=X.severity(L("INFO"), L("❌"), L("android")), s2=X.severity(L(None), L("❌"), L("ios")), s3=X.severity(L("WARN"), L("‼️")), b=X.speed_bucket(L(100.0)), bn=X.speed_bucket(L(None).cast("double")), d1=X.duration_text(L(89)), d2=X.duration_text(L(5399)), d3=X.duration_text(L(5400)),
        dirn=X.earliest_direction(L("stationary then moving"), ["moving"], ["stationary"]), urls=X.urls(L("see http://a/b. and https://c/d')")), step=X.axis_step_s(L(3600)),
    )
    assert got == {
        "shape": "id «id» took # ms at #", "lan": "private-lan", "clear": "cleartext-http", "https": "https-public", "other": "other", "host172": "cleartext-http", "ms": 171_616_428, "none": None,
        "a": "A", "z": "Z", "aa": "AA", "zz": "ZZ", "aaa": "AAA", "v": True, "v2": False, "vn": True, "bad": False, "ok": True, "s1": None, "s2": "error", "s3": "error", "b": 7, "bn": -1,
        "d1": "89 s", "d2": "90.0 min", "d3": "1.5 h", "dirn": False, "urls": ["http://a/b", "https://c/d"], "step": 600,
    }


def test_rule_chains(spark):
    rules = [{"pattern": "x"}, {"pattern": "x", "platform": "ios"}, {"pattern": "y", "layer": "b"}]
    sup = [{"pattern": "x", "when": "mock"}, {"pattern": "x", "class": "Ab", "unless": "keep"}]
    L = F.lit
    got = one(
        spark, own=A.presentation_rules(rules, L("ios"), L("a"), L("x")), shared=A.presentation_rules(rules, L("android"), L("a"), L("x")), none=A.presentation_rules(rules, L("ios"), L("a"), L("y")),
        s0=A.suppression_rules(sup, {"mock": L(True)}, L("Zz"), L("x")), s1=A.suppression_rules(sup, {}, L("Abc"), L("x")), s2=A.suppression_rules(sup, {}, L("Abc"), L("x keep")), s3=A.suppression_rules(sup, {}, L("xAb"), L("x")),
    )
    assert got == {"own": 1, "shared": 0, "none": None, "s0": 0, "s1": 1, "s2": None, "s3": None}


def test_fragments():
    f = vocabulary.fragments
    assert ("stop timer ", True) in f(r"stop timer (\d+)") and ("maybe", False) in f(r"x(?:maybe)?y") and ("left", False) in f(r"(left|right) side")
    assert (" side", True) in f(r"(left|right) side") and f("(") == [] and ("ab", True) in f(r"(?:ab)+")
    assert vocabulary.qualifies("abcd") and vocabulary.qualifies("a b c") and not vocabulary.qualifies("  abc ") and not vocabulary.qualifies(None) and vocabulary.qualifies("🔵")


ENTRIES = [
    Entry("exact", "android", "Http", "flush", "INFO", "🔵", [r"flush started n=(\d+)"]),
    Entry("other", "android", "Db", "flush", "INFO", None, [r"flush started n=(\d+)"]),
    Entry("long", "android", "Http", "flush", "INFO", None, [r"flush started n=(\d+) with many extra words"]),
    Entry("catch", "android", "Log", "any", "WARN", None, [r".*"], flags=["builder-catchall"]),
    Entry("old", "android", "Old", "x", None, None, [r"retired message here"], valid_to="2.0", source=["Old.java:9"]),
    Entry("pass", "android", "Raw", None, None, None, [], flags=["passthrough"]),
    Entry("selector", "android", "Hb", "x", None, None, [r"heart ❤️ beats"]),
    Entry("bare", "android", "Bare", "x", None, None, [r"n=\d+"]),
    Entry("both", "android", "Both", "x", "WARN", "⚠", [r"zz"]),
    Entry("drifty", "android", "Dr", "x", None, None, [r"connection to server was lost (\d+)"]),
    Entry("twin1", "ios", "Tw", "a:", None, None, [r"same text \d"], semantic="s", source=["Tw.m:1"]),
    Entry("twin2", "ios", "Tw", "a:", None, None, [r"same text \d"], semantic="t", source=["Tw.m:2", "Tw.m:1"]),
    Entry("iany", "ios", "Tw", "b:", None, None, [r".+"], flags=["builder-catchall"]),
]


@pytest.mark.parametrize("r,status,sites,conf", [
    (dict(raw="x flush started n=3", tag_class="Http", tag_method="flush", level="INFO", icon="🔵"), "matched", ["exact"], "exact"),
    (dict(raw="x flush started n=3 with many extra words", tag_class="Db", tag_method="flush"), "matched", ["long"], "exact"),
    (dict(raw="x flush started n=3", tag_class="None"), "matched", ["exact"], "ambiguous"),
    (dict(raw="anything", tag_class="Log", tag_method="zz", level="WARN"), "matched", ["catch"], "exact"),
    (dict(raw="anything", tag_class="Log", level="INFO"), "unknown", [], None),
    (dict(raw="retired message here", tag_class="Old", version="1.9"), "matched", ["Old.java:9"], "exact"),
    (dict(raw="retired message here", tag_class="Old", version="2.1", tag_method="x"), "unknown", [], None),
    (dict(raw="retired message was here", tag_class="Old", version="1.9 (4063)", tag_method="x"), "drift", ["Old.java:9"], "fuzzy"),
    (dict(raw="retired message was here", tag_class="Old", version="2.1", tag_method="x"), "unknown", [], None),
    (dict(raw="whatever", tag_class="Raw", tag_method="q"), "passthrough", [], "exact"),
    (dict(raw="the connection to the server got lost", tag_class="Dr", tag_method="x"), "drift", [], "fuzzy"),
    (dict(raw="the Connection To the server got lost", tag_class="Dr", tag_method="x"), "unknown", [], None),
    (dict(raw="heart ❤️ beats", tag_class="Hb"), "matched", ["selector"], "exact"),
    (dict(raw="heart ❤ beats", tag_class="Zz"), "unknown", [], None),
    (dict(raw="n=12 k", tag_class="Bare"), "matched", ["bare"], "exact"),
    (dict(raw="n=12 k", tag_class="LoggerFacade$Entry"), "unknown", [], None),
    (dict(raw="zz", tag_class="LoggerFacade$Entry", level="WARN", icon="⚠"), "matched", ["both"], "exact"),
    (dict(raw="x flush started n=3", tag_class="Logger"), "passthrough", [], "exact"),
    (dict(raw="q", platform="ios", tag_class="TSLocationManager", tag_method="log:message:"), "passthrough", [], "exact"),
    (dict(raw="same text 1", platform="ios", tag_class="Tw", tag_method="a:"), "matched", ["Tw.m:1", "Tw.m:2"], "ambiguous"),
    (dict(raw="same text 1", platform="ios", tag_class="Tw", tag_method="c:d:"), "matched", ["Tw.m:1", "Tw.m:2"], "ambiguous"),
    (dict(raw="new text", platform="ios", tag_class="Tw", tag_method="b:"), "matched", ["iany"], "exact"),
    (dict(raw="nothing", platform="ios", tag_class="Qq"), "unknown", [], None),
])
def test_matcher(r, status, sites, conf):
    r = {"platform": "android", "tag_class": None, "tag_method": None, "level": None, "icon": None, "version": None, **r}
    got = Matcher(ENTRIES).classify(r)
    assert (got["status"], got["sites"], got["confidence"]) == (status, sites, conf)
    assert got["semantic"] is None


def test_vocabulary_files(tmp_path):
    (tmp_path / "v.yaml").write_text("entries:\n- id: a\n  class: C\n  patterns: ['x y']\n- nope\n")
    got, warn = vocabulary.load_entries(str(tmp_path / "v.yaml"), "ios")
    assert got[0].cls == "C" and got[0].platform == "ios" and len(warn) == 1
    assert vocabulary.load_entries(str(tmp_path / "none.yaml"), "ios")[0] == []
    vocabulary.overlay(got, {"a": ["f:1"]})
    assert got[0].source == ["f:1"] and vocabulary.newest_version(["1.9", "HEAD", "1.10"]) == "1.10"


def test_classification_is_right_and_fast_enough(spark):
    import time

    recs = bench_inputs.synthetic_records(spark, 20_000).cache()
    bench_inputs.classified(recs.limit(10)).count()
    t = time.perf_counter()
    got = bench_inputs.classified(recs).where("klass.status = 'matched' and klass.confidence = 'exact' and klass.sites[0] = concat('e', lpad(cast(seq % 1000 as string), 4, '0'))").count()
    assert got == 20_000 and 20_000 / (time.perf_counter() - t) > 2_000  # the floor itself is measured by bench.py


def test_redactor(spark):
    t = "at <+45.1234,-72.5> and 45.1234,-72.5000 v 4.5.0 id 01234567-89AB-cdef-0123-456789abcdef com.acme.app.Main java.util.List https://h.example/x. 95.1234,10.0000 fence home homework"
    d = spark.createDataFrame([("c", 0, t), ("c", 1, "https://h.example/x again"), ("d", 0, "com.other.app.X")], "capture_id string, seq int, raw string")
    reg = spark.createDataFrame([("c", "gf", "home")], "capture_id string, kind string, value string")
    table = redact.alias_table(d, ["capture_id"], ["seq"], "raw", reg)
    got = {(r.capture_id, r.seq): r.redacted for r in redact.apply_aliases(d, table, ["capture_id"], "raw").collect()}
    assert got["c", 0] == "at <COORD-A> and COORD-B v 4.5.0 id UUID-A PKG-A java.util.List URL-A. 95.1234,10.0000 fence GF-A homework"
    assert got["c", 1] == "URL-A again" and got["d", 0] == "PKG-A"


def test_redactor_replaces_whole_strings_only(spark):
    lines = ["1.2345,5.6789 and 191.2345,5.6789 <+1.2345 , 5.6789> 4.5,6.7", "see (app://a.b/c), home://x; 0A234567-89AB-cdef-0123-456789abcdef", "", None, "\n1.2345,5.6789", "name home http://h/home x@com.acme.app.Main com.acme.app-1"]
    d = spark.createDataFrame(list(enumerate(lines)), "seq int, raw string").withColumn("capture_id", F.lit("c"))
    reg = spark.createDataFrame([("c", "gf", "home")], "capture_id string, kind string, value string")
    table = redact.alias_table(d, ["capture_id"], ["seq"], "raw", reg)
    got = [r.redacted for r in redact.apply_aliases(d, table, ["capture_id"], "raw").orderBy("seq").collect()]
    assert got == ["COORD-A and 191.2345,5.6789 <COORD-A> 4.5,6.7", "see (URL-A), URL-B; UUID-A", "", None, "\nCOORD-A", "name GF-A URL-C x@com.acme.app.Main PKG-A-1"]
    unknown = redact.apply_aliases(d, table.where("kind = 'gf'"), ["capture_id"], "raw").where("seq = 1").first().redacted
    assert unknown == "see (URL-?), URL-?; UUID-?"


def log(spark, lines, platform="android"):
    d = spark.createDataFrame([("c", platform, 2024, "\n".join(lines) + "\n")], "capture_id string, platform string, year int, text string")
    return findings.with_state(findings.with_segments(findings.marks(P.annotate(R.assemble(d))))).cache()


def at(sec, rest, level="INFO"):
    return f"{(T0 + timedelta(seconds=sec)).strftime('%m-%d %H:%M:%S')}.000 {level} {rest}"


def test_findings(spark):
    lines = [
        at(0, "[App start] LocationManager version: 4.4.2 (4070)"), "╟─ com.acme.app", "╟─ acme Phone @ 33 (13)", at(1, "[App boot] HeadlessMode? true"), at(5, "[LifecycleManager handleOnResume] x"),
        at(10, "[SQLiteLocationDAO persist] Location[fused 45.0,7.0 hAcc=5.0]"), at(12, "[HeadlessEventTx fire] 💀⚡️ location"), at(20, "[HttpService flush] HTTP Service (count: 7)"), at(21, "[H y] Response: 200"),
        at(30, "[T t] Connectivity change: connected? true"), at(60, "[HttpService flush] go"), at(91, "[HttpService flush] late"), at(100, "[G g] 📢 ENTER Geofence: home"), at(101, "[G g] Ignoring spurious geofence dist=250.0m radius=200.0m outsideBy=50.0"),
        at(110, "[M m] motionchange: true"), at(1200, "[S s] Schedule alarm fired"), at(1210, "[X e] boom 17", "ERROR"), at(1211, "[X e] boom 18", "ERROR"), at(1220, "[K k] 🛃 GATE CLOSE"), at(3000, "[App start] LocationManager version: 4.4.3 (4071)"),
        at(5000, "[E e] {", "WARN"),
    ]
    m = log(spark, lines)
    gaps = findings.gaps(m).orderBy("seq").collect()
    assert [(g.gap_s, g.kind) for g in gaps] == [(1090.0, "scheduler-window"), (1780.0, "death"), (2000.0, "wedge-candidate")]
    seg = {r.segment: r.version for r in findings.segments(m).collect()}
    assert seg == {0: "4.4.2", 1: "4.4.3"}
    d = findings.dedup(m).orderBy(F.desc("n")).first()
    assert (d.n, d["shape"], d.by_state) == (2, "boom #", {"foreground": 2})
    h = findings.http_health(m).first()
    assert (h.flush_try, h.final_queue_depth) == (3, 7)
    assert findings.connectivity(m).first().flushes == 1
    g = findings.geofence_health(m).first()
    assert (g.enter, g.spurious) == (1, 1)
    assert findings.motion_health(m).first().moving_ratio == 1.0
    p = {r.pair: (r.firsts, r.unpaired) for r in findings.pairs(m).collect()}
    assert p["GATE CLOSE/OPEN"] == (1, 1)
    kinds = [r.kind for r in findings.anomalies(m, findings.gaps(m)).orderBy("sev_rank", "rule_ord", "seq").collect()]
    assert kinds == ["wedge-candidate-gap", "unpaired-gate", "abrupt-end"]
    assert "wedge-candidate-gap" not in [r.kind for r in findings.anomalies(m, findings.gaps(m), excerpt=True).collect()]
    launch = enrich.launches(m).orderBy("seq").first()
    assert (launch.build, launch.app_id, launch.device, launch.headless) == ("4070", "com.acme.app", "acme Phone @ 33 (13)", True)
    ev = enrich.fence_evidence(m).orderBy("seq").collect()
    assert ev[0].tint == "green" and (ev[1].verdict, ev[1].outside_by_m) == ("outside fence", 50.0)
    from trailmill.plans.layers import fixes

    dispatch = m.withColumn("event", enrich.event_name(F.col("tag_method"), F.col("raw"))).where("event = 'location'")
    s = enrich.stamp_fixes(fixes(m), dispatch).first()
    assert s.delivered and s.headless
    assert [(r.event, r.delivered) for r in enrich.event_pairs(m).collect()] == [("location", False)]
    assert enrich.stationary_radius(m).first().radius_m == 150.0


def test_compaction_is_invertible(spark):
    rows = [("t1", "t1", "gaps", "gaps", "placed", 0.0, False, "normal", 1), ("t2", "t9", "gaps", "x", "own", 3.0, True, "error", 4)]
    d = spark.createDataFrame(rows, "ts string, slice_ts string, layer string, category string, placement string, dt_s double, own_position boolean, severity string, count int")
    small = enrich.compact(d)
    assert small.orderBy("ts").first().asDict() == {**dict.fromkeys(d.columns), "ts": "t1", "layer": "gaps"}
    assert sorted(enrich.inflate(small).collect()) == sorted(d.collect())


def test_petals_and_caps(spark):
    d = spark.range(12).select("id", (F.col("id") % 2 * 100.0).alias("x"), F.lit(1.0).alias("y"))
    got = enrich.petals(d, [], F.col("x"), F.col("y"), "id").collect()
    assert {r.petal for r in got} == set(range(6)) and not any(r.clustered for r in got)
    capped = A.capped_counts(spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "v string, p int"), [], "v", ["p"], 2)
    assert [(r.v, r.n, r["rank"]) for r in capped.orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, 2)]


def _streamed(spark, tmp_path, batches, make, name, mode="append"):
    """The rows of a stream that gets ``batches`` one file at a time."""
    src = tmp_path / f"in-{name}"
    src.mkdir()
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"{name}-{i}")
        spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{file}", src / f"{i:03d}.parquet")
        os.utime(src / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q


def test_counts_of_a_stream(spark, tmp_path):
    rows = [(i % 3, T0 + timedelta(seconds=700 * i)) for i in range(40)]
    got, _ = _streamed(spark, tmp_path, [rows], lambda s: stream.windowed_counts(s, "ts", ["k"], "1 hour", "1 hour"), "counts", "complete")
    assert sum(r.n for r in got) == 40


def test_silences_of_a_stream_equal_the_batch(spark, tmp_path):
    stream.use_timers(spark)
    rng = random.Random(6)
    at = [T0 + timedelta(seconds=s) for s in sorted(rng.sample(range(200_000), 90))]
    rows = [(i % 3, t) for i, t in enumerate(at)]
    # out of order by less than the watermark's hour, over several micro-batches
    dealt = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randrange(1800)), r[0]))
    batches = [dealt[i : i + 30] for i in range(0, 90, 30)] + [[(9, T0 + timedelta(days=5))], [(1, T0 + timedelta(days=1)), (9, T0 + timedelta(days=6))]]
    got, _ = _streamed(spark, tmp_path, batches, lambda s: stream.stream_gaps(s, "k", "ts", "1 hour", 4000.0), "gaps")
    want = []
    for k in range(3):
        mine = [t for kk, t in rows if kk == k]
        want += [(k, b - a) for a, b in zip(mine, mine[1:]) if (b - a).total_seconds() >= 4000]
    # the event of day 1 came when the watermark was at day 5: it is late and makes no silence
    assert sorted((r.key, r.end - r.start) for r in got) == sorted(want)


def test_state_of_a_stream_ends(spark, tmp_path):
    stream.use_timers(spark)
    day = timedelta(days=1)
    batches = [[(1, T0), (2, T0)], [(3, T0 + 2 * day)], [(3, T0 + 3 * day)], [(1, T0 + 4 * day), (3, T0 + 4 * day)], [(3, T0 + 6 * day)], [(3, T0 + 7 * day)]]
    make = lambda s: stream.stream_gaps(s, "k", "ts", "1 hour", 3600.0, forget_s=86400.0 * 1.5)
    got, q = _streamed(spark, tmp_path, batches, make, "ended")
    assert not [r for r in got if r.key == 1] and {r.gap_s for r in got if r.key == 3} <= {86400.0, 2 * 86400.0}
    kept = next(p.stateOperators[0].numRowsTotal for p in reversed(q.recentProgress) if p.stateOperators)
    assert kept <= 6  # last time, waiting times and timers of key 3 alone


def test_entry_works_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{repo}/trailmill", tmp_path / "trailmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries()))]))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    n, orphans = json.loads(out.stdout.strip().splitlines()[-1])
    assert n > 50 and orphans == []


def test_digest_masks_secrets(spark):
    rows = [("c", "authorization.accessToken", "tok-123"), ("c", "http.url", "https://h.example/in"), ("c", "locator", "wss://h.example/x"), ("c", "refreshToken", "tok-456"), ("c", "headers.X-Key", "tok-789"), ("c", "debug", "true"), ("c", "distanceFilter", None)]
    text = sinks.digest({"config": spark.createDataFrame(rows, "capture_id string, key string, value string")}, "c")
    assert not any(x in text for x in ("tok-", "h.example"))
    assert "| debug | true |" in text


def test_neighbours_against_a_loop(spark):
    rng = random.Random(3)
    ev = [("c", i, rng.randrange(40)) for i in range(300)]
    fx = [("c", 1000 + i, rng.randrange(40), float(i)) for i in range(60)]
    e = spark.createDataFrame(ev, "by string, seq int, s int").withColumn("ts", F.timestamp_seconds("s"))
    f = spark.createDataFrame(fx, "by string, seq int, s int, lat double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.seq: (r.prev_lat, r.next_lat) for r in asof.neighbours(e, f, ["by"], "ts", ["seq"], ["lat"]).collect()}
    line = sorted(fx, key=lambda x: (x[2], x[1]))
    for _, seq, s in ev:
        before = [x[3] for x in line if x[2] < s]
        after = [x[3] for x in line if x[2] >= s]
        assert got[seq] == (before[-1] if before else None, after[0] if after else None)


def test_rules_missing_file_and_order_of_layers(spark, tmp_path):
    from trailmill.plans import router

    rules, warnings = router.load_rules(str(tmp_path / "none.json"))
    assert list(rules.layers) == list(router.LAYERS) and len(warnings) == 1
    with open(tmp_path / "r.json", "w") as f:
        json.dump({"layers": {"b": {"clock": 3}, "a": None}, "rules": [{"icon": "no match"}, {"match": "x", "icon": "i"}], "other": 1}, f)
    rules, warnings = router.load_rules(str(tmp_path / "r.json"))
    assert list(rules.layers) == ["b", "a"] and len(rules.rules) == 1 and not warnings
    d = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "layer string")
    got = d.select(router.layer_rank(rules, F.col("layer")), router.layer_setting(rules, F.col("layer"), "clock", 12)).collect()
    assert [tuple(r) for r in got] == [(1, 12), (0, 3), (2, 12), (2, 12)]


def test_heartbeat_interval_of_the_configuration(spark):
    lines = [at(60 * i, "[HeartbeatService run] onHeartbeat") for i in range(5)]
    m = log(spark, lines)
    cfg = lambda v: spark.createDataFrame([("c", "app.heartbeatInterval", v)], "capture_id string, key string, value string")
    for value, stretched in (("30", True), ("60", False), ("0", False), ("soon", False), (None, False)):
        assert [r.stretched for r in findings.heartbeats(m, cfg=cfg(value)).collect()] == [stretched]
    gap = findings.gaps(m)
    assert "heartbeat-cadence" in [r.kind for r in findings.anomalies(m, gap, cfg=cfg("30")).collect()]
    assert "heartbeat-cadence" not in [r.kind for r in findings.anomalies(m, gap, cfg=cfg("60")).collect()]


def test_meanings(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("categories:\n- {match_class: Http.*, category: http}\n- {match_class: '(', category: bad}\n- {match_body_hint: saved, category: store}\n- {match_semantic: tw, category: twins}\nbody_emoji_hints: {'💾': saved}\nicon_semantics:\n  android:\n  - {icon: '⚠️', semantic: warn, family: severity, valid_from: '2.0'}\n", encoding="utf-8")
    m, warn = vocabulary.load_meanings(str(tmp_path / "m.yaml"))
    assert len(m.categories) == 3 and len(warn) == 1 and vocabulary.load_meanings(str(tmp_path / "none.yaml"))[1]
    rows = [("android", "x flush started n=3", "LoggerFacade", None, "INFO", "⚠", "2.1"), ("android", "💾 zz", "Q", None, None, "⚠", "1.0"), ("android", None, None, None, None, None, None), ("ios", "same text 1", "Tw", "a:", None, None, None)]
    d = spark.createDataFrame(rows, "platform string, raw string, tag_class string, tag_method string, level string, icon string, version string")
    got = [(r.klass.status, r.category, r.klass.semantic, r.klass.family) for r in vocabulary.interpret(vocabulary.classify(d, ENTRIES), m).collect()]
    assert got == [("matched", "http", "warn", "severity"), ("unknown", "store", None, None), ("unknown", None, None, None), ("matched", None, None, None)]
