import gzip

import pytest
from pyspark.sql import functions as F

from trailmill.plans import analyze as A
from trailmill.plans import sinks
from trailmill.sources import captures as C
from trailmill.sources import payloads as P
from trailmill.sources import records as R

ANDROID = """noise before the first header
12-31 23:59:50.100 INFO [LoggerFacade$Entry log] ⏱️ [Config hydrate] 123ms
12-31 23:59:51.100 DEBUG [AbstractService stopDelayed[λ]] \n  🔵 Location[fused 45.5188,-73.6005 hAcc=12.5 et=+1d2h3m4s5ms alt=20.0 vel=1.5 bear=90.0 {Bundle[{a=1}]}], time: 1700000000000
01-01 00:10:00.000 WARN [HttpService flush] ⚠️ HTTP Service (count: 3)
╔══════
║ something
╟─ row
01-01 00:10:01.000 ERROR [X y] Response: 500
  DetectedActivity [type=walking, confidence=88]
02-30 00:10:01.000 ERROR [X y] no such day
"""
IOS = """2024-01-02 10:00:00.000 📌 🔒 -[Authorization check:] hello

2024-01-02 10:00:01.500 
0:📍<+45.01491283,-72.12346833> +/- 5.00m (speed -1.00 mps / course -1.00) @ 1/2/24, 10:00 | age: 12 ms

1:📍<+45.02,-72.13> +/- 6.00m

2024-01-02 10:00:02.000 📍<+45.03,-72.14> +/- 6.00m

2024-01-02 10:00:03.000 {
    foo = "<null>";
    bar = ( 1, "2", x );
    nested =     {
        q = 3.5;
    };
}

2024-01-02 10:20:04.000 🔴 __12-[Http foo:bar:]_block_invoke_2 Error Domain=NSURL Code=-1009 "offline" UserInfo={NSLocalizedDescription=The line}
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    (d / "a one.log").write_text(ANDROID)
    (d / "i.log.gz").write_bytes(gzip.compress(IOS.encode()))
    (d / "magic.log").write_bytes(gzip.compress(IOS.encode()))
    (d / "broken.log").write_bytes(b"hello \xff\xfe world\n")
    (d / "empty.log").write_bytes(b"")
    return d


@pytest.fixture(scope="module")
def records(spark, folder):
    return P.annotate(R.assemble(C.read_captures(spark, [f"{folder}/*"], 2023))).cache()


def test_captures(spark, folder):
    got = {r.capture_id: r for r in C.read_captures(spark, [f"{folder}/*"], 2023).collect()}
    assert {k: r.platform for k, r in got.items()} == {"a_one": "android", "i": "ios", "magic": "ios", "broken": "unknown"}  # Spark lists no empty files
    assert got["broken"].text == "hello �� world\n" and got["broken"].notes


def test_android_records(records):
    r = records.where("capture_id = 'a_one'").orderBy("seq").collect()
    assert [x.line_no for x in r] == [2, 3, 5, 9, 11]
    assert (r[0].tag_class, r[0].tag_method, r[0].header_msg, r[0].icon) == ("Config", "hydrate", "123ms", "⏱")
    assert (r[1].tag_method_raw, r[1].tag_method, r[1].icon) == ("stopDelayed[λ]", "stopDelayed", "🔵")
    assert [str(x.ts)[:10] if x.ts else None for x in r] == ["2023-12-31", "2023-12-31", "2024-01-01", "2024-01-01", None]
    assert r[2].body == ["╔══════", "║ something", "╟─ row"] and r[2].raw.endswith("╟─ row")


def test_ios_records(records):
    r = records.where("capture_id = 'i'").orderBy("seq").collect()
    assert (r[0].icon, r[0].tag_class, r[0].tag_method, r[0].header_msg, r[0].body) == ("📌🔒", "Authorization", "check:", "hello", [])
    assert r[1].body[1] == "" and len(r[1].body) == 3  # a blank line inside stays
    assert r[2].icon is None and r[4].tag_class == "Http"


def test_payloads(records):
    a = {x.seq: x.structs for x in records.where("capture_id = 'a_one'").collect()}
    loc = a[1].location
    assert (loc.lat, loc.lon, loc.acc, loc.speed, loc.course, loc.et_ms, loc.time_ms) == (45.5188, -73.6005, 12.5, 1.5, 90.0, 93_784_005, 1_700_000_000_000)
    assert a[1].locations is None and a[2].http["count"] == 3 and a[3].http.status == 500 and a[3].detected_activity.confidence == 88
    i = {x.seq: x.structs for x in records.where("capture_id = 'i'").collect()}
    assert [x.batch_index for x in i[1].locations] == [0, 1] and i[1].location.speed is None and i[1].location.age_ms == 12
    assert i[2].locations is None and i[2].location.lat == 45.03
    assert i[3].config_dump.data == '{"foo": null, "bar": [1, 2, "x"], "nested": {"q": 3.5}}' and i[3].config_dump.truncated is False
    assert (i[4].nserror.domain, i[4].nserror.code, i[4].nserror.desc) == ("NSURL", -1009, "The line")


@pytest.mark.parametrize("body,data,cut", [
    ('{\n  "a": 1,\n  "b": {\n    "c": [1]\n  },\n  "d": "x', {"a": 1, "b": {"c": [1]}}, True),
    ('{\n  "a": true\n}', {"a": True}, False),
    ("{\n    a = {(\n        1,\n        2\n    )};\n    b = \"q; r\";\n", {"a": [1, 2], "b": "q; r"}, True),
])
def test_config_dump(body, data, cut):
    import json

    text, truncated = P.config_dump("head\n" + body)
    assert json.loads(text) == data and truncated is cut


GARBAGE = ["Location[", "Location[]", "Location[fused x,y]", "📍<", "📍<a,b>", "decision=", "Intent {", "Intent { act=", "{", "{\n a = ", "{\n  \"a\": ", "Error Domain=", "HTTP ERROR: ", "Response: x", "<CMMotionActivity", "╟─ A: -", "📢 Geofence:", "Geofencing Event: ", "{(" * 300, "((((" * 300, "}" * 50, "\x00", "=;=;", "FilterResult[a=1, a=2]", "Location[a 1,2 x=1 x=2 x=3]"]


def test_garbage_never_raises(spark):
    rows = [(i, g) for i, g in enumerate(GARBAGE + [g + "\n" + g for g in GARBAGE] + ["x\n" + g for g in GARBAGE])]
    d = P.annotate(spark.createDataFrame(rows, "seq int, raw string"))
    got = {r.seq: r for r in d.collect()}
    assert len(got) == len(rows) and all(got[i].raw == g for i, g in rows)
    assert got[GARBAGE.index("FilterResult[a=1, a=2]")].structs.filter_result.extras == {"a": "2"}


def test_duplicates(spark):
    long = "x" * 300
    rows = [(0, "abc"), (1, "abcdef"), (2, "abc"), (3, long), (4, long + "y"), (5, long + "y"), (6, ""), (7, None), (8, "zzz")]
    got = {r.k: r.duplicate for r in C.duplicates(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    want = {}
    for k, t in rows:
        t = t or ""
        want[k] = any((u or "") == t and j < k for j, u in rows) or any(len(u or "") > len(t) and (u or "").startswith(t) for j, u in rows)
    assert got == want


def test_duplicates_meet_by_beginnings_in_segments(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in (40, 300, 1000, 5000)]
    texts = [t[: rng.randint(0, len(t))] + rng.choice(["", "", "x", "yy"]) + t[rng.randint(0, len(t)) :] * rng.randint(0, 1) for t in base for _ in range(40)]
    texts += [t[:cut] for t in base for cut in (1, 16, 31, 32, 33, 63, 64, len(t))]
    dealt = []
    monkeypatch.setattr(C.scan, "written", lambda df, tag, f=C.scan.written: dealt.append(f(df, tag)) or dealt[-1])
    got = {r.k: r.duplicate for r in C.duplicates(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", segment_bytes=20_000, row_bytes=100, common=30).collect()}
    assert got == {k: any(u == t and j < k or len(u) > len(t) and u.startswith(t) for j, u in enumerate(texts)) for k, t in enumerate(texts)}
    assert dealt[0].where("length(t) > 2 * p").count() == 0
    assert dealt[0].select(C.scan.segment_column(["s0", "s1", "t"])).distinct().count() > 3


def test_heavy_rows_are_dealt_by_weight(spark):
    d = spark.range(100).select(C.F.lit(0).alias("c"), "id", C.F.when(C.F.col("id") >= 90, 100).otherwise(1).alias("w"))
    got = C.scan.deal(d, ["c"], ["id"], parts=10, weight=C.F.col("w"))
    assert sorted(map(tuple, got.select("c", "id", "w").collect())) == sorted(map(tuple, d.collect()))
    assert got.where("w = 100").select(C.scan.segment_column(["id"])).distinct().count() >= 5


def test_line_ends(spark):
    d = C.explode_lines(spark.createDataFrame([("a\r\nb\rc\x0bd\x85e f\n\n",)], "text string"))
    assert [r.line for r in d.orderBy("line_no").collect()] == ["a", "b", "c", "d", "e", "f", ""]


def test_analysis_end_to_end(spark, folder):
    res = A.analyze(spark, [f"{folder}/*"], 2023)
    gaps = res.tables["gaps"].collect()
    assert [(g.capture_id, g.gap_s, g.kind) for g in gaps if g.capture_id != "magic"] == [("i", 1201.0, "suspension")] or len(gaps) == 1
    for name, t in res.tables.items():
        if t is not None:
            t.collect()
    one = gaps[0].capture_id
    text = sinks.digest(res.tables, one)
    assert text == sinks.digest(res.tables, one) and "suspension" in text and text.count("\n") < 250
    doc = sinks.layer_document(res.features, one)
    assert {"fixes", "track"} <= set(doc) and "auth" not in doc and len(doc["fixes"]["features"]) == 3
    page = sinks.map_page({"x</script>": {"features": []}}, "<t>")
    assert "</script>\":" not in page and "http://www.w3.org" in page and "src=" not in page


def test_redaction(spark, records):
    d, table = A.redacted(records.where("capture_id = 'i'"))
    aliases = {r.key: r.alias for r in table.collect()}
    assert aliases["45.01491283,-72.12346833"] == "COORD-A" and aliases["45.03,-72.14"] == "COORD-C"
    assert not d.where(F.col("redacted").contains("45.0")).count()


def test_slice(spark, records):
    one = records.where("capture_id = 'i'")
    assert A.slice_records(one, "2024-01-02 10:00:01.500±1s").count() == 2
    assert A.slice_records(one, "01-02 10:00:03.000±1m").count() == 4
    assert A.slice_records(one, "2024-01-02 10:20±0s").count() == 1
    with pytest.raises(ValueError):
        A.slice_records(one, "nonsense")


def test_two_files_of_one_name_are_two_captures(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "log.log").write_text(f"01-02 03:04:05.000 INFO [A b] {d}\n")
    (tmp_path / "a" / "other.log").write_text("01-02 03:04:05.000 INFO [A b] x\n")
    ids = sorted(r.capture_id for r in C.read_captures(spark, [f"{tmp_path}/*/*.log"], 2024).select("capture_id").collect())
    assert len(set(ids)) == 3 and ids[2] == "other" and all(x.startswith("log-") for x in ids[:2])
