import json

from pyspark.sql import functions as F

from trailmill.functions import exprs as X
from trailmill.operators import aggregate as A
from trailmill.plans import findings as N
from trailmill.plans import sinks, vocabulary


def test_both_ends(spark):
    rows = [(g, i) for g, n in [("a", 3), ("b", 4), ("c", 5), ("d", 300), ("e", 1)] for i in range(n)]
    d = spark.createDataFrame(rows, "g string, i int")
    got = A.both_ends(d, ["g"], [F.asc("i")], [F.desc("i")], 2, 2)
    want = A.two_sided_cap(d, ["g"], ["i"], 2, 2)
    assert sorted((r.g, r.i) for r in got.collect()) == sorted((r.g, r.i) for r in want.collect())
    assert all(r.nth == r.i + 1 for r in got.collect())
    assert A.both_ends(d.limit(0), ["g"], [F.asc("i")], [F.desc("i")], 2, 2).count() == 0


def test_first_lines(spark):
    cases = ["", "a", "a\nb\nc", "a\r\nb\nc\nd", "a\nb\nc\n\n", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(X.first_lines(F.col("t"), 3)).collect()]
    assert got == ["", "a", "a\nb\nc", "a\nb\nc\n… (+1 more lines)", "a\nb\nc\n\n", None]


def test_groups_name_their_sites_as_they_come_first(spark):
    rows = [("c", i, None, "K", None, "error", "s", f"raw {i}", "fg") for i in range(4)] + [("c", 9, None, "L", "m", "warning", "s", "other", "bg")]
    m = spark.createDataFrame(rows, "capture_id string, seq int, ts timestamp_ntz, tag_class string, tag_method string, severity string, shape string, raw string, state string")
    sites = {0: ["b:2"], 1: ["a:1", "b:2"], 2: None, 3: ["a:1"], 9: []}
    k = spark.createDataFrame([("c", i, (s,)) for i, s in sites.items()], "capture_id string, seq int, klass struct<sites:array<string>>")
    got = {r.tag_class: (r.n, r.sites, r.sample, r.by_state) for r in N.dedup(m, k).collect()}
    assert got == {"K": (4, ["b:2", "a:1"], "raw 0", {"fg": 4}), "L": (1, [], "other", {"bg": 1})}
    assert all(r.sites == [] for r in N.dedup(m).collect())


def test_source_notes_need_lines_and_a_release(spark):
    g = spark.createDataFrame([("a", ["src/x/File.ext:12"]), ("b", ["entry.id"]), ("c", ["x/F.ext:1", "y"])], "capture_id string, sites array<string>")
    h = spark.createDataFrame([("a", "ios", ["3.1", "4.0"]), ("b", "ios", []), ("c", "unknown", [])], "capture_id string, platform string, versions array<string>")
    got = {r.capture_id: r.note for r in N.source_notes(g, h, {"iOS": "4.2.0", "android": "5.0"}).collect()}
    assert set(got) == {"a", "c"} and "**iOS 4.2.0**" in got["a"] and "3.1 / 4.0" in got["a"] and "**android 5.0 / iOS 4.2.0**" in got["c"] and "This capture" not in got["c"]


def test_vocabulary_files_say_their_release_and_sources(tmp_path):
    f = tmp_path / "v.json"
    f.write_text(json.dumps({"meta": {"platform": "ios", "harvested_refs": {"HEAD": "x", "3.9.0": "y", "3.10.1": "z"}}, "entries": [{"id": "a", "patterns": ["x"]}]}))
    assert vocabulary.harvest_versions(str(f), "other") == {"ios": "3.10.1"}
    for bad in ("[]", "{}", '{"meta": 3}', '{"meta": {"harvested_refs": {"HEAD": 1}}}', "{"):
        f.write_text(bad)
        assert vocabulary.harvest_versions(str(f), "ios") == {} and vocabulary.load_sources(str(f))[0] == {} and vocabulary.load_sources(str(f))[1]
    f.write_text(json.dumps({"sources": {"a": ["f:1", "g:2"], "b": "h:3", "c": None}}))
    assert vocabulary.load_sources(str(f)) == ({"a": ["f:1", "g:2"], "b": ["h:3"]}, [])


def test_sections_show_ends_groups_and_texts(spark):
    gaps = spark.createDataFrame([("c", i, None, 60.0 * i, "suspension") for i in range(100)], "capture_id string, seq int, start timestamp_ntz, gap_s double, kind string")
    dedup = spark.createDataFrame(
        [("c", 3, "K", None, None, None, ["/a/b:3"], "l1\n```\n" + "\n".join("xyz"), 0, "error", "s")],
        "capture_id string, n bigint, tag_class string, tag_method string, first_ts timestamp_ntz, last_ts timestamp_ntz, sites array<string>, sample string, first_seq int, severity string, shape string",
    )
    status = spark.createDataFrame([("c", "200", 2, (4, 0)), ("c", "500", 7, (9, 0)), ("c", "404", 2, (3, 1))], "capture_id string, value string, n bigint, first struct<__o:int,__i:int>")
    sessions = spark.createDataFrame([("c", 0, None, None, 1234.0, "", 5), ("c", 1, None, None, 3.0, "death", 6)], "capture_id string, session int, start timestamp_ntz, end timestamp_ntz, distance_m double, ended_by string, records bigint")
    notes = spark.createDataFrame([("d", "not of c")], "capture_id string, note string")
    text = sinks.digest({"gaps": gaps, "dedup": dedup, "status": status, "sessions": sessions, "source_notes": notes}, "c")
    assert "… 60 left out …" in text and text.count("| suspension |") == 40 and "1.6 h" in text
    assert "**3 × K** — → —" in text and "- at `/a/b:3`" in text and "````\nl1\n```\nx\ny\nz\n````" in text
    assert "500×7, 404×2, 200×2" in text and "session 1 of 2 · 1.2 km" in text and "session 2 of 2 · ended by death" in text
    assert "Source lines" not in text and "not of c" not in text
    assert "> not of c" in sinks.digest({"source_notes": notes}, "d")
