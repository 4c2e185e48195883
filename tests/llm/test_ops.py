"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and other
columns with clashing names."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmill.llm import decontam, langid, lm_score, neardup_vectors, pieces, pii, sharding, simhash, training_order, warc
from trailmill.llm.common import connected_components, gapless

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, uid string, w string, fp string, h1 string"
WORDS = ["the", "of", "and", "Être", "straße", "日本", "x1", "12", "run", "away", "mail"]


def documents(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "src", None, -i, "u", None, "fp", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(seed=1, n=40):
    rnd = random.Random(seed)
    out = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return [*out, None, "", "   \n\t", out[0], out[0], out[1] + " x", " ".join(rnd.choice(WORDS) for _ in range(30_000)), "a" * 50_000, "one"]


def components(n, pairs):
    par = list(range(n))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


# Common ------------------------------------------------------------------------------------------------------------


def test_connected_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    comp = components(400, edges)
    assert got == {x: comp[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gapless(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 2).alias("g"), "id")
    got = gapless(d, ["g"], ["id"], "r", 50).collect()
    for g in (0, 1):
        assert sorted(r.r for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


# 1 -----------------------------------------------------------------------------------------------------------------


def words_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark):
    rnd = random.Random(5)
    item = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(1, item(25)), (2, item(10)), (3, item(4)), (4, item(2)), (5, "mail"), (6, None), (7, "--- "), (None, item(14)), (8, item(12))]
    items.append((9, items[0][1]))
    ts = texts(2, 60) + [f"clean {items[0][1]}, and more", items[1][1].upper(), "zz " + items[0][1][:40], items[8][1] + " " + items[8][1]]
    b = spark.createDataFrame(items + [items[0]], "item_id bigint, text string").withColumn("win", F.lit(1))
    got = {r.doc_id: r for r in decontam.contamination(documents(spark, ts), b).collect()}
    wins = {}
    for i, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    assert len(got) == len(ts)
    for d, t in enumerate(ts):
        w = words_of(t)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        names = sorted(str(i) for i in ids if i is not None)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit)), d
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_decontamination_without_broadcast_and_empty(spark):
    ts = ["a b c d e f g h i j k", "x"]
    b = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id bigint, text string")
    got = {r.doc_id: r.n_hit for r in decontam.contamination(documents(spark, ts), b, broadcast_rows=0).collect()}
    assert got == {0: 10, 1: 0}
    assert {r.n_hit for r in decontam.contamination(documents(spark, ts), b.limit(0)).collect()} == {0}
    assert decontam.contamination(documents(spark, []), b).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------


def test_vector_dedup(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 60)) if c < 6 else 1):
            rows.append([float(x) for x in base + 0.08 * rng.standard_normal(16)])
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 16, None, [], [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    labels = [None if i % 41 == 40 else int(i % 3 == 0) for i in range(len(rows))]
    d = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in enumerate(zip(rows, labels))], "vec_id bigint, embedding array<double>, label int, unit string")
    got = {r.vec_id: r for r in neardup_vectors.vector_dedup(d, audit=10, tables=3).collect()}
    ok = [i for i, v in enumerate(rows) if v and labels[i] is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            x, y = np.array(rows[i]), np.array(rows[j])
            if labels[i] == labels[j] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                pairs.append((i, j))
    n, comp = Counter(x for p in pairs for x in p), components(len(rows), pairs)
    assert len(pairs) > 500
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in range(len(rows))}


def test_vector_dedup_empty(spark):
    assert neardup_vectors.vector_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def bridged_groups(rng, n=60, dim=24):
    """Two groups of one label with cosines of about 0.97 inside; only a few pairs across reach 0.93."""

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    c = unit(rng.standard_normal(dim))
    d = rng.standard_normal(dim)
    d = unit(d - (d @ c) * c)
    groups = []
    for angle in (0.0, 0.47):
        g = unit(unit(np.cos(angle) * c + np.sin(angle) * d) + 0.17 * rng.standard_normal((n, dim)) / np.sqrt(dim))
        groups.append(g)
    return np.concatenate(groups)


def brute_links(v, threshold=0.93):
    hit = v @ v.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


def test_dense_groups_joined_by_a_bridge(spark):
    v = bridged_groups(np.random.default_rng(4))
    v = np.concatenate([v, np.random.default_rng(5).standard_normal((40, 24))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = brute_links(v)
    assert 1 <= hit[:60, 60:120].sum() <= 200 and not hit[0, 60] and hit[:60, :60].sum() > 60 * 55
    comp = components(len(v), list(zip(*np.nonzero(hit))))
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    # without an audit, whose own links could be those of the bridge
    got = {r.vec_id: r for r in neardup_vectors.vector_dedup(d, audit=0).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(hit[i].sum()), comp[i], comp[i] == i) for i in range(len(v))}


def test_recall_weighs_vectors_and_tables_grow(spark):
    truth = spark.createDataFrame([(1, i) for i in range(100, 400)] + [(2, 3), (4, 5)], "u bigint, v bigint")
    comps = spark.createDataFrame([(x, 1) for x in [1, *range(100, 400)]] + [(4, 4), (5, 4)], "node bigint, component bigint")
    assert abs(neardup_vectors._recall(truth, comps) - 2 / 3) < 1e-9
    assert neardup_vectors._recall(truth.where("u < 0"), comps) is None
    sizes = [neardup_vectors._tables_for(n, 0.93, 0.99) for n in (0, 100, 5000, 100_000, 3_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] > 2 * sizes[2]


def test_few_links_are_audited_by_other_sorts(spark, monkeypatch):
    """A hundred audited vectors of many, none of them linked: the graph's lost links are seen all the same."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    v[1], v[3] = v[0] * 2, v[2] + 0.01
    df = spark.createDataFrame([(i, [float(x) for x in r], "l") for i, r in enumerate(v)], "vec_id bigint, embedding array<double>, label string")
    monkeypatch.setattr(neardup_vectors, "_audit", lambda nodes, threshold, audit: spark.createDataFrame([], "u bigint, v bigint"))
    real, calls = neardup_vectors.neighbour_graph, []

    def blind(nodes, *a):
        calls.append(a)
        return real(nodes, *a).where("false")

    monkeypatch.setattr(neardup_vectors, "neighbour_graph", blind)
    got = {r.vec_id: r.component_id for r in neardup_vectors.vector_dedup(df).collect()}
    assert len(calls) > 2 and got[1] == 0 and got[3] == 2 and got[5] == 5


def test_every_turn_is_measured_and_the_last_resort_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.repeat(rng.standard_normal((60, 16)), 2, axis=0) + 0.08 * rng.standard_normal((120, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = brute_links(v)
    comp = components(120, list(zip(*np.nonzero(hit))))
    turns = []

    def nothing(nodes, *args):  # a graph that finds no link at all
        turns.append(args[-1])
        return spark.createDataFrame([], "u bigint, v bigint, s float")

    monkeypatch.setattr(neardup_vectors, "neighbour_graph", nothing)
    d = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: r for r in neardup_vectors.vector_dedup(d, audit=5, tries=2).collect()}
    assert len(turns) == 4 and hit.sum() > 60
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(hit[i].sum()), comp[i]) for i in range(120)}


def test_links_are_counted_across_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(8) + 0.25 * rng.standard_normal((120, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, 0, 1 + i % 2, bytearray(x.tobytes())) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "rid bigint, comp bigint, mult bigint, unit binary")
    got = {r.rid: r.n for r in neardup_vectors._count_links(d, 0.93, block=16, block_max=16).collect()}
    hit = v @ v.T >= 0.93
    np.fill_diagonal(hit, True)
    want = hit @ np.array([r[2] for r in rows])
    assert [got[i] for i in range(120)] == want.tolist()


# 3 -----------------------------------------------------------------------------------------------------------------


def test_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(200):
        items = [rnd.choice([rnd.randint(1, 50), 7, 13]) for _ in range(rnd.randint(1, 80))]
        cap = rnd.randint(max(items), 120)
        bins = []
        for x in sorted(items, reverse=True):
            fit = [(r, i) for i, r in enumerate(bins) if r >= x]
            if fit:
                bins[min(fit)[1]] -= x
            else:
                bins.append(cap - x)
        fill = Counter()
        for size, b, n in sharding.pack(list(Counter(items).items()), cap):
            fill[b] += size * n
        assert sorted(fill.values()) == sorted(cap - r for r in bins)


def test_capacity_tree():
    rnd, tree, plain = random.Random(2), sharding.CapacityTree(), []
    for i in range(5000):
        tree.add(r := rnd.randint(1, 900), i)
        plain.append((r, i))
        if rnd.random() < 0.4:
            s = rnd.randint(1, 950)
            want = min((x for x in plain if x[0] >= s), default=None)
            assert tree.pop_fit(s) == want
            if want:
                plain.remove(want)


def test_sharding(spark):
    ts = texts(6, 400)[:-3] + ["hot"] * 300
    got = sharding.shard_by_size(documents(spark, ts)).collect()
    assert len(got) == len(ts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, group = Counter(), {}
    for r in got:
        t = (ts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        total[r.shard] += r.size
        assert group.setdefault(t, r.shard) == r.shard
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= 0.01 * sum(total.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_size(documents(spark, [])).count() == 0
    alone = sharding.pack_even([(1000, 1), (1, 70)], 8)
    assert Counter({b: sum(s * n for s, x, n in alone if x == b) for _, b, _ in alone}) == Counter({0: 1000, **{i: 10 for i in range(1, 8)}})


# 4 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    p = training_order.Permutation(n, 7)
    x = p.slots(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.index(x) == np.arange(n)).all()
    if n > 100:
        assert (x != training_order.Permutation(n, 8).slots(np.arange(n))).any()


def test_training_order_round_trip(spark, tmp_path):
    ts = texts(7)
    d = documents(spark, ts).repartition(3).union(spark.createDataFrame([(None, "no id", *[None] * 8)], SCHEMA))
    path = tmp_path / "in"
    d.write.parquet(str(path))
    d = spark.read.parquet(str(path))
    manifest, total, per = training_order.write_shards(d, f"file://{tmp_path}/out", key=3, length=64, shard_records=100)
    with open(training_order.default_ranks(), "rb") as f:
        encode, eos = training_order.encoder(f.read())
    back, slots = {}, []
    for m in manifest.collect():
        for k, i, part, tokens in training_order.read_records(m.path, 64):
            slots.append(m.first_slot + k)
            back[i, part] = tokens
        tail = list(training_order.read_records(m.path, 64, start=m.records - 1))
        assert len(tail) == 1 and tail[0][0] == m.records - 1
    assert sorted(slots) == list(range(total))
    for i, t in [*enumerate(ts), (None, "no id")]:
        raw = b"".join(back[i, p] for p in range(sum(1 for k in back if k[0] == i)))
        assert np.frombuffer(raw, "<u2").tolist() == [*encode(t or ""), eos]
    again = {r.shard: r.sha256 for r in training_order.write_shards(d, f"file://{tmp_path}/again", key=3, length=64, shard_records=100)[0].collect()}
    assert again == {r.shard: r.sha256 for r in manifest.collect()}
    assert training_order.training_order(documents(spark, [])).count() == 0
    few = training_order.write_shards(d, f"file://{tmp_path}/few", key=3, length=64, shard_records=100, tasks=3)[0]
    assert {r.shard: r.sha256 for r in few.collect()} == again


def test_training_order_against_a_plain_permutation(spark, tmp_path):
    ts = [t for t in texts(8) if t]
    documents(spark, ts).coalesce(1).write.parquet(f"{tmp_path}/in")
    with open(training_order.default_ranks(), "rb") as f:
        encode, eos = training_order.encoder(f.read())
    seqs = [(d, k, ids[lo : lo + 16]) for d, t in enumerate(ts) for ids in [[*encode(t), eos]] for k, lo in enumerate(range(0, len(ids), 16))]
    slot = training_order.Permutation(len(seqs), 5).slots(np.arange(len(seqs)))
    want = {int(s): (d, k, len(x), zlib.crc32(np.array(x, "<u2").tobytes())) for s, (d, k, x) in zip(slot, seqs)}
    got = training_order.training_order(spark.read.parquet(f"{tmp_path}/in"), key=5, length=16, shard_records=50).collect()
    assert {r.slot: (r.doc_id, r.part, r.n_tokens, r.tokens_crc32) for r in got} == want and len(got) == len(seqs)
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * (training_order.HEAD_SIZE + 32) for r in got)


def test_faster_pattern_cuts_the_same_pieces():
    import public_tokenizers
    import tiktoken

    with open(training_order.default_ranks(), "rb") as f:
        ranks = f.read()
    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    encode, _ = training_order.encoder(ranks)
    assert public_tokenizers.PATTERN in training_order.FASTER
    rnd = random.Random(4)
    odd = [" ", " ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'", "'s", "'ll", "'LL", "'re", "a", "été", "日本", "e\u0301", "1", "²", "٣", "!", "--", "🙂", "_"]
    for _ in range(20_000):
        t = "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 12)))
        assert encode(t) == plain(t), repr(t)


@pytest.mark.parametrize("lost", [False, True])
def test_training_order_deals_what_it_counted(spark, tmp_path, monkeypatch, lost):
    """The second pass takes the sequences of the first, not the texts; where a kept file is lost, the texts."""
    ts = [t for t in texts(9) if t]
    documents(spark, ts).coalesce(1).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in").select("doc_id", "text")
    monkeypatch.setattr(training_order, "new_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    kept, seen = f"{tmp_path}/sequences", f"{tmp_path}/seen"

    def between(batches):
        for b in batches:
            if os.path.isdir(kept):
                files = os.listdir(kept)
                with open(seen, "w") as f:
                    f.write(str(len(files)))
                if lost:
                    for x in files:
                        os.remove(f"{kept}/{x}")
                else:
                    b = pa.RecordBatch.from_arrays([b.column(0), pa.array(["?"] * b.num_rows)], names=["doc_id", "text"])
            yield b

    got = training_order.write_shards(docs.mapInArrow(between, docs.schema), f"file://{tmp_path}/out", length=16, shard_records=50)[0].collect()
    with open(seen) as f:
        assert f.read() == "1"
    assert os.listdir(kept) == []
    with open(training_order.default_ranks(), "rb") as f:
        encode, eos = training_order.encoder(f.read())
    want = {(d, k): np.array(ids[lo : lo + 16], "<u2").tobytes() for d, t in enumerate(ts) for ids in [[*encode(t), eos]] for k, lo in enumerate(range(0, len(ids), 16))}
    assert {(i, k): x for m in got for _, i, k, x in training_order.read_records(m.path, 16)} == want


# 5 -----------------------------------------------------------------------------------------------------------------


def test_arc_versions_and_conversion():
    body = b"HTTP/1.1 200 OK\r\nX-Source-Row: 5\r\nContent-Length: 3\r\n\r\nabc"
    for v in (1, 2):
        data = warc.gzip_member(warc.arc_header(v, "a.arc.gz", "20200102030405")) + warc.gzip_member(warc.arc_record(v, "http://x/ y?q=é", "20200102030405", body, "a.arc.gz", 9))
        (_, desc), (off, rec) = warc.read_arc(data)
        assert desc.version == v and off > 0 and rec.body == body and rec.url.startswith("http://x/%20y") and rec.date == "20200102030405"
        (h, block), = warc.read_warc(warc.convert(rec))
        assert h["WARC-Type"] == "response" and block == body and h["WARC-Date"] == "2020-01-02T03:04:05Z" and h["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(b"abc")
        url, earlier = warc.quoted("http://x/fïrst"), "20200101000000"
        (_, one), = list(warc.read_arc(warc.gzip_member(warc.arc_header(v, "b", earlier)) + warc.gzip_member(warc.arc_record(v, "http://x/fïrst", earlier, body.replace(b"Row: 5", b"Row: 4"), "b", 9))))[1:]
        (to, _), = warc.read_warc(warc.convert(one))
        (h, block), = warc.read_warc(warc.convert(rec, (4, url, earlier)))
        assert h["WARC-Type"] == "revisit" and h[warc.ROW_OF] == "4" and block == body[:-3]
        assert (h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) == (to["WARC-Record-ID"], to["WARC-Target-URI"], to["WARC-Date"])
        assert next(warc.read_warc(warc.convert(desc)))[0]["WARC-Type"] == "warcinfo"
    cut = warc.arc_header(1, "a", "2020") + warc.arc_record(1, "http://x", "2020", body, "a", 0)[:-6]
    assert list(warc.read_arc(cut))[1][1].truncated
    spaced = warc.arc_header(1, "a", "2020") + b"http://x/a b 1.2.3.4 20200101000000 text/html 2\nhi\n"
    assert list(warc.read_arc(spaced))[1][1].url == "http://x/a b"
    with pytest.raises(ValueError):
        list(warc.read_arc(b"not an archive\n"))


def test_pages_round_trip(spark):
    html = ["<p>a</p>", "b", None, "", "b", "é" * 5000, "<p>a</p>", "b", "x\r\n\r\ny", "c"]
    rows = [(i, None if i == 3 else f"http://h/{i}", t, "x") for i, t in enumerate(html)] + [(None, "http://n", "c", "x"), (None, None, "only", "x")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, row string")
    got = {r.page_id: r for r in warc.pages_to_warc(d).collect() if r.page_id is not None}
    first = {}
    for i, t in enumerate(html):
        first.setdefault(t or "", i)
    for i, t in enumerate(html):
        t = t or ""
        want = (len(t.encode()), warc.base32_sha1(t.encode()), "response" if first[t] == i else "revisit", None if first[t] == i else first[t])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    small = {r.page_id: r.record_type for r in warc.pages_to_warc(d, min_bytes=2).collect()}
    assert small[4] == "response" and small[6] == "revisit"
    assert warc.pages_to_warc(d.limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t):
            h, g = m.group(), re.sub("[^0-9]", "", m.group())
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in h.split(".")) or k == "card" and 13 <= len(g) <= 19 and luhn(g) or k == "phone" and 9 <= len(g) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    rnd = random.Random(8)
    bits = ["a@b.c", "_d@e.f", "x.y+z@mail.example.com", "@", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-5555", "+49", "+", " ", "-", ".", "é", "日", "12", "5500000000000004", "\n", "%", "999.1.2.3.4.5", "x"]
    ts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    ts += [None, "", "9" * 60_000, "1 " * 20_000, "a" * 60_000 + "@", "a@b.c" * 300, "+1 555 555 5555 " * 200, ts[0], ts[0]]
    got = {r.doc_id: r for r in pii.pii_report(documents(spark, ts)).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        want = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r, n = got[i], Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE), (i, t[:80])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_adds_and_masks(spark):
    ts = [f"call {200 + i} now +1 (555) 555-{1000 + i} or x{i}@mail.example.com" for i in range(60)] + ["phone (555) 555-0199 please", "nothing here", None]
    d = documents(spark, ts)
    got = {r.doc_id: r for r in pii.pii_report(d).collect()}
    assert "phone:6:20" in got[60].spans and got[60].n_phone == 0 and got[61].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert red[0] == "call 200 now <phone> or <email>" and red[60] == "phone <phone> please" and red[61] == "nothing here" and red[62] is None
    assert pii.pii_report(documents(spark, [])).count() == 0


def test_em_finds_the_bad_labeler():
    rnd, counts = random.Random(1), Counter()
    for _ in range(4000):
        y = rnd.random() < 0.5
        counts[tuple((1 if y else -1) * (1 if rnd.random() < q else -1) for q in (0.95, 0.9, 0.85, 0.55))] += 1
    _, table, post = pii.em(dict(counts))
    rates = [t[1][0] for t in table]
    assert rates[0] > rates[2] > rates[3] and abs(rates[0] - 0.95) < 0.05 and post[1, 1, 1, -1] > 0.9


# 7 -----------------------------------------------------------------------------------------------------------------


def test_cross_parser_against_a_plain_parse():
    rnd = random.Random(2)
    samples = {"a": "".join(rnd.choice("abcab cd") for _ in range(400)), "b": "".join(rnd.choice("xyz ab") for _ in range(300))}
    p = langid.CrossParser(samples)
    ts = ["".join(rnd.choice("abcxyz dq") for _ in range(rnd.randint(1, 90))) for _ in range(50)]
    seqs = [langid._code_points(t) for t in ts]
    got = p.phrases(seqs, 10**6)
    sparse = langid.CrossParser(samples, 0)
    assert sparse.dense is None and p.dense is not None
    for block in (1, 2, 7, 64):
        assert (p.phrases(seqs, block) == got).all() and (sparse.phrases(seqs, block) == got).all()
    for k, lang in enumerate(p.langs):
        known = "".join(map(chr, langid._code_points(samples[lang])))
        for j, s in enumerate(seqs):
            t, n, i = "".join(map(chr, s)), 0, 0
            while i < len(t):
                e = i + 1
                while e <= len(t) and t[i:e] in known:
                    e += 1
                n, i = n + 1, max(i + 1, e - 1)
            assert got[k, j] == n, (lang, t)


def test_cross_parser_blocks_and_memory():
    rnd = random.Random(5)
    p = langid.CrossParser({"a": "a" * 40 + "".join(rnd.choice("abc ") for _ in range(3000)), "b": "ab" * 30 + "".join(rnd.choice("abd ") for _ in range(3000)), "none": ""})
    ts = ["a" * 5000, "ab" * 2500, "".join(rnd.choice("abcd ") for _ in range(9000)), "x" * 1500, "a", ""]
    seqs = [langid._code_points(t) for t in ts]
    want = p.phrases(seqs, 10**6)
    assert (p.phrases(seqs, 512) == want).all() and (p.phrases(seqs, 100) == want).all()
    wide = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(32_000))
    p = langid.CrossParser({"wide": wide})
    assert p.symbols > 2900 and p.dense is None and p.moves.keys.nbytes + p.moves.targets.nbytes + p.first.nbytes < 20_000_000
    assert p.phrases([langid._code_points(wide[:5000])], 512).tolist() == [[1]]


def test_language_samples_are_of_different_texts_and_places(spark):
    ts = ["same opening " * 200 + f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 300 for i in range(40)] + ["copy of a text"] * 60
    s = langid.learn(documents(spark, ts))["en"]
    assert s.count("copy of a text") <= 1 and sum(f"word{c}" in s for c in "abcdefghij") >= 3


def test_language_samples_with_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, f"text number {i} of many", "en") for i in range(500)] + [(7, f"noch ein text {i}", "de") for i in range(500)] + [(None, "always the same", "fr")] * 500 + [(1, "seul", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.training_samples(df, "doc_id", "text", "lang", 4, 4000)
    assert {k: len(v.split("\n")) for k, v in got.items()} == {"en": 4, "de": 4, "fr": 2} and "seul" in got["fr"]
    assert got == langid.training_samples(df.repartition(7), "doc_id", "text", "lang", 4, 4000)


def test_language_id(spark):
    vocab = {"en": ["the", "and", "house", "running", "with"], "de": ["der", "und", "haus", "laufen", "mit"], "fr": ["le", "et", "maison", "courir", "avec"]}
    rnd = random.Random(9)
    langs, ts = {}, []
    for i in range(300):
        lang = ["en", "en", "de", "fr"][i % 4]
        langs[i] = lang
        ts.append(" ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(4, 30))))
    ts += [None, "", "123 !!", "the " * 20_000, ts[0]]
    langs |= {303: None, 304: "en"}
    d = documents(spark, ts, langs).withColumn("lang_pred", F.lit("zz"))
    samples = langid.learn(d)
    assert set(samples) == set(vocab) and max(map(len, samples.values())) <= 32_000
    got = {r.doc_id: r for r in langid.identify(d, samples).collect()}
    assert len(got) == len(ts) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[303].lang_pred == "en"
    assert sum(got[i].lang_pred == langs[i] for i in range(300)) >= 295
    assert {r.lang_pred for r in langid.identify(d, {}).collect()} == {"und"}
    assert langid.learn(d.limit(0)) == {} and langid.identify(d.limit(0), samples).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceCodec(f.read(), cache_bytes=100_000, pairs=2000)


def test_codec_equals_the_library(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rnd = random.Random(3)
    alpha = ["a", "b", "e", "th", "ing", " ", "  ", "▁", "\n", "é", "ß", "日", "本", "😀", "\t", "x" * 40, " " * 50, "\x00", "\r\n", "the", "of ", ".", "1", "<0x0A>", "=====", "́"]
    for _ in range(3000):
        s = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 14)))
        ids = sp.encode(s)
        assert codec.encode(s) == ids and codec.encode_text(s)[1] == sp.decode(ids)
        r = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), rnd.randrange(3)]) for _ in range(rnd.randint(0, 6))]
        assert codec.decode(r) == sp.decode(r)
    long = "abcdefghij" * 3000
    assert codec.encode(long) == sp.encode(long)


def test_caches_are_bounded_by_bytes():
    import sys

    with open(pieces.default_model(), "rb") as f:
        c = pieces.PieceCodec(f.read(), cache_bytes=200_000)
    for i in range(3000):
        c.encode_text("".join(chr(0x1F300 + (i * 7 + j) % 500) for j in range(60)) + f" w{i}")
    size = lambda d: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
    assert size(c.chunks) < 200_000 and size(c.chunks.old) < 200_000 and size(c.inner) < 200_000


def test_encode_decode_rows(spark):
    ts = texts(4)
    got = {r.doc_id: r for r in pieces.encode_decode(documents(spark, ts), ids=True).collect()}
    for i, t in enumerate(ts):
        assert got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, got[i].ids)).encode()).hexdigest()
    assert pieces.encode_decode(documents(spark, [])).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def test_lm_scores(spark):
    ts = texts(9, 30) + ["one two  Three\tone two\nthree", "the same words here again " * 3000]
    got = {r.doc_id: r for r in lm_score.lm_scores(documents(spark, ts), block_words=200, bucket_bytes=2000).collect()}
    words = [lm_score.words_of(t) for t in ts]
    c = Counter(tuple(w[i : i + k]) for w in words for k in range(1, 4) for i in range(len(w) - k + 1))
    n = sum(map(len, words))
    for d, w in enumerate(words):
        s = 0.0
        for p in range(len(w)):
            room = min(3, p + 1)
            for k in range(room, 0, -1):
                g = tuple(w[p - k + 1 : p + 1])
                if k == 1 or c[g] >= 2:
                    s += (room - k) * math.log(0.4) + math.log(c[g] / (c[g[:-1]] if k > 1 else n))
                    break
        assert got[d].n_words == len(w) and got[d].log_score == pytest.approx(s, rel=1e-9)
        assert (got[d].avg_log_score is None) == (not w)
    assert lm_score.lm_scores(documents(spark, [])).count() == 0


def test_lm_scores_add_up_for_rows_of_one_id(spark):
    d = spark.createDataFrame([(1, "a b a b", "x"), (1, "c", "y"), (None, "a b", "z"), (2, None, "w")], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in lm_score.lm_scores(d).collect()}
    assert {k: r.n_words for k, r in got.items()} == {1: 5, None: 2, 2: 0}
    assert got[2].log_score == 0 and got[2].avg_log_score is None


def test_counts_pack():
    for x in ([0, 5, 65534, 65535, 70000, 10**12], [0], []):
        assert lm_score.unpack(lm_score.pack(np.array(x, dtype=np.uint64))).tolist() == x


# 10 ----------------------------------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").strip("\x20\x09\x0a\x0b\x0c\x0d"))
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rnd = random.Random(10)
    ts = texts(11, 60)
    for _ in range(60):  # near copies
        w = ts[rnd.randrange(60)].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        ts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.simhash_dedup(documents(spark, ts)).collect()}
    f = [fingerprint(t) for t in ts]
    assert [int(got[i].fingerprint, 16) for i in range(len(ts))] == f
    comp = components(len(ts), [(i, j) for i in range(len(ts)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    assert [got[i].component_id for i in range(len(ts))] == comp and len(set(comp)) < len(ts)
    kept = simhash.keep_one(documents(spark, ts).union(documents(spark, ts[:1])))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert simhash.simhash_dedup(documents(spark, [])).count() == 0


def test_bk_tree_pairs():
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(8)]
    v = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for b in base for _ in range(40)})
    t = simhash.BKTree(np.array(v, dtype=np.uint64))
    got = {(min(i, j), max(i, j)) for a, b in t.pairs(2, block=17) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (v[i] ^ v[j]).bit_count() <= 2}


# Pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    item = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(15))
    long = lambda: " ".join(f"word{rnd.randrange(10**6)}" for _ in range(80))
    ts = [long() for _ in range(30)]
    ts += [ts[0], "12345 !!", None, f"{long()} {item} {long()}", f"{long()} a@b.example.com"]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    documents(spark, ts).select(*cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == cols
    assert sorted(r.doc_id for r in docs.collect()) == [*range(30), 34]
    assert docs.where("doc_id = 34").first().text.endswith("<email>")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 31


def test_stages_drop_rows_and_not_ids(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(13)
    item = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(15))
    a, b, c, e = (" ".join(f"word{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = f"{e} {item}"
    rows = [(None, a, "x"), (None, bad, "x"), (5, b, "x"), (5, bad, "x"), (5, b, "y"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [r for r in rows if r[1] != bad]))
    # id 5 has two unrelated texts; 3 is a copy of one of them, 9 of the other; 7 repeats as a row
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "x"), (9, a, "x"), (7, c, "x"), (7, c, "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = [(5, a, "x"), (3, b, "x"), (7, c, "x"), (None, a, "x"), (None, a, "x")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    docs = spark.createDataFrame([(1, a, "z"), (1, a, "y")], "doc_id bigint, text string, lang string")
    assert simhash.keep_one(docs).collect() == simhash.keep_one(docs.orderBy("lang")).collect()
