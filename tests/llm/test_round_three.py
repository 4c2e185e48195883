"""Conversation repair, lexical search and mixing against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and other columns with clashing names."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from trailmill.llm import conversations, lexical, mixing

# Conversations -----------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by relaxing every (rows, state, position) until nothing changes: no heuristic, no pieces."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {(0, ""): (0, "", ())}
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if (cost, audit) > best[(i, last)][:2]:
            continue
        steps = [(2, "I", i, x, (f"{n}:",)) for x, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, what = rows[i]
            steps.append((3, "D", i + 1, last, ()))
            if what not in ("blank", "duplicate"):
                more = what == "truncated"
                steps += [(2 + more, "R", i + 1, x, (f"{n}:{text}",)) for x, n in (("u", "user"), ("a", "assistant"))]
                steps.append((more, "K", i + 1, role[:1], (f"{role}:{text}",)))
        for c, sign, j, there, shown in steps:
            if sign != "D" and (last, there) not in follows:
                continue
            new = (cost + c, audit + sign, out + shown)
            if (j, there) not in best or new[:2] < best[(j, there)][:2]:
                best[(j, there)] = new
                heapq.heappush(queue, (new[0], new[1], j, there, new[2]))
    return min(best[(len(rows), x)] for x in ("", "a") if (len(rows), x) in best)


def expected(rows, ids):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv in ids:
        group = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in group:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            what = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, what))
        turns = {r[1] for r in group if r[1] is not None}
        cost, audit, shown = cheapest(marked)
        n = Counter(m[2] for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(shown).encode()).hexdigest())
    return out


def chats(seed=5, n=60):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), role, rnd.choice(["Yes.", "No!", "cut off", "", None, "  \t", "Why?", f"x{turn}.", "ende. "])))
    return rows


CHAT = "conv_id bigint, turn bigint, role string, text string, part int, seq bigint, audit string, salt int"


def ask(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 1, 1, "a", 1) for r in rows], CHAT).repartition(parts)
    got = conversations.repair(conversations.damage(df), **kw).collect()
    out = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 2, "partition_rows": 25}, {"piece_rows": 3, "partition_rows": 5}])
def test_repair_against_plain_search(spark, sizes):
    rows = chats()
    assert ask(spark, rows, **sizes) == expected(damaged(rows), {r[0] for r in rows})


def test_repair_of_one_hot_conversation(spark):
    rnd = random.Random(2)
    rows = [(7, rnd.choice([i, i, None, 3]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["Same.", f"t{i}", f"t{i}.", f"{i % 5}" + "x" * 9000])) for i in range(700)] + [(1, 1, "user", "Hi.")] * 5
    got = ask(spark, rows, piece_rows=16, partition_rows=60)
    assert got == expected(damaged(rows), {7, 1}) and got == ask(spark, rows, parts=1)


def test_repair_edges(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = ask(spark, [(gone, 0, "user", "Lost.")])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(conversations.damage(spark.createDataFrame([], CHAT))).count() == 0


def test_heuristic_is_consistent_and_pieces_compose():
    for n in range(5):
        for line in map("".join, product("SUADux", repeat=n)):
            h = conversations.least_charges(line)
            for i, state in product(range(n + 1), range(4)):
                assert all(h[i] <= cost + h[j] for cost, _, j, _ in conversations.moves(line, i, state))
            cost, path = conversations.compose([[conversations.search(c, e, False) for e in range(4)] for c in line]) if line else (0, [])
            assert min(conversations.search(line).values()) == (cost, "".join(a for _, a in path))


# Search ------------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    have = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out, asked = [], defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    for i, want in asked.items():
        scores = []
        for d, c in have:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


WORDS = [f"w{i}" for i in range(60)] + ["the"] * 60 + ["Of"] * 30 + ["straße", "日本"]


def corpus(seed=4, n=400):
    rnd = random.Random(seed)
    docs = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 80)))) for i in range(n)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (5, docs[3][1]), (9000, None), (9001, "  ,.;"), (9002, "the " * 30_000 + "w1"), (9003, "THE-w2_w3")]
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 25)))) for i in range(30)] + [(None, "w1 w2"), (77, None), (78, ""), (79, "nowhere"), (80, "the"), (81, "w1"), (81, "w2 w2")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"seed_rows": 3, "broadcast_rows": 0}, {"seed_rows": 10_000, "broadcast_rows": 0}])
def test_search_against_brute_force(spark, limits):
    docs, items = corpus()
    table = spark.createDataFrame([(d, t, 1, 1, 1) for d, t in docs], "doc_id bigint, text string, uid int, term int, n int").repartition(4)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, word int")
    got = lexical.search(table, asked, **limits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)


def test_search_with_few_documents_and_none(spark):
    docs, items = [(1, "a b"), (2, "a"), (3, "c")], [(1, "a b"), (2, "b c d")]
    table, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, lexical.search(table, asked).collect()), key=str) == brute_search(docs, items)
    assert lexical.search(table.limit(0), asked).count() == 0 and lexical.search(table, asked.limit(0)).count() == 0


# Mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        each = (budget - sum(got.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > 2 * sizes[s]}
        got |= {s: 2.0 * sizes[s] for s in over} if over else {s: each * w[s] for s in open_}
        open_ -= over or open_
    return got


def library(seed=8, n=3000):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", "d", "é", None]), " ".join(["w"] * rnd.choice([1, 5, 40, 200]))) for i in range(n)]
    return rows + [(n, "long", "w " * 20_000), (n + 1, "long", "w"), (n + 2, "zero", None), (None, "b", "x y"), (None, "b", "x y"), *[(5, "e", "same text here")] * 400]


DOCS = "doc_id bigint, source string, text string, size int, target int, src int, key int, salt int"


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}])
def test_mix(spark, limits):
    rows = library()
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], DOCS)
    got = mixing.mix(df.repartition(5), **limits).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").split())) for d, _, t in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    of = {d: s for d, s, _ in rows}
    for source, target in want.items():
        mine = [r for r in got if of[r.doc_id] == source or (r.doc_id is None and source == "b")]
        mine = [r for r in mine if r.source_size == sizes[source]]
        assert all(math.isclose(r.target, target, rel_tol=1e-12) for r in mine)
        near = 10_001 if source == "long" else 101
        assert abs(sum(r.taken for r in mine) - target) <= near
    key = lambda rs: Counter((r.doc_id, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(2)).collect()) != key(mixing.mix(df, seed=1).collect())


def test_mix_includes_by_odds(spark):
    """Documents of a size enter as often as its inclusion probability, min(1, scale · size), says."""
    rows = [(i, "abc"[i % 3], " ".join(["w"] * (1 + i // 3 % 30))) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    mine = [r for r in got if r.doc_id % 3 == 2]
    assert {r.taken // r.size for r in mine} == {1, 2}
    rest = mine[0].target - mine[0].source_size
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * r.size) * r.size for r in mine) < rest else (low, mid)
    for sizes in (range(1, 8), range(8, 16), range(16, 24)):
        of = [r for r in mine if r.size in sizes]
        p = [min(1, low * r.size) for r in of]
        assert abs(sum(r.taken > r.size for r in of) - sum(p)) < 5 * math.sqrt(sum(x * (1 - x) for x in p)) + 5
    assert all(r.taken == 2 * r.size for r in mine if low * r.size > 1.01)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix(df).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "x", " ")], df.schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_running_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(1000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v bigint, s bigint").repartition(3)
    got = mixing.running(df, ["g"], ["v", "s"], {"t": "v"}, rows_per_partition=100).collect()
    want, sums = {}, Counter()
    for g, v, s in sorted(rows):
        sums[g] += v
        want[s] = sums[g]
    assert {r.s: int(r.t) for r in got} == want
    assert mixing.running(df.where(F.lit(False)), [], ["v"], {"t": "v"}).count() == 0


def test_members_behind_a_member_are_not_copied_with_it(monkeypatch):
    from trailmill.llm import warc

    make, left = warc.zlib.decompressobj, []

    class Counted:
        def __init__(self, bits):
            self.d = make(bits)
            self.decompress = self.d.decompress

        eof = property(lambda self: self.d.eof)

        @property
        def unused_data(self):
            left.append(len(self.d.unused_data))
            return self.d.unused_data

    bodies = [bytes([i % 251]) * (i * 37) for i in range(300)] + [random.Random(1).randbytes(50_000)]
    members = [warc.gzip_member(b) for b in bodies]
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert list(warc.gunzip(b"".join(members))) == list(zip(starts, bodies))
    assert max(left) <= 8192
    *_, (at, cut) = warc.gunzip(b"".join(members)[:-10])
    assert at == starts[-1] and bodies[-1].startswith(cut)
