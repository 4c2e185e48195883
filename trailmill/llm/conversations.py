"""Conversation structure repair: the cheapest edits that make a conversation alternate, by A* on the edit lattice.

A lattice node is (rows consumed, what the output ends with). Keep, rerole and delete consume a row, insert does not. The
heuristic is the suffix sum of what no path escapes: the deletion of every blank or repeated row, and one for every
truncated row, which is charged when it stays and costs more when it goes. It is consistent, so the first time that a node
leaves the queue, keyed (cost plus heuristic, audit), both its cost and its audit are final: equal cost over equal rows
means equally many letters per row, so no audit is a proper prefix of another, and the least prefix gives the least whole.

For the same reason pieces of a conversation compose: the best (cost, audit) between each two output states of a piece, put
in sequence, give the best of the whole. So a conversation of any length is split: rows go to range partitions by
(conversation, turn, role, text), so that a conversation with a third of all rows fills many of them. What lies inside one
partition is solved there, row group by row group. The first and the last conversation of each partition may go on in its
neighbours: their rows are written, first occurrences found by an aggregation, pieces of ``piece_rows`` rows solved on their
own, composed, and rendered piece by piece into a running hash. One task holds some 20 bytes a row of such a conversation
(its audit is one cell of the result), and one streams its text, as a hash has to; no task holds its rows.

Defined cases: nulls count as one space, except that null turns come first, have no part in gaps, and that rows of a null
conversation are one conversation. Rows of equal turn come by role, then text (64 characters of each, then their hash); equal
rows are interchangeable. A role without characters has no initial, so it is never kept. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: What the output ends with: nothing, a system row, a user row, an assistant row. NEXT holds where a role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
ROLES = {"u": "user", "a": "assistant"}
COMPLETE = (START, ASSISTANT)
SPACE = " \t\n\x0b\x0c\r"
SIZES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault(text: str, seen_before: bool) -> str:
    """The first fault of a row."""
    words = text.strip(SPACE)
    if not words:
        return "blank"
    if seen_before:
        return "duplicate"
    return "" if words[-1] in ".!?" else "truncated"


def letter(role: str, what: str) -> str:
    """A row as the lattice sees it: D must go; else the initial (x: none that can stay), in capitals if nothing is charged."""
    if what in ("blank", "duplicate"):
        return "D"
    initial = role[:1] if role[:1] in NEXT and role else "x"
    return initial if what == "truncated" else initial.upper()


def least_charges(rows: str) -> list[int]:
    """Suffix sums of mandatory deletions and of unavoidable charges for truncated rows."""
    out = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = out[i + 1] + (3 if rows[i] == "D" else 1 if rows[i].islower() else 0)
    return out


def moves(rows: str, i: int, state: int):
    """(cost, audit letter, rows consumed, state) of each edit at a node."""
    role = "a" if state == USER else "u"
    there = NEXT[role][state]
    yield 2, "I", i, there
    if i == len(rows):
        return
    yield 3, "D", i + 1, state
    if rows[i] == "D":
        return
    charge = 1 if rows[i].islower() else 0
    yield 2 + charge, "R", i + 1, there
    kept = NEXT.get(rows[i].lower(), (None,) * 4)[state]
    if kept is not None:
        yield charge, "K", i + 1, kept


@lru_cache(maxsize=20_000)
def search(rows: str, entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) over ``rows`` from ``entry``: to the best complete end if ``whole``, else to each state."""
    ahead = least_charges(rows)
    queue, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows) and (not whole or state in COMPLETE):
            found[state] = (f, audit)
            if whole or len(found) == 4:
                break
        for cost, sign, j, there in moves(rows, i, state):
            if (j, there) not in closed:
                heapq.heappush(queue, (f - ahead[i] + cost + ahead[j], audit + sign, j, there))
    return found


def compose(pieces: list[list[dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and (entry, audit) of each piece, of the best way through ``pieces``: per entry, its ends with cost and audit."""
    best, steps = {START: (0, "")}, []
    for table in pieces:
        ways: dict[int, tuple[int, str, int, str]] = {}
        for entry, (cost, so_far) in best.items():
            for end, (more, audit) in table[entry].items():
                way = (cost + more, so_far + audit, entry, audit)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        # what all best ways begin with is settled and no longer compared
        shared = len(commonprefix([w[1] for w in ways.values()]))
        best = {end: (cost, so_far[shared:]) for end, (cost, so_far, _, _) in ways.items()}
        steps.append({end: (entry, audit) for end, (_, _, entry, audit) in ways.items()})
    state = min((s for s in COMPLETE if s in best), key=best.__getitem__)
    cost, path = best[state][0], []
    for step in reversed(steps):
        path.append(step[state])
        state = path[-1][0]
    return cost, path[::-1]


def render(rows: list[tuple[str, str]], entry: int, audit: str) -> list[str]:
    """The repaired rows, ``role:text`` each."""
    out, state, at = [], entry, iter(rows)
    for sign in audit:
        role, text = ("", "") if sign == "I" else next(at)
        if sign == "D":
            continue
        if sign != "K":
            initial = "a" if state == USER else "u"
            role = ROLES[initial]
        out.append(f"{role}:{text}")
        state = NEXT[role[:1]][state]
    return out


class Tally:
    """Counts of faults and of adjacent initials, over rows in order."""

    def __init__(self):
        self.first = self.last = None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = 0

    def add(self, role: str, what: str) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.counts[what] += 1


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by crc32 of ``conv_id:turn``, modulo 20: 0 drops the row, 1 empties its text, 2 takes its ends of
    sentences, 3 repeats it, 4 makes it the user's. Dropped rows stay as rows without ``there``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(code == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), code.alias("code"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("code") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def _groups(batches, n_keys: int):
    """(key values, rows) of neighbouring rows whose first ``n_keys`` columns are equal, rows as an iterator."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:n_keys])


def _write(names: list[str], types: list, rows, most_rows: int = 2_000, most_chars: int = 4 << 20):
    """Record batches of tuples, closed by rows or characters."""
    schema, held, chars = pa.schema(list(zip(names, types))), [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most_rows or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)


def repair(rows: DataFrame, piece_rows: int = 256, partition_rows: int = 50_000) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, there): its faults, the cost and audit of its cheapest
    edits, and the SHA-256 of the repaired rows. ``piece_rows`` and ``partition_rows`` size the work, not the result."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    conv, sql = to_arrow_type(kind), kind.simpleString()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // partition_rows))
    keyed = rows.select(
        "conv_id", "turn", "role", "text", "there",
        F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"), F.xxhash64("role", "text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "r", "t", "h", "salt"]
    lined = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "there")
    names = ["conv_id", *SIZES, "audit", "repaired_sha256", "part", "side", "seq", "turn", "role", "text", "there"]
    types = [conv, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema = f"conv_id {sql}, " + ", ".join(f"{c} bigint" for c in SIZES) + ", audit string, repaired_sha256 string, part bigint, side int, seq bigint, turn bigint, role string, text string, there boolean"
    none = (None,) * 8

    def inside(batches):
        """Whole conversations solved, the rows of the first and last as they are."""
        part, seq = TaskContext.get().partitionId(), 0

        def found():
            nonlocal seq
            held = None
            for k, ((key,), group) in enumerate(_groups(batches, 1)):
                if held is not None:
                    yield (held[0], *_solve(held[1], piece_rows), *(None,) * 7)
                    held = None
                if k == 0:
                    for r in group:
                        yield (key, *none, part, 0, seq, *r[1:])
                        seq += 1
                else:
                    held = (key, list(group))
            if held is not None:
                for r in held[1]:
                    yield (held[0], *none, part, 1, seq, *r[1:])
                    seq += 1

        yield from _write(names, types, found())

    both = materialize(lined.mapInArrow(inside, schema), "conversations")
    done = both.where("part IS NULL").select(*names[:9])
    return done.unionByName(_across(both.where("part IS NOT NULL").select("conv_id", *names[9:]), conv, sql, piece_rows))


def _solve(rows: list[tuple], piece_rows: int) -> tuple:
    """Sizes, audit and hash of one conversation in memory."""
    rows = [r for r in rows if r[4]]
    turns = {r[1] for r in rows if r[1] is not None}
    tally, seen, signs = Tally(), set(), []
    for _, _, role, text, _ in rows:
        what = fault(text, (role, text) in seen)
        seen.add((role, text))
        tally.add(role, what)
        signs.append(letter(role, what))
    line = "".join(signs)
    cuts = range(0, len(line), piece_rows)
    if len(line) <= piece_rows:
        cost, audit = min(search(line).values())
        path = [(START, audit)]
    else:
        cost, path = compose([[search(line[i : i + piece_rows], e, False) for e in range(4)] for i in cuts])
    sha, lines = hashlib.sha256(), 0
    for i, (entry, audit) in zip(cuts, path):
        got = render([(r[2], r[3]) for r in rows[i : i + piece_rows]], entry, audit)
        sha.update((("\n" if lines and got else "") + "\n".join(got)).encode("utf-8", "surrogatepass"))
        lines += len(got)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    c = tally.counts
    return gaps, c["blank"], c["duplicate"], c["truncated"], tally.illegal, cost, "".join(a for _, a in path), sha.hexdigest()


def _across(rows: DataFrame, conv, sql: str, piece_rows: int) -> DataFrame:
    """Conversations that may lie in several partitions. (part, seq) names a row and orders it, (part, side, piece) a piece."""
    there = rows.where("there")
    key = F.struct(F.xxhash64("role", "text"), F.crc32(F.concat_ws("\u0000", "role", "text")), F.length("text"))
    first = there.groupBy("conv_id", key.alias("key")).agg(F.min(F.struct("part", "seq")).alias("at")).select("at.part", "at.seq", F.lit(True).alias("first"))
    known = rows.join(first, ["part", "seq"], "left").select("part", "side", F.floor(F.col("seq") / piece_rows).cast("bigint").alias("piece"), "seq", "conv_id", "role", "text", "there", F.coalesce("first", F.lit(False)).alias("first"))
    known = materialize(known, "conversation-pieces")
    pieces = known.repartition("part", "side", "piece").sortWithinPartitions("part", "side", "piece", "seq")

    names = ["part", "side", "piece", "conv_id", "rows", "head", "tail", "blank", "duplicate", "truncated", "illegal", "line", "ways"]
    types = [pa.int64(), pa.int32(), pa.int64(), conv, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.list_(pa.string()))]
    schema = f"part bigint, side int, piece bigint, conv_id {sql}, rows bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, line string, ways array<array<string>>"

    def solve(batches):
        def found():
            for (part, side, piece), group in _groups(batches, 3):
                tally, signs, conv_id = Tally(), [], None
                for _, _, _, _, conv_id, role, text, there, new in group:
                    if there:
                        what = fault(text, not new)
                        tally.add(role, what)
                        signs.append(letter(role, what))
                line, c = "".join(signs), tally.counts
                ways = [[f"{end}:{cost}:{audit}" for end, (cost, audit) in search(line, e, False).items()] for e in range(4)]
                yield part, side, piece, conv_id, len(line), tally.first, tally.last, c["blank"], c["duplicate"], c["truncated"], tally.illegal, line, ways

        yield from _write(names, types, found(), 200)

    solved = materialize(pieces.mapInArrow(solve, schema), "conversation-ways")

    def join_up(batches):
        """Per conversation a row with its sums, and one per piece with the way through it."""

        def found():
            for (conv_id,), group in _groups(batches, 1):
                sums, tail, tables, at = [0, 0, 0, 0], None, [], []
                for _, part, side, piece, head, last, blank, duplicate, truncated, illegal, ways in group:
                    sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal))]
                    if head is not None:
                        sums[3] += tail is not None and tail + head not in ("su", "ua", "au")
                        tail = last
                    at.append((part, side, piece))
                    tables.append([{int(e): (int(cost), audit) for e, cost, audit in (w.split(":") for w in ends)} for ends in ways])
                cost, path = compose(tables)
                yield (conv_id, None, None, None, None, "".join(a for _, a in path), *sums, cost)
                for where, (entry, audit) in zip(at, path):
                    yield (conv_id, *where, entry, audit, None, None, None, None, None)

        yield from _write(
            ["conv_id", "part", "side", "piece", "entry", "audit", "blank", "duplicate", "truncated", "illegal", "cost"],
            [conv, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5], found(), 200,
        )

    told = solved.select("conv_id", "part", "side", "piece", "head", "tail", "blank", "duplicate", "truncated", "illegal", "ways")
    told = told.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(join_up, f"conv_id {sql}, part bigint, side int, piece bigint, entry int, audit string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")
    told = materialize(told, "conversation-paths")

    def write_out(batches):
        """The text of each piece after its edits."""

        def found():
            for (part, _, piece), group in _groups(batches, 3):
                group = list(group)
                got = render([(r[5], r[6]) for r in group if r[7]], group[0][8], group[0][9])
                yield group[0][4], part, piece, len(got), "\n".join(got)

        yield from _write(["conv_id", "part", "piece", "lines", "text"], [conv, pa.int64(), pa.int64(), pa.int64(), pa.string()], found(), 100)

    ways = told.where("part IS NOT NULL").select("part", "side", "piece", "entry", "audit")
    shown = known.join(ways, ["part", "side", "piece"]).select("part", "side", "piece", "seq", "conv_id", "role", "text", "there", "entry", "audit")
    shown = shown.repartition("part", "side", "piece").sortWithinPartitions("part", "side", "piece", "seq").mapInArrow(write_out, f"conv_id {sql}, part bigint, piece bigint, lines bigint, text string")

    def hashes(batches):
        def found():
            for (conv_id,), group in _groups(batches, 1):
                sha, lines = hashlib.sha256(), 0
                for _, _, _, more, text in group:
                    sha.update((("\n" if lines and more else "") + text).encode("utf-8", "surrogatepass"))
                    lines += more
                yield conv_id, sha.hexdigest()

        yield from _write(["conv_id", "repaired_sha256"], [conv, pa.string()], found())

    hashed = shown.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(hashes, f"conv_id {sql}, repaired_sha256 string")
    turns = there.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    told = told.where("part IS NULL")
    out = told.join(hashed, same(told, hashed)).join(turns, same(told, turns), "left")
    return out.select(told["conv_id"], F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of damaged conversations."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
