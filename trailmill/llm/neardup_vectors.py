"""Embedding near-dedup by NN-descent.

(1) Equal vectors of a label become one class. (2) A first neighbour graph comes from ``tables`` sorts by random
hyperplane codes: consecutive blocks of a sort are compared inside. (3) NN-descent: each vector's neighbours and
reverse neighbours meet at it and are compared with each other; lists keep the best ``k``. Lists that are full of
links (saturated) are enlarged, up to ``k_max``. Rounds end when few lists change. (4) Edges at the threshold, checked
in double precision, give components; one vector per component goes through the graph once more, so that parts of a
dense group meet cheaply; then each component that holds a saturated list is compared exactly with all other vectors of
its label, so that no link that a full list had no room for is lost. (5) Recall is audited in every turn: ``audit`` vectors of least hash are compared
with all rows, and the share of their links that the graph found without them is averaged over the vectors. Below
``recall``, a turn with other hyperplanes follows; after ``tries`` turns all vectors of a label are compared, exactly.
Missed links of the audited vectors are added. The number of sorts grows with the largest label. (6) Links
are counted inside components, block against block: an exact count for every vector whatever its lists could hold.

A component of m vectors costs m * m multiplications in (6), spread over pairs of blocks; two blocks whose centres and
radii prove that all their pairs link are counted without comparing. No pair table is made there. In (4), the vectors of a label are compared with the centres
of the blocks (of up to 256 members) of its dense components, and with the members of the blocks whose radius reaches them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
or id, link with nothing and are their own component; vectors of different lengths don't link; equal rows (ids too)
are copies of each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, grouped, materialize

_MARGIN = 0.01  # of the graph's half-precision cosines


def _units(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, raw, unit): vectors that can link; raw are the given numbers, unit the doubles of length 1."""

    def run(batches):
        for b in batches:
            keep, raw, unit, dim = [], [], [], []
            for i, v in enumerate(b.column(2)):
                x = v.as_py()
                if x is None or not x or any(e is None for e in x):
                    continue
                a = np.array(x, dtype=np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(a).max()
                    n = np.linalg.norm(a / top) if np.isfinite(top) and top > 0 else 0.0
                if not np.isfinite(n) or n == 0 or not np.isfinite(a).all():
                    continue
                keep.append(i)
                raw.append(a.tobytes())
                unit.append((a / top / n).tobytes())
                dim.append(len(a))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dim, pa.int32()), pa.array(raw, pa.binary()), pa.array(unit, pa.binary())], names=["id", "label", "dim", "raw", "unit"])

    src = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return src.mapInArrow(run, "id bigint, label string, dim int, raw binary, unit binary")


def _mat(col, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), dtype=dtype).reshape(len(col), -1)


def _lists(ids: np.ndarray, sims: np.ndarray, k: int):
    """For each row of a square similarity matrix, its best k others."""
    n = len(ids)
    s = sims.copy()
    np.fill_diagonal(s, -9)
    k = min(k, n - 1)
    if k <= 0:
        return [], []
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return ids[top], np.take_along_axis(s, top, axis=1)


_EDGE = "u bigint, v bigint, s float"


def _first_graph(nodes: DataFrame, k: int, tables: int, seed: int, block: int = 128) -> DataFrame:
    """(u, v, s) from ``tables`` sorts; ``nodes`` has (rid, g, half)."""

    def code(batches):
        planes: dict = {}
        for b in batches:
            ids, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            out = [[], [], [], [], []]
            halves = b.column(2)
            lens = np.array([len(x) for x in (y.as_py() for y in halves)])
            for size in np.unique(lens):
                at = np.flatnonzero(lens == size)
                x = _mat(halves.take(pa.array(at)), np.float16).astype(np.float32)
                for t in range(tables):
                    if (size, t) not in planes:
                        planes[size, t] = np.random.default_rng([seed, t, int(size)]).standard_normal((x.shape[1], 31)).astype(np.float32)
                    bits = (x @ planes[size, t]) > 0
                    out[0].append(np.full(len(at), t, np.int32))
                    out[1].append(g[at])
                    out[2].append(bits @ (1 << np.arange(30, -1, -1, dtype=np.int64)))
                    out[3].append(ids[at])
                    out[4] += [halves[int(i)].as_py() for i in at]
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())], names=["t", "g", "code", "rid", "half"])

    def blocks(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if held.num_rows < 20 * block:
                continue
            yield from cut(held)
            held = None
        if held is not None:
            yield from cut(held)

    def cut(b):
        t, g, ids = (b.column(i).to_numpy() for i in (0, 1, 3))
        edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(g) != 0)) + 1
        us, vs, ss = [], [], []
        for a, z in zip([0, *edge], [*edge, len(ids)]):
            for lo in range(a, z, block):
                lo = max(a, min(lo, z - block))  # the last block overlaps rather than being small
                hi = min(z, lo + block)
                x = _mat(b.column(4).slice(lo, hi - lo), np.float16).astype(np.float32)
                v, s = _lists(ids[lo:hi], x @ x.T, k)
                if len(v):
                    us.append(np.repeat(ids[lo:hi], v.shape[1]))
                    vs.append(v.ravel())
                    ss.append(s.ravel())
        if us:
            yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    coded = nodes.select("rid", "g", "half").mapInArrow(code, "t int, g bigint, code bigint, rid bigint, half binary")
    tie = F.xxhash64("rid")
    return coded.repartitionByRange("t", "g", "code", tie).sortWithinPartitions("t", "g", "code", tie).mapInArrow(blocks, _EDGE)


def _edges(u, v, s):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.float32), pa.float32())], names=["u", "v", "s"])


def _best(edges: DataFrame, k: int, k_max: int, link: float) -> DataFrame:
    """Each u's best k distinct neighbours; a list whose k-th is still a link is let grow to ``k_max``."""

    def run(batches):
        for b, starts, ends in grouped(batches):
            u, v, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((-s, v, u))
            u, v, s = u[order], v[order], s[order]
            one = np.ones(len(u), dtype=bool)
            one[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v, s = u[one], v[one], s[one]
            order = np.lexsort((v, -s, u))
            u, v, s = u[order], v[order], s[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1])
            rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
            keep = (rank < k) | ((rank < k_max) & (s >= link))
            yield _edges(u[keep], v[keep], s[keep])

    return edges.repartition("u").sortWithinPartitions("u").mapInArrow(run, _EDGE)


def _descend(nodes: DataFrame, graph: DataFrame, k: int, reverse: int) -> DataFrame:
    """Candidates from one round: neighbours and some reverse neighbours of each vector, compared at it."""
    back = graph.select(F.col("v").alias("c"), F.col("u").alias("m"))
    w = Window.partitionBy("c").orderBy(F.xxhash64("m", "c"))
    back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reverse).select("c", "m")
    meet = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).union(back).distinct()
    own = graph.select(F.col("u").alias("c"), F.col("u").alias("m")).distinct()
    sent = meet.union(own).join(nodes.select(F.col("rid").alias("m"), "half"), "m").select("c", "m", "half")

    def run(batches):
        for b, starts, ends in grouped(batches):
            ids, halves = b.column(1).to_numpy(), b.column(2)
            us, vs, ss = [], [], []
            for a, z in zip(starts, ends):
                x = _mat(halves.slice(a, z - a), np.float16).astype(np.float32)
                v, s = _lists(ids[a:z], x @ x.T, k)
                if len(v):
                    us.append(np.repeat(ids[a:z], v.shape[1]))
                    vs.append(v.ravel())
                    ss.append(s.ravel())
            if us:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    return sent.repartition("c").sortWithinPartitions("c").mapInArrow(run, _EDGE)


def neighbour_graph(nodes: DataFrame, threshold: float, k: int, k_max: int, tables: int, rounds: int, seed: int) -> DataFrame:
    """(u, v, s): the refined lists of all ``nodes`` (rid, g, half)."""
    link = threshold - _MARGIN
    graph = materialize(_best(_first_graph(nodes, k, tables, seed), k, k_max, link), "graph")
    for _ in range(rounds):
        more = _descend(nodes, graph, k, k)
        nxt = materialize(_best(graph.union(more), k, k_max, link), "graph")
        changed = nxt.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        total = nxt.count()
        graph = nxt
        if changed <= 0.02 * total:
            break
    return graph


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among ``pairs``, those whose cosine in doubles is at least the threshold. Of a batch's links only a
    spanning forest is kept: components need no more, and the links are counted elsewhere."""
    x = nodes.select(F.col("rid").alias("a"), F.col("unit").alias("x"))
    y = nodes.select(F.col("rid").alias("b"), F.col("unit").alias("y"))
    both = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            lens = np.array([len(x.as_py()) for x in b.column(2)])
            for size in np.unique(lens):
                part = b.filter(pa.array(lens == size))
                s = np.einsum("ij,ij->i", _mat(part.column(2), np.float64), _mat(part.column(3), np.float64))
                hit = part.select([0, 1]).filter(pa.array(s >= threshold))
                yield hit.filter(pa.array(_forest(hit.column(0).to_pylist(), hit.column(1).to_pylist()), pa.bool_()))

    sized = both.where(F.octet_length("x") == F.octet_length("y"))
    return sized.mapInArrow(run, "a bigint, b bigint")


def _forest(a: list[int], b: list[int]) -> list[bool]:
    """Which of the edges join what the edges before them didn't."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    out = []
    for x, y in zip(map(find, a), b):
        x, y = find(x), find(y)
        out.append(x != y)
        parent[x] = y
    return out


def _audit(nodes: DataFrame, threshold: float, audit: int) -> DataFrame:
    """(u, v): all links of ``audit`` vectors, each compared with all rows, in blocks."""
    chosen = nodes.orderBy(F.xxhash64(F.lit(11), "rid"), "rid").limit(audit).select("rid", "g", "unit").collect()
    by: dict[tuple[int, int], tuple[list, list]] = {}
    for r in chosen:
        ids, vecs = by.setdefault((r.g, len(r.unit)), ([], []))
        ids.append(r.rid)
        vecs.append(np.frombuffer(r.unit))
    sets = nodes.sparkSession.sparkContext.broadcast({k: (np.array(a), np.stack(b)) for k, (a, b) in by.items()})

    def run(batches):
        for b in batches:
            ids, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            lens = np.array([len(x.as_py()) for x in b.column(2)])
            for (key, size), (qids, q) in sets.value.items():
                at = np.flatnonzero((g == key) & (lens == size))
                if len(at):
                    s = q @ _mat(b.column(2).take(pa.array(at)), np.float64).T
                    i, j = np.nonzero(s >= threshold)
                    u, v = qids[i], ids[at[j]]
                    yield _edges(u[u != v], v[u != v], s[i, j][u != v])

    return nodes.select("rid", "g", "unit").mapInArrow(run, _EDGE).select("u", "v")


def _blocks(members: DataFrame, block: int = 256) -> DataFrame:
    """(bid, rid, g, comp, unit, centre, radius, bcomp) of members (rid, g, comp, unit): blocks of one component of near
    directions. ``centre``, ``radius`` and ``bcomp`` stand on one row of a block; ``bcomp`` is its component, or null in
    blocks of single vectors."""

    def run(batches):
        planes: dict = {}
        for b in batches:
            out = []
            for x in b.column(3):
                v = np.frombuffer(x.as_py())
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([5, len(v)]).standard_normal((len(v), 31))
                out.append(int((v @ planes[len(v)] > 0) @ (1 << np.arange(30, -1, -1, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "code"])

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, g, of = (b.column(i).to_numpy() for i in (0, 1, 4))
            single = b.column(5).to_numpy(zero_copy_only=False)
            lens = np.array([len(x.as_py()) for x in b.column(3)])
            edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(of) != 0) | (np.diff(lens) != 0) | (single[1:] != single[:-1])) + 1
            bid, centre, radius, bcomp = np.empty(len(ids), np.int64), [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for a, z in zip([0, *edge], [*edge, len(ids)]):
                for lo in range(a, z, block):
                    hi = min(z, lo + block)
                    x = _mat(b.column(3).slice(lo, hi - lo), np.float64)
                    c = x.mean(axis=0)
                    c /= max(np.linalg.norm(c), 1e-300)
                    bid[lo:hi] = ids[lo]
                    centre[lo], radius[lo] = c.tobytes(), float(np.arccos(np.clip((x @ c).min(), -1, 1)))
                    bcomp[lo] = None if single[lo] else int(of[lo])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bid), *(b.column(i) for i in range(4)), pa.array(centre, pa.binary()), pa.array(radius, pa.float64()), pa.array(bcomp, pa.int64())],
                names=["bid", "rid", "g", "comp", "unit", "centre", "radius", "bcomp"],
            )

    single = F.col("single")
    coded = members.select("rid", "g", "comp", "unit", F.when(single, F.lit(0)).otherwise(F.col("comp")).cast("bigint").alias("of"), single)
    coded = coded.mapInArrow(run, "rid bigint, g bigint, comp bigint, unit binary, of bigint, single boolean, code bigint")
    order = ["g", "single", "of", F.octet_length("unit"), "code", "rid"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, "bid bigint, rid bigint, g bigint, comp bigint, unit binary, centre binary, radius double, bcomp bigint")


def _across(nodes: DataFrame, comps: DataFrame, dense: DataFrame | None, threshold: float, slice_bytes: int = 32 << 20, part: int = 2048) -> DataFrame:
    """Links (a, b), exact, between different components: of each component in ``dense`` (comp), or of all vectors if it
    is None, with all vectors of the label; one link for each vector and component at least. Components go as blocks; a
    vector is compared with a block's members unless the block's centre and radius prove that it links with none."""
    own = nodes.join(comps.select(F.col("node").alias("rid"), "component"), "rid", "left")
    own = own.select("rid", "g", "unit", F.coalesce("component", "rid").alias("comp"), F.col("component").isNull().alias("single"))
    if dense is None:
        own = own.withColumn("dense", F.lit(True))
    else:
        own = own.join(dense.select("comp", F.lit(True).alias("dense")), "comp", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    own = materialize(own.select("rid", "g", "comp", "unit", "dense", "single"), "own")
    blocks = materialize(_blocks(own.where("dense")), "blocks")
    centres = blocks.where("centre is not null").select("bid", "g", "bcomp", "centre", "radius")
    size = centres.agg(F.sum(F.octet_length("centre") + 32)).first()[0] or 0
    slices = -(-size // slice_bytes)
    limit = float(np.arccos(threshold))
    found = None
    for i in range(slices):
        by: dict[tuple[int, int], list] = {}
        for r in centres.where(F.pmod(F.xxhash64("bid"), F.lit(slices)) == i).toLocalIterator():
            by.setdefault((r.g, len(r.centre)), []).append((r.bid, -1 if r.bcomp is None else r.bcomp, r.bcomp is None, r.radius, np.frombuffer(r.centre).astype(np.float32)))
        table = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]), np.array([x[3] for x in v], np.float32), np.stack([x[4] for x in v])) for k, v in by.items()}
        sent = nodes.sparkSession.sparkContext.broadcast(table)

        def run(batches, sent=sent):
            for b in batches:
                ids, g, comp = (b.column(c).to_numpy() for c in range(3))
                dense_row = b.column(4).to_numpy(zero_copy_only=False)
                lens = np.array([len(x.as_py()) for x in b.column(3)])
                for (key, width), (bids, bcomp, mixed, radius, c) in sent.value.items():
                    at = np.flatnonzero((g == key) & (lens == width))
                    step = max(1, (1 << 22) // len(bids))
                    for lo in range(0, len(at), step):
                        rows = at[lo : lo + step]
                        x = _mat(b.column(3).take(pa.array(rows)), np.float64).astype(np.float32)
                        near = np.arccos(np.clip(x @ c.T, -1, 1)) <= radius + np.float32(limit + 2e-3)
                        # two dense components meet once, a component never meets itself
                        mine = comp[rows][:, None]
                        near &= mixed | np.where(dense_row[rows][:, None], mine > bcomp, mine != bcomp)
                        r, q = np.nonzero(near)
                        if len(r):
                            yield pa.RecordBatch.from_arrays([pa.array(bids[q]), pa.array(ids[rows[r]])], names=["bid", "rid"])

        # single vectors have no component to be kept from meeting; their blocks meet all
        rows = own.select("rid", "g", "comp", "unit", (F.col("dense") & ~F.col("single")).alias("dense"))
        meet = materialize(rows.mapInArrow(run, "bid bigint, rid bigint"), "meet")
        found = meet if found is None else found.union(meet)
    if found is None:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    parts = found.groupBy("bid").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("n"))
    key = F.xxhash64("bid", "p").alias("key")
    home = blocks.join(parts, "bid").select("bid", "rid", "comp", "unit", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    guest = found.join(parts, "bid").join(own.select("rid", "comp", "unit"), "rid").select("bid", "rid", "comp", "unit", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int").alias("p"))
    both = home.select(key, "rid", "comp", "unit", F.lit(True).alias("home")).union(guest.select(key, "rid", "comp", "unit", F.lit(False)))

    def compare(batches):
        for b, starts, ends in grouped(batches):
            ids, comp, units = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            side = b.column(4).to_numpy(zero_copy_only=False)
            for a, z in zip(starts, ends):
                p, q = a + np.flatnonzero(side[a:z]), a + np.flatnonzero(~side[a:z])
                if not len(p) or not len(q):
                    continue
                x = _mat(units.take(pa.array(p)), np.float64)
                _, of = np.unique(comp[p], return_inverse=True)
                for lo in range(0, len(q), 4096):
                    y = q[lo : lo + 4096]
                    i, j = np.nonzero((x @ _mat(units.take(pa.array(y)), np.float64).T >= threshold) & (comp[p][:, None] != comp[y]))
                    _, one = np.unique(of[i] * len(y) + j, return_index=True)
                    if len(one):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[p[i[one]]]), pa.array(ids[y[j[one]]])], names=["a", "b"])

    return both.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _recall(truth: DataFrame, comps: DataFrame) -> float | None:
    """The mean over audited vectors with links of the share of their links whose ends are in one component; None without
    any. Each vector weighs the same, so that a large group doesn't hide isolated pairs."""
    c1, c2 = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("u", "v"))
    met = truth.join(c1, "u", "left").join(c2, "v", "left").select("u", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False)).cast("int").alias("met"))
    share = met.groupBy("u").agg(F.avg("met").alias("share")).agg(F.avg("share")).first()[0]
    return share


def _other_links(nodes: DataFrame, threshold: float, k: int, tables: int, seed: int) -> DataFrame:
    """(u, v), both ways: links that sorts of their own find, as an audit where the audited vectors have none. They know
    nothing of the graph's sorts, and miss a link at the threshold as seldom as those (``_tables_for``)."""
    first = _first_graph(nodes, k, tables, seed)
    found = _exact(first.where(F.col("s") >= threshold - _MARGIN), nodes, threshold)
    return found.select(F.col("a").alias("u"), F.col("b").alias("v")).union(found.select(F.col("b"), F.col("a")))


def _tables_for(rows: int, threshold: float, recall: float, block: int = 128) -> int:
    """How many sorts bring two vectors at the threshold into one block of a label of ``rows`` at a chance of ``recall``:
    in one sort about as many leading bits must agree as it takes to part the label into blocks."""
    bits = max(0.0, np.log2(max(rows, 1) / block))
    p = (1 - np.arccos(threshold) / np.pi) ** bits
    return 1 if p >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-p)))


def _count_links(members: DataFrame, threshold: float, block: int = 256, block_max: int = 8192) -> DataFrame:
    """(rid, n): linked vectors, copies included, of each member (rid, comp, mult, unit) inside its component. A component
    is cut in eighths, within the bounds of a block: each member is sent once for every block of its component."""
    size = members.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    sized = members.join(size, "comp").withColumn("nb", F.ceil(F.col("m") / F.greatest(F.lit(block), F.least(F.lit(block_max), F.ceil(F.col("m") / 8)))).cast("int"))
    home = F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")
    # every block meets itself and, once, each other block
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("home"), o).alias("i"), F.greatest(F.col("home"), o).alias("j")))
    dealt = sized.withColumn("home", home).select("rid", "mult", "unit", "comp", "home", F.inline(pair)).withColumn("key", F.xxhash64("comp", "i", "j"))

    def run(batches):
        limit = np.arccos(threshold)
        for b, starts, ends in grouped(batches):
            out_r, out_n = [], []
            ids, mult, home, first, second = (b.column(c).to_numpy() for c in (1, 2, 4, 5, 6))
            for a, z in zip(starts, ends):
                x = _mat(b.column(3).slice(a, z - a), np.float64)
                h, m, r = home[a:z], mult[a:z], ids[a:z]
                i, j = first[a], second[a]
                p, q = np.flatnonzero(h == i), np.flatnonzero(h == j)
                n = np.zeros(z - a, dtype=np.int64)
                if len(p) and len(q):
                    ball = []
                    for at in (p, q):
                        c = x[at].mean(axis=0)
                        c /= max(np.linalg.norm(c), 1e-300)
                        ball.append((c, np.arccos(np.clip((x[at] @ c).min(), -1, 1))))
                    apart = np.arccos(np.clip(ball[0][0] @ ball[1][0], -1, 1)) + ball[0][1] + ball[1][1]
                    if apart < limit - 1e-6:  # all of them link
                        n[p] += m[q].sum()
                        if i != j:
                            n[q] += m[p].sum()
                    else:
                        for lo in range(0, len(p), 512):
                            hit = (x[p[lo : lo + 512]] @ x[q].T) >= threshold
                            if i == j:
                                hit[np.arange(hit.shape[0]), lo + np.arange(hit.shape[0])] = True
                            n[p[lo : lo + 512]] += hit @ m[q]
                            if i != j:
                                n[q] += m[p[lo : lo + 512]] @ hit
                out_r.append(r)
                out_n.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_r)), pa.array(np.concatenate(out_n))], names=["rid", "n"])

    cols = ["key", "rid", "mult", "unit", "home", "i", "j"]
    return dealt.select(*cols).repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid bigint, n bigint").groupBy("rid").agg(F.sum("n").alias("n"))


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, k: int = 10, k_max: int = 32, tables: int = 6, rounds: int = 3, audit: int = 200, recall: float = 0.99, tries: int = 3, seed: int = 1) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row per row of ``vectors``."""
    given = materialize(_units(vectors, id_col, vec_col, label_col), "units")
    # a hash of the label names its group; the count makes a collision of two labels of one length show up
    key = F.xxhash64("label", "dim")
    nodes = given.groupBy("label", "raw").agg(F.min("id").alias("rid"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))

    def halve(batches):
        for b in batches:
            half = [np.frombuffer(x.as_py()).astype(np.float16).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(half, pa.binary())], names=[*b.schema.names, "half"])

    nodes = nodes.select("rid", key.alias("g"), "mult", "unit", "raw", "label").mapInArrow(halve, "rid bigint, g bigint, mult bigint, unit binary, raw binary, label string, half binary")
    nodes = materialize(nodes, "nodes")
    truth = materialize(_audit(nodes, threshold, audit).distinct(), "audit")
    largest = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 1
    tables = max(tables, _tables_for(largest, threshold, recall))
    if not truth.limit(1).count():
        truth = materialize(_other_links(nodes, threshold, k, tables, seed + 7919).distinct(), "audit")
    links = nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    for turn in range(tries):
        graph = neighbour_graph(nodes, threshold, k, k_max, tables, rounds, seed + 101 * turn)
        found = _exact(graph.where(F.col("s") >= threshold - _MARGIN), nodes, threshold)
        links = materialize(links.union(found), "links")
        comps = materialize(connected_components(links), "components")
        # parts of dense groups: one vector per component through the graph once more
        leaders = comps.where("node = component").select(F.col("node").alias("rid"))
        few = materialize(nodes.join(leaders, "rid", "left_semi"), "leaders")
        again = neighbour_graph(few, threshold, k, k_max, tables, 1, seed + 101 * turn + 50)
        links = links.union(_exact(again.where(F.col("s") >= threshold - _MARGIN), few, threshold))
        links = materialize(links.distinct(), "links")
        comps = materialize(connected_components(links), "components")
        # lists with k links or more may have lost others: their components meet the rest of the label exactly
        full = graph.where(F.col("s") >= threshold - _MARGIN).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        dense = comps.join(full, comps.node == full.u, "left_semi").select(F.col("component").alias("comp")).distinct()
        crossing = materialize(_across(nodes, comps, dense, threshold), "crossing")
        if crossing.limit(1).count():
            links = links.union(crossing)
            comps = materialize(connected_components(links), "components")
        # none of these links is the audit's own
        share = _recall(truth, comps)
        if share is None:  # neither the audit nor other sorts saw a link that could be missed
            share = 1.0
        if share >= recall:
            break
    else:
        links = links.union(materialize(_across(nodes, comps, None, threshold), "crossing"))
        comps = materialize(connected_components(links), "components")
        share = 1.0
    if share < 1:
        links = links.union(truth.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
        comps = materialize(connected_components(links), "components")
    comp = nodes.join(comps, nodes.rid == comps.node, "inner").select("rid", F.col("component").alias("comp"), "mult", "unit")
    counts = materialize(_count_links(comp, threshold), "counts")
    per = nodes.select("rid", "mult", "raw", "label").join(comps.select(F.col("node").alias("rid"), "component"), "rid", "left").join(counts, "rid", "left")
    n = F.coalesce(F.col("n") - 1, F.col("mult") - 1)
    per = per.select("label", "raw", n.alias("n_links"), F.coalesce("component", "rid").alias("component_id"))
    linked = given.select("id", "label", "raw").join(per, ["label", "raw"]).select("id", "label", "n_links", "component_id").dropDuplicates(["id"])
    out = vectors.select(F.col(id_col).alias("id")).join(linked.drop("label"), "id", "left")
    comp = F.coalesce("component_id", F.col("id").cast("bigint"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir):
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))



SQL = """
WITH RECURSIVE n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM n),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.size > 0 AND b.size > 0
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
