"""Embedding near-dedup: dual traversal of cover trees, exact threshold pairs.

Unit vectors with cosine >= t are those at distance <= sqrt(2 - 2t). A cover tree has nested levels: the
cells of a level have half the radius of the one above, and each node keeps its covering radius, the largest
distance of a member from its centre (of an upper node: a bound on it, from its children's). Two nodes farther apart than
the sum of their covering radii and the distance threshold hold no pair and are pruned with all below them.

Equal vectors become one row with the number of their ids first, so copies of a vector cost one row however many they are.
The upper levels are fitted on a bounded sample (``SAMPLE`` vectors, smallest hashes); then *every* vector goes down to a
cell by the nearest child at each level, and covering radii are taken over all members, so pruning is exact
whatever the sample was. The upper tree is walked in pairs from its root; pairs of cells that are not pruned go on. Cells are
dealt into blocks of about ``BLOCK`` vectors by hash, and up to ``GROUP`` blocks stand together: a vector is sent
once for each group that is near its own, not once for each block. A task holds two groups, builds the lower tree of each
block once, and traverses the trees of near blocks; what is left at the leaves is compared: first by a few components,
which bound the distance from below, then in double precision. A task returns, per vector, its
number of links and one link into its local component, never the pairs.

Vectors without structure (all cells overlap) leave nothing to prune at any radius; then this is a
blocked comparison of all distinct vectors, whose cost grows with the square of their number.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do vectors of different lengths or rows of null vec_id (their component_id is null and they are not
kept). Equal rows count as one vector; different vectors of one vec_id each link, their links add up and join their
components. Lengths of at most ``BLOCK`` vectors are one block each, all in one job. Empty table: empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach_by_key, components, local_roots

COSINE = 0.95
SAMPLE = 2048
BLOCK = 4096
#: Blocks that stand together.
GROUP = 8
LEAF = 64
TILE = 1024
#: Links of tiles held before they are joined.
HELD = 1 << 21
#: Components by which vectors are compared first.
PROBE = 16


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ c.T), 0.0))


class Node:
    __slots__ = ("centre", "kids", "radius", "rows")

    def __init__(self, centre, rows, radius, kids=()):
        self.centre, self.rows, self.radius, self.kids = centre, rows, radius, kids


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node | None:
    """Cover tree over unit vectors. A cell stays a leaf when it is small, or when the next level would not
    gather its members (as many centres as half the tried ones)."""
    if not len(x):
        return None

    def grow(rows: np.ndarray, centre: np.ndarray, limit: float) -> Node:
        radius = float(_distances(x[rows], centre[None])[:, 0].max())
        if len(rows) <= leaf or radius == 0.0:
            return Node(centre, rows, radius)
        r = min(limit, radius) / 2
        tried = x[rows[: min(len(rows), 128)]]
        probe, alive = 0, np.ones(len(tried), bool)
        while alive.any():
            k = int(np.argmax(alive))
            alive &= _distances(tried, tried[k][None])[:, 0] > r
            probe += 1
        if 2 * probe > len(tried):
            return Node(centre, rows, radius)
        kids, left, at = [], rows, centre
        while len(left):
            near = _distances(x[left], at[None])[:, 0] <= r
            if near.any():
                kids.append(grow(left[near], at, r))
                left = left[~near]
            if len(left):
                at = x[left[0]]
        return Node(centre, rows, radius, kids)

    return grow(np.arange(len(x)), x[0], 2.0)


def leaves(node: Node | None) -> list[Node]:
    if node is None:
        return []
    return [node] if not node.kids else [y for k in node.kids for y in leaves(k)]


def dual_traversal(a: Node | None, b: Node | None, reach: float):
    """Pairs of leaves that may hold pairs within ``reach``."""
    todo = [(a, b)] if a is not None and b is not None else []
    while todo:
        p, q = todo.pop()
        gap = float(np.sqrt(max(0.0, 2.0 - 2.0 * float(p.centre @ q.centre))))
        if gap > p.radius + q.radius + reach + 1e-9:
            continue
        if p.kids and (not q.kids or p.radius >= q.radius):
            todo += [(k, q) for k in p.kids]
        elif q.kids:
            todo += [(p, k) for k in q.kids]
        else:
            yield p.rows, q.rows


def cells_of(x: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """(leaf number in the order of ``leaves``, distance from its centre) of every vector: down by the nearest child."""
    cell, gap = np.zeros(len(x), np.int32), np.zeros(len(x))
    number = {id(n): i for i, n in enumerate(leaves(tree))}
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if not node.kids:
            cell[rows], gap[rows] = number[id(node)], _distances(x[rows], node.centre[None])[:, 0]
            continue
        near = _distances(x[rows], np.array([k.centre for k in node.kids])).argmin(1)
        todo += [(k, rows[near == i]) for i, k in enumerate(node.kids)]
    return cell, gap


def cover(node: Node, radius: dict[int, float]) -> None:
    """Set the covering radii of a tree: those of the leaves by ``radius`` (-1: no member), of the others from their children."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    for n in reversed(order):
        if not n.kids:
            n.radius = radius[id(n)]
            continue
        held = [k for k in n.kids if k.radius >= 0]
        n.radius = max((float(np.linalg.norm(n.centre - k.centre)) + k.radius for k in held), default=-1.0)


def near_leaves(tree: Node, reach: float) -> list[tuple[int, int]]:
    """Pairs of leaves (i <= j, in the order of ``leaves``) that may hold vectors within ``reach``, by dual traversal."""
    number = {id(n): i for i, n in enumerate(leaves(tree))}
    out, todo = set(), [(tree, tree)]
    while todo:
        p, q = todo.pop()
        if p.radius < 0 or q.radius < 0 or float(np.linalg.norm(p.centre - q.centre)) > p.radius + q.radius + reach + 1e-9:
            continue
        if p is q and p.kids:
            todo += [(a, b) for i, a in enumerate(p.kids) for b in p.kids[i:]]
        elif p.kids and (not q.kids or p.radius >= q.radius):
            todo += [(k, q) for k in p.kids]
        elif q.kids:
            todo += [(p, k) for k in q.kids]
        else:
            out.add((min(number[id(p)], number[id(q)]), max(number[id(p)], number[id(q)])))
    return sorted(out)


class Probe:
    """Some components of vectors, by which most pairs are refuted: they bound the distance of two vectors from below."""

    def __init__(self, x: np.ndarray, parts: np.ndarray):
        few = x[:, parts].astype(np.float32)
        half = (few * few).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        self.left, self.right = np.hstack([few, -half, one]), np.hstack([few, one, -half])


def pairs_of(x: np.ndarray, probe: Probe | None, i0: np.ndarray, j0: np.ndarray, cosine: float):
    """(i, j) of ``i0`` x ``j0`` with cosine of at least ``cosine``."""
    if probe is None:
        i, j = np.nonzero(x[i0] @ x[j0].T >= cosine)
        return i0[i], j0[j]
    # minus half the squared distance in some components, which is at most that in all of them; 1e-5 for single precision
    i, j = np.nonzero(probe.left[i0] @ probe.right[j0].T >= cosine - 1 - 1e-5)
    i, j = i0[i], j0[j]
    if not len(i):
        return i, j
    if len(i) * 8 > len(i0) * len(j0):  # not refuted enough to look at pairs one by one
        i, j = np.nonzero(x[i0] @ x[j0].T >= cosine)
        return i0[i], j0[j]
    ok = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)])
    return i[ok], j[ok]


def block_links(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, blocks, near: list[tuple[int, int]], cosine: float):
    """(place, links, link) of the vectors that link, for the pairs ``near`` of ``blocks`` (places of their vectors).

    ``links`` adds the weights of the linked vectors, ``link`` is the id of a vector of the local component."""
    reach = float(np.sqrt(2 - 2 * cosine))
    count, stars, held = np.zeros(len(ids), np.int64), [], 0
    probe = Probe(x, np.sort(np.argsort(-x.var(0), kind="stable")[:PROBE])) if x.shape[1] >= 2 * PROBE else None
    trees: dict[int, Node | None] = {}
    for a, b in near:
        for k in (a, b):
            if k not in trees:
                trees[k] = cover_tree(x[blocks[k]])
        for ra, rb in dual_traversal(trees[a], trees[b], reach):
            for lo in range(0, len(ra), TILE):
                i0 = blocks[a][ra[lo : lo + TILE]]
                for lo_b in range(0, len(rb), TILE):
                    i, j = pairs_of(x, probe, i0, blocks[b][rb[lo_b : lo_b + TILE]], cosine)
                    other = i != j
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    # in one block the traversal meets (i, j) and (j, i); between two blocks only (i, j)
                    count += np.bincount(i, weight[j], len(ids)).astype(np.int64)
                    if a != b:
                        count += np.bincount(j, weight[i], len(ids)).astype(np.int64)
                    ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)  # a star for each component of the tile
                    stars.append((ends, ends[local_roots(at[: len(i)], at[len(i) :], len(ends))]))
                    held += len(ends)
                    if held > HELD:
                        stars = [(np.arange(len(ids)), _joined(stars, len(ids)))]
                        held = len(ids)
    hit = np.flatnonzero(count)
    return hit, count[hit], ids[_joined(stars, len(ids))[hit]] if stars else ids[hit]


def _joined(stars: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    return local_roots(np.concatenate([a for a, _ in stars]), np.concatenate([b for _, b in stars]), n)


def _units(batches):
    """(vec_id, dim, unit) of the vectors that can link."""
    for b in batches:
        out = []
        for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if vec_id is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top
            out.append((vec_id, len(x), (x / np.sqrt(x @ x)).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["vec_id", "dim", "unit"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


_LINKS = "key struct<a:long,b:long>, rep long, links long, link long"


def _found(table: pa.Table, hit: np.ndarray, count: np.ndarray, link: np.ndarray) -> pa.Table:
    at = pa.array(hit, pa.int64())
    return pa.table([table.column("key").combine_chunks().take(at), table.column("rep").take(at), pa.array(count, pa.int64()), pa.array(link, pa.int64())], ["key", "rep", "links", "link"])


def _small(cosine: float):
    """Kernel: links of all vectors of one length, as one block."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("unit"), table.column("dim")[0].as_py())
        return _found(table, *block_links(table.column("rep").to_numpy(), x, table.column("w").to_numpy(), [np.arange(len(x))], [(0, 0)], cosine))

    return run


def distinct_vectors(units: DataFrame) -> DataFrame:
    """(key, dim, unit, rep, w): every distinct vector with the smallest of its ids and their number; ``key`` is a 128-bit hash."""
    own = units.groupBy("vec_id", "key").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    return own.groupBy("key").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))


class Grid:
    """Blocks of the cells of an upper tree, the groups they stand in, and the pairs of groups to look at."""

    def __init__(self, tree: Node, members: list[int], reach: float, block: int, group: int):
        self.parts = -(-np.array(members, np.int64) // block)
        self.offset = np.concatenate([[0], np.cumsum(self.parts)])
        self.total, self.group = int(self.offset[-1]), group
        self.cells = near_leaves(tree, reach)
        near: dict[int, set] = {}
        at = lambda c: range(int(self.offset[c]) // group, (int(self.offset[c + 1]) - 1) // group + 1)
        for c, d in self.cells:
            for g in at(c):
                for h in at(d):
                    near.setdefault(g, set()).add(h)
                    near.setdefault(h, set()).add(g)
        self.near = {g: sorted(hs) for g, hs in near.items()}

    def block_of(self, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.offset[cell] + salt % np.maximum(1, self.parts[cell])

    def block_pairs(self, g: int, h: int) -> list[tuple[int, int]]:
        """Near blocks (i <= j) of the groups g <= h."""
        cell = np.searchsorted(self.offset, np.arange(self.total), side="right") - 1
        near, span = set(self.cells), lambda k: range(k * self.group, min((k + 1) * self.group, self.total))
        return [(i, j) for i in span(g) for j in span(h) if i <= j and (min(cell[i], cell[j]), max(cell[i], cell[j])) in near]


def links(rows: DataFrame, dim: int, scratch: Scratch, cosine: float = COSINE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(key, rep, links, link) rows of all pairs of groups for distinct vectors of one length; sums and components are left to do."""
    reach = float(np.sqrt(2 - 2 * cosine))
    rows = rows.where(F.col("dim") == dim).select("key", "rep", "w", "unit")
    picked = rows.orderBy(F.xxhash64("rep"), "rep", "key").limit(SAMPLE).select("unit").toArrow()
    tree = cover_tree(_matrix(picked.column(0), dim))

    def place(batches):
        for b in batches:
            if b.num_rows:
                cell, gap = cells_of(_matrix(b.column(3), dim), tree)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(gap)], ["key", "rep", "w", "unit", "cell", "gap"])

    placed = scratch.store(rows.mapInArrow(place, "key struct<a:long,b:long>, rep long, w long, unit binary, cell int, gap double"), f"placed{dim}")
    stats = {s["cell"]: s for s in placed.groupBy("cell").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("n")).collect()}  # at most SAMPLE rows
    own = leaves(tree)
    cover(tree, {id(n): stats[i]["r"] if i in stats else -1.0 for i, n in enumerate(own)})
    grid = Grid(tree, [stats[i]["n"] if i in stats else 0 for i in range(len(own))], reach, block, group)

    def deal(batches):
        for b in batches:
            mine = grid.block_of(b.column(4).to_numpy(), b.column(5).to_numpy())
            for g in np.unique(mine // grid.group).tolist():
                at = pa.array(np.flatnonzero(mine // grid.group == g))
                part = b.take(at)
                for h in grid.near.get(g, ()):
                    pair = np.full(len(at), min(g, h) * (grid.total + 1) + max(g, h), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(mine[at], pa.int64()), *part.columns[:4]], ["pair", "block", "key", "rep", "w", "unit"])

    def join(table: pa.Table) -> pa.Table:
        g, h = divmod(table.column("pair")[0].as_py(), grid.total + 1)
        block_of = table.column("block").to_numpy()
        pairs = grid.block_pairs(g, h)
        blocks = {k: np.flatnonzero(block_of == k) for k in {x for p in pairs for x in p}}
        return _found(table, *block_links(table.column("rep").to_numpy(), _matrix(table.column("unit"), dim), table.column("w").to_numpy(), blocks, pairs, cosine))

    salted = placed.select("key", "rep", "w", "unit", "cell", F.pmod("key.a", F.lit(1 << 30)).alias("salt"))
    dealt = salted.mapInArrow(deal, "pair long, block long, key struct<a:long,b:long>, rep long, w long, unit binary")
    return dealt.groupBy("pair").applyInArrow(join, _LINKS)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = ids.mapInArrow(_units, "vec_id long, dim int, unit binary")
    units = scratch.store(units.withColumn("key", F.struct(F.xxhash64("dim", "unit").alias("a"), F.xxhash64("unit", "dim", F.lit(7)).alias("b"))), "units")
    rows = scratch.store(distinct_vectors(units), "distinct")
    lengths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    many = sorted(r["dim"] for r in lengths.where(F.col("n") > block).select("dim").collect())  # at most rows / block lengths
    found = rows.where(~F.col("dim").isin(many)).groupBy("dim").applyInArrow(_small(cosine), _LINKS)
    for dim in many:
        found = found.unionByName(links(rows, dim, scratch, cosine, block, group))
    found = scratch.store(found, "links")
    # every id with its vectors; ids of several vectors join them
    members = units.select("vec_id", "key").distinct()
    members = scratch.store(attach_by_key(members, rows.select("key", "rep", "w"), "key", ["vec_id"]), "members")
    several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("vec_id", "a")
    edges = found.select(F.col("rep").alias("a"), F.col("link").alias("b")).unionByName(members.join(several, "vec_id").select("a", F.col("rep").alias("b")))
    comp = components(edges, scratch).withColumnRenamed("node", "rep")
    far = found.groupBy("key").agg(F.sum("links").alias("_far"))
    per_rep = rows.join(far, "key", "left").join(comp, "rep", "left").select("key", F.coalesce("_far", F.lit(0)).alias("_far"), F.coalesce("root", "rep").alias("root"))
    per = attach_by_key(members, per_rep, "key", ["vec_id"]).groupBy("vec_id").agg(F.sum(F.col("w") - 1 + F.col("_far")).alias("n_links"), F.min("root").alias("root"))
    out = ids.select("vec_id").join(per, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
