"""Exact top-k inner-product search by an M-tree, searched best-first.

Vectors are quantised to floor(256 * x). Inner products become distances in one more dimension: with M2
the largest squared norm, x' = (x, sqrt(M2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M2 - 2 q.x,
a metric in which the nearest is the highest score. The tree's upper two levels are routing objects drawn from
the table; a row goes down to the nearest of the first level, then of the second, and so to a slice, whose
covering radius is kept. A slice of very many rows (one vector may hold a third) is cut by id. Each slice is an
M-tree of pages that hold, for every entry, its distance to the page's routing object, and for inner entries a
covering radius and the least id below; it is built once and written.

A query visits its nearest slice first, and with the k-th best score found there only the slices whose radius
can still hold a better one: a higher score, or the same at a smaller id. Within a slice it visits pages in
order of the least distance that they could hold; | d(q, parent) - d(entry, parent) | - radius rules entries out
before any distance to them is computed. Bounds carry a small slack, scores are exact integers, and ties go to
the smaller id, so results are exact. Slices that many queries visit are searched in blocks of queries.

Defined cases: vectors that are null or hold null or non-finite components, and rows whose vec_id is null,
take no part; vectors of unequal length compare on their common components; rows that repeat an id are
separate candidates and queries, each of these with its own k ranks under the same query_id, and a query's own
row is every row of its id; fewer than k candidates give fewer ranks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

SCALE, TOP, QUERY_STEP = 256, 5, 50
#: Rows of a slice by design, and slices at most: their routing objects and radii are known to every task.
SLICE, MAX_SLICES, MAX_PARTS = 16384, 1 << 16, 4096
QUERY_BLOCK, PAGE, FANOUT, SLACK = 4096, 512, 32, 1e-6
SPREAD = 1 << 40


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(ok, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))


class Node:
    """A page. A leaf's entries are rows lo..hi of the tree; an inner page's are routing objects with children.

    least_id is the smallest id below.
    """

    __slots__ = ("lo", "hi", "parent_dist", "routes", "radius", "children", "least_id")

    def __init__(self, least_id: int, parent_dist: np.ndarray, lo: int = 0, hi: int = 0, routes=None, radius=None, children: list[Node] | None = None):
        self.least_id, self.parent_dist, self.lo, self.hi = least_id, parent_dist, lo, hi
        self.routes, self.radius, self.children = routes, radius, children


    def state(self) -> tuple:
        return (self.least_id, self.parent_dist, self.lo, self.hi, self.routes, self.radius, self.children and [c.state() for c in self.children])

    @staticmethod
    def of(state: tuple) -> Node:
        return Node(*state[:6], children=state[6] and [Node.of(c) for c in state[6]])


def best_score(base: np.ndarray | float, least: np.ndarray | float) -> np.ndarray:
    """The highest whole score that a vector no nearer than `least` can have; never too low."""
    return np.floor((base - np.square(np.maximum(least, 0.0))) / 2 + 1e-3 + 1e-14 * base)


class MTree:
    """An M-tree over integer vectors in the lifted space; the rows of a leaf lie side by side."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, m2: float):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        f = v.astype(np.float64)
        norm = np.einsum("ij,ij->i", f, f)
        self.m2 = m2
        self._x = np.hstack([f, np.sqrt(np.maximum(m2 - norm, 0.0))[:, None]])
        self._f = f
        self._ids = ids
        self.slack = slack_of(m2)
        self._laid: list[np.ndarray] = []
        self._n = 0
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None
        self.first = f[0] if len(ids) else None
        laid = np.concatenate(self._laid) if self._laid else np.zeros(0, int)
        self.ids = ids[laid]
        # Sums of products below 2**53 are exact in doubles, whose products are much the faster.
        self.rows = f[laid] if m2 < 1 << 52 else v[laid]
        self.exact = m2 < 1 << 52
        self.scored = 0  # rows of the leaves that searches looked into
        del self._x, self._f, self._laid, self._ids

    def packed(self) -> bytes:
        return pickle.dumps((self.m2, self.ids, self.rows, self.first, self.root and self.root.state()), 5)

    @staticmethod
    def unpacked(blob: bytes) -> MTree:
        tree = MTree.__new__(MTree)
        tree.m2, tree.ids, tree.rows, tree.first, root = pickle.loads(blob)
        tree.exact, tree.slack, tree.scored = tree.m2 < 1 << 52, slack_of(tree.m2), 0
        tree.root = root and Node.of(root)
        return tree

    def _dist(self, i: int, rows: np.ndarray) -> np.ndarray:
        d = self._x[rows] - self._x[i]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, centre: int) -> Node:
        """The page of these rows (in id order) below the routing object `centre`."""
        to_centre = self._dist(centre, rows)
        if len(rows) <= PAGE:
            self._laid.append(rows)
            self._n += len(rows)
            return Node(int(self._ids[rows].min()), to_centre, self._n - len(rows), self._n)
        # Routing objects: evenly spaced rows, which follow the density of the vectors, so pages fill alike.
        fan = min(FANOUT, -(-2 * len(rows) // PAGE))
        pivots, near, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), int)
        for p in rows[np.linspace(0, len(rows) - 1, fan).astype(int)].tolist():
            d = self._dist(p, rows)
            closer = d < near - SLACK
            if not pivots or closer.any():
                owner[closer] = len(pivots)
                near = np.minimum(near, d)
                pivots.append(p)
        if len(pivots) == 1 or np.bincount(owner).max() > 0.95 * len(rows):  # nearly all alike: pages in id order
            parts = np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))
            pivots = [int(p[0]) for p in parts]
        else:
            parts = [rows[owner == k] for k in range(len(pivots))]
        kept = [(p, r) for p, r in zip(pivots, parts, strict=True) if len(r)]
        children = [self._build(r, p) for p, r in kept]
        entries = np.array([p for p, _ in kept])
        radius = np.array([self._dist(p, r).max() for p, r in kept])
        return Node(min(c.least_id for c in children), self._dist(centre, entries), routes=self._f[entries], radius=radius, children=children)

    def search(self, query_id: int, q: np.ndarray, k: int, known: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """The k best (score, vec_id), highest score first, ties to the smaller id; rows of query_id excluded.

        known, the k-th best (score, vec_id) found elsewhere, leaves out what is not better.
        """
        if self.root is None:
            return []
        qf = q.astype(np.float64)
        base = float(qf @ qf) + self.m2
        asked = qf if self.exact else q
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id), the worst first
        worst = None if known is None else (known[0], -known[1])
        d0 = math.sqrt(max(base - 2 * float(self.first @ qf), 0.0))
        heap: list[tuple[float, int, int, Node, float]] = [(0.0, self.root.least_id, 0, self.root, d0)]
        made = 0

        def limit() -> float:
            return np.inf if worst is None else math.sqrt(max(base - 2 * worst[0], 0.0)) + self.slack

        while heap:
            bound, least_id, _, node, d_parent = heapq.heappop(heap)
            if worst is not None:
                top = best_score(base, bound)
                if top < worst[0]:
                    break
                if top == worst[0] and least_id > -worst[1]:
                    continue
            reach = limit()
            gap = np.abs(node.parent_dist - d_parent)
            if node.children is None:
                self.scored += node.hi - node.lo
                if worst is not None:
                    at = np.flatnonzero(gap <= reach) + node.lo
                    score = (self.rows[node.lo : node.hi] if len(at) == node.hi - node.lo else self.rows[at]) @ asked
                    good = score >= worst[0]
                    if not good.any():
                        continue
                    at, score = at[good], score[good]
                else:
                    at, score = np.arange(node.lo, node.hi), self.rows[node.lo : node.hi] @ asked
                ids = self.ids[at]
                if len(at) > 4 * k:  # only the page's own best can enter
                    top = np.lexsort((ids, -score))[: k + int((ids == query_id).sum())]
                    ids, score = ids[top], score[top]
                for i, s in zip(ids.tolist(), score.tolist(), strict=True):
                    if i != query_id and (worst is None or (s, -i) > worst):
                        if len(best) < k:
                            heapq.heappush(best, (int(s), -i))
                        else:
                            heapq.heapreplace(best, (int(s), -i))
                        if len(best) == k and (worst is None or best[0] > worst):
                            worst = best[0]
                continue
            pick = np.flatnonzero(gap - node.radius <= reach)
            d = np.sqrt(np.maximum(base - 2 * (node.routes[pick] @ qf), 0.0))
            least = d - node.radius[pick] - self.slack
            for c, dc, lo in zip(pick.tolist(), d.tolist(), least.tolist(), strict=True):
                if lo <= reach:
                    made += 1
                    heapq.heappush(heap, (lo, node.children[c].least_id, made, node.children[c], dc))
        return [(s, -i) for s, i in sorted(best, key=lambda b: (-b[0], -b[1]))]


def slack_of(m2: float) -> float:
    """What distances may be off by: whole sums are exact in doubles up to 2**53."""
    return SLACK if m2 < 1 << 52 else SLACK + 1e-7 * math.sqrt(m2)


class Routes:
    """The tree's upper two levels: routing objects, and once they are known the slices' radii and least ids."""

    def __init__(self, vectors: np.ndarray, m2: float):
        self.m2 = m2
        self.v = vectors.astype(np.float64)
        norm = np.einsum("ij,ij->i", self.v, self.v)
        self.x = np.hstack([self.v, np.sqrt(np.maximum(m2 - norm, 0.0))[:, None]])
        first = max(1, math.isqrt(len(vectors)))
        self.owner = self._nearest(self.x, self.x[:first])
        self.below = [np.flatnonzero(self.owner == c) for c in range(first)]
        self.first = self.x[:first]

    @staticmethod
    def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.argmin(np.einsum("ij,ij->i", to, to)[None, :] - 2 * (x @ to.T), axis=1)

    def placed(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slice of each vector, and its distance to the slice's routing object."""
        f = v.astype(np.float64)
        norm = np.einsum("ij,ij->i", f, f)
        x = np.hstack([f, np.sqrt(np.maximum(self.m2 - norm, 0.0))[:, None]])
        branch = self._nearest(x, self.first)
        out = np.zeros(len(x), np.int64)
        for c in np.unique(branch).tolist():
            rows = np.flatnonzero(branch == c)
            out[rows] = self.below[c][self._nearest(x[rows], self.x[self.below[c]])]
        d = x - self.x[out]
        return out, np.sqrt(np.einsum("ij,ij->i", d, d))

    def bounds(self, q: np.ndarray, slices: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and slice the least distance that it could hold, and the highest score."""
        f = q.astype(np.float64)
        base = np.einsum("ij,ij->i", f, f)[:, None] + self.m2
        d = np.sqrt(np.maximum(base - 2 * (f @ self.v.T), 0.0))[:, slices]
        least = d - radius[None, :] - slack_of(self.m2)
        return least, best_score(base, least)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


PLACED = "slice int, query_row bigint, vec_id bigint, v array<bigint>, dist double"
TREE = "slice int, part int, n bigint, radius double, least_id bigint, tree binary"
VISIT = "slice int, part int, query_row bigint, query_id bigint, v array<bigint>, score bigint, vec_id bigint"
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _table(schema: str, columns: list) -> dict:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return {f.split()[0]: pa.array(c, kinds[f.split()[1]]) for f, c in zip(schema.split(", "), columns, strict=True)}


class Index:
    """The slices' trees as a written table, and what every task knows of them."""

    def __init__(self, ws: Workspace, rows: DataFrame):
        norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
        facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("m2"), F.max(F.size("v")).alias("width")).first()
        self.ws, self.rows, self.n = ws, rows, facts["n"]
        self.width, m2 = int(facts["width"] or 0), float(facts["m2"] or 0.0)
        if not self.n:
            return
        want = min(MAX_SLICES, -(-self.n // SLICE))
        # A limit on the hash lets through about twice as many rows as are wanted; the lowest hashes are taken.
        at = F.pmod(F.xxhash64("vec_id", "query_row"), F.lit(SPREAD))
        drawn = rows.select(at.alias("at"), "query_row", "v").where(F.col("at") <= SPREAD * 2 * want // self.n + SPREAD // self.n).collect()
        picked = sorted((r["at"], r["query_row"], r["v"]) for r in drawn)[:want] or [(0, 0, [0] * self.width)]
        vectors = np.unique(self.matrix([v for _, _, v in picked]), axis=0)
        vectors = vectors[np.random.default_rng(0).permutation(len(vectors))]
        self.routes = routes = Routes(vectors, m2)
        width = self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    slices, dist = routes.placed(_matrix(batch.column(2), width))
                    yield pa.RecordBatch.from_pydict(_table(PLACED, [slices, batch.column(0), batch.column(1), batch.column(2), dist]))

        placed = ws.save(rows.select("query_row", "vec_id", "v").mapInArrow(place, PLACED))
        sizes = placed.groupBy("slice").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > 2 * SLICE)
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            placed = placed.withColumn("part", F.lit(0))
        else:
            parts = min(MAX_PARTS, -(-most // SLICE))
            cuts = F.percentile_approx("vec_id", [i / parts for i in range(1, parts)], 10_000).alias("cuts")
            cut = placed.join(large.select("slice"), "slice", "left_semi").groupBy("slice").agg(cuts, F.count("*").alias("n"))
            cut = ws.save(cut.select(F.col("slice").alias("s_"), "cuts", F.least(F.lit(parts), F.ceil(F.col("n") / SLICE)).alias("parts")))
            placed = placed.join(cut, F.col("slice") == F.col("s_"), "left")
            place_of = F.size(F.filter("cuts", lambda c: c <= F.col("vec_id")))
            placed = placed.withColumn("part", F.coalesce(F.floor(place_of * F.col("parts") / parts).cast("int"), F.lit(0))).drop("s_", "cuts", "parts")

        def build(table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").to_numpy()
            tree = MTree(ids, _matrix(table.column("v"), width), m2)
            radius = float(table.column("dist").to_numpy().max())
            row = [[table.column(c)[0].as_py()] for c in ("slice", "part")] + [[len(ids)], [radius], [int(ids.min())], [tree.packed()]]
            return pa.table(_table(TREE, row))

        self.trees = ws.save(placed.groupBy("slice", "part").applyInArrow(build, TREE))
        known = sorted(tuple(r) for r in self.trees.select("slice", "part", "radius", "least_id").collect())
        self.slice, self.part, self.radius, self.least_id = (np.array(c) for c in zip(*known, strict=True))

    def matrix(self, rows: list) -> np.ndarray:
        return _matrix(pa.chunked_array([pa.array(rows, pa.list_(pa.int64()))]), self.width)

    def visits(self, asked: DataFrame, first: bool) -> DataFrame:
        """(VISIT): the slices that each query goes to: the nearest, or then those that can still hold better.

        asked has (query_row, query_id, v, score, vec_id), the last two the k-th best so far or null.
        """
        routes, width, names = self.routes, self.width, [x.split()[0] for x in VISIT.split(", ")]
        slices, parts, radius, least_id = self.slice, self.part, self.radius, self.least_id
        block = max(1, (1 << 22) // max(len(slices), len(routes.v)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    b = batch.slice(at, block)
                    q = _matrix(b.column(2), width)
                    least, score = routes.bounds(q, slices, radius)
                    home = np.argmin(least, axis=1)  # of equals the first, which holds the smallest ids
                    if first:
                        i, j = np.arange(len(q)), home
                    else:
                        worst = np.array([-np.inf if x is None else x for x in b.column(3).to_pylist()])
                        its_id = np.array([np.inf if x is None else x for x in b.column(4).to_pylist()])
                        ok = (score > worst[:, None]) | ((score == worst[:, None]) & (least_id[None, :] < its_id[:, None]))
                        ok[np.arange(len(q)), home] = False
                        i, j = np.nonzero(ok)
                    for some in range(0, len(i), 65_536):
                        row = pa.array(i[some : some + 65_536])
                        cols = [pa.array(slices[j[some : some + 65_536]], pa.int32()), pa.array(parts[j[some : some + 65_536]], pa.int32())]
                        yield pa.RecordBatch.from_arrays(cols + [b.column(c).take(row) for c in range(5)], names)

        return asked.select("query_row", "query_id", "v", "score", "vec_id").mapInArrow(run, VISIT)

    def found(self, visits: DataFrame, k: int) -> DataFrame:
        """(FOUND): the best of each query in each slice that it visits."""
        width = self.width
        visits = self.ws.save(visits)
        blocks = visits.groupBy("slice", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = self.ws.save(blocks.select(F.col("slice").alias("s_"), F.col("part").alias("p_"), "blocks"))
        here = (F.col("slice") == F.col("s_")) & (F.col("part") == F.col("p_"))
        trees = self.trees.select("slice", "part", "tree").join(F.broadcast(blocks), here).drop("s_", "p_")
        trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = visits.join(F.broadcast(blocks), here).drop("s_", "p_")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_row"), F.col("blocks")).cast("int")).drop("blocks")

        def run(_, held: pa.Table, queries: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int, int]] = []
            if held.num_rows and queries.num_rows:
                tree = MTree.unpacked(held.column("tree")[0].as_py())
                q = _matrix(queries.column("v"), width)
                cols = [queries.column(c).to_pylist() for c in ("query_row", "query_id", "score", "vec_id")]
                for i, (row, qid, score, vid) in enumerate(zip(*cols, strict=True)):
                    known = None if score is None else (score, vid)
                    out += [(row, qid, v, s) for s, v in tree.search(qid, q[i], k, known)]
            return pa.table(_table(FOUND, list(zip(*out, strict=True)) if out else [[]] * 4))

        keys = ["slice", "part", "block"]
        return self.ws.save(trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND))


def top_k(vectors: DataFrame, k: int = TOP, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row whose id query_step divides."""
    ws = Workspace(vectors.sparkSession)
    rows = ws.save(quantised(vectors).withColumn("query_row", F.monotonically_increasing_id()))
    index = Index(ws, rows)
    if not index.n:
        return ws.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    none = F.lit(None).cast("long")
    asked = rows.where(F.col("vec_id") % query_step == 0).select("query_row", F.col("vec_id").alias("query_id"), "v")
    near = index.found(index.visits(asked.select("*", none.alias("score"), none.alias("vec_id")), True), k)
    # The k-th best so far, null where there are fewer.
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id")))
    kth = near.groupBy(F.col("query_row").alias("r_")).agg(F.get(pairs, F.lit(k - 1)).alias("kth"))
    asked = asked.join(kth, F.col("query_row") == F.col("r_"), "left")
    asked = asked.select("query_row", "query_id", "v", (-F.col("kth.score")).alias("score"), F.col("kth.vec_id").alias("vec_id"))
    found = near.unionByName(index.found(index.visits(asked, False), k))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = TOP, step: int = QUERY_STEP) -> str:
    return f"""
with q as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(e::double * {SCALE})::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select a.r, a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
    from q a join q b on a.vec_id <> b.vec_id where a.vec_id % {step} = 0),
t as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from t where rank <= {k}
"""
