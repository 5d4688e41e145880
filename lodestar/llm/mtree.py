"""Exact k nearest neighbours by best-first search in a forest of M-trees.

Building:
1. Pivots, the roots' entries, are drawn from the distinct vectors in a seeded order;
   every vector goes to the subtree of its nearest pivot.  A pivot that is nearest to
   more vectors than a task should hold (copies, say) has several subtrees.
2. Inside a subtree the vectors are split around routing vectors, and these parts
   again until each fits a page.  The first split makes the inner nodes.  A node holds
   its routing vector, its covering radius and the distance of its routing vector to
   its parent's: the pivot for an inner node, the inner node for a page (a leaf node);
   a page also has of every entry the distance to the page's routing vector.

Searching: a query visits first the subtree it lies in, which bounds the distance of
its k-th neighbour, and then all subtrees that the bound can't rule out.  There it
visits pages by their least possible distance.  By the triangle inequality
- a node's routing vector is measured only if the distances of query and routing
  vector to the parent's, both stored, don't rule the node out already;
- a node is entered only if the distance to its routing vector less the covering
  radius is within the bound, so that with an inner node all its pages fall;
- an entry is measured only if the distances of query and entry to the routing
  vector don't rule it out.
All queries in hand do this side by side: in each round every query visits the best
page it has left, and queries at the same page are measured together.

Pages and queries meet by a shuffle on (subtree, part): no task holds more than one
subtree, of a bounded number of vectors, and a batch of queries.  A subtree that many
queries visit is copied for parts of them, one that none visits stays behind.  What is
broadcast, the pivots, has a size limit.  Distances are Euclidean, in 64-bit floats;
for vectors of norm 1 the order is that of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .tokens import freed

K = 10
#: Vectors in a subtree, on the average.
SUBTREE_ROWS = 4096
#: Vectors in a subtree at most, about: those of a pivot that has more are dealt out to several.
SUBTREE_MOST = 4
#: Most bytes of pivots, which are broadcast; beyond it, a pivot has several subtrees.
PIVOT_BYTES = 64 << 20
PAGE_ROWS = 128
#: Queries that go to one subtree in one task; beyond it, copies of the subtree share them.
QUERIES_PER_TASK = 20_000
#: Queries searched side by side.
BATCH = 2048
#: Room for rounding in bounds, as a share of squared norms.
SLACK = 1e-11


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of a and of b, up to rounding of SLACK in their squares."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to the same rows of b; the same pair has the same distance wherever it is measured."""
    return np.sqrt(np.square(a - b).sum(1))


@dataclass
class Page:
    """A leaf node: entries' ids, vectors and distances to the routing vector; inner: the number of its inner node in the subtree."""

    inner: int
    routing: np.ndarray
    radius: float
    to_parent: float
    ids: np.ndarray
    vectors: np.ndarray
    entry: np.ndarray


@dataclass
class Inner:
    """An inner node."""

    routing: np.ndarray
    radius: float
    to_parent: float


def build_pages(ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, page_rows: int = PAGE_ROWS) -> tuple[list[Inner], list[Page]]:
    """The nodes of one subtree."""
    inner: list[Inner] = []
    pages: list[Page] = []
    for rows, routing in _split(vectors, np.arange(len(ids)), pivot, page_rows):
        inner.append(Inner(routing, float(exact(vectors[rows], routing[None, :]).max()), float(exact(routing[None, :], pivot[None, :])[0])))
        todo = [(rows, routing)]
        while todo:
            rows, own = todo.pop()
            parts = _split(vectors, rows, own, page_rows)
            if len(parts) > 1:
                todo.extend(parts)
                continue
            entry = exact(vectors[rows], own[None, :])
            pages.append(Page(len(inner) - 1, own, float(entry.max()), float(exact(own[None, :], routing[None, :])[0]), ids[rows], vectors[rows], entry))
    return inner, pages


def _split(vectors: np.ndarray, rows: np.ndarray, routing: np.ndarray, page_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, routing vector) of the parts that rows are split into, a single one where they fit a page."""
    if len(rows) <= page_rows:
        return [(rows, routing)]
    ways = min(16, -(-len(rows) // page_rows) + 1)
    seeds = np.unique(vectors[rows[np.linspace(0, len(rows) - 1, ways).astype(int)]], axis=0)
    nearest = distances(vectors[rows], seeds).argmin(1)
    held = np.bincount(nearest, minlength=len(seeds))
    if held.max() < len(rows):
        return [(rows[nearest == i], seeds[i]) for i in range(len(seeds)) if held[i]]
    if np.ptp(vectors[rows], axis=0).any():
        # seeds that part nothing: halves by the distance to one of them part the rest
        far = distances(vectors[rows], seeds[:1])[:, 0].argsort(kind="stable")
        return [(rows[half], vectors[rows[half[0]]]) for half in np.array_split(far, 2)]
    # the same vector all along: parts of copies
    return [(rows[cut : cut + page_rows], vectors[rows[0]]) for cut in range(0, len(rows), page_rows)]


class Tree:
    """The nodes of one subtree, ready to be searched."""

    def __init__(self, inner: list[Inner], pages: list[Page]):
        self.inner, self.pages = inner, pages
        self.radius = np.array([p.radius for p in pages])
        self.to_parent = np.array([p.to_parent for p in pages])
        self.norm = [np.square(p.vectors).sum(1) for p in pages]
        self.measured = 0  # distances between a query and an entry or a routing vector

    def _least(self, vectors: np.ndarray, to_pivot: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least possible distances to what pages hold, distances to their routing vectors, NaN where not measured): queries x pages."""
        n, m = len(vectors), len(self.pages)
        least, to_routing = np.full((n, m), np.inf), np.full((n, m), np.nan)
        of_inner: dict[int, list[int]] = {}
        for p, page in enumerate(self.pages):
            of_inner.setdefault(page.inner, []).append(p)
        for c, own in of_inner.items():
            node = self.inner[c]
            # what the distances to the parent tell of a node, without measuring its routing vector
            rows = np.flatnonzero(np.abs(to_pivot - node.to_parent) - node.radius <= limit)
            self.measured += len(rows)
            d = distances(vectors[rows], node.routing[None, :])[:, 0]
            open_ = d - node.radius <= limit[rows]
            rows, d = rows[open_], d[open_]
            for p in own:
                near = np.abs(d - self.to_parent[p]) - self.radius[p] <= limit[rows]
                some = rows[near]
                self.measured += len(some)
                far = distances(vectors[some], self.pages[p].routing[None, :])[:, 0]
                to_routing[some, p] = far
                least[some, p] = np.maximum(far - self.radius[p], d[near] - node.radius)
        return least, to_routing

    def search(self, ids: np.ndarray, vectors: np.ndarray, to_pivot: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, neighbours' ids, distances) of the k nearest within the bounds, by (distance, id), the query's id excluded."""
        n, m = len(ids), len(self.pages)
        norm = np.square(vectors).sum(1)
        slack = np.sqrt(SLACK * (1 + norm))
        best_d = np.full((n, k), np.inf)
        best_i = np.full((n, k), np.iinfo(np.int64).max)
        kth = bound.copy()
        least, to_routing = self._least(vectors, to_pivot, kth + slack)
        order = np.argsort(least, axis=1, kind="stable")
        least = np.take_along_axis(least, order, 1)
        live = np.arange(n)
        for step in range(m):
            live = live[(least[live, step] <= (kth + slack)[live]) & np.isfinite(least[live, step])]
            if not len(live):
                break
            page = order[live, step]
            by_page = np.argsort(page, kind="stable")
            edge = np.searchsorted(page[by_page], np.arange(m + 1))
            for p in np.flatnonzero(np.diff(edge)):
                self._visit(int(p), live[by_page[edge[p] : edge[p + 1]]], ids, vectors, norm, to_routing, slack, kth, best_d, best_i, k)
        row, place = np.nonzero(np.isfinite(best_d))
        return row, best_i[row, place], best_d[row, place]

    def _visit(self, p: int, rows: np.ndarray, ids, vectors, norm, to_routing, slack, kth, best_d, best_i, k: int) -> None:
        page = self.pages[p]
        limit = (kth + slack)[rows]
        open_ = np.abs(to_routing[rows, p][:, None] - page.entry[None, :]) <= limit[:, None]
        open_ &= ids[rows][:, None] != page.ids[None, :]
        columns = np.flatnonzero(open_.any(0))
        if not len(columns):
            return
        open_ = open_[:, columns]
        self.measured += int(open_.sum())
        square = norm[rows][:, None] + self.norm[p][columns][None, :] - 2 * (vectors[rows] @ page.vectors[columns].T)
        near = np.where(open_, np.sqrt(np.maximum(square, 0)), np.inf)
        if len(columns) > k:
            # of one page no more than its k nearest count, and those as near as they
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack[rows])
        r, c = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        if not len(r):
            return
        hit = np.unique(r)
        d = exact(vectors[rows[r]], page.vectors[columns[c]])
        place = np.searchsorted(hit, r)
        held = rows[hit]
        owner = np.concatenate([np.repeat(np.arange(len(hit)), k), place])
        all_d = np.concatenate([best_d[held].ravel(), d])
        all_i = np.concatenate([best_i[held].ravel(), page.ids[columns[c]]])
        sorted_ = np.lexsort((all_i, all_d, owner))
        begin = np.searchsorted(owner[sorted_], np.arange(len(hit)))
        top = sorted_[begin[:, None] + np.arange(k)]
        best_d[held], best_i[held] = all_d[top], all_i[top]
        kth[held] = np.minimum(kth[held], best_d[held][:, -1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _pivots(vectors: DataFrame, dim: int, rows: int, subtree_rows: int) -> np.ndarray:
    """Distinct pivots, one for subtree_rows vectors, PIVOT_BYTES of them at most."""
    wanted = max(1, min(-(-rows // subtree_rows), PIVOT_BYTES // (8 * dim)))
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
    return np.unique(_matrix(drawn.column(0).combine_chunks(), dim), axis=0)


def _search(pages: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(id, near) of queries (id, subtree, vector, to_pivot, bound) in their subtrees; near: structs (distance, id)."""
    # a row a subtree
    asked_of = queries.groupBy("subtree").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("parts"))
    blank = F.lit(None)
    # pages go ahead of the queries of each (subtree, part)
    copies = pages.join(asked_of, "subtree").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("subtree", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.col("routing").alias("vector"), F.col("to_parent").alias("to_pivot"), F.col("radius").alias("bound"), "ids", "vectors", "entry", "node")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    asked = queries.join(asked_of, "subtree").select("subtree", part.alias("part"), F.lit(1).alias("kind"), "id", "vector", "to_pivot", "bound", *(blank.cast("binary").alias(c) for c in ("ids", "vectors", "entry", "node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inner, pages_, tree = None, {}, [], None
        waiting: list[tuple] = []

        def finish() -> pa.RecordBatch:
            ids, vectors, to_pivot, bound = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            row, near, d = tree.search(ids, vectors, to_pivot, bound, k)
            offsets = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(d), pa.array(near)], names=["distance", "id"])
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["id", "near"])

        for batch in freed(batches):
            subtree, piece, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(subtree) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                own = (subtree[a], piece[a])
                if own != key:
                    if waiting:
                        yield finish()
                    key, inner, pages_, tree = own, {}, [], None
                vector = _matrix(batch.column(4).slice(a, b - a), dim)
                to_pivot, bound = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (5, 6))
                if kind[a] == 0:
                    for i in range(b - a):
                        raw = [batch.column(j)[a + i].as_buffer() for j in (7, 8, 9, 10)]
                        node = np.frombuffer(raw[3], np.float64)  # number, radius, distance to the pivot, routing vector
                        inner[int(node[0])] = Inner(node[3:], float(node[1]), float(node[2]))
                        pages_.append(Page(int(node[0]), vector[i], float(bound[i]), float(to_pivot[i]), np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.float64).reshape(-1, dim), np.frombuffer(raw[2], np.float64)))
                    continue
                tree = tree or Tree([inner[c] for c in range(len(inner))], pages_)
                for c in range(a, b, BATCH):
                    some = slice(c - a, min(c + BATCH, b) - a)
                    waiting.append((ids[a:b][some], vector[some], to_pivot[some], bound[some]))
                    if sum(len(x[0]) for x in waiting) >= BATCH:
                        yield finish()
        if waiting:
            yield finish()

    together = copies.unionByName(asked).repartition("subtree", "part").sortWithinPartitions("subtree", "part", "kind")
    return together.mapInArrow(run, "id long, near array<struct<distance:double,id:long>>")


def nearest(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", query_step: int = 1, k: int = K, subtree_rows: int = SUBTREE_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors of every query, rank 1 first.

    Queries are the vectors whose id query_step divides, all of them by default; all
    vectors are searched.

    Equal distances go by neighbour_id.  Where there are fewer than k others, there
    are fewer rows.  Rows without an id or a vector, and vectors with a null, a NaN
    or an infinite component or without any, are left out.  Vectors of different
    lengths aren't near each other: each is searched for among those of its length.
    Rows that share an id are one vector, that which sorts first.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    clean = (
        vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    )
    clean = written(clean.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    out = None
    # the lengths that occur, commonly a single one
    for dim, rows in sorted((r[0], r[1]) for r in clean.groupBy(F.size("vector")).count().collect()):
        found = _nearest(clean.where(F.size("vector") == dim), dim, rows, query_step, k, subtree_rows, page_rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    return out


def _nearest(clean: DataFrame, dim: int, rows: int, query_step: int, k: int, subtree_rows: int, page_rows: int) -> DataFrame:
    spark = clean.sparkSession
    pivots = _pivots(clean, dim, rows, subtree_rows)
    # PIVOT_BYTES at most
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            if batch.num_rows:
                v = _matrix(batch.column(1), dim)
                home = np.concatenate([distances(v[i : i + 256], shared.value).argmin(1) for i in range(0, len(v), 256)])
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column(0), batch.column(1), pa.array(exact(v, shared.value[home]))], names=["pivot", "id", "vector", "to_pivot"])

    assigned = written(clean.mapInArrow(assign, "pivot int, id long, vector array<double>, to_pivot double"), "homes")
    # of each pivot, how far its vectors reach and the numbers of its subtrees: a row a pivot
    reach, trees = np.full(len(pivots), -1.0), np.zeros(len(pivots), dtype=np.int64)
    for r in assigned.groupBy("pivot").agg(F.max("to_pivot"), F.ceil(F.count("*") / (SUBTREE_MOST * subtree_rows))).collect():
        reach[r[0]], trees[r[0]] = r[1], r[2]
    begin = np.concatenate([[0], np.cumsum(trees)])
    known = spark.sparkContext.broadcast((reach, trees, begin))
    numbered = F.broadcast(spark.createDataFrame([(i, int(begin[i]), int(n)) for i, n in enumerate(trees) if n], "pivot int, begin int, trees int"))
    homes = assigned.join(numbered, "pivot").select("pivot", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("trees"))).cast("int").alias("subtree"), "id", "vector", "to_pivot")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, ids, held = None, None, [], []

        def finish() -> pa.RecordBatch:
            inner, made = build_pages(np.concatenate(ids), np.concatenate(held), shared.value[pivot], page_rows)
            nodes = [np.concatenate([[p.inner, inner[p.inner].radius, inner[p.inner].to_parent], inner[p.inner].routing]) for p in made]
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * len(made), pa.int32()), _lists(np.stack([p.routing for p in made])), pa.array([p.radius for p in made]), pa.array([p.to_parent for p in made])]
                + [pa.array([x.tobytes() for x in column], pa.binary()) for column in ([p.ids for p in made], [p.vectors for p in made], [p.entry for p in made], nodes)],
                names=["subtree", "routing", "radius", "to_parent", "ids", "vectors", "entry", "node"],
            )

        for batch in freed(batches):
            subtree, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            edges = (np.flatnonzero(np.diff(subtree)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if subtree[a] != key:
                    if ids:
                        yield finish()
                    key, pivot, ids, held = int(subtree[a]), int(home[a]), [], []
                ids.append(batch.column(1).slice(a, b - a).to_numpy())
                held.append(_matrix(batch.column(2).slice(a, b - a), dim))
        if ids:
            yield finish()

    pages = homes.select("subtree", "id", "vector", "pivot").repartition("subtree").sortWithinPartitions("subtree", "id").mapInArrow(build, "subtree int, routing array<double>, radius double, to_parent double, ids binary, vectors binary, entry binary, node binary")
    pages = written(pages, "pages")
    queries = homes.where(F.col("id") % query_step == 0) if query_step != 1 else homes
    first = written(_search(pages, queries.select("subtree", "id", "vector", "to_pivot", F.lit(float("inf")).alias("bound")), dim, k), "own")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other subtrees that a query's bound doesn't rule out."""
        far, count, first_tree = known.value
        for batch in freed(batches):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                v = _matrix(part.column(1), dim)
                home, pivot, bound = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
                d = distances(v, shared.value)
                own = d[np.arange(len(v)), pivot]
                # by the covering radius, and as every vector lies at its nearest pivot
                least = np.maximum(d - far[None, :], (d - own[:, None]) / 2)
                slack = 2 * np.sqrt(SLACK * (1 + np.square(v).sum(1)))
                row, near = np.nonzero((least <= (bound + slack)[:, None]) & (far >= 0)[None, :])
                # all subtrees of these pivots but the query's own
                again = np.repeat(np.arange(len(row)), count[near])
                row, near = row[again], near[again]
                subtree = first_tree[near] + np.arange(len(again)) - np.searchsorted(again, again)
                other = subtree != home[row]
                row, near, subtree = row[other], near[other], subtree[other]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(subtree.astype(np.int32)), part.column(1).take(at), pa.array(d[row, near]), pa.array(bound[row])], names=["id", "subtree", "vector", "to_pivot", "bound"])

    bounded = queries.join(first, "id", "left").select("id", "vector", "subtree", "pivot", F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(F.lit(float("inf"))).alias("bound"))
    asked = written(bounded.mapInArrow(route, "id long, subtree int, vector array<double>, to_pivot double, bound double"), "asked")
    others = _search(pages, asked, dim, k)
    top = first.unionByName(others).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return top.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("place", "n")).select("vec_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.col("n.distance").alias("distance"))


def oracle(table: str = "embeddings", id_column: str = "vec_id", vector_column: str = "embedding", query_step: int = 1, k: int = K, digits: int = 6) -> str:
    """The same in SQL, distances rounded to digits, for a table without repeated ids."""
    return f"""
WITH vectors AS (SELECT {id_column} AS id, CAST({vector_column} AS DOUBLE[]) AS vector FROM {table} WHERE {id_column} IS NOT NULL AND {vector_column} IS NOT NULL),
ranked AS (
  SELECT a.id AS vec_id, b.id AS neighbour_id, list_distance(a.vector, b.vector) AS distance,
         row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vector, b.vector), b.id) AS rank
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % {query_step} = 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, {digits}) AS distance FROM ranked WHERE rank <= {k}"""
