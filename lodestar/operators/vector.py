"""Nearest-neighbour search over a column of vectors.

Vectors are scanned once, in Arrow batches, by one matrix product a batch; each task
keeps the k best of its rows for every query, so a shuffle carries k rows a task and
query.  Filters are applied before that, where Catalyst can push them to the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Block, check_metric, distance, matrix_distance
from ..functions.metadata import predicate
from ..session import input_bytes, ship, spread, written

#: Queries of this size at most are sent to all tasks; more are joined in blocks.
BROADCAST_BYTES = 32 << 20
#: Rows of one side in a block of that join.
BLOCK_ROWS = 1024
#: Blocks of queries that a task of that join has, and blocks of records it compares them with.
TASK_QUERY_BLOCKS, TASK_BLOCKS = 32, 128


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of vectors; they must be of one length and without nulls."""
    count = len(column)
    lengths = pc.min_max(pc.list_value_length(column))
    if count and lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} to {lengths['max']} components")
    if column.flatten().null_count:
        raise ValueError("a vector with a null component")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(count, -1 if count else (dim or 0))


def top_k(records: DataFrame, query: Sequence[float], k: int = 10, *, metric: str = "cosine", where=None, mode: str = "pre", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(rank, score, and the columns of records but the vector) of the k nearest records, nearest first.

    where: a filter on records (see metadata.predicate(); a mapping or a function
    judges the column metadata).  mode "pre" applies it before the search; "post"
    searches max(10 k, 50) records first, and so may give fewer than k.  Ties go by
    id.  Records without a vector aren't found.  A query of another length than the
    vectors raises ValueError.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be positive")
    condition = predicate(F.col("metadata") if "metadata" in records.columns else F.lit(None), where)
    live = records.where(F.col(vector_column).isNotNull())
    if mode == "pre":
        live = live.where(condition)
    elif mode != "post":
        raise ValueError("mode is pre or post")
    query = np.asarray(query, dtype=np.float64).reshape(-1)
    found = _scored(live, query, k if mode == "pre" or where is None else max(10 * k, 50), metric, vector_column)
    found = found.orderBy("score", id_column)
    if mode == "post" and where is not None:
        found = found.limit(max(10 * k, 50)).where(condition).orderBy("score", id_column)
    place = Window.orderBy("score", id_column)  # over k rows
    return found.limit(k).withColumn("rank", F.row_number().over(place))


def _scored(live: DataFrame, query: np.ndarray, keep: int, metric: str, vector_column: str) -> DataFrame:
    """live without its vectors, with score; of each batch the nearest keep rows and their ties."""
    ship(live.sparkSession)
    names = [c for c in live.columns if c != vector_column]
    schema = live.select(*names).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(len(names))
            flat = _matrix(vectors)
            if flat.shape[1] != len(query):
                raise ValueError(f"a query of {len(query)} components for vectors of {flat.shape[1]}")
            score = matrix_distance(flat, query[None, :], metric)[:, 0]
            rows = np.arange(len(score))
            if len(score) > keep:
                rows = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(names))), pa.array(score[rows])], names=[*names, "score"])

    return live.select(*names, vector_column).mapInArrow(run, schema)


def batch_top_k(records: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "cosine", id_column: str = "id", vector_column: str = "embedding", query_id: str = "id", query_vector: str = "embedding", exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest records for each query.

    Queries of up to broadcast_bytes by Catalyst's estimate go to every task; more
    are packed in blocks and meet the records block by block.  exclude_self leaves
    out the record with the query's own id.
    """
    check_metric(metric)
    spark = records.sparkSession
    ship(spark)
    records = records.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    queries = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector"))
    kind, query_kind = records.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    schema = f"query_id {query_kind}, id {kind}, score double"
    if input_bytes(queries) <= broadcast_bytes:
        table = queries.toArrow().combine_chunks()
        if table.num_rows:
            query_ids, vectors = table.column(0).combine_chunks(), _matrix(table.column(1).combine_chunks())
        else:
            query_ids, vectors = pa.array([], table.schema.field(0).type), np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((query_ids, vectors))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_, vectors_ = shared.value
            nearest = [_Nearest(ids_.slice(a, BLOCK_ROWS), Block(vectors_[a : a + BLOCK_ROWS], metric), k, exclude_self) for a in range(0, len(ids_), BLOCK_ROWS)]
            for batch in batches:
                for a in range(0, batch.num_rows if nearest else 0, BLOCK_ROWS):
                    part = batch.slice(a, BLOCK_ROWS)
                    block = Block(_matrix(part.column(1)), metric)
                    for one in nearest:
                        one.see(part.column(0), block)
            for one in nearest:
                yield from one.found()

        found = spread(records).mapInArrow(scan, schema)
    else:
        left, right = written(_blocks(records), "blocks"), written(_blocks(queries).withColumn("block", F.monotonically_increasing_id()), "blocks")
        parts = max(1, -(-right.count() // TASK_QUERY_BLOCKS))
        # a task has some blocks of queries and keeps their k nearest among many blocks of records
        slices = max(-(-left.count() // TASK_BLOCKS), -(-3 * spark.sparkContext.defaultParallelism // parts))
        left = left.repartition(slices)
        right = right.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.col("dim").alias("query_dim"), "block").repartition(parts)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest: dict[int, _Nearest] = {}
            seen = block = None
            for batch in batches:
                for i in range(batch.num_rows):
                    ids_, vectors_, dim, own, own_vectors, own_dim, number = (batch.column(j)[i] for j in range(7))
                    # a block of records comes with each block of queries in turn
                    if seen is None or not seen.equals(ids_):
                        seen, block = ids_, Block(_unpacked(vectors_, dim), metric)
                    number = number.as_py()
                    if number not in nearest:
                        nearest[number] = _Nearest(pa.concat_arrays([own.values]), Block(_unpacked(own_vectors, own_dim), metric), k, exclude_self)
                    nearest[number].see(ids_.values, block)
            for one in nearest.values():
                yield from one.found()

        found = left.crossJoin(right).mapInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Nearest:
    """The k nearest of the records seen, for each query of a block; ties go by id."""

    def __init__(self, ids: pa.Array, block: Block, k: int, exclude_self: bool):
        self.ids, self.block, self.k, self.exclude_self = ids, block, k, exclude_self
        self.bound = np.full(len(ids), np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pending = 0

    def see(self, ids: pa.Array, block: Block) -> None:
        score, off = self.block.approximate(block)
        if self.exclude_self:
            score[_same(self.ids, ids)] = np.inf
        limit = self.bound + off
        fresh = np.isinf(self.bound)
        if fresh.any() and score.shape[1] > self.k:
            limit[fresh] = np.partition(score[fresh], self.k - 1, axis=1)[:, self.k - 1] + 2 * off
        row, column = np.divmod(np.flatnonzero(score <= np.where(np.isnan(limit), np.inf, limit)[:, None]), score.shape[1])
        if self.exclude_self:
            other = np.isfinite(score[row, column])
            row, column = row[other], column[other]
        exact = self.block.exact(block, row, column)
        good = np.isfinite(exact)
        self.held.append((row[good], exact[good], ids.take(pa.array(column[good]))))
        self.pending += len(row)
        if fresh.any() or self.pending > 2 * self.k * len(self.ids):
            self._cut()

    def _cut(self) -> None:
        row, score = (np.concatenate([x[i] for x in self.held]) for i in range(2))
        ids = pa.concat_arrays([x[2] for x in self.held])
        order = pc.sort_indices(pa.table({"row": row, "score": score, "id": ids}), [("row", "ascending"), ("score", "ascending"), ("id", "ascending")]).to_numpy()
        row = row[order]
        begin = np.searchsorted(row, np.arange(len(self.ids) + 1))
        kept = order[np.arange(len(row)) - begin[row] < self.k]
        score = score[kept]
        full = np.diff(begin) >= self.k
        row = row[np.arange(len(row)) - begin[row] < self.k]
        self.bound[full] = score[np.searchsorted(row, np.flatnonzero(full), "right") - 1]
        self.held, self.pending = [(row, score, ids.take(pa.array(kept)))], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            row, score, ids = self.held[0]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), ids, pa.array(score)], names=["query_id", "id", "score"])


def _same(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where a value of a is one of b."""
    codes = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    x, y = codes[: len(a)], codes[len(a) :]
    order = np.argsort(y, kind="stable")
    begin, end = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    count = end - begin
    return np.repeat(np.arange(len(x)), count), order[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _blocks(side: DataFrame) -> DataFrame:
    """(ids, vectors, dim): up to BLOCK_ROWS rows of (id, vector) each, the vectors packed."""
    kind = side.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                vectors = _matrix(part.column(1))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([vectors.tobytes()], pa.binary()), pa.array([vectors.shape[1]], pa.int32())], names=["ids", "vectors", "dim"])

    return side.mapInArrow(pack, f"ids array<{kind}>, vectors binary, dim int")


def _unpacked(vectors: pa.BinaryScalar, dim: pa.Int32Scalar) -> np.ndarray:
    return np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, dim.as_py())


def recommend(records: DataFrame, ids: DataFrame, k: int = 10, *, metric: str = "cosine", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each of the records named in ids the k nearest other records."""
    wanted = records.join(ids.select(id_column).distinct(), id_column, "left_semi")
    return batch_top_k(records, wanted, k, metric=metric, id_column=id_column, vector_column=vector_column, query_id=id_column, query_vector=vector_column, exclude_self=True)


def near_pairs(records: DataFrame, threshold: float, *, metric: str = "cosine", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(id_a, id_b, score) of all pairs of records nearer than the threshold, id_a < id_b; compared block by block."""
    check_metric(metric)
    ship(records.sparkSession)
    side = records.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    kind = side.schema["id"].dataType.simpleString()
    blocks = written(_blocks(side).withColumn("block", F.monotonically_increasing_id()), "blocks")
    left = blocks.select("ids", "vectors", "dim", "block")
    right = blocks.select(F.col("ids").alias("ids_b"), F.col("vectors").alias("vectors_b"), F.col("dim").alias("dim_b"), F.col("block").alias("block_b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, va, da, b, vb, db, own = (batch.column(j)[i] for j in range(7))
                x, y = Block(_unpacked(va, da), metric), Block(_unpacked(vb, db), metric)
                score, off = x.approximate(y)
                row, column = np.divmod(np.flatnonzero(score < threshold + off), score.shape[1])
                if own.as_py():
                    later = row < column  # each pair once
                    row, column = row[later], column[later]
                score = x.exact(y, row, column)
                near = score < threshold
                p, q = a.values.take(pa.array(row[near])), b.values.take(pa.array(column[near]))
                turned = pc.greater(p, q)
                yield pa.RecordBatch.from_arrays([pc.if_else(turned, q, p), pc.if_else(turned, p, q), pa.array(score[near])], names=["id_a", "id_b", "score"])

    # two blocks meet once
    met = left.join(right, F.col("block") <= F.col("block_b")).select("ids", "vectors", "dim", "ids_b", "vectors_b", "dim_b", (F.col("block") == F.col("block_b")).alias("own"))
    return met.mapInArrow(meet, f"id_a {kind}, id_b {kind}, score double").where("id_a < id_b")


def score_column(vector: Column, other: Column, metric: str = "cosine") -> Column:
    """The distance as a built-in expression, for joins and projections of one's own."""
    return distance(vector, other, metric)
