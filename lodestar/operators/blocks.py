"""PageRank and components of graphs too large for one machine, on numbers in place of names.

A node is known by a 64-bit hash of its id (another seed is taken where two ids meet),
and its block by the hash.  For PageRank a block holds its nodes' in-edges as packed positions; a
round sends it, of all other nodes, only the shares of those its edges come from, each
once.  So a round shuffles packed numbers: a few bytes an edge, no names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, ship, written

#: In-edges of a block, in the mean.
BLOCK_EDGES = 2_000_000
SEEDS = 8


def hashed(id_: Column, seed: int) -> Column:
    return F.xxhash64(id_) if not seed else F.xxhash64(id_, F.lit(seed))


def ends(links: DataFrame) -> DataFrame:
    """(id) of both ends of links (src, dst)."""
    return links.select(F.explode(F.array("src", "dst")).alias("id"))


def distinct_hashes(nodes: DataFrame) -> int | None:
    """A seed that gives all ids of nodes (id) hashes of their own."""
    for seed in range(SEEDS):
        if nodes.groupBy(hashed(F.col("id"), seed).alias("h")).count().where("count > 1").isEmpty():
            return seed
    raise RuntimeError("hashes of ids meet, whatever the seed")


def _binary(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _packed(blocks: int):
    """Rows (block, kind, a, b) of whole blocks to (block, other, hashes, out, begin, index): the block itself, and what it needs of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
        if not columns:
            return
        own, degree, a, b = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        for block in np.unique(own):
            here = own == block
            edge = here & ~degree
            to, source, left, out = a[edge], b[edge], a[here & degree], b[here & degree]
            nodes = np.unique(np.concatenate([to, left]))
            outs = np.zeros(len(nodes), dtype=np.int64)
            outs[np.searchsorted(nodes, left)] = out
            place = np.searchsorted(nodes, to)
            begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(nodes)))])
            needed, index = np.unique(source, return_inverse=True)
            home = needed % blocks
            order = np.argsort(home, kind="stable")  # by block, then by hash
            position = np.empty(len(order), dtype=np.int64)
            position[order] = np.arange(len(order))
            index = position[index][np.argsort(place, kind="stable")]
            yield pa.RecordBatch.from_pylist([{"block": int(block), "other": -1, "hashes": _binary(nodes, np.int64), "outs": _binary(outs, np.int64), "begin": _binary(begin, np.int64), "index": _binary(index, np.int32)}], _PACKED)
            needed, home = needed[order], home[order]
            for other in np.unique(home):
                yield pa.RecordBatch.from_pylist([{"block": int(other), "other": int(block), "hashes": _binary(needed[home == other], np.int64), "outs": None, "begin": None, "index": None}], _PACKED)

    return run


_PACKED = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("hashes", pa.binary()), ("outs", pa.binary()), ("begin", pa.binary()), ("index", pa.binary())])
_ROUND = pa.schema([("block", pa.int32()), ("source", pa.int32()), ("value", pa.binary()), ("loose", pa.float64()), ("change", pa.float64())])
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i] for j in range(batch.num_columns))


def _sent(block: int, rank: np.ndarray, outs: np.ndarray, asked, change: float) -> Iterator[pa.RecordBatch]:
    """A block's ranks for itself, and to each block that asked the shares of the nodes it asked for."""
    yield pa.RecordBatch.from_pylist([{"block": block, "source": -1, "value": _binary(rank, np.float64), "loose": float(rank[outs == 0].sum()), "change": change}], _ROUND)
    share = rank / np.maximum(outs, 1)
    for one in asked:
        yield pa.RecordBatch.from_pylist([{"block": one["other"].as_py(), "source": block, "value": _binary(share[np.frombuffer(one["places"].as_buffer(), np.int32)], np.float64), "loose": None, "change": None}], _ROUND)


def pagerank(links: DataFrame, nodes: DataFrame, damping: float, iterations: int, tol: float) -> DataFrame:
    """(id, rank) of nodes (id); links (src, dst) are a table that was written, and so are nodes."""
    spark = links.sparkSession
    ship(spark)
    n, total = nodes.count(), links.count()
    if not n:
        return spark.createDataFrame([], "id string, rank double")
    seed = distinct_hashes(nodes)
    blocks = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK_EDGES))
    of_block = lambda h: F.pmod(h, F.lit(blocks)).cast("int").alias("block")
    ends = links.select(hashed(F.col("src"), seed).alias("s"), hashed(F.col("dst"), seed).alias("t"))
    degrees = ends.groupBy("s").agg(F.count("*").alias("out"))
    rows = ends.select(of_block(F.col("t")), F.lit(False).alias("degree"), F.col("t").alias("a"), F.col("s").alias("b")).union(degrees.select(of_block(F.col("s")), F.lit(True), "s", "out"))
    packed = written(rows.repartitionById(blocks, F.col("block")).mapInArrow(_packed(blocks), _ddl(_PACKED)), "packed")
    asked = packed.where("other >= 0").groupBy("block").agg(F.collect_list(F.struct("other", "hashes")).alias("asked"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("other", pa.int32()), ("places", pa.binary())]))
        for block, hashes, outs, begin, index, asked_ in _rows(batches):
            own = np.frombuffer(hashes.as_buffer(), np.int64)
            places = [{"other": x["other"].as_py(), "places": _binary(np.searchsorted(own, np.frombuffer(x["hashes"].as_buffer(), np.int64)), np.int32)} for x in asked_] if asked_.is_valid else []
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), *(pa.array([x.as_py()], pa.binary()) for x in (outs, begin, index)), pa.array([places], kind)], names=["block", "outs", "begin", "index", "asked"])

    whole = packed.where("other < 0").select("block", "hashes", "outs", "begin", "index").join(asked, "block", "left")
    static = written(whole.mapInArrow(placed, "block int, outs binary, begin binary, index binary, asked array<struct<other int, places binary>>"), "static")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, outs, asked_ in _rows(batches):
            own = np.frombuffer(outs.as_buffer(), np.int64)
            yield from _sent(block.as_py(), np.full(len(own), 1 / n), own, asked_, 0.0)

    sent = written(static.select("block", "outs", "asked").mapInArrow(first, _ddl(_ROUND)), "ranks")
    for _ in range(iterations):
        loose = sent.where("source < 0").agg(F.sum("loose")).first()[0]

        def step(batches: Iterator[pa.RecordBatch], loose=loose) -> Iterator[pa.RecordBatch]:
            for block, outs, begin, index, asked_, got in _rows(batches):
                own, start, at = np.frombuffer(outs.as_buffer(), np.int64), np.frombuffer(begin.as_buffer(), np.int64), np.frombuffer(index.as_buffer(), np.int32)
                by = sorted(((x["source"].as_py(), np.frombuffer(x["value"].as_buffer(), np.float64)) for x in got), key=lambda x: x[0])
                rank, shares = by[0][1], np.concatenate([v for _, v in by[1:]]) if len(by) > 1 else np.zeros(0)
                moved = np.bincount(np.repeat(np.arange(len(own)), np.diff(start)), weights=shares[at], minlength=len(own))
                new = (1 - damping) / n + damping * (moved + loose / n)
                yield from _sent(block.as_py(), new, own, asked_, float(np.abs(new - rank).sum()))

        got = sent.groupBy("block").agg(F.collect_list(F.struct("source", "value")).alias("got"))
        fresh = written(static.join(got, "block").mapInArrow(step, _ddl(_ROUND)), "ranks")
        discard(sent)
        sent = fresh
        if sent.where("source < 0").agg(F.sum("change")).first()[0] < tol:
            break

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, value in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes.as_buffer(), np.int64)), pa.array(np.frombuffer(value.as_buffer(), np.float64))], names=["h", "rank"])

    last = packed.where("other < 0").select("block", "hashes").join(sent.where("source < 0").select("block", "value"), "block").select("hashes", "value").mapInArrow(named, "h long, rank double")
    return nodes.select("id", hashed(F.col("id"), seed).alias("h")).join(last, "h").select("id", "rank")


#: Edges that a task of components() folds at a time.
FOREST_EDGES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to fewer that join the same nodes: each node but the least of its tree to that."""

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while len(a):
            low = label.copy()
            np.minimum.at(low, a, b)
            np.minimum.at(low, b, a)
            while not ((deeper := low[low]) == low).all():
                low = deeper
            label = low[label]
            a, b = low[a], low[b]
            apart = a != b
            a, b = a[apart], b[apart]
        moved = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield folded(held)
            held, n = [], 0
    if n:
        yield folded(held)


#: Names of so many components are broadcast.
NAMED = 500_000


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of nodes (id); links (src, dst) are a table that was written, and so are nodes."""
    ship(links.sparkSession)
    seed = distinct_hashes(nodes)
    pairs = links.select(hashed(F.col("src"), seed).alias("u"), hashed(F.col("dst"), seed).alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long")
    links = written(pairs.distinct(), "links")
    state = None
    while True:
        # larger neighbours join the least neighbour; then all smaller ones join the least of them
        both = links.select("u", "v").union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "links")
        discard(links)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = written(small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct(), "links")
        discard(large)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.groupBy("u").agg(F.min("v").alias("v"))
    labelled = nodes.select("id", hashed(F.col("id"), seed).alias("h")).join(roots, F.col("h") == F.col("u"), "left").select("id", F.coalesce("v", "h").alias("root"))
    labelled = written(labelled, "labelled")
    names = written(labelled.groupBy("root").agg(F.min("id").alias("component")), "names")
    return labelled.join(F.broadcast(names) if names.count() <= NAMED else names, "root").select("id", "component")
