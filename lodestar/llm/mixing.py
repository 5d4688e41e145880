"""Mixing sources to target weights by Sainte-Lague apportionment.

The tokens of a source, its documents in a seeded order, are cut into blocks of
equal size; seats (blocks) go to the sources by the highest quotients
weight / (2 k + 1), up to a stated share of all blocks; a source that has no block
left drops out and the others go on.  As the method is house-monotone, the first
seats are the quota of shard 0, the next ones that of shard 1, and so on: each shard
follows the target weights by itself.  Which blocks of a source fill its seats is a
second seeded order.

Only totals reach the driver, one row a source.  The running token count inside a
source, and the rank of a block in the second order, are taken in two levels, first
over buckets of the order and then inside a bucket, so that no source, however hot,
has to pass through a single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Leading hexadecimal digits of the seeded order that make a bucket's name.
BUCKET_DIGITS = 3
#: The share of all blocks that is selected.
KEEP = 0.8


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, newline and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def integer_weights(totals: dict[str, int], alpha: float) -> dict[str, int]:
    """tokens ** alpha for each source, scaled so that the largest is 1,000,000; 1 at least."""
    top = max(totals.values(), default=0)
    return {s: max(1, math.floor(1_000_000 * (n / top) ** alpha + 0.5)) for s, n in totals.items() if n > 0}


def quotas(weights: dict[str, int], blocks: dict[str, int], shards: int, total: int | None = None) -> dict[str, list[int]]:
    """Seats of each source up to the end of each shard.

    Without a total, the house is the largest in which no source needs more blocks
    than it has, cut down to a multiple of shards: it ends for all sources where the
    first one runs out, so that a tiny source can cut most of a corpus off.  With a
    total, a source that runs out drops out and the others go on by the highest
    quotients up to so many seats, or all blocks there are; shards then differ by one
    seat at most, and those after the first source ran out no longer hold the weights.

    Equal quotients go to the source whose name sorts first.  A source without
    blocks takes no part; a source without a positive weight gets nothing.
    """
    names = sorted(s for s in weights if blocks.get(s, 0) > 0 and weights[s] > 0)
    if not names:
        return {}
    # the first seat that some source could not fill ends the house, unless a total is stated
    end = min((-weights[s] / (2 * blocks[s] + 1), s) for s in names) if total is None else (math.inf, "")

    def seats(limit: tuple[float, str]) -> dict[str, int]:
        """For each source, its seats that come before the seat with this (-quotient, name)."""
        out = {}
        for s in names:
            low, high = 0, blocks[s]
            while low < high:
                mid = (low + high) // 2
                if (-weights[s] / (2 * mid + 1), s) < limit:
                    low = mid + 1
                else:
                    high = mid
            out[s] = low
        return out

    house = sum(seats(end).values())
    result: dict[str, list[int]] = {s: [] for s in names}
    for shard in range(1, shards + 1):
        want = house // shards * shard if total is None else min(total, house) * shard // shards
        # every seat is known by (source, k); find the want-th in order by bisecting each source's seats
        best = seats(end) if want >= house else _first(want, names, weights, blocks, seats)
        for s in names:
            result[s].append(best[s])
    return result


def _first(want: int, names: list[str], weights: dict[str, int], blocks: dict[str, int], seats) -> dict[str, int]:
    """The seats of each source among the first so many."""
    for s in names:
        low, high = 0, blocks[s]
        while low < high:
            mid = (low + high) // 2
            if sum(seats((-weights[s] / (2 * mid + 1), s)).values()) < want:
                low = mid + 1
            else:
                high = mid
        if low < blocks[s] + 1 and sum((got := seats((-weights[s] / (2 * low + 1), s))).values()) == want:
            return got
    return seats((math.inf, ""))


def _key(seed: str, *parts: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), *parts))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    *,
    block_tokens: int = 1024,
    shards: int = 8,
    alpha: float = 0.7,
    seed: str = "17",
    keep: float | None = KEEP,
) -> DataFrame:
    """(doc_id, source, n_tokens, block, shard) of every document selected.

    A document belongs to the block of its source in which its first token
    lies.  weights: integer weights by source; where absent, tokens ** alpha.
    keep: the share of the blocks of all weighted sources to select, rounded up,
    whichever of them run out; where None, the selection ends with the first that
    does, at a multiple of shards, so that fewer blocks than shards give nothing
    (see quotas()).

    A null source counts as the source "".  Rows without a doc_id are left out.
    A document without tokens (null or empty text) weighs nothing and goes with
    the block it falls in.  Rows that share source and doc_id are counted each but
    fall into the same block, that of the first of them.  An empty table gives no
    rows.  Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    # a written table, since the counts are read three times and cost a scan of all texts
    rows = written(
        docs.where(F.col("doc_id").isNotNull()).select(
            "doc_id",
            F.coalesce(F.col("source"), F.lit("")).alias("source"),
            token_count(F.col("text")).alias("n_tokens"),
            _key(seed, F.col("doc_id").cast("string")).alias("place"),
        ),
        "mix",
    )
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("bucket_tokens"))
    order = Window.partitionBy("source").orderBy("bucket")
    before = sums.select("source", "bucket", (F.sum("bucket_tokens").over(order) - F.col("bucket_tokens")).alias("bucket_before"))
    # up to a document's first row: all up to its last one, less its own
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id")) - F.sum("n_tokens").over(Window.partitionBy("source", "bucket", "place", "doc_id"))
    cut = (
        rows.withColumn("bucket", bucket)
        .withColumn("inside", inside)
        .join(before, ["source", "bucket"])
        .select("doc_id", "source", "n_tokens", F.floor((F.col("bucket_before") + F.col("inside")) / F.lit(block_tokens)).cast("bigint").alias("block"))
    )
    # blocks in which a document starts, ranked in their seeded order
    named = written(cut.select("source", "block").distinct().withColumn("key", _key(seed, "source", F.lit(":"), F.col("block").cast("string"))), "mix-blocks")
    key_bucket = F.substring("key", 1, BUCKET_DIGITS)
    held = named.groupBy("source", key_bucket.alias("bucket")).agg(F.count("*").alias("held"))
    ahead = held.select("source", "bucket", (F.sum("held").over(order) - F.col("held")).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "block"))
    blocks = named.withColumn("bucket", key_bucket).withColumn("rank", rank).join(ahead, ["source", "bucket"]).select("source", "block", (F.col("ahead") + F.col("rank") - 1).alias("seat"))
    has = {r[0]: r[1] for r in named.groupBy("source").count().collect()}
    totals = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()}
    weights = weights if weights is not None else integer_weights(totals, alpha)
    total = None if keep is None else math.ceil(keep * sum(n for s, n in has.items() if weights.get(s, 0) > 0))
    table = quotas(weights, has, shards, total)
    spans = [(s, k, ([0, *ends])[k], ends[k]) for s, ends in table.items() for k in range(len(ends)) if ends[k] > ([0, *ends])[k]]
    quota = spark.createDataFrame(spans, "source string, shard int, first_seat int, end_seat int")
    # one row a source and shard: small beside anything that is shuffled here
    chosen = blocks.join(F.broadcast(quota) if len(spans) <= 1_000_000 else quota, "source").where("seat >= first_seat AND seat < end_seat")
    return cut.join(chosen.select("source", "block", "shard"), ["source", "block"]).select("doc_id", "source", "n_tokens", "block", "shard")


def oracle(block_tokens: int = 1024, shards: int = 8, alpha: float = 0.7, seed: str = "17", keep: float = KEEP) -> str:
    """The same in SQL, over the view documents."""
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens,
         md5('{seed}:' || CAST(doc_id AS VARCHAR)) AS place
  FROM documents WHERE doc_id IS NOT NULL),
cut AS (
  SELECT doc_id, source, n_tokens,
         CAST(floor((sum(n_tokens) OVER (PARTITION BY source ORDER BY place, doc_id) - sum(n_tokens) OVER (PARTITION BY source, place, doc_id)) / {block_tokens}) AS BIGINT) AS block
  FROM rows),
blocks AS (
  SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5('{seed}:' || source || ':' || CAST(block AS VARCHAR))) - 1 AS seat
  FROM (SELECT DISTINCT source, block FROM cut)),
totals AS (SELECT source, sum(n_tokens) AS tokens FROM rows GROUP BY source HAVING sum(n_tokens) > 0),
weights AS (SELECT source, greatest(1, CAST(floor(1000000 * pow(tokens / (SELECT max(tokens) FROM totals), {alpha}) + 0.5) AS BIGINT)) AS weight FROM totals),
ranked AS (SELECT source, seat, row_number() OVER (ORDER BY weight / (2.0 * seat + 1)::DOUBLE DESC, source) AS place FROM blocks JOIN weights USING (source)),
house AS (SELECT CAST(ceil(CAST({keep} AS DOUBLE) * count(*)) AS BIGINT) AS house FROM ranked),
chosen AS (SELECT source, seat, CAST((place * {shards} + house - 1) // house - 1 AS INTEGER) AS shard FROM ranked, house WHERE place <= house)
SELECT doc_id, source, n_tokens, block, shard FROM cut JOIN blocks USING (source, block) JOIN chosen USING (source, seat)"""
