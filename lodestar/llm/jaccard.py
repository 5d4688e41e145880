"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

1. Each document's set of word n-grams is hashed, with two 64-bit sums that name
   the set and one MinHash band key for each band.  Documents with the same set
   are one group from here on (their Jaccard is 1), so copies cost nothing more.
2. Band keys are shuffled; keys that only one group has are dropped.  Two groups
   that share a key are a candidate pair in the first band whose key they share,
   and in no other, so no pair has to be made distinct.
3. The texts of groups that are in a pair go to the pair's band key, where all
   pairs of the key are verified on the full sets.  A key that many groups have is
   parted in blocks of them, any two of which meet in a task of their own.
4. Classes are what chains of verified pairs and copies link.

Bands and rows are chosen for the target recall at the threshold; see
choose_bands().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, ship, written
from .tokens import common, distinct_in_rows, freed, mix64, multipliers, rolling, slices, windows, words_of

GRAM = 3
THRESHOLD = 0.5
RECALL = 0.97
MAX_HASHES = 256
#: Groups of one band key whose texts a task compares with those of as many others.
BLOCK = 256


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, that find a pair at the threshold with that probability."""
    for rows in range(max_hashes, 0, -1):
        hit = threshold**rows
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-hit))) if hit < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    return max_hashes, 1


def grams_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, sorted in each row; offsets of the rows).

    A text of fewer than n words, but one at least, has one gram of all its words.
    """
    words = words_of(texts)
    count = np.diff(words.offsets)
    start, row = windows(words.offsets, n)
    gram = rolling(words.hashes, n)[start] if len(start) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = words.offsets[short]
        one = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            one[has] = mix64(one[has] * multipliers(n)[k] + words.hashes[at[has] + k])
        gram, row = np.concatenate([gram, one]), np.concatenate([row, short])
        again = np.argsort(row, kind="stable")
        gram, row = gram[again], row[again]
    gram, _, offsets = distinct_in_rows(row, gram, len(count))
    return gram, offsets


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, set_a, set_b, size, keys) of every document that has a word."""
    scale = multipliers(bands * rows)[: bands * rows]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, 1):
                gram, offsets = grams_of(part.column(1), n)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                at = offsets[:-1][full]
                with np.errstate(over="ignore"):
                    set_a = np.add.reduceat(gram, at)
                    set_b = np.add.reduceat(mix64(gram), at)
                    keys = np.empty((len(full), bands), dtype=np.uint64)
                    for band in range(bands):
                        key = np.full(len(full), band + 1, dtype=np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            low = np.minimum.reduceat(gram * scale[k], at)
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low)
                        keys[:, band] = key
                flat = pa.array(keys.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(full)), part.column(2).take(pa.array(full)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(size[full].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "text_hash", "set_a", "set_b", "size", "keys"],
                )

    return docs.mapInArrow(sign, "doc_id long, text_hash long, set_a long, set_b long, size int, keys array<long>")


def _verify(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """rows: (key, i, j, kind, a, b, text), sorted by all but the text; of a (key, i, j) come its texts (kind 0), then its pairs (kind 1)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []  # of the group in hand: the reps, ascending, and their sets

        def compared(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            names = np.array(ids)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            x, y = np.searchsorted(names, left), np.searchsorted(names, right)
            near = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            x, y = x[near], y[near]
            same = common(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), x, y)
            jaccard = same / (size[x] + size[y] - same)
            hit = jaccard >= threshold
            return pa.RecordBatch.from_arrays([pa.array(names[x[hit]]), pa.array(names[y[hit]]), pa.array(jaccard[hit])], names=["a", "b", "jaccard"])

        for batch in freed(batches):
            for part in slices(batch, 6):
                key, i, j, kind, left, right = (part.column(c).to_numpy() for c in range(6))
                edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(kind) != 0)) + 1
                gram, offsets = None, None
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), part.num_rows], strict=True):
                    if a == b:
                        continue
                    if (key[a], i[a], j[a]) != group:
                        group, ids, sets = (key[a], i[a], j[a]), [], []
                    if kind[a] == 1:
                        yield compared(left[a:b], right[a:b])
                        continue
                    if gram is None:
                        gram, offsets = grams_of(part.column(6), n)
                    for row in range(a, b):
                        mine = gram[offsets[row] : offsets[row + 1]]
                        # of a doc_id with several texts that of the group's set
                        if int(mine.sum().view(np.int64)) == right[row] and (not ids or ids[-1] != left[row]):
                            ids.append(left[row])
                            sets.append(mine.copy())

    return rows.mapInArrow(check, "a long, b long, jaccard double")


def _candidates(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, i, j, a, b): pairs a < b of groups that share a band key, in the first such band; i, j: the blocks that they are in."""
    named = groups.select(F.col("rep").alias("doc_id"), "text_hash", "set_a", "set_b")
    keys = signed.join(named, ["doc_id", "text_hash", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "keys")
    keys = written(keys, "bands")
    exploded = keys.select("rep", F.posexplode("keys").alias("band", "key"))
    held = exploded.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = written(exploded.join(held, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("held") / BLOCK)).cast("int")).drop("held"), "shared")
    # band keys hold the band's number, so that an earlier band in common shows as any key in common; keys of groups alone in them can't be
    busy = shared.join(shared.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("all")), "rep").join(keys, "rep")
    before = F.array_intersect(F.slice("keys", F.lit(1), F.col("band")), "all")
    sides = busy.select("rep", "key", "block", before.alias("before"))
    left = sides.select(F.col("rep").alias("a"), "key", F.col("block").alias("i"), F.col("before").alias("a_before"))
    right = sides.select(F.col("rep").alias("b"), "key", F.col("block").alias("j"), F.col("before").alias("b_before"))
    pairs = written(left.join(right, "key").where(F.col("a") < F.col("b")).where(~F.arrays_overlap("a_before", "b_before")).select("key", "i", "j", "a", "b"), "candidates")
    discard(keys, shared)
    return pairs


def near_groups(docs: DataFrame, *, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, text_hash, rep, held), a row for each document, of the groups with the same set of
    n-grams, and pairs (a, b, jaccard) of the groups' reps, a < b, whose Jaccard reaches the threshold.

    rep is the smallest doc_id of a group and held the number of its documents.
    """
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall, max_hashes)
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    signed = written(_signatures(docs.withColumn("text_hash", F.xxhash64("text")), n, bands, rows), "minhash")
    # a doc_id that stands on rows of different texts counts by the set that sorts first
    own = signed.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "size", "text_hash")).alias("own")).select("doc_id", "own.*")
    own = written(own, "own")
    first = F.min(F.struct("doc_id", "text_hash"))
    groups = written(own.groupBy("set_a", "set_b", "size").agg(first.alias("first"), F.count("*").alias("held")).select("set_a", "set_b", "size", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "held"), "groups")
    pairs = _candidates(signed, groups)
    discard(signed)
    needed = pairs.select("key", "i", "j", F.col("a").alias("rep")).union(pairs.select("key", "i", "j", F.col("b").alias("rep"))).distinct()
    # the set's hash goes along in b, to tell the rep's own text if its doc_id has several
    texts = needed.join(groups.select("rep", "set_a"), "rep").join(docs, F.col("rep") == F.col("doc_id")).select("key", "i", "j", F.lit(0).alias("kind"), F.col("rep").alias("a"), F.col("set_a").alias("b"), "text")
    both = texts.union(pairs.select("key", "i", "j", F.lit(1), "a", "b", F.lit(None).cast("string")))
    sorted_rows = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind", "a")
    verified = written(_verify(sorted_rows, n, threshold), "verified")
    discard(pairs)
    members = written(own.join(groups.drop("text_hash"), ["set_a", "set_b", "size"]).select("doc_id", "text_hash", "rep", "held"), "members")
    discard(own, groups)
    return members, verified


def jaccard_join(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, class_id, copies, links): one row for every document that another one matches.

    Two documents match if their n-gram sets have a Jaccard of the threshold at least.
    class_id: the smallest doc_id of all documents that a chain of matches leads to.
    copies: the other documents with the same set; links: all other documents that
    match this one, copies included, each counted once.

    Null texts, texts without a word, rows without a doc_id and documents that match
    no other have no row.  A doc_id on several rows is one document; if their texts
    differ, that counts whose set of n-grams sorts first.  An empty table gives no
    rows.  Other columns of docs are ignored.
    """
    members, verified = near_groups(docs, **parameters)
    groups = members.where("doc_id = rep").select("rep", "held")
    roots = components(verified.select("a", "b"))
    ends = verified.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(verified.select("b", "a"))
    # a group that matches another does so with all documents of it
    linked = ends.join(groups.select(F.col("rep").alias("other"), "held"), "other").groupBy("rep").agg(F.sum("held").alias("near"))
    classes = linked.join(roots, F.col("rep") == F.col("node")).select("rep", "near", "root")
    out = members.join(classes, "rep", "left").where("held > 1 OR root IS NOT NULL")
    copies = F.col("held") - 1
    return out.select("doc_id", F.coalesce("root", "rep").alias("class_id"), copies.alias("copies"), (copies + F.coalesce("near", F.lit(0))).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of pairs (a, b): root is the smallest node of its connected component.

    Alternates joining larger neighbours and smaller ones to the smallest, until
    nothing changes: a logarithmic number of rounds in practice, none of which
    gathers a component in one place.  Each round is written to the shared folder.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        # every node's larger neighbours join its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node and its smaller neighbours join the smallest of them
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(joined.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document, that with the smallest doc_id, of each group of near duplicates.

    A group is a class of jaccard_join(), which tells what matches nothing and stays.
    Of a doc_id on rows of different texts only the rows with the text that counts
    can go; rows that repeat, doc_id and text, stay or go together.  Columns stay as
    they are, whatever their names.
    """
    members, verified = near_groups(docs, **parameters)
    roots = components(verified.select("a", "b")).where("node <> root").select(F.col("node").alias("rep"), "root")
    gone = members.join(roots, "rep", "left").where("doc_id <> rep OR root IS NOT NULL").select(F.col("doc_id").alias("gone_id"), "text_hash")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = whole.join(gone, (F.col("row.doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("row.text") == F.col("text_hash")), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
