"""Near-duplicate lines across the corpus: an exact set-similarity join with prefix filtering.

1. Token frequencies are counted over the whole corpus in a fixed number of
   hashed counters, which give one total order of tokens, rarest first, that
   every worker shares.  The counters are broadcast; their size is fixed.
2. Lines with the same set of tokens are one set from here on, known by its
   first occurrence.
3. Of every distinct set the prefix goes out, token by token.  Two sets whose
   Jaccard reaches the threshold share a token of both prefixes.  A token whose
   counter is 1 occurs once in the corpus, can join nothing, and stays home.
4. Sets that share a prefix token are compared by size (length filter), by the
   positions of that token (positional filter), and by a 64-bit map of the parities
   of their hashed tokens: a bit that differs stands for a token that one alone has.
   Pairs left are compared once more by a map of four times 64 bits.
   The sets of a token that is frequent are parted in blocks, any two of which meet
   in a bucket of their own.  Prefixes travel packed by buckets of tokens, not row by row.
5. The candidates of a line are verified on full token sets from the earliest one
   on, in rounds of growing length, until one matches: what comes after it needs no
   look.  Each line's text is fetched once, for all rounds, and only texts of lines
   that have candidates are; they make the larger maps, too.

A line is removed if an earlier line, by (doc_id, position), has a Jaccard of the
threshold at least with it, whether or not that earlier line is itself removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, ship, written
from .tokens import common, distinct_in_rows, freed, mix64, order_in_rows, slices, words_of

THRESHOLD = 0.8
#: Counters of token frequencies.
COUNTERS = 1 << 21
COUNTER_PARTS = 16
#: Pairs looked at side by side, rows of the prefix index that a task packs at once, and rows of a bucket of it, which is in hand as a whole.
PAIRS = 1 << 17
PREFIX_ROWS = 1 << 19
BUCKET_ROWS = 1 << 18
#: A token of more occurrences in the corpus has its sets parted in blocks, one for each so many occurrences.
HOT = 1 << 20
BLOCKS = 32
#: Candidates of a line that one task verifies.
CHUNK = 4096
#: Bits of a set's size, and of size and part together, in a key of the prefix index.
SIZE_BITS = 26
KEY_BITS = SIZE_BITS + 2 * (BLOCKS - 1).bit_length()
#: Columns of the prefix index.
PACKED = [("key", "<u8"), ("place", "<u4"), ("block", "u1"), ("id", "<u8"), ("parity", "<u8")]
#: Bits, at most, that tell the places of lines whose texts are fetched, and parts they are gathered in.
PLACE_BITS = 1 << 27
PLACE_PARTS = 16
#: 64-bit words of the larger map of a set's parities.
WIDE = 4
WIDE_NAMES = [f"wide{k}" for k in range(WIDE)]
#: By how much rounds of verification grow.
GROWTH = 8
#: Matches a text that has a word, as tokens.words_of() understands it.
HAS_WORD = r"[A-Za-z0-9]|[^\x00-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]"


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines of all rows, offsets of the rows); a null text has no line, an empty one a single empty line."""
    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_flatten(lists)
    count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lines, np.concatenate([[0], np.cumsum(count)])


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


@dataclass
class Sets:
    """Distinct tokens of lines, sorted within each; name: a 64-bit sum that names a line's set (0 if empty); wide: its map of parities, by columns."""

    token: np.ndarray
    row: np.ndarray
    bounds: np.ndarray
    size: np.ndarray
    name: np.ndarray
    wide: np.ndarray
    all_tokens: np.ndarray


def names_of(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The names of sets of distinct tokens, whatever the order within each."""
    name = np.zeros(len(bounds) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        name[full] = np.add.reduceat(mix64(token), bounds[:-1][full])
    return name


def token_sets(lines: pa.Array, *, with_wide: bool = False) -> Sets:
    words = words_of(lines)
    n = len(lines)
    token, row, bounds = distinct_in_rows(np.repeat(np.arange(n), np.diff(words.offsets)), words.hashes, n)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    wide = np.zeros((WIDE, n), dtype=np.uint64)
    if with_wide and len(full):
        bit, word = np.uint64(1) << ((token >> np.uint64(6)) & np.uint64(63)), (token >> np.uint64(12)) % np.uint64(WIDE)
        for k in range(WIDE):
            wide[k, full] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), bounds[:-1][full])
    return Sets(token, row, bounds, size, names_of(token, bounds), wide, words.hashes)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of which a set of that size shares one at least with any set that reaches the threshold."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over docs (doc_id long, text, text_hash): a row for each line with a token,
    and, with a null line, rows of the token counters of each task, in parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in freed(batches):
            for part in slices(batch, 1):
                text, offsets = split_lines(part.column(1))
                sets = token_sets(text)
                np.add.at(total, counter_of(sets.all_tokens), 1)
                full = np.flatnonzero(sets.size)
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                yield _batch(
                    part.column(0).take(pa.array(row[full])),
                    part.column(2).take(pa.array(row[full])),
                    (np.arange(len(row)) - offsets[:-1][row])[full].astype(np.int32),
                    sets.name[full].view(np.int64),
                    sets.size[full].astype(np.int32),
                    pa.nulls(len(full), pa.binary()),
                )
        width = COUNTERS // COUNTER_PARTS
        none = pa.nulls(COUNTER_PARTS, pa.int64())
        counts = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(COUNTER_PARTS)]
        yield _batch(none, none, pa.nulls(COUNTER_PARTS, pa.int32()), none, pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(counts, pa.binary()))

    return docs.mapInArrow(scan, "doc_id long, text_hash long, line int, id long, size int, counts binary")


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "text_hash", "line", "id", "size", "counts"])


def _frequencies(scanned: DataFrame) -> np.ndarray:
    """The tasks' counters, summed part by part; their number is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(v.as_buffer()), dtype=np.int64)
                total[k] = total[k] + counts if k in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])

    parts = scanned.where("line IS NULL").select(F.col("size").alias("part"), "counts")
    width = COUNTERS // COUNTER_PARTS
    out = np.zeros(COUNTERS, dtype=np.int64)
    for part, counts in parts.repartition(COUNTER_PARTS, "part").mapInArrow(add, "part int, counts binary").toLocalIterator():
        out[part * width : (part + 1) * width] += np.frombuffer(zlib.decompress(counts), dtype=np.int64)
    return out


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Ranks of frequencies, below 2 ** 12; 0 for a frequency of 1 or none."""
    return np.minimum(np.floor(64 * np.log2(np.maximum(counts, 1))), 4095).astype(np.uint16)


def blocks_of(counts: np.ndarray) -> np.ndarray:
    """Blocks of the sets of tokens with that many occurrences."""
    return np.minimum(np.ceil(counts / HOT), BLOCKS).astype(np.int64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of the types of PACKED, byte plane by byte plane: planes that hardly vary cost little once they are compressed."""
    return b"".join(c.astype(kind, copy=False).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, kind) in zip(columns, PACKED, strict=True))


def unpack(data: bytes | memoryview) -> list[np.ndarray]:
    widths = [np.dtype(kind).itemsize for _, kind in PACKED]
    n, at, out = len(data) // sum(widths), 0, []
    for width, (_, kind) in zip(widths, PACKED, strict=True):
        planes = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def buckets_of(counts: np.ndarray, threshold: float) -> int:
    """Buckets of the prefix index, each of about BUCKET_ROWS rows at most as long as no token alone has more."""
    return int(np.ceil(counts.sum() * min(1.0, 1.25 * (1 - threshold)) / BUCKET_ROWS)) + 1


def _prefixes(docs: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(bucket, data): the prefix tokens of every line, packed by buckets of tokens; see PACKED.

    key holds, from the highest bits on, bits of the token's hash, the part, and the
    set's size; place: the token's in the set, rarest first.  part: the two blocks of
    sets that meet, first * BLOCKS + second; 0 for tokens that aren't parted.  block:
    the set's own.  Tokens of one bucket whose bits are the same only make candidates more.
    """
    # 3 bytes a counter, whatever the size of the corpus
    shared = docs.sparkSession.sparkContext.broadcast((rank_of(counts), blocks_of(counts).astype(np.uint8)))
    buckets = np.uint64(buckets_of(counts, threshold))

    def rows_of(lines: pa.Array) -> list[np.ndarray]:
        rank_by_counter, blocks_by_counter = shared.value
        words = words_of(lines)
        n = len(lines)
        row = np.repeat(np.arange(n), np.diff(words.offsets))
        rank = rank_by_counter[counter_of(words.hashes)]
        order = order_in_rows(row, words.hashes, rank)
        token, row, rank = words.hashes[order], row[order], rank[order]
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        token, row, rank = token[first], row[first], rank[first]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        size, name, parity = np.diff(bounds), names_of(token, bounds), np.zeros(n, dtype=np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            parity[full] = np.bitwise_xor.reduceat(np.uint64(1) << (token & np.uint64(63)), bounds[:-1][full])
        # the same set within a slice goes out once
        once = np.zeros(n, dtype=bool)
        once[np.unique(name, return_index=True)[1]] = True
        place = np.arange(len(token)) - bounds[:-1][row]
        chosen = np.flatnonzero((place < np.where(once, prefix_length(size, threshold), 0)[row]) & (rank > 0))
        owner, token, place = row[chosen], token[chosen], place[chosen]
        blocks = np.maximum(blocks_by_counter[counter_of(token)].astype(np.int64), 1)
        mine = (mix64(name[owner]) % blocks.astype(np.uint64)).astype(np.int64)
        # a set meets those of every block, its own too
        again = np.repeat(np.arange(len(token)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine, owner = mine[again], owner[again]
        part = (np.minimum(mine, other) * BLOCKS + np.maximum(mine, other)).astype(np.uint64)
        mixed = mix64(token[again] + part * np.uint64(0x9E3779B97F4A7C15))
        key = (mixed >> np.uint64(KEY_BITS) << np.uint64(KEY_BITS)) | (part << np.uint64(SIZE_BITS)) | size[owner].astype(np.uint64)
        return [(mixed & np.uint64((1 << KEY_BITS) - 1)) % buckets, key, place[again], mine, name[owner], parity[owner]]

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        bucket, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((columns[0], bucket))
        bucket, columns = bucket[order], [c[order] for c in columns]
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        data = [pack([c[i:j] for c in columns]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in freed(batches):
            for piece in slices(batch, 1):
                held.append(rows_of(split_lines(piece.column(1))[0]))
                rows += len(held[-1][0])
                if rows >= PREFIX_ROWS:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    return docs.mapInArrow(prefix, "bucket int, data binary")


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of sets that share a prefix token and pass the filters, x the smaller one; a pair comes once for each such token."""

    def pairs_of(key: np.ndarray, place: np.ndarray, block: np.ndarray, name: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((name, key))
        key, place, block, name, parity = (c[order] for c in (key, place.astype(np.int64), block, name, parity))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (place[1:] != place[:-1])  # lines of the same set are one
        key, place, block, name, parity = (c[fresh] for c in (key, place, block, name, parity))
        part = (key >> np.uint64(SIZE_BITS)).astype(np.int64) & (BLOCKS * BLOCKS - 1)
        apart = part // BLOCKS != part % BLOCKS  # two blocks, of which only sets of different ones meet here
        size = (key & np.uint64((1 << SIZE_BITS) - 1)).astype(np.int64)
        # the length filter, and the positional one for the smaller set: what is left of it from the token on bounds the larger one's size
        longest = np.minimum(np.floor(size / threshold + 1e-9), np.floor((size - place) * (1 + threshold) / threshold + 1e-6) - size).astype(np.int64)
        reach = np.clip(longest, 0, (1 << SIZE_BITS) - 1).astype(np.uint64)
        end = np.searchsorted(key, (key - size.astype(np.uint64)) | reach, side="right")
        total = np.concatenate([[0], np.cumsum(np.maximum(end - np.arange(len(key)) - 1, 0))])
        at = 0
        while at < len(key):
            # as many rows as make about PAIRS pairs, one row at least
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
            count = np.diff(total[at : stop + 1])
            i = np.repeat(np.arange(at, stop), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(total[at:stop] - total[at], count)
            both = size[i] + size[j]
            overlap = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
            good = np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * overlap
            i, j, overlap = i[good], j[good], overlap[good]
            good = np.minimum(size[i] - place[i], size[j] - place[j]) >= overlap
            good &= (name[i] != name[j]) & (~apart[i] | (block[i] != block[j]))
            i, j = i[good], j[good]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(name[i].view(np.int64)), pa.array(name[j].view(np.int64))], names=["x", "y"])
            at = stop

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None
        for batch in freed(batches):
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != now:
                    yield from pairs_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                now = bucket
                held.append(unpack(data.as_buffer()))
        if held:
            yield from pairs_of(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return prefixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "x long, y long")


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: (late, rank, text), sorted by late: the late line's own text (rank 0), then its candidates'; gives those that match."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the own text of the line that the last slice ended in
        for batch in freed(batches):
            for part in slices(batch, 2):
                late, rank = (part.column(i).to_numpy() for i in range(2))
                if carried is not None:
                    late, rank = np.append(carried[0], late), np.append(np.int32(0), rank)
                    text = pa.concat_arrays([carried[1], part.column(2)])
                else:
                    text = part.column(2)
                sets = token_sets(text)
                own = np.flatnonzero(rank == 0)
                carried = (late[own[-1]], text.slice(int(own[-1]), 1))
                other = np.flatnonzero(rank > 0)
                mine = own[np.searchsorted(own, other) - 1]
                if (late[mine] != late[other]).any():
                    raise ValueError("a candidate without the line it is compared with")
                same = common(sets.token, sets.bounds, other, mine)
                jaccard = same / np.maximum(sets.size[mine] + sets.size[other] - same, 1)
                hit = jaccard >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(late[other][hit]), pa.array(rank[other][hit]), pa.array(jaccard[hit])], names=["late", "rank", "jaccard"])

    return rows.mapInArrow(check, "late long, rank int, jaccard double")


def place_hash(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc_id.view(np.uint64)) + line.astype(np.uint64))


def _places(known: DataFrame) -> np.ndarray:
    """A bit for the hash of each set's first place, in bytes; their number has a bound, beyond which more places share a bit."""
    bits = min(max(16 * known.count(), 1 << 16), PLACE_BITS)
    bits = 1 << (bits - 1).bit_length()
    width = bits // PLACE_PARTS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = (place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit // width).astype(np.int32)), pa.array((bit % width).astype(np.int32))], names=["part", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(part).tolist():
                total.setdefault(k, np.zeros(width, dtype=bool))[bit[part == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x).tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    rows = known.select("first.doc_id", "first.line").mapInArrow(hashed, "part int, bit int").repartition(PLACE_PARTS, "part")
    for part, found in rows.mapInArrow(gather, "part int, bits binary").toLocalIterator():
        out[part * (width // 8) : (part + 1) * (width // 8)] = np.frombuffer(found, dtype=np.uint8)
    return out


def _texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, first, size, text, larger map) of the sets in known (id, first, size).

    Of the documents only lines at a place whose bit is set go out.  Rows that share a
    doc_id may offer other lines, so a text's set tells.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_places(known))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in freed(batches):
            for part in slices(batch, 1):
                text, offsets = split_lines(part.column(1))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                doc, line = part.column(0).to_numpy()[row], (np.arange(len(row)) - offsets[:-1][row]).astype(np.int32)
                bit = (place_hash(doc, line) & np.uint64(8 * len(places) - 1)).astype(np.int64)
                hit = np.flatnonzero(places[bit >> 3] & (128 >> (bit & 7)))
                text = text.take(pa.array(hit))
                sets = token_sets(text, with_wide=True)
                columns = [sets.name.view(np.int64), doc[hit], line[hit], text, *(w.view(np.int64) for w in sets.wide)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["id", "doc_id", "line", "text", *WIDE_NAMES])

    picked = docs.mapInArrow(pick, f"id long, doc_id long, line int, text string, {', '.join(f'{w} long' for w in WIDE_NAMES)}")
    there = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.line") == F.col("line"))
    return picked.join(known, "id").where(there).select("id", "first", "size", "text", *WIDE_NAMES).dropDuplicates(["id"])


def _earliest(texts: DataFrame, pairs: DataFrame, threshold: float) -> list[DataFrame]:
    """Tables (late, match, jaccard) of each line's earliest match, a table a round."""
    longest = pairs.agg(F.max("rank")).first()[0] or 0
    found: list[DataFrame] = []
    low, high = 0, 1
    while low < longest:
        now = pairs.where((F.col("rank") > low) & (F.col("rank") <= high)).select("late", "rank", "early", F.floor(F.col("rank") / CHUNK).alias("chunk"))
        for done in found:
            now = now.join(done.select("late"), "late", "left_anti")
        now = written(now, "line-round")
        own = now.select("late", "chunk").distinct().join(texts, F.col("late") == F.col("id")).select("late", "chunk", F.lit(0).alias("rank"), "text")
        others = now.join(texts, F.col("early") == F.col("id")).select("late", "chunk", "rank", "text")
        ready = own.union(others).repartition("late", "chunk").sortWithinPartitions("late", "chunk", "rank").select("late", "rank", "text")
        best = _verify(ready, threshold).groupBy("late").agg(F.min(F.struct("rank", "jaccard")).alias("best")).select("late", "best.*")
        named = best.join(pairs.select("late", "rank", F.col("early_first").alias("match")), ["late", "rank"]).select("late", "match", "jaccard")
        found.append(written(named, "line-matches"))
        discard(now)
        low, high = high, high * GROWTH
    return found


def later_lines(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, match_doc_id, match_line, jaccard) of every line that an earlier line matches.

    Lines are what newlines separate, numbered from 0 in each document, and are
    compared as sets of words; "earlier" is by (doc_id, line).  Of all earlier
    matches the earliest is named.

    Lines without a word (blank ones, those of null and empty texts) match nothing.
    Rows without a doc_id are left out.  Rows that share a doc_id and a line number
    stand at the same place: neither is later than the other.  An empty table gives
    no rows.  Other columns of docs are ignored.
    """
    return _later(docs, threshold).drop("text_hash")


def _later(docs: DataFrame, threshold: float) -> DataFrame:
    """As later_lines(), with the text_hash of the row that has the line."""
    ship(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    scanned = written(_scan(docs.withColumn("text_hash", F.xxhash64("text"))), "lines")
    lines = scanned.where("line IS NOT NULL").drop("counts")
    counts = _frequencies(scanned)
    candidates = written(_candidates(_prefixes(docs, counts, threshold), threshold).distinct(), "line-candidates")
    sets = written(lines.groupBy("id").agg(F.first("size").alias("size"), F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("held")), "line-sets")
    paired = candidates.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    known = written(sets.join(paired, "id").select("id", "first", "size"), "line-known")
    texts = written(_texts(docs, known), "line-texts")
    discard(known)
    side = lambda s: texts.select(F.col("id").alias(s), F.col("first").alias(f"{s}_first"), F.col("size").alias(f"{s}_size"), *(F.col(w).alias(f"{s}_{w}") for w in WIDE_NAMES))
    placed = candidates.join(side("x"), "x").join(side("y"), "y")
    both = F.col("x_size") + F.col("y_size")
    apart = sum(F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in WIDE_NAMES)
    placed = placed.where(apart <= both - 2 * F.ceil(threshold / (1 + threshold) * both - 1e-9))
    ahead = F.col("x_first") < F.col("y_first")
    placed = placed.select(*(F.when(ahead, b).otherwise(a).alias(name) for name, a, b in (("late", F.col("x"), F.col("y")), ("late_first", F.col("x_first"), F.col("y_first")), ("early", F.col("y"), F.col("x")), ("early_first", F.col("y_first"), F.col("x_first")))))
    # sets whose firsts stand at one place, of rows that share a doc_id, aren't later than one another
    placed = placed.where("early_first < late_first").drop("late_first").withColumn("rank", F.row_number().over(Window.partitionBy("late").orderBy("early_first", "early")))
    pairs = written(placed, "line-pairs")
    discard(candidates)
    nearest = None
    for table in _earliest(texts, pairs, threshold):
        nearest = table if nearest is None else nearest.union(table)
    discard(pairs, texts)
    if nearest is None:
        nearest = sets.where("false").select(F.col("id").alias("late"), F.col("first").alias("match"), F.lit(1.0).alias("jaccard"))
    nearest = nearest.select(F.col("late").alias("id"), F.struct("match", "jaccard").alias("near"))
    earliest = sets.where("held > 1").select("id", "first").join(nearest, "id", "full").select("id", F.coalesce("near", F.struct(F.col("first").alias("match"), F.lit(1.0).alias("jaccard"))).alias("best"))
    return (
        lines.join(earliest, "id")
        .where(F.struct("doc_id", "line") > F.col("best.match"))
        .select("doc_id", "text_hash", "line", F.col("best.match.doc_id").alias("match_doc_id"), F.col("best.match.line").alias("match_line"), F.col("best.jaccard").alias("jaccard"))
    )


def remove_later_lines(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the lines that later_lines() names; all other rows and columns as they are.

    A document that had a word and has none left goes.  Documents of which nothing
    is removed (with null or empty texts, or without a doc_id, too) are untouched;
    n_chars, if docs has it, follows the text.  Of rows that share a doc_id each loses
    its own lines alone.  No column's name of docs clashes with those used inside.
    """
    gone = _later(docs, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(gone, (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash")), "left")
    kept = F.expr("array_join(filter(split(row.text, '\n', -1), (x, i) -> NOT array_contains(lines, i)), '\n')")
    changed = F.col("lines").isNotNull()
    out = joined.withColumn("kept", F.when(changed, kept)).where(~changed | F.col("kept").rlike(HAS_WORD))
    follow = {"text": F.col("kept"), "n_chars": F.length("kept")}
    columns = [F.when(changed, follow[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c) if c in follow else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
