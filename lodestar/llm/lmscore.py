"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of all word n-grams up to the order are gathered from the whole corpus and
quantised to levels 1, 2, ... of a logarithmic scale; an n-gram of level q is
entered q times, as (n-gram, 1) ... (n-gram, q).  A count is read back by probing
(n-gram, 1), (n-gram, 2), ... until one is absent: it is never read too low, and too
high only by the filter's rate of false positives, which falls with each level.
Probabilities are interpolated from such counts.

The filter is split into shards by the n-grams' hashes.  It grows with the corpus:
up to BROADCAST_BYTES it is broadcast; beyond that its shards stay files in the
shared folder, and a worker maps (or reads) those it probes, one at a time.  Both
give the same scores.

Counting: every task sorts the hashes of about BUFFER_NGRAMS n-grams at once and
sends distinct ones with their counts, as one packed array for each shard, so that
neither a row nor an object is made for a single n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, ship
from .tokens import Words, freed, mix64, multipliers, slices, windows, words_of

ORDER = 2
#: Levels of the logarithmic scale: counts 1, 2-3, 4-7, ...
BASE = 2.0
BITS_PER_ENTRY = 12
PROBES = 5
BROADCAST_BYTES = 64 << 20
SHARD_INPUT_BYTES = 16 << 20
BUFFER_NGRAMS = 3_000_000
#: Text scored at once: the more, the fewer distinct n-grams are probed.
SCORE_BYTES = 4 << 20
#: Weight of the longest n-gram's estimate against that of the next shorter one.
INTERPOLATION = 0.6


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams within rows, positions of their last words)."""
    if n == 1:
        return mix64(words.hashes + np.uint64(1)), np.arange(len(words.hashes))
    start, _ = windows(words.offsets, n)
    total = np.zeros(max(0, len(words.hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        total += words.hashes[k : k + len(total)] * multipliers(n)[k]
    return mix64(total[start] + np.uint64(n)), start + n - 1


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the geometric middle of its range, 1 for the first, 0 for none."""
    return np.where(level <= 1, level, BASE ** (level - 0.5))


def _probe_words(hashes: np.ndarray, level: int | np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, bits in it) for (n-gram, level): all probes of an entry fall in one 64-bit word."""
    mixed = mix64(hashes + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(level).astype(np.uint64)))
    place = ((mixed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    mask = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return place.astype(np.int64), mask


def build_filter(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter's words for distinct n-grams and their counts."""
    level = level_of(counts)
    size = max(1, int(np.ceil(level.sum() * BITS_PER_ENTRY / 64)))
    out = np.zeros(size, dtype=np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        place, mask = _probe_words(hashes[level >= q], q, size)
        np.bitwise_or.at(out, place, mask)
    return out


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Levels of n-grams: probes of (n-gram, 1), (n-gram, 2), ... up to the first that is absent."""
    level = np.zeros(len(hashes), dtype=np.int64)
    live = np.arange(len(hashes))
    q = 1
    while len(live):
        place, mask = _probe_words(hashes[live], q, len(bits))
        live = live[(bits[place] & mask) == mask]
        level[live] = q
        q += 1
    return level


@dataclass
class Model:
    """files: path of each shard; bits: the shards themselves, where they are broadcast."""

    order: int
    tokens: int
    vocabulary: int
    files: list[str]
    bits: object | None
    entries: int
    bytes: int


def _write_file(path: str, bits: np.ndarray) -> None:
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        local = Path(urlparse(path).path)
        local.parent.mkdir(parents=True, exist_ok=True)
        temporary = local.with_name(f"{local.name}.{np.random.default_rng().integers(1 << 62):x}")
        bits.tofile(temporary)
        temporary.rename(local)  # a task that runs twice leaves one whole file
    else:
        system, at = pa.fs.FileSystem.from_uri(path)
        with system.open_output_stream(at) as out:
            out.write(bits.tobytes())


def _read_file(path: str) -> np.ndarray:
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return np.memmap(urlparse(path).path, dtype=np.uint64, mode="r")
    system, at = pa.fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as source:
        return np.frombuffer(source.read(), dtype=np.uint64)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (shards - 1).bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), dtype=np.int64)


def _packed(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, hashes, counts, words): distinct n-grams of a buffer, sorted, and their counts; words: 1-grams among all counted."""

    def pack(parts: list[np.ndarray], words: int) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        edge = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
        full = [i for i in range(shards) if edge[i + 1] > edge[i]]
        # bytes of the same weight side by side: the sorted hashes' high ones and the counts compress well
        planes = [np.ascontiguousarray(hashes[edge[i] : edge[i + 1]].view(np.uint8).reshape(-1, 8).T).tobytes() for i in full]
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(planes, pa.binary()), pa.array([counts[edge[i] : edge[i + 1]].astype(np.uint32).tobytes() for i in full], pa.binary()), pa.array([words if k == 0 else 0 for k in range(len(full))], pa.int64())],
            names=["shard", "hashes", "counts", "words"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, total = [], 0, 0
        for batch in freed(batches):
            for part in slices(batch, 0):
                words = words_of(part.column(0))
                total += len(words.hashes)
                for n in range(1, order + 1):
                    parts.append(ngrams(words, n)[0])
                    held += len(parts[-1])
                if held >= BUFFER_NGRAMS:
                    yield pack(parts, total)
                    parts, held, total = [], 0, 0
        if held:
            yield pack(parts, total)

    return docs.select("text").mapInArrow(count, "shard int, hashes binary, counts binary, words long")


def train(docs: DataFrame, *, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES) -> Model:
    """Counts the n-grams of all texts and builds the filter.  Null texts count as empty."""
    spark = docs.sparkSession
    ship(spark)
    # the texts' bytes, not those of their files, so that scores don't depend on how a table is stored
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = 1 << max(4, (size // SHARD_INPUT_BYTES).bit_length())
    folder = new_path(spark, "filter")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task is given one shard."""
        out = []
        current, hashes, counts, words = None, [], [], 0

        def finish() -> None:
            together = np.concatenate(hashes)
            order_ = np.argsort(together, kind="stable")
            sorted_ = together[order_]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            summed = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order_], first)
            bits = build_filter(sorted_[first], summed)
            path = f"{folder}/shard-{current:06d}"
            _write_file(path, bits)
            out.append((current, path, bits.nbytes, int(level_of(summed).sum()), len(first), words))

        for batch in freed(batches):
            for shard, packed, count, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != current:
                    if current is not None:
                        finish()
                    current, hashes, counts, words = shard, [], [], 0
                hashes.append(np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1))
                counts.append(np.frombuffer(count, dtype=np.uint32))
                words += n
        if current is not None:
            finish()
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "path", "bytes", "entries", "ngrams", "words"])

    built = _packed(docs, order, shards).repartitionById(shards, F.col("shard")).mapInArrow(build, "shard int, path string, bytes long, entries long, ngrams long, words long")
    rows = {r.shard: r for r in built.collect()}  # a row a shard
    tokens = sum(r.words for r in rows.values())
    size = sum(r.bytes for r in rows.values())
    files = [rows[i].path if i in rows else "" for i in range(shards)]
    bits = None
    if size <= broadcast_bytes:
        # read back by the driver from the shared folder, never larger than the limit
        bits = spark.sparkContext.broadcast([np.array(_read_file(f)) if f else np.zeros(1, dtype=np.uint64) for f in files])
    return Model(order, tokens, sum(r.ngrams for r in rows.values()), files, bits, sum(r.entries for r in rows.values()), size)


def score(docs: DataFrame, model: Model, *, interpolation: float = INTERPOLATION) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row, by the model's interpolated probabilities.

    p1(w) = (c(w) + 0.5) / (tokens + 0.5 * ngrams), and
    pn(w | h) = interpolation * min(1, c(hw) / c(h)) + (1 - interpolation) * pn-1(w | h')
    where c(h) is above 0, else pn-1(w | h'); c are counts as the filter has them and
    h' is h without its first word.  log_prob is the sum of natural logarithms over
    the words of the whole text; perplexity = exp(-log_prob / n_words).

    A text without a word (null, empty) has n_words 0, log_prob 0 and a null
    perplexity.  A null doc_id stays null, repeated rows are scored each.  An empty
    table gives no rows.  Other columns of docs are left out.
    """
    ship(docs.sparkSession)
    order, tokens, files, shared = model.order, model.tokens, model.files, model.bits
    ngram_total = model.vocabulary
    shards = len(files)

    def counts(hashes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(hashes, return_inverse=True)
        edge = np.searchsorted(_shard(distinct, shards), np.arange(shards + 1))
        level = np.zeros(len(distinct), dtype=np.int64)
        for i in range(shards):
            if edge[i + 1] > edge[i] and files[i]:
                bits = shared.value[i] if shared is not None else _read_file(files[i])
                level[edge[i] : edge[i + 1]] = probe(bits, distinct[edge[i] : edge[i + 1]])
        return count_of(level)[back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, 1, SCORE_BYTES):
                words = words_of(part.column(1))
                n_words = np.diff(words.offsets)
                grams = [ngrams(words, n) for n in range(1, order + 1)]
                lengths = [len(g) for g, _ in grams]
                found = np.split(counts(np.concatenate([g for g, _ in grams])), np.cumsum(lengths)[:-1])
                p = (found[0] + 0.5) / (tokens + 0.5 * ngram_total)
                by_end = found[0]
                for n in range(2, order + 1):
                    last = grams[n - 1][1]
                    # the history of an n-gram is the (n - 1)-gram that ends one word earlier
                    before = by_end[last - 1]
                    ratio = np.minimum(1.0, found[n - 1] / np.maximum(before, 1e-9))
                    p[last] = np.where(before > 0, interpolation * ratio + (1 - interpolation) * p[last], p[last])
                    by_end = np.zeros(len(words.hashes))
                    by_end[last] = found[n - 1]
                log_prob = np.zeros(len(n_words))
                full = np.flatnonzero(n_words)
                if len(full):
                    log_prob[full] = np.add.reduceat(np.log(p), words.offsets[:-1][full])
                perplexity = np.exp(-log_prob / np.maximum(n_words, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words.astype(np.int64)), pa.array(log_prob), pa.array(perplexity, mask=n_words == 0)], names=["doc_id", "n_words", "log_prob", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, perplexity double")
