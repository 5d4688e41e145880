"""Passages that repeat across documents, by a hash-compared suffix sort.

A passage of min_words words holds a gram (a run of GRAM words) whose hash is the
least among those of its grams; wherever the passage stands, that gram is chosen.
So positions that can share a passage meet at the hash of the chosen gram, and the
suffixes of the corpus need not be sorted in one place:

1. The chosen grams of all documents are counted by hash.  A hash that stands at one
   place alone is dropped.
2. Around each gram left, the document's words that can be in a passage which
   chose it go to the gram's hash, with the numbers of the document and the word.
3. There the suffixes that start at the passages' first words are sorted by
   merging runs.  Two suffixes are compared by the length of their common
   extension, found by binary search on prefix sums of a polynomial hash: some six
   look-ups for 50 words.  Neighbours whose hashes agree on min_words words are
   verified letter by letter.
4. A gram at more than HOT_PLACES places would be too much for one task.  There each
   passage is told by two 64-bit hashes of its words, drawn apart, and passages are
   grouped by these, with partial aggregates ahead of the shuffle.

Every passage of min_words words that stands at two places is found; adjoining and
overlapping ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, ship, written
from .tokens import Words, cut_hash, freed, mix64, prefix_hash, slices, words_of

MIN_WORDS = 50
#: Words in hand when suffixes are sorted; groups of one gram aren't parted.
SORT_WORDS = 400_000
#: Places of a gram that one task takes.
HOT_PLACES = 20_000


def chosen_grams(words: Words, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams' hashes by position, starts of all windows of min_words words within a row, position of the gram each chooses)."""
    n = len(words.hashes) - gram + 1
    if len(words.hashes) < min_words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    prefix = prefix_hash(words.hashes)
    at = np.arange(n)
    value = mix64(cut_hash(prefix, at, at + gram))
    least, place = value, at
    width, span = 1, min_words - gram + 1
    while width < span:
        step = min(width, span - width)
        left, right = least[:-step], least[step:]
        take = right < left
        least, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        width += step
    row = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    start = np.flatnonzero(row[: len(least)] == row[min_words - 1 : min_words - 1 + len(least)])
    return value, start, place[start]


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """How many words, limit at most, the suffixes at a and b have in common, by binary search on their hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), limit, dtype=np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = cut_hash(prefix, a, a + mid) == cut_hash(prefix, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(tokens: np.ndarray, suffix: np.ndarray, part: np.ndarray, limit: int, text: bytes, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by (part, first limit words), whether each equals the one before it in those words).

    part ascends.  Bottom-up mergesort of all parts at once: in each round, every
    suffix finds by binary search how many of the neighbouring run go before it.
    Each suffix has limit words at least; what the hashes say is equal is verified by
    text, in which word i begins at letter[i].
    """
    prefix = prefix_hash(tokens)
    n = len(suffix)
    first = np.ones(n, dtype=bool)
    first[1:] = part[1:] != part[:-1]
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, n))
    base = np.repeat(begin, sizes)
    end = base + np.repeat(sizes, sizes)
    slot = np.arange(n) - base
    current = suffix.copy()
    order = np.arange(n)
    width = 1
    largest = int(sizes.max()) if n else 0
    while width < largest:
        run = slot // width
        own = base + run * width
        sibling = base + (run ^ 1) * width
        low = np.minimum(sibling, end)
        high = np.minimum(sibling + width, end)
        right_run = (run & 1).astype(bool)
        start = low.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            mine, other = current[live], current[mid]
            common = common_extension(prefix, mine, other, limit)
            differ = common < limit
            at = np.minimum(common, limit - 1)
            x, y = tokens[mine + at], tokens[other + at]
            # equal suffixes keep their order: those of the left run go first
            before = np.where(differ, y < x, right_run[live])
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        target = np.minimum(own, sibling) + (np.arange(n) - own) + (low - start)
        moved, moved_order = np.empty_like(current), np.empty_like(order)
        moved[target], moved_order[target] = current, order
        current, order = moved, moved_order
        width *= 2
    same = np.zeros(n, dtype=bool)
    pairs = np.flatnonzero(~first)
    equal = common_extension(prefix, current[pairs - 1], current[pairs], limit) == limit
    pairs = pairs[equal]
    # the hashes agree; the letters decide
    x, y = current[pairs - 1], current[pairs]
    spans = zip(letter[x].tolist(), letter[x + limit].tolist(), letter[y].tolist(), letter[y + limit].tolist(), strict=True)
    same[pairs] = [text[a:b] == text[c:d] for a, b, c, d in spans]
    return order, same


class _Stretch:
    """Words around a chosen gram, the same ones wherever they stand: (doc_id, number of the first word) of each place.

    text: the words, each with a blank after it; at: where each begins in it.
    """

    __slots__ = ("at", "gram", "places", "text", "windows", "words")

    def __init__(self, words: np.ndarray, text: bytes, at: np.ndarray, gram: int, windows: int):
        self.words, self.text, self.at, self.gram, self.windows = words, text, at, gram, windows
        self.places: list[tuple[int, int]] = []


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, a blank after each; where each begins, and the end)."""
    length = words.end - words.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(at[-1], ord(" "), dtype=np.uint8)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at[:-1], length) + step] = words.data[np.repeat(words.start, length) + step]
    return out, at


def _spans(groups: list[list[_Stretch]], min_words: int, within: bool) -> Iterator[tuple[int, int, int, bool]]:
    """(doc_id, start, end, later) of the passages in groups of stretches that chose the same gram."""
    several = [g for g in groups if len(g) > 1]
    for (only,) in (g for g in groups if len(g) == 1):
        first = min(only.places)
        if any(place != first if within else place[0] != first[0] for place in only.places):
            for place in only.places:
                yield place[0], place[1], place[1] + only.windows - 1 + min_words, place != first
    if not several:
        return
    stretches = [s for g in several for s in g]
    length = np.array([len(s.words) for s in stretches])
    tokens = np.concatenate([s.words for s in stretches])
    begin = np.cumsum(length) - length
    count = np.array([s.windows for s in stretches])
    owner = np.repeat(np.arange(len(stretches)), count)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    group = np.repeat(np.arange(len(several)), [len(g) for g in several])
    # passages that are equal have their chosen gram at the same distance
    part = group[owner] * (min_words + 1) + np.array([s.gram for s in stretches])[owner] - window
    by_part = np.argsort(part, kind="stable")
    room = np.array([len(s.text) for s in stretches])
    at = np.concatenate([s.at[:-1] + base for s, base in zip(stretches, (np.cumsum(room) - room).tolist(), strict=True)] + [[room.sum()]])
    order, same = suffix_sort(tokens, (begin[owner] + window)[by_part], part[by_part], min_words, b"".join(s.text for s in stretches), at)
    order = by_part[order]
    low, high = [min(s.places) for s in stretches], [max(s.places) for s in stretches]
    repeated = np.zeros(len(owner), dtype=bool)
    firsts: list[dict[int, tuple[int, int]]] = [{} for _ in stretches]
    starts = np.flatnonzero(~same)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        members = order[a:b].tolist()
        where, best = min(((low[owner[i]][0], low[owner[i]][1] + int(window[i])), i) for i in members)
        last = max((high[owner[i]][0], high[owner[i]][1] + int(window[i])) for i in members)
        if (where if within else where[0]) == (last if within else last[0]):
            continue
        repeated[members] = True
        firsts[owner[best]][int(window[best])] = where
    edge = np.concatenate([[0], np.cumsum(count)])
    for k, s in enumerate(stretches):
        mask = repeated[edge[k] : edge[k + 1]].tolist()
        if not any(mask):
            continue
        runs = _runs(mask)
        for place in s.places:
            if place == low[k] and firsts[k]:
                # the first place of some windows: told apart from the later ones
                first = [w in firsts[k] for w in range(len(mask))]
                for a, b in _runs([m and f for m, f in zip(mask, first, strict=True)]):
                    yield place[0], place[1] + a, place[1] + b - 1 + min_words, False
                for a, b in _runs([m and not f for m, f in zip(mask, first, strict=True)]):
                    yield place[0], place[1] + a, place[1] + b - 1 + min_words, True
            else:
                for a, b in runs:
                    yield place[0], place[1] + a, place[1] + b - 1 + min_words, True


def _runs(mask: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, x in enumerate([*mask, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            out.append((start, i))
            start = None
    return out


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, within: bool = True) -> DataFrame:
    """(doc_id, start_word, end_word, words, later) of the passages of min_words words or more that stand at another place too.

    Words are numbered from 0 in each document, end_word excluded.  later: false for
    passages of which this is the first place, by (doc_id, word), of every stretch of
    min_words words in them; true for those to be removed so that one copy stays.

    The other place may be in the same document, and may overlap; where within is
    false, some other place must be in another document.  Null, empty and
    short texts have no passage; rows without a doc_id are left out; rows that share a
    doc_id are one document, so what stands at the same number of both is at one place.
    An empty table gives no rows.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    gram = max(1, min_words // 2)
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, 1):
                words = words_of(part.column(1))
                value, _, place = chosen_grams(words, min_words, gram)
                place = np.unique(place)
                row = np.searchsorted(words.offsets, place, side="right") - 1
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(value[place].view(np.int64)), pa.array((place - words.offsets[row]).astype(np.int32))], names=["doc_id", "gram", "word"])

    grams = written(docs.mapInArrow(choose, "doc_id long, gram long, word int"), "grams")
    of_gram = grams.groupBy("gram").agg(F.count("*").alias("held"), *(f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in ("doc_id", "word")))
    shared = written(of_gram.where("low_doc_id < high_doc_id OR low_word < high_word" if within else "low_doc_id < high_doc_id").select("gram", (F.col("held") > HOT_PLACES).alias("hot")), "shared")
    some_hot = not shared.where("hot").isEmpty()
    places = written(grams.join(shared, "gram").groupBy("doc_id").agg(F.collect_set(F.struct("word", "hot")).alias("places")).withColumnRenamed("doc_id", "in_doc"), "places")
    discard(grams, shared)

    names = ["gram", "doc_id", "word", "offset", "windows", "text", "second"]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in slices(batch, 1):
                words = words_of(part.column(1))
                value, start, place = chosen_grams(words, min_words, gram)
                wanted = part.column(2)
                count = wanted.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), count)
                fields = wanted.flatten()
                at, one = np.unique(fields.field("word").to_numpy(zero_copy_only=False).astype(np.int64) + words.offsets[row], return_index=True)
                hot = fields.field("hot").to_numpy(zero_copy_only=False).astype(bool)[one]
                low, high = np.searchsorted(place, at, side="left"), np.searchsorted(place, at, side="right")
                known = high > low  # of rows that share a doc_id, each has its own grams
                at, low, high, hot = at[known], low[known], high[known], hot[known]
                ids = part.column(0).to_numpy()
                if hot.any():
                    # every passage by itself
                    span = (high - low)[hot]
                    own = start[np.repeat(low[hot] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))]
                    row = np.searchsorted(words.offsets, own, side="right") - 1
                    first_hash, second_hash = (cut_hash(prefix_hash(v), own, own + min_words).view(np.int64) for v in (words.hashes, mix64(words.hashes)))
                    none = pa.nulls(len(own), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(first_hash), pa.array(ids[row]), pa.array((own - words.offsets[row]).astype(np.int32)), none, none, pa.nulls(len(own), pa.string()), pa.array(second_hash)], names=names)
                at, low, high = at[~hot], low[~hot], high[~hot]
                row = np.searchsorted(words.offsets, at, side="right") - 1
                first, last = start[low], start[high - 1] + min_words - 1
                text = [words.data[a:b].tobytes().decode() for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[at].view(np.int64)),
                        pa.array(ids[row]),
                        pa.array((first - words.offsets[row]).astype(np.int32)),
                        pa.array((at - first).astype(np.int32)),
                        pa.array((high - low).astype(np.int32)),
                        pa.array(text, pa.string()),
                        pa.nulls(len(at), pa.int64()),
                    ],
                    names=names,
                )

    stretches = docs.join(places, F.col("doc_id") == F.col("in_doc")).select("doc_id", "text", "places").mapInArrow(around, "gram long, doc_id long, word int, offset int, windows int, text string, second long")
    hot_spans = None
    if some_hot:
        stretches = written(stretches, "stretches")
        alone = stretches.where("second IS NOT NULL").select("gram", "second", "doc_id", "word")
        firsts = alone.groupBy("gram", "second").agg(F.min(F.struct("doc_id", "word")).alias("low"), F.max(F.struct("doc_id", "word")).alias("high")).where("low < high" if within else "low.doc_id < high.doc_id")
        hot_spans = alone.join(firsts, ["gram", "second"]).select("doc_id", F.col("word").alias("start_word"), (F.col("word") + min_words).cast("int").alias("end_word"), (F.struct("doc_id", "word") != F.col("low")).alias("later")).distinct()
        stretches = stretches.where("second IS NULL")
    stretches = stretches.drop("second")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict[tuple[bytes, int, int], _Stretch]] = []
        current, held = None, 0

        def result() -> pa.RecordBatch:
            spans = list(_spans([list(g.values()) for g in done], min_words, within))
            doc, start, end, later = zip(*spans, strict=True) if spans else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(later, pa.bool_())], names=["doc_id", "start_word", "end_word", "later"])

        for batch in freed(batches):
            for part in slices(batch, 5):
                words = words_of(part.column(5))
                letters, at = spaced(words)
                gram_, doc, word, offset, windows = (part.column(i).to_pylist() for i in range(5))
                for i in range(part.num_rows):
                    if gram_[i] != current:
                        if held > SORT_WORDS:
                            yield result()
                            done, held = [], 0
                        current = gram_[i]
                        done.append({})
                    a, b = words.offsets[i], words.offsets[i + 1]
                    text = letters[at[a] : at[b]].tobytes()
                    key = (text, offset[i], windows[i])
                    stretch = done[-1].get(key)
                    if stretch is None:
                        stretch = done[-1][key] = _Stretch(words.hashes[a:b].copy(), text, at[a : b + 1] - at[a], offset[i], windows[i])
                        held += b - a
                    stretch.places.append((doc[i], word[i]))
        yield result()

    spans = stretches.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "doc_id long, start_word int, end_word int, later boolean")
    spans = written(spans if hot_spans is None else spans.union(hot_spans), "spans")
    discard(places)
    order = Window.partitionBy("doc_id", "later").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("start_word")).cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "later", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("words"), "later")
