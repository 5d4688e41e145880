"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (see tokens) make one automaton, which is broadcast: test sets
don't grow with the corpus, and a set of more than MAX_WORDS words is split over
several automata, each of bounded size, that are applied in turn to every text.
Training words are streamed through it; at each word the state knows the length
of the longest run ending there that occurs in an item.

Before that, a text is cut down to the stretches whose every pair of neighbouring
words is a pair of some item: a common run of m words can lie nowhere else, and
the test is a table look-up for all words of a batch at once.

A maximal common run of min_span words at least is removed if
- it has max_length words or more, or
- it occurs in an item of whose words the text's runs cover the share
  max_coverage or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .tokens import rolling, slices, words_of

MIN_SPAN = 6
MAX_LENGTH = 10
MAX_COVERAGE = 0.5
#: Words of items in one automaton.
MAX_WORDS = 1_000_000
_TABLE_BITS = 20


class Automaton:
    """Suffix automaton of several word sequences; states: next, link, length, and the items each occurs in."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.size = {name: len(words) for name, words in items}
        ends: list[tuple[int, str]] = []
        for name, words in items:
            last = 0
            for word in words.tolist():
                last = self._extend(last, word)
                ends.append((last, name))
        found: list[set[str]] = [set() for _ in self.next]
        for state, name in ends:
            found[state].add(name)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                found[self.link[state]] |= found[state]
        self.items = [tuple(sorted(x)) for x in found]
        pairs = [rolling(words, 2) for _, words in items if len(words) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.pairs >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the longest run of state followed by word, split off target if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return self._split(last, word, target)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            # _split may change the transitions of state, not the target it returns
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def runs(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of the maximal runs of words that occur in an item, by end."""
        state, length = 0, 0
        for i, word in enumerate(words):
            following = self.next[state].get(word)
            if following is None:
                if length:
                    yield i - length, i, state
                while state > 0 and (following := self.next[state].get(word)) is None:
                    state = self.link[state]
                length = self.length[state]
                if following is None and (following := self.next[state].get(word)) is None:
                    state, length = 0, 0
                    continue
            state, length = following, length + 1
        if length:
            yield len(words) - length, len(words), state


def stretches(hashes: np.ndarray, offsets: np.ndarray, automaton: Automaton, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches of at least that many words, within a row, of which every pair of neighbours is in an item."""
    if len(hashes) < 2 or not len(automaton.pairs):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pair = rolling(hashes, 2)
    known = automaton.table[(pair >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
    maybe = np.flatnonzero(known)
    place = np.minimum(np.searchsorted(automaton.pairs, pair[maybe]), len(automaton.pairs) - 1)
    known[maybe] = automaton.pairs[place] == pair[maybe]
    borders = offsets[1:-1] - 1
    known[borders[(borders >= 0) & (borders < len(known))]] = False
    edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    long = end - start >= least
    return start[long], end[long]


def removals(words: list[int], base: int, pieces: list[tuple[int, int]], automaton: Automaton, min_span: int, max_length: int, max_coverage: float) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, items) of the runs of one text to be removed; pieces: its stretches, positions count from base."""
    runs = []
    for start, end in pieces:
        for a, b, state in automaton.runs(words[start - base : end - base]):
            if b - a >= min_span:
                runs.append((start - base + a, start - base + b, automaton.items[state]))
    covered: dict[str, list[tuple[int, int]]] = {}
    for a, b, items in runs:
        for item in items:
            covered.setdefault(item, []).append((a, b))
    full = set()
    for item, spans in covered.items():
        total, reach = 0, 0
        for a, b in sorted(spans):
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        if total >= max_coverage * automaton.size[item]:
            full.add(item)
    return [(a, b, items) for a, b, items in runs if b - a >= max_length or full.intersection(items)]


def _automata(benchmark: DataFrame, min_span: int, max_words: int) -> list[Broadcast]:
    """The automata of all items of min_span words at least, broadcast."""
    # the test sets come to the driver whole: they are fixed beside the corpus
    table = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toArrow()
    words = words_of(table.column(1).combine_chunks())
    groups: list[list[tuple[str, np.ndarray]]] = [[]]
    total = 0
    for i, name in enumerate(table.column(0).to_pylist()):
        item = words.hashes[words.offsets[i] : words.offsets[i + 1]]
        if len(item) < min_span:
            continue
        if total and total + len(item) > max_words:
            groups.append([])
            total = 0
        groups[-1].append((name, item))
        total += len(item)
    return [benchmark.sparkSession.sparkContext.broadcast(Automaton(g)) for g in groups]


def _cut(docs: DataFrame, benchmark: DataFrame, min_span: int, max_length: int, max_coverage: float, max_words: int):
    """A function from texts to {row: (text without the runs, runs removed, words removed, longest run, items)}."""
    ship(docs.sparkSession)
    shared = _automata(benchmark, min_span, max_words)

    def cut(texts: pa.Array) -> dict[int, tuple[str, int, int, int, str]]:
        words = words_of(texts)
        found: dict[int, list[tuple[int, int, tuple[str, ...]]]] = {}
        for one in shared:
            automaton = one.value
            start, end = stretches(words.hashes, words.offsets, automaton, min_span)
            rows = np.searchsorted(words.offsets, start, side="right") - 1
            pieces: dict[int, list[tuple[int, int]]] = {}
            for row, a, b in zip(rows.tolist(), start.tolist(), end.tolist(), strict=True):
                pieces.setdefault(row, []).append((a, b))
            for row, own in pieces.items():
                base, stop = int(words.offsets[row]), int(words.offsets[row + 1])
                if gone := removals(words.hashes[base:stop].tolist(), base, own, automaton, min_span, max_length, max_coverage):
                    found.setdefault(row, []).extend(gone)
        out = {}
        for row, gone in found.items():
            base, begin, stop = int(words.offsets[row]), int(words.row_start[row]), int(words.row_start[row + 1])
            # lower-casing may change the bytes of a character, never the number of characters
            character = np.cumsum((words.data[begin:stop] & 0xC0) != 0x80)
            text, kept, reach, removed = texts[row].as_py(), [], 0, 0
            word_reach = 0
            for a, b, _ in sorted(gone):
                removed += max(0, b - max(a, word_reach))
                word_reach = max(word_reach, b)
                first = int(character[words.start[base + a] - begin]) - 1
                last = int(character[words.end[base + b - 1] - begin - 1])
                kept.append(text[reach:first] if first > reach else "")
                reach = max(reach, last)
            items = sorted({x for _, _, names in gone for x in names})
            out[row] = ("".join([*kept, text[reach:]]), len(gone), removed, max(b - a for a, b, _ in gone), ",".join(items))
        return out

    return cut


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_span: int = MIN_SPAN, max_length: int = MAX_LENGTH, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, runs, removed_words, longest_run, items, text) of every document of which something is removed.

    text: what is left.  items: ids of the test items concerned, joined by commas.
    An item of fewer than min_span words, a null item or one without a text is not
    searched for.  A null or empty text matches nothing; a null doc_id stays null;
    repeated rows are judged each by itself.  An empty table of either kind gives no
    rows.  Other columns are ignored, whatever their names.
    """
    cut = _cut(docs, benchmark, min_span, max_length, max_coverage, max_words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                if found := cut(part.column(1)):
                    text, runs, removed, longest, items = zip(*found.values(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(list(found), pa.int64())), pa.array(runs, pa.int32()), pa.array(removed, pa.int32()), pa.array(longest, pa.int32()), pa.array(items, pa.string()), pa.array(text, pa.string())],
                        names=["doc_id", "runs", "removed_words", "longest_run", "items", "text"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, runs int, removed_words int, longest_run int, items string, text string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_span: int = MIN_SPAN, max_length: int = MAX_LENGTH, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the runs that contaminated() finds; other rows and columns as they are.

    A document that has no word left goes.  n_chars, if docs has it, follows the text.
    """
    cut = _cut(docs, benchmark, min_span, max_length, max_coverage, max_words)
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = cut(part.column(at))
                if not found:
                    yield part
                    continue
                columns = part.columns
                texts = columns[at].to_pylist()
                for row, x in found.items():
                    texts[row] = x[0]
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    lengths = columns[chars].to_pylist()
                    for row, x in found.items():
                        lengths[row] = len(x[0])
                    columns[chars] = pa.array(lengths, columns[chars].type)
                touched = list(found)
                left = words_of(columns[at].take(pa.array(touched, pa.int64())))
                gone = {row for row, n in zip(touched, np.diff(left.offsets).tolist(), strict=True) if n == 0}
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array([i not in gone for i in range(part.num_rows)]))

    return docs.mapInArrow(clean, docs.schema)
