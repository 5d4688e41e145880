"""Token counts of a byte-level BPE by rank-synchronous merging in ragged numpy arrays.

1. Texts are cut into pre-tokens by the vocabulary's pattern: words, numbers and
   other marks, each with the blank before it, contractions and white space.  The
   cut is computed on arrays of character classes, for a whole slice at once.
2. Pre-tokens are hashed, and those not met before in this task are held as one
   ragged array of symbols, bytes to begin with.  In each round every sequence
   applies its own pair of lowest rank, all sequences at the same time; a sequence
   without a pair in the vocabulary is done, and the symbols it has left are its
   count.
3. A text's count is the sum over its pre-tokens.

The vocabulary (token bytes and ranks, a tiktoken file) is of a fixed size and is
broadcast; counts known already are kept in each task up to CACHE of them.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship
from .tokens import slices, spans_hash, string_buffers

#: The production vocabulary; a parameter of token_counts().
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Counts of pre-tokens that a task keeps.
CACHE = 1 << 20
NONE = np.int64(1) << 40

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), white space or another."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, dtype=np.uint8)
        major = {"L": _LETTER, "N": _NUMBER}
        for code in range(0x110000):
            kind = major.get(unicodedata.category(chr(code))[0])
            if kind:
                out[code] = kind
        out[_WHITE] = _SPACE
        _classes = out
    return _classes


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of valid UTF-8, position of the first byte of each)."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[first].astype(np.int64)
    code = lead
    if len(first) != len(raw):
        padded = np.append(raw, np.zeros(3, dtype=np.uint8))
        tail = [(padded[first + k] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
        code = np.select(
            [lead < 0x80, lead < 0xE0, lead < 0xF0],
            [lead, (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]],
            (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2],
        )
    return code, first


def pretoken_starts(code: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character; row_start: whether a text does.

    Does what the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ does.
    """
    n = len(code)
    if n == 0:
        return np.zeros(0, dtype=bool)
    kind = character_classes()[code]
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[row_start] = 255
    changes = kind != before
    last = np.empty(n, dtype=bool)  # of its text
    last[-1], last[:-1] = True, row_start[1:]
    space = kind == _SPACE
    start = changes.copy()
    # the last character of white space before something else stands by itself or, if a blank, goes with what follows
    following = np.zeros(n, dtype=bool)
    following[:-1] = ~space[1:] & ~last[:-1]
    final = space & following
    start |= final
    joins = np.flatnonzero(final & (code == 32))
    start[joins + 1] = False
    # a contraction: an apostrophe that begins a run of marks, with no blank before it
    mark = np.flatnonzero((code == 39) & start)
    if len(mark):
        ends = np.zeros(len(mark), dtype=np.int64)
        near = np.append(code, [0, 0])
        room = np.append(row_start, [True, True])
        one, two = near[mark + 1], near[mark + 2]
        has_one = ~room[mark + 1]
        has_two = has_one & ~room[mark + 2]
        ends[has_one & np.isin(one, [ord(c) for c in "stmd"])] = 1
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        ends[has_two & pairs] = 2
        mark, ends = mark[ends > 0], ends[ends > 0]
        start[mark + 1] = False
        after = mark + ends + 1
        inside = after < n
        # what is left of the word; a change of class begins a pre-token anyway, a blank is handled above
        after = after[inside]
        start[after[kind[after] == _LETTER]] = True
    return start


@dataclass
class Vocabulary:
    """byte_id: ids of single bytes; keys, ids: an open hash table from pairs of ids to the merged id; whole: hashes of all tokens."""

    byte_id: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    shift: int
    whole: np.ndarray


def _slot(key: np.ndarray, shift: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a rank file: a line for each token, its bytes in base 64 and its rank."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    bits = max(4, (4 * len(pairs)).bit_length())
    size, shift = 1 << bits, 64 - bits
    keys, ids = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int64)
    left = np.array(list(pairs), dtype=np.int64)
    value = np.array(list(pairs.values()), dtype=np.int64)
    at = _slot(left, shift)
    while len(left):
        free = keys[at] < 0
        _, one = np.unique(at[free], return_index=True)  # of those that want a slot, one gets it
        got = np.flatnonzero(free)[one]
        keys[at[got]], ids[at[got]] = left[got], value[got]
        rest = np.ones(len(left), dtype=bool)
        rest[got] = False
        left, value, at = left[rest], value[rest], (at[rest] + 1) & (size - 1)
    joined = np.frombuffer(b"".join(ranks), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in ranks])
    whole = np.sort(spans_hash(joined, np.concatenate([[0], ends[:-1]]), ends))
    return Vocabulary(np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64), keys, ids, shift, whole)


def pair_ids(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id (and rank) that each pair merges to, NONE where it is in no token."""
    key = left << 20 | right
    out = np.full(len(key), NONE, dtype=np.int64)
    at = _slot(key, vocabulary.shift)
    live = np.arange(len(key))
    while len(live):
        there = vocabulary.keys[at]
        hit = there == key[live]
        out[live[hit]] = vocabulary.ids[at[hit]]
        on = ~hit & (there >= 0)
        live, at = live[on], (at[on] + 1) & (len(vocabulary.keys) - 1)
    return out


def merged_counts(vocabulary: Vocabulary, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence; data: the bytes of all, one after another, none of them empty."""
    total = len(length)
    result = np.zeros(total, dtype=np.int64)
    symbol = vocabulary.byte_id[data]
    owner = np.repeat(np.arange(total), length)
    paired = np.empty(len(symbol), dtype=np.int64)  # the merge of each symbol with the next one
    paired[:-1] = pair_ids(vocabulary, symbol[:-1], symbol[1:])
    paired[-1:] = NONE
    paired[:-1][owner[:-1] != owner[1:]] = NONE
    while len(symbol):
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(begin, len(symbol)))
        lowest = np.minimum.reduceat(paired, begin)
        done = lowest == NONE
        if done.any():
            result[owner[begin[done]]] = size[done]
            on = np.repeat(~done, size)
            symbol, owner, paired = symbol[on], owner[on], paired[on]
            size, lowest = size[~done], lowest[~done]
            if not len(symbol):
                break
        target = np.repeat(lowest, size)
        hit = paired == target
        # of overlapping places (aaa) every second one, from the left
        at = np.flatnonzero(hit)
        close = np.append(False, np.diff(at) == 1)
        run_start = np.maximum.accumulate(np.where(close, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        after = symbol.copy()
        after[at] = paired[at]
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        new_symbol, new_owner = after[keep], owner[keep]
        new_paired = paired[keep]
        touched = place[at]
        stale = np.unique(np.concatenate([touched, touched[touched > 0] - 1]))
        inner = stale[(stale + 1 < len(new_symbol))]
        inner = inner[new_owner[inner] == new_owner[inner + 1]]
        new_paired[stale] = NONE
        new_paired[inner] = pair_ids(vocabulary, new_symbol[inner], new_symbol[inner + 1])
        # a merge can make a pair of a lower rank than its own only in vocabularies with holes; then the leftmost place alone counts
        odd = np.unique(new_owner[inner[new_paired[inner] < _rank_at(lowest, size, owner, new_owner[inner])]])
        if len(odd):
            first = np.append(True, owner[at][1:] != owner[at][:-1])
            at = at[first | ~np.isin(owner[at], odd)]
            after = symbol.copy()
            after[at] = paired[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            new_symbol, new_owner = after[keep], owner[keep]
            new_paired = np.full(len(new_symbol), NONE, dtype=np.int64)
            inner = np.flatnonzero(new_owner[:-1] == new_owner[1:])
            new_paired[inner] = pair_ids(vocabulary, new_symbol[inner], new_symbol[inner + 1])
        symbol, owner, paired = new_symbol, new_owner, new_paired
    return result


def _rank_at(lowest: np.ndarray, size: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """lowest of the sequences with these owners."""
    owners = owner[np.cumsum(size) - size]
    return lowest[np.searchsorted(owners, wanted)]


class Counter:
    """Counts of texts, with the counts of pre-tokens met before."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.limit = vocabulary, cache
        self.known = np.zeros(0, dtype=np.uint64)
        self.count = np.zeros(0, dtype=np.int64)

    def _pretokens(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Counts of distinct pre-tokens, whose hashes ascend."""
        out = np.zeros(len(hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        old = self.known[place] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)
        out[old] = self.count[place[old]]
        new = np.flatnonzero(~old)
        if not len(new):
            return out
        spot = np.minimum(np.searchsorted(self.vocabulary.whole, hashes[new]), len(self.vocabulary.whole) - 1)
        whole = self.vocabulary.whole[spot] == hashes[new]
        out[new[whole]] = 1
        rest = new[~whole]
        if len(rest):
            length = end[rest] - start[rest]
            at = np.repeat(start[rest] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            out[rest] = merged_counts(self.vocabulary, raw[at], length)
        if len(self.known) + len(new) > self.limit:
            self.known, self.count = hashes, out
        else:
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.count = known[order], np.concatenate([self.count, out[new]])[order]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each text; null counts as empty."""
        rows, raw = string_buffers(texts.fill_null(""))
        n = len(rows) - 1
        if not len(raw):
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        code, first = code_points(raw)
        row_start = np.zeros(len(code), dtype=bool)
        row_start[np.searchsorted(first, rows[:-1][rows[:-1] < rows[1:]])] = True
        start = first[pretoken_starts(code, row_start)]
        end = np.append(start[1:], len(raw))
        hashes = spans_hash(raw, start, end)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        tokens = self._pretokens(distinct, raw, start[where], end[where])[back]
        edge = np.searchsorted(start, rows)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        return sums[edge[1:]] - sums[edge[:-1]], np.diff(edge)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_bytes) of every row: tokens of the whole text by the rank file at that path.

    The counts are those of encoding the text with the vocabulary's merges and
    without special tokens, whose strings are ordinary text.  A null or empty text
    has none of either.  Repeated rows are counted each, a null doc_id stays null;
    an empty table gives no rows.  Other columns of docs are left out, whatever
    their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                tokens, pretokens = counter(part.column(1))
                size = pc.binary_length(part.column(1)).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(pretokens), size], names=["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long, n_pretokens long, n_bytes long")
