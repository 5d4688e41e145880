"""Words of texts for keyword search: case folding, accents, stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A word: letters and digits, wherever something else parts them.
WORD = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without them."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accents()
_FOLD = str.maketrans(MARKED, PLAIN)


def word_array(text: Column, fold: bool = False) -> Column:
    """The words of a text in order, in lower case, without accents if fold; none for a null text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    if fold:
        lower = F.translate(lower, MARKED, PLAIN)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def split_words(text: str, fold: bool = False) -> list[str]:
    """What word_array() does, on the driver."""
    text = text.lower()
    if fold:
        text = text.translate(_FOLD)
    return ["".join(g) for g in _groups(text)]


def _groups(text: str):
    run: list[str] = []
    for c in text:
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def query_phrases(text: str, fold: bool = False) -> list[tuple[str, ...]]:
    """The phrases of a query, with repeats: each run of word characters (an underscore is one) is a phrase of its words."""
    return [words for run in re.findall(r"\w+", text.lower()) if (words := tuple(split_words(run, fold)))]


_VOWEL = set("aeiou")


def _measure(stem: str) -> tuple[int, list[bool]]:
    """(number of vowel-consonant sequences, which letters are consonants)."""
    consonant: list[bool] = []
    for i, c in enumerate(stem):
        consonant.append(not (c in _VOWEL or (c == "y" and i > 0 and consonant[i - 1])))
    return sum(1 for i in range(1, len(consonant)) if consonant[i] and not consonant[i - 1]), consonant


def _ends_cvc(stem: str) -> bool:
    _, c = _measure(stem)
    return len(stem) >= 3 and c[-3] and not c[-2] and c[-1] and stem[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Porter's stem of an English word in lower case; words under three letters, over 64, or with other letters stay."""
    if len(word) < 3 or len(word) > 64 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3])[0] > 0:
            w = w[:-1]
    elif w.endswith("ed") and not all(_measure(w[:-2])[1]):
        cut = w[:-2]
    elif w.endswith("ing") and not all(_measure(w[:-3])[1]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _measure(w)[1][-1] and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w)[0] == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and not all(_measure(w[:-1])[1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)])[0] > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest)[0] > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])[0]
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w)[0] > 1:
        w = w[:-1]
    return w


def _stems(words: pa.Array) -> pa.Array:
    """The stems of arrays of words; each distinct word of a batch is stemmed once."""
    coded = pc.dictionary_encode(pc.list_flatten(words))
    stems = pa.array([stem(x) for x in coded.dictionary.to_pylist()], pa.string())
    count = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *count.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))


def stem_array(words: Column) -> Column:
    """The stems of arrays of words."""
    return F.arrow_udf(_stems, ArrayType(StringType()))(words)
