"""Porter's stemmer (1980), and the tokens of an index that folds case and accents and stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "aeiou"


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in _VOWEL and (c != "y" or i == 0 or not out[-1]))
    return out


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    c = _consonants(w)
    return sum(not a and b for a, b in zip(c, c[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return not all(_consonants(w))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-3:] == [True, False, True] and w[-1] not in "wxy"


# Porter's suffixes and what stands for them.
_STEP2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
_STEP3 = ["icate", "ic", "ative", "", "alize", "al", "iciti", "ic", "ical", "ic", "ful", "", "ness", ""]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, pairs: list[str], least: int) -> str:
    for suffix, new in sorted(zip(pairs[::2], pairs[1::2], strict=True), key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + new if _measure(stem) > least else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case word of a to z; others as they are."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    # a suffix is never the whole word
    if w.endswith("sses") or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, _STEP2, 0)
    w = _longest(w, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: len(w) - len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def folded(word: str) -> str:
    """word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def index_form(term: str) -> str:
    return stem(folded(term))


def index_forms(term: Column) -> Column:
    """The indexed form of terms, by an Arrow function: to be asked of a distinct vocabulary."""

    def run(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in terms:
            yield s.map(index_form)

    run.__annotations__ = {"terms": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(term)


def phrase_tokens(query: Column) -> Column:
    """Arrays of one token, or of the tokens of a word that holds underscores, which a text must have side by side."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.filter(F.transform(words, lambda w: F.filter(F.split(w, "_+"), lambda x: x != "")), lambda a: F.size(a) > 0)
