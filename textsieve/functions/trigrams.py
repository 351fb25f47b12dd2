"""Similarity of sets of word trigrams, and of extents of a text to a word."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from textsieve.settings import setting

#: Characters of words after A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word with two spaces before and one after it."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORDS), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: w.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trgm_similarity(a: Column, b: Column) -> Column:
    """Common trigrams as a share of all, as float; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, F.when(all_ > 0, both / all_).otherwise(0.0)).cast("float")


def trgm_distance(a: Column, b: Column) -> Column:
    return (F.lit(1.0).cast("float") - trgm_similarity(a, b)).cast("float")


def trgm_sim_op(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Whether trgm_similarity, a 32-bit number, is at least the 64-bit threshold, by default the session's."""
    return trgm_similarity(a, b).cast("double") >= F.lit(float(setting("similarity_threshold") if threshold is None else threshold))


def positions(text: str) -> tuple[list[str], list[bool], list[bool]]:
    """Trigrams in the order of the text, and which of them begin and end a word."""
    grams, begin, end = [], [], []
    for w in _WORD.findall(text.translate(_FOLD)):
        p = f"  {w} "
        own = [p[i : i + 3] for i in range(len(p) - 2)]
        grams += own
        begin += [True] + [False] * (len(own) - 1)
        end += [False] * (len(own) - 1) + [True]
    return grams, begin, end


def extent_similarity(word: str, text: str, strict: bool = False) -> np.float32:
    """The greatest similarity found of word's trigrams to those of an extent of text.

    The search is greedy: at each place where an extent may end, its best begin since the one kept
    so far is kept, if it is better than that; an earlier begin isn't tried again.  strict: extents
    begin and end with words.
    """
    wanted = set(positions(word)[0])
    grams, begin, end = positions(text)
    best, kept = np.float32(0), 0 if strict else None
    for stop, g in enumerate(grams):
        if not (end[stop] if strict else g in wanted):
            continue
        if kept is None:
            kept = stop
        # going back from the end, what each begin adds
        inside: set[str] = set()
        value = {}
        common = 0
        for start in range(stop, kept - 1, -1):
            if grams[start] not in inside:
                inside.add(grams[start])
                common += grams[start] in wanted
            value[start] = np.float32(common) / np.float32(len(wanted) + len(inside) - common)
        top = value[kept]
        for start in range(kept, stop + 1):
            if (begin[start] or not strict) and value[start] > top:
                top, kept = value[start], start
        best = max(best, top)
    return best
