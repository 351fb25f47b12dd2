"""Parser, kernels and prefilters against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textsieve.functions import nfa, regex
from textsieve.functions.pattern import Pattern
from textsieve.functions.trigrams import extent_similarity
from textsieve.plans import planner, prefilter
from textsieve.sources.index import strings


def least_edits(word, text):
    column = list(range(len(word) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for j in range(1, len(word) + 1):
            new.append(min(column[j] + 1, new[-1] + 1, column[j - 1] + (word[j - 1] != c)))
        column, best = new, min(best, new[-1])
    return best


@pytest.mark.parametrize(
    "pattern,tree",
    [
        ("a", "LITERAL(a)"), ("abc", "CONCAT\n  CONCAT\n    LITERAL(a)\n    LITERAL(b)\n  LITERAL(c)"), ("a|b", "ALT\n  LITERAL(a)\n  LITERAL(b)"), ("a*", "REP{0,-1}\n  LITERAL(a)"), ("a+", "REP{1,-1}\n  LITERAL(a)"),
        ("a?", "REP{0,1}\n  LITERAL(a)"), ("a{3}", "REP{3,3}\n  LITERAL(a)"), ("a{2,5}", "REP{2,5}\n  LITERAL(a)"), ("(ab)+", "REP{1,-1}\n  CONCAT\n    LITERAL(a)\n    LITERAL(b)"), (".", "ANY(.)"), ("[abc]", "CLASS(a-c)"), ("[^0-9]", "CLASS(^0-9)"), ("a{~1}", "APPROX{~1}\n  LITERAL(a)"), ("x$", "CONCAT\n  LITERAL(x)\n  ANCHOR($)"),
    ],
)
def test_trees(pattern, tree):
    assert regex.dump(regex.parse(pattern)) == tree


@pytest.mark.parametrize("bad", ["(", "(a))(", "[a", "a{3,1}", "*a", "[z-a]", "a{", "\\", "[[:nope:]]", "a{~}", "\\b"])
def test_bad_patterns(bad):
    with pytest.raises(regex.RegexError):
        regex.parse(bad)


def test_limits():
    with pytest.raises(regex.RegexError):
        regex.parse("a" * 70_000)
    with pytest.raises(regex.RegexError):
        nfa.Matcher("(a{200}){200}")
    with pytest.raises(nfa.MatchTimeout):
        nfa.compiled("(a|b|c)*d(a|b)*e").search("abc" * 20_000, 3, deadline=0.05)


@given(st.text("abé", max_size=6), st.text("abcé", max_size=14), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_literals(word, text, k):
    want = least_edits(word, text)
    want = want if want <= k else None
    matcher = nfa.compiled(word)
    found = matcher.search(text, k)
    assert matcher.costs([text], k) == [want] and (found and found[0]) == want


PATTERNS = ["a+b", "(ab|c)*d", "a.c", "[ab]{2,3}c", "^ab", "bc$", "^a*$", "(a|b)?c{2}", "a(b|^c)", "$", "x*", "[^a]b", "(abcd|bcda)c", "ab{2,}c"]


@given(st.sampled_from(PATTERNS), st.text("abcd", max_size=10), st.integers(0, 2))
@settings(max_examples=600, deadline=None)
def test_patterns(pattern, text, k):
    matcher = nfa.compiled(pattern)
    cost = matcher.costs([text], k)[0]
    found = matcher.search(text, k)
    assert cost == (found and found[0])
    if k == 0:
        assert (cost is not None) == bool(re.search(pattern, text))
    assert cost is None or matcher.costs([text], k + 1) == [cost]
    formula = prefilter.formula(pattern, k)

    def holds(f):
        return f is None or (f[1] in text if f[0] == "has" else (all if f[0] == "all" else any)(map(holds, f[1])))

    assert cost is None or holds(formula)
    tiles = planner.gram_query(pattern, k).tiles
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    assert cost is None or not tiles or any(t <= grams for t in tiles)


def test_long_texts_are_cut_soundly():
    rng = random.Random(3)
    for _ in range(20):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(500, 2500)))
        word = "".join(rng.choice("abcd") for _ in range(9))
        want = least_edits(word, text)
        assert nfa.compiled(word).costs([text], 4) == [want if want <= 4 else None]


@pytest.mark.parametrize(
    "pattern,text,k,want",
    [
        ("color", "colour", 3, (1, 1, 0, 0, 0, 6)), ("", "", 0, (0, 0, 0, 0, 0, 0)), ("hello", "hello", 0, (0, 0, 0, 0, 0, 5)), ("enviro.*ment", "environment", 2, (0, 0, 0, 0, 0, 11)),
        ("xyz", "abcdef", 1, None), ("(foo){~1}bar", "xfobar", 0, (1, 0, 1, 0, 1, 6)), ("(foo){~1}bar", "foobr", 0, None), ("é.", "aéb", 0, (0, 0, 0, 0, 1, 4)),
    ],
)
def test_details(pattern, text, k, want):
    assert nfa.compiled(pattern).search(text, k) == want


def test_weights():
    def cheapest(word, text, ins, dele, sub):
        column = [j * dele for j in range(len(word) + 1)]
        best = column[-1]
        for c in text:
            new = [0]
            for j in range(1, len(word) + 1):
                new.append(min(column[j] + ins, new[-1] + dele, column[j - 1] + sub * (word[j - 1] != c)))
            column, best = new, min(best, new[-1])
        return best

    rng = random.Random(5)
    for _ in range(300):
        word, text = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (5, 9))
        costs = [rng.randint(1, 3) for _ in range(3)]
        want = cheapest(word, text, *costs)
        found = nfa.compiled(word).search(text, 4, *costs)
        assert (found and found[0]) == (want if want <= 4 else None)


@pytest.mark.parametrize("text,want", [("abc", "abc"), ("abc@1", "abc@1"), ("abc@2:1,1,1", "abc@2"), ("a@0:2,2,2", "a"), ("a@3:1,2,3", "a@3:1,2,3")])
def test_pattern_text(text, want):
    assert str(Pattern.parse(text)) == want


@pytest.mark.parametrize("bad", ["a@", "a@-1", "a@x", "a@1:1,1", "a@1:1,1,z"])
def test_bad_pattern_text(bad):
    with pytest.raises(ValueError):
        Pattern.parse(bad)


def test_extents():
    got = [float(extent_similarity(*x)) for x in (("cat", "category"), ("cat", "a category dog"), ("word", "two words here"), ("foo", "the foobar baz"), ("xyz", "abcdefg"), ("", "empty"), ("word", "two words here", True), ("cat", "category", True))]
    assert got == pytest.approx([0.75, 0.75, 0.8, 0.75, 0, 0, 0.5714286, 0.3])


def test_selectivity():
    q = planner.GramQuery((frozenset({"abc", "bcd"}),))
    assert planner.selectivity(q, {"abc": 10, "bcd": 50}, 1000) == 0.01
    assert planner.use_index(q, {"abc": 10, "bcd": 50}, 1000) and not planner.use_index(q, {"abc": 90, "bcd": 90}, 1000)
    assert planner.selectivity(planner.GramQuery(()), {}, 10) == 1.0


def test_surroundings_hold_every_match():
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 12)))
        k = rng.randint(1, 3)
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(4)]
        texts += [t + word[: len(word) // 2] + "d" + word[len(word) // 2 :] + t for t in texts]
        pieces = prefilter.pieces(prefilter.formula(word, k))
        matcher = nfa.compiled(word)
        whole = matcher.costs(texts, k)
        if pieces:
            assert matcher.costs(texts, k, pieces) == whole


def test_strings_of_code_points():
    text = "aé€😀\x00ÿ߿ࠀ￿𐀀"
    code = np.array([[ord(text[i]), ord(text[j]), ord(text[k])] for i in range(10) for j in (0, 3) for k in range(10)], np.uint32)
    assert strings(code).to_pylist() == ["".join(map(chr, row)) for row in code.tolist()]
    assert strings(code[:0]).to_pylist() == []


@pytest.mark.parametrize("pattern", ["anvul", "a(b|c)*d", "^ab", "cd$", "ab?c", "a*", "^$", "(^a|b)c$", "(ab){~1}c"])
def test_details_of_batches(pattern):
    """Costs and details of many texts, and the cost of one, against searches one by one."""
    rng = random.Random(pattern)
    m = nfa.Matcher(pattern)
    for _ in range(40):
        k, w = rng.randint(0, 4), rng.choice([(1, 1, 1), (2, 3, 1), (1, 2, 2), (3, 1, 1), (0, 1, 1)])
        texts = ["".join(rng.choices("abcdnvul", k=rng.randint(0, 12))) for _ in range(5)] + [None]
        want = [None if x is None else m.search(x, k, *w) for x in texts]
        costs = [r and r[0] for r in want]
        assert m.details(texts, k, *w) == want and m.costs(texts, k, weights=w) == costs
        assert not m.parallel(w) or [None if x is None else m.least(x, k, w) for x in texts] == costs


def test_details_search_little(monkeypatch):
    m, searched = nfa.Matcher("anvul"), []
    search = m.search
    monkeypatch.setattr(m, "search", lambda text, k, *rest: searched.append((text, k)) or search(text, k, *rest))
    texts = ["red anvil", "large ring", "blue bolt"] * 100
    assert [r is not None for r in m.details(texts, 2)] == [True, False, False] * 100
    assert searched == [("red anvil", 1)]
    searched.clear()
    assert m.costs(texts, 3, weights=(2, 3, 1))[:3] == [1, None, None] and not searched
