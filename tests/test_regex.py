"""The regex dialect against literal cases and a slow model of its own."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import regex
from tessella.plans.regex import Automaton, Blank, emit, explain, parts

CASES = [
    ("abc*", "abcabc", {(0, 3), (0, 6), (3, 3)}),
    ("x(yz)*", "x", set()),
    ("x([0-9])*", "x", {(0, 1)}),
    ("x(yz)*w", "xw", {(0, 2)}),
    ("a.b", "a\nb", set()),
    ("a.*b", "a\nb", {(0, 3)}),
    (".*a", "ba", set()),
    ("", "abc", set()),
    ("a[0-9]+", "a1a22", {(0, 2), (0, 4), (2, 2)}),
    ("a([0-9])+", "a1a22", {(0, 2), (2, 2), (2, 3)}),
    ("(a){2,3}", "aaaa", {(0, 2), (0, 3), (1, 2), (1, 3), (2, 2)}),
    ("(a){0,0}", "aa", {(0, 1), (1, 1)}),
    ("a\\.b", "axb", {(0, 3)}),
    ("[^a]", "^ab", {(0, 1), (1, 1)}),
    ("a\\+", "a+", {(0, 2)}),
    ("(yz)*x", "x", {(0, 1)}),
    ("a|bc", "abc", {(0, 1), (1, 2)}),
]


def found(spark, pattern, text, **kw):
    docs = spark.createDataFrame([(1, bytearray(text.encode()))], "doc_id long, content binary")
    return {(r["off"], r["len"]) for r in regex.search(docs, pattern, **kw).collect()}


@pytest.mark.parametrize("pattern,text,expected", CASES)
def test_cases(spark, pattern, text, expected):
    assert found(spark, pattern, text) == expected


def test_standard_mode_may_skip(spark):
    assert found(spark, "x(yz)*", "x", mode="standard") == {(0, 1)}


@pytest.mark.parametrize("pattern", ["a]", "{", "a{3}", "(a.*b)", "*a", "a)", "(a", "[a", "a\\", "a}"])
def test_what_cannot_be_parsed_raises(pattern):
    with pytest.raises(ValueError):
        parts(pattern)


def test_counts_and_explain(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abab")), (2, None)], "doc_id long, content binary")
    assert {(r["sub_id"], r["n"]) for r in regex.count(docs, "a.*b").collect()} == {(0, 2), (1, 2)}
    assert explain("ab.*(c)+").splitlines() == ["literal 'ab' backwards", "repeat(literal 'c', +) backwards"]
    assert [tuple(r) for r in regex.show(docs, "b", 1).collect()] == [(1, 1, 1)]


def test_dot_is_one_byte(spark):
    assert found(spark, "a..b", "aéb") == {(0, 4)}


def test_choices_of_literals_run_without_python(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abab|a")), (2, None)], "doc_id long, content binary")
    for pattern, expected in (("ab|b|ab|a", {(0, 2), (2, 2), (1, 1), (3, 1), (0, 1), (2, 1), (5, 1)}), ("b\\|", {(3, 2)}), ("a|", {(0, 1), (2, 1), (5, 1)})):
        found = regex.search(docs, pattern)
        assert {(r["off"], r["len"]) for r in found.collect()} == expected and found.count() == len(expected)
        assert "Arrow" not in found._jdf.queryExecution().toString()
    assert {(r["off"], r["len"]) for r in regex.search(docs, "ab|a", max_len=1).collect()} == {(0, 1), (2, 1), (5, 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), min_size=1, max_size=6), min_size=2, max_size=4))
def test_gaps_equal_all_pairs(found):
    expected = {(o, o + n) for o, n in found[0]}
    for right in found[1:]:
        expected = {(o, p + m) for o, e in expected for p, m in right if p >= e}
    got = [(o, o + n) for os, ns in regex._over_gaps(found) for o, n in zip(os.tolist(), ns.tolist())]
    assert sorted(got) == sorted(expected)


ATOM = st.sampled_from(["a", "b", "ab", ".", "[ab]", "(a)", "(ab)", "(a|b)", "(b|aa)"])
PATTERN = st.lists(st.tuples(ATOM, st.sampled_from(["", "", "*", "+", "{1,2}", "{0,2}"])).map("".join), min_size=1, max_size=4).map("".join).filter(lambda p: ".*" not in p)  # that is a gap


@settings(max_examples=200, deadline=None)
@given(PATTERN, st.text("ab\n", max_size=7), st.sampled_from(["reference", "standard"]))
def test_automaton_equals_emitted_pattern(pattern, text, mode):
    (tree,) = parts(pattern)
    usual = emit(tree, mode)
    data = text.encode()
    expected = {(i, j - i) for i in range(len(data)) for j in range(i + 1, len(data) + 1) if usual is not None and re.fullmatch(usual, text[i:j])}
    auto = Automaton(tree, mode)
    assert {(i, n) for i in range(len(data)) for n in auto.lengths(data, i)} == expected
    assert tree != Blank()
