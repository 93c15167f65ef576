"""The trigram index against a scan of the passages."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenia.operators import patterns, search

WORDS = ["Alpha", "beta", "gamma-delta", "ETA", "théorie", "日本語テキスト", "node_7", "x", "", "worthless", "Quantum,", "aaaa", "STRASSE straße"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(f"{k % 11}:p{k}", str(k % 11) if k % 13 else f"doc{k}", " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), k) for k in range(500)] + [("n", "n", None, 1)]
    n = spark.createDataFrame(rows, "node_id string, source_id string, text string, paragraph int").cache()
    return n, patterns.build_pattern_index(n, f"file://{tmp_path_factory.mktemp('patterns')}")


PATTERNS = [
    "worthless", "WORTH", "alpha|quantum", "(alpha|beta) (eta|x)", "gam+a-delta", "th[eé]orie", "node_[0-9]", "日本語", "a{4}", "(?:wor|ab)thless", "x", "zzz", "zzz|alpha",
    "qu?antum", "[ab]lpha", r"\bbeta\b", r"alpha.*worthless", r"\p{L}+orie", "(?s)alpha.beta", "alpha(?= beta)", "beta(?!x)", "STRAßE", "straße", "[[a]b]eta", "(unclosed", "^alpha$", "", "(alpha )+beta", r"node\_7", "[^a]lpha", "eta{2,3}",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_a_scan(small, pattern):
    n, index = small
    for limit in (3, 1000):
        assert index.search(pattern, limit=limit).collect() == search.regex_search(n, pattern, limit=limit).collect()
    assert index.search(pattern, source_id="3").collect() == search.regex_search(n, pattern, source_id="3").collect()


def test_all_matches_and_late_rounds(small, monkeypatch):
    n, index = small
    monkeypatch.setattr(patterns, "AHEAD", 2)
    for pattern in ("worthless x", "alpha beta"):
        want = search.regex_search(n, pattern, limit=10_000).collect()
        assert want and index.search(pattern, limit=None).collect() == want
        assert index.search(pattern, limit=9).collect() == want[:9]
        monkeypatch.setattr(patterns, "ROUNDS", 1)
        assert index.search(pattern, limit=9).collect() == want[:9]


def test_few_passages_are_read(small):
    n, index = small
    assert index.passages.count() == n.count()
    for pattern, most in (("worthless x worthless", 40), ("zzzz", 0), ("(théorie|node_7) worthless", 120)):
        got = {r.place for r in index.candidates(pattern).collect()}
        holds = {r.place for r in index.passages.where(F.col("text").rlike(f"(?i){pattern}")).collect()}
        assert holds <= got and len(got) <= most
    assert index.candidates("[a-z]+") is None and index.candidates(r"\Qalpha\E") is None


def test_formulas():
    t = patterns.trigram
    assert patterns.formula_of("ab") is None and patterns.formula_of("a.c") is None and patterns.formula_of("") is None
    assert patterns.formula_of("ABCd") == ("and", (t("abc"), t("bcd")))
    assert patterns.formula_of("abc|xyz") == ("or", (t("abc"), t("xyz")))
    assert patterns.formula_of("abc|.") is None and patterns.formula_of("(abc)*") is None
    assert patterns.formula_of("abc.*xyz") == ("and", (t("abc"), t("xyz")))
    assert patterns.formula_of("(abc)+") == t("abc") and patterns.formula_of("abc(?:d)?") == ("or", (t("abc"), ("and", (t("abc"), t("bcd")))))
    assert patterns.formula_of("[ax]bc") == ("or", (t("abc"), t("xbc")))
    for strange in (r"\Qabc", "[a&&b]cde", "(?i)abc", "(?<n>abc)", r"\x41bcd", "[[ab]c]def", "[]a]bcd", "(?x)a b c"):
        assert patterns.formula_of(strange) is None


def holds(f, text):
    if f is None:
        return True
    if isinstance(f, tuple):
        return (all if f[0] == "and" else any)(holds(p, text) for p in f[1])
    return any(patterns.trigram(text[i : i + 3]) == f for i in range(len(text) - 2))


atoms = st.sampled_from(["a", "b", "c", "ab", "abc", "[ab]", "[a-c]", ".", "B", "(a|bc)", "(?:ab|c)", "^", r"\b", "[^a]", "é"])
regexes = st.recursive(atoms, lambda x: st.one_of(st.lists(x, min_size=1, max_size=4).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{1,3}"])).map(lambda p: f"(?:{p[0]}){p[1]}")), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(regexes, st.text("abcABé", min_size=0, max_size=14))
def test_every_match_satisfies_the_formula(pattern, text):
    if re.search(pattern, text, re.IGNORECASE):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        assert holds(patterns.formula_of(pattern), low)


def test_pairs_are_sorted_in_runs_without_a_shuffle(spark, small, tmp_path, monkeypatch):
    n, _ = small
    dealt, real = [], type(n).repartitionByRange
    monkeypatch.setattr(type(n), "repartitionByRange", lambda self, *keys: dealt.append(keys) or real(self, *keys))
    monkeypatch.setattr(patterns, "HELD", 60)
    monkeypatch.setattr(patterns, "BLOCK", 4)
    built = patterns.build_pattern_index(n, f"file://{tmp_path}")
    assert len(dealt) == 1 and "gram" not in dealt[0]
    for pattern in ("worthless x", "(alpha|beta) (eta|x)", "zzz"):
        assert built.search(pattern, limit=1000).collect() == search.regex_search(n, pattern, limit=1000).collect()
