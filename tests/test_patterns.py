import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import patterns
from lexloom.functions.text import inflected_forms
from lexloom.operators import audit, generated


@settings(max_examples=15, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abé", max_size=12), max_size=6), st.lists(st.text(alphabet="abé", min_size=1, max_size=3), min_size=1, max_size=20))
def test_counts_are_those_of_each_pattern(spark, texts, tokens):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.token: (r.n, r.entries) for r in patterns.occurrence_counts(df, "text", tokens).collect()}
    assert got == {p: (sum((t or "").count(p) for t in texts), sum(p in (t or "") for t in texts)) for p in tokens}


def test_few_and_many_tokens_count_alike(spark, monkeypatch):
    df = spark.createDataFrame([("aaa b aa",), (None,), ("",), ("b\nb",)], "text string")
    few = sorted(map(tuple, audit.token_counts(df, "text", ("aa", "b", "zz")).collect()))
    monkeypatch.setattr(audit, "FEW_TOKENS", 0)
    assert few == sorted(map(tuple, audit.token_counts(df, "text", ("aa", "b", "zz")).collect())) == [("aa", 2, 1), ("b", 3, 2), ("zz", 0, 0)]


def plain(tokens, wanted):
    return [s for s, words in enumerate(wanted) if any(all(k + o < len(tokens) and tokens[k + o] in forms for o, forms in enumerate(words)) for k in range(len(tokens)))]


WORDS = st.sampled_from(["a", "aa", "ab", "b", "ba", "", "é"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=9), min_size=1, max_size=5), st.lists(st.lists(st.lists(WORDS.filter(bool), min_size=1, max_size=3), min_size=1, max_size=3), max_size=6))
def test_sequences_are_found_wherever_they_stand(spark, texts, wanted):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, words array<string>")
    got = {r.id: r.found for r in patterns.sequences(df, "words", wanted).collect()}
    assert got == {**{i: plain(t, wanted) for i, t in enumerate(texts)}, 99: []}


def test_hundreds_of_items(spark):
    items = [f"word{i} stop" for i in range(300)] + ["cat", "the cats", "!!", "cat"]
    texts = [(1, "Word7 stopped; the CAT."), (2, "cats and word299, stops"), (3, None), (4, "word300 stop")]
    got = {r.id: r["items"] for r in generated.covered_items(spark.createDataFrame(texts, "id int, text string"), items).collect()}
    assert got[1] == ["cat", "word7 stop"] and got[2] == ["cat", "word299 stop"] and got[3] == got[4] == []
    assert "cats" in spark.range(1).select(inflected_forms(F.lit("cat"))).first()[0]


def test_patterns_have_bounds(spark, monkeypatch):
    for bad in (["a", ""],):
        with pytest.raises(ValueError, match="empty"):
            patterns.checked(bad)
    monkeypatch.setattr(patterns, "MOST_CHARACTERS", 3)
    with pytest.raises(ValueError, match="characters"):
        patterns.checked(["ab", "cd"])
    with pytest.raises(ValueError, match="empty"):
        patterns.sequences(spark.createDataFrame([], "words array<string>"), "words", [[]])
