import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions.text import align_languages
from lexloom.operators import lines as ln

FULL = "よみ［読み・余味］\n【名】\n◯かなの意味/汉字意思\n｢れいぶん/例子｣\n▶メモ\n派生よむ"


def nodes(spark, *texts, headword="key"):
    return ln.parse_records(spark.createDataFrame([(i, headword, t) for i, t in enumerate(texts)], "ordinal int, headword string, text string")).cache()


def types(df):
    return [r.type for r in df.orderBy("ordinal", "line").collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        (FULL, ["heading", "grammatical-label", "definition", "example", "note", "derivative"]),
        ("【名】\n①かな/汉字\n｢かな/汉｣\n表現いいかた\n②ふた/二", ["grammatical-label", "definition", "example", "expression", "definition"]),
        ("①a\n②b\n◯c\n①d\n㋐e", ["definition"] * 4 + ["subdivision"]),
        ("h\n◈表記x\n◈語法x\n◈表現x\n◈注意x\n◈語源x", ["heading"] + ["special-section"] * 5),
        ("h\n→ よそ\n\n何か", ["heading", "redirect", "raw", "raw"]),
    ],
)
def test_node_types_and_round_trip(spark, text, expected):
    df = nodes(spark, text)
    assert types(df) == expected
    assert ln.serialize(df).first().text == text


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="①｢｣/かa漢\r\n◈", min_size=1, max_size=20), min_size=1, max_size=4))
def test_any_text_round_trips(spark, texts):
    got = {r.ordinal: r.text for r in ln.serialize(nodes(spark, *texts)).collect()}
    assert got == dict(enumerate(texts))


def test_custom_link(spark):
    text = "target @@@LINK=░display░【source】🗏12№345⚠️warn"
    records = spark.createDataFrame([(0, "k", text), (1, "k", "plain")], "ordinal int, headword string, text string")
    r = ln.custom_links(records).first()
    assert (r.target, r.display, r.source, r.page, r.source_id, r.warning) == ("target", "display", "source", "12", "345", "⚠️warn")
    assert ln.parse_records(records).select("ordinal").distinct().count() == 1


def test_ambiguous_lines_are_reported(spark):
    df = nodes(spark, "h\n①かな/汉/字\n｢かな/汉\n何か")
    assert [r.alignment for r in df.filter("alignment is not null").orderBy("line").collect()] == ["ambiguous", "ambiguous"]
    assert {r.code for r in ln.diagnostics(df).collect()} == {"ambiguous-definition-alignment", "ambiguous-example", "ambiguous-example-ownership-or-alignment", "raw-line"}


def test_alignment(spark):
    cases = {"かな/汉字": ("かな", "汉字", "paired"), "/汉字": (None, "汉字", "right-only"), "かな/": ("かな", None, "left-only"), "a/b/c": (None, None, "ambiguous"), "ab/汉": ("ab", "汉", "ambiguous"), "none": (None, None, "ambiguous")}
    df = spark.createDataFrame([(k,) for k in cases], "body string")
    got = {r.body: tuple(r.s) for r in df.select("body", align_languages(F.col("body")).alias("s")).collect()}
    assert got == cases


def test_nested_markers_and_orthographies(spark):
    df = spark.createDataFrame([("🡺x㋐y(1)z[23]⑴", "甲・⟪乙・丙⟫・丁")], "body string, o string")
    r = df.select(ln.nested_markers(F.col("body")).alias("m"), ln.split_orthographies(F.col("o")).alias("o")).first()
    assert [(m.system, m.marker, m.offset) for m in r.m] == [("circled-katakana", "㋐", 3), ("ascii-parenthesized-number", "(1)", 5), ("square-number", "[23]", 9), ("parenthesized-number", "⑴", 13)]
    assert r.o == ["甲", "⟪乙・丙⟫", "丁"]


def test_projection(spark):
    records = spark.createDataFrame([(0, "よ-み", FULL)], "ordinal int, headword string, text string")
    df = ln.parse_records(records)
    assert [(r.text, r.kind) for r in ln.forms(records, df).orderBy("form_ordinal").collect()] == [("よ-み", None), ("読み", "kanji"), ("余味", "kanji")]
    blocks = ln.project_blocks(df).orderBy("block").collect()
    assert [(b.kind, b.annotation_kind, b.parent_block, b.sibling_ordinal) for b in blocks] == [
        ("annotation", "grammar", None, 0), ("definition", None, None, 1), ("example", None, 1, 0), ("annotation", "note", None, 2), ("section", "derivative", None, 3)]
    assert [(d.language, d.text) for d in ln.project_definitions(df).orderBy("language").collect()] == [("ja", "かなの意味"), ("zh-CN", "汉字意思")]
    assert ln.project_examples(df).first().translation == "例子"
    assert all(r.destinations for r in ln.accounting(df).collect())


def test_restart_and_unscoped(spark):
    df = nodes(spark, "h\n㋐x\n①a\n②b\n◯c\n②d\n③e")
    assert sorted((r.line, r.code) for r in ln.diagnostics(df).filter("code in ('numbering-restart', 'unscoped-subdivision')").collect()) == [(1, "unscoped-subdivision"), (5, "numbering-restart")]


BRACKETED = st.text(alphabet="a・⟪⟫⟨⟩㋐⑴(1)[2]😀", max_size=24)


@settings(max_examples=25, deadline=None)
@given(st.lists(BRACKETED, min_size=1, max_size=30))
def test_marks_of_a_walk_are_those_of_every_place(spark, texts):
    """Markers are looked for at every place, brackets counted before every middle dot."""

    def pieces(t):
        depth, out = 0, [""]
        for c in t:
            depth = depth + (c in "⟪⟨") - (c in "⟫⟩" and depth > 0)
            if c == "・" and depth == 0:
                out.append("")
            else:
                out[-1] += c
        return out

    def markers(t):
        out, at = [], 0
        while at < len(t):
            for name, p in ln.SYSTEMS.items():
                if m := re.compile(p).match(t, at):
                    out.append((name, m[0], len(t[:at].encode("utf-16-le")) // 2))
                    at = m.end() - 1
                    break
            at += 1
        return out

    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [([tuple(m) for m in r.m] if r.m is not None else None, r.o) for r in df.select(ln.nested_markers(F.col("t")).alias("m"), ln.split_orthographies(F.col("t")).alias("o")).collect()]
    assert got == [*((markers(t), pieces(t)) for t in texts), (None, None)]
