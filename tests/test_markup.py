"""The sanitiser by its properties, on generated markup: what may come out, and that it says the same twice."""

import gc
import re
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.functions import markup as mk
from lexloom.functions.text import each

names = st.sampled_from("a b i p div span img script style table td ul li br em strong ruby rt iframe font h2".split())
attributes = st.lists(
    st.tuples(
        st.sampled_from("href src class style onclick onerror lang title data-mdict-kind data-mdict-resource data-mdict-entry-target".split()),
        st.sampled_from(["x", "sound://s/one.ogg", "entry://word", "entry://", "javascript:f()", "pic/one.png", "/pic/one.png", "../up.png", "https://e.example/", "sound://../up.ogg", "data:x", "a b", "é"]),
    ),
    max_size=3,
)


@st.composite
def markup(draw, depth=3):
    out = ""
    for _ in range(draw(st.integers(0, 3))):
        if depth == 0 or draw(st.booleans()):
            out += draw(st.sampled_from(["word ", "a &amp; b", "<", "&lt;i&gt;", " \n", "語", '"']))
            continue
        name = draw(names)
        own = "".join(f' {k}="{v}"' for k, v in draw(attributes))
        out += f"<{name}{own}>{draw(markup(depth - 1))}" + (f"</{name}>" if draw(st.booleans()) else "")
    return out


class Seen(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.tags = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, dict(attrs)))


@settings(max_examples=150, deadline=None)
@given(markup())
def test_only_what_is_allowed_comes_out(raw):
    for tag, own in Seen(mk.sanitize(raw)).tags:
        assert tag not in ("script", "style", "iframe", "font", "img", "table")
        assert not any(k.startswith("on") or k == "style" for k in own)
        for value in (own.get("href"), own.get("src")):
            assert value is None or re.match("https?://|mailto:", value)


@settings(max_examples=150, deadline=None)
@given(markup())
def test_markers_are_made_of_references_only(raw):
    """Markers in the raw markup are forged and go; those that come out name a kind and one target each."""
    made = [own for _, own in Seen(mk.sanitize(raw)).tags if any(k.startswith("data-") for k in own)]
    for own in made:
        kind = own["data-mdict-kind"]
        assert set(own) == {"data-mdict-kind", "data-mdict-entry-target" if kind == "entry" else "data-mdict-resource"}
        assert ".." not in "".join(own.values()) and ":" not in "".join(own.values())
    bare = re.sub(r"(href|src)=", "title=", raw)
    assert "data-mdict" not in mk.sanitize(bare)


@settings(max_examples=150, deadline=None)
@given(markup())
def test_twice_is_once_without_the_markers(raw):
    clean = mk.sanitize(raw)
    bare = re.sub(r' data-mdict-[a-z-]+="[^"]*"', "", clean)
    assert mk.sanitize(clean) == bare == mk.sanitize(bare)
    assert mk.plain_text(clean) == mk.plain_text(bare)


@settings(max_examples=100, deadline=None)
@given(markup())
def test_plain_text_has_no_markup_and_single_spaces(raw):
    text = mk.plain_text(mk.sanitize(raw))
    assert text == text.strip() and not re.search(r"[ \t\n]{2}", text)


def test_a_reference_of_each_kind():
    assert Seen(mk.sanitize('<a href="sound://dir/one.ogg">say</a>')).tags == [("span", {"data-mdict-kind": "sound", "data-mdict-resource": "dir/one.ogg"})]
    assert Seen(mk.sanitize('<a href="entry://two words">see</a>')).tags == [("span", {"data-mdict-kind": "entry", "data-mdict-entry-target": "two words"})]
    assert Seen(mk.sanitize('<img src="dir/one.png">')).tags == [("span", {"data-mdict-kind": "image", "data-mdict-resource": "dir/one.png"})]


@pytest.mark.parametrize("bad", ["sound://", "entry://", "sound://%2e%2e/one", "sound://one%00", "entry://%zz", "sound://one\x07"])
def test_references_to_nothing_are_no_markers(bad):
    assert "data-" not in mk.sanitize(f'<a href="{bad}">t</a>')


def test_in_batches(spark):
    df = spark.createDataFrame([("<em>one</em><u>",), (None,), ("",)], "h string")
    got = [tuple(r) for r in df.select(mk.sanitized("h").alias("s"), mk.plain("h").alias("p")).collect()]
    assert got[1] == (None, None) and got[2] == ("", "") and got[0][1] == "one"


def test_pieces_of_a_batch_and_nulls():
    values = pa.array([None, *[f"<p>{i}</p><b>&amp;" for i in range(600)], None])
    assert each(mk.plain_text, values).to_pylist() == [None, *[f"{i} &amp;" for i in range(600)], None]
    assert each(mk.plain_text, values.slice(0, 0)).to_pylist() == []


def test_a_text_leaves_no_class_behind():
    gc.disable()
    try:
        before = len(HTMLParser.__subclasses__())
        for _ in range(20):
            mk.plain_text("<p>a</p>")
        assert len(HTMLParser.__subclasses__()) == before
    finally:
        gc.enable()
