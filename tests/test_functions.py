import hashlib
import unicodedata
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import ids, paths, text
from lexloom.operators import detail


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_headwords(spark):
    assert column(spark, ["  Café   APPLE  ", "①", "ｱ　b", "İ", None], text.normalize_headword) == ["café apple", "1", "ア b", "i̇", None]
    assert column(spark, ["Caf\u00e9", "\u304c"], text.sort_key) == ["cafe", "\u304b\u3099"]
    assert column(spark, ["@@@LINK=apple\r\n\0", "x\n@@@LINK= pear \n", "none", "@@@LINK="], text.parse_redirect) == ["apple", "pear", None, None]


def test_forms_and_policies(spark):
    assert column(spark, ["かな", "漢字", "abc"], text.form_kind) == ["kana", "kanji", None]
    got = column(spark, ["stop", "lie", "city", "box", "bake"], text.inflected_forms)
    assert {"stopped", "stopping"} <= set(got[0]) and "lying" in got[1] and {"cities", "citied"} <= set(got[2]) and "boxes" in got[3] and {"baked", "baking"} <= set(got[4])
    got = column(spark, ["Stop", "lie", "city", "two words"], text.correction_forms)
    assert got == [["stop", "stops", "stopped", "stopping"], ["lie", "lies", "lied", "lying"], ["city", "cities", "citied", "citying"], ["two words"]]
    assert [r.asDict() for r in column(spark, [3, 7, 8], text.length_policy, "int")] == [{"min": 35, "max": 120}, {"min": 50, "max": 150}, {"min": 80, "max": 180}]
    assert column(spark, [["a"], [], ["\x01"], ["!!"], ["x"] * 31, ["y" * 101]], text.valid_items, "array<string>") == [True, False, False, False, False, False]
    assert column(spark, [" id ", "", "a\x00b", "z" * 201], text.valid_identifier) == [True, False, False, False]


def test_compositions(spark):
    assert column(spark, ["ＡＢ don't ﬁt"], text.lexical_tokens, "string") == [["ab", "don't", "fit"]]
    assert column(spark, ["ｗａｌｋ"], text.correction_forms) == [["walk", "walks", "walked", "walking"]]
    assert column(spark, [["e\u0301" * 100], [None], None], text.valid_items, "array<string>") == [True, False, None]
    assert column(spark, ["①a/b", "①かな/汉", "①/b"], lambda c: text.slash_shape(c, 1)) == ["one-ambiguous", "obvious-ja-zh", "right-only"]


def test_covered_items(spark):
    from lexloom.operators.generated import covered_items

    df = spark.createDataFrame([(1, "She was LOOKING forward to it"), (2, "forward looking"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r["items"] for r in covered_items(df, ["look forward", "forward", "it"]).collect()}
    assert got == {1: ["forward", "it", "look forward"], 2: ["forward"], 3: [], 4: []}


def test_coverage_of_phrases(spark):
    df = spark.createDataFrame([("she was looking forward to it", "look forward"), ("forward looking", "look forward"), ("", "x"), ("a b", "")], "t string, w string")
    assert [r.x for r in df.select(text.contains_item(text.composed_tokens(F.col("t")), text.composed_tokens(F.col("w"))).alias("x")).collect()] == [True, False, False, False]


def test_stable_json(spark):
    assert column(spark, ['{"b": 1, "a": {"d": "é", "c": 2}}'], text.stable_json) == ['{"a":{"c":2,"d":"é"},"b":1}']


def test_small_text_functions(spark):
    assert column(spark, ["m", "a/m", "m:1", "a:b/m"], text.model_tag) == ["m:latest", "a/m:latest", "m:1", "a:b/m:latest"]
    assert column(spark, ["<a & 'b'>"], text.escape_xml) == ["&lt;a &amp; &apos;b&apos;&gt;"]
    assert column(spark, ["かな/汉", "a/b", "a", "a/b/c", "/b", "a/"], text.slash_shape) == ["obvious-ja-zh", "one-ambiguous", "none", "multiple", "right-only", "left-only"]


def plain_uuid(*parts):
    raw = bytearray(hashlib.sha256("\0".join(parts).encode()).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x80, raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


def test_identifiers(spark):
    values = [str(i) for i in range(200)]
    assert column(spark, values, lambda v: ids.deterministic_uuid("dictionary", v)) == [plain_uuid("dictionary", v) for v in values]
    assert all(column(spark, values, lambda v: ids.is_uuid(ids.deterministic_uuid(v))))
    assert column(spark, ["x", plain_uuid("a").replace("-8", "-9", 1)], ids.is_uuid)[0] is False
    want = [int(hashlib.sha256(f"s\0{v}".encode()).hexdigest()[:8], 16) / 2**32 < 0.3 for v in values]
    assert column(spark, values, lambda v: ids.in_sample("s", v, 30)) == want
    assert set(column(spark, values, lambda v: ids.in_sample("s", v, 100))) == {True} and set(column(spark, values, lambda v: ids.in_sample("s", v, 0))) == {False}
    assert column(spark, ["5", "101", "x", None, "-1"], ids.parse_percent) == [5, 0, 0, 0, 0]


@pytest.mark.parametrize("path,key", [("a/b.png", "\\a\\b.png"), ("é.png", "\\é.png"), ("A", "\\A"), ("", None), ("/a", None), ("a\\b", None), ("C:/a", None), ("a//b", None), ("./a", None), ("a/..", None), ("a\x00", None), ("a\x7f", None)])
def test_resource_paths(spark, path, key):
    assert column(spark, [path], paths.resource_key) == [key]


def test_references(spark):
    assert column(spark, ["a%20b", "a+b", "%ZZ", "%ff", "", "x" * 4097], paths.decoded_reference) == ["a b", "a+b", None, None, None, None]
    assert column(spark, ["/pic/x.png", "//h/x", "http:x", "../x", "%2e%2e/x"], lambda v: paths.resource_reference(v, True)) == ["pic/x.png", None, None, None, None]
    assert column(spark, ["/pic/x.png", "p"], lambda v: paths.resource_reference(v, False)) == [None, "p"]
    assert column(spark, ["t", " ", "a%00"], paths.entry_reference) == ["t", None, None]
    assert column(spark, ["a.1.MDD", "b.css", "noext", "d/x.Tar.gz"], paths.extension) == [".mdd", ".css", "", ".gz"]


def test_media_types(spark):
    speex = b"OggS\0" + bytes(21) + b"\x01" + b"\x50" + b"Speex   " + bytes(8)
    cases = [b"OggS1", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF\x0a\x0d\x0a\x0aWEBP", b"?", b""]
    assert column(spark, cases, paths.content_type, "binary") == ["audio/ogg", "image/png", "image/jpeg", "image/gif", "image/webp", "application/octet-stream", "application/octet-stream"]
    assert column(spark, [b"ID3x", b"\xff\xfb", b"\xff\x0b"], paths.is_mp3, "binary") == [True, True, False]
    assert column(spark, [speex, b"OggS\0"], paths.is_ogg_speex, "binary") == [True, False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FF) | st.sampled_from("\u0301\u0308\u0327ａＡ①ﬁ가\u1100\u1161が\u304b\u3099…–’"), max_size=12), min_size=1, max_size=20))
def test_composition_in_and_out_of_the_jvm(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(text.nfkc("t").alias("c"), text.without_marks("t").alias("b")).collect()
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) < 0x370)
    assert [tuple(r) for r in got] == [*((unicodedata.normalize("NFKC", t), bare(t)) for t in texts), (None, None)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_keys_that_appear_at_one_place_are_divided_in_order(spark, adaptive):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("o"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for found in (detail.grouped_in_order(rows, "k", "o", "v"), detail.first_seen(rows, "k", "o")):
            got = found.withColumn("part", F.spark_partition_id()).collect()
            assert [r.k for r in got] == list(range(2000)) and (adaptive == "true" or len({r.part for r in got}) > 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_headwords_are_normalised_in_one_step(spark, capsys):
    odd = ["a\x1c b\x85 c", "﻿ a　﻿b  ", "  Ａ\n\n\tb ", "é ŉ", "", " ", None, *[f"Ée {i}" for i in range(600)]]

    def plain(s):
        return text.collapse_spaces(F.lit(unicodedata.normalize("NFKC", s))) if s is not None else F.lit(None).cast("string")

    want = spark.range(1).select(F.array(*[F.lower(plain(s)) for s in odd[:7]]).alias("w")).first().w
    got = column(spark, odd, text.normalize_headword)
    assert got[:7] == want and got[7:] == [f"ée {i}" for i in range(600)]
    assert column(spark, odd[7:], lambda c: text.without_marks(text.normalize_headword(c))) == [f"ee {i}" for i in range(600)]
    spark.createDataFrame([("x",)], "t string").select(text.sort_key(F.col("t"))).explain()
    plan = capsys.readouterr().out
    assert "regexp_replace" not in plan and "translate" not in plan
