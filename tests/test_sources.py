import gzip
import json
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql.functions import lit

from lexloom.operators import lexicon_import as li
from lexloom.sources import html_entries, sqlite_lexicon, stardict, volumes


def container(folder, records, bits=32, compress=False, **info):
    payload, index = b"", b""
    for word, text in records:
        raw = text.encode()
        index += word.encode() + b"\0" + struct.pack(">QI" if bits == 64 else ">II", len(payload), len(raw))
        payload += raw
    head = {"version": "3.0.0", "bookname": "b", "wordcount": len(records), "idxfilesize": len(index), "sametypesequence": "m"} | ({"idxoffsetbits": 64} if bits == 64 else {}) | info
    (folder / "f.ifo").write_text("﻿StarDict's dict ifo file\n" + "".join(f"{k}={v}\n" for k, v in head.items()), encoding="utf-8")
    (folder / "f.idx").write_bytes(index)
    if compress:
        (folder / "f.dict.dz").write_bytes(gzip.compress(payload))
    else:
        (folder / "f.dict").write_bytes(payload)
    return index


@pytest.mark.parametrize("bits,compress", [(32, False), (64, True)])
def test_stardict_scan(spark, tmp_path, bits, compress):
    records = [(f"語{i}", f"text {i}\nline") for i in range(70)]
    container(tmp_path, records, bits, compress)
    spark.dataSource.register(stardict.StarDictSource)
    rows = spark.read.format("stardict").option("rowsPerPartition", "16").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.headword, r.text, r.error) for r in rows] == [(i, w, t, None) for i, (w, t) in enumerate(records)]


@pytest.mark.parametrize("wrong", [{"wordcount": 3}, {"idxfilesize": 1}, {"sametypesequence": "h"}])
def test_stardict_metadata_must_agree(tmp_path, wrong):
    container(tmp_path, [("a", "x"), ("b", "y")], **wrong)
    with pytest.raises(stardict.StarDictError):
        stardict.check(stardict.open_container(str(tmp_path)))


def test_stardict_lenient_scan_reports(spark, tmp_path):
    container(tmp_path, [("a", "x"), ("b", "yy")])
    (tmp_path / "f.dict").write_bytes(b"\xffy")
    spark.dataSource.register(stardict.StarDictSource)
    rows = spark.read.format("stardict").option("mode", "PERMISSIVE").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [r.error for r in rows] == ["payload is not UTF-8", "outside of the payload"]


def test_stardict_offset_index(tmp_path):
    index = container(tmp_path, [(f"w{i}", "x") for i in range(40)])
    starts = [at for i, (_, _, _, at) in enumerate(stardict.parse_index(index, 32)) if i % 32 == 0]
    def faults(data):
        (tmp_path / "f.idx.oft").write_bytes(data)
        return stardict.offset_index_faults(stardict.open_container(str(tmp_path)))

    head = b"StarDict's Cache, Version: 0.2" + b"\xc1\xd1\xa4\x51"
    listed = struct.pack(f"<{len(starts) + 1}I", *starts, len(index))
    assert faults(head + listed) == []
    assert faults(head + listed[:-4] + struct.pack("<I", 5)) == ["1 of 3 entries differ"]
    assert faults(head + listed + b"x") and faults(listed) == ["unexpected header"]


def test_payload_for_random_access(spark, tmp_path):
    """A gzip file whose extra field lists chunks that begin afresh is read chunk by chunk."""
    records = [(f"w{i}", f"text {i} " * 40) for i in range(50)]
    container(tmp_path, records)
    payload, size = (tmp_path / "f.dict").read_bytes(), 1000
    packer, chunks = zlib.compressobj(9, zlib.DEFLATED, -15), []
    for at in range(0, len(payload), size):
        chunks.append(packer.compress(payload[at : at + size]) + packer.flush(zlib.Z_FULL_FLUSH))
    extra = b"RA" + struct.pack("<H", 6 + 2 * len(chunks)) + struct.pack("<HHH", 1, size, len(chunks)) + struct.pack(f"<{len(chunks)}H", *map(len, chunks))
    head = b"\x1f\x8b\x08\x0c" + bytes(6) + struct.pack("<H", len(extra)) + extra + b"f.dict\0"
    (tmp_path / "f.dict.dz").write_bytes(head + b"".join(chunks) + packer.flush() + struct.pack("<II", zlib.crc32(payload), len(payload)))
    (tmp_path / "f.dict").unlink()
    box = stardict.open_container(str(tmp_path))
    assert box.payload() == payload
    assert all(box.span(a, b) == payload[a:b] for a, b in ((0, 10), (990, 1010), (0, len(payload)), (3500, 3500), (len(payload) - 5, len(payload) + 5)))
    spark.dataSource.register(stardict.StarDictSource)
    rows = spark.read.format("stardict").option("rowsPerPartition", "7").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.headword, r.text) for r in rows] == records


def test_truncated_index():
    with pytest.raises(stardict.StarDictError):
        list(stardict.parse_index(b"abc\0\0\0", 32))


ENTRIES = {
    "1": {"id": "1", "kanji": [{"text": "猫", "info": ["i"], "priority": ["p"]}], "kana": [{"text": "ねこ", "info": [], "priority": [], "restricted_to": ["猫"]}],
          "senses": [{"pos": ["n"], "field": [], "misc": [], "notes": "note", "glosses": [{"text": "cat", "lang": "eng", "gloss_type": None}, {"text": "猫科", "lang": "zho", "gloss_type": None}]}]},
    "2": {"id": "2", "kanji": [], "kana": [{"text": "ねこ", "info": [], "priority": [], "restricted_to": []}],
          "senses": [{"pos": [], "field": ["zool"], "misc": [], "notes": None, "glosses": [{"text": "feline", "lang": "eng", "gloss_type": "lit"}]}]},
}


def lexicon_file(path, zh=None, forms=None):
    con = sqlite3.connect(path)
    for t, cols in sqlite_lexicon.REQUIRED.items():
        con.execute(f"CREATE TABLE {t} ({', '.join(cols)}, extra)")
    for i, d in ENTRIES.items():
        con.execute("INSERT INTO entries VALUES (?, 1, ?, NULL)", (i, json.dumps(d)))
    for row in forms or [("猫", "1", 0, 1), ("ねこ", "1", 1, 1), ("ねこ", "2", 1, 0)]:
        con.execute("INSERT INTO forms VALUES (?, ?, ?, ?, NULL)", row)
    con.execute("INSERT INTO jpn_defs VALUES ('1', 's', ?, ?, NULL)", (json.dumps(["動物", "ペット"]), json.dumps([None, [["x", "y"]]])))
    con.execute("INSERT INTO jpn_defs VALUES ('1', 's', ?, ?, NULL)", (json.dumps(["続き"]), json.dumps([None])))
    for i, d in (zh or {"1": {"senses": {"0": {"glosses": [{"text": "猫科"}]}}}, "2": {"senses": {"0": {"glosses": []}}}}).items():
        con.execute("INSERT INTO zh_defs VALUES (?, 'zh-CN', ?, NULL)", (i, json.dumps(d)))
    con.execute("INSERT INTO meta VALUES ('exported_at', '2026-01-01T00:00', NULL)")
    con.execute("INSERT INTO table_licenses VALUES ('entries', 'l', 's', 'a', NULL)")
    con.commit()
    con.close()
    return str(path)


def tables(spark, path):
    return {t: sqlite_lexicon.read(spark, path, t, rows=1) for t in ("entries", "forms", "jpn_defs", "zh_defs")}


def test_lexicon_import(spark, tmp_path):
    path = lexicon_file(tmp_path / "l.db")
    seen = sqlite_lexicon.inspect(spark, path)
    assert seen["counts"]["forms"] == 3 and seen["meta"] == {"exported_at": "2026-01-01T00:00"} and [x["table_name"] for x in seen["licenses"]] == ["entries"]
    out = li.import_lexicon(tables(spark, path), "d")
    entries = {r.source_record_id: r for r in out["dictionary_entries"].collect()}
    assert entries["1"].entry_plain_text == "猫\nねこ\ncat\n動物\nペット\n続き\n猫科" and entries["1"].source_ordinal == 0
    assert entries["2"].headword_original == "ねこ"
    assert [(r.text, r.ordinal) for r in out["structured_entry_definitions"].orderBy("ordinal").collect()] == [("動物", 0), ("ペット", 1), ("続き", 2)]
    assert sorted((r.language, r.text) for r in out["structured_sense_definitions"].collect()) == [("en", "cat"), ("en", "feline"), ("zh-CN", "猫科")]
    assert li.import_summary(out).first().languages == ["en", "ja", "zh-CN"]
    assert li.import_counts(out).first().asDict() == {"dictionary_entries": 2, "structured_entries": 2, "structured_forms": 3, "structured_senses": 2, "structured_entry_definitions": 3, "structured_sense_definitions": 3}
    told = li.write_import(out, str(tmp_path / "import")).first().asDict()
    assert told == {**li.import_counts(out).first().asDict(), "definitions_en": 2, "definitions_ja": 3, "definitions_zh-CN": 1, "languages": ["en", "ja", "zh-CN"]}
    assert {t: spark.read.parquet(str(tmp_path / "import" / t)).count() for t in out} == li.import_counts(out).first().asDict()
    with pytest.raises(ValueError, match="other languages"):
        li.write_import({"other_definitions": out["structured_sense_definitions"].withColumn("language", lit("xx"))}, str(tmp_path / "other"))
    again = li.import_lexicon(tables(spark, path), "d")
    assert {r.id for r in again["structured_forms"].collect()} == {r.id for r in out["structured_forms"].collect()}
    from lexloom.operators.validation import integrity_issues

    assert integrity_issues({k: v for k, v in out.items()}).count() == 0


@pytest.mark.parametrize(
    "zh,forms",
    [
        ({"1": {"senses": {"0": {"glosses": [{"text": "猫科"}]}, "99": {"glosses": []}}}, "2": {"senses": {"0": {"glosses": []}}}}, None),
        ({"1": {"senses": {"0": {"glosses": [{"text": "else"}]}}}, "2": {"senses": {"0": {"glosses": []}}}}, None),
        ({"1": {"senses": {"0": {"glosses": [{"text": "猫科"}]}}}}, None),
        (None, [("猫", "1", 0, 1), ("ねこ", "2", 1, 0)]),
        (None, [("猫", "1", 0, 1), ("ねこ", "1", 1, 1), ("ねこ", "2", 1, 0), ("x", "3", 1, 0)]),
    ],
)
def test_lexicon_problems_stop_the_import(spark, tmp_path, zh, forms):
    path = lexicon_file(tmp_path / "l.db", zh, forms)
    with pytest.raises(ValueError):
        li.import_lexicon(tables(spark, path), "d")


def test_lexicon_schema_is_checked(tmp_path):
    bad = tmp_path / "x.db"
    bad.write_bytes(b"no database")
    with pytest.raises(sqlite_lexicon.LexiconError):
        sqlite_lexicon.validate(str(bad))
    con = sqlite3.connect(tmp_path / "y.db")
    con.execute("CREATE TABLE entries (id)")
    con.commit()
    with pytest.raises(sqlite_lexicon.LexiconError):
        sqlite_lexicon.validate(str(tmp_path / "y.db"))


def test_volumes_first_hit_wins(spark):
    files = spark.createDataFrame([("p/source.1.mdd",), ("p/source.mdd",), ("p/source.2.mdd",), ("p/source.10.mdd",), ("p/a.css",)], "path string")
    ranked = volumes.ordered_volumes(files).orderBy("volume_rank").collect()
    assert [r.path for r in ranked] == ["p/source.mdd", "p/source.1.mdd", "p/source.2.mdd", "p/source.10.mdd"]
    stored = spark.createDataFrame([(0, "\\a.gif", "R0lGODlh"), (1, "\\a.gif", "QUFB"), (1, "\\b", "QUFB")], "volume_rank int, key string, content string")
    got = {r.path: (bytes(r.content), r.media_type) for r in volumes.lookup(stored, spark.createDataFrame([("a.gif",), ("b",), ("../b",), ("A.gif",)], "path string")).collect()}
    assert got == {"a.gif": (b"GIF89a", "image/gif"), "b": (b"AAA", "application/octet-stream")}


def test_packages(spark):
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert volumes.package_problems(frame("r/a.mdx", "r/s.css", "r/x.1.mdd")).count() == 0
    assert volumes.package_problems(frame("a.mdx", "b.mdx", "s.css", "t.css", "s.css", "../e")).count() == 4
    assert sorted(r.path for r in volumes.without_common_root(frame("r/a.mdx", "r/d/b.png")).collect()) == ["a.mdx", "d/b.png"]
    assert sorted(r.path for r in volumes.without_common_root(frame("r/a.mdx", "b.png")).collect()) == ["b.png", "r/a.mdx"]
    assert sorted(r.target for r in volumes.package_layout(frame("a.mdx", "x/s.css", "d/b.png")).collect()) == ["resources/d/b.png", "source.mdx", "styles/s.css"]


def test_stored_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"abc")
    r = volumes.stored_files(spark, str(tmp_path)).first()
    assert r.size == 3 and r.checksum == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_html_entries(spark):
    rows = spark.createDataFrame([(0, " Apple ", "<p>a</p>\0"), (1, "snd", '<a href="sound://p/a.spx"><img src="i"></a>'), (2, "apples", "@@@LINK=apple\r\n\0")], "source_ordinal int, headword string, raw string")
    got = html_entries.import_entries(rows, "d").orderBy("source_ordinal").collect()
    assert [(r.headword_normalized, r.entry_kind, r.entry_plain_text, r.redirect_target_original) for r in got] == [("apple", "definition", "a", None), ("snd", "definition", "", None), ("apples", "redirect", "", "apple")]
    assert "\0" not in got[0].entry_raw
