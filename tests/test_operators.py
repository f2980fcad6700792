import pytest
from pyspark.sql import functions as F

from lexloom.operators import audit, corpus_audit, detail, lines, maintenance, search, validation

ENTRY = "id string, dictionary_id string, headword_original string, headword_normalized string, sort_key string, entry_kind string, entry_plain_text string, redirect_target_original string, redirect_target_normalized string, source_ordinal int, source_record_id string, entry_sanitized_html string"


def entries(spark, *rows):
    full = [(i, "d", w, w, w, kind, text, target, target, n, i, html) for n, (i, w, kind, text, target, html) in enumerate(rows)]
    return spark.createDataFrame(full, ENTRY)


@pytest.fixture(scope="module")
def store(spark):
    e = entries(
        spark,
        ("e1", "ringing", "definition", "t1", None, "<p>"),
        ("e2", "bell", "definition", "t2", None, "<p>"),
        ("e3", "ring", "definition", "t3", None, "<p>"),
        ("e4", "rings", "redirect", "", "ring", ""),
        ("e5", "nowhere", "redirect", "own", "missing", "<i>"),
        ("e6", "chain", "redirect", "", "rings", ""),
    )
    f = spark.createDataFrame([("e2", "ring", "ring", 1), ("e2", "ringer", "ringer", 0), ("e1", "ring", "ring", 0)], "structured_entry_id string, text string, normalized_text string, ordinal int")
    return e.cache(), f.cache()


def test_ranked_search(store):
    e, f = store
    rows = search.ranked_search(e, f, "d", "ring").collect()
    assert [(r.id, r.match_rank, r.matched_form) for r in rows] == [("e3", 0, None), ("e2", 1, "ring"), ("e1", 1, "ring"), ("e4", 2, None)]
    assert "entry_raw" not in rows[0] and "entry_sanitized_html" not in rows[0]
    exact = search.ranked_search(e, f, "d", "ring", "exact").collect()
    assert [r.id for r in exact] == ["e3", "e2", "e1"]
    pages = [search.ranked_search(e, f, "d", "ring", limit=1, offset=k).first().id for k in range(4)]
    assert pages == [r.id for r in rows]
    assert search.ranked_search(e, f, "d", "ring", limit=0).count() == 0


@pytest.mark.parametrize("args", [(" ",), ("x", "fuzzy"), ("x", "exact", 0), ("x", "exact", 101), ("x", "exact", 5, -1)])
def test_bad_requests(args):
    with pytest.raises(ValueError):
        search.check_request(*args)


def test_search_of_a_dictionary(spark, store):
    e, f = store
    d = spark.createDataFrame([("d", "ready", "structured"), ("h", "ready", "html"), ("q", "queued", "html")], "id string, status string, content_model string")
    assert [r.id for r in search.search(d, e, f, "d", " RING ").collect()] == ["e3", "e2", "e1", "e4"]
    assert search.search(d, e, f, "h", "ring").count() == 0
    for missing in ("q", "x"):
        with pytest.raises(LookupError):
            search.search(d, e, f, missing, "ring")


def test_redirects_take_one_hop(store):
    e, _ = store
    got = {r.id: r.resolved_text for r in search.resolve_redirects(e, e).collect()}
    assert got == {"e1": "t1", "e2": "t2", "e3": "t3", "e4": "t3", "e5": "own", "e6": ""}
    shown = {r.id: (r.shown_html, r.shown_text) for r in detail.html_detail(e).collect()}
    assert shown["e4"] == ("<p>", "t3") and shown["e5"] == ("<i>", "own")


def test_missing_html_is_an_error(spark):
    with pytest.raises(Exception, match="entry without HTML"):
        detail.html_detail(entries(spark, ("e1", "a", "definition", "t", None, None))).collect()


def test_suggestions(spark):
    words = ["ask sb", "give sth up", "give", "give", "take", "SB else", "do STH"]
    got = search.suggestions(spark.createDataFrame(list(enumerate(words)), "ord int, headword string"))
    assert [r.headword for r in got.collect()] == ["give", "take", "give sth up", "do STH"]


def test_structured_detail(spark, store):
    e, _ = store
    forms = spark.createDataFrame([("f2", "e1", "b", "ja", "kana", [], [], 1), ("f1", "e1", "a", "ja", "kana", [], [], 0)], "id string, structured_entry_id string, text string, language string, kind string, tags array<string>, restrictions array<string>, ordinal int")
    defs = spark.createDataFrame([("x", "e1", "d", "en", "s", 0)], "id string, structured_entry_id string, text string, language string, source string, ordinal int")
    senses = spark.createDataFrame([("s2", "e1", 1, [], [], [], None), ("s1", "e1", 0, [], [], [], "n")], "id string, structured_entry_id string, ordinal int, part_of_speech array<string>, domains array<string>, tags array<string>, notes string")
    of_sense = spark.createDataFrame([("y", "s2", "g2", "en", "b", 0), ("z", "s2", "g1", "en", "a", 0)], "id string, sense_id string, text string, language string, source string, ordinal int")
    got = {r.id: r for r in detail.structured_detail(e, forms, defs, senses, of_sense).collect()}
    assert [x.text for x in got["e1"].forms] == ["a", "b"] and [s.ordinal for s in got["e1"].senses] == [0, 1]
    assert [d.text for d in got["e1"].senses[1].definitions] == ["g1", "g2"] and got["e1"].senses[0].definitions == []
    assert got["e2"].forms == [] and got["e2"].senses == []


def test_bookmarks(spark, store):
    e, _ = store
    schema = "id string, entry_id string, created_at timestamp"
    have = spark.sql("select 'b1' id, 'e1' entry_id, timestamp'2026-01-01' created_at")
    want = spark.sql("select * from values ('b2', 'e1', timestamp'2026-02-01'), ('b3', 'e2', timestamp'2026-02-01'), ('b4', 'e2', timestamp'2026-03-01'), ('b5', 'nope', timestamp'2026-02-01') v(id, entry_id, created_at)")
    new = detail.add_bookmarks(have, want, e)
    assert [r.id for r in new.collect()] == ["b3"]
    assert [r.id for r in detail.bookmarks(have.unionByName(new), e).collect()] == ["b3", "b1"]
    assert detail.remove_bookmarks(have, have).count() == 0 and schema


def test_jobs(spark):
    jobs = spark.sql("select * from values ('j1', 'running', timestamp'2026-01-01'), ('j2', 'queued', timestamp'2026-01-03'), ('j3', 'queued', timestamp'2026-01-02') v(id, status, created_at)")
    assert detail.next_job(jobs).first().id == "j3"
    done = detail.job_event(jobs.filter("id = 'j1'"), "failed", F.current_timestamp(), F.repeat(F.lit("x"), 9000)).first()
    assert done.status == "failed" and len(done.error) == 8000
    with pytest.raises(Exception, match="no way"):
        detail.job_event(jobs, "completed", F.current_timestamp()).collect()
    assert {r.id: r.status for r in detail.latest(jobs.unionByName(jobs.filter("id = 'j1'").withColumn("status", F.lit("failed")).withColumn("created_at", F.timestamp_add("DAY", F.lit(1), F.col("created_at")))), "id", "created_at").collect()}["j1"] == "failed"


def test_integrity(spark):
    blocks = spark.createDataFrame(
        [("b1", "e1", None, None, "annotation", "note", 0), ("b2", "e1", None, None, "raw", "note", 0), ("b3", "e1", "b9", None, "raw", None, 0), ("b4", "e1", "b4", None, "raw", None, 1)],
        "id string, structured_entry_id string, parent_block_id string, sense_id string, kind string, annotation_kind string, ordinal int",
    )
    other = spark.createDataFrame([("x", "e2", "b1", None, 0)], "id string, structured_entry_id string, content_block_id string, sense_id string, ordinal int")
    got = {(r.table, r.code, r.ref) for r in validation.integrity_issues({"structured_content_blocks": blocks, "structured_examples": other}).collect()}
    assert ("structured_content_blocks", "check:annotation", "b2") in got
    assert ("structured_content_blocks", "check:own_parent", "b4") in got
    assert any(t == "structured_content_blocks" and c.startswith("duplicate") and r == "e1|0" for t, c, r in got)
    assert ("structured_content_blocks", "orphan:structured_entry_id,parent_block_id", "e1|b9") in got
    assert ("structured_examples", "orphan:structured_entry_id,content_block_id", "e2|b1") in got
    with pytest.raises(ValueError, match="cycle"):
        validation.block_levels(blocks)
    levels = {r.id: r.level for r in validation.block_levels(blocks, strict=False).collect()}
    assert levels == {"b1": 0, "b2": 0, "b3": None, "b4": None}
    from lexloom.schemas import schema

    markers = spark.createDataFrame([(None,), ("e1",)], "entry_id string")
    assert [r.x for r in markers.select(validation.missing_values(markers, schema("structured_entries")).alias("x")).collect()] == [["entry_id"], []]


def test_projection_validator_finds_damage(spark):
    records = spark.createDataFrame([(0, "k", "h\n①かな/汉字\n｢かな/汉｣\n㋐x")], "ordinal int, headword string, text string")
    nodes = lines.parse_records(records).cache()
    parts = [lines.forms(records, nodes), lines.project_definitions(nodes), lines.project_examples(nodes), lines.project_blocks(nodes), lines.accounting(nodes)]
    codes = lambda *p: {r.code for r in validation.projection_issues(nodes, *p).collect()}
    assert codes(*parts) == set()
    assert codes(*parts[:4], parts[4].filter("line <> 1")) == {"dropped-ast-node", "accounting-cardinality"}
    assert "invalid-block-parent" in codes(*parts[:3], parts[3].filter("block <> 0"), parts[4])
    assert codes(parts[0].withColumn("form_ordinal", F.lit(-1)), *parts[1:]) == {"invalid-ordinal"}
    assert codes(parts[0], parts[1].withColumn("language", F.upper("language")), *parts[2:]) == {"invalid-language"}


def test_reprocessing(spark):
    rows = [("a", "RAW", "raw!", "raw"), ("b", "raw2", "raw2!", "raw2"), ("c", "x", "x!", "old"), ("d", None, "keep", "keep")]
    e = spark.createDataFrame(rows, "id string, entry_raw string, entry_sanitized_html string, entry_plain_text string")
    run = lambda df: maintenance.reprocess(df, F.concat(F.lower("entry_raw"), F.lit("!")), F.lower("entry_raw"))
    r = maintenance.reprocess_summary(run(e)).first()
    assert (r.processed, r.changed, r.html_changed, r.text_changed, r.unchanged, r.failed) == (4, 1, 0, 1, 2, 1)
    written = maintenance.apply_reprocessed(run(e), e.columns)
    again = maintenance.reprocess_summary(run(written)).first()
    assert (again.changed, again.unchanged, again.failed) == (0, 3, 1)


def test_locator_backfill(spark):
    own = ", ".join(f"mdx_locator_{c} {t}" for c, t in zip(maintenance.LOCATOR, ("int", "string", "string", "int", "bigint", "bigint"), strict=True))
    e = spark.createDataFrame([(i, w, w, f"raw {w}", "definition", None, *[None] * 6) for i, w in enumerate("aabcd")], f"source_ordinal int, headword_original string, headword_normalized string, entry_raw string, entry_kind string, redirect_target_original string, {own}")
    keys = spark.createDataFrame([(i, w, f"raw {w}", "definition", None, 1, "f", w, 0, (1 << 53) + i, (1 << 53) + i + 1) for i, w in enumerate("aabcd")], "source_ordinal int, headword_normalized string, entry_raw string, entry_kind string, redirect_target_original string, version int, file_checksum string, key_text string, key_block_index int, record_start_offset bigint, record_end_offset bigint")

    def seen(entries, keys=keys, checksum="f"):
        aligned = maintenance.align_locators(entries, keys, checksum)
        return maintenance.backfill_summary(aligned, keys).first().asDict(), aligned

    counts, aligned = seen(e)
    assert counts == {"processed": 5, "mappable": 5, "mismatches": 0, "already_populated": 0, "collisions": 0, "written": 5}
    written = maintenance.apply_backfill(aligned, e.columns, keys)
    assert written.orderBy("source_ordinal").first().mdx_locator_record_start_offset == 1 << 53
    assert seen(written)[0]["already_populated"] == 5 and seen(written)[0]["written"] == 0
    partial = written.withColumn("mdx_locator_key_text", F.when(F.col("source_ordinal") > 0, F.col("mdx_locator_key_text")))
    assert seen(partial)[0]["mismatches"] == 1
    moved = written.withColumn("mdx_locator_record_end_offset", F.col("mdx_locator_record_end_offset") + 1)
    assert seen(moved)[0]["mismatches"] == 5
    assert seen(e.withColumn("entry_raw", F.lit("other")))[0]["mappable"] == seen(e, checksum="g")[0]["mappable"] == 0
    # One key twice, even where no entry stands: nothing is written at all.
    twice = keys.unionByName(keys.filter("source_ordinal = 4").withColumn("source_ordinal", F.lit(9)))
    counts, aligned = seen(e, twice)
    assert (counts["mappable"], counts["collisions"], counts["written"]) == (5, 1, 0)
    assert maintenance.apply_backfill(aligned, e.columns, twice).filter("mdx_locator_version is not null").count() == 0
    assert maintenance.locator_key().alias("k") is not None
    assert keys.filter("source_ordinal = 2").select(maintenance.locator_key().alias("k")).first().k == '[1,"f","b",0,"9007199254740994","9007199254740995"]'


def test_levels_of_a_deep_tree(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id int, parent_block_id int")
    assert {r.id: r.level for r in validation.block_levels(chain).collect()} == {i: i for i in range(300)}


def test_what_is_kept_of_rows_with_one_key(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "id string, v int")
    old = spark.createDataFrame([("a", 9), ("c", 9)], "id string, v int")
    assert sorted(map(tuple, maintenance.upsert(rows, old).collect())) == [("a", 1), ("b", 3), ("c", 9)]
    assert sorted(map(tuple, maintenance.upsert(rows, old, order=-F.col("v")).collect())) == [("a", 2), ("b", 3), ("c", 9)]
    assert sorted(map(tuple, maintenance.new_rows(rows.repartition(3), old).collect())) == [("b", 3)]
    kids = spark.createDataFrame([("k1", "a"), ("k2", "c")], "id string, parent string")
    new = spark.createDataFrame([("k3", "a"), ("k4", "b")], "id string, parent string")
    assert sorted(r.id for r in maintenance.rebuild_children(rows, "id", new, kids, "parent").collect()) == ["k2", "k3", "k4"]


def test_writes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "id string, v int, part string")
    maintenance.write_partitions(rows, str(tmp_path / "t"), "part")
    maintenance.write_partitions(rows.filter("part = 'q'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "part")
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 9)}
    maintenance.write_append(rows, str(tmp_path / "u"), "part")
    stored = spark.read.parquet(str(tmp_path / "u"))
    assert maintenance.new_rows(rows.unionByName(spark.createDataFrame([("c", 3, "p")], rows.schema)), stored).collect()[0].id == "c"
    changed = rows.withColumn("v", F.col("v") + (F.col("id") == "b").cast("int"))
    assert [r.id for r in maintenance.conflicts(changed, stored, "id", ["v"]).collect()] == ["b"]


def test_audit_report(spark, tmp_path):
    texts = ["よみ［読み］\n【名】\n①かな/汉\n①又/字\n｢「れい/例｣", "t @@@LINK=░d░【s】🗏1№2", "→ よそ", "x\u200b\n\n注意y\n◯a\n②b", None, ""]
    records = spark.createDataFrame([(i, f"w{i}", t) for i, t in enumerate(texts)], "ordinal int, headword string, text string")
    report = corpus_audit.report(records)
    nodes = report["nodes"].first()
    assert (nodes.entries, nodes.entries_with_blank, nodes.by_type["raw"], nodes.raw_by_reason) == (3, 1, 2, {"blank-line": 1, "unknown-structure": 1})
    found = {(r.topic, r.key): (r.n, r.entries, r.samples) for r in report["facts"].collect()}
    assert {k for t, k in found if t == "shape"} == {"H P D#×2 E", "L", "R", "H 注意 D◯ D#", "EMPTY"}
    assert {k: n for (t, k), (n, *_) in found.items() if t == "numbering"} == {"repeated": 1, "restarting": 1, "mixed": 1}
    assert found["codepoint", "U+1F5CF"] == (1, 1, []) and found["anomaly", "control-or-format"][:2] == (1, 1)
    assert found["section-position", "注意|between-definitions"] == (1, 1, ["注意y"])
    assert found["quote-imbalance", "「」: 1/0"][2][0].startswith("よみ") and found["link", "unexplained-mismatch"][0] == 1
    assert found["heading-pattern", "explicit+reading-orthography"] == (1, 1, ["よみ［読み］"]) and found["examples-per-entry", "0"][1] == 5
    assert found["redirect", "target-missing"][0] == 1 and found["slash-definition", "obvious-ja-zh"] == (1, 1, ["①かな/汉"])
    audit.write_report({"sizes": report["sizes"]}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "sizes")).count() == 1


def test_lazy_details(spark):
    fields = ("version", "file_checksum", "key_text", "key_block_index", "record_start_offset", "record_end_offset")
    raws = {1: ("apple", "<p>text<script>x</script></p>"), 2: ("apfel", "@@@LINK=apple\r\n\0"), 3: ("twice", "@@@LINK=apfel\n"), 4: ("lost", "@@@LINK=nowhere\n"), 5: ("apple", "<p>second</p>")}
    targets = {2: "apple", 3: "apfel", 4: "nowhere"}
    at = lambda i: (1, "f", raws[i][0], 0, i, i + 1)
    records = spark.createDataFrame([(*at(i), h, r) for i, (h, r) in raws.items()], "version int, file_checksum string, key_text string, key_block_index int, record_start_offset long, record_end_offset long, headword string, raw string")
    rows = [(i, "d", h, h, "redirect" if i in targets else "definition", targets.get(i), targets.get(i), i, *at(i)) for i, (h, _) in raws.items()]
    schema = "id int, dictionary_id string, headword_original string, headword_normalized string, entry_kind string, redirect_target_original string, redirect_target_normalized string, source_ordinal int, "
    schema += ", ".join(f"mdx_locator_{n} {k}" for n, k in zip(fields, ("int", "string", "string", "int", "long", "long"), strict=True))
    entries = spark.createDataFrame(rows, schema)
    got = {r.id: (r.resolved_id, r.sanitized_html, r.plain_text) for r in detail.lazy_detail(entries, records).collect()}
    assert got == {1: (None, "<p>text</p>", "text"), 2: (1, "<p>text</p>", "text"), 3: (2, "", ""), 4: (None, "", ""), 5: (None, "<p>second</p>", "second")}
    for bad in (entries.withColumn("headword_original", F.lit("other")), entries.withColumn("mdx_locator_record_end_offset", F.lit(9).cast("long")), entries.withColumn("redirect_target_original", F.lit("x"))):
        with pytest.raises(Exception, match="no record of its own"):
            detail.lazy_detail(bad, records).collect()


def test_pages_as_documents(spark):
    rows = spark.range(50).select("id", (F.col("id") % 3).alias("k")).orderBy(F.desc("k"), "id")
    r = search.response(rows, 4, 15).first()
    assert [(i.id, i.k) for i in r["items"]] == [(47, 2), (1, 1), (4, 1), (7, 1)] and tuple(r.pagination) == (4, 15, 4)
    assert tuple(search.response(rows, 20, 60).first()) == ([], (20, 60, 0))
    with pytest.raises(ValueError, match="limit"):
        search.response(rows, 0)
