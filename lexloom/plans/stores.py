"""Queries over stores, containers and streams that Spark writes from the standard tables and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detail, lexicon_import, lines, search
from ..sources import ledger, lookup_store, stardict, stardict_writer
from ..storage import shared_path
from ..streaming import chunk_log, json_field
from .catalog import query, table


WORD = "lower(split_part(text, ' ', 1))"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: their source is the dictionary, their first word the headword."""
    word = F.expr(WORD)
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("dictionary_id"), word.alias("headword_normalized"), word.alias("sort_key"), F.col("doc_id").alias("source_ordinal"), "lang", "n_chars")


def stored(spark: SparkSession, sf_dir: str) -> lookup_store.Store:
    return lookup_store.write(entries(spark, sf_dir), shared_path(spark, "entries"), shard_rows=5000)


@query(f"SELECT doc_id AS id, {WORD} AS headword, n_chars FROM documents WHERE source = 'src3' AND {WORD} = 'the'")
def stored_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One headword of a clustered store."""
    return stored(spark, sf_dir).exact("src3", "the").select("id", F.col("headword_normalized").alias("headword"), "n_chars")


@query(f"SELECT doc_id AS id, {WORD} AS headword, row_number() OVER (ORDER BY {WORD}, doc_id) AS place FROM documents WHERE source = 'src3' AND starts_with({WORD}, 't')")
def stored_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir).prefix("src3", "t")
    place = F.row_number().over(Window.orderBy("sort_key", "source_ordinal")).cast("long")
    return found.select("id", F.col("headword_normalized").alias("headword"), place.alias("place"))


@query(f"SELECT doc_id AS id, source AS dictionary_id, {WORD} AS headword FROM documents WHERE (source, {WORD}) IN (SELECT (source, {WORD}) FROM documents WHERE doc_id % 100 = 0)")
def stored_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries under the headwords of every hundredth."""
    store = stored(spark, sf_dir)
    return store.lookup(entries(spark, sf_dir).filter("id % 100 = 0")).select("id", "dictionary_id", F.col("headword_normalized").alias("headword"))


HEAD = "CASE WHEN doc_id % 3 = 0 THEN translate(split_part(text, ' ', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE split_part(text, ' ', 1) END"


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as containers and read for lookups: first words are the headwords, some in capitals, whole texts
    the payloads. Texts that begin with a blank have no headword and are left out."""
    docs = table(spark, sf_dir, "documents").filter("split_part(text, ' ', 1) <> ''")
    folder = shared_path(spark, "containers")
    stardict_writer.write_containers(docs.select(F.expr(HEAD).alias("headword"), "text", "doc_id"), folder, ("doc_id",))
    return stardict.for_lookups(spark, folder)


HELD = f"(SELECT {HEAD} AS headword, text, doc_id FROM documents WHERE split_part(text, ' ', 1) <> '')"


@query(f"SELECT headword, sha256(text) AS checksum FROM {HELD} WHERE headword IN ('the', 'THE', 'nothing such')")
def container_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers(spark, sf_dir).filter(F.col("headword").isin("the", "THE", "nothing such"))
    return found.select("headword", F.sha2("text", 256).alias("checksum"))


@query(f"SELECT headword, sha256(text) AS checksum FROM {HELD} WHERE starts_with(headword, 'Th')")
def container_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir).filter(F.col("headword").startswith("Th")).select("headword", F.sha2("text", 256).alias("checksum"))


@query(f"""
SELECT CAST(row_number() OVER (ORDER BY translate(headword, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), headword, doc_id) - 1 AS INTEGER) AS ordinal,
       headword, octet_length(encode(text)) AS size FROM {HELD}
""")
def container_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in the order of the format, which their numbers follow over all containers."""
    return containers(spark, sf_dir).select("ordinal", "headword", F.col("size").cast("long").alias("size"))


def assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select(F.col("conv_id").cast("string").alias("request_id"), "turn", "text")


def cut(rows: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """request_id, seq and pieces of so many characters or bytes of each row's text, in order, and a null at the end."""
    value, n = F.col(text), F.octet_length(text) if dict(rows.dtypes)[text] == "binary" else F.char_length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda i: F.substring(value, i * size + 1, F.lit(size)))
    return rows.select("request_id", F.posexplode(F.concat(pieces, F.array(F.lit(None).cast(dict(rows.dtypes)[text])))).alias("seq", name)).withColumn("seq", F.col("seq").cast("long"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source is at its end, by way of a ledger."""
    spark, folder = stream.sparkSession, shared_path(stream.sparkSession, name)
    spark.dataSource.register(ledger.Ledger)
    run = stream.writeStream.format("ledger").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/ledger")
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return ledger.read(spark, f"{folder}/ledger").drop(ledger.BATCH)


def streamed(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Chunks appended to logs and read from them as a stream."""
    folder = shared_path(spark, "logs")
    chunk_log.append_logs(chunks, folder)
    spark.dataSource.register(chunk_log.ChunkLog)
    return spark.readStream.format("chunk-log").option("bytesPerPartition", str(16 << 20)).load(folder)


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, text AS response FROM conversations WHERE role = 'assistant'")
def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator lines cut into chunks of 50 bytes, anywhere, read from logs as a stream and framed into lines again."""
    line = F.to_json(F.struct(F.col("text").alias("response"), F.lit(False).alias("done")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n")
    requests = assistant(spark, sf_dir).groupBy("request_id").agg(joined.cast("binary").alias("data"))
    found = finished(json_field.framed_lines(streamed(spark, cut(requests, "data", 50, "chunk"))), "lines")
    return json_field.checked_events(found).filter("problem is null").select("request_id", "seq", "response")


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, string_agg(text, chr(10) ORDER BY turn) AS paragraph FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def streamed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of each conversation's generated JSON, read while its fragments of 30 characters come in."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n")
    requests = assistant(spark, sf_dir).groupBy("request_id").agg(F.to_json(F.struct(F.lit('"paragraph": ').alias("note"), joined.alias("paragraph"), F.lit("t").alias("translation"))).alias("json"))
    pieces = cut(requests, "json", 30, "fragment").withColumn("chunk", F.col("fragment").cast("binary")).drop("fragment")
    stream = streamed(spark, pieces).withColumn("fragment", F.col("chunk").cast("string"))
    deltas = finished(json_field.field_deltas(stream), "fields")
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return deltas.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x.delta), "").alias("paragraph"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id % 4 AS v FROM conversations WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS request_id, CASE v WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'protocol-error' END AS status,
       CASE v WHEN 3 THEN '' ELSE coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE v <> 1 OR k > 1), '') END AS draft
FROM e GROUP BY conv_id, v
""")
def streamed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as the deltas of attempts: sound ones, ones with a retry behind the first reply, failures, double retries."""
    turns = assistant(spark, sf_dir).withColumn("v", F.col("request_id").cast("long") % 4)
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("turn"))
    deltas = turns.withColumn("seq", (10 * nth).cast("long")).withColumn("kind", F.lit("delta"))
    first, last = deltas.filter("seq = 10"), deltas.groupBy("request_id", "v").agg((F.max("seq") + 5).alias("seq"))
    none = F.lit(None).cast("string").alias("text")
    events = [deltas.select("request_id", "seq", "kind", "text")]
    events += [first.filter(f"v {rule}").select("request_id", (F.col("seq") + by).alias("seq"), F.lit("retry").alias("kind"), none) for rule, by in (("in (1, 3)", 1), ("= 3", 2))]
    events.append(last.select("request_id", "seq", F.when(F.col("v") == 2, "error").otherwise("result").alias("kind"), none))
    folder = shared_path(spark, "events")
    for e in events:
        e.write.mode("append").parquet(folder)
    return finished(json_field.attempt_results(spark.readStream.schema("request_id string, seq long, kind string, text string").parquet(folder)), "attempts")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN n_chars + 100 ELSE n_chars END AS n_chars FROM documents")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in two batches, one of them twice, and every fifth again with another size; the last count."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), shared_path(spark, "ledger")
    for batch, rows in (("1", docs.filter("doc_id % 2 = 0")), ("2", docs.filter("doc_id % 2 = 1")), ("2", docs), ("3", docs.filter("doc_id % 5 = 0").withColumn("n_chars", F.col("n_chars") + 100))):
        ledger.append(rows, folder, batch)
    return ledger.snapshot(ledger.read(spark, folder), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS ways FROM documents")
def ledger_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inserted into a ledger that has every third, otherwise: these stay, and are told as conflicts."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "lang"), shared_path(spark, "ledger")
    ledger.append(docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("stored")), folder, "1")
    ledger.append(docs, folder, "2")
    rows = ledger.read(spark, folder)
    kept = ledger.snapshot(rows, "doc_id", keep="first")
    return kept.join(ledger.conflicts(rows, "doc_id"), "doc_id", "left").select("doc_id", "lang", F.coalesce("ways", F.lit(1)).cast("int").alias("ways"))


WORDS = [*(f"coalesce(nullif(split_part(text, ' ', {i}), ''), 'x{i}') AS w{i}" for i in (1, 2, 3)), "coalesce(lang, 'zz') AS zh"]
EXPORT = f"(SELECT doc_id, {', '.join(WORDS)} FROM documents)"


def exported(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as the tables of a lexicon's export, written and read again: first and second word are the forms, the third
    the English gloss, the language the Chinese one; every second entry has two Japanese definitions."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) entry_id", "doc_id", *WORDS)
    none = F.array().cast("array<string>")

    def form(word: str, *more: Column) -> Column:
        return F.array(F.struct(F.col(word).alias("text"), none.alias("info"), none.alias("priority"), *more))

    def gloss(word: str, lang: str) -> Column:
        return F.struct(F.col(word).alias("text"), F.lit(lang).alias("lang"), F.lit(None).cast("string").alias("gloss_type"))

    sense = F.struct(F.array(F.lit("n")).alias("pos"), none.alias("field"), none.alias("misc"), F.lit(None).cast("string").alias("notes"), F.array(gloss("w3", "eng"), gloss("zh", "zho")).alias("glosses"))
    data = F.to_json(F.struct(F.col("entry_id").alias("id"), form("w1").alias("kanji"), form("w2", none.alias("restricted_to")).alias("kana"), F.array(sense).alias("senses")))
    both = F.explode(F.array(*(F.struct(F.col(w).alias("text"), F.lit(k).alias("is_kana"), (F.col("doc_id") * 2 + k).alias("ord")) for k, w in enumerate(("w1", "w2"))))).alias("f")
    zh = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("zh").alias("text"))).alias("glosses")).alias("0")).alias("senses")))
    tables = {
        "entries": docs.select(F.col("entry_id").alias("id"), data.alias("data")),
        "forms": docs.select("entry_id", both).select("entry_id", "f.*"),
        "jpn_defs": docs.filter("doc_id % 2 = 0").select("entry_id", F.col("doc_id").alias("ord"), F.lit("s").alias("source"), F.to_json(F.array("w2", "w3")).alias("glosses"), F.lit("[null,null]").alias("furigana")),
        "zh_defs": docs.select("entry_id", zh.alias("data")),
    }
    folder = shared_path(spark, "export")
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS source_record_id, w1 AS headword, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INTEGER) AS source_ordinal,
       sha256(w1 || chr(10) || w2 || chr(10) || w3 || chr(10) || CASE WHEN doc_id % 2 = 0 THEN w2 || chr(10) || w3 || chr(10) ELSE '' END || zh) AS checksum
FROM {EXPORT}
""")
def imported_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon's export checked and imported: every entry with its place and all its forms and definitions."""
    entries = lexicon_import.import_lexicon(exported(spark, sf_dir), "d")["dictionary_entries"]
    return entries.select("source_record_id", F.col("headword_original").alias("headword"), "source_ordinal", F.sha2("entry_plain_text", 256).alias("checksum"))


@query(f"""
SELECT count(*) AS dictionary_entries, count(*) AS structured_entries, 2 * count(*) AS structured_forms, count(*) AS structured_senses, 2 * count(*) FILTER (WHERE doc_id % 2 = 0) AS structured_entry_definitions,
       2 * count(*) AS structured_sense_definitions, count(*) AS "definitions_en", 2 * count(*) FILTER (WHERE doc_id % 2 = 0) AS "definitions_ja", count(*) AS "definitions_zh-CN", 'en,ja,zh-CN' AS languages
FROM {EXPORT}
""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of an import written, and counted as they are."""
    imported = lexicon_import.import_lexicon(exported(spark, sf_dir), "d")
    return lexicon_import.write_import(imported, shared_path(spark, "import")).withColumn("languages", F.array_join("languages", ","))


@query(f"""
SELECT text, language, source, ordinal, count(*) AS n FROM (
  SELECT w3 AS text, 'en' AS language, 'jmdict' AS source, 0 AS ordinal FROM {EXPORT}
  UNION ALL SELECT zh, 'zh-CN', 'lexicon', 0 FROM {EXPORT}
  UNION ALL SELECT CASE k WHEN 0 THEN w2 ELSE w3 END, 'ja', 's', k FROM {EXPORT} CROSS JOIN (VALUES (0), (1)) v(k) WHERE doc_id % 2 = 0
) GROUP BY ALL
""")
def imported_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = lexicon_import.import_lexicon(exported(spark, sf_dir), "d")
    columns = ("text", "language", "source", "ordinal")
    every = tables["structured_sense_definitions"].select(*columns).unionByName(tables["structured_entry_definitions"].select(*columns))
    return every.groupBy(*columns).agg(F.count("*").alias("n"))


#: How a text's line is written under the grammar, by its number (from 1) modulo six.
PLANTED = ("'◈注意' || raw", "'①' || raw", "'｢' || raw || '｣'", "'▶' || raw", "'㋐' || raw || '⑴b(3)c'", "'表現' || raw")
TYPES = ("special-section", "definition", "example", "note", "subdivision", "expression")
HEADS = "'かな［漢' || doc_id || '・⟪甲・乙⟫・' || coalesce(lang, 'zz') || '］'"
PLANTED_LINES = f"""(
  SELECT doc_id, 0 AS line, {HEADS} AS raw FROM documents
  UNION ALL SELECT doc_id, k, CASE k % 6 {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(PLANTED))} END
  FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS raw, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)
)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of the line grammar: a heading, and all their lines with marks by turns."""
    texts = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n")
    marked = F.transform(texts, lambda raw, i: _written(raw, (i + 1) % 6))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.array_join(F.concat(F.array(F.expr(HEADS)), F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(marked)), "\n"))
    return docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("headword"), "text")


def _written(raw: Column, turn: Column) -> Column:
    lead = F.element_at(F.array(*map(F.lit, ("◈注意", "①", "｢", "▶", "㋐", "表現"))), (turn + 1).cast("int"))
    return F.concat(lead, raw, F.when(turn == 2, "｣").when(turn == 4, "⑴b(3)c").otherwise(""))


@query(f"SELECT doc_id AS ordinal, sha256(string_agg(raw, chr(10) ORDER BY line)) AS checksum FROM {PLANTED_LINES} GROUP BY doc_id")
def grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken apart into nodes and put together again."""
    return lines.serialize(lines.parse_records(planted(spark, sf_dir))).select("ordinal", F.sha2("text", 256).alias("checksum"))


@query(f"""
SELECT doc_id AS ordinal, line, CASE WHEN line = 0 THEN 'heading' ELSE {list(TYPES)}[1 + line % 6] END AS type, CASE WHEN line > 0 AND line % 6 IN (2, 4) THEN line - 1 END AS parent FROM {PLANTED_LINES}
""")
def grammar_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with the container that owns it."""
    found = lines.containers(lines.parse_records(planted(spark, sf_dir)))
    return found.select("ordinal", F.col("line").cast("long").alias("line"), "type", F.col("parent").cast("long").alias("parent"))


@query(f"""
SELECT doc_id AS ordinal, line, array_to_string(m, ',') AS markers, strpos(body, m[1]) - 1 AS first, length(body) - 6 AS planted FROM (
  SELECT *, regexp_extract_all(body, '[㋐-㋾]|[⑴-⒇]|\\([0-9]{{1,2}}\\)|\\[[0-9]{{1,2}}\\]') AS m FROM (SELECT doc_id, line, substr(raw, 2) AS body FROM {PLANTED_LINES} WHERE line > 0 AND line % 6 = 4))
""")
def grammar_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers within every subdivision: all of them, where the first stands, and where the first planted one does."""
    nodes = lines.parse_records(planted(spark, sf_dir)).filter("type = 'subdivision'")
    found = nodes.select("ordinal", F.col("line").cast("long").alias("line"), lines.nested_markers(F.col("body")).alias("m"))
    at = F.get(F.filter("m", lambda m: m.marker == "⑴"), F.size(F.filter("m", lambda m: m.marker == "⑴")) - 1).getField("offset")
    return found.select("ordinal", "line", F.array_join(F.transform("m", lambda m: m.marker), ",").alias("markers"), F.get("m", F.lit(0)).getField("offset").cast("long").alias("first"), at.cast("long").alias("planted"))


@query("""
SELECT doc_id AS ordinal, k AS form_ordinal, ['k' || doc_id, 'かな', '漢' || doc_id, coalesce(lang, 'zz')][k + 1] AS text, [NULL, 'kana', 'kanji', NULL][k + 1] AS kind
FROM documents CROSS JOIN (VALUES (0), (1), (2), (3)) v(k)
""")
def grammar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of every record: its key, its reading, and the spellings that stand outside of brackets."""
    records = planted(spark, sf_dir)
    return lines.forms(records, lines.parse_records(records)).select("ordinal", F.col("form_ordinal").cast("int").alias("form_ordinal"), "text", "kind")


@query(f"""
SELECT doc_id AS ordinal, line - 1 AS block, CASE WHEN line % 6 IN (2, 4) THEN line - 2 END AS parent_block, ['section', 'definition', 'example', 'annotation', 'subdivision', 'section'][1 + line % 6] AS kind,
       ['caution', NULL, NULL, 'note', NULL, 'expression'][1 + line % 6] AS annotation_kind
FROM {PLANTED_LINES} WHERE line > 0
""")
def grammar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every record, with the block that owns each."""
    found = lines.project_blocks(lines.parse_records(planted(spark, sf_dir)))
    return found.select("ordinal", F.col("block").cast("long").alias("block"), F.col("parent_block").cast("long").alias("parent_block"), "kind", "annotation_kind")


@query("""
WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS redirects, coalesce(source, 'none') AS s FROM documents), t AS (SELECT s, min(doc_id) AS t FROM d WHERE NOT redirects GROUP BY s)
SELECT d.doc_id AS id, CASE WHEN redirects THEN t END AS resolved_id, CASE WHEN NOT redirects THEN 'text ' || doc_id WHEN t IS NULL THEN '' ELSE 'text ' || t END AS plain_text
FROM d LEFT JOIN t ON d.s = t.s
""")
def lazy_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries that hold locators only; every third redirects to the first other one of its source."""
    k, redirects = F.col("doc_id"), F.col("doc_id") % 3 == 0
    name = F.coalesce("source", F.lit("none"))
    head = F.when(redirects, F.concat(F.lit("r"), k.cast("string"))).otherwise(name)
    locator = {"version": F.lit(1), "file_checksum": F.lit("f"), "key_text": head, "key_block_index": (k % 7).cast("int"), "record_start_offset": k, "record_end_offset": k + 1}
    docs = table(spark, sf_dir, "documents")
    entries = docs.select(
        k.alias("id"), F.lit("d").alias("dictionary_id"), head.alias("headword_original"), head.alias("headword_normalized"), F.when(redirects, "redirect").otherwise("definition").alias("entry_kind"),
        F.when(redirects, name).alias("redirect_target_original"), F.when(redirects, name).alias("redirect_target_normalized"), k.alias("source_ordinal"), *(c.alias(f"mdx_locator_{n}") for n, c in locator.items()),
    )
    raw = F.when(redirects, F.concat(F.lit("@@@LINK="), name, F.lit("\r\n"))).otherwise(F.concat(F.lit("<p onclick=x>text "), k.cast("string"), F.lit("</p>")))
    records = docs.select(*(c.alias(n) for n, c in locator.items()), head.alias("headword"), raw.alias("raw"))
    return detail.lazy_detail(entries, records).select("id", "resolved_id", "plain_text")


@query(f"""
WITH p AS (SELECT doc_id, {WORD} AS w FROM documents WHERE source = 'src3' AND starts_with({WORD}, 't') ORDER BY w, doc_id LIMIT 20 OFFSET 5)
SELECT coalesce(string_agg(doc_id || ':' || w, ',' ORDER BY w, doc_id), '') AS items, 20 AS "limit", 5 AS "offset", count(*) AS returned FROM p
""")
def paged_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a prefix search as one document."""
    found = search.response(search.prefix(entries(spark, sf_dir), "src3", "t").select("id", "headword_normalized"), 20, 5)
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["id"].cast("string"), i["headword_normalized"])), ",")
    return found.select(shown.alias("items"), "pagination.*")
