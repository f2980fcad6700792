"""Queries over the standard tables, and the SQL each must agree with.

Each query applies an operator of the library to a table that stands in for its own: `part` is a lexicon (brand is the
dictionary, part name the headword, its second word a form), `orders` and `events` stand for jobs and measurements,
`documents`, `pages` and `conversations` for texts. Where order is the point, it is a column of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, paths, text
from ..operators import audit, corpus_audit, detail, generated, lexicon_import, lines, maintenance, reports, search, validation
from ..storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and forms out of `part`."""
    part = table(spark, sf_dir, "part")
    entries = part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("dictionary_id"),
        F.col("p_name").alias("headword_original"),
        F.col("p_name").alias("headword_normalized"),
        F.col("p_name").alias("sort_key"),
        F.lit("definition").alias("entry_kind"),
        F.col("p_type").alias("entry_plain_text"),
        F.lit(None).cast("string").alias("redirect_target_original"),
        F.col("p_partkey").alias("source_ordinal"),
        F.col("p_partkey").cast("string").alias("source_record_id"),
    )
    forms = part.select(F.col("p_partkey").alias("structured_entry_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("text"), F.lit(1).alias("ordinal")).withColumn("normalized_text", F.col("text"))
    return entries, forms


BRAND = "Brand#13"
ARMS = {
    0: "SELECT p_partkey AS id, 0 AS match_rank, NULL AS matched_form, NULL AS o FROM part WHERE p_brand = '{brand}' AND p_name = '{word}'",
    1: "SELECT p_partkey, 1, split_part(p_name, ' ', 2), 1 FROM part WHERE p_brand = '{brand}' AND split_part(p_name, ' ', 2) = '{word}'",
    2: "SELECT p_partkey, 2, NULL, NULL FROM part WHERE p_brand = '{brand}' AND starts_with(p_name, '{word}') AND p_name <> '{word}'",
    3: "SELECT p_partkey, 3, split_part(p_name, ' ', 2), 1 FROM part WHERE p_brand = '{brand}' AND starts_with(split_part(p_name, ' ', 2), '{word}') AND split_part(p_name, ' ', 2) <> '{word}'",
}


def ranked_sql(word: str, arms: tuple[int, ...], end: str) -> str:
    return f"""
WITH candidates AS ({' UNION ALL '.join(ARMS[a] for a in arms).format(brand=BRAND, word=word)}),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_rank, o NULLS FIRST, matched_form NULLS FIRST) AS n FROM candidates)
SELECT p.p_partkey AS id, p_brand AS dictionary_id, p_name AS headword_original, 'definition' AS entry_kind, p_type AS entry_plain_text,
       p_partkey AS source_ordinal, matched_form, CAST(match_rank AS INTEGER) AS match_rank
FROM best JOIN part p ON p.p_partkey = best.id WHERE n = 1 ORDER BY match_rank, p_name, source_ordinal, id {end}
"""


RANKED_COLUMNS = ("id", "dictionary_id", "headword_original", "entry_kind", "entry_plain_text", "source_ordinal", "matched_form", "match_rank")


@query(ranked_sql("r", (0, 1, 2, 3), "LIMIT 50 OFFSET 2"))
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the entries whose headword or form begins with a letter."""
    entries, forms = lexicon(spark, sf_dir)
    return search.ranked_search(entries, forms, BRAND, "r", limit=50, offset=2).select(*RANKED_COLUMNS)


@query(ranked_sql("ring", (0, 1), ""))
def ranked_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, forms = lexicon(spark, sf_dir)
    return search.ranked_search(entries, forms, BRAND, "ring", "exact").select(*RANKED_COLUMNS)


@query("SELECT p_partkey AS id, p_name AS headword, p_partkey AS source_ordinal FROM part WHERE p_brand = 'Brand#16' AND p_name = 'hot rod'")
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _ = lexicon(spark, sf_dir)
    return search.exact(entries, "Brand#16", "hot rod").select("id", F.col("headword_original").alias("headword"), "source_ordinal")


@query("SELECT p_partkey AS id, p_name AS headword, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part WHERE p_brand = 'Brand#13' AND starts_with(p_name, 'old')")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _ = lexicon(spark, sf_dir)
    found = search.prefix(entries, "Brand#13", "old")
    place = F.row_number().over(Window.orderBy("sort_key", "source_ordinal")).cast("long")
    return found.select("id", F.col("headword_original").alias("headword"), place.alias("place"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 25")
def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.seek(lexicon(spark, sf_dir)[0], 100, 25).select("id")


@query("""
SELECT headword, CAST(min(ord) AS BIGINT) AS ord, CASE WHEN regexp_matches(headword, '(?i)\\bring\\b') THEN 1 ELSE 0 END AS bucket
FROM (SELECT p_name AS headword, p_partkey AS ord FROM part) WHERE NOT regexp_matches(headword, '(?i)\\bsb\\b')
GROUP BY headword, 3 ORDER BY 3, ord, headword LIMIT 10
""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", r"\bring\b", "sth").alias("headword"), F.col("p_partkey").alias("ord"))
    found = search.suggestions(words)
    return found.select(F.regexp_replace("headword", r"\bsth\b", "ring").alias("headword"), "ord", "bucket")


@query("""
SELECT d.doc_id, d.source, CASE WHEN d.lang = 'en' THEN d.n_chars ELSE coalesce(t.n_chars, d.n_chars) END AS n_chars, coalesce(d.lang <> 'en' AND t.source IS NOT NULL, false) AS resolved
FROM documents d
LEFT JOIN (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang = 'en') t
  ON d.source = t.source AND t.n = 1
""")
def redirect_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in other languages redirect to the first English text of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    english = docs.filter("lang = 'en'").select(F.lit("x").alias("dictionary_id"), F.col("source").alias("headword_normalized"), F.col("doc_id").alias("source_ordinal"), F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("entry_plain_text"))
    rows = docs.select("doc_id", "source", F.lit("x").alias("dictionary_id"), F.when(F.col("lang") == "en", "definition").otherwise("redirect").alias("entry_kind"), F.col("source").alias("redirect_target_normalized"), F.col("n_chars").cast("string").alias("entry_plain_text"))
    first = search.first_by_headword(english).select(F.col("headword_normalized").alias("source"), F.lit(True).alias("known"))
    found = search.resolve_redirects(rows, english).join(first, "source", "left")
    return found.select("doc_id", "source", F.col("resolved_text").cast("long").alias("n_chars"), F.coalesce((F.col("entry_kind") == "redirect") & F.col("known"), F.lit(False)).alias("resolved"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || '  x ', '\\s+', ' ', 'g'))) AS headword FROM part")
def normalize_headword_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_ascii(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  x "))).alias("headword"))


@query("""
SELECT doc_id, h AS headword, strip_accents(h) AS sort_key, lower(trim(regexp_replace(left(text, 20), '\\s+', ' ', 'g'))) AS narrow
FROM (SELECT doc_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents)
""")
def normalize_headword_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, which are composed already, and their beginnings written in wide letters, which are made narrow."""
    docs = table(spark, sf_dir, "documents")
    wide = F.translate(F.substring("text", 1, 20), "".join(map(chr, range(0x21, 0x7F))), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)))
    head = docs.select("doc_id", text.normalize_headword(F.col("text")).alias("headword"), text.normalize_headword(wide).alias("narrow"))
    return head.withColumn("sort_key", text.without_marks("headword"))


@query("""
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT p_partkey, sha256('part' || chr(0) || p_brand || chr(0) || p_partkey) AS h FROM part)
""")
def deterministic_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ids.deterministic_uuid("part", F.col("p_brand"), F.col("p_partkey")).alias("id"))


@query("SELECT p_partkey FROM part WHERE CAST('0x' || substr(sha256('seed' || chr(0) || p_partkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.2")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(ids.in_sample("seed", F.col("p_partkey"), 20)).select("p_partkey")


@query("SELECT doc_id FROM documents ORDER BY sha256('seed' || chr(0) || doc_id), doc_id LIMIT 20")
def deterministic_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.sample_top(table(spark, sf_dir, "documents").select("doc_id"), "seed", 20, "doc_id", "doc_id")


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def content_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.checksum(F.col("text")).alias("checksum"))


@query("SELECT sha256(string_agg(n || chr(0) || h || chr(0) || s || chr(0), '' ORDER BY k)) AS checksum FROM (SELECT r_regionkey AS k, r_name AS n, sha256(r_name) AS h, length(r_name) AS s FROM region)")
def snapshot_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("name"), F.sha2("r_name", 256).alias("hash"), F.length("r_name").alias("size"))
    return ids.snapshot_checksum(files)


@query("""
SELECT event_type, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max
FROM events GROUP BY event_type
""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latency_statistics(table(spark, sf_dir, "events"), "value", "event_type").withColumn("avg", F.round("avg", 6))


@query("SELECT min(n_chars) AS least, max(n_chars) AS most, median(n_chars) AS median, round(avg(n_chars), 6) AS mean FROM documents")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.size_statistics(table(spark, sf_dir, "documents"), "n_chars").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.size_statistics(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", F.round("median", 6).alias("median"))


@query("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS cold FROM events),
m AS (SELECT event_type, avg(value) FILTER (WHERE cold) AS c, avg(value) FILTER (WHERE NOT cold) AS w FROM e GROUP BY event_type)
SELECT event_type, round(c, 6) AS cold, round(w, 6) AS warm, round(c - w, 6) AS reduction, round(CASE WHEN c <> 0 THEN (c - w) / c * 100 END, 4) AS percent FROM m
""")
def cold_warm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    marked = table(spark, sf_dir, "events").withColumn("cold_run", first)
    found = audit.cold_warm(marked, "event_type", F.col("cold_run"), "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("cold", "warm", "reduction")], F.round("percent", 4).alias("percent"))


@query("SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_groups(table(spark, sf_dir, "documents"), "text")


@query("""
SELECT doc_id, CAST(k - 1 AS INTEGER) AS line, raw
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents)
WHERE NOT (k = n AND raw = '')
""")
def exploded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line", "raw")


@query("""
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN raw = '' THEN 'blank' WHEN regexp_matches(raw, '^[A-Z0-9!? .,]+$') THEN 'capitals' WHEN contains(raw, '|') THEN 'table' WHEN regexp_matches(raw, '[#$%&*]{3}') THEN 'signs' ELSE 'prose' END AS kind
  FROM (SELECT unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (k = n AND raw = '')
) GROUP BY kind
""")
def line_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    kind = F.when(raw == "", "blank").when(raw.rlike("^[A-Z0-9!? .,]+$"), "capitals").when(raw.contains("|"), "table").when(raw.rlike("[#$%&*]{3}"), "signs").otherwise("prose")
    return audit.histogram(lines.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), kind, "kind")


@query("""
WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r),
u AS (SELECT conv_id, run, any_value(role) || CASE WHEN count(*) > 1 THEN '×' || count(*) ELSE '' END AS p FROM s GROUP BY conv_id, run)
SELECT shape, count(*) AS n FROM (SELECT string_agg(p, ' ' ORDER BY run) AS shape FROM u GROUP BY conv_id) GROUP BY shape
""")
def shape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(audit.shapes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role"), "shape", "shape")


@query("""
WITH m AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS k, p_size % 7 = 0 AS o FROM part),
n AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)
SELECT p_brand, count(k) > count(DISTINCT k) AS repeated, coalesce(bool_or(k > b + 1), false) AS skipping, coalesce(bool_or(k <= b), false) AS restarting, bool_or(o) AND count(k) > 0 AS mixed FROM n GROUP BY p_brand
""")
def numbering_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as the numbers of a brand's parts; multiples of seven stand for marks that are no numbers."""
    marks = table(spark, sf_dir, "part").withColumn("number", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    return audit.sequence_flags(marks, "p_brand", "p_partkey", "number", F.col("p_size") % 7 == 0)


@query("""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN nullif(last_value(CASE WHEN role = 'user' THEN turn WHEN role = 'system' THEN -1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS parent
FROM conversations
""")
def active_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    turns = table(spark, sf_dir, "conversations").withColumn("type", role)
    found = lines.containers(turns, "conv_id", "turn", role == "user", role == "system", role == "assistant")
    return found.select("conv_id", "turn", "role", F.col("parent").cast("long").alias("parent"))


@query("""
SELECT conv_id, turn, coalesce(max(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen,
       CASE WHEN l IS NULL THEN 'before-definition' WHEN turn > l THEN 'after-last-definition' ELSE 'between-definitions' END AS place
FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations)
""")
def marks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    seen = audit.seen_before(turns, "conv_id", "turn", F.col("role") == "assistant")
    return audit.around_marks(seen, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "seen", "place")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem")
def per_group_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.row_number().over(place) - 1).cast("long").alias("ordinal"))


@query("""
WITH RECURSIVE t(k, level) AS (
  SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n.n_nationkey, t.level + 1 FROM nation n JOIN t ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = t.k
) SELECT k AS n_nationkey, CAST(level AS INTEGER) AS level FROM t
""")
def block_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a tree in which (k - 1) / 2 is the parent of k."""
    tree = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.expr("(n_nationkey - 1) div 2").cast("int")).alias("parent"))
    return validation.block_levels(tree, "n_nationkey", "parent")


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, coalesce({TOKENS}[1], '') AS first FROM documents")
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.lexical_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("first"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(
    [w, w || 's', w || 'ed', w || 'ing', w || 'er', w || 'est'],
    CASE WHEN w LIKE '%e' THEN [w || 'd', substr(w, 1, length(w) - 1) || 'ing'] ELSE [] END,
    CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN [substr(w, 1, length(w) - 1) || 'ies', substr(w, 1, length(w) - 1) || 'ied', substr(w, 1, length(w) - 1) || 'ier', substr(w, 1, length(w) - 1) || 'iest'] ELSE [] END,
    CASE WHEN w LIKE '%ie' THEN [substr(w, 1, length(w) - 2) || 'ying'] ELSE [] END,
    CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN [w || 'es'] ELSE [] END,
    CASE WHEN regexp_matches(w, '[aeiou][^aeiouywx]$') THEN [w || right(w, 1) || 'ed', w || right(w, 1) || 'ing', w || right(w, 1) || 'er', w || right(w, 1) || 'est'] ELSE [] END))), ' ') AS forms
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part)
""")
def inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.inflected_forms(word)), " ").alias("forms"))


@query("""
WITH w AS (SELECT * FROM (VALUES ('the ing'), ('and'), ('er then'), ('tion')) v(item)),
f AS (SELECT doc_id, text, %s AS t FROM documents),
forms AS (SELECT item, k, [x, x || 's', x || 'ed', x || 'ing', x || 'er', x || 'est'] || CASE WHEN x LIKE '%%e' THEN [x || 'd', substr(x, 1, length(x) - 1) || 'ing'] ELSE [] END
   || CASE WHEN regexp_matches(x, '[aeiou][^aeiouywx]$') THEN [x || right(x, 1) || 'ed', x || right(x, 1) || 'ing', x || right(x, 1) || 'er', x || right(x, 1) || 'est'] ELSE [] END AS fs
   FROM (SELECT item, unnest(string_split(item, ' ')) AS x, generate_subscripts(string_split(item, ' '), 1) AS k FROM w)),
pos AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM f),
hit AS (SELECT DISTINCT doc_id, item, i - k AS start, k FROM pos JOIN forms ON list_contains(fs, tok)),
ok AS (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item, start, count(*) AS n FROM hit GROUP BY ALL) h WHERE n = len(string_split(item, ' ')))
SELECT d.doc_id, w.item, ok.item IS NOT NULL AS covered FROM documents d CROSS JOIN w LEFT JOIN ok ON ok.doc_id = d.doc_id AND ok.item = w.item
""" % TOKENS)
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text has each item, word after word, in some inflection."""
    items = ["the ing", "and", "er then", "tion"]
    found = generated.covered_items(table(spark, sf_dir, "documents"), items, "doc_id")
    return found.select("doc_id", "items", F.explode(F.array(*map(F.lit, items))).alias("item")).select("doc_id", "item", F.array_contains("items", F.col("item")).alias("covered"))


@query("SELECT doc_id, CAST(CASE WHEN k <= 3 THEN 35 WHEN k <= 7 THEN 50 ELSE 80 END AS INTEGER) AS least, CAST(CASE WHEN k <= 3 THEN 120 WHEN k <= 7 THEN 150 ELSE 180 END AS INTEGER) AS most FROM (SELECT doc_id, n_chars % 12 AS k FROM documents)")
def coverage_length_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = text.length_policy(F.col("n_chars") % 12)
    return table(spark, sf_dir, "documents").select("doc_id", bounds.min.alias("least"), bounds.max.alias("most"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '</?(?:br|p|div|li|tr|h[1-6])\\b[^>]*>', ' ', 'gi'), '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths_text("html").alias("text"))


def paths_text(column: str):
    from ..functions.markup import plain_text_column

    return plain_text_column(F.col(column))


@query()
def html_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.markup import plain, sanitized

    return table(spark, sf_dir, "pages").select("page_id", sanitized("html").alias("html")).withColumn("text", plain("html"))


@query("SELECT o_orderkey AS id, c_name, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 100")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred bookmarks: orders of customers."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entry_id"), F.col("o_orderdate").alias("created_at"))
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("headword_original"), F.lit("").alias("entry_plain_text"), F.lit("").alias("dictionary_id"))
    newest = detail.bookmarks(items, entries).limit(100)
    place = F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("id").desc())).cast("long")
    return newest.select("id", F.col("headword_original").alias("c_name"), place.alias("place"))


@query("SELECT c_custkey, coalesce(j.o_orderstatus, 'none') AS status, coalesce(j.o_orderkey, 0) AS progress FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) j ON c_custkey = o_custkey")
def latest_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dictionary_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("progress"), F.lit(None).cast("string").alias("error"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    found = detail.dictionaries_with_jobs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), jobs)
    return found.select(F.col("id").alias("c_custkey"), F.coalesce("job_status", F.lit("none")).alias("status"), F.col("progress").cast("long").alias("progress"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"))
    return detail.next_job(jobs).select("id")


STATES = ("queued", "running", "completed", "failed")


@query("""
SELECT event_id, s, t, (s = 'queued' AND t = 'running') OR (s = 'running' AND t IN ('completed', 'failed')) AS allowed
FROM (SELECT event_id, ['queued', 'running', 'completed', 'failed'][1 + user_id % 4] AS s, ['queued', 'running', 'completed', 'failed'][1 + event_id % 4] AS t FROM events)
""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs that go from the state of their user's number to that of their own."""
    names = F.array(*map(F.lit, STATES))
    both = table(spark, sf_dir, "events").select("event_id", *(F.get(names, (F.col(c) % 4).cast("int")).alias(n) for c, n in (("user_id", "s"), ("event_id", "t"))))
    return both.select("event_id", "s", "t", detail.allowed_transition(F.col("s"), F.col("t")).alias("allowed"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of a table of which every third is stored, given twice."""
    rows = table(spark, sf_dir, "part").select("p_partkey")
    return maintenance.new_rows(rows.unionByName(rows), rows.filter("p_partkey % 3 = 0"), "p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 5 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return maintenance.upsert(old.filter("p_partkey % 5 = 0").withColumn("p_size", F.col("p_size") + 100), old, "p_partkey")


@query("""
SELECT count(*) AS processed, count(*) FILTER (WHERE o = 'changed') AS changed, count(*) FILTER (WHERE h) AS html_changed, count(*) FILTER (WHERE t) AS text_changed,
       count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o = 'failed') AS failed
FROM (SELECT *, CASE WHEN page_id % 10 = 9 THEN 'failed' WHEN h OR t THEN 'changed' ELSE 'unchanged' END AS o
  FROM (SELECT page_id, page_id % 10 <> 9 AND page_id % 4 = 0 AS h, page_id % 10 <> 9 AND page_id % 6 = 0 AS t FROM pages))
""")
def reprocess_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every fourth has stale markup, every sixth a stale text, every tenth no raw entry."""
    pages = table(spark, sf_dir, "pages")
    stored = pages.select(
        F.col("page_id").alias("id"),
        F.when(F.col("page_id") % 10 != 9, F.col("html")).alias("entry_raw"),
        F.when(F.col("page_id") % 4 == 0, "stale").otherwise(F.upper("html")).alias("entry_sanitized_html"),
        F.when(F.col("page_id") % 6 == 0, "stale").otherwise(F.lower("html")).alias("entry_plain_text"),
    )
    return maintenance.reprocess_summary(maintenance.reprocess(stored, F.upper("entry_raw"), F.lower("entry_raw")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'only-left' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'different' ELSE 'equal' END AS outcome,
       CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'lang' END, CASE WHEN doc_id % 5 = 0 THEN 'n_chars' END) END AS labels
FROM documents
""")
def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    copy = docs.filter("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "??").otherwise(F.col("lang")).alias("lang"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n_chars"), "source")
    return maintenance.parity(docs, copy, "doc_id", ["lang", "n_chars", "source"]).withColumn("labels", F.array_join("labels", ","))


@query("SELECT count(*) FILTER (WHERE doc_id % 11 <> 0) AS mapped, count(*) FILTER (WHERE doc_id % 11 = 0) AS missing, count(*) FILTER (WHERE doc_id % 11 <> 0 AND doc_id % 7 = 0) AS lang_mismatch FROM documents")
def mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    copy = docs.filter("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "??").otherwise(F.col("lang")).alias("lang"))
    return maintenance.column_mismatches(docs, copy, "doc_id", ["lang"])


@query("""
SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS items
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nested_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as ordered arrays of structs, shown as text."""
    part = detail.children(table(spark, sf_dir, "lineitem"), "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey"), ("l_linenumber", "l_partkey", "l_returnflag"), "items")
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i.l_linenumber.cast("string"), i.l_partkey.cast("string"), i.l_returnflag)), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(part, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(shown, F.lit("")).alias("items"))


@query("""
SELECT relation, target_known, count(*) AS n FROM (
  SELECT CASE WHEN l_partkey = l_suppkey THEN 'headword=target' WHEN l_partkey = l_orderkey THEN 'headword=display' WHEN contains(CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) THEN 'headword-in-source-orthography' ELSE 'unexplained-mismatch' END AS relation,
         l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS target_known
  FROM lineitem) GROUP BY relation, target_known
""")
def link_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links from parts to suppliers' numbers, known where a large part has that number."""
    text_ = lambda c: F.col(c).cast("string")
    links = table(spark, sf_dir, "lineitem").select(text_("l_partkey").alias("headword"), text_("l_suppkey").alias("target"), text_("l_orderkey").alias("display"), text_("l_orderkey").alias("source"))
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(text_("p_partkey").alias("headword"))
    return audit.link_relations(links, known).groupBy("relation", "target_known").agg(F.count("*").alias("n"))


@query("""
SELECT k, count(*) AS n FROM (
  SELECT '.,: ' || a || '/' || b AS k FROM (SELECT length(text) - length(replace(text, '.', '')) AS a, length(text) - length(replace(text, ',', '')) AS b FROM documents) WHERE a <> b
) GROUP BY k
""")
def imbalance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stops and commas as if they were a pair."""
    each = table(spark, sf_dir, "documents").select(F.explode(audit.imbalance(F.col("text"), {".": ","})).alias("k"))
    return audit.histogram(each, "k", "k")


@query("""
SELECT token, CAST(sum(k) AS BIGINT) AS n, count(*) FILTER (WHERE k > 0) AS entries FROM (
  SELECT token, (length(text) - length(replace(text, token, ''))) // length(token) AS k FROM documents CROSS JOIN (VALUES ('the'), ('***'), ('License'), ('@')) v(token)
) GROUP BY token
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.token_counts(table(spark, sf_dir, "documents"), "text", ("the", "***", "License", "@"))


BENCHMARK_WORDS = r"SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS token FROM benchmark"


@query(f"""
WITH w AS (SELECT token FROM ({BENCHMARK_WORDS}) WHERE length(token) >= 6)
SELECT token, CAST(coalesce(sum(k), 0) AS BIGINT) AS n, count(*) FILTER (WHERE k > 0) AS entries FROM (
  SELECT token, (length(text) - length(replace(text, token, ''))) // length(token) AS k FROM w CROSS JOIN documents
) GROUP BY token
""")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long words of the benchmark, hundreds of them, counted in all documents, within other words, too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("token")).filter(F.char_length("token") >= 6)
    tokens = [r.token for r in words.distinct().orderBy("token").collect()]  # bounded by `patterns.MOST_CHARACTERS`
    return audit.token_counts(table(spark, sf_dir, "documents"), "text", tuple(tokens))


@query("""
WITH t AS (SELECT source, count(*) AS n, count(DISTINCT doc_id) AS entries FROM documents GROUP BY source),
s AS (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY source, lang),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f, lang) AS k FROM s)
SELECT t.source, n, entries, string_agg(lang, ',' ORDER BY k) AS samples FROM t JOIN r ON r.source = t.source AND k <= 3 GROUP BY t.source, n, entries
""")
def keyed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_samples(table(spark, sf_dir, "documents"), "source", "doc_id", "lang").withColumn("samples", F.array_join("samples", ","))


@query("SELECT p_type AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type ORDER BY n DESC, first LIMIT 5")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return audit.most_common(counts, 5)


@query("""
SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source NULLS FIRST) AS BIGINT) AS rank, round(sum(n) OVER (ORDER BY n DESC, source NULLS FIRST ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS share
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return audit.cumulative_share(counts, "source").select("source", "n", F.col("rank").cast("long").alias("rank"), F.round("share", 9).alias("share"))


@query("SELECT n AS key, count(*) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.count_distribution(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 10")
def longest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.longest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 10, "doc_id")


@query("""
SELECT 'duplicate' AS code, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'range', count(*) FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 2 AND 49, false)
""")
def integrity_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")

    def counted(df: DataFrame, code: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")

    duplicate = counted(validation.duplicates(items, "l_orderkey", "l_linenumber"), "duplicate")
    orphan = counted(validation.orphans(items, ("l_orderkey",), orders.filter("o_orderstatus <> 'F'"), ("o_orderkey",)), "orphan")
    outside = counted(items.filter("NOT coalesce(l_quantity BETWEEN 2 AND 49, false)"), "range")
    return duplicate.unionByName(orphan).unionByName(outside)


#: First bytes of a file and the kind they tell.
MAGIC = (("4F67675300", "audio/ogg"), ("89504E470D0A1A0A00", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("524946460000000057454250", "image/webp"), ("00", "application/octet-stream"))


@query(f"SELECT doc_id, {[kind for _, kind in MAGIC]}[1 + doc_id % 6] AS kind FROM documents")
def mime_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind the first bytes of six kinds of files."""
    head = F.get(F.array(*(F.lit(h) for h, _ in MAGIC)), (F.col("doc_id") % 6).cast("int"))
    content = F.concat(F.unhex(head), F.coalesce("text", F.lit("")).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.content_type(content).alias("kind"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(p, '^[^/]+(/[^/]+)*$') AND NOT regexp_matches(p, '(^|/)\\.{1,2}(/|$)|^[A-Za-z]:') THEN '\\' || replace(p, '/', '\\') END AS key
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', CASE WHEN page_id % 3 = 0 THEN '/' WHEN page_id % 3 = 1 THEN '../' ELSE '' END) AS p FROM pages)
""")
def resource_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, "../").otherwise("")
    path = F.regexp_replace("url", F.lit("^[a-z]+://"), lead)
    return table(spark, sf_dir, "pages").select("page_id", paths.resource_key(path).alias("key"))


@query("SELECT lang, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first FROM documents GROUP BY lang")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.first_seen(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query("SELECT o_orderkey AS \"key\", min(l_linenumber) AS first, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def grouped_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detail.grouped_in_order(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return found.select(F.col("l_orderkey").alias("key"), "first", F.array_join(F.transform("rows", lambda r: r.l_partkey.cast("string")), ",").alias("parts"))


@query("SELECT count(*) AS n, array_to_string(list(m ORDER BY doc_id)[1:5], ',') AS samples FROM (SELECT doc_id, 'doc ' || doc_id AS m FROM documents WHERE n_chars < 200)")
def capped_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = table(spark, sf_dir, "documents").filter("n_chars < 200").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("message"))
    found = audit.capped_failures(short, "doc_id", most=5)
    return found.select("n", F.array_join(F.transform("samples", lambda s: s.message), ",").alias("samples"))


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, string_agg(text, '' ORDER BY turn) AS text, 'completed' AS status FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def stream_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts cut into chunks: each request's field, read again from its fragments in order."""
    from ..streaming.json_field import completions, checked_events, ndjson

    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    events = turns.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), F.concat(F.to_json(F.struct(F.col("text").alias("response"), F.lit(False).alias("done"))), F.lit("\n")).alias("chunk"))
    ends = events.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", F.lit('{"response": "", "done": true}'))
    return completions(checked_events(ndjson(events.unionByName(ends))))


@query("""
WITH l AS (
  SELECT doc_id, k - 1 AS line, CASE WHEN k < n OR NOT ends THEN raw END AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n, ends_with(text, chr(10)) OR text = '' AS ends FROM documents)
)
SELECT CASE WHEN raw = '' THEN 'raw' WHEN regexp_matches(raw, '^【[^】]*】$') THEN 'grammatical-label' WHEN regexp_matches(raw, '^[◯①-⑳]') THEN 'definition' WHEN starts_with(raw, '｢') THEN 'example'
            WHEN starts_with(raw, '▶') THEN 'note' WHEN starts_with(raw, '◈') THEN 'special-section' WHEN starts_with(raw, '表現') THEN 'expression' WHEN starts_with(raw, '派生') THEN 'derivative'
            WHEN regexp_matches(raw, '^([㋐-㋾⑴-⒇]|\\([0-9]{1,2}\\)|\\[[0-9]{1,2}\\])') THEN 'subdivision' WHEN regexp_matches(raw, '^→') THEN 'redirect' WHEN line = 0 THEN 'heading' ELSE 'raw' END AS type,
       count(*) AS n
FROM l WHERE raw IS NOT NULL GROUP BY 1
""")
def line_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read under the line grammar: their nodes, blocks and diagnostics in one histogram."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("headword"), "text")
    nodes = lines.parse_records(records)
    return audit.histogram(nodes, "type", "type")


@query("SELECT DISTINCT trim(split_part(p_name, ' ', 1)) AS name FROM part WHERE trim(split_part(p_name, ' ', 1)) <> ''")
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    return reports.model_names(names)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"), F.col("o_orderpriority").alias("package_path"), F.col("o_orderdate").alias("imported_at")
    )
    return reports.most_recent_dictionary(stored).select("id")


@query("""
WITH s AS (SELECT event_id, value, event_type FROM events ORDER BY sha256('run' || chr(0) || event_id), event_id LIMIT 200),
m AS (SELECT *, row_number() OVER (ORDER BY event_id) = 1 AS cold FROM s)
SELECT (SELECT count(*) FROM m) AS samples, (SELECT count(*) FROM m WHERE event_type <> 'view') AS failures, (SELECT max(value) FROM m WHERE cold) AS cold,
       round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max
FROM m WHERE NOT cold
""")
def diagnostic_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of two hundred events as the results of a diagnostic run."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("source_ordinal"), "value", "event_type")
    sample = reports.diagnostic_sample(events, "run", 200).select(F.col("id").alias("ordinal"), F.col("value").alias("milliseconds"), F.when(F.col("event_type") == "view", "ok").otherwise("failed").alias("status"))
    return reports.diagnostic_run(sample).withColumn("avg", F.round("avg", 6))


@query()
def projection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the line grammar, projected: rows by kind, language and code."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("headword"), "text")
    path = shared_path(spark, "outlines")
    lines.outlines(lines.parse_records(records)).write.parquet(path)  # lines are parsed once, not for each count
    nodes = spark.read.parquet(path)
    return reports.projection_audit(lines.forms(records, nodes), lines.project_definitions(nodes), lines.project_examples(nodes), lines.project_blocks(nodes), lines.diagnostics(nodes))


LOCATED = """
SELECT p_partkey AS k, p_name AS w, p_partkey % 11 = 0 AS absent, p_partkey % 13 = 0 AS other_raw, p_partkey % 17 = 0 AS partly, p_partkey % 3 = 0 AS stored, p_partkey % 9 = 0 AS wrong FROM part
"""


def located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries out of `part` and the key list of their source. Of the entries some lack a key, some have another content,
    some half a locator; every third has one, of which every third is wrong."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_ordinal"), F.col("p_name").alias("headword_original"), F.col("p_type").alias("entry_raw"))
    k = F.col("source_ordinal")
    locator = {"version": F.lit(1), "file_checksum": F.lit("f"), "key_text": F.col("headword_original"), "key_block_index": (k % 7).cast("int"), "record_start_offset": k.cast("long") + (1 << 53), "record_end_offset": k.cast("long") + (1 << 53) + 1}
    kinds = [F.col("headword_original").alias("headword_normalized"), F.lit("definition").alias("entry_kind"), F.lit(None).cast("string").alias("redirect_target_original")]
    keys = part.filter(k % 11 != 0).select("source_ordinal", "entry_raw", *kinds, *[c.alias(n) for n, c in locator.items()])
    whole = (k % 3 == 0) & (k % 17 != 0)
    stored = {n: F.when(whole | ((k % 17 == 0) & F.lit(n == "version")), c) for n, c in locator.items()}
    stored["record_end_offset"] = F.when(whole, locator["record_end_offset"] + F.when(k % 9 == 0, 1).otherwise(0))
    raw = F.when(k % 13 == 0, F.concat("entry_raw", F.lit("!"))).otherwise(F.col("entry_raw")).alias("entry_raw")
    return part.select("source_ordinal", "headword_original", raw, *kinds, *[c.alias(f"mdx_locator_{n}") for n, c in stored.items()]), keys


@query(f"""
WITH e AS (SELECT *, NOT absent AND NOT other_raw AND NOT partly AND NOT (stored AND wrong) AS ok FROM ({LOCATED}))
SELECT count(*) AS processed, count(*) FILTER (WHERE ok) AS mappable, count(*) FILTER (WHERE NOT ok) AS mismatches, count(*) FILTER (WHERE ok AND stored) AS already_populated,
       0::BIGINT AS collisions, count(*) FILTER (WHERE ok AND NOT stored) AS written FROM e
""")
def locator_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, keys = located(spark, sf_dir)
    found = maintenance.backfill_summary(maintenance.align_locators(entries, keys, "f"), keys)
    return found.select(*[F.col(c).cast("long").alias(c) for c in found.columns])


@query(f"""
SELECT reason, count(*) AS n FROM (
  SELECT unnest([CASE WHEN absent THEN 'missing' END, CASE WHEN NOT absent AND other_raw THEN 'raw' END, CASE WHEN partly THEN 'partial' END, CASE WHEN NOT absent AND NOT partly AND stored AND wrong THEN 'locator' END]) AS reason
  FROM ({LOCATED})) WHERE reason IS NOT NULL GROUP BY reason
""")
def locator_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, keys = located(spark, sf_dir)
    return maintenance.align_locators(entries, keys, "f").select(F.explode("mismatches").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT k AS source_ordinal, '[1,\"f\",\"' || w || '\",' || k % 7 || ',\"' || (k + 9007199254740992) || '\",\"' || (k + 9007199254740993) || '\"]' AS locator FROM ({LOCATED}) WHERE NOT absent")
def locator_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir)[1].select("source_ordinal", maintenance.locator_key().alias("locator"))


@query("SELECT count(*) - count(DISTINCT p_name) AS collisions, 0::BIGINT AS filled FROM part")
def locator_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose locators are their names only: where they collide, nothing may be filled in."""
    entries, keys = located(spark, sf_dir)
    keys = keys.unionByName(keys.limit(0))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_ordinal"), F.col("p_name").alias("key_text"))
    same = part.select("source_ordinal", "key_text", F.col("key_text").alias("headword_normalized"), F.lit(None).cast("string").alias("entry_raw"), F.lit("definition").alias("entry_kind"), F.lit(None).cast("string").alias("redirect_target_original"), F.lit(1).alias("version"), F.lit("f").alias("file_checksum"), F.lit(0).alias("key_block_index"), F.lit(0).cast("long").alias("record_start_offset"), F.lit(1).cast("long").alias("record_end_offset"))
    bare = entries.filter("mdx_locator_version is null")
    filled = maintenance.apply_backfill(maintenance.align_locators(bare, same, "f"), bare.columns, same).filter("mdx_locator_version is not null")
    return audit.in_one_row(maintenance.locator_collisions(same), filled.agg(F.count("*").alias("filled")))


#: Names of errors, what they say, and their category.
CASES = (
    ("ShadowSanitizerError", "x", "sanitizer"),
    ("LazyDetailPipelineError", "checksum", "sanitizer"),
    ("MdxFileIdentityMismatchError", "", "checksum_mismatch"),
    ("LazyDetailMappingError", "the checksum differs", "checksum_mismatch"),
    ("PartialPersistedMdxLocatorError", "x", "malformed_locator"),
    ("InvalidMdxLocatorError", "x", "malformed_locator"),
    ("LazyDetailMappingError", "has no persisted locator", "missing_locator"),
    ("LazyDetailMappingError", "identity differs", "identity_mismatch"),
    ("LazyDetailMappingError", "does not align", "identity_mismatch"),
    ("LazyDetailMappingError", "other", "mdx_read"),
    ("MdxEntryNotFoundByLocatorError", "identity", "mdx_read"),
    ("TypeError", "checksum", "unknown"),
)


def case_sql(place: int) -> str:
    return f"{[c[place] for c in CASES]}[1 + doc_id % {len(CASES)}]"


@query(f"SELECT doc_id, {case_sql(0)} AS c, {case_sql(2)} AS category FROM documents")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as failures of twelve sorts, whose messages go on with the document's language."""
    one = lambda i: F.get(F.array(*(F.lit(c[i]) for c in CASES)), (F.col("doc_id") % len(CASES)).cast("int"))
    failures = table(spark, sf_dir, "documents").select("doc_id", one(0).alias("c"), F.concat_ws(" ", one(1), F.lit("in"), "lang").alias("m"))
    return failures.select("doc_id", "c", maintenance.failure_category(F.col("c"), F.col("m")).alias("category"))


PAYLOADS = """
SELECT p_partkey AS ordinal, p_name AS headword, p_partkey % 6 AS v, p_size AS z, p_name AS w, p_partkey AS k FROM part
"""
#: By the rest of the key divided by six: a record's text, its heading pattern and relation.
FORMS = (
    ("w || '［' || w || '・x］' || chr(10) || '①a/b' || chr(10) || '表現x'", "explicit+reading-orthography+middle-dot", "contains-index"),
    ("w || chr(10) || '注意y' || chr(10) || 'z'", "explicit+plain", "exact"),
    ("'x-' || k || chr(10) || '◯a' || chr(10) || '派生p・q' || chr(10) || '◯b' || chr(10) || '｢c/d｣'", "explicit+plain+hyphen", "different"),
    ("'【名】' || chr(10) || '①かな/汉' || chr(10) || '③c' || chr(10) || '①d'", "implicit-index-heading", "payload-starts-with-pos"),
    ("'→ ' || w || ' 【x】'", "plain-redirect", "plain-redirect"),
    ("w || ' @@@LINK=░d░【s】🗏1№2'", "link-record", "link-record"),
)


def payload_sql() -> str:
    return f"SELECT ordinal, headword, v, CASE v {' '.join(f'WHEN {i} THEN {t}' for i, (t, *_) in enumerate(FORMS))} END AS text FROM ({PAYLOADS})"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary records of six forms."""
    return spark.sql(payload_sql().replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")).select("ordinal", "headword", "text")


@query(f"""
WITH p AS ({payload_sql()}), f AS (
  SELECT 'heading-pattern' AS topic, CASE v {' '.join(f"WHEN {i} THEN '{h}'" for i, (_, h, _) in enumerate(FORMS))} END AS key, 1 AS n FROM p
  UNION ALL SELECT 'heading-relation', CASE v {' '.join(f"WHEN {i} THEN '{r}'" for i, (*_, r) in enumerate(FORMS))} END, 1 FROM p
  UNION ALL SELECT 'section-position', CASE v WHEN 0 THEN '表現|after-last-definition' WHEN 1 THEN '注意|before-definition' ELSE '派生|between-definitions' END, 1 FROM p WHERE v < 3
  UNION ALL SELECT 'numbering', unnest(['repeated', 'skipping', 'restarting']), 1 FROM p WHERE v = 3
  UNION ALL SELECT 'codepoint', 'U+1F5CF', 1 FROM p WHERE v = 5
  UNION ALL SELECT 'derivative-shape', 'multiple-separators', 1 FROM p WHERE v = 2
  UNION ALL SELECT 'example-note', 'after-notes', 1 FROM p WHERE v = 2
  UNION ALL SELECT 'shape', CASE v WHEN 0 THEN 'H D# 表現' WHEN 1 THEN 'H 注意 RAW' WHEN 2 THEN 'H D◯ 派生 D◯ E' WHEN 3 THEN 'P D#×3' WHEN 4 THEN 'R' ELSE 'L' END, 1 FROM p
  UNION ALL SELECT 'marker', CASE v WHEN 2 THEN '◯' ELSE '①' END, CASE v WHEN 0 THEN 1 ELSE 2 END FROM p WHERE v IN (0, 2, 3)
  UNION ALL SELECT 'marker', '③', 1 FROM p WHERE v = 3
  UNION ALL SELECT 'slash-definition', 'one-ambiguous', 1 FROM p WHERE v = 0
  UNION ALL SELECT 'slash-definition', 'none', 2 FROM p WHERE v IN (2, 3)
  UNION ALL SELECT 'slash-definition', 'obvious-ja-zh', 1 FROM p WHERE v = 3
  UNION ALL SELECT 'redirect', unnest(['records', 'target-in-index']), 1 FROM p WHERE v = 4
  UNION ALL SELECT 'link', unnest(['records', 'parsed', 'target-in-index', 'headword=target']), 1 FROM p WHERE v = 5
) SELECT topic, key, CAST(sum(n) AS BIGINT) AS n, count(*) AS entries FROM f GROUP BY topic, key
""")
def corpus_audit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus audit of records of six forms."""
    topics = ["heading-pattern", "heading-relation", "section-position", "numbering", "codepoint", "derivative-shape", "example-note", "shape", "marker", "slash-definition", "redirect", "link"]
    records = payloads(spark, sf_dir)
    return corpus_audit.facts(records).filter(F.col("topic").isin(topics)).groupBy("topic", "key").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))


@query("SELECT count(*) FILTER (WHERE k % 6 <> 5) AS entries, count(*) FILTER (WHERE k % 6 = 1) AS entries_with_unknown, 0::BIGINT AS entries_with_blank FROM (SELECT p_partkey AS k FROM part)")
def node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.node_audit(lines.parse_records(payloads(spark, sf_dir)).filter("raw not like '注意%' and raw not like '表現%' or raw is null"))
    return found.select("entries", F.col("entries_with_unknown"), "entries_with_blank")


@query("SELECT array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM (SELECT lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'ja')")
def definition_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"))
    found = lexicon_import.definition_languages({"structured_sense_definitions": docs, "structured_entry_definitions": docs.limit(1).select(F.lit("ja").alias("language"))})
    return found.select(F.array_join("languages", ",").alias("languages"))


@query("""
WITH t AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang FROM documents)
SELECT d.doc_id, CASE WHEN d.lang = 'en' OR t.source IS NULL THEN '<p>' || d.n_chars || '</p>' ELSE '<p>' || t.n_chars || '</p>' END AS shown_html
FROM documents d LEFT JOIN t ON d.source = t.source AND t.n = 1
""")
def html_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in other languages than English show the first text of their source."""
    docs = table(spark, sf_dir, "documents")
    html = F.concat(F.lit("<p>"), F.col("n_chars").cast("string"), F.lit("</p>"))
    entries = docs.select(F.col("doc_id").alias("id"), F.lit("d").alias("dictionary_id"), F.col("source").alias("headword_normalized"), F.when(F.col("lang") == "en", "definition").otherwise("redirect").alias("entry_kind"), F.col("source").alias("redirect_target_normalized"), html.alias("entry_sanitized_html"), F.lit("").alias("entry_plain_text"), F.col("doc_id").alias("source_ordinal"))
    return detail.html_detail(entries).select(F.col("id").alias("doc_id"), "shown_html")


@query("""
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_returnflag AS f FROM lineitem)
SELECT o_orderkey AS id, coalesce((SELECT string_agg(p, ',' ORDER BY n, p) FROM i WHERE i.k = o_orderkey AND f = 'A'), '') AS forms,
       coalesce((SELECT string_agg(n || ':' || p, ',' ORDER BY n, p) FROM i WHERE i.k = o_orderkey AND f <> 'A'), '') AS senses
FROM orders
""")
def structured_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries: items returned are their forms, others senses with one definition each."""
    items = table(spark, sf_dir, "lineitem")
    none, word = F.array().cast("array<string>"), F.col("l_partkey").cast("string")
    own = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    forms = items.filter("l_returnflag = 'A'").select(F.lpad(word, 12, "0").alias("id"), F.col("l_orderkey").alias("structured_entry_id"), word.alias("text"), F.lit("ja").alias("language"), F.lit("kana").alias("kind"), none.alias("tags"), none.alias("restrictions"), F.col("l_linenumber").alias("ordinal"))
    other = items.filter("l_returnflag <> 'A'")
    senses = other.select(F.concat(F.lpad(word, 12, "0"), own).alias("id"), F.col("l_orderkey").alias("structured_entry_id"), F.col("l_linenumber").alias("ordinal"), none.alias("part_of_speech"), none.alias("domains"), none.alias("tags"), F.lit(None).cast("string").alias("notes"))
    meanings = other.select(F.lit("m").alias("id"), F.concat(F.lpad(word, 12, "0"), own).alias("sense_id"), word.alias("text"), F.lit("en").alias("language"), F.lit("s").alias("source"), F.lit(0).alias("ordinal"))
    definitions = forms.limit(0).select("id", "structured_entry_id", "text", "language", F.lit("s").alias("source"), "ordinal")
    full = detail.structured_detail(entries, forms, definitions, senses, meanings)
    shown = F.transform("senses", lambda s: F.concat_ws(":", s.ordinal.cast("string"), s.definitions[0].text))
    return full.select("id", F.array_join(F.transform("forms", lambda f: f.text), ",").alias("forms"), F.array_join(shown, ",").alias("senses"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Output is not valid JSON' WHEN 1 THEN '' WHEN 2 THEN 'paragraph is missing requested items: ' || w || '; usedWords does not match the requested vocabulary items' ELSE 'paragraph must contain 35–120 English words' END AS errors
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part)
""")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts of four sorts: broken, sound, without the word, too short."""
    k, word = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1))
    said = F.when(k % 4 == 2, F.lit("qqq")).otherwise(word)
    paragraph = F.concat_ws(" ", said, F.repeat(F.lit("zzz "), F.when(k % 4 == 3, 5).otherwise(39)))
    output = F.to_json(F.struct(paragraph.alias("paragraph"), F.lit("t").alias("translation"), F.array(said).alias("usedWords")))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "{broken").otherwise(output).alias("text"), F.array(word).alias("words"))
    return generated.validate_generated(asked).select("p_partkey", F.array_join("errors", "; ").alias("errors"))


ASKED = "CASE doc_id % 6 WHEN 4 THEN 'ice cream' ELSE coalesce(lang, 'xx') END"


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 6 AS v, {ASKED} AS w FROM documents)
SELECT doc_id, CASE v WHEN 0 THEN 0 WHEN 2 THEN NULL WHEN 4 THEN 80 ELSE 40 END AS word_count, CASE v
  WHEN 0 THEN 'paragraph must be a non-empty string; paragraph must contain 35–120 English words; paragraph is missing requested items: ' || w
  WHEN 2 THEN 'paragraph must be a non-empty string; paragraph must contain 35–120 English words; paragraph is missing requested items: ' || w
  WHEN 3 THEN 'translation must be a non-empty string' WHEN 4 THEN 'usedWords does not match the requested vocabulary items' ELSE '' END AS errors
FROM d
""")
def generated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts with nothing but line breaks, words in wide letters, no paragraph, an empty translation, other blanks
    within a reported word, and sound ones."""
    v, word = F.col("doc_id") % 6, F.expr(ASKED)
    wide = F.translate(word, "abcdefghijklmnopqrstuvwxyz", "".join(chr(c + 0xFEE0) for c in range(0x61, 0x7B)))
    paragraph = F.when(v == 0, "\n\r\n \t").when(v != 2, F.repeat(F.concat(word, F.lit(" ")), 40))
    said = F.when(v == 4, "ice  cream").when(v == 1, F.upper(word)).otherwise(F.concat(F.lit(" "), word, F.lit("\n")))
    output = F.to_json(F.struct(paragraph.alias("paragraph"), F.when(v == 3, "\n").otherwise("t").alias("translation"), F.array(said).alias("usedWords")))
    asked = table(spark, sf_dir, "documents").select("doc_id", output.alias("text"), F.array(F.when(v == 1, wide).otherwise(word)).alias("words"))
    return generated.validate_generated(asked).select("doc_id", "word_count", F.array_join("errors", "; ").alias("errors"))
