"""SQLite lexicon exports to the model's tables: parse, check, align, and give identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.ids import deterministic_uuid
from ..functions.text import normalize_headword, sort_key
from .audit import in_one_row
from .ordering import running

# The shapes of the export's JSON columns.
ENTRY = (
    "struct<id:string,kanji:array<struct<text:string,info:array<string>,priority:array<string>>>,"
    "kana:array<struct<text:string,info:array<string>,priority:array<string>,restricted_to:array<string>>>,"
    "senses:array<struct<pos:array<string>,field:array<string>,misc:array<string>,notes:string,glosses:array<struct<text:string,lang:string,gloss_type:string>>>>>"
)
ZH = "struct<senses:map<string,struct<glosses:array<struct<text:string>>,notes:string,examples:map<string,string>>>>"
STRINGS = "array<string>"
#: The languages that definitions may be in.
LANGUAGES = ("en", "ja", "zh-CN")


def _must(condition: Column, message: str, value: Column) -> Column:
    """value, or an error that names the entry where the condition doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + " in entry "), F.col("entry_id"))))


def parse_entries(entries: DataFrame, dictionary: str) -> DataFrame:
    """entry_id (source), id, source_ordinal, forms, senses. JSON of another shape, or of another entry, is an error."""
    parsed = entries.select(F.col("id").alias("entry_id"), F.from_json("data", ENTRY, {"mode": "FAILFAST"}).alias("d"))
    none = F.array().cast(STRINGS)
    kanji = F.transform(F.coalesce("d.kanji", F.array()), lambda k: F.struct(k.text.alias("text"), F.lit("kanji").alias("kind"), k.info.alias("tags"), k.priority.alias("priority_tags"), none.alias("restrictions")))
    kana = F.transform(F.coalesce("d.kana", F.array()), lambda k: F.struct(k.text.alias("text"), F.lit("kana").alias("kind"), k.info.alias("tags"), k.priority.alias("priority_tags"), k.restricted_to.alias("restrictions")))
    known = F.forall(F.flatten(F.transform("d.senses", lambda s: s.glosses)), lambda g: g.lang.isin("eng", "zho"))
    checked = _must((F.col("d.id") == F.col("entry_id")) & known & (F.size(F.concat(kanji, kana)) > 0), "malformed data", F.concat(kanji, kana))
    numbered = running(entries.select(F.col("id").alias("entry_id")), ["entry_id"], name="source_ordinal").withColumn("source_ordinal", F.col("source_ordinal").cast("int"))
    return parsed.join(numbered, "entry_id").select("entry_id", deterministic_uuid(dictionary, "entry", F.col("entry_id")).alias("id"), "source_ordinal", checked.alias("forms"), F.col("d.senses").alias("senses"))


def forms(parsed: DataFrame) -> DataFrame:
    each = parsed.select("entry_id", "id", F.posexplode("forms").alias("ordinal", "f"))
    return each.select(
        "entry_id",
        deterministic_uuid(F.col("id"), "form", F.col("ordinal")).alias("id"),
        F.col("id").alias("structured_entry_id"),
        F.col("f.text").alias("text"),
        normalize_headword(F.col("f.text")).alias("normalized_text"),
        F.lit("ja").alias("language"),
        F.col("f.kind").alias("kind"),
        *[F.coalesce(f"f.{c}", F.array().cast(STRINGS)).alias(c) for c in ("tags", "priority_tags", "restrictions")],
        "ordinal",
    )


def form_mismatches(parsed_forms: DataFrame, table: DataFrame) -> DataFrame:
    """Positions at which the forms in the JSON and those in the forms table disagree."""
    placed = table.withColumn("ordinal", F.row_number().over(Window.partitionBy("entry_id").orderBy("ord")) - 1)
    right = placed.select("entry_id", "ordinal", F.col("text").alias("t_text"), F.when(F.col("is_kana") == 1, "kana").otherwise("kanji").alias("t_kind"))
    both = parsed_forms.select("entry_id", "ordinal", "text", "kind").join(right, ["entry_id", "ordinal"], "full")
    return both.filter(~(F.col("text").eqNullSafe(F.col("t_text")) & F.col("kind").eqNullSafe(F.col("t_kind"))))


def senses(parsed: DataFrame) -> DataFrame:
    each = parsed.select("entry_id", F.col("id").alias("structured_entry_id"), F.posexplode("senses").alias("ordinal", "s"))
    return each.select(
        "entry_id",
        deterministic_uuid(F.col("structured_entry_id"), "sense", F.col("ordinal")).alias("id"),
        "structured_entry_id",
        "ordinal",
        F.col("ordinal").alias("source_sense_ordinal"),
        F.coalesce("s.pos", F.array().cast(STRINGS)).alias("part_of_speech"),
        F.coalesce("s.field", F.array().cast(STRINGS)).alias("domains"),
        F.coalesce("s.misc", F.array().cast(STRINGS)).alias("tags"),
        F.col("s.notes").alias("notes"),
        F.col("s.glosses").alias("glosses"),
    )


def chinese(zh_defs: DataFrame) -> DataFrame:
    """entry_id, ordinal, glosses, has_notes, examples of each sense. Keys that aren't plain numbers are an error."""
    each = zh_defs.select("entry_id", F.explode(F.from_json("data", ZH, {"mode": "FAILFAST"}).getField("senses")).alias("key", "s"))
    ordinal = _must(F.col("key").rlike("^(0|[1-9][0-9]*)$"), "sense key is no number", F.col("key").try_cast("int"))
    return each.select("entry_id", ordinal.alias("ordinal"), F.transform("s.glosses", lambda g: g.text).alias("zh"), F.col("s.notes").isNotNull().alias("has_notes"), F.coalesce(F.size("s.examples"), F.lit(0)).alias("examples"))


def alignment_problems(sense_rows: DataFrame, zh: DataFrame) -> DataFrame:
    """entry_id, ordinal, problem: senses without Chinese, Chinese without a sense, or glosses that differ."""
    embedded = F.transform(F.filter("glosses", lambda g: g.lang == "zho"), lambda g: g.text)
    left = sense_rows.select("entry_id", "ordinal", embedded.alias("embedded"))
    both = left.join(zh.select("entry_id", "ordinal", "zh"), ["entry_id", "ordinal"], "full")
    problem = F.when(F.col("zh").isNull(), "missing in zh_defs").when(F.col("embedded").isNull(), "no such sense").when(F.col("zh") != F.col("embedded"), "glosses differ")
    return both.select("entry_id", "ordinal", problem.alias("problem")).filter("problem is not null")


def sense_definitions(sense_rows: DataFrame, zh: DataFrame) -> DataFrame:
    en = sense_rows.select(F.col("id").alias("sense_id"), F.posexplode("glosses").alias("ordinal", "g")).filter("g.lang = 'eng'").select("sense_id", F.col("g.text").alias("text"), F.lit("en").alias("language"), F.lit("jmdict").alias("source"), "ordinal", F.to_json(F.struct(F.lit("entries").alias("table"), F.col("g.gloss_type").alias("glossType"))).alias("provenance"))
    of = zh.join(sense_rows.select("entry_id", "ordinal", F.col("id").alias("sense_id")), ["entry_id", "ordinal"]).withColumnRenamed("ordinal", "sense_ordinal")
    cn = of.select("sense_id", "sense_ordinal", F.posexplode("zh").alias("ordinal", "text")).select("sense_id", "text", F.lit("zh-CN").alias("language"), F.lit("lexicon").alias("source"), "ordinal", F.to_json(F.struct(F.lit("zh_defs").alias("table"), F.lit("zh-CN").alias("locale"), F.col("sense_ordinal").alias("sourceSenseOrdinal"))).alias("provenance"))
    return en.unionByName(cn).withColumn("id", deterministic_uuid(F.col("sense_id"), "definition", F.col("source"), F.col("ordinal")))


def entry_definitions(parsed: DataFrame, jpn_defs: DataFrame) -> DataFrame:
    """Japanese definitions; ordinals go on over the rows of one source. As many furigana as glosses are due."""
    both = jpn_defs.select("entry_id", "ord", "source", F.from_json("glosses", STRINGS, {"mode": "FAILFAST"}).alias("g"), F.from_json("furigana", "array<variant>", {"mode": "FAILFAST"}).alias("f"))
    even = both.withColumn("g", _must(F.size("g") == F.size("f"), "glosses and furigana differ in number", F.col("g")))
    each = even.select("entry_id", "ord", "source", F.posexplode("g").alias("gloss", "text"), "f")
    place = F.row_number().over(Window.partitionBy("entry_id", "source").orderBy("ord", "gloss")) - 1
    own = each.withColumn("ordinal", place).join(parsed.select("entry_id", F.col("id").alias("structured_entry_id")), "entry_id")
    return own.select(deterministic_uuid(F.col("structured_entry_id"), "entry-definition", F.col("source"), F.col("ordinal")).alias("id"), "structured_entry_id", "text", F.lit("ja").alias("language"), "source", "ordinal", "entry_id", "ord", "gloss")


def dictionary_entries(parsed: DataFrame, sense_rows: DataFrame, jpn: DataFrame, zh: DataFrame, dictionary: str) -> DataFrame:
    """One entry a source entry; its text is all forms, then English, Japanese and Chinese definitions, line by line."""
    word = F.col("forms")[0].getField("text")
    en = sense_rows.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.transform(F.filter("glosses", lambda g: g.lang == "eng"), lambda g: g.text).alias("t")))).alias("en"))
    ja = jpn.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("ord", "gloss", "text"))).alias("ja"))
    cn = zh.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("zh").alias("t")))).alias("cn"))
    all_ = parsed.join(en, "entry_id", "left").join(ja, "entry_id", "left").join(cn, "entry_id", "left")
    none = F.array().cast(STRINGS)
    lines = F.concat(
        F.transform("forms", lambda f: f.text),
        F.coalesce(F.flatten(F.transform("en", lambda x: x.t)), none),
        F.coalesce(F.transform("ja", lambda x: x.text), none),
        F.coalesce(F.flatten(F.transform("cn", lambda x: x.t)), none),
    )
    return all_.select(
        "id", F.lit(dictionary).alias("dictionary_id"), word.alias("headword_original"), normalize_headword(word).alias("headword_normalized"), sort_key(word).alias("sort_key"),
        F.array_join(lines, "\n").alias("entry_plain_text"), F.lit("definition").alias("entry_kind"), "source_ordinal", F.col("entry_id").alias("source_record_id"),
    )


def import_lexicon(tables: dict[str, DataFrame], dictionary: str) -> dict[str, DataFrame]:
    """The model's tables of an export's tables. Problems raise errors before anything is returned: forms that
    disagree, children of no entry, entries without exactly one Chinese row, senses that don't align."""
    from .validation import must_be_empty

    parsed = parse_entries(tables["entries"], dictionary)
    all_forms, all_senses, zh = forms(parsed), senses(parsed), chinese(tables["zh_defs"])
    ids = parsed.select("entry_id")
    for name in ("forms", "jpn_defs", "zh_defs"):
        must_be_empty(tables[name].join(ids, "entry_id", "left_anti"), f"{name} of no entry")
    must_be_empty(ids.join(tables["zh_defs"].groupBy("entry_id").count(), "entry_id", "left").filter("coalesce(count, 0) <> 1"), "entries without one zh_defs row")
    must_be_empty(form_mismatches(all_forms, tables["forms"]), "forms disagree")
    must_be_empty(alignment_problems(all_senses, zh), "zh_defs don't align")
    jpn = entry_definitions(parsed, tables["jpn_defs"])
    return {
        "dictionary_entries": dictionary_entries(parsed, all_senses, jpn, zh, dictionary),
        "structured_entries": parsed.select(F.col("id").alias("entry_id")),
        "structured_forms": all_forms.drop("entry_id"),
        "structured_senses": all_senses.drop("entry_id", "glosses"),
        "structured_entry_definitions": jpn.drop("entry_id", "ord", "gloss"),
        "structured_sense_definitions": sense_definitions(all_senses, zh),
    }


def definition_languages(imported: dict[str, DataFrame]) -> DataFrame:
    """One row: the languages that the definitions of an import are in, each once, in order."""
    tables = [imported[t].select("language") for t in ("structured_entry_definitions", "structured_sense_definitions") if t in imported]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.agg(F.sort_array(F.collect_set("language")).alias("languages"))


def import_counts(imported: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of every table, in one job."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in imported.items()]
    return in_one_row(*counts)


def import_summary(imported: dict[str, DataFrame]) -> DataFrame:
    """One row: the counts of all tables, and the languages."""
    return in_one_row(import_counts(imported), definition_languages(imported))


def write_import(imported: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes every table once and counts it meanwhile; one row: the rows of each table, definitions by language, languages.

    The counts are metrics of the tasks that write, each counted once however often a task is tried, so no table is read or
    computed a second time to be counted. A definition in another language is an error, after which the folder is not whole.
    """
    counts: dict[str, int] = {}
    by = dict.fromkeys(LANGUAGES, 0)
    for name, df in imported.items():
        metrics = [F.count(F.lit(1)).alias("n")]
        if name.endswith("_definitions"):
            metrics += [F.count_if(F.col("language") == x).alias(x) for x in LANGUAGES]
        seen = Observation(name)
        df.observe(seen, *metrics).write.mode("error").parquet(f"{folder}/{name}")
        counts[name] = seen.get["n"]
        if len(metrics) > 1:
            told = {x: seen.get[x] for x in LANGUAGES}
            if sum(told.values()) != counts[name]:
                raise ValueError(f"{name} has definitions in other languages")
            by = {x: by[x] + told[x] for x in LANGUAGES}
    spark = next(iter(imported.values())).sparkSession
    row = (*counts.values(), *by.values(), [x for x in LANGUAGES if by[x]])
    columns = [*(f"`{c}` bigint" for c in counts), *(f"`definitions_{x}` bigint" for x in LANGUAGES), "languages array<string>"]
    return spark.createDataFrame([row], ", ".join(columns))
