"""The line grammar of dictionary payloads: records to lines, lines to nodes, nodes to the model's rows.

Everything is column expressions over exploded lines: a record is a partition of windows, so records of any number
spread over the cluster, and a payload's lines meet only in their own record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import SYSTEMS, nested_markers, split_orthographies  # noqa: F401 - nested_markers is part of the grammar
from ..functions.text import align_languages, form_kind, is_safe_orthography, strip_hyphens

# The marks of the grammar.
NUMBERED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
PRIMARY = f"[◯{NUMBERED}]"
SECTIONS = {"表記": "orthography", "語法": "grammar", "表現": "expression", "注意": "caution", "語源": "etymology"}
LINK = "(?s)^(.*?) @@@LINK=░(.*?)░【(.*?)】🗏(\\d+)№(\\d+)(⚠️.*)?$"
LABEL = "^【([^】]*)】$"
HEADING = "^(.*?)［(.*)］$"
SUBDIVISION = r"^([㋐-㋾⑴-⒇]|\(\d{1,2}\)|\[\d{1,2}\])(.*)$"
REDIRECT = r"^→\s*(.*)$"
CONTAINERS = ("definition", "note", "special-section", "expression", "derivative")
MEMBERS = ("example", "subdivision")


def custom_links(records: DataFrame) -> DataFrame:
    """ordinal, headword, target, display, source, page, source_id, warning of the records that are links."""
    names = ("target", "display", "source", "page", "source_id", "warning")
    found = records.filter(F.col("text").rlike(LINK))
    return found.select("ordinal", "headword", *[F.regexp_extract("text", LINK, i + 1).alias(n) for i, n in enumerate(names[:-1])], F.nullif(F.regexp_extract("text", LINK, 6), F.lit("")).alias("warning"))


def split_lines(records: DataFrame, text: str = "text") -> DataFrame:
    """records with line (from 0), raw and line_ending for each line; concatenated again they are the text."""
    found = F.regexp_extract_all(F.col(text), F.lit("[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"), F.lit(0))
    lines = records.select("*", F.posexplode(found).alias("line", "whole"))
    ending = F.regexp_extract("whole", "(\r\n|\r|\n)$", 1)
    return lines.withColumn("line_ending", ending).withColumn("raw", F.substring("whole", F.lit(1), F.char_length("whole") - F.char_length("line_ending"))).drop("whole")


def node_type() -> Column:
    raw = F.col("raw")
    return (
        F.when(raw == "", "raw")
        .when(raw.rlike(LABEL), "grammatical-label")
        .when(raw.rlike(f"^{PRIMARY}"), "definition")
        .when(raw.startswith("｢"), "example")
        .when(raw.startswith("▶"), "note")
        .when(raw.startswith("◈"), "special-section")
        .when(raw.startswith("表現"), "expression")
        .when(raw.startswith("派生"), "derivative")
        .when(raw.rlike(SUBDIVISION), "subdivision")
        .when(raw.rlike(REDIRECT), "redirect")
        .when(F.col("line") == 0, "heading")
        .otherwise("raw")
    )


def _cut(n: Column | int) -> Column:
    return F.substring(F.col("raw"), F.lit(1) + n, F.char_length("raw"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines as nodes: type, marker, label, body, left, right, alignment, system, reading, orthography, reason, diagnostic."""
    t = F.col("type")
    closed = F.col("raw").endswith("｣")
    section = F.coalesce(*[F.when(F.startswith(_cut(1), F.lit(s)), F.lit(s)) for s in SECTIONS])
    marker = (
        F.when(t == "definition", F.substring("raw", 1, 1))
        .when(t.isin("note", "special-section"), F.substring("raw", 1, 1))
        .when(t.isin("expression", "derivative"), F.substring("raw", 1, 2))
        .when(t == "subdivision", F.regexp_extract("raw", SUBDIVISION, 1))
    )
    body = (
        F.when(t.isin("definition", "note"), _cut(1))
        .when(t == "example", F.when(closed, F.substring("raw", F.lit(2), F.char_length("raw") - 2)).otherwise(_cut(1)))
        .when(t == "special-section", _cut(F.lit(1) + F.coalesce(F.char_length("label"), F.lit(0))))
        .when(t.isin("expression", "derivative"), _cut(2))
        .when(t == "subdivision", F.regexp_extract("raw", SUBDIVISION, 2))
        .when(t == "redirect", F.regexp_extract("raw", REDIRECT, 1))
        .when(t == "grammatical-label", F.regexp_extract("raw", LABEL, 1))
    )
    sides = align_languages(F.col("body"))
    bilingual = t.isin("definition", "example", "subdivision")
    how = F.when(t == "example", F.when(closed & (F.col("s.alignment") == "paired"), "paired").otherwise("ambiguous")).otherwise(F.col("s.alignment"))
    explicit = (t == "heading") & F.col("raw").rlike(HEADING)
    out = lines.withColumn("type", node_type()).withColumn("label", F.when(t == "special-section", section)).withColumn("marker", marker).withColumn("body", body)
    out = out.withColumn("s", F.when(bilingual, sides)).withColumn("alignment", F.when(bilingual, how)).withColumn("left", F.col("s.left")).withColumn("right", F.col("s.right")).drop("s")
    system = F.coalesce(*[F.when(F.col("marker").rlike(f"^{p}$"), F.lit(n)) for n, p in SYSTEMS.items()])
    return (
        out.withColumn("system", F.when(t == "subdivision", system))
        .withColumn("reading", F.when(explicit, F.regexp_extract("raw", HEADING, 1)))
        .withColumn("orthography", F.when(explicit, F.regexp_extract("raw", HEADING, 2)))
        .withColumn("reason", F.when((t == "raw") & (F.col("raw") == ""), "blank-line").when(t == "raw", "unknown-structure"))
        .withColumn("diagnostic", F.when((t == "example") & (F.col("alignment") == "ambiguous"), "ambiguous-example").when(F.col("reason") == "unknown-structure", "raw-line"))
    )


def parse_records(records: DataFrame) -> DataFrame:
    """Nodes of all records (ordinal, headword, text) that aren't links. A null text has no lines."""
    return parse_lines(split_lines(records.filter(~F.coalesce(F.col("text").rlike(LINK), F.lit(False))))).drop("text")


def outlines(nodes: DataFrame) -> DataFrame:
    """nodes as far as counts need them: texts are empty where there is one, but for the parts of headings."""
    texts = [F.when(F.col(c).isNotNull(), "").alias(c) for c in ("raw", "body", "left", "right")]
    return nodes.select("ordinal", "line", "type", "label", "marker", "alignment", "reading", "orthography", "diagnostic", *texts)


def serialize(nodes: DataFrame) -> DataFrame:
    """The payloads again, from their nodes."""
    lines = F.array_sort(F.collect_list(F.struct("line", F.concat("raw", "line_ending").alias("x"))))
    return nodes.groupBy("ordinal").agg(F.array_join(F.transform(lines, lambda r: r.x), "").alias("text"))


def forms(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """ordinal, form_ordinal, text, normalized_text, kind: the key, a kana reading, and plain orthographies, each
    normalised text once, the first standing."""
    key = records.select("ordinal", F.lit(-1).alias("line"), F.lit(0).alias("i"), F.col("headword").alias("text"))
    reading = strip_hyphens(F.col("reading"))
    read = nodes.filter(F.col("type") == "heading").select("ordinal", "line", F.lit(0).alias("i"), F.when(form_kind(reading) == "kana", reading).alias("text"))
    spelled = nodes.filter("orthography is not null").select("ordinal", "line", F.posexplode(split_orthographies(F.col("orthography"))).alias("j", "text")).select("ordinal", "line", (F.col("j") + 1).alias("i"), "text")
    every = key.unionByName(read).unionByName(spelled.filter(is_safe_orthography(F.col("text")))).filter("text <> ''")
    every = every.withColumn("normalized_text", strip_hyphens(F.col("text"))).withColumn("kind", form_kind(F.col("text")))
    first = Window.partitionBy("ordinal", "normalized_text").orderBy("line", "i")
    once = every.withColumn("n", F.row_number().over(first)).filter("n = 1")
    place = Window.partitionBy("ordinal").orderBy("line", "i")
    return once.withColumn("form_ordinal", F.row_number().over(place) - 1).select("ordinal", "form_ordinal", "text", "normalized_text", "kind")


def containers(nodes: DataFrame, record: str = "ordinal", order: str = "line", setters: Column | None = None, resets: Column | None = None, members: Column | None = None) -> DataFrame:
    """nodes with parent: the last container before an example or subdivision, unless something ended it."""
    t = F.col("type")
    setters = t.isin(*CONTAINERS) if setters is None else setters
    resets = t.isin("heading", "grammatical-label", "redirect", "raw") if resets is None else resets
    members = t.isin(*MEMBERS) if members is None else members
    before = Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last_value(F.when(setters, F.col(order)).when(resets, F.lit(-1)), F.lit(True)).over(before)
    return nodes.withColumn("parent", F.when(members, F.nullif(last, F.lit(-1))))


def project_blocks(nodes: DataFrame) -> DataFrame:
    """ordinal, block, parent, kind, annotation_kind, sibling_ordinal and texts of every node but headings."""
    t = F.col("type")
    kind = (
        F.when(t.isin("definition", "example", "subdivision"), t)
        .when(t.isin("grammatical-label", "note"), "annotation")
        .when(t.isin("special-section", "expression", "derivative"), "section")
        .otherwise("raw")
    )
    section = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in SECTIONS.items()], F.lit("other"))
    annotation = F.when(t == "grammatical-label", "grammar").when(t == "note", "note").when(t == "special-section", section).when(t.isin("expression", "derivative"), t)

    def text(language: str | None, role: str, value: Column) -> Column:
        return F.struct(F.lit(language).cast("string").alias("language"), F.lit(role).alias("role"), value.alias("text"))

    def sides(left: str, right: str) -> Column:
        both = F.array(F.when(F.col("left").isNotNull(), text("ja", left, F.col("left"))), F.when(F.col("right").isNotNull(), text("zh-CN", right, F.col("right"))))
        return F.array_compact(both)

    plain = F.array(text(None, "body", F.coalesce(F.when(t.isin("redirect", "raw"), F.col("raw")).otherwise(F.col("body")), F.lit(""))))
    texts = (
        F.when((t == "definition") & (F.col("alignment") != "ambiguous"), sides("definition", "definition"))
        .when((t == "example") & (F.col("alignment") == "paired"), sides("source", "translation"))
        .when((t == "subdivision") & (F.col("alignment") != "ambiguous"), sides("body", "translation"))
        .when(t == "grammatical-label", F.array(text(None, "label", F.col("body"))))
        .otherwise(plain)
    )
    in_order = Window.partitionBy("ordinal").orderBy("line")
    sibling = Window.partitionBy("ordinal", "parent").orderBy("line")
    numbered = containers(nodes).withColumn("block", (F.count_if(t != "heading").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    # The parent is the last container, so its number stands in the same window.
    last = F.last_value(F.when(t.isin(*CONTAINERS), F.col("block")), F.lit(True)).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = numbered.withColumn("parent_block", F.when(F.col("parent").isNotNull(), last)).filter(t != "heading")
    return blocks.withColumn("sibling_ordinal", F.row_number().over(sibling) - 1).select(
        "ordinal", "block", "parent_block", "line", F.col("type").alias("source_type"), kind.alias("kind"), annotation.alias("annotation_kind"), "sibling_ordinal", texts.alias("texts")
    )


def project_definitions(nodes: DataFrame) -> DataFrame:
    """ordinal, language, definition_ordinal, text: both sides of every definition whose split is sure."""
    sure = nodes.filter((F.col("type") == "definition") & (F.col("alignment") != "ambiguous"))
    sides = F.array(F.struct(F.lit("ja").alias("language"), F.col("left").alias("text")), F.struct(F.lit("zh-CN").alias("language"), F.col("right").alias("text")))
    rows = sure.select("ordinal", "line", F.explode(sides).alias("d")).select("ordinal", "line", "d.*").filter("text is not null")
    place = Window.partitionBy("ordinal", "language").orderBy("line")
    return rows.withColumn("definition_ordinal", F.row_number().over(place) - 1).drop("line")


def project_examples(nodes: DataFrame) -> DataFrame:
    paired = nodes.filter((F.col("type") == "example") & (F.col("alignment") == "paired"))
    place = Window.partitionBy("ordinal").orderBy("line")
    return paired.withColumn("example_ordinal", F.row_number().over(place) - 1).select("ordinal", "example_ordinal", "line", F.col("left").alias("source"), F.col("right").alias("translation"))


def diagnostics(nodes: DataFrame) -> DataFrame:
    """ordinal, line, code: what parsing and projection could not settle."""
    t, in_order = F.col("type"), Window.partitionBy("ordinal").orderBy("line")
    number = F.when(t == "definition", F.nullif(F.call_function("locate", F.col("marker"), F.lit(NUMBERED)), F.lit(0)))
    seen = containers(nodes).withColumn("number", number)
    last = F.last_value("number", F.lit(True)).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    codes = F.array(
        F.col("diagnostic"),
        F.when((t == "definition") & (F.col("alignment") == "ambiguous"), "ambiguous-definition-alignment"),
        F.when(F.col("number") <= last, "numbering-restart"),
        F.when((t == "example") & (F.col("alignment") == "ambiguous"), "ambiguous-example-ownership-or-alignment"),
        F.when(t == "derivative", "unresolved-derivative"),
        F.when((t == "subdivision") & F.col("parent").isNull(), "unscoped-subdivision"),
        F.when(t == "redirect", "deferred-redirect"),
    )
    bad = F.filter(split_orthographies(F.col("orthography")), lambda x: ~is_safe_orthography(x))
    deferred = F.transform(F.coalesce(F.when(t == "heading", bad), F.array().cast("array<string>")), lambda _: F.lit("deferred-heading-form"))
    return seen.withColumn("codes", F.concat(F.array_compact(codes), deferred)).select("ordinal", "line", F.explode("codes").alias("code"))


def accounting(nodes: DataFrame) -> DataFrame:
    """ordinal, line, type, destinations: where each node went; none is dropped."""
    t = F.col("type")
    lexical = (t == "heading") | ((t == "definition") & (F.col("alignment") != "ambiguous")) | ((t == "example") & (F.col("alignment") == "paired"))
    where = F.array(F.lit("source-artifact"), F.when(lexical, "lexical"), F.when(t != "heading", "rich-content"), F.when(t.isin("derivative", "redirect"), "deferred"))
    return nodes.select("ordinal", "line", "type", F.array_compact(where).alias("destinations"))
