"""Smaller reports: projection audits, diagnostic runs, measurements in Markdown, lists for a client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import sample_top
from .audit import in_one_row, latency_statistics


def projection_audit(forms: DataFrame, definitions: DataFrame, examples: DataFrame, blocks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """name, key, n: rows by kind, language and code of projected records (tables as `lines` makes them)."""

    def counted(df: DataFrame, name: str, key: Column) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.coalesce("key", F.lit("und")).alias("key"), "n")

    def fact(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), key.alias("key"))

    # The counts of blocks are of one pass over them.
    of_block = F.array(
        fact("blocks", F.col("kind")),
        fact("annotations", F.coalesce("annotation_kind", F.lit("none"))),
        fact("nesting", F.when(F.col("parent_block").isNull(), "root").otherwise("child")),
    )
    facts = blocks.select(F.explode(F.concat(of_block, F.transform(F.coalesce("texts", F.array()), lambda x: fact("texts", x.language)))).alias("f"))
    parts = [
        counted(forms, "forms", F.col("kind")),
        counted(definitions, "definitions", F.col("language")),
        counted(examples, "examples", F.lit("all")),
        facts.groupBy("f.name", "f.key").agg(F.count("*").alias("n")).select("name", F.coalesce("key", F.lit("und")).alias("key"), "n"),
        counted(diagnostics, "diagnostics", F.col("code")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def diagnostic_run(results: DataFrame, value: str = "milliseconds", status: str = "status", order: str = "ordinal") -> DataFrame:
    """One row: the first result's time as cold, statistics of the others as warm, and how many went wrong."""
    first = F.row_number().over(Window.orderBy(order)) == 1  # a run is a small sample
    marked = results.withColumn("cold_run", first)
    warm = latency_statistics(marked.filter("NOT cold_run"), value)
    rest = marked.agg(F.count("*").alias("samples"), F.count_if(F.col(status) != "ok").alias("failures"), F.max(F.when(F.col("cold_run"), F.col(value))).alias("cold"))
    return in_one_row(rest, warm)


def diagnostic_sample(entries: DataFrame, seed: str, n: int) -> DataFrame:
    return sample_top(entries, seed, n, "id", "source_ordinal")


def markdown_measurements(lines: DataFrame, heading: str, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """The rows of a section of Markdown files that match a pattern, its groups as columns.

    lines: file, line, text. A section runs from its heading to the next heading of any level.
    """
    before = Window.partitionBy("file").orderBy("line")
    section = F.last(F.when(F.col("text").rlike("^#+ "), F.regexp_replace("text", "^#+ +", "")), ignorenulls=True).over(before)
    found = lines.withColumn("section", section).filter((F.col("section") == heading) & F.col("text").rlike(pattern))
    return found.select("file", "line", *[F.regexp_extract("text", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def markdown_table(df: DataFrame) -> str:
    """A small report as a Markdown table, all of its rows, taken partition by partition."""
    shown = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.toLocalIterator()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *shown])


def model_names(models: DataFrame, name: str = "name") -> DataFrame:
    """Names trimmed, without blanks, each once, in order."""
    return models.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


def most_recent_dictionary(dictionaries: DataFrame) -> DataFrame:
    ready = dictionaries.filter((F.col("status") == "ready") & F.col("package_path").isNotNull())
    return ready.orderBy(F.col("imported_at").desc_nulls_last(), "id").limit(1)


def default_name(exported_at: Column, product: str) -> Column:
    """A dictionary's name when none is given: the product and the day of the export."""
    return F.when(exported_at.isNotNull() & (exported_at != ""), F.concat(F.lit(f"{product} "), F.substring(exported_at, 1, 10))).otherwise(F.lit(product))


def count_drift(expected: dict[str, int], tables: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """Tables whose rows aren't as many as were announced: (announced, read)."""
    read = {name: tables[name].count() for name in expected}
    return {name: (n, read[name]) for name, n in expected.items() if n != read[name]}
