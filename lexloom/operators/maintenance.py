"""Maintenance as recompute and compare: reprocessing, locator alignment, parity, and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import in_one_row

LOCATOR = ("version", "file_checksum", "key_text", "key_block_index", "record_start_offset", "record_end_offset")


def reprocess(entries: DataFrame, html: Column, text: Column, key: str = "id", old_html: str = "entry_sanitized_html", old_text: str = "entry_plain_text", raw: str = "entry_raw") -> DataFrame:
    """Each entry with new_html, new_text and outcome (changed, unchanged or failed). A missing raw entry fails; the new
    values of failed rows are the old ones. html and text are expressions over the entry's columns."""
    failed = F.col(raw).isNull()
    out = entries.withColumn("new_html", F.when(failed, F.col(old_html)).otherwise(html)).withColumn("new_text", F.when(failed, F.col(old_text)).otherwise(text))
    out = out.withColumn("html_changed", ~F.col("new_html").eqNullSafe(F.col(old_html))).withColumn("text_changed", ~F.col("new_text").eqNullSafe(F.col(old_text)))
    changed = F.col("html_changed") | F.col("text_changed")
    return out.withColumn("outcome", F.when(failed, "failed").when(changed, "changed").otherwise("unchanged"))


def reprocess_summary(compared: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return compared.agg(
        F.count("*").alias("processed"),
        F.count_if(o == "changed").alias("changed"),
        F.count_if(F.col("html_changed")).alias("html_changed"),
        F.count_if(F.col("text_changed")).alias("text_changed"),
        F.count_if(o == "unchanged").alias("unchanged"),
        F.count_if(o == "failed").alias("failed"),
    )


def apply_reprocessed(compared: DataFrame, columns: list[str], old_html: str = "entry_sanitized_html", old_text: str = "entry_plain_text") -> DataFrame:
    """The entries as they are to be written; with nothing changed, the same rows."""
    return compared.withColumn(old_html, F.col("new_html")).withColumn(old_text, F.col("new_text")).select(columns)


def locator_state(prefix: str = "mdx_locator_") -> Column:
    """none, complete or partial, by the six locator columns; a complete one of an unknown version is partial."""
    missing = F.array(*[F.col(f"{prefix}{c}").isNull() for c in LOCATOR])
    whole = F.forall(missing, lambda x: ~x) & (F.col(f"{prefix}version") == 1)
    return F.when(F.forall(missing, lambda x: x), "none").when(F.coalesce(whole, F.lit(False)), "complete").otherwise("partial")


def locator_key(prefix: str = "") -> Column:
    """A locator as one JSON array: version and block index as numbers, offsets as text."""

    def quoted(name: str) -> Column:
        text = F.to_json(F.array(F.col(f"{prefix}{name}").cast("string")))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def plain(name: str) -> Column:
        return F.col(f"{prefix}{name}").cast("string")

    parts = [plain(c) if c in ("version", "key_block_index") else quoted(c) for c in LOCATOR]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def align_locators(entries: DataFrame, keys: DataFrame, checksum: str) -> DataFrame:
    """Entries beside the source's key list by ordinal, with `mismatches`, the reasons why an entry may not be mapped,
    and `state`, that of the stored locator.

    keys: source_ordinal, headword_normalized, entry_raw, entry_kind, redirect_target_original as the source has them,
    and the locator. Reasons: missing, checksum (of another file), headword, raw (content absent or another), kind,
    partial (a stored locator that isn't whole), locator (a stored one that differs from the source's).
    """
    compared = ("headword_normalized", "entry_raw", "entry_kind", "redirect_target_original")
    source = keys.select("source_ordinal", *[F.col(c).alias(f"k_{c}") for c in compared], *[F.col(c).alias(f"k_loc_{c}") for c in LOCATOR], F.lit(True).alias("k_found"))
    both = entries.join(source, "source_ordinal", "left").withColumn("state", locator_state())
    found, stored = F.col("k_found").isNotNull(), F.col("state") == "complete"

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    reasons = {
        "missing": ~found,
        "checksum": found & (F.coalesce("k_loc_file_checksum", F.lit("")) != checksum),
        "headword": found & (differs("headword_original", "k_loc_key_text") | differs("headword_normalized", "k_headword_normalized")),
        "raw": found & (F.col("entry_raw").isNull() | differs("entry_raw", "k_entry_raw")),
        "kind": found & (differs("entry_kind", "k_entry_kind") | differs("redirect_target_original", "k_redirect_target_original")),
        "partial": F.col("state") == "partial",
        "locator": found & stored & (locator_key("mdx_locator_") != locator_key("k_loc_")),
    }
    return both.withColumn("mismatches", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()])))


def locator_collisions(keys: DataFrame) -> DataFrame:
    """One row: how many keys of the whole list share a locator with another one before it."""
    return keys.select(locator_key().alias("k")).agg((F.count("*") - F.count_distinct("k")).alias("collisions"))


def backfill_summary(aligned: DataFrame, keys: DataFrame) -> DataFrame:
    """Counts of an alignment: what may be mapped, what has its locator already, and what a backfill would write."""
    ok = F.size("mismatches") == 0
    counts = aligned.agg(
        F.count("*").alias("processed"),
        F.count_if(ok).alias("mappable"),
        F.count_if(~ok).alias("mismatches"),
        F.count_if(ok & (F.col("state") == "complete")).alias("already_populated"),
        F.count_if(ok & (F.col("state") == "none")).alias("fillable"),
    )
    both = in_one_row(counts, locator_collisions(keys))
    return both.withColumn("written", F.when(F.col("collisions") == 0, F.col("fillable")).otherwise(0)).drop("fillable")


def apply_backfill(aligned: DataFrame, columns: list[str], keys: DataFrame, prefix: str = "mdx_locator_") -> DataFrame:
    """The entries with locators filled in where they were absent and the source agrees; as they were if any keys of
    the source share a locator."""
    if locator_collisions(keys).first().collisions:
        return aligned.select(columns)
    fill = (F.size("mismatches") == 0) & (F.col("state") == "none")
    filled = {f"{prefix}{c}": F.when(fill, F.col(f"k_loc_{c}")).otherwise(F.col(f"{prefix}{c}")) for c in LOCATOR}
    return aligned.select([filled[c].alias(c) if c in filled else F.col(c) for c in columns])


def column_mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows mapped, missing on the right, and disagreements by column."""
    r = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = left.join(r, left[key] == r["__key"], "left")
    found = F.col("__key").isNotNull()
    return both.agg(F.count_if(found).alias("mapped"), F.count_if(~found).alias("missing"), *[F.count_if(found & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"{c}_mismatch") for c in columns])


def parity(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome, labels: rows of either side beside each other, with the columns that differ."""
    r = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = left.select(key, *columns).join(r, F.col(key) == F.col("__key"), "full")
    labels = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    outcome = F.when(F.col("__key").isNull(), "only-left").when(F.col(key).isNull(), "only-right").when(F.size(labels) == 0, "equal").otherwise("different")
    return both.select(F.coalesce(key, "__key").alias(key), outcome.alias("outcome"), F.when(outcome == "different", labels).otherwise(F.array().cast("array<string>")).alias("labels"))


# The errors of a detail read by its locator, and the categories that reports count them under, first match first.
MAPPING_ERROR = "LazyDetailMappingError"
FAILURES = (
    ("sanitizer", ("ShadowSanitizerError", "LazyDetailPipelineError"), ()),
    ("checksum_mismatch", ("MdxFileIdentityMismatchError",), ("checksum",)),
    ("malformed_locator", ("PartialPersistedMdxLocatorError", "InvalidMdxLocatorError"), ()),
    ("missing_locator", (), ("no persisted",)),
    ("identity_mismatch", (), ("identity", "align")),
    ("mdx_read", ("MdxEntryNotFoundByLocatorError", MAPPING_ERROR), ()),
)


def failure_category(error_class: Column, message: Column) -> Column:
    """By the error's class, and for mapping errors by words in the message."""
    out = F.lit("unknown")
    for name, classes, words in reversed(FAILURES):
        hit = error_class.isin(*classes) if classes else F.lit(False)
        for word in words:
            hit = hit | ((error_class == MAPPING_ERROR) & message.contains(word))
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    return out


def one_per_key(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Of rows with one key, the first by `order` and then by content, so that reruns agree."""
    content = F.to_json(F.struct(*rows.columns))
    first = F.min_by(F.struct(*rows.columns), F.struct(order, content) if order is not None else content)
    return rows.groupBy(F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """The rows to append so that each key is stored once, the stored one standing."""
    return one_per_key(rows.join(existing.select(key), key, "left_anti").select(rows.columns), key, order)


def conflicts(rows: DataFrame, existing: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows stored already with other values: they may neither be inserted nor passed over."""
    old = existing.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(old, rows[key] == old["__key"]).filter(differ).select(rows.columns)


def upsert(rows: DataFrame, existing: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """The table with the rows in place of those of the same keys; of rows with one key, the first by `order`."""
    once = one_per_key(rows, key, order)
    return existing.join(once.select(key), key, "left_anti").select(rows.columns).unionByName(once)


def rebuild_children(parents: DataFrame, key: str, children: DataFrame, existing: DataFrame, reference: str) -> DataFrame:
    """The children's table after the parents were stored again: all that they had goes, what they have now comes."""
    kept = existing.join(parents.select(F.col(key).alias(reference)), reference, "left_anti")
    return kept.select(existing.columns).unionByName(children.select(existing.columns))


def write_append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def write_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replaces the partitions that rows has, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def snapshot_conflict(dictionaries: DataFrame, storage_key: str, checksum: str, source_format: str) -> DataFrame:
    """Stored dictionaries under the same key with another checksum or format."""
    same = (F.col("checksum") == checksum) & (F.col("source_format") == source_format)
    return dictionaries.filter((F.col("storage_key") == storage_key) & ~F.coalesce(same, F.lit(False)))
