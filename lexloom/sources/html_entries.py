"""HTML entry collections: rows of a decoded source (headword, raw entry, redirect) become dictionary entries.

The codec of the binary container is not part of this library: a collection comes as a table or as files of rows, and
`EntrySource` is what a decoder has to offer.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import deterministic_uuid
from ..functions.markup import plain, sanitized
from ..functions.text import normalize_headword, parse_redirect, sort_key, strip_nul


class EntrySource(Protocol):
    """What a decoder offers: the entries, and where each lies in the file."""

    def entries(self) -> DataFrame:
        """source_ordinal, headword, raw."""

    def locators(self) -> DataFrame:
        """source_ordinal, version, file_checksum, key_text, key_block_index, record_start_offset, record_end_offset."""


def import_entries(rows: DataFrame, dictionary: str) -> DataFrame:
    """dictionary_entries of a source (source_ordinal, headword, raw). Redirects have empty HTML and text."""
    raw = strip_nul(F.col("raw"))
    base = rows.withColumn("raw", raw).withColumn("redirect", parse_redirect(F.col("raw")))
    redirects = F.col("redirect").isNotNull()
    done = base.withColumn("html", F.when(redirects, "").otherwise(sanitized("raw")))
    return done.select(
        deterministic_uuid(dictionary, "entry", F.col("source_ordinal")).alias("id"),
        F.lit(dictionary).alias("dictionary_id"),
        F.col("headword").alias("headword_original"),
        normalize_headword(F.col("headword")).alias("headword_normalized"),
        sort_key(F.col("headword")).alias("sort_key"),
        F.col("raw").alias("entry_raw"),
        F.col("html").alias("entry_sanitized_html"),
        F.when(redirects, "").otherwise(plain("html")).alias("entry_plain_text"),
        F.when(redirects, "redirect").otherwise("definition").alias("entry_kind"),
        F.col("redirect").alias("redirect_target_original"),
        normalize_headword(F.col("redirect")).alias("redirect_target_normalized"),
        "source_ordinal",
    )


def fetch_by_locator(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with raw: the records at complete locators; a locator that matches in part matches nothing."""
    keys = ["version", "file_checksum", "key_text", "key_block_index", "record_start_offset", "record_end_offset"]
    return wanted.join(records.select(*keys, strip_nul(F.col("raw")).alias("raw")), keys, "left")
