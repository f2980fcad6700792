"""Headword lookups: exact, prefix and ranked search, redirects, suggestions and samples.

Queries run over the model's tables as DataFrames. Prefixes are `startswith`, which reaches the Parquet scan; every
result has a total order, so pages are slices of the whole result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("exact", "prefix")
PAGE, LARGEST_PAGE = 20, 100
#: What a search may read of an entry; raw and HTML columns never leave the store.
SEARCH_COLUMNS = ("id", "dictionary_id", "headword_original", "entry_kind", "entry_plain_text", "redirect_target_original", "source_ordinal", "source_record_id")


def check_request(query: str, mode: str = "prefix", limit: int | None = PAGE, offset: int = 0) -> tuple[str, str, int, int]:
    """The request's values, checked; ValueError says what is wrong."""
    text = query.strip() if isinstance(query, str) else ""
    if not text:
        raise ValueError("query must not be blank")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    limit = PAGE if limit is None else limit
    if not isinstance(limit, int) or not 1 <= limit <= LARGEST_PAGE:
        raise ValueError(f"limit must lie between 1 and {LARGEST_PAGE}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must not be negative")
    return text, mode, limit, offset


def page(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A slice of ordered rows. No limit means all; limit 0 is empty."""
    if (limit is not None and limit < 0) or offset < 0:
        raise ValueError("limit and offset must not be negative")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def response(rows: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One row: `items`, a page of ordered rows as an array, and `pagination`: limit, offset and how many were returned. A
    page has LARGEST_PAGE rows at most, so the array is small."""
    if not 1 <= limit <= LARGEST_PAGE:
        raise ValueError(f"limit must lie between 1 and {LARGEST_PAGE}")
    names = rows.columns
    placed = page(rows, limit, offset).select(F.monotonically_increasing_id().alias("place"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"])
    counted = F.struct(F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.count("*").alias("returned"))
    return placed.agg(items.alias("items"), counted.alias("pagination"))


def exact(entries: DataFrame, dictionary: str, word: str) -> DataFrame:
    hit = entries.filter((F.col("dictionary_id") == dictionary) & (F.col("headword_normalized") == word))
    return hit.orderBy("source_ordinal", "id")


def prefix(entries: DataFrame, dictionary: str, word: str) -> DataFrame:
    hit = entries.filter((F.col("dictionary_id") == dictionary) & F.col("headword_normalized").startswith(word))
    return hit.orderBy("sort_key", "source_ordinal", "id")


def candidates(entries: DataFrame, forms: DataFrame, dictionary: str, word: str, mode: str) -> DataFrame:
    """entry_id, match_rank, matched_form, matched_form_ordinal: headword hits before form hits, exact before prefix."""
    own = entries.filter(F.col("dictionary_id") == dictionary)
    ids = own.select(F.col("id").alias("entry_id"))
    of_form = forms.select(F.col("structured_entry_id").alias("entry_id"), "normalized_text", F.col("text").alias("matched_form"), F.col("ordinal").alias("matched_form_ordinal"))

    def headwords(condition: Column, rank: int) -> DataFrame:
        return own.filter(condition).select(
            F.col("id").alias("entry_id"), F.lit(rank).alias("match_rank"), F.lit(None).cast("string").alias("matched_form"), F.lit(None).cast("int").alias("matched_form_ordinal")
        )

    def by_form(condition: Column, rank: int) -> DataFrame:
        return of_form.filter(condition).join(ids, "entry_id").select("entry_id", F.lit(rank).alias("match_rank"), "matched_form", F.col("matched_form_ordinal").cast("int").alias("matched_form_ordinal"))

    head, form = F.col("headword_normalized"), F.col("normalized_text")
    arms = [headwords(head == word, 0), by_form(form == word, 1)]
    if mode == "prefix":
        arms += [headwords(head.startswith(word) & (head != word), 2), by_form(form.startswith(word) & (form != word), 3)]
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def ranked_search(entries: DataFrame, forms: DataFrame, dictionary: str, word: str, mode: str = "prefix", limit: int | None = None, offset: int = 0) -> DataFrame:
    """One row an entry, by its best match, in total order (rank, sort key, ordinal, id)."""
    best = Window.partitionBy("entry_id").orderBy("match_rank", F.col("matched_form_ordinal").asc_nulls_first(), F.col("matched_form").asc_nulls_first())
    ranked = candidates(entries, forms, dictionary, word, mode).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "matched_form_ordinal")
    own = entries.filter(F.col("dictionary_id") == dictionary).select(*SEARCH_COLUMNS, "sort_key")
    rows = ranked.join(own, ranked.entry_id == own.id).drop("entry_id").orderBy("match_rank", "sort_key", "source_ordinal", "id")
    return page(rows, limit, offset)


def first_by_headword(entries: DataFrame) -> DataFrame:
    """Of each dictionary and normalised headword, the entry of the least ordinal."""
    least = Window.partitionBy("dictionary_id", "headword_normalized").orderBy("source_ordinal", "id")
    return entries.withColumn("n", F.row_number().over(least)).filter("n = 1").drop("n")


def resolve_redirects(rows: DataFrame, entries: DataFrame, target: str = "redirect_target_normalized") -> DataFrame:
    """rows with resolved_text: one hop to the first entry of the target's headword in the same dictionary.

    A redirect without a target keeps its own text, as do other entries; a target that redirects gives its own text.
    """
    targets = first_by_headword(entries).select(
        F.col("dictionary_id").alias("t_dictionary"), F.col("headword_normalized").alias("t_headword"), F.col("entry_plain_text").alias("t_text"), F.lit(True).alias("t_found")
    )
    joined = rows.join(targets, (F.col("dictionary_id") == F.col("t_dictionary")) & (F.col(target) == F.col("t_headword")), "left")
    use = F.coalesce(F.col("t_found"), F.lit(False)) & (F.col("entry_kind") == "redirect")
    return joined.withColumn("resolved_text", F.when(use, F.coalesce("t_text", "entry_plain_text")).otherwise(F.col("entry_plain_text"))).drop("t_dictionary", "t_headword", "t_text", "t_found")


def suggestions(headwords: DataFrame, most: int = 10) -> DataFrame:
    """Suggested headwords in order of first appearance (columns headword, ord): without patterns for somebody, one of
    each, plain ones before patterns for something."""
    kept = headwords.filter(~F.col("headword").rlike(r"(?i)\bsb\b"))
    once = kept.groupBy("headword").agg(F.min("ord").alias("ord"))
    return once.withColumn("bucket", F.col("headword").rlike(r"(?i)\bsth\b").cast("int")).orderBy("bucket", "ord", "headword").limit(most)


def dictionary_state(dictionaries: DataFrame, dictionary: str) -> str:
    """ready, not-ready or missing."""
    row = dictionaries.filter(F.col("id") == dictionary).select("status").first()
    return "missing" if row is None else ("ready" if row.status == "ready" else "not-ready")


def ready_dictionaries(dictionaries: DataFrame) -> DataFrame:
    return dictionaries.filter(F.col("status") == "ready").orderBy(F.col("imported_at").desc_nulls_first(), "id")


def seek(rows: DataFrame, after: int, n: int) -> DataFrame:
    """The next n rows beyond an ordinal."""
    return rows.filter(F.col("source_ordinal") > after).orderBy("source_ordinal").limit(n)


def search(dictionaries: DataFrame, entries: DataFrame, forms: DataFrame, dictionary: str, query: str, mode: str = "prefix", limit: int | None = PAGE, offset: int = 0) -> DataFrame:
    """A checked search of one dictionary, by its content model. The query is normalised as headwords are."""
    import unicodedata

    text, mode, limit, offset = check_request(query, mode, limit, offset)
    word = " ".join(unicodedata.normalize("NFKC", text).split()).lower()
    state = dictionary_state(dictionaries, dictionary)
    if state != "ready":
        raise LookupError(f"dictionary is {state}")
    model = dictionaries.filter(F.col("id") == dictionary).select("content_model").first().content_model
    if model == "structured":
        return ranked_search(entries, forms, dictionary, word, mode, limit, offset)
    rows = exact(entries, dictionary, word) if mode == "exact" else prefix(entries, dictionary, word)
    return page(rows.select(*SEARCH_COLUMNS), limit, offset)
