"""Entry details as nested rows, bookmarks, and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(keys: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """The rows of a group as an array of structs, in order of the keys."""
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*fields).alias("row"))))
    return F.transform(rows, lambda r: r.row)


def children(df: DataFrame, parent: str, keys: tuple[str, ...], fields: tuple[str, ...], name: str) -> DataFrame:
    return df.groupBy(parent).agg(ordered(keys, fields).alias(name))


def structured_detail(entries: DataFrame, forms: DataFrame, definitions: DataFrame, senses: DataFrame, sense_definitions: DataFrame) -> DataFrame:
    """Each entry with its forms, definitions, and senses with theirs; missing children are empty arrays."""
    of_sense = children(sense_definitions, "sense_id", ("source", "language", "ordinal", "id"), ("text", "language", "source"), "definitions")
    none = F.array().cast(dict(of_sense.dtypes)["definitions"])
    full = senses.join(of_sense, senses.id == of_sense.sense_id, "left").withColumn("definitions", F.coalesce("definitions", none))
    parts = (
        children(forms, "structured_entry_id", ("ordinal", "id"), ("text", "language", "kind", "tags", "restrictions"), "forms"),
        children(definitions, "structured_entry_id", ("source", "language", "ordinal", "id"), ("text", "language", "source"), "entry_definitions"),
        children(full, "structured_entry_id", ("ordinal", "id"), ("ordinal", "part_of_speech", "domains", "tags", "notes", "definitions"), "senses"),
    )
    out = entries
    for part in parts:
        name = part.columns[1]
        kind = dict(part.dtypes)[name]
        out = out.join(part, out.id == part.structured_entry_id, "left").drop("structured_entry_id").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def html_detail(entries: DataFrame) -> DataFrame:
    """Entries with the content that is shown: a redirect's is that of the first entry it names, one hop away.

    An entry without HTML where HTML is due raises an error rather than showing nothing.
    """
    from .search import first_by_headword

    targets = first_by_headword(entries).select(
        F.col("dictionary_id").alias("t_dictionary"), F.col("headword_normalized").alias("t_headword"), F.col("entry_sanitized_html").alias("t_html"), F.col("entry_plain_text").alias("t_text"), F.lit(True).alias("t_found")
    )
    due = (F.col("dictionary_id") == F.col("t_dictionary")) & (F.col("redirect_target_normalized") == F.col("t_headword")) & (F.col("entry_kind") == "redirect")
    out = entries.join(targets, due, "left")
    found = F.coalesce("t_found", F.lit(False))
    html = F.when(found, F.col("t_html")).otherwise(F.col("entry_sanitized_html"))
    text = F.when(found, F.col("t_text")).otherwise(F.col("entry_plain_text"))
    shown = F.when(html.isNull(), F.raise_error(F.concat(F.lit("entry without HTML: "), F.col("id").cast("string")))).otherwise(html)
    return out.select(*entries.columns, shown.alias("shown_html"), text.alias("shown_text"))


LOCATOR = ("version", "file_checksum", "key_text", "key_block_index", "record_start_offset", "record_end_offset")


def lazy_detail(entries: DataFrame, records: DataFrame) -> DataFrame:
    """id, resolved_id, sanitized_html, plain_text of entries that hold only a locator (mdx_locator_...) of their content.

    records: the locator's fields, headword, raw. An entry's own record is fetched and must be its own: the same headword,
    and a redirect to what the entry says. A redirect that names an entry of its dictionary is then answered by a second
    fetch, by the locator of the first entry of that name; what is fetched there and redirects again is shown empty, as is
    a redirect to nothing. An entry without a record, or with another's, is an error.
    """
    from ..functions.markup import plain, sanitized
    from ..functions.text import parse_redirect
    from ..sources.html_entries import fetch_by_locator
    from .search import first_by_headword

    def located(prefix: str) -> list[Column]:
        return [F.col(f"{prefix}{c}").alias(c) for c in LOCATOR]

    held = [f"mdx_locator_{c}" for c in LOCATOR]
    identity = records.select(*LOCATOR, F.col("headword").alias("fetched_headword"))
    own = entries.select("id", "dictionary_id", "headword_original", "entry_kind", "redirect_target_original", "redirect_target_normalized", *located("mdx_locator_"))
    own = fetch_by_locator(records, own).join(identity, list(LOCATOR), "left")
    told = parse_redirect(F.col("raw"))
    wrong = F.col("raw").isNull() | (F.col("fetched_headword") != F.col("headword_original")) | ~told.eqNullSafe(F.col("redirect_target_original"))
    own = own.withColumn("raw", F.when(wrong, F.raise_error(F.concat(F.lit("no record of its own at the locator of entry "), F.col("id").cast("string")))).otherwise(F.col("raw")))
    first = first_by_headword(entries).select(F.col("dictionary_id").alias("t_dictionary"), F.col("headword_normalized").alias("t_headword"), F.col("id").alias("resolved_id"), *[F.col(h).alias(f"t_{c}") for h, c in zip(held, LOCATOR, strict=True)])
    due = (F.col("dictionary_id") == F.col("t_dictionary")) & (F.col("redirect_target_normalized") == F.col("t_headword")) & (F.col("entry_kind") == "redirect")
    both = own.select("id", "dictionary_id", "entry_kind", "redirect_target_normalized", F.col("raw").alias("own_raw")).join(first, due, "left")
    again = fetch_by_locator(records, both.select("id", "own_raw", "resolved_id", *located("t_")))
    missing = F.col("resolved_id").isNotNull() & F.col("raw").isNull()
    shown = F.when(missing, F.raise_error(F.concat(F.lit("no record at the locator of entry "), F.col("resolved_id").cast("string")))).otherwise(F.coalesce("raw", "own_raw"))
    done = again.select("id", "resolved_id", shown.alias("raw")).withColumn("html", F.when(parse_redirect(F.col("raw")).isNotNull(), "").otherwise(sanitized("raw")))
    return done.select("id", "resolved_id", F.col("html").alias("sanitized_html"), plain("html").alias("plain_text"))


def reading_applies(headword: Column, kind: Column, restrictions: Column) -> Column:
    """Whether a form is a reading of the headword: kana, and restricted to it or to nothing."""
    return (kind == "kana") & ((F.size(restrictions) == 0) | F.array_contains(restrictions, headword))


def alternates(forms: Column, headword: Column, readings: Column) -> Column:
    """Forms that are neither the headword nor readings, as an array of texts in order."""
    return F.array_except(F.array_except(forms, F.array(headword)), readings)


def labels(values: Column, names: Column) -> Column:
    """Values by their names in a map, each once; unknown ones as they are."""
    return F.array_distinct(F.transform(values, lambda v: F.coalesce(names[v], v)))


def first_seen(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """key, first, n: keys in order of first appearance, then of the key, with their number of rows; any number of rows a key."""
    return rows.groupBy(key).agg(F.min(ordinal).alias("first"), F.count("*").alias("n")).orderBy("first", key)


def grouped_in_order(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """Values by key, keys in order of first appearance, then of the key, so that ranges divide keys that appear at one
    place. For groups of one entry, which are as small as an entry is."""
    return rows.groupBy(key).agg(F.min(ordinal).alias("first"), ordered((ordinal,), (value,)).alias("rows")).orderBy("first", key)


def bookmarks(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Bookmarked entries, newest first."""
    own = entries.select(F.col("id").alias("entry_id"), "headword_original", "entry_plain_text", "dictionary_id")
    return items.join(own, "entry_id").orderBy(F.col("created_at").desc(), F.col("id").desc())


def add_bookmarks(items: DataFrame, wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows to append for the wanted bookmarks (id, entry_id, created_at): of known entries, not yet bookmarked."""
    known = wanted.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    once = known.groupBy("entry_id").agg(F.min_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("r")).select("r.id", "entry_id", "r.created_at")
    return once.join(items, "entry_id", "left_anti").select("id", "entry_id", "created_at")


def remove_bookmarks(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def dictionaries_with_jobs(dictionaries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each dictionary with its newest job's status, progress and error; progress 0 without a job."""
    newest = latest(jobs.select("dictionary_id", F.col("status").alias("job_status"), "progress", "error", "created_at", "id"), "dictionary_id", "created_at", "id")
    return dictionaries.join(newest.drop("created_at", "id"), dictionaries.id == newest.dictionary_id, "left").drop("dictionary_id").withColumn("progress", F.coalesce("progress", F.lit(0)))


def next_job(jobs: DataFrame) -> DataFrame:
    """The job that a worker would claim: the oldest queued one."""
    return jobs.filter(F.col("status") == "queued").orderBy("created_at", "id").limit(1)


def allowed_transition(before: Column, after: Column) -> Column:
    from ..schemas import TRANSITIONS

    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[before], after), F.lit(False))


def job_event(jobs: DataFrame, status: str, at: Column, error: Column | None = None) -> DataFrame:
    """The events to append when jobs move on; a move that isn't allowed raises an error. Errors are cut to 8000 characters."""
    ok = allowed_transition(F.col("status"), F.lit(status))
    return jobs.select(
        "id",
        F.when(ok, F.lit(status)).otherwise(F.raise_error(F.concat(F.lit(f"no way to {status} from "), "status"))).alias("status"),
        at.alias("created_at"),
        (F.substring(error, 1, 8000) if error is not None else F.lit(None).cast("string")).alias("error"),
    )
