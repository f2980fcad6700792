"""Corpus audits: histograms, samples, sequences, shapes and shares, each a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import occurrence_counts
from .lines import LABEL, NUMBERED, SECTIONS
from .ordering import order_statistics, running

# The audit's own line kinds and tokens.
LINE_SECTIONS = ("表現", "派生", "語源", "類語", "対義語", "参考", "注意", "表記", "用法", "語法")
QUOTES = {"｢": "｣", "「": "」", "『": "』", "“": "”", "‘": "’", "《": "》", "〈": "〉"}
BRACKETS = {"［": "］", "【": "】", "（": "）", "〔": "〕", "⟪": "⟫", "⟨": "⟩"}
#: Tokens that are counted by expressions.
FEW_TOKENS = 12
ARTIFACTS = ("@@@LINK=", "░", "🗏", "⚠️", "🌸", "🍀", "▾", "▿", "ⓚ", "🡺")


def in_one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables as one row of all their columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for p in parts for c in p.columns])


def histogram(df: DataFrame, key: Column | str, name: str = "key", missing: str = "und") -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    return df.groupBy(F.coalesce(column.cast("string"), F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def occurrences(text: Column, token: str) -> Column:
    """How often a token stands in a text, without overlaps."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(token), F.lit("")))) / F.lit(len(token))


def token_counts(df: DataFrame, text: str, tokens: tuple[str, ...]) -> DataFrame:
    """token, n, entries: occurrences, and rows with any. One pass; a row each token. Of many tokens, all are looked for
    together by an automaton; a few are cheaper as expressions."""
    if len(tokens) > FEW_TOKENS:
        return occurrence_counts(df, text, tokens)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), occurrences(F.col(text), t).cast("long").alias("k")) for t in tokens])).alias("x")
    return df.select(each).groupBy("x.token").agg(F.sum("x.k").alias("n"), F.count_if(F.col("x.k") > 0).alias("entries"))


def with_samples(df: DataFrame, key: str, entry: str, sample: str, most: int = 3) -> DataFrame:
    """key, n, entries, samples: occurrences, distinct entries, and the first few distinct samples in entry order.

    Samples are found among the first rows of each distinct sample, so a frequent key brings only its samples together.
    """
    totals = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(entry).alias("entries"))
    once = df.groupBy(key, sample).agg(F.min(entry).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first", sample))
    few = once.withColumn("r", rank).filter(F.col("r") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", sample))).alias("s"))
    return totals.join(few.select(key, F.transform("s", lambda x: x[sample]).alias("samples")), key)


def most_common(counts: DataFrame, k: int, n: str = "n", first: str = "first") -> DataFrame:
    """The k most frequent, of equal ones those first seen."""
    return counts.orderBy(F.col(n).desc(), F.col(first).asc()).limit(k)


def capped_failures(failures: DataFrame, ordinal: str = "ordinal", message: str = "message", most: int = 100, longest: int = 500) -> DataFrame:
    """n, samples: the number of failures, and the first of them, messages cut."""
    first = failures.select(F.struct(ordinal, F.substring(message, 1, longest).alias("message")).alias("x")).orderBy(F.col(f"x.{ordinal}"), F.col("x.message")).limit(most)
    return in_one_row(failures.agg(F.count("*").alias("n")), first.agg(F.array_sort(F.collect_list("x")).alias("samples")))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """One row: groups of equal keys, and rows beyond the first of each."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def size_statistics(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """least, most, median (of an even number, the mean of the middle two) and mean; null where there are none."""
    middle = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1}
    ends = [F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean")]
    median = ((F.col("low").cast("double") + F.col("high")) / 2).alias("median")
    return _with_ranks(df, size, keys, middle, ends).select(*keys, "least", "most", median, "mean")


def latency_statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """avg, nearest-rank p50, p95, p99, and max of the values that aren't null; null where there are none."""
    shares = {f"p{round(p * 100)}": p for p in (0.5, 0.95, 0.99)}
    ranks = {name: (lambda n, p=p: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))) for name, p in shares.items()}
    return _with_ranks(df, value, keys, ranks, [F.avg(value).alias("avg"), F.max(value).alias("max")]).select(*keys, "avg", *shares, "max")


def _with_ranks(df: DataFrame, value: str, keys: tuple[str, ...], ranks: dict, ends: list[Column]) -> DataFrame:
    """A row a group, of values or not, with aggregates and the values at ranks."""
    every = df.groupBy(*keys).agg(*ends)
    told = order_statistics(df, value, list(keys), ranks).drop("n")
    if not keys:
        return in_one_row(every, told.agg(*(F.max(c).alias(c) for c in ranks)))
    told = told.select(*(F.col(k).alias(f"ranked_{k}") for k in keys), *ranks)
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"ranked_{k}")) for k in keys))
    return every.join(told, same, "left").drop(*(f"ranked_{k}" for k in keys))


def rate_per_second(count: Column, nanoseconds: Column) -> Column:
    return F.when(nanoseconds > 0, count * 1e9 / nanoseconds).otherwise(0.0)


def cold_warm(df: DataFrame, label: str, is_cold: Column, value: str) -> DataFrame:
    """By label: mean cold and warm value, the reduction, and its share of the cold one in percent."""
    means = df.groupBy(label).agg(F.avg(F.when(is_cold, F.col(value))).alias("cold"), F.avg(F.when(~is_cold, F.col(value))).alias("warm"))
    return means.withColumn("reduction", F.col("cold") - F.col("warm")).withColumn("percent", F.when(F.col("cold") != 0, F.col("reduction") / F.col("cold") * 100))


def imbalance(text: Column, pairs: dict[str, str]) -> Column:
    """An array with `<pair>: left/right` for every pair whose signs differ in number."""

    def one(a: str, b: str) -> Column:
        left, right = occurrences(text, a).cast("long"), occurrences(text, b).cast("long")
        return F.when(left != right, F.concat(F.lit(f"{a}{b}: "), left.cast("string"), F.lit("/"), right.cast("string")))

    return F.array_compact(F.array(*[one(a, b) for a, b in pairs.items()]))


def line_kind(raw: Column, line: Column, initial_label: Column) -> Column:
    """The audit's coarse kind of a line."""
    special = F.when(raw.startswith("◈"), F.concat(F.lit("◈"), F.coalesce(*[F.when(F.startswith(F.substring(raw, F.lit(2), F.char_length(raw)), F.lit(s)), F.lit(s)) for s in SECTIONS], F.lit("raw"))))
    section = F.coalesce(*[F.when(raw.startswith(s), F.lit(s)) for s in LINE_SECTIONS])
    return (
        F.when(raw.contains("@@@LINK="), "L")
        .when(raw.rlike(r"^→\s*.+$"), "R")
        .when((line == 0) & ~initial_label, "H")
        .when(raw.rlike(LABEL), "P")
        .when(raw.startswith("◯"), "D◯")
        .when(raw.rlike(f"^[{NUMBERED}]"), "D#")
        .when(raw.startswith("｢"), "E")
        .when(raw.startswith("▶"), "▶")
        .when(special.isNotNull(), special)
        .otherwise(F.coalesce(section, F.lit("RAW")))
    )


def shapes(rows: DataFrame, entry: str, order: str, kind: str) -> DataFrame:
    """entry, shape: the kinds in order, runs written as kind×length, for entries with any row. Runs are found by windows
    within the entry."""
    w = Window.partitionBy(entry).orderBy(order)
    run = rows.withColumn("new", (~F.col(kind).eqNullSafe(F.lag(kind).over(w))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = run.groupBy(entry, "run").agg(F.first(kind).alias("kind"), F.count("*").alias("n"))
    part = F.when(F.col("n") > 1, F.concat("kind", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("kind"))
    return runs.groupBy(entry).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", part.alias("p")))), lambda x: x.p), " ").alias("shape"))


def cumulative_share(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, n, rank, share: running share of all, most frequent first. counts has one row a key."""
    placed = running(counts.select(key, n), [F.col(n).desc(), F.col(key).asc_nulls_first()], {"upto": n}, "place")
    total = placed.agg(F.sum(n)).first()[0]  # of a table that running() has written
    return placed.select(key, n, (F.col("place") + 1).alias("rank"), (F.col("upto") / F.lit(total)).alias("share"))


def sequence_flags(rows: DataFrame, entry: str, order: str, number: str, other: Column | None = None) -> DataFrame:
    """entry, repeated, skipping, restarting, mixed: what an entry's numbers do in order, and whether there are both
    numbers and other marks (`other`: which rows are). Rows without a number count for nothing else."""
    w = Window.partitionBy(entry).orderBy(order)
    marks = rows.withColumn("other_mark", F.coalesce(other, F.lit(False)) if other is not None else F.lit(False))
    before = F.last_value(number, F.lit(True)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = marks.filter(F.col(number).isNotNull() | F.col("other_mark")).withColumn("before", before)
    return seen.groupBy(entry).agg(
        (F.count(number) > F.count_distinct(number)).alias("repeated"),
        F.coalesce(F.bool_or(F.col(number) > F.col("before") + 1), F.lit(False)).alias("skipping"),
        F.coalesce(F.bool_or(F.col(number) <= F.col("before")), F.lit(False)).alias("restarting"),
        (F.bool_or("other_mark") & (F.count(number) > 0)).alias("mixed"),
    )


def around_marks(rows: DataFrame, entry: str, order: str, is_mark: Column) -> DataFrame:
    """rows with place: before-definition in an entry without any mark, after-last-definition after its last mark, and
    between-definitions elsewhere."""
    last = F.max(F.when(is_mark, F.col(order))).over(Window.partitionBy(entry))
    place = F.when(last.isNull(), "before-definition").when(F.col(order) > last, "after-last-definition").otherwise("between-definitions")
    return rows.withColumn("place", place)


def seen_before(rows: DataFrame, entry: str, order: str, is_mark: Column) -> DataFrame:
    """rows with seen: whether a mark stands earlier in the entry."""
    w = Window.partitionBy(entry).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("seen", F.coalesce(F.max(is_mark.cast("int")).over(w), F.lit(0)) == 1)


def link_relations(links: DataFrame, headwords: DataFrame) -> DataFrame:
    """links with target_known and relation: how the key relates to the link's parts."""
    from .corpus_audit import link_relation

    known = headwords.select(F.col("headword").alias("target")).distinct().withColumn("known", F.lit(True))
    return links.join(known, "target", "left").withColumn("target_known", F.coalesce("known", F.lit(False))).withColumn("relation", link_relation()).drop("known")


def heading_pattern(first: Column, is_link: Column, is_redirect: Column, labelled: Column, headword: Column) -> tuple[Column, Column]:
    """What a record's first line is made of, and how it relates to the headword."""
    parts = F.concat_ws(
        "+",
        F.lit("explicit"),
        F.when(first.contains("［") & first.contains("］"), "reading-orthography").otherwise("plain"),
        F.when(occurrences(first, "［") > 1, "multi-bracket"),
        F.when(first.rlike("[‐―-]"), "hyphen"),
        F.when(first.contains("・"), "middle-dot"),
    )
    pattern = F.when(is_link, "link-record").when(is_redirect, "plain-redirect").when(labelled, "implicit-index-heading").otherwise(parts)
    explicit = F.when(first == headword, "exact").when(F.contains(first, headword), "contains-index").otherwise("different")
    return pattern, F.when(is_link, "link-record").when(is_redirect, "plain-redirect").when(labelled, "payload-starts-with-pos").otherwise(explicit)


def longest(records: DataFrame, size: str, k: int, *ties: str) -> DataFrame:
    return records.orderBy(F.col(size).desc(), *[F.col(t).desc() for t in ties]).limit(k)


def node_audit(nodes: DataFrame) -> DataFrame:
    """One row: nodes by type and raw ones by reason, and entries with any raw, unknown or blank node."""

    def has(condition: Column, name: str) -> Column:
        return F.bool_or(F.coalesce(condition, F.lit(False))).alias(name)

    raw, reason = F.col("type") == "raw", F.col("reason")
    per = nodes.groupBy("ordinal").agg(has(raw, "raw"), has(reason == "unknown-structure", "unknown"), has(reason == "blank-line", "blank"), F.count("*").alias("n"))
    flags = [F.count_if(c).alias(f"entries_with_{c}") for c in ("raw", "unknown", "blank")]
    entries = per.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), *flags)

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return in_one_row(entries, counted(nodes, "type", "by_type"), counted(nodes.filter(raw), "reason", "raw_by_reason"))


def count_distribution(rows: DataFrame, entry: str, entries: DataFrame | None = None, name: str = "key") -> DataFrame:
    """How many entries have how many rows; with `entries`, those without any count as having none."""
    per = rows.groupBy(entry).agg(F.count("*").alias(name))
    if entries is not None:
        per = entries.select(entry).join(per, entry, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return per.groupBy(name).agg(F.count("*").alias("n"))


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON in a folder of its name."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
