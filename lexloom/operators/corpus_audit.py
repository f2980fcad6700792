"""The structural audit of a corpus of records (ordinal, headword, text), as one table of facts.

Every record, and every line of it, states facts: a topic, a key, how often, and a sample. Facts are expressions over a
record and its exploded lines; what a line needs to know of its record (its first line, the last definition, the first
note) is computed on the record before its lines are exploded, so there is one shuffle, of records, and everything after
it is aggregation. `report` counts each key's occurrences and entries, and shows its first samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, slash_shape
from .audit import ARTIFACTS, BRACKETS, LINE_SECTIONS, QUOTES, duplicate_groups, heading_pattern, line_kind, longest, node_audit, occurrences, size_statistics
from .lines import LABEL, LINK, NUMBERED, PRIMARY, SECTIONS, parse_records

# What ends a line, a record that only redirects, nested markers, and signs of damage.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
REDIRECT_RECORD = r"^→\s*(.+)$"
NESTED = {"circled-katakana": "[㋐-㋾]", "parenthesized-unicode": "[⑴-⒇]", "ascii-parentheses": r"\(\d{1,2}\)", "square-brackets": r"\[\d{1,2}\]"}
ANOMALIES = {"control-or-format": r"[\p{Cc}\p{Cf}&&[^\n\r\t]]", "replacement-character": "�", "mojibake-like": "(?:Ã.|Â.)"}
UNUSUAL = r"[\x{10000}-\x{10FFFF}]|[\p{Co}\p{Cn}\p{Cs}]"
SAMPLES, LONGEST = 3, 10
NONE = "array<struct<topic:string,key:string,n:bigint,shown:int>>"
#: What a fact shows as its sample: the headword, its line, the record's begin, its first line, or nothing.
HEADWORD, LINE, BEGIN, FIRST, NOTHING = range(5)
#: Characters of a record that are shown.
SHOWN = 500


def fact(topic: Column | str, key: Column, when: Column | None = None, n: Column | int = 1, shown: Column | int = HEADWORD) -> Column:
    number = lambda x, kind: (F.lit(x) if isinstance(x, int) else x).cast(kind)
    one = F.struct((F.lit(topic) if isinstance(topic, str) else topic).alias("topic"), key.cast("string").alias("key"), number(n, "long").alias("n"), number(shown, "int").alias("shown"))
    return one if when is None else F.when(when, one)


def _starting(text: Column, words) -> Column:
    return F.coalesce(*[F.when(text.startswith(w), F.lit(w)) for w in words])


def shape(kinds: Column) -> Column:
    """Kinds in order, runs written as kind×length; EMPTY for none."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"))

    def written(acc: Column) -> Column:
        last = F.when(acc.n > 1, F.concat(acc.kind, F.lit("×"), acc.n.cast("string"))).otherwise(acc.kind)
        return F.when(acc.n > 0, F.concat(acc.done, F.array(last))).otherwise(acc.done)

    def step(acc: Column, kind: Column) -> Column:
        same = acc.kind.eqNullSafe(kind)
        return F.struct(F.when(same, acc.done).otherwise(written(acc)).alias("done"), kind.alias("kind"), F.when(same, acc.n + 1).otherwise(1).alias("n"))

    runs = F.aggregate(kinds, start, step, written)
    return F.when(F.size(kinds) == 0, "EMPTY").otherwise(F.array_join(runs, " "))


def prepared(records: DataFrame) -> DataFrame:
    """Records with their lines that aren't empty, and what lines need to know of their record. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    # With their number named, adaptive execution doesn't join partitions that are small in bytes but much work.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select("ordinal", "headword", text.alias("text")).repartition(parts, "ordinal")
    rows = rows.withColumn("lines", F.filter(F.split("text", LINE_ENDS), lambda x: x != ""))
    first = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    rows = rows.withColumn("first", first).withColumn("labelled", F.coalesce(first.rlike(LABEL), F.lit(False)))
    rows = rows.withColumn("is_link", F.col("text").rlike(LINK)).withColumn("is_redirect", F.col("text").rlike(REDIRECT_RECORD))
    marks = F.transform(F.filter("lines", lambda x: x.rlike(f"^{PRIMARY}")), lambda x: F.substring(x, 1, 1))
    rows = rows.withColumn("marks", marks).withColumn("numbers", F.filter(F.transform("marks", lambda m: F.call_function("locate", m, F.lit(NUMBERED))), lambda k: k > 0))
    places = lambda found: F.filter(F.transform("lines", lambda x, i: F.when(found(x), i)), lambda i: i.isNotNull())
    note = lambda x: x.startswith("◈") | x.startswith("▶") | _starting(x, LINE_SECTIONS).isNotNull()
    rows = rows.withColumn("last_mark", F.array_max(places(lambda x: x.rlike(f"^{PRIMARY}")))).withColumn("first_note", F.array_min(places(note)))
    return rows.withColumn("kinds", F.transform("lines", lambda x, i: line_kind(x, i, F.col("labelled"))))


def counted(topic: str, text: Column, tokens, shown: int) -> Column:
    """Facts of the tokens that stand in a text, found in one pass. No token is part of another."""
    found = F.regexp_extract_all(text, F.lit("|".join(tokens)), F.lit(0))
    each = lambda all_: F.transform(F.array_distinct(all_), lambda t: fact(topic, t, n=F.size(F.filter(all_, lambda x: x == t)), shown=shown))
    # As the variable of a lambda, what was found is computed once a row.
    return F.flatten(F.transform(F.array(found), each)).cast(NONE)


def unbalanced(topic: str, text: Column, pairs: dict[str, str], shown: int) -> Column:
    """Facts of the pairs whose signs differ in number, as `<pair>: left/right`."""
    found = F.regexp_extract_all(text, F.lit("[" + "".join(a + b for a, b in pairs.items()) + "]"), F.lit(0))
    of = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs.items()])

    def one(all_: Column) -> Column:
        n = lambda sign: F.size(F.filter(all_, lambda x: x == sign))
        sides = F.transform(of, lambda p: F.struct(F.concat(p.a, p.b, F.lit(": "), n(p.a).cast("string"), F.lit("/"), n(p.b).cast("string")).alias("key"), (n(p.a) != n(p.b)).alias("bad")))
        return F.when(F.size(all_) > 0, F.transform(F.filter(sides, lambda s: s.bad), lambda s: fact(topic, s.key, shown=shown))).otherwise(F.array().cast(NONE))

    return F.flatten(F.transform(F.array(found), one)).cast(NONE)


def record_facts() -> tuple[Column, Column]:
    """The facts of a record as a whole: one each or null, and lists of them. The first have no lambdas around them and
    so are compiled."""
    text, numbers, marks = F.col("text"), F.col("numbers"), F.col("marks")
    pairs = F.arrays_zip(F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))).alias("a"), F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))).alias("b"))
    flags = {
        "mixed": F.array_contains(marks, "◯") & (F.size(numbers) > 0),
        "repeated": F.size(numbers) > F.size(F.array_distinct(numbers)),
        "skipping": F.exists(pairs, lambda p: p["b"] > p["a"] + 1),
        "restarting": F.exists(pairs, lambda p: p["b"] <= p["a"]),
    }
    pattern, relation = heading_pattern(F.col("first"), F.col("is_link"), F.col("is_redirect"), F.col("labelled"), F.col("headword"))
    some = F.size("lines") > 0
    single = [
        fact("marker-sequence", F.when(F.size(marks) > 0, F.array_join(marks, "")).otherwise("none")),
        *[fact("numbering", F.lit(name), flag) for name, flag in flags.items()],
        *[fact("nested", F.lit(name), F.regexp_count(text, F.lit(p)) > 0, F.regexp_count(text, F.lit(p)), BEGIN) for name, p in NESTED.items()],
        fact("examples-per-entry", F.size(F.filter("lines", lambda x: x.startswith("｢")))),
        fact("heading-pattern", pattern, some, shown=FIRST),
        fact("heading-relation", relation, some, shown=FIRST),
        fact("shape", shape(F.col("kinds"))),
        fact("coverage", F.lit("entries-with-unclassified-lines"), F.array_contains("kinds", "RAW")),
        *[fact("anomaly", F.lit(name), text.rlike(p), shown=BEGIN) for name, p in ANOMALIES.items()],
    ]
    tokens = {"artifact": ARTIFACTS, "marker-anywhere": f"◯{NUMBERED}", "bracket-character": [c for pair in BRACKETS.items() for c in pair]}
    many = [
        *[counted(topic, text, of, BEGIN if topic == "artifact" else HEADWORD) for topic, of in tokens.items()],
        F.transform(marks, lambda m: fact("marker", m)),
        unbalanced("quote-imbalance", text, QUOTES, BEGIN),
        unbalanced("bracket-imbalance", text, BRACKETS, BEGIN),
        F.transform(F.regexp_extract_all(text, F.lit(UNUSUAL), F.lit(0)), lambda c: fact("codepoint", code_point(c), shown=NOTHING)),
    ]
    return F.array(*single), F.concat(*many).cast(NONE)


def code_point(c: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    number = F.hex(F.ascii(c))
    return F.concat(F.lit("U+"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def line_facts() -> tuple[Column, Column]:
    """The facts of a line (raw, line, kind), with its record's columns beside it: one each or null, and a list."""
    raw, t = F.col("raw"), F.col("line")
    section, rest = _starting(raw, LINE_SECTIONS), F.substring(raw, F.lit(2), F.char_length(raw))
    place = F.when(F.size("marks") == 0, "before-definition").when(t > F.col("last_mark"), "after-last-definition").otherwise("between-definitions")
    separated = F.substring(raw, F.lit(3), F.char_length(raw)).rlike("[・、;]")
    definition, example = raw.rlike(f"^{PRIMARY}"), raw.startswith("｢")
    category = F.when(definition, "definition").when(example, "example").otherwise("other")
    single = [
        fact("pos", F.regexp_extract(raw, LABEL, 1), raw.rlike(LABEL)),
        fact("diamond", F.coalesce(_starting(rest, SECTIONS), F.lit("(unlabeled)")), raw.startswith("◈"), shown=LINE),
        fact("section", section, section.isNotNull(), shown=LINE),
        fact("section", F.lit("▶"), raw.startswith("▶"), shown=LINE),
        fact("section-position", F.concat(section, F.lit("|"), place), section.isNotNull(), shown=LINE),
        fact("derivative-shape", F.when(separated, "multiple-separators").otherwise("single-run"), section == "派生", shown=LINE),
        fact("arrow", F.coalesce(_starting(rest, LINE_SECTIONS), F.lit("(unlabeled)")), raw.startswith("▶"), shown=LINE),
        fact(F.concat(F.lit("slash-"), category), slash_shape(raw, F.when(category == "other", 0).otherwise(1)), F.lit(True), shown=F.when(raw.contains("/"), LINE).otherwise(NOTHING)),
        fact("example-note", F.when(F.col("first_note") < t, "after-notes").otherwise("before-notes"), example),
        fact("example-delimiter", F.lit("｢…｣"), example),
        fact("example-delimiter", F.lit("nested/multiple ｢…｣"), example & ((occurrences(raw, "｢") > 1) | (occurrences(raw, "｣") > 1))),
        fact("coverage", F.lit("unclassified-lines"), F.col("kind") == "RAW", shown=LINE),
    ]
    return F.array(*single), counted("quote-character", raw, [c for pair in QUOTES.items() for c in pair], HEADWORD)


def reference_facts(records: DataFrame) -> DataFrame:
    """The facts of records that refer to others: how the key relates to the link's parts, and whether targets exist."""
    link = [F.regexp_extract("text", LINK, i + 1).alias(n) for i, n in enumerate(("target", "display", "source"))]
    warned = (F.regexp_extract("text", LINK, 6) != "").alias("warned")
    marked = records.select("ordinal", "headword", "text").filter(F.col("text").contains("@@@LINK="))
    links = marked.filter(F.col("text").rlike(LINK)).select("ordinal", "headword", "text", F.lit("link").alias("topic"), *link, warned)
    target = F.trim(F.split_part(F.regexp_extract("text", REDIRECT_RECORD, 1), F.lit(" 【"), F.lit(1)))
    redirects = records.filter(F.col("text").rlike(REDIRECT_RECORD)).select("ordinal", "headword", "text", F.lit("redirect").alias("topic"), target.alias("target"), F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("warned"))
    known = records.select(F.col("headword").alias("target")).distinct().withColumn("known", F.lit(True))
    both = links.unionByName(redirects).join(known, "target", "left")
    relation = link_relation()
    single = [
        fact(F.col("topic"), F.lit("records"), F.col("topic") == "redirect", shown=BEGIN),
        fact(F.col("topic"), F.lit("parsed"), F.col("topic") == "link", shown=BEGIN),
        fact(F.col("topic"), F.when(F.col("known"), "target-in-index").otherwise("target-missing"), F.lit(True), shown=BEGIN),
        fact(F.col("topic"), relation, F.col("topic") == "link", shown=BEGIN),
        fact(F.col("topic"), F.lit("warning-marker"), F.col("warned"), shown=BEGIN),
    ]
    facts = both.select("ordinal", F.explode(F.array_compact(F.array(*single)).cast(NONE)).alias("f"))
    every = F.array_compact(F.array(fact("link", F.lit("records"), shown=BEGIN), fact("link", F.lit("malformed"), ~F.col("text").rlike(LINK), shown=BEGIN))).cast(NONE)
    return facts.unionByName(marked.select("ordinal", F.explode(every).alias("f")))


def link_relation() -> Column:
    """How a link's headword relates to its target, display and source."""
    return (
        F.when(F.col("headword") == F.col("target"), "headword=target")
        .when(F.col("headword") == F.col("display"), "headword=display")
        .when(casefold("headword") == casefold("target"), "casefold-target")
        .when(F.contains("source", "headword"), "headword-in-source-orthography")
        .otherwise("unexplained-mismatch")
    )


def facts(records: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """topic, key, ordinal, n, line, shown: a row for each record that has the key, with the first line that has it (-1
    for the record as a whole). rows: the records as `prepared` gives them."""
    rows = (prepared(records).cache() if rows is None else rows).withColumn("line", F.lit(-1))
    quoted = "[" + "".join(a + b for a, b in QUOTES.items()) + "]"
    beside = ("ordinal", "marks", "last_mark", "first_note")
    of_lines = rows.select(*beside, F.posexplode(F.arrays_zip("lines", "kinds")).alias("line", "x")).select(*beside, "line", F.col("x.lines").alias("raw"), F.col("x.kinds").alias("kind"))

    def stated(of: DataFrame, found: Column) -> DataFrame:
        return of.select("ordinal", "line", F.explode(found).alias("f")).filter("f is not null")

    def each(found: DataFrame) -> DataFrame:
        return found.groupBy("f.topic", "f.key", "ordinal").agg(F.sum("f.n").alias("n"), F.min("line").alias("line"), F.min("f.shown").alias("shown"))

    # Records are dealt by ordinal, so these groups need no shuffle; no topic and key is in two of the tables.
    (of_record, in_record), (of_line, in_line) = record_facts(), line_facts()
    tables = [stated(rows, in_record), stated(of_lines, of_line), stated(of_lines.filter(F.col("raw").rlike(quoted)), in_line)]
    # A record states each of its single facts once, so these are not grouped.
    once = stated(rows, of_record).select("f.topic", "f.key", "ordinal", "f.n", "line", "f.shown")
    out = each(reference_facts(records).withColumn("line", F.lit(-1))).unionByName(once)
    for t in tables:
        out = out.unionByName(each(t))
    return out


def summary(found: DataFrame, rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """topic, key, n, entries, samples: occurrences, records, and what the first records with the key show."""
    totals = found.groupBy("topic", "key").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    rank = F.row_number().over(Window.partitionBy("topic", "key").orderBy("ordinal"))
    few = found.filter(F.col("shown") != NOTHING).withColumn("r", rank).filter(F.col("r") <= samples)
    sample = F.when(F.col("shown") == HEADWORD, F.col("headword")).when(F.col("shown") == LINE, F.get("lines", F.col("line"))).when(F.col("shown") == BEGIN, F.substring("text", 1, SHOWN)).otherwise(F.col("first"))
    shown = few.join(rows.select("ordinal", "headword", "text", "first", "lines"), "ordinal").groupBy("topic", "key").agg(F.array_sort(F.collect_list(F.struct("r", sample.alias("s")))).alias("x"))
    same = F.col("t.topic").eqNullSafe(F.col("f.topic")) & F.col("t.key").eqNullSafe(F.col("f.key"))
    every = F.coalesce(F.transform("x", lambda x: x.s), F.array().cast("array<string>"))
    return totals.alias("t").join(shown.alias("f"), same, "left").select("t.topic", "t.key", "n", "entries", every.alias("samples"))


def report(records: DataFrame) -> dict[str, DataFrame]:
    """The audit: the facts with their counts and samples, the parser's nodes, sizes, duplicates and longest records."""
    rows = prepared(records).cache()  # read for the facts of records and of lines, and for samples
    found = facts(records, rows).cache()  # read by totals and samples
    sized = records.select("ordinal", "headword", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return {
        "facts": summary(found, rows),
        "nodes": node_audit(parse_records(records)),
        "sizes": size_statistics(sized, "size"),
        "duplicates": duplicate_groups(records, "headword"),
        "longest": longest(sized, "size", LONGEST, "headword", "text"),
    }
