"""Text functions of the lexical model, as column expressions where SQL has what is needed."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The white space of the sources' language of origin, and the characters of its scripts.
SPACES = "\t\n\x0b\x0c\r    -     　﻿"
#: The same as single characters.
TRIMMED = "".join(chr(c) for c in range(0x10000) if re.match(f"[{SPACES}]", chr(c)))
KANA = "[ぁ-ヿー]"
HAN = "[㐀-鿿]"
KANA_ONLY = "^[ぁ-ヿー]+$"
UNSAFE_ORTHOGRAPHY = "[⟪⟫⟨⟩［］]"
HYPHENS = "‐―-"
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
CONTROL = r"[\x00-\x1f\x7f]"
REDIRECT = "(?m)^@@@LINK=([^\\n\\r  ]+)$"


#: Characters that compatibility composition leaves as they are, whatever stands beside them: those up to U+024F and common
#: punctuation of which that is so. No mark that combines is among them.
STABLE = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028)) if unicodedata.normalize("NFKC", chr(c)) == chr(c)]


def ranges(characters: list[str]) -> str:
    """Characters in order as the ranges of a regular expression's class."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


#: Texts of a batch that are Python objects at one time.
PIECE = 256
MARKS = re.compile("[\u0300-\u036f]+")
SPACE_RUN = re.compile(f"[{SPACES}]+")
#: Where Python's own white space and SPACES differ.
OTHER_SPACES = re.compile("[\x1c-\x1f\x85\ufeff]")
UNSTABLE = f"[^{ranges(STABLE)}]"


def _unstable(value: Column) -> Column:
    return (F.octet_length(value) != F.char_length(value)) & value.rlike(UNSTABLE)


def each(f: Callable[[str], str], values: pa.Array) -> pa.Array:
    """f of every text but nulls. Only a few texts at a time are Python objects; a batch as a whole stays in Arrow's form."""
    parts = [pa.array([v if v is None else f(v) for v in values.slice(i, PIECE).to_pylist()], pa.string()) for i in range(0, len(values), PIECE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(value: Column | str) -> Column:
    """Compatibility-composed. Texts of characters that are so already, as most are, don't leave the JVM."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(_nfkc(F.when(_unstable(value), value)), value)


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def nfc_each(values: pd.Series) -> pd.Series:
    """Texts of a list trimmed and composed; a null among them counts as empty."""
    return values.map(lambda words: [unicodedata.normalize("NFC", (w or "").strip()) for w in words], na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(values: pd.Series) -> pd.Series:
    """Texts of a list trimmed and compatibility-composed; a null among them counts as empty."""
    return values.map(lambda words: [unicodedata.normalize("NFKC", (w or "").strip(TRIMMED)) for w in words], na_action="ignore")


@F.arrow_udf(StringType())
def _without_marks(values: pa.Array) -> pa.Array:
    return each(lambda s: MARKS.sub("", unicodedata.normalize("NFKD", s)), values)


def without_marks(value: Column | str) -> Column:
    """Decomposed, without the combining marks U+0300 to U+036F; ASCII without leaving the JVM."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(_without_marks(F.when(F.octet_length(value) != F.char_length(value), value)), value)


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def casefold(value: Column | str) -> Column:
    """Folded for comparison without regard to case, letters that fold to several included; ASCII on the JVM."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(_casefold(F.when(F.octet_length(value) != F.char_length(value), value)), F.lower(value))


@F.pandas_udf(StringType())
def stable_json(values: pd.Series) -> pd.Series:
    """JSON text with keys in order and no white space."""
    return values.map(lambda s: json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False, separators=(",", ":")), na_action="ignore")


def trim_spaces(value: Column) -> Column:
    """Without the white space at both ends, line breaks included."""
    return F.regexp_replace(value, f"^[{SPACES}]+|[{SPACES}]+$", "")


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, f"[{SPACES}]+", " "))


def _composed(s: str) -> str:
    s = unicodedata.normalize("NFKC", s)
    return SPACE_RUN.sub(" ", s).strip(" ") if OTHER_SPACES.search(s) else " ".join(s.split())


@F.arrow_udf(StringType())
def _composed_spaces(values: pa.Array) -> pa.Array:
    return each(_composed, values)


def strip_nul(value: Column) -> Column:
    return F.translate(value, "\u0000", "")


def normalize_headword(value: Column) -> Column:
    """Compatibility-composed, trimmed, white space made single spaces, lower-case. Computed once, when written."""
    return F.lower(_composed_spaces(value))


def normalize_ascii(value: Column) -> Column:
    """The same for ASCII texts, without leaving the JVM."""
    return F.lower(collapse_spaces(value))


def sort_key(value: Column) -> Column:
    return without_marks(normalize_headword(value))


def parse_redirect(raw: Column) -> Column:
    """The target of the first redirect line, trimmed; null without one."""
    found = F.regexp_extract(strip_nul(raw), REDIRECT, 1)
    return F.when(found != "", F.regexp_replace(found, f"^[{SPACES}]+|[{SPACES}]+$", ""))


def strip_hyphens(value: Column) -> Column:
    return F.translate(value, HYPHENS, "")


def form_kind(value: Column) -> Column:
    return F.when(value.rlike(KANA_ONLY), "kana").when(value.rlike(HAN), "kanji")


def is_safe_orthography(value: Column) -> Column:
    return (value != "") & ~value.rlike(UNSAFE_ORTHOGRAPHY)


def lexical_tokens(value: Column) -> Column:
    """Words of letters and digits with inner apostrophes, compatibility-composed."""
    return composed_tokens(nfkc(value))


def composed_tokens(value: Column) -> Column:
    """The same of a text already composed, without leaving the JVM."""
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0))


def inflected_forms(word: Column) -> Column:
    """A word with the regular English inflections that its spelling allows."""
    stem, last = F.substring(word, F.lit(1), F.length(word) - 1), F.substring(word, -1, 1)
    plain = [F.concat(word, F.lit(s)) for s in ("", "s", "ed", "ing", "er", "est")]
    none = F.array().cast("array<string>")

    def when(pattern: str, *forms: Column) -> Column:
        return F.when(word.rlike(pattern), F.array(*forms)).otherwise(none)

    return F.array_distinct(
        F.concat(
            F.array(*plain),
            when("e$", F.concat(word, F.lit("d")), F.concat(stem, F.lit("ing"))),
            when("[^aeiou]y$", *[F.concat(stem, F.lit(s)) for s in ("ies", "ied", "ier", "iest")]),
            when("ie$", F.concat(F.substring(word, F.lit(1), F.length(word) - 2), F.lit("ying"))),
            when("(?:s|x|z|ch|sh)$", F.concat(word, F.lit("es"))),
            when("[aeiou][^aeiouywx]$", *[F.concat(word, last, F.lit(s)) for s in ("ed", "ing", "er", "est")]),
        )
    )


def correction_forms(word: Column) -> Column:
    """The forms suggested for a correction: one plural, one past and one progressive of a single ASCII word."""
    low = F.lower(nfkc(collapse_spaces(word)))
    stem = F.substring(low, F.lit(1), F.length(low) - 1)
    doubled = F.concat(low, F.substring(low, -1, 1))
    plural = F.when(low.rlike("(?:s|x|z|ch|sh)$"), F.concat(low, F.lit("es"))).when(low.rlike("[^aeiou]y$"), F.concat(stem, F.lit("ies"))).otherwise(F.concat(low, F.lit("s")))
    pair = (
        F.when(low.rlike("ie$"), F.array(F.concat(low, F.lit("d")), F.concat(F.substring(low, F.lit(1), F.length(low) - 2), F.lit("ying"))))
        .when(low.rlike("e$"), F.array(F.concat(low, F.lit("d")), F.concat(stem, F.lit("ing"))))
        .when(low.rlike("[^aeiou]y$"), F.array(F.concat(stem, F.lit("ied")), F.concat(low, F.lit("ing"))))
        .when(low.rlike("[aeiou][^aeiouywx]$"), F.array(F.concat(doubled, F.lit("ed")), F.concat(doubled, F.lit("ing"))))
        .otherwise(F.array(F.concat(low, F.lit("ed")), F.concat(low, F.lit("ing"))))
    )
    return F.when(low.rlike("^[a-z]+$"), F.array_distinct(F.concat(F.array(low, plural), pair))).otherwise(F.array(word))


def contains_item(tokens: Column, target: Column) -> Column:
    """Whether the target's tokens (of composed texts) stand in a row in the text, each in some inflection. For one
    target a row; `generated.covered_items` looks for many at once."""
    offsets = F.sequence(F.lit(0), F.size(target) - 1)

    def among(forms: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - F.size(target))
        return F.exists(starts, lambda s: F.forall(offsets, lambda o: F.array_contains(F.element_at(forms, o + 1), F.element_at(tokens, s + o + 1))))

    # As the variable of a lambda, the inflections are computed once a row.
    found = F.exists(F.array(F.transform(target, inflected_forms)), among)
    return F.when((F.size(target) == 0) | (F.size(tokens) < F.size(target)), False).otherwise(found)


def length_policy(n: Column) -> Column:
    """The bounds on a paragraph's words, by the number of requested items."""

    def bounds(low: int, high: int) -> Column:
        return F.struct(F.lit(low).alias("min"), F.lit(high).alias("max"))

    return F.when(n <= 3, bounds(35, 120)).when(n <= 7, bounds(50, 150)).otherwise(bounds(80, 180))


def valid_items(words: Column, most: int = 30, longest: int = 100) -> Column:
    """Whether a request's words, composed, are few, short, printable and each with a letter or digit."""
    ok = F.forall(nfc_each(words), lambda w: (F.char_length(w) >= 1) & (F.char_length(w) <= longest) & ~w.rlike(CONTROL) & w.rlike(r"[\p{L}\p{N}]"))
    return (F.size(words) >= 1) & (F.size(words) <= most) & ok


def valid_identifier(value: Column, longest: int = 200) -> Column:
    trimmed = F.trim(value)
    return F.coalesce((trimmed != "") & (F.char_length(trimmed) <= longest) & ~trimmed.rlike(CONTROL), F.lit(False))


def align_languages(body: Column) -> Column:
    """Both sides of the one slash in a bilingual body, and how sure the split is.

    Paired: kana on the left, and Han but no kana on the right.
    """
    left, right = F.split_part(body, F.lit("/"), F.lit(1)), F.split_part(body, F.lit("/"), F.lit(2))
    one = F.length(body) - F.length(F.replace(body, F.lit("/"), F.lit(""))) == 1
    how = (
        F.when(~one, "ambiguous")
        .when(left == "", "right-only")
        .when(right == "", "left-only")
        .when(left.rlike(KANA) & ~right.rlike(KANA) & right.rlike(HAN), "paired")
        .otherwise("ambiguous")
    )
    return F.struct(F.when(one & (left != ""), left).alias("left"), F.when(one & ((right != "") | (left == "")), right).alias("right"), how.alias("alignment"))


def slash_shape(line: Column, marker: Column | int = 0) -> Column:
    """The audit's own reading of a bilingual line after a marker of that length; its Han class lacks the hexagram
    symbols."""
    line = F.substring(line, F.lit(1) + marker, F.char_length(line))
    left, right = F.split_part(line, F.lit("/"), F.lit(1)), F.split_part(line, F.lit("/"), F.lit(2))
    n = F.length(line) - F.length(F.replace(line, F.lit("/"), F.lit("")))
    kana, han = "[぀-ヿー]", "[㐀-䶿一-鿿]"
    return (
        F.when(n == 0, "none")
        .when(n > 1, "multiple")
        .when(left == "", "right-only")
        .when(right == "", "left-only")
        .when(left.rlike(kana) & ~right.rlike(kana) & right.rlike(han), "obvious-ja-zh")
        .otherwise("one-ambiguous")
    )


def model_tag(name: Column) -> Column:
    """A model name with a tag; `latest` where the last path part has none."""
    return F.when(F.substring_index(name, "/", -1).contains(":"), name).otherwise(F.concat(name, F.lit(":latest")))


def escape_xml(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def iso_timestamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
