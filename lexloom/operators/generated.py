"""Checks of generated vocabulary texts: JSON shape, length, coverage, reported words; all errors are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import sequences
from ..functions.text import composed_tokens, contains_item, inflected_forms, length_policy, lexical_tokens, nfkc, nfkc_each, trim_spaces

KEYS = ("paragraph", "translation", "usedWords")
SHAPE_ERROR = "Output must be an object with only paragraph, translation, and usedWords"


def _string(v: Column, key: str) -> Column:
    """The key's string, trimmed; null where there is none."""
    typed = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING"
    return F.when(typed, trim_spaces(F.try_variant_get(v, f"$.{key}", "string")))


def validate_generated(results: DataFrame) -> DataFrame:
    """results (text, words) with errors, word_count and valid.

    Text that isn't JSON, or isn't an object, has that one error; otherwise every error is listed. word_count is null where
    the paragraph is no string. Requested and reported words are compared composed, in small letters, without the white
    space around them.
    """
    parsed = results.withColumn("v", F.try_parse_json("text"))
    reported = F.try_variant_get("v", "$.usedWords", "array<string>")
    out = parsed.select(
        "*",
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        nfkc(_string(F.col("v"), "paragraph")).alias("paragraph"),
        nfkc_each("words").alias("asked"),
        nfkc_each(reported).alias("said"),
    )
    out = out.withColumn("tokens", composed_tokens(F.coalesce("paragraph", F.lit(""))))
    bounds = length_policy(F.size("words"))
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    missing = F.filter("words", lambda w, i: ~contains_item(F.col("tokens"), composed_tokens(F.get("asked", i))))
    strings = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.usedWords", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))

    def compared(words: str) -> Column:
        return F.sort_array(F.transform(words, F.lower))

    short = (F.size("tokens") < bounds.min) | (F.size("tokens") > bounds.max)
    errors = F.array(
        F.when(F.exists(keys, lambda k: ~k.isin(*KEYS)), SHAPE_ERROR),
        F.when(F.coalesce("paragraph", F.lit("")) == "", "paragraph must be a non-empty string"),
        F.when(F.coalesce(_string(F.col("v"), "translation"), F.lit("")) == "", "translation must be a non-empty string"),
        F.when(~strings, "usedWords must be an array of strings"),
        F.when(short, F.concat(F.lit("paragraph must contain "), bounds.min.cast("string"), F.lit("–"), bounds.max.cast("string"), F.lit(" English words"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("paragraph is missing requested items: "), F.array_join(missing, ", "))),
        F.when(strings & (compared("asked") != compared("said")), "usedWords does not match the requested vocabulary items"),
    )
    every = F.when(F.col("v").isNull(), F.array(F.lit("Output is not valid JSON"))).when(~F.col("is_object"), F.array(F.lit(SHAPE_ERROR))).otherwise(F.array_compact(errors))
    return out.withColumn("errors", every).withColumn("word_count", F.when(F.col("paragraph").isNotNull(), F.size("tokens"))).withColumn("valid", F.size("errors") == 0).drop("v", "is_object", "paragraph", "asked", "said", "tokens")


def covered_items(texts: DataFrame, items: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """key, items: for each text, those of the items whose words stand in it in a row, each in some inflection.

    The inflections of all items are looked for in one pass over each text's words; items without words stand nowhere.
    """
    spark = texts.sparkSession
    once = list(dict.fromkeys(items))
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(once)], "item int, word string").select("item", F.posexplode(lexical_tokens(F.col("word"))).alias("offset", "word"))
    forms: dict[int, dict[int, list[str]]] = {}
    for r in asked.select("item", "offset", inflected_forms(F.col("word")).alias("forms")).collect():  # a row a word asked for
        forms.setdefault(r.item, {})[r.offset] = r.forms
    known = sorted(forms)
    wanted = [[forms[i][k] for k in range(len(forms[i]))] for i in known]
    found = sequences(texts.select(key, lexical_tokens(F.col(text)).alias("words")), "words", wanted)
    names = F.array(*(F.lit(once[i]) for i in known)).cast("array<string>")
    return found.select(key, F.array_sort(F.transform("found", lambda i: F.get(names, i))).alias("items"))
