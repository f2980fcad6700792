"""Assertions over the model: each returns the rows that violate it, so a sound store gives empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHECKS, REFERENCES, UNIQUE
from ..storage import durable

LANGUAGE = "^[a-z]{2,3}(-[A-Z]{2})?$"
ISSUE = "table string, code string, ref string"


def _issue(df: DataFrame, table: str, code: str, ref: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(code).alias("code"), ref.cast("string").alias("ref"))


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Values of the columns that occur more than once, with their number. A null in the last column names nothing,
    except that a null parent is the root's own parent."""
    nullable = [c for c in columns[1:] if c not in ("parent_block_id",)]
    kept = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in nullable])) if nullable else df
    return kept.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Child rows whose reference isn't found; a null last column refers to nothing."""
    known = parent.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)])
    return child.filter(F.col(columns[-1]).isNotNull()).join(known, same, "left_anti")


def missing_values(df: DataFrame, schema) -> Column:
    """Names of required columns that are null in a row."""
    return F.array_compact(F.array(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable]))


def integrity_issues(tables: dict[str, DataFrame]) -> DataFrame:
    """table, code, ref of all violated keys, references and row conditions among the given tables."""
    found = []
    for name, df in tables.items():
        for columns in UNIQUE.get(name, ()):
            dup = duplicates(df, *columns)
            found.append(_issue(dup, name, f"duplicate:{','.join(columns)}", F.concat_ws("|", *columns)))
        for columns, parent, keys in REFERENCES.get(name, ()):
            if parent in tables:
                found.append(_issue(orphans(df, columns, tables[parent], keys), name, f"orphan:{','.join(columns)}", F.concat_ws("|", *columns)))
        for code, condition in CHECKS.get(name, {}).items():
            found.append(_issue(df.filter(f"NOT coalesce({condition}, false)"), name, f"check:{code}", F.col("id") if "id" in df.columns else F.lit(None)))
    return reduce(DataFrame.unionByName, found)


def block_levels(blocks: DataFrame, key: str = "id", parent: str = "parent_block_id", strict: bool = True) -> DataFrame:
    """key, level: roots at 0, children one below their parents, however deep.

    Every round doubles how far a block looks up, so rounds grow with the logarithm of the depth. Blocks in a cycle or
    below a missing parent are an error; if not strict, they have level null.
    """
    state = blocks.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("d"), F.lit(False).alias("lost"))
    state = durable(state)
    rounds = state.count().bit_length() + 1
    while rounds and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("lost").alias("lost2"), F.lit(True).alias("known"))
        both = state.join(above, "up", "left")
        missing = F.col("up").isNotNull() & F.col("known").isNull()
        state = durable(both.select("k", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), (F.col("lost") | missing | F.coalesce("lost2", F.lit(False))).alias("lost")))
        rounds -= 1
    placed = F.when(F.col("up").isNull() & ~F.col("lost"), F.col("d"))
    out = state.select(F.col("k").alias(key), placed.alias("level"))
    if strict:
        must_be_empty(out.filter("level is null"), "blocks in a cycle or without their parent")
    return out


def projection_issues(nodes: DataFrame, forms: DataFrame, definitions: DataFrame, examples: DataFrame, blocks: DataFrame, accounting: DataFrame) -> DataFrame:
    """code, ordinal of everything wrong with projected records (tables as `lines` makes them).

    Ordinals are unique and not negative; parents are of the same record and don't go round; languages look like
    languages; examples stand on example blocks, one each; every node is accounted for.
    """

    def bad_ordinals(df: DataFrame, column: str, *scope: str) -> list[DataFrame]:
        keys = ["ordinal", *scope]
        dup = df.groupBy(*keys, column).count().filter("count > 1")
        return [_coded(dup, "duplicate-ordinal"), _coded(df.filter((F.col(column) < 0) | F.col(column).isNull()), "invalid-ordinal")]

    def _coded(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.col("ordinal").cast("long").alias("ordinal"))

    own = blocks.select("ordinal", F.col("block").alias("parent_block"))
    texts = blocks.select("ordinal", F.explode("texts").alias("x")).select("ordinal", "x.language")
    of_line = blocks.select("ordinal", "line", "kind")
    at_block = examples.join(of_line, ["ordinal", "line"], "left")
    counts = nodes.groupBy("ordinal").count().join(accounting.select("ordinal", "line").distinct().groupBy("ordinal").agg(F.count("*").alias("accounted")), "ordinal", "left")
    found = [
        *bad_ordinals(forms, "form_ordinal"),
        *bad_ordinals(definitions, "definition_ordinal", "language"),
        *bad_ordinals(examples, "example_ordinal"),
        *bad_ordinals(blocks, "sibling_ordinal", "parent_block"),
        _coded(definitions.filter(~F.col("language").rlike(LANGUAGE)), "invalid-language"),
        _coded(texts.filter(F.col("language").isNotNull() & ~F.col("language").rlike(LANGUAGE)), "invalid-language"),
        _coded(at_block.filter("kind is null"), "invalid-example-block"),
        _coded(at_block.filter("kind <> 'example'"), "invalid-example-block-kind"),
        _coded(examples.groupBy("ordinal", "line").count().filter("count > 1"), "duplicate-example-block"),
        _coded(blocks.filter("parent_block = block"), "invalid-block-parent"),
        _coded(blocks.filter("parent_block is not null").join(own, ["ordinal", "parent_block"], "left_anti"), "invalid-block-parent"),
        # A parent always stands before its block, so a parent that doesn't is part of a way round.
        _coded(blocks.filter("parent_block > block"), "block-cycle"),
        _coded(nodes.join(accounting.filter(F.size("destinations") > 0), ["ordinal", "line"], "left_anti"), "dropped-ast-node"),
        _coded(counts.filter("coalesce(accounted, 0) <> count"), "accounting-cardinality"),
    ]
    return reduce(DataFrame.unionByName, found)


def must_be_empty(issues: DataFrame, what: str) -> None:
    """Raises an error with a first example unless there are no rows."""
    first = issues.first()
    if first is not None:
        raise ValueError(f"{what}: {first}")
