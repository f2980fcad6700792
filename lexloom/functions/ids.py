"""Checksums, deterministic identifiers and deterministic samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def joined(*parts: Column | str) -> Column:
    """The parts as text, joined by NUL characters."""
    return F.concat_ws(NUL, *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def checksum(value: Column) -> Column:
    return F.sha2(value, 256)


def deterministic_uuid(*parts: Column | str) -> Column:
    """The first 16 bytes of the parts' SHA-256, with version 8 and the usual variant."""
    h = F.sha2(joined(*parts), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid(value: Column) -> Column:
    return F.lower(value).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def sample_fraction(seed: str, value: Column) -> Column:
    """A number in [0, 1) that seed and value determine."""
    return F.conv(F.substring(F.sha2(joined(seed, value), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def in_sample(seed: str, value: Column, percent: float) -> Column:
    """Whether a row belongs to the sample; none at 0 percent or less, all at 100 or more."""
    if percent <= 0:
        return F.lit(False)
    if percent >= 100:
        return F.lit(True)
    return sample_fraction(seed, value) < percent / 100


def parse_percent(text: Column) -> Column:
    """A sample rate; anything that isn't a number in [0, 100] is 0."""
    value = text.try_cast("double")
    return F.when((value >= 0) & (value <= 100), value).otherwise(0.0)


def sample_top(df: DataFrame, seed: str, n: int, id_column: str, *ties: str) -> DataFrame:
    """The n rows of the least seeded hashes, in that order."""
    return df.orderBy(F.sha2(joined(seed, F.col(id_column)), 256), *ties).limit(n)


def cache_key(**parameters: Column) -> Column:
    """SHA-256 of the parameters as a JSON object, names in order."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(parameters.items())])), 256)


def snapshot_checksum(files: DataFrame) -> DataFrame:
    """SHA-256 over name, hash and size of all files of a snapshot, in order of their rank. files: rank, name, hash, size."""
    line = F.concat(joined(F.col("name"), F.col("hash"), F.col("size")), F.lit(NUL))
    lines = F.array_sort(F.collect_list(F.struct("rank", "name", line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x.line), ""), 256).alias("checksum"))
