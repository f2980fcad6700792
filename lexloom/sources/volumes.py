"""Resource volumes and packages: ordered volumes, first hit wins; classification and layout of uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import content_type, extension, package_path, resource_key, volume_order


def ordered_volumes(files: DataFrame, path: str = "path") -> DataFrame:
    """Resource volumes (.mdd files) with volume_rank: by stem, the base before numbered ones, then path."""
    volumes = files.filter(F.lower(path).endswith(".mdd"))
    return volumes.withColumn("volume_rank", F.row_number().over(Window.orderBy(*volume_order(F.col(path)))) - 1)  # a package has few volumes


def lookup(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, key, content, media_type of the wanted logical paths, from the first volume that has each.

    resources: volume_rank, key, content (base64); unsafe paths are not found.
    """
    keyed = wanted.select("path", resource_key(F.col("path")).alias("key")).filter("key is not null")
    hits = keyed.join(resources, "key")
    best = hits.groupBy("path", "key").agg(F.min_by("content", "volume_rank").alias("content"))
    return best.withColumn("content", F.unbase64("content")).withColumn("media_type", content_type(F.col("content")))


def stored_files(spark, folder: str) -> DataFrame:
    """path, size, checksum of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))


def without_common_root(files: DataFrame, path: str = "path") -> DataFrame:
    """files without their first path segment, if all share it and all have more."""
    root, every = F.substring_index(path, "/", 1), Window.partitionBy()  # a package has few files
    one = (F.min(root).over(every) == F.max(root).over(every)) & (F.min(F.size(F.split(path, "/"))).over(every) > 1)
    return files.withColumn("one", one).withColumn(path, F.when(F.col("one"), F.expr(f"substring({path}, instr({path}, '/') + 1)")).otherwise(F.col(path))).drop("one")


def package_problems(files: DataFrame, path: str = "path") -> DataFrame:
    """problem: what is wrong with an uploaded package; exactly one .mdx, at most one .css, no path twice, all safe."""
    kind = extension(F.col(path))
    counted = files.agg(
        F.count_if(kind == ".mdx").alias("mdx"), F.count_if(kind == ".css").alias("css"), (F.count("*") - F.count_distinct(path)).alias("twice"), F.count_if(package_path(F.col(path)).isNull()).alias("unsafe")
    )
    problems: list[Column] = [
        F.when(F.col("mdx") != 1, F.lit("one .mdx file is due")),
        F.when(F.col("css") > 1, F.lit("more than one .css file")),
        F.when(F.col("twice") > 0, F.lit("a path occurs twice")),
        F.when(F.col("unsafe") > 0, F.lit("a path is not safe")),
    ]
    return counted.select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def package_layout(files: DataFrame, path: str = "path") -> DataFrame:
    """files with target: where each belongs in the stored package."""
    kind = extension(F.col(path))
    return files.withColumn("target", F.when(kind == ".mdx", "source.mdx").when(kind == ".css", F.concat(F.lit("styles/"), F.substring_index(path, "/", -1))).otherwise(F.concat(F.lit("resources/"), package_path(F.col(path)))))


def stylesheet_profile(styles: DataFrame, profiles: dict[str, str], content: str = "content") -> DataFrame:
    """styles with fingerprint and the compatibility profile known for it."""
    table = F.create_map(*[F.lit(x) for kv in profiles.items() for x in kv]) if profiles else None
    out = styles.withColumn("fingerprint", F.sha2(content, 256))
    return out.withColumn("profile", table[F.col("fingerprint")] if table is not None else F.lit(None).cast("string"))


def needs_profile(dictionaries: DataFrame) -> DataFrame:
    """Dictionaries stored as packages, with a stylesheet, that have no profile yet."""
    return dictionaries.filter(F.col("profile").isNull() & F.col("package_path").isNotNull() & F.col("stylesheet").isNotNull())
