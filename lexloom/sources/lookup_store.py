"""A clustered store of entries: rows laid out by their keys, so that a lookup opens only the files that may hold it.

Rows are dealt by range of (keys, order) into shards and sorted within them; a shard is a partition folder of Parquet files
with a bloom filter on the last key and small row groups. A manifest, itself a small Parquet table sorted by range, has one
row a shard: least and greatest keys, and its rows. It is written last: without it there is no store, so a write that
fails halfway is never read. The order columns take part in the ranges, so one very frequent key spreads over shards.

A lookup asks the manifest, whose row groups are pruned by the dictionary, for the shards that overlap, and reads those
partitions; the conditions themselves are pushed to row groups, pages and bloom filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

KEYS = ("dictionary_id", "headword_normalized")
ORDER = ("sort_key", "source_ordinal", "id")
#: Rows in a shard, about; bytes in a row group.
SHARD_ROWS = 1_000_000
ROW_GROUP = 8 << 20
#: A lookup that overlaps more shards than this reads them by a join with the manifest, not by a list from the driver.
LISTED = 1000
SHARD = "store_shard"


def write(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER, shards: int | None = None, shard_rows: int = SHARD_ROWS) -> Store:
    """Writes rows as a store; the folder must not hold one. Null keys come first, and no lookup finds them."""
    spark = rows.sparkSession
    if SHARD in (c.lower() for c in rows.columns):
        raise ValueError(f"a column of the rows is named {SHARD}")
    if shards is None:
        shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.repartitionByRange(shards, *keys, *order).withColumn(SHARD, F.spark_partition_id())
    out = dealt.sortWithinPartitions(SHARD, *keys, *order).write.partitionBy(SHARD)
    # Pages and row groups end often, so that statistics are narrow; the filter answers for words that are not there.
    options = {"parquet.bloom.filter.enabled#" + keys[-1]: "true", "parquet.block.size": str(ROW_GROUP), "parquet.page.row.count.limit": "2000"}
    out.options(**options).mode("error").parquet(f"{path}/rows")
    ends = [f(keys[0]).alias(f"{name}_{keys[0]}") for name, f in (("least", F.min), ("greatest", F.max))]
    pair = F.struct(*keys)
    ends += [F.min(pair).alias("least"), F.max(pair).alias("greatest"), F.count("*").alias("n")]
    manifest = spark.read.parquet(f"{path}/rows").groupBy(SHARD).agg(*ends)
    manifest.repartitionByRange(max(1, shards // 100_000), SHARD).sortWithinPartitions(SHARD).write.mode("error").parquet(f"{path}/manifest")
    return open_store(spark, path, keys, order)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _shards(self, overlaps: Column) -> DataFrame:
        """The rows of the shards that may hold some; of few shards, only their folders are listed."""
        hit = self.manifest.filter(overlaps).select(SHARD)
        few = [r[0] for r in hit.limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return self.rows.join(hit, SHARD, "left_semi").drop(SHARD)
        folder = f"{self.path}/rows"
        named = [f"{folder}/{SHARD}={k}" for k in few or [self.manifest.select(SHARD).first()[0]]]
        rows = self.spark.read.option("basePath", folder).parquet(*named).drop(SHARD)
        return rows if few else rows.limit(0)

    def _group(self, dictionary: str) -> Column:
        first = self.keys[0]
        return (F.col(f"least_{first}") <= dictionary) & (F.col(f"greatest_{first}") >= dictionary)

    def _pair(self, dictionary: str, word: str) -> Column:
        return F.struct(F.lit(dictionary).alias(self.keys[0]), F.lit(word).alias(self.keys[1]))

    def exact(self, dictionary: str, word: str) -> DataFrame:
        """The entries of one headword, ordered as `search.exact`."""
        pair = self._pair(dictionary, word)
        return search.exact(self._shards(self._group(dictionary) & (F.col("least") <= pair) & (F.col("greatest") >= pair)), dictionary, word)

    def prefix(self, dictionary: str, word: str) -> DataFrame:
        """The entries of all headwords that begin so, ordered as `search.prefix`."""
        pair, least = self._pair(dictionary, word), F.col("least")
        begins = (least[self.keys[0]] == dictionary) & least[self.keys[1]].startswith(word)
        return search.prefix(self._shards(self._group(dictionary) & (F.col("greatest") >= pair) & ((least <= pair) | begins)), dictionary, word)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The entries of many headwords at once: wanted has the keys, repeated or not. Up to LISTED headwords choose the
        shards to read; more of them touch most shards, which are then read all. Either way rows meet them by the keys."""
        wanted = wanted.select(*self.keys).distinct()
        few = wanted.dropna().limit(LISTED + 1).collect()
        rows = self.rows.drop(SHARD)
        if len(few) <= LISTED:
            pairs = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(self.keys, r, strict=True))) for r in few))
            rows = self._shards(F.exists(pairs, lambda p: (F.col("least") <= p) & (F.col("greatest") >= p)) if few else F.lit(False))
        return rows.join(wanted, list(self.keys), "left_semi")


def open_store(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER) -> Store:
    """The store in a folder. One without a manifest was never finished; that is an error, as for any missing table."""
    store = Store(spark, path.rstrip("/"), keys, order)
    store.manifest.schema  # noqa: B018 - fails here, not at the first lookup
    return store
