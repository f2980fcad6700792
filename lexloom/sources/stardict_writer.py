"""Writes StarDict containers from a table, many side by side, in two phases.

Rows are dealt by range of the format's order, and each task writes one container (header, index, payload, list of record
starts) into a folder of its own below that of the write. Nothing there counts until the commit writes the manifest, under
another name first and then moved, so readers see the old containers or the new, never a mixture. A task that fails
removes what it wrote, an aborted write its whole folder; a write that is run again replaces the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stardict import StarDictSource

#: Bytes of headwords and texts in a container, about.
CONTAINER_BYTES = 32 << 20


def in_order(word: Column) -> list[Column]:
    """What rows are ordered by in a container: the word with its ASCII letters small, then the word; both by bytes."""
    return [F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), word]


def write_containers(rows: DataFrame, folder: str, then: tuple[str, ...] = (), containers: int | None = None, bookname: str = "lexicon", mode: str = "overwrite") -> None:
    """Writes rows (headword, text) as containers. `then`: columns that order rows of one headword, which so may spread over
    containers; of rows that agree in all of them a hash of the text tells."""
    spark = rows.sparkSession
    spark.dataSource.register(StarDictSource)
    if containers is None:
        size = rows.agg(F.sum(F.octet_length("headword") + F.octet_length("text"))).first()[0] or 0
        containers = max(1, -(-size // CONTAINER_BYTES))
    # Ranges are cut by a sample of the keys, which the driver gets: no whole texts among them.
    keys = [*in_order(F.col("headword")), *map(F.col, then), F.xxhash64("text")]
    dealt = rows.repartitionByRange(containers, *keys).sortWithinPartitions(*keys).select("headword", "text")
    dealt.write.format("stardict").mode(mode).option("bookname", bookname).save(folder)
