"""Byte-level BPE encoding and decoding.

A text is cut into pieces by a pattern; a piece starts as its bytes, and the pair of neighbouring tokens whose bytes
joined have the least rank, the leftmost of equals, is merged until no pair has a rank. Which pair that is stands at
the root of a segment tree over the piece's byte positions: a leaf holds the rank of the pair that starts there, a node
the least (rank, position) below it. A merge changes at most three leaves: that of the new token, of the neighbour it
swallowed, and of the live neighbour to its left; each is carried up to the root. A piece that is a token as a whole is
that token, whatever its merges would give.

Many short pieces go up their trees together, as rows of one array; a long piece has a tree of its own, so n bytes take
n log n steps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import annotate, slices, table, text_of

#: Text that is cut at a time, in bytes, and pieces that are encoded at a time: a very long text is taken in parts.
SLICE = 8 << 20
PIECES = 1 << 20
#: Pieces of up to so many bytes share the arrays of trees.
SHORT = 64
#: Ids that are decoded at a time.
IDS = 1 << 20
#: Tokens a vocabulary may have: the driver reads it whole, and each task gets its arrays.
MOST_TOKENS = 1 << 21
NONE = np.int64(1) << 62


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id (`starts`, `sizes` into `flat`; size 0: no such id), the pairs that merge, and whole tokens by bytes."""

    pattern: str
    ids: dict[bytes, int]
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the pair doesn't merge or a side is -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)


def load(path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """The vocabulary of a rank file: a token in base64 and its rank, which is its id, on each line."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if len(ids) > MOST_TOKENS or max(ids.values(), default=0) >= 2 * MOST_TOKENS:
        raise ValueError(f"a vocabulary may have {MOST_TOKENS} tokens")
    if any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("a byte is no token")
    sizes = np.zeros(max(ids.values()) + 1, dtype=np.int64)
    for token, i in ids.items():
        sizes[i] = len(token)
    pairs = {}
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
    return Vocabulary(
        pattern,
        ids,
        np.frombuffer(b"".join(sorted(ids, key=ids.get)), dtype=np.uint8),
        np.cumsum(sizes) - sizes,
        sizes,
        np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64),
        keys,
        np.array([pairs.get(k, NONE) for k in keys.tolist()], dtype=np.int64),
    )


def merge_together(data: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many pieces, one after another, and how many each has. data: a row of bytes for each piece, as many
    columns as a power of two; sizes: the bytes that count. The rows' trees are updated level by level, together."""
    n, width = data.shape
    shift = np.int64(width.bit_length() - 1)
    # Column `width` stands for the end on both sides; it holds no token.
    token = np.full((n, width + 1), -1, dtype=np.int64)
    token[:, :width] = np.where(np.arange(width) < sizes[:, None], vocab.byte_ids[data], -1)
    after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
    after[np.arange(n), sizes - 1] = width
    before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
    tree = np.full((n, 2 * width), NONE, dtype=np.int64)
    first = vocab.ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = np.where(first < NONE, (first << shift) | np.arange(width), NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    leaves, places, nodes = (x.reshape(-1) for x in (token, after, tree))
    lefts = before.reshape(-1)
    row = np.arange(n)
    while len(row):
        least = nodes[row * (2 * width) + 1]
        row, least = row[least < NONE], least[least < NONE]
        base, here, new = row * (width + 1), least & (width - 1), least >> shift
        swallowed = places[base + here]
        right, left = places[base + swallowed], lefts[base + here]
        leaves[base + here], leaves[base + swallowed] = new, -1
        places[base + here] = right
        lefts[base + right] = here
        of_new, of_left = vocab.ranks(new, leaves[base + right]), vocab.ranks(leaves[base + left], new)
        has = np.flatnonzero(left < width)
        rows = np.concatenate([row, row, row[has]]) * (2 * width)
        place = np.concatenate([swallowed, here, left[has]])
        rank = np.concatenate([np.full(len(row), NONE), of_new, of_left[has]])
        at = place + width
        nodes[rows + at] = np.where(rank < NONE, (rank << shift) | place, NONE)
        while len(at) and at[0] > 1:  # all leaves are at one depth
            at = at >> 1
            nodes[rows + at] = np.minimum(nodes[rows + 2 * at], nodes[rows + 2 * at + 1])
    live = token[:, :width] >= 0
    return token[:, :width][live], live.sum(axis=1)


def merge_alone(piece: bytes, vocab: Vocabulary, pairs: dict[int, int]) -> list[int]:
    """The ids of one piece of any size, by a tree of its own. pairs: the vocabulary's pairs and ranks."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    far = int(NONE)
    token = [vocab.byte_ids[b].item() for b in piece] + [-1]
    after, before = [*range(1, n + 1), n], [-1, *range(n)]
    tree = [far] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(token[i] << 32 | token[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(place: int, left: int, right: int) -> None:
        rank = pairs.get(left << 32 | right) if right >= 0 else None
        at = width + place
        tree[at] = far if rank is None else rank * width + place
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                break
            tree[at] = least

    while tree[1] < far:
        new, here = divmod(tree[1], width)
        swallowed = after[here]
        right, left = after[swallowed], before[here]
        token[here], token[swallowed] = new, -1
        after[here], before[right] = right, here
        put(swallowed, -1, -1)
        put(here, new, token[right])
        if left >= 0:
            put(left, token[left], new)
    return [t for t in token if t >= 0]


class Encoder:
    """Encodes texts with one vocabulary; holds nothing of the texts it has seen."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.pattern = regex.compile(vocab.pattern)
        self.pairs: dict[int, int] | None = None

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in order, and how many each has. Equal pieces are merged once."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        raw = coded.dictionary.cast(pa.large_binary())
        flat, counts = self._distinct(raw)
        code = np.asarray(coded.indices).astype(np.int64)
        starts = np.cumsum(counts) - counts
        n = counts[code]
        ends = np.cumsum(n)
        return flat[np.repeat(starts[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n

    def _distinct(self, raw: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        parts = raw.to_pylist()
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        whole = np.fromiter((self.vocab.ids.get(p, -1) for p in parts), dtype=np.int64, count=len(parts))
        counts = (whole >= 0).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        data = np.frombuffer(b"".join(parts) + bytes(SHORT), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        least = 1
        while least < SHORT:
            mine = np.flatnonzero((whole < 0) & (sizes > least) & (sizes <= 2 * least))
            least *= 2
            for at in range(0, len(mine), (1 << 20) // least):
                some = mine[at : at + (1 << 20) // least]
                ids, n = merge_together(data[starts[some][:, None] + np.arange(least)], sizes[some], self.vocab)
                counts[some] = n
                found.append((np.repeat(some, n), ids))
        for i in np.flatnonzero((whole < 0) & (sizes > SHORT)).tolist():
            if self.pairs is None:
                self.pairs = dict(zip(self.vocab.pair_keys.tolist(), self.vocab.pair_ranks.tolist(), strict=True))
            ids = np.array(merge_alone(parts[i], self.vocab, self.pairs), dtype=np.int64)
            counts[i] = len(ids)
            found.append((np.full(len(ids), i), ids))
        order = np.argsort(np.concatenate([o for o, _ in found]), kind="stable")
        return np.concatenate([ids for _, ids in found])[order], counts

    def texts(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        held: list[str] = []
        ids: list[np.ndarray] = []
        total = np.zeros(len(texts), dtype=np.int64)
        owner: list[tuple[int, int]] = []  # (text, pieces of it that are held)

        def flush() -> None:
            flat, n = self.pieces(held)
            ids.append(flat.astype(np.int32))
            at = 0
            for text, pieces in owner:
                total[text] += n[at : at + pieces].sum()
                at += pieces
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if len(text) < SLICE:
                found = self.pattern.findall(text)
                held += found
                owner.append((i, len(found)))
                if len(held) >= PIECES:
                    flush()
            else:
                matches = self.pattern.finditer(text)
                while found := [m.group() for m in islice(matches, PIECES)]:
                    held += found
                    owner.append((i, len(found)))
                    flush()
        flush()
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total)]), pa.int64()), pa.array(np.concatenate(ids), pa.int32())).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, vocab: Vocabulary, added: str = "ids") -> DataFrame:
    """docs (text) with the ids of each whole text, array<int>.

    Null and empty texts have no ids. A very long text is cut into pieces in parts of PIECES, a very long piece has a tree
    of its own; neither is shortened. Of pairs of equal rank the leftmost merges. Repeated rows agree; a column of docs
    that is named as the added one is replaced, others stay; a table without rows gives one without rows. Text that
    looks like a special token is text.
    """

    def make():
        encoder = Encoder(vocab)
        return lambda batch: [encoder.texts(text_of(batch).to_pylist())]

    return annotate(docs, make, f"`{added}` array<int>", SLICE)


def bytes_of(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes that ids stand for, joined."""
    out = []
    for at in range(0, len(ids), IDS):
        some = ids[at : at + IDS].astype(np.int64)
        bad = (some < 0) | (some >= len(vocab.sizes))
        if bad.any() or not vocab.sizes[some].all():
            raise ValueError(f"no token has the id {some[bad][0] if bad.any() else some[vocab.sizes[some] == 0][0]}")
        n = vocab.sizes[some]
        ends = np.cumsum(n)
        out.append(vocab.flat[np.repeat(vocab.starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def decode(rows: DataFrame, vocab: Vocabulary, ids: str = "ids", added: str = "decoded") -> DataFrame:
    """rows (ids, array<int>) with the bytes that the ids stand for, binary.

    A null or empty list stands for no bytes; a list as long as may be is decoded in parts. An id that no token has, a
    null among them, is an error, as nothing could stand for it. Repeated rows agree; a column that is named as the
    added one is replaced, others stay; a table without rows gives one without rows.
    """
    kept = rows.select([F.col(f"`{c}`") for c in rows.columns if c.lower() != added.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                flat = np.asarray(pc.fill_null(lists.flatten(), -1))
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                decoded = [bytes_of(flat[a:b], vocab) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, added])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(f"`{added}` binary").fields]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab).drop("text")
    return decode(ids, vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
