"""Benchmark decontamination: BM25 over test items, block-max WAND, and a check of question and answer.

Test items are cut into pieces of at most `PIECE` words and indexed: a posting holds a piece and the term's share of
the piece's BM25 score against itself, so scores lie in [0, 1] and one threshold fits short and long pieces. Every
document is read as overlapping passages of two steps of `STEP` words, so any piece that a document repeats lies whole
within some passage, and every passage is a query.

Two bounds come before the exact search, as WAND's own pivoting, passage by passage, is slow in Python (see README). Terms that many pieces share are set aside as long as no piece gets more than
`SLACK` of its score from them; a passage must then reach `threshold - rest(piece)` from the others, which is tested for
all passages of a slice at once. Passages left are searched by block-max WAND. Each hit is verified against the whole
document: enough of the item's question and of its answer must stand in it, word for word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, durable, encode, free_name, hash_words, mix, owners, slices, split_words, table, text_of, windows

PIECE, STEP = 32, 32
THRESHOLD = 0.6
SLACK = 0.35
K1, B = 1.2, 0.75
BLOCK = 64
#: Words in one index; a larger benchmark is searched with several indexes in turn.
INDEX_WORDS = 2_000_000
#: Words of the phrases that overlap is counted in, and the share of question and answer to be found.
PHRASE, OVERLAP = 3, 0.5
MARKS = ".,;:!?\"'()[]{}*$%&#|<>"


def term_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes of all words, lower-case without marks around them; words of each text; the words as they stand."""
    words, counts = split_words(text)
    codes, distinct = encode(words)
    return hash_words(pc.utf8_trim(pc.utf8_lower(distinct), MARKS))[codes], counts, words


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        h, counts, words = term_hashes(text_of(batch))
        ends = np.asarray(pc.match_substring_regex(words, r"[.!?]$"))
        start, items, versions = 0, batch.column("item_id").to_pylist(), batch.column("version").to_pylist()
        for item, version, n in zip(items, versions, counts.tolist(), strict=True):
            own, stops = h[start : start + n].view(np.int64), np.flatnonzero(ends[start : start + n]) + 1
            start += n
            if not n:
                continue
            # The answer is the last sentence; in an item of one sentence, the last quarter.
            cut = max([s for s in stops.tolist() if s < n], default=0) or max(1, n - max(1, n // 4))
            parts = max(1, -(-n // PIECE))
            bounds = [n * p // parts for p in range(parts + 1)]
            rows = [(item, version, p, own[a:b].tolist(), own.tolist() if p == 0 else None, cut) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()), strict=True)],
                ["item_id", "version", "piece", "terms", "words", "cut"],
            )


@dataclass
class Index:
    """Postings by term (terms sorted; pieces sorted within), and the items' words."""

    terms: np.ndarray
    at: np.ndarray
    piece: np.ndarray
    share: np.ndarray
    #: Whether a term is set aside by the first bound, and each piece's score from such terms.
    common: np.ndarray
    rest: np.ndarray
    item: np.ndarray
    #: The words of every text by item and the text's hash, as an item may have several, and each piece's hash.
    words: dict[tuple[str, int], tuple[np.ndarray, int]]
    version: np.ndarray | None = None


def build_index(rows: list, common_share: float = SLACK) -> Index:
    """rows: item_id, version, piece, words, cut, and postings as (term, share)."""
    rows = sorted(rows, key=lambda r: (r.item_id, r.version, r.piece))
    term = np.array([p.term for r in rows for p in r.postings], dtype=np.int64).view(np.uint64)
    share = np.array([p.share for r in rows for p in r.postings])
    piece = np.repeat(np.arange(len(rows)), [len(r.postings) for r in rows])
    order = np.lexsort((piece, term))
    term, share, piece = term[order], share[order], piece[order]
    terms, at, df = np.unique(term, return_index=True, return_counts=True)
    common, rest = np.zeros(len(terms), dtype=bool), np.zeros(len(rows))
    for t in np.argsort(-df, kind="stable"):
        a, b = at[t], at[t] + df[t]
        if (rest[piece[a:b]] + share[a:b] <= common_share).all():
            common[t] = True
            rest[piece[a:b]] += share[a:b]
    words = {(r.item_id, r.version): (np.array(r.words, dtype=np.int64).view(np.uint64), r.cut) for r in rows if r.piece == 0}
    return Index(terms, np.append(at, len(term)), piece, share, common, rest, np.array([r.item_id for r in rows], dtype=object), words, np.array([r.version for r in rows]))


class Parts(Sequence):
    """Indexes that are built when they are asked for, so that the driver holds one at a time."""

    def __init__(self, rows: DataFrame | None, parts: list[int]):
        self.rows, self.parts = rows, parts

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> Index:
        part = self.parts[k]
        return build_index(self.rows.filter(F.col("part") == part).drop("uid", "part").collect())


def indexes(items: DataFrame, index_words: int = INDEX_WORDS) -> Parts:
    """One index for each `index_words` words of test items (item_id, text), with statistics over all items.

    Items with a null id, or without words, are left out; of several rows with one id, each is searched and
    verified under that id, and equal ones count once. Ids may be of any type that has a text.
    """
    own = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.xxhash64("text").alias("version")).distinct()
    pieces = own.mapInArrow(_pieces, "item_id string, version long, piece int, terms array<long>, words array<long>, cut int")
    pieces = pieces.withColumn("uid", F.xxhash64("item_id", "version", "piece", "terms"))
    n, words = pieces.agg(F.count("*"), F.sum(F.size("terms"))).first()
    if not n:
        return Parts(None, [])
    parts = -(-words // index_words)
    tf = pieces.select("uid", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("uid", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * n / words))
    scored = tf.join(df, "term").withColumn("gain", gain)
    own_score = scored.groupBy("uid").agg(F.sum("gain").alias("own"), F.collect_list(F.struct("term", "gain")).alias("gains"))
    posted = own_score.select("uid", F.transform("gains", lambda g: F.struct(g.term.alias("term"), (g.gain / F.col("own")).alias("share"))).alias("postings"))
    rows = pieces.drop("terms").join(posted, "uid").withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    rows = durable(rows)
    return Parts(rows, sorted(r.part for r in rows.select("part").distinct().collect()))


def block_max_wand(query: list[int], index: Index, threshold: float) -> list[tuple[int, float]]:
    """All pieces whose score for the distinct query terms is the threshold or more, with the score."""
    lists = []
    for t in query:
        a, b = int(index.at[t]), int(index.at[t + 1])
        piece, share = index.piece[a:b], index.share[a:b]
        blocks = [(int(piece[min(x + BLOCK, b - a) - 1]), float(share[x : x + BLOCK].max())) for x in range(0, b - a, BLOCK)]
        lists.append([piece.tolist(), share.tolist(), max(m for _, m in blocks), blocks, 0])
    found, eps = [], 1e-9
    live = [x for x in lists if x[0]]
    while live:
        live.sort(key=lambda x: x[0][x[4]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(live):
            bound += x[2]
            if bound >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        doc = live[pivot][0][live[pivot][4]]
        while pivot + 1 < len(live) and live[pivot + 1][0][live[pivot + 1][4]] == doc:
            pivot += 1
        # The blocks that doc falls in bound its score, and that of every piece up to the nearest block end.
        tight, until = 0.0, None
        for x in live[: pivot + 1]:
            last, most = next(((last, most) for last, most in x[3] if last >= doc), (None, 0.0))
            tight += most
            if last is not None:
                until = last if until is None else min(until, last)
        if tight >= threshold - eps:
            if live[0][0][live[0][4]] == doc:
                score = sum(x[1][x[4]] for x in live[: pivot + 1])
                if score >= threshold - eps:
                    found.append((doc, score))
                to = doc + 1
            else:
                to = doc
        else:
            to = (until if until is not None else doc) + 1
            if pivot + 1 < len(live):
                to = min(to, live[pivot + 1][0][live[pivot + 1][4]])
            to = max(to, doc + 1)
        for x in live[: pivot + 1]:
            x[4] += int(np.searchsorted(x[0][x[4] :], to))
        live = [x for x in live if x[4] < len(x[0])]
    return found


def passages_above(code: np.ndarray, counts: np.ndarray, index: Index, threshold: float) -> dict[int, dict[int, float]]:
    """Pieces found and their best score, by row. code: the index's term at each word, or -1."""
    row = owners(counts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    steps = np.maximum(-(-counts // STEP), 1)
    first_step = np.cumsum(steps) - steps
    step = first_step[row] + place // STEP
    rare = np.flatnonzero((code >= 0) & ~np.append(index.common, True)[code])
    key = np.unique(step[rare] * len(index.terms) + code[rare])
    s, t = key // len(index.terms), key % len(index.terms)
    length = index.at[t + 1] - index.at[t]
    post = np.repeat(index.at[t] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    cell, back = np.unique(np.repeat(s, length) * len(index.item) + index.piece[post], return_inverse=True)
    score = np.bincount(back, index.share[post], minlength=len(cell))
    # A passage is a step and the next one of the same row.
    owner = np.repeat(np.arange(len(counts)), steps)
    at = np.searchsorted(cell, cell + len(index.item))
    follows = (at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == cell + len(index.item)) if len(cell) else np.zeros(0, dtype=bool)
    here = cell // max(len(index.item), 1)
    same = np.zeros(len(cell), dtype=bool)
    inside = here + 1 < len(owner)
    same[inside] = owner[here[inside]] == owner[here[inside] + 1]
    both = score + np.where(follows & same, score[np.minimum(at, max(len(cell) - 1, 0))] if len(cell) else 0, 0)
    need = threshold - index.rest[cell % max(len(index.item), 1)] - 1e-9
    # Where the step before has none of the piece's rare terms, the passage that begins there has no cell of its own.
    back_at = np.searchsorted(cell, cell - len(index.item))
    alone = np.ones(len(cell), dtype=bool)
    if len(cell):
        alone = cell[np.minimum(back_at, len(cell) - 1)] != cell - len(index.item)
    alone &= (here > 0) & (owner[np.maximum(here - 1, 0)] == owner[here])
    hit = np.unique(np.concatenate([here[both >= need], here[alone & (score >= need)] - 1]))
    found: dict[int, dict[int, float]] = defaultdict(dict)
    bounds = np.searchsorted(step, np.arange(len(owner) + 1))
    for h in hit.tolist():
        end = h + 2 if h + 1 < len(owner) and owner[h + 1] == owner[h] else h + 1
        query = np.unique(code[bounds[h] : bounds[end]])
        for piece, value in block_max_wand(query[query >= 0].tolist(), index, threshold):
            best = found[int(owner[h])]
            best[piece] = max(best.get(piece, 0.0), value)
    return found


def overlaps(item: tuple[np.ndarray, int], doc: np.ndarray) -> tuple[float, float]:
    """Share of the phrases of question and answer that stand in the document. Shorter parts are one phrase."""
    words, cut = item
    out = []
    for part in (words[:cut], words[cut:]):
        k = min(PHRASE, len(part))
        if not k:
            out.append(1.0)
            continue
        mine = np.unique(windows(part, np.array([len(part)]), k)[0])
        theirs = windows(doc, np.array([len(doc)]), k)[0]
        out.append(float(np.isin(mine, theirs).mean()))
    return out[0], out[1]


def _finder(given: dict, threshold: float, overlap: float) -> Callable[[pa.RecordBatch], list[list[tuple]]]:
    index = Index(**given)

    def find(batch: pa.RecordBatch) -> list[list[tuple]]:
        """For each row, its items as (item_id, score, question share, answer share)."""
        h, counts, _ = term_hashes(text_of(batch))
        at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
        code = np.where(index.terms[at] == h, at, -1)
        out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
        start = np.cumsum(counts) - counts
        for row, pieces in passages_above(code, counts, index, threshold).items():
            best: dict[tuple[str, int], float] = {}
            for piece, value in pieces.items():
                item = index.item[piece], int(index.version[piece])
                best[item] = max(best.get(item, 0.0), value)
            hits: dict[str, tuple] = {}
            own = h[start[row] : start[row] + counts[row]]
            for item, value in sorted(best.items()):
                question, answer = overlaps(index.words[item], own)
                if question >= overlap and answer >= overlap:
                    hits[item[0]] = max(hits.get(item[0], ()), (min(value, 1.0), question, answer))
            out[row] = [(item, *hit) for item, hit in sorted(hits.items())]
        return out

    return find


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs with `leaks`: an array of the test items that a document repeats, with score, question and answer share,
    by item_id.

    Null and empty texts, and all texts if there are no items, have an empty array. Very long texts are read whole, a
    slice of rows at a time. Every row is judged by itself, so repeated rows get the same answer. An item counts once,
    with its best score; of equal scores the greater shares stand. docs: text and any other columns, which stay, but for
    a column named `leaks`, which is replaced.
    """
    kind = "array<struct<item_id: string, score: double, question: double, answer: double>>"
    spark = docs.sparkSession
    out = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() != "leaks"])
    parts, names = indexes(items), []
    for p, index in enumerate(parts):
        shared = spark.sparkContext.broadcast(vars(index))  # about INDEX_WORDS words of test items
        del index

        def make(shared=shared) -> Callable[[pa.RecordBatch], list[pa.Array]]:
            find = _finder(shared.value, threshold, overlap)
            struct = pa.struct([("item_id", pa.string()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
            return lambda batch: [pa.array([[dict(zip(struct.names, x, strict=True)) for x in r] for r in find(batch)], pa.list_(struct))]

        names.append(free_name(out, f"leaks_{p}"))
        out = annotate(out, make, f"`{names[-1]}` {kind}", 1 << 20)
    own = dict(items.dtypes)["item_id"]
    final = kind.replace("item_id: string", f"item_id: {own}")
    if not parts:
        return out.withColumn("leaks", F.from_json(F.lit("[]"), final))
    return out.withColumn("leaks", F.array_sort(F.concat(*names).cast(final))).drop(*names)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that it repeats; shares and scores to six places."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    shown = {"score": "score", "question_overlap": "question", "answer_overlap": "answer"}
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", *[F.round(F.col(f"leak.{c}"), 6).alias(n) for n, c in shown.items()])


_WORDS = r"list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: trim(lower(x), '.,;:!?\"''()[]{}*$%&#|<>'))"
#: BM25 of every piece against every passage, by a plain join, and the overlaps of what reaches the threshold.
OP9_SQL = f"""
WITH item AS (
  SELECT *, len(terms) AS n, CAST(ceil(len(terms) / {PIECE}.0) AS BIGINT) AS parts, row_number() OVER () AS v
  FROM (SELECT item_id, text, {_WORDS} AS terms, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS raw
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) WHERE len(terms) > 0
), cut AS (
  SELECT *, coalesce(list_max(list_filter(range(1, n), lambda i: regexp_matches(raw[i], '[.!?]$'))), greatest(1, n - greatest(1, n // 4))) AS c FROM item
), tf AS (
  SELECT v, p, term, count(*) AS tf FROM (
    SELECT v, ((i + 1) * parts - 1) // n AS p, terms[i + 1] AS term FROM (SELECT *, unnest(range(n)) AS i FROM item)
  ) GROUP BY ALL
), dl AS (SELECT v, p, sum(tf) AS dl FROM tf GROUP BY ALL
), total AS (SELECT count(*) AS pieces, sum(dl) AS words FROM dl
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), gain AS (
  SELECT v, p, term, ln(1 + (pieces - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl * pieces / words)) AS gain
  FROM tf JOIN dl USING (v, p) JOIN df USING (term) CROSS JOIN total
), share AS (SELECT v, p, term, gain / sum(gain) OVER (PARTITION BY v, p) AS share FROM gain
), doc AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS terms FROM documents WHERE text IS NOT NULL
), step AS (
  SELECT DISTINCT d, i // {STEP} AS s, term FROM (SELECT d, unnest(range(len(terms))) AS i, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM df)
), passage AS (SELECT d, s, term FROM step UNION SELECT d, s - 1, term FROM step WHERE s > 0
), best AS (
  SELECT d, v, max(score) AS score
  FROM (SELECT d, s, v, p, sum(share) AS score FROM passage JOIN share USING (term) GROUP BY ALL HAVING sum(share) >= {THRESHOLD} - 1e-9) GROUP BY d, v
), part AS (SELECT v, 0 AS answer, terms[1:c] AS w FROM cut UNION ALL SELECT v, 1, terms[c + 1:n] FROM cut
), phrases AS (
  SELECT v, answer, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS grams
  FROM (SELECT *, least({PHRASE}, len(w)) AS k FROM part)
), shown AS (
  SELECT b.d, b.v, b.score, answer,
         CASE WHEN k = 0 THEN 1.0 ELSE len(list_intersect(grams, list_transform(range(1, len(terms) - k + 2), lambda i: array_to_string(terms[i:i + k - 1], ' ')))) / len(grams) END AS overlap
  FROM best b JOIN phrases USING (v) JOIN doc USING (d)
), hit AS (
  SELECT d, item_id, least(score, 1.0) AS score, max(overlap) FILTER (WHERE answer = 0) AS q, max(overlap) FILTER (WHERE answer = 1) AS a
  FROM shown JOIN item USING (v) GROUP BY d, v, item_id, score HAVING min(overlap) >= {OVERLAP}
), top AS (SELECT d, item_id, max(struct_pack(score := score, q := q, a := a)) AS x FROM hit GROUP BY d, item_id)
SELECT doc_id, item_id, round(x.score, 6) AS score, round(x.q, 6) AS question_overlap, round(x.a, 6) AS answer_overlap FROM top JOIN doc USING (d)
"""
