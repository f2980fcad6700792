"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags words as begin, inside or outside of a secret, from the shape of a word, the kinds of its neighbours and
features of the whole file; Viterbi decoding gives the best tag sequence. It is trained on a bounded sample of windows
in which the patterns' own finds are the labels. What the patterns go by is then hidden from it in copies of these
windows: the keyword is replaced by a plain word, the value is drawn anew from other alphabets and lengths, or written
in groups; so it learns what secrets look like rather than the patterns, and finds them in other surroundings.

A word whose emissions favour "outside" by more than any transitions could make up is outside in every best sequence,
so only the stretches between such words are decoded: the result is that of decoding it all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, annotate, encode, free_name, owners, per_row, slices, split_words, table, text_of

# The base patterns, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "crf")

#: Every text in which some base pattern finds a secret matches one of these, in Java's syntax.
LIKELY = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", ACCESS.pattern, "[0-9a-f]{32}")

#: Documents that windows without a mark come from at most, and the most windows of either sort.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4096, 1024
REACH = 4
#: The alphabets and lengths of values that are drawn for altered copies of windows.
ALPHABETS = tuple(map("".join, ("0123456789abcdef", (DIGITS := "0123456789") + (UPPER := "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), DIGITS + UPPER + UPPER.lower(), DIGITS + UPPER + UPPER.lower() + "+/")))
LENGTHS = (12, 40)
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
EDGES = "\"'`,;:.()[]{}<>#*$%&!?"
SECRET_WORD = r"(?i)(pass(word|wd)|pwd|secret|token|api_?key|credential|bearer|private_?key|access_?key)"
#: Shape features of a word without the signs around it.
SHAPES = (
    r"^.{8,}$",
    r"^.{16,}$",
    r"^.{32,}$",
    r"[0-9]",
    r"[A-Z].*[0-9]|[0-9].*[A-Z]",
    r"[a-z].*[0-9]|[0-9].*[a-z]",
    r"[a-z].*[A-Z].*[0-9]|[0-9].*[a-z].*[A-Z]",
    r"^[0-9a-f]{16,}$",
    r"^[A-Za-z0-9+/_=-]{16,}$",
    r"^[A-Z0-9]{12,}$",
    r"^[0-9.+-]+$",
    r"@|://",
    r"[0-9].*[a-zA-Z].*[0-9].*[a-zA-Z].*[0-9]",
)
#: Kinds of neighbours.
KINDS_OF_WORD = (SECRET_WORD, r"^[\"']?[:=]+[\"']?$|[:=][\"']?$", r"^[\"']")
WIDTH = 1 + len(SHAPES) + 4 * len(KINDS_OF_WORD) + 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, each kind leftmost and non-overlapping, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def may_match(text: pa.Array) -> np.ndarray:
    """Texts that some base pattern may match; the others have no match."""
    hit = pc.match_substring_regex(text, r"(?i)password|passwd|secret|token|api_?key")
    for pattern in ("AKIA", "[0-9a-f]{32}"):
        hit = pc.or_(hit, pc.match_substring_regex(text, pattern))
    return np.asarray(hit)


def word_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shape features and kinds of each distinct word."""
    core = pc.utf8_trim(distinct, EDGES)
    shapes = [np.asarray(pc.match_substring_regex(core, p)) for p in SHAPES]
    kinds = [np.asarray(pc.match_substring_regex(distinct, p)) for p in KINDS_OF_WORD]
    return np.stack([np.ones(len(distinct), dtype=bool), *shapes], axis=1).astype(np.float32), np.stack(kinds, axis=1).astype(np.float32)


def file_features(kinds: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: whether it has secret words, whether it has assignments, whether over a twentieth has digits."""
    keys, signs, digits = per_row(kinds[:, 0], counts), per_row(kinds[:, 1], counts), per_row(shapes[:, 4], counts)
    return np.stack([keys > 0, signs > 0, 20 * digits > counts], axis=1).astype(np.float32)


def emissions(codes: np.ndarray, counts: np.ndarray, distinct: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of the three tags at each word: its own, plus what neighbours and file add. weights: WIDTH x 3."""
    shapes, kinds = word_features(distinct)
    s, k = shapes.shape[1], kinds.shape[1]
    at = np.cumsum([0, s, k, k, k, k])
    own = (shapes @ weights[: at[1]] + kinds @ weights[at[1] : at[2]])[codes]
    row = owners(counts)
    for step, a, b in ((1, at[2], at[3]), (2, at[3], at[4]), (-1, at[4], at[5])):
        near = (kinds @ weights[a:b])[codes]
        if step > 0:
            ok = row[step:] == row[:-step]
            own[step:][ok] += near[:-step][ok]
        else:
            ok = row[:-1] == row[1:]
            own[:-1][ok] += near[1:][ok]
    return own + (file_features(kinds[codes], shapes[codes], counts) @ weights[at[5] :])[row]


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags of one sequence."""
    return viterbi_each(scores, np.array([len(scores)]), transitions)


def viterbi_each(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags of many sequences, of `counts` words each (one at least): a step takes one word of all that reach it."""
    longest = np.argsort(-counts, kind="stable")
    first, length = (np.cumsum(counts) - counts)[longest], counts[longest]
    running = np.searchsorted(-length, -np.arange(int(length[0])))  # sequences with more words than that
    best, back = scores[first], np.zeros(scores.shape, dtype=np.int8)
    for t in range(1, int(length[0])):
        m = running[t]
        at = first[:m] + t
        ways = best[:m, :, None] + transitions
        back[at] = ways.argmax(axis=1)
        best[:m] = ways.max(axis=1) + scores[at]
    tag, tags = best.argmax(axis=1), np.zeros(len(scores), dtype=np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        m = running[t]
        at = first[:m] + t
        tags[at] = tag[:m]
        tag[:m] = back[at, tag[:m]]
    return tags


def in_a_run(scores: np.ndarray, row: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Words within some run that may score as much, tagged begin or inside throughout, as it does outside.

    A run gains at most the gains of its words and, for each transition, the best gain of any. The best run through a
    word is a difference of running sums, which fall so far between texts that no run goes over.
    """
    gain = (scores[:, 1:].max(axis=1) - scores[:, OUTSIDE]).astype(np.float64)
    others = np.delete(transitions.ravel().astype(np.float64), 3 * OUTSIDE + OUTSIDE)
    most = float(others.max() - transitions[OUTSIDE, OUTSIDE])
    step = gain + most  # k words have k + 1 transitions, up to two less at the ends of a text
    reach = np.bincount(row, np.abs(step))
    fall = np.cumsum(reach) + np.cumsum(np.append(0, reach[:-1])) if len(reach) else reach
    after = np.cumsum(step) - fall[row]
    through = np.maximum.accumulate(after[::-1])[::-1] - np.minimum.accumulate(after - step)
    return through + abs(most) >= -1e-4


def may_be_tagged(scores: np.ndarray, row: np.ndarray, transitions: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Words that some best sequence may tag begin or inside.

    Only words within a run that may pay are looked at. A tag y is out at a word if "outside" scores more there than y
    could gain by its transitions, whatever possible tags the neighbours have. Each round uses what the one before ruled
    out.
    """
    gain_in, gain_out = transitions - transitions[:, [OUTSIDE]], transitions - transitions[[OUTSIDE]]
    most = max(float(gain_in[:, y].max() + max(gain_out[y].max(), 0)) for y in (BEGIN, INSIDE))
    at = np.flatnonzero(scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= max(most, float(gain_out[1:].max()), 0) + 1e-4)
    at = at[in_a_run(scores, row, transitions)[at]]
    possible = np.zeros((len(scores) + 2, 3), dtype=bool)  # with a place before and after
    possible[:, OUTSIDE] = True
    possible[at + 1] = True
    inner = np.append(row, -1)
    first, last = at == 0, inner[at + 1] != row[at]
    first[at > 0] = row[at[at > 0] - 1] != row[at[at > 0]]
    for _ in range(rounds):
        keep = possible[at + 1]
        for y in (BEGIN, INSIDE):
            # At the ends of a text there is no transition.
            into = np.where(first, 0, np.where(possible[at], gain_in[:, y], -np.inf).max(axis=1))
            out_of = np.where(last, 0, np.where(possible[at + 2], gain_out[y], -np.inf).max(axis=1))
            keep[:, y] &= scores[at, OUTSIDE] - scores[at, y] <= into + out_of + 1e-4
        if (keep == possible[at + 1]).all():
            break
        possible[at + 1] = keep
    return possible[1:-1, 1:].any(axis=1)


def decode(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tags of every text: Viterbi over the stretches between words that are outside for certain."""
    tags = np.zeros(len(scores), dtype=np.int64)
    row = owners(counts)
    at = np.flatnonzero(may_be_tagged(scores, row, transitions))
    if not len(at):
        return tags
    starts = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
    sizes = np.diff(np.append(starts, len(at)))
    a, b = at[starts], at[starts + sizes - 1]
    pre = np.append(-1, row)[a] == row[a]
    post = np.append(row, -1)[b + 1] == row[b]
    s = scores[at]
    s[starts[pre]] += transitions[OUTSIDE]
    s[(starts + sizes - 1)[post]] += transitions[:, OUTSIDE]
    tags[at] = viterbi_each(s, sizes, transitions)
    return tags


def train(x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 0.02, settled: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the conditional likelihood of the tags, by gradient steps with momentum
    (Adam), until the likelihood of a window hardly changes. x: windows x length x WIDTH, y: tags, mask: 1 where a
    window has a word."""
    n, length, width = x.shape
    weights, trans = np.zeros((width, 3), dtype=np.float32), np.zeros((3, 3), dtype=np.float32)
    gold = np.eye(3, dtype=np.float32)[y] * mask[..., None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    flat = x.reshape(-1, width)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans)]
    before = np.inf
    for step in range(1, steps + 1):
        e = (flat @ weights).reshape(n, length, 3)
        # Forward and backward in log space; past the end of a window the state is carried along.
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            ways = fwd[:, t - 1, :, None] + trans
            top = ways.max(axis=1)
            moved = np.log(np.exp(ways - top[:, None]).sum(axis=1)) + top + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, moved, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            ways = (bwd[:, t + 1] + e[:, t + 1])[:, None] + trans
            top = ways.max(axis=2)
            moved = np.log(np.exp(ways - top[..., None]).sum(axis=2)) + top
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, moved, bwd[:, t + 1])
        z = fwd[:, -1].max(axis=1) + np.log(np.exp(fwd[:, -1] - fwd[:, -1].max(axis=1, keepdims=True)).sum(axis=1))
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pairs = np.exp(fwd[:, :-1, :, None] + trans + (bwd[:, 1:] + e[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = (flat.T @ (gold - p).reshape(-1, 3) / n - decay * weights / 10, (gold_pairs - pairs.sum(axis=(0, 1))) / n - decay * trans)
        for q, g, s in zip((weights, trans), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            q += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        if step % 10 == 0:
            loss = float((z.sum() - (e * gold).sum() - (trans * gold_pairs).sum()) / n)
            if abs(before - loss) < settled:
                break
            before = loss
    return weights, trans


def altered(words: list[str], tags: list[int]) -> list[tuple[list[str], list[int]]]:
    """Copies of a marked window in which what the patterns go by is hidden, always the same for the same words: without
    the keyword; with a value of another kind, with or without the keyword and quotes; with a value written in groups."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(" ".join(words)))
    cues = [j for j, w in enumerate(words) if not tags[j] and re.search(f"{SECRET_WORD}|{KINDS_OF_WORD[1]}", w)]
    plain = [w for j, w in enumerate(words) if not tags[j] and j not in cues and not re.search("[0-9]", w)] or ["the"]

    def value() -> str:
        letters = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
        return "".join(letters[int(k)] for k in rng.integers(len(letters), size=int(rng.integers(*LENGTHS))))

    def copy(hide: bool, new: str, bare: bool = False) -> tuple[list[str], list[int]]:
        out: list[str] = []
        own: list[int] = []
        for j, (w, tag) in enumerate(zip(words, tags, strict=True)):
            if not tag:
                out.append(plain[int(rng.integers(len(plain)))] if hide and j in cues else w)
                own.append(tag)
                continue
            head = re.match(r"(?:[^:=]*[:=]+)?[\"']?", w)
            lead = re.sub(r"^[^:=]*[:=]+", "", head[0]) if hide else head[0]
            rest = w[head.end() :]
            core = rest.rstrip(EDGES)
            tail = rest[len(core) :]
            if new == "value" and bare:
                lead, tail = lead.rstrip("\"'"), tail.lstrip("\"'")
            parts = [core]
            if new:
                core = value()
                size = int(rng.integers(8, 13)) if new == "groups" else len(core)
                parts = [core[k : k + size] for k in range(0, len(core), size)]
                if len(parts) > 1 and len(parts[-1]) < 8:
                    parts[-2:] = ["".join(parts[-2:])]
            parts[0] = lead + parts[0]
            parts[-1] += tail
            out += parts
            own += [tag, *[INSIDE] * (len(parts) - 1)]
        return out[: 2 * REACH + 1], own[: 2 * REACH + 1]

    return [copy(True, ""), copy(bool(rng.integers(2)), "value", bool(rng.integers(2))), copy(False, "groups")]


def window_features(words: list[list[str]], files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of windows of words, padded to one length, and the mask."""
    length = 2 * REACH + 1
    codes, distinct = encode(pa.array([w for ws in words for w in ws], pa.large_string()))
    shapes, kinds = word_features(distinct)
    s, k = shapes.shape[1], kinds.shape[1]
    x, mask = np.zeros((len(words), length, WIDTH), dtype=np.float32), np.zeros((len(words), length), dtype=np.float32)
    at = 0
    for i, ws in enumerate(words):
        c, n = codes[at : at + len(ws)], len(ws)
        at += n
        x[i, :n, :s], x[i, :n, s : s + k] = shapes[c], kinds[c]
        x[i, 1:n, s + k : s + 2 * k] = kinds[c[:-1]]
        x[i, 2:n, s + 2 * k : s + 3 * k] = kinds[c[:-2]]
        x[i, : n - 1, s + 3 * k : s + 4 * k] = kinds[c[1:]]
        x[i, :n, s + 4 * k :] = files[i]
        mask[i, :n] = 1
    return x, mask


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: windows around the words that the patterns mark, one around a long word with digits that they don't
    mark, and one anywhere."""
    for batch in slices(batches, "text", 1 << 20):
        text = text_of(batch)
        words, counts = split_words(text)
        codes, distinct = encode(words)
        shapes, kinds = word_features(distinct)
        files = file_features(kinds[codes], shapes[codes], counts)
        hit = may_match(text)
        out: list[tuple] = []
        for i in range(batch.num_rows):
            if not counts[i]:
                continue
            s = text[i].as_py()
            spans = [m.span(2) for m in ASSIGN.finditer(s) if len(m[2]) >= ASSIGN_LEAST] + [(a, b) for a, k, b in base_spans(s) if k] if hit[i] else []
            places = [m.span() for m in re.finditer(WORD, s)]
            tags = [OUTSIDE] * len(places)
            for a, b in sorted(spans):
                inside = [j for j, (c, d) in enumerate(places) if c < b and d > a]
                for j in inside:
                    tags[j] = BEGIN if j == inside[0] else INSIDE
            marks = [j for j, t in enumerate(tags) if t == BEGIN]
            odd = [j for j, (c, d) in enumerate(places) if d - c >= 8 and not tags[j] and re.search("[0-9]", s[c:d])]
            spots = {len(s) * 2654435761 % len(places), *odd[len(s) % max(1, len(odd)) :][:1]}
            for j in [*marks, *sorted(spots.difference(marks))]:
                a, b = max(0, j - REACH), min(len(places), j + REACH + 1)
                out.append(([s[c:d] for c, d in places[a:b]], tags[a:b], files[i].tolist(), int(j in marks)))
        if out:
            kinds_of = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_of, strict=True)], ["words", "tags", "file", "marked"])


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and transitions from at most `windows` windows of either sort, those of the least hashes: marked ones out
    of all documents, with three altered copies each, others out of `sample` documents of the least id hashes. None if
    the patterns find nothing anywhere; then the patterns alone work. Repeated rows give equal windows, each counting."""

    def least(rows: DataFrame, marked: int) -> list:
        found = rows.select("text").mapInArrow(_windows, "words array<string>, tags array<int>, file array<float>, marked int").filter(F.col("marked") == marked)
        return found.orderBy(F.md5(F.array_join("words", " ").cast("binary")), "words", "tags", "file").limit(windows).collect()

    likely = F.lit(False)
    for pattern in LIKELY:
        likely = likely | F.col("text").rlike(pattern)
    marked = least(docs.filter(likely), 1)
    if not marked:
        return None
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    plain = least(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), 0)  # at most `sample` ids
    chosen = [(w, t, r.file) for r in marked for w, t in [(r.words, r.tags), *altered(r.words, r.tags)]] + [(r.words, r.tags, r.file) for r in plain]
    # What the patterns mark is the rule in files with keywords and assignments, so copies must do without these, too.
    files = np.array([f for *_, f in chosen], dtype=np.float32)
    files[1 : 4 * len(marked) : 4, :2] = 0
    x, mask = window_features([w for w, _, _ in chosen], files)
    y = np.zeros(mask.shape, dtype=np.int64)
    for i, (_, tags, _) in enumerate(chosen):
        y[i, : len(tags)] = tags
    return train(x, y, mask)


def _spans(model: tuple[np.ndarray, np.ndarray] | None) -> Callable[[pa.RecordBatch], list[list[tuple[int, int, int]]]]:
    def find(batch: pa.RecordBatch) -> list[list[tuple[int, int, int]]]:
        text = text_of(batch)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero(may_match(text)).tolist():
            out[i] = base_spans(text[i].as_py())
        if not model:
            return out
        words, counts = split_words(text)
        codes, distinct = encode(words)
        tags = decode(emissions(codes, counts, distinct, model[0]), counts, model[1])
        start = np.cumsum(counts) - counts
        tagged = np.flatnonzero(tags)
        texts, ends = np.unique(owners(counts)[tagged], return_index=True)
        for i, words_of in zip(texts.tolist(), np.split(tagged, ends)[1:], strict=True):
            s = text[i].as_py()
            places = [m.span() for m in re.finditer(WORD, s)]
            base = list(out[i])
            own = (words_of - start[i]).tolist()
            runs: list[list[int]] = []
            for j in own:
                if tags[start[i] + j] == INSIDE and runs and runs[-1][-1] == j - 1:
                    runs[-1].append(j)
                else:
                    runs.append([j])
            for run in runs:
                a, b = places[run[0]][0], places[run[-1]][1]
                while a < b and s[a] in EDGES:
                    a += 1
                while a < b and s[b - 1] in EDGES:
                    b -= 1
                key = re.match(r"[^:=]*[:=]+[\"']?(?=.)", s[a:b], re.S)
                a += key.end() if key else 0
                if a < b and not any(c < b and d > a for c, _, d in base):
                    out[i].append((a, 3, b))
            out[i].sort()
        return out

    return find


def find_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """docs with `secrets`: an array of kind, start and end (code points, end exclusive) by start and kind.

    Null and empty texts have an empty array; very long ones are read whole. Spans of the field that touch a pattern's
    span are left out; of equally good tag sequences the one with the lower tags is taken, so reruns agree. Other columns
    stay, but for one named `secrets`, which is replaced; each row is judged by itself, so repeated rows agree.
    """

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        find = _spans(model)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda batch: [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in r] for r in find(batch)], kind)]

    return annotate(docs, make, "secrets array<struct<kind: string, start: int, end: int>>", 1 << 20)


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by the mark; overlapping spans are one. A null text stays null."""

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        find = _spans(model)

        def clean(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(find(batch)):
                if spans:
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [texts[i][end:a], mark]
                        end = max(end, b)
                    texts[i] = "".join([*parts, texts[i][end:]])
            return [pa.array(texts, pa.string())]

        return clean

    clean = free_name(docs, "clean_text")
    return annotate(docs, make, f"`{clean}` string", 1 << 20).withColumn("text", F.col(clean)).drop(clean)


def op6_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs))

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(F.filter("secrets", lambda s: s.kind != "crf")), 256).alias("base_sha256"),
        digest(F.col("secrets")).alias("spans"),
    )
