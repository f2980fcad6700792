"""Quality rules with risk-controlled thresholds.

Each rule turns a document into a badness in a fixed range, and rejects what lies above its cutoff. A third of the
labels, by hash, orders the trials of each stratum: from no cutoff at all on, the next trial tightens the one rule that
catches most of the bad documents for the good ones it costs. The others, the holdout, decide how far along that order
the cutoffs may go: a trial is accepted while the exact binomial test rejects "more
than `alpha` of the stratum's good documents are rejected by any rule", and the first failure ends the stratum.

An order fixed beforehand needs no correction within a stratum. Across strata, each starts with an equal part of
`delta`; a stratum whose trials are all accepted hands its part on to those still open (Holm's step, for sequences). So
with probability 1 - delta, no stratum loses more than alpha of its good documents to the rules. Where too few labels
exist to prove anything, no rule acts in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, encode, owners, per_row, slices, split_words, table, text_of, windows

MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
#: Strata are bands of document length, so their number is fixed whatever the data hold.
BANDS = (150, 400, 1000)
#: Rule: badness expression over the features, and its range.
RULES = {
    "symbols": ("n_symbols / word_chars", 0.0, 1.0),
    "repeated_lines": ("n_dup_lines / n_lines", 0.0, 1.0),
    "repeated_words": ("n_repeat_words / n_words", 0.0, 1.0),
    "upper_case": ("n_upper / n_words", 0.0, 1.0),
    "word_length": ("word_chars / n_words", 3.0, 23.0),
    "few_distinct": ("1 - n_distinct / n_words", 0.0, 1.0),
}
STEPS = 50
#: A trial must raise the share of bad documents by this many times the share of good ones.
LIFT = 3.0
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_distinct long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        text = text_of(batch)
        words, counts = split_words(text)
        codes, distinct = encode(words)
        row = owners(counts)
        length = np.asarray(pc.utf8_length(distinct)).astype(np.int64)[codes]
        upper = np.asarray(pc.utf8_is_upper(distinct)).astype(np.int64)[codes]

        window, n = windows(codes, counts, 3)
        key = window ^ (owners(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(n, counts))
        edge = np.zeros(len(codes) + 1, dtype=np.int64)
        again = starts[times[inverse] > 1]
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 3, -1)
        covered = (np.cumsum(edge)[:-1] > 0).astype(np.int64)

        lists = pc.split_pattern(text, "\n")
        lines, per_text = lists.flatten(), np.diff(np.asarray(lists.offsets)).astype(np.int64)
        worded = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0))
        line_row = owners(per_text)[worded]
        line_code, _ = encode(lines.filter(pa.array(worded)))
        n_lines = np.bincount(line_row, minlength=len(text))
        unique_lines = np.unique((line_row << 32) | line_code) >> 32
        unique_words = np.unique((row << 32) | codes) >> 32
        found = {
            "n_words": counts,
            "word_chars": per_row(length, counts),
            "n_symbols": np.asarray(pc.count_substring_regex(text, SYMBOLS)).astype(np.int64),
            "n_dup_lines": n_lines - np.bincount(unique_lines, minlength=len(text)),
            "n_repeat_words": per_row(covered, counts),
            "n_lines": n_lines,
            "n_upper": per_row(upper, counts),
            "n_distinct": np.bincount(unique_words, minlength=len(text)),
        }
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every whole text. A null or empty text has zeros; repeated rows stay repeated."""
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, {FEATURES}")


def stratum() -> Column:
    """The length band of a document."""
    return sum((F.col("n_words") >= b).cast("int") for b in BANDS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _step(rule: str) -> Column:
    """The number of candidate cutoffs that lie below the badness; candidate i is low + i * (high - low) / STEPS."""
    what, low, high = RULES[rule]
    bad = F.coalesce(F.when(F.col("n_words") > 0, F.expr(what)), F.lit(low))
    return F.least(F.lit(STEPS), F.greatest(F.lit(0), F.ceil((bad - low) / ((high - low) / STEPS)))).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p). Terms are added downwards from k in blocks until they no longer count."""
    if k >= n:
        return 1.0
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, at = 1.0, 1.0, k
    while at > 0:
        i = np.arange(at, max(at - (1 << 16), 0), -1, dtype=np.float64)
        with np.errstate(over="ignore"):
            terms = term * np.cumprod(i / (n - i + 1) * ((1 - p) / p))
        total, term, at = total + float(terms.sum()), float(terms[-1]), at - len(i)
        if not math.isfinite(total) or (at < p * n and term < 1e-17 * total):
            break
    return min(1.0, math.exp(log_top + math.log(total))) if math.isfinite(total) else 1.0


def order_trials(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, int]]:
    """(rule, cutoff) in the order of trial, from counts of good and bad documents by rule and step.

    A cutoff i rejects steps above i. Of all next cutoffs of all rules, the one that catches most for its cost is
    taken, as long as that is `LIFT` or more; ties go to the first rule, then to the more lenient cutoff.
    """
    at = {rule: STEPS for rule in RULES}
    n_good, n_bad = (max(1, max(map(sum, side.values()), default=0)) for side in (good, bad))
    out = []
    while True:
        best = None
        for rule, now in at.items():
            lost = caught = 0
            for cutoff in range(now - 1, -1, -1):
                lost += good.get(rule, [0] * (STEPS + 1))[cutoff + 1]
                caught += bad.get(rule, [0] * (STEPS + 1))[cutoff + 1]
                lift = (caught / n_bad) / ((lost + 0.5) / n_good)
                if caught and lift >= LIFT and (best is None or lift > best[0]):
                    best = (lift, rule, cutoff)
        if best is None:
            return out
        out.append(best[1:])
        at[best[1]] = best[2]


def first_rejected(trials: list[tuple[str, int]], rule: str) -> list[int]:
    """For each step of the rule, the number (from 1) of the first trial that rejects it; one past the last if none."""
    return [next((i for i, (r, cutoff) in enumerate(trials, 1) if r == rule and step > cutoff), len(trials) + 1) for step in range(STEPS + 1)]


def choose(lost: dict[int, list[int]], alpha: float, delta: float) -> dict[int, int]:
    """The number of accepted trials by stratum. lost: for each stratum, how many good holdout documents fall at each
    trial, from 1, and last those that never do."""
    level = {s: delta / len(lost) for s in lost}
    done = {s: 0 for s in lost}
    open_, moved = set(lost), True
    while moved:
        moved = False
        for s in sorted(open_):
            n = sum(lost[s])
            while done[s] < len(lost[s]) - 1 and n:
                gone = sum(lost[s][: done[s] + 1])
                if gone >= alpha * n or binomial_tail(gone, n, alpha) > level[s]:
                    break
                done[s] += 1
            if n and done[s] == len(lost[s]) - 1:  # every trial is accepted: the others share the level
                open_.discard(s)
                for t in open_:
                    level[t] += level[s] / len(open_)
                moved = bool(open_)
                break
    return done


def _at(columns: dict[int, list[int]], of: Column) -> Column:
    """Of a stratum's list, the element at a place counted from 0."""
    lists = F.coalesce(*[F.when(stratum() == s, F.array(*map(F.lit, x))) for s, x in sorted(columns.items())], F.lit(None).cast("array<int>"))
    return F.get(lists, of)


def fall(trials: dict[int, list[tuple[str, int]]]) -> dict[str, Column]:
    """For each rule, the first of the stratum's trials that rejects the document."""
    return {rule: _at({s: first_rejected(t, rule) for s, t in trials.items()}, _step(rule)) for rule in RULES}


def calibrate(features: DataFrame, labels: DataFrame, alpha: float, delta: float) -> tuple[dict[int, list[tuple[str, int]]], dict[int, int]]:
    """The trials of each stratum in order, and how many of them hold.

    Only documents that pass the base rules count. What reaches the driver has bounds: a histogram of at most
    2 * bands * rules * (STEPS + 1) cells, and one of bands * (rules * STEPS + 1). A doc_id labelled both good and bad
    counts as good.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.withColumn("part", F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(3)))
    labelled = durable(features.filter(~base_failed()).join(known, "doc_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _step(r).alias("step")) for r in RULES]))
    cells = labelled.filter("part = 0").select(stratum().alias("stratum"), "quality", steps.alias("cell")).groupBy("stratum", "quality", "cell.rule", "cell.step").agg(F.count("*").alias("n")).collect()
    by: dict[tuple[int, int], dict[str, list[int]]] = {}
    for c in cells:
        by.setdefault((c.stratum, int(c.quality > 0)), {}).setdefault(c.rule, [0] * (STEPS + 1))[c.step] += c.n
    trials = {s: order_trials(by.get((s, 1), {}), by.get((s, 0), {})) for s in range(len(BANDS) + 1)}
    trials = {s: t for s, t in trials.items() if t}
    if not trials:
        return {}, {}
    good = labelled.filter("part > 0 and quality = 1").select(stratum().alias("stratum"), F.least(*fall(trials).values()).alias("falls"))
    lost = {s: [0] * (len(t) + 1) for s, t in trials.items()}
    for c in good.filter("falls is not null").groupBy("stratum", "falls").agg(F.count("*").alias("n")).collect():
        lost[c.stratum][c.falls - 1] = c.n
    return trials, choose(lost, alpha, delta)


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Every document with its features, the base verdict, the rule that rejects it (`rejected_by`) and `kept`.

    Null or empty texts and texts below 50 words fail the base rules; without labels no rule is ever proven, so only
    the base rules act. Very long texts are measured whole. Repeated rows get equal verdicts; rows with a null doc_id
    are judged but never labelled. Of several rules that reject a document, the one whose trial came first is named (of
    equal ones, the first in RULES). Extra columns of docs and labels are ignored, whatever their names.
    """
    features = durable(measure(docs))
    trials, accepted = calibrate(features, labels.select("doc_id", "quality"), alpha, delta)
    held = {s: t[: accepted[s]] for s, t in trials.items() if accepted[s]}
    by = F.lit(None).cast("string")
    if held:
        first = fall(held)
        never = _at({s: [len(t) + 1] for s, t in held.items()}, F.lit(0))
        least = F.least(*first.values())
        by = F.when(least < never, F.coalesce(*[F.when(c == least, F.lit(r)) for r, c in first.items()]))
    return features.withColumn("base_failed", base_failed()).withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
