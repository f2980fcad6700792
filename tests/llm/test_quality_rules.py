import re
from collections import Counter
from math import comb

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import quality_rules as qr

from .edges import documents, labels, no_documents


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_base_features_and_awkward_rows(spark):
    docs = documents(spark)
    got = qr.apply_rules(docs, labels(spark)).collect()
    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert qr.apply_rules(no_documents(spark), labels(spark, [])).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#|", max_size=60), min_size=1, max_size=5))
def test_features_of_random_texts(spark, texts):
    got = qr.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (7, 7, 0.5), (400, 3, 0.02), (400, 390, 0.02)):
        assert abs(qr.binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_trials_go_from_the_cheapest_on():
    good, bad = [0] * (qr.STEPS + 1), [0] * (qr.STEPS + 1)
    good[0], good[30], bad[10], bad[40] = 90, 10, 50, 50
    other = [100, *[0] * qr.STEPS]
    trials = qr.order_trials({"symbols": good, "upper_case": other}, {"symbols": bad, "upper_case": other})
    assert trials[0] == ("symbols", 39) and trials[1] == ("symbols", 9)  # 50 % bad for none, then 50 % for 10 %
    assert qr.order_trials({"symbols": good}, {"symbols": good}) == []


def test_sequences_stop_at_the_first_failure_and_hand_on_their_level():
    first_fails = {0: [100, 0, 900], 1: [0, 0, 300]}
    assert qr.choose(first_fails, 0.02, 0.05) == {0: 0, 1: 2}
    # 170 documents without a loss prove 2 % at the level 0.05 / 1.5 or so, but not at 0.05 / 2.
    assert 0.025 < qr.binomial_tail(0, 170, 0.02) < 0.05
    assert qr.choose({0: [0, 170], 1: [1000, 0]}, 0.02, 0.05) == {0: 0, 1: 0}
    assert qr.choose({0: [0, 170], 1: [0, 300]}, 0.02, 0.05) == {0: 1, 1: 1}
    assert qr.choose({0: [0]}, 0.02, 0.05) == {0: 0}


def population(n, seed):
    """Documents of two lengths, of which a tenth are junk: signs in every word; a few good ones have some signs."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad, some = rng.random() < 0.1, rng.random() < 0.01
        words = [f"w{x}" + ("##" if bad or (some and j % 9 == 0) else "") for j, x in enumerate(rng.integers(0, 5000, int(rng.choice([80, 200]))))]
        rows.append((seed * 1_000_000 + i, " ".join(words), int(not bad)))
    return rows


def test_kept_is_that_of_a_plain_version_and_the_loss_on_unused_labels_is_bounded(spark):
    known, fresh = population(2500, 1), population(1500, 2)
    docs = spark.createDataFrame(known + fresh, "doc_id long, text string, quality int")
    labels = spark.createDataFrame(known, "doc_id long, text string, quality int").select("doc_id", "quality")
    got = {r.doc_id: r for r in qr.apply_rules(docs.select("doc_id", "text"), labels).collect()}
    steps = {r.doc_id: {k: r[k] for k in qr.RULES} | {"s": r.s, "p": r.p, "q": r.quality} for r in qr.measure(docs).join(docs.select("doc_id", "quality"), "doc_id").select(
        "doc_id", "quality", qr.stratum().alias("s"), F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(3)).alias("p"), *[qr._step(r).alias(r) for r in qr.RULES]).collect()}
    cutoffs = {}
    for s in {x["s"] for x in steps.values()}:
        own = [steps[i] for i, _, _ in known if steps[i]["s"] == s]
        counts = [{r: [sum(x[r] == k for x in own if x["p"] == 0 and x["q"] == q) for k in range(qr.STEPS + 1)] for r in qr.RULES} for q in (1, 0)]
        held, now = [x for x in own if x["p"] and x["q"]], dict.fromkeys(qr.RULES, qr.STEPS)
        for rule, cutoff in qr.order_trials(*counts):
            then = now | {rule: cutoff}
            gone = sum(any(x[r] > c for r, c in then.items()) for x in held)
            if sum(comb(len(held), i) * 0.02**i * 0.98 ** (len(held) - i) for i in range(gone + 1)) > 0.05 / 2:
                break
            now = then
        cutoffs[s] = now
    assert any(c < qr.STEPS for now in cutoffs.values() for c in now.values())
    for i, r in got.items():
        x = steps[i]
        assert r.kept == (not r.base_failed and all(x[k] <= c for k, c in cutoffs[x["s"]].items())), i
    unused = [(got[i].kept, q) for i, _, q in fresh]
    assert sum(q and not k for k, q in unused) <= 0.02 * sum(q for _, q in unused)
    assert sum(not q and not k for k, q in unused) >= 0.95 * sum(not q for _, q in unused)


def test_rules_act_on_the_tables(spark):
    got = qr.op3_quality_rules(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r.n for r in got.filter("not base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n[0, False] >= 0.8 * (n[0, False] + n[0, True])
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
