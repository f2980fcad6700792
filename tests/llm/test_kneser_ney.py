import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lexloom.llm import kneser_ney as kn

from .edges import documents, no_documents


def plain_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def plain_model(texts):
    """p(w | v) of the interpolated modified model, and the counts of tokens."""
    pairs, words = Counter(), Counter()
    for t in texts:
        before = "<s>"
        for w in plain_tokens(t):
            pairs[before, w] += 1
            words[w] += 1
            before = w
    left, context, classes = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), n in pairs.items():
        context[v] += n
        classes[v][min(n, 3) - 1] += 1
    d = kn.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    e = kn.discounts([sum(n == k for n in left.values()) for k in (1, 2, 3, 4)])

    rest = sum(e[min(n, 3)] for n in left.values()) / max(len(pairs), 1) / (len(words) + 1)

    def single(w):
        return max(left[w] - e[min(left[w], 3)], 0) / len(pairs) + rest

    def p(v, w):
        if not context[v]:
            return single(w)
        n = pairs[v, w]
        return max(n - d[min(n, 3)], 0) / context[v] + sum(a * b for a, b in zip(d[1:], classes[v], strict=True)) / context[v] * single(w)

    return p, words


@pytest.mark.parametrize("shard", [3_000_000, 40])
def test_scores_equal_the_plain_model(spark, small_dir, monkeypatch, shard):
    monkeypatch.setattr(kn, "SHARD_TOKENS", shard * 100 if shard == 40 else shard)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    train = docs.filter("doc_id % 5 <> 1")
    model = kn.count(train)
    assert model.shards == 1 or shard == 40
    p, words = plain_model([r.text for r in train.collect()])
    got = {r.doc_id: r for r in kn.score(docs, model).collect()}
    total, kinds = sum(words.values()), len(words)
    for doc_id, text in docs.collect():
        tokens, before, want = plain_tokens(text), "<s>", 0.0
        for w in tokens:
            want += math.log10(p(before, w))
            before = w
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), total)
        assert math.isclose(r.score, want, rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens), rel_tol=1e-9)


def plain_trigrams(texts):
    """p(w | u, v) of the interpolated modified model of order 3."""
    top, raw = Counter(), Counter()
    for t in texts:
        a, b = "<s>", "<s>"
        for w in plain_tokens(t):
            top[a, b, w] += 1
            raw[b, w] += 1
            a, b = b, w
    distinct = Counter((v, w) for _, v, w in top)
    middle = {(v, w): raw[v, w] if v == "<s>" else n for (v, w), n in distinct.items()}
    left = Counter(w for _, w in middle)
    ds = [kn.discounts([sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]) for x in (left, middle, top)]
    rest = sum(ds[0][min(n, 3)] for n in left.values()) / len(middle) / (len(left) + 1)

    def step(table, d, gram, lower):
        own = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not own:
            return lower
        n = table.get(gram, 0)
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in own) * lower) / sum(own)

    def p(u, v, w):
        one = max(left[w] - ds[0][min(left[w], 3)], 0) / len(middle) + rest
        return step(top, ds[2], (u, v, w), step(middle, ds[1], (v, w), one))

    return p, left


@pytest.mark.parametrize("shard", [3_000_000, 8])
def test_order_three_equals_the_plain_model(spark, monkeypatch, shard):
    monkeypatch.setattr(kn, "SHARD_TOKENS", shard)
    texts = ["a b a c a b", "a b b a b a b", "c a b a a", "d", "b a c", None, "a b a c d d d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "a b e a", "c c a b"])], "doc_id long, text string")
    model = kn.count(docs.filter(f"doc_id < {len(texts)}"), 3)
    assert model.shards == 1 or shard == 8
    p, words = plain_trigrams(texts)
    assert math.isclose(sum(p("a", "b", w) for w in [*words, "<unknown>"]), 1.0, rel_tol=1e-9)
    for r in kn.score(docs, model).join(docs, "doc_id").collect():
        u, v, want = "<s>", "<s>", 0.0
        for w in plain_tokens(r.text):
            want += math.log10(p(u, v, w))
            u, v = v, w
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_the_query_sees_more_than_one_word_before():
    assert kn.ORDER >= 3


def test_probabilities_add_up_to_one():
    p, words = plain_model(["a b a c", "a b b", "c a b a a", "d"])
    for v in ("<s>", "a", "b", "unseen"):
        assert math.isclose(sum(p(v, w) for w in words) + p(v, "<unknown>"), 1.0, rel_tol=1e-9)


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(0)
    v, w, c = rng.integers(0, 50, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(1, 1 << 20, 500)
    size = kn.packed_size(len(np.unique(v)), len(np.unique(w)), 500)
    got = kn.unpack(kn.pack(v, w, c), size)
    assert all((a == b).all() for a, b in zip(got, (v, w, c), strict=True))


def test_awkward_rows(spark):
    docs = documents(spark)
    got = kn.score(docs, kn.count(docs)).collect()
    assert len(got) == docs.count()
    assert all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    none = kn.score(docs, kn.count(no_documents(spark))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in none)
    assert kn.score(no_documents(spark), kn.count(docs)).count() == 0


def test_what_is_kept_and_sent_of_an_ngram_is_small(spark):
    rng = np.random.default_rng(1)
    words = np.minimum(rng.zipf(1.3, 60_000), 20_000)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in words[i : i + 200])) for i in range(0, len(words), 200)], "doc_id long, text string")
    model = kn.count(docs, 3)
    kept = sum(f.stat().st_size for f in Path(model.root.removeprefix("file:")).glob("*.npy"))
    assert kept < 11 * sum(model.totals[1:])
    u, v, w = words[:-2].astype(np.uint64), words[1:-1].astype(np.uint64), words[2:].astype(np.uint64)
    _, c, at = kn.merge(kn.gram(u, v, w), np.ones(len(u), dtype=np.int64))
    data, size = kn.pack_numbers([x[at] for x in (u, v, w)], c[:, None])
    assert len(data) < 5 * len(at)
    sides, stats = kn.unpack_numbers(data, size, 3, 1)
    assert {*zip(*(x.tolist() for x in sides), stats[:, 0].tolist(), strict=True)} == {*zip(*(x[at].tolist() for x in (u, v, w)), c.tolist(), strict=True)}


def test_tables_find_all_keys_and_no_others():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    values = kn.records([rng.zipf(1.2, len(keys)).clip(max=1 << 40).astype(np.int64), np.arange(len(keys)) % 7])
    table, _ = kn.hashed(keys, values)
    at = kn.places(keys, table)
    assert (at >= 0).all() and (kn.values_at(at, table) == values).all()
    assert len(table[2])  # some are rare
    assert (kn.places(keys + np.uint64(1 << 63), table) < 0).all()
