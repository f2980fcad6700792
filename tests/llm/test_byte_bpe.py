import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import byte_bpe as bp

from .edges import documents, no_documents

VOCAB = bp.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCAB.ids, special_tokens={})
ENCODER = bp.Encoder(VOCAB)
PAIRS = dict(zip(VOCAB.pair_keys.tolist(), VOCAB.pair_ranks.tolist(), strict=True))


def plain_merges(piece):
    """Every pair looked at before every merge."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [VOCAB.ids.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        if not ranks or min(ranks) == 1 << 40:
            return [VOCAB.ids[p] for p in parts]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_are_the_librarys(texts):
    assert ENCODER.texts(texts).to_pylist() == LIBRARY.encode_ordinary_batch(texts)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=2, max_size=90))
def test_both_trees_merge_as_every_pair_looked_at(piece):
    import numpy as np

    width = 1 << (len(piece) - 1).bit_length()
    data = np.frombuffer(piece + bytes(width - len(piece)), dtype=np.uint8)[None, :]
    together, n = bp.merge_together(data, np.array([len(piece)]), VOCAB)
    assert together.tolist() == bp.merge_alone(piece, VOCAB, PAIRS) == plain_merges(piece) and n.tolist() == [len(together)]


def test_long_pieces_and_long_texts():
    rng = random.Random(3)
    texts = ["a" * 70_000, "".join(rng.choice("abcdeé漢") for _ in range(50_000)), " " * 5000 + "x", "".join(rng.choice("ab é漢😀 \n\t1!'s") for _ in range(40_000))]
    assert ENCODER.texts(texts).to_pylist() == LIBRARY.encode_ordinary_batch(texts)


def test_texts_in_parts_are_texts_at_once(monkeypatch):
    texts = ["one two  three\n" * 50, "", "it's 1 text", "word " * 400]
    whole = ENCODER.texts(texts).to_pylist()
    monkeypatch.setattr(bp, "SLICE", 300)
    monkeypatch.setattr(bp, "PIECES", 7)
    assert bp.Encoder(VOCAB).texts(texts).to_pylist() == whole == LIBRARY.encode_ordinary_batch(texts)
    monkeypatch.setattr(bp, "IDS", 5)
    import numpy as np

    assert bp.bytes_of(np.array(whole[0]), VOCAB).decode() == texts[0]


def test_the_whole_query_is_the_library(spark, small_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = bp.op11_byte_bpe(spark, small_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark):
    docs = documents(spark).withColumn("ids", F.lit("a clash")).withColumn("decoded", F.lit(1))
    got = bp.decode(bp.encode(docs, VOCAB), VOCAB).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.decoded.decode() == (r.text or "") and r.ids == LIBRARY.encode_ordinary(r.text or "")
    empty = bp.decode(bp.encode(no_documents(spark), VOCAB), VOCAB)
    assert empty.count() == 0 and dict(empty.dtypes)["ids"] == "array<int>"
    rows = spark.createDataFrame([(None,), ([],), ([256, 300],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bp.decode(rows, VOCAB).collect()][:2] == [b"", b""]


@pytest.mark.parametrize("bad", [[60_000], [-1], [None]])
def test_ids_without_a_token_are_an_error(spark, bad):
    with pytest.raises(Exception, match="no token has the id"):
        bp.decode(spark.createDataFrame([(bad,)], "ids array<int>"), VOCAB).collect()


def test_a_vocabulary_without_a_byte_is_an_error(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="a byte is no token"):
        bp.load(str(tmp_path / "few"))
