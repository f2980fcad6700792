import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.common import WORD, encode, hash_words, slices, split_words, text_of, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1c\x85\xa0éA", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for part in slices(iter([batch]), "text", 8):
        words, counts = split_words(text_of(part))
        at = np.cumsum(counts) - counts
        flat = words.to_pylist()
        got += [flat[a : a + n] for a, n in zip(at, counts, strict=True)]
    assert got == [re.findall(WORD, t or "") for t in texts]


def test_windows_stay_within_rows():
    words, counts = split_words(pa.array(["a b c d", "a b", "", "b c d"], pa.large_string()))
    codes, distinct = encode(words)
    found, n = windows(hash_words(distinct)[codes], counts, 3)
    assert n.tolist() == [2, 0, 0, 1]
    assert found[1] == found[2] and found[0] != found[1]
