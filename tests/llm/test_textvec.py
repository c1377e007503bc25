import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import textvec as v


def brute(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="abcXYZé \n\t\x0b界", max_size=40) | st.none(), max_size=8))
def test_words_of_rows(texts):
    got = {r: h[ptr[r - lo] : ptr[r - lo + 1]].tolist() for lo, hi, h, ptr in v.word_batches(pa.array(texts, pa.string()), v.SPACE_WORDS) for r in range(lo, hi)}
    by_word = {}
    for r, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert len(got[r]) == len(brute(low))
        for w, h in zip(brute(low), got[r], strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_are_cut_at_separators():
    text = " ".join(f"word{i % 77}" for i in range(400_000))
    short = {w: v.word_batches(pa.array([w]), v.SPACE_WORDS).__next__()[2][0] for w in {f"word{i}" for i in range(77)}}
    ((_, _, h, ptr),) = list(v.word_batches(pa.array([text]), v.SPACE_WORDS))
    assert ptr.tolist() == [0, 400_000] and h[:77].tolist() == [short[f"word{i}"] for i in range(77)]
    ((_, _, h, _),) = list(v.word_batches(pa.array(["a" * 3_000_000]), v.SPACE_WORDS))
    assert len(h) == 1


def test_distinct():
    h = np.array([5, 5, 9, 5], np.uint64) << np.uint64(20)
    row, value, count = v.distinct(h, np.array([0, 3, 3, 4]))
    assert row.tolist() == [0, 0, 2] and value.tolist() == [5, 9, 5] and count.tolist() == [2, 1, 1]
