from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import words as W


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0bZ9-", max_size=30)), max_size=12), size=st.sampled_from([1, 7, 1 << 20]))
def test_words_are_those_of_the_pattern(texts, size):
    found, hashes = [], {}
    for block in W.blocks(pa.array(texts, pa.string()), W.space_table(), size=size):
        h = block.hashes()
        for r in range(block.rows):
            at = range(block.first[r], block.first[r + 1])
            found.append([block.word(i).decode() for i in at])
            for i in at:
                assert hashes.setdefault(block.word(i), h[i]) == h[i]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_lower_case_words():
    block = next(W.blocks(pa.array(["Ab-C9 É_z"]), W.alnum_table(), lower=True))
    assert [block.word(i).decode() for i in range(len(block.start))] == ["ab", "c9", "É", "z"]


def test_sliced_columns_keep_their_rows():
    column = pa.array(["skip", "a b", None, "c"]).slice(1)
    assert [int(n) for block in W.blocks(column, W.space_table()) for n in block.counts()] == [2, 0, 1]


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8, 13, 50])
def test_rolling_hashes_and_minima(m):
    v = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    seen = {}
    for i, h in enumerate(W.rolling(v, m)):
        assert seen.setdefault(tuple(v[i : i + m]), h) == h
    assert len(set(seen.values())) == len(seen)
    assert all(x == v[i : i + m].min() for i, x in enumerate(W.sliding_min(v, m)))
