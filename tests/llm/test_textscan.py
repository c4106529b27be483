"""Word scans against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trafficgraph.llm import textscan as ts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="aAbZ \n\té漢.", max_size=30), max_size=8)


def check(texts):
    data, offs = ts.utf8(pa.array(texts, pa.string()))
    first, start, end, h = ts.words(data, offs)
    seen = {}
    for r, t in enumerate(texts):
        raw = (t or "").encode()
        want = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(raw)]
        got = [(int(start[i] - offs[r]), int(end[i] - offs[r])) for i in range(first[r], first[r + 1])]
        assert got == [x[:2] for x in want]
        for i, x in zip(range(first[r], first[r + 1]), want):
            assert seen.setdefault(x[2], h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_equal_regular_expression(texts):
    check(texts)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_blocks_do_not_change_words(texts):
    old, ts.BLOCK_BYTES = ts.BLOCK_BYTES, 5
    try:
        check(texts)
    finally:
        ts.BLOCK_BYTES = old


def test_nulls_empties_and_slices():
    check([None, "", "a b", None, "  "])
    arr = pa.array(["x", "a b", None, "c"], pa.string()).slice(1)
    data, offs = ts.utf8(arr)
    assert bytes(data) == b"a bc" and offs.tolist() == [0, 3, 3, 4]
    assert list(ts.slices(offs, 2)) == [(0, 1), (1, 3)] or sum(b - a for a, b in ts.slices(offs, 2)) == 3


def test_rolling_runs_stay_in_rows():
    data, offs = ts.utf8(pa.array(["a b c", "b c a b", "c"]))
    first, _, _, h = ts.words(data, offs)
    g, ok = ts.rolling(h, 2), ts.whole_runs(first, len(h), 2)
    assert ok.tolist() == [True, True, False, True, True, True, False]
    assert g[1] == g[3] and g[0] == g[5] and g[0] != g[1]
    assert len(ts.rolling(np.zeros(1, np.uint64), 2)) == 0
