import re

import numpy as np
import pyarrow as pa

from corvane.llm import textcore as tc

TEXTS = ["", "one", " a  b\tc\n", "ü ñ x", "A b", None, "\x0b\x0c", "x" * 5000 + " y", "a b c a b c"]


def test_words_are_those_of_the_pattern():
    got = []
    for _, _, w in tc.docs_words(pa.array(TEXTS, pa.string())):
        for d in range(len(w.offs) - 1):
            got.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_hashes_depend_on_the_word_alone():
    w = tc.split(*tc.strings(pa.array(["ab cd", "cd ab", "AB", "abc"])), lower=True)
    h = w.hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_rolling_is_place_free():
    h = tc.mix(np.arange(20, dtype=np.uint64) % np.uint64(7))
    g = tc.rolling(h, 5)
    assert (g[:9] == g[7:16]).all() and len(set(g[:7].tolist())) == 7
    assert len(tc.rolling(h, 21)) == 0


def test_sliced_and_null_columns():
    a = pa.array(["x", None, "y z", ""]).slice(1, 3)
    data, offs = tc.strings(a)
    assert offs[-1] - offs[0] == 3 and len(offs) == 4
    assert list(tc.slices(np.array([0, 10, 10, 30, 31]), 12)) == [(0, 2), (2, 3), (3, 4)]
