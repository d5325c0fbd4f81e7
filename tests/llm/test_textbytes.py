import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wreath.llm import textbytes as TB

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n.é漢|", max_size=40)), max_size=8), st.integers(1, 30))
def test_words_are_those_of_the_regular_expressions(texts, limit):
    for pattern, lut in ((ALNUM, TB.ALNUM), (SPACED, TB.SPACED)):
        found = {}
        for i, j, h, rows in TB.words(pa.array(texts, pa.string()), lut, limit):
            for r in range(j - i):
                found[i + r] = h[rows == r].tolist()
        names = {}
        for i, t in enumerate(texts):
            want = pattern.findall(low(t))
            assert len(found.get(i, [])) == len(want)
            for w, h in zip(want, found.get(i, [])):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_slices_and_pieces_do_not_change_hashes():
    text = " ".join(f"wort{i % 97}é" for i in range(4000))
    one = np.concatenate([h for *_, h, _ in TB.words(pa.array([text]), TB.ALNUM)])
    data, off = TB.utf8(pa.array([text]))
    mapped, s, e, _ = TB.word_spans(data, off, TB.ALNUM)
    assert (TB.span_hashes(mapped, s, e, piece=64) == one).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_sliced_columns(kind):
    column = pa.array(["one two", None, "", "three"], kind).slice(1)
    data, off = TB.utf8(column)
    assert bytes(data) == b"three" and off.tolist() == [0, 0, 0, 5]
