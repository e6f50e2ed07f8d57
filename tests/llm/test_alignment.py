from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.alignment import banded_distance, find


def distance(a, b, free=False):
    row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if free else row[-1]


seqs = st.lists(st.integers(0, 3), max_size=24)


@settings(max_examples=400, deadline=None)
@given(seqs, seqs, st.integers(0, 30))
def test_banded(a, b, most):
    assert banded_distance(a, b, most) == min(distance(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), seqs)
def test_find(pattern, text):
    d, start, end = find(pattern, text)
    assert d == distance(pattern, text, True) == distance(pattern, text[start:end])
