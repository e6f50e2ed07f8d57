import hashlib

import pytest
from helpers import documents, empty, shaped
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.exact_dedup import LEAST, MOST, chunk_dictionary, chunk_recipes, cut_points, exact_duplicates


def lower(t):
    return (t or "").encode().lower().decode()


def brute(texts, ids):
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(lower(t), []).append(i)
    return sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in zip(ids, texts))


TEXTS = ["A b", "a B", None, "", "É", "é", shaped(1, 9000), shaped(1, 9000).upper(), shaped(1, 9000) + "x", " ", "a b ", "x" * 40_000, "x" * 40_000, "x" * 40_001]


@pytest.mark.parametrize("bits", [64, 2])
def test_groups_equal_brute_force_even_with_clashing_fingerprints(spark, bits):
    got = exact_duplicates(documents(spark, TEXTS), fingerprint_bits=bits).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(TEXTS, range(len(TEXTS)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_null_and_repeated_ids(spark):
    got = exact_duplicates(documents(spark, ["a", "A", "a", "b", "b"], [None, 5, 5, None, None])).collect()
    assert sorted((r.keep_id or 0, r.group_size) for r in got) == [(0, 2), (0, 2), (5, 3), (5, 3), (5, 3)]
    assert sum(r.kept for r in got) == 2


def test_empty_table(spark):
    assert exact_duplicates(empty(spark)).collect() == []


def test_dictionary_numbers_clashes(spark):
    rows = chunk_dictionary(chunk_recipes(documents(spark, TEXTS), fingerprint_bits=2)).collect()
    assert len({(r.fp, r.number) for r in rows}) == len({r.digest for r in rows}) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 2000))
def test_cuts(data, shift):
    data = data * 9
    cuts = cut_points(data)
    assert (cuts[-1] if cuts else 0) == len(data) and cuts == sorted(set(cuts))
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert all(LEAST <= s <= MOST for s in sizes[:-1])


def test_shared_passages_share_chunks():
    a, b = shaped(2, 6000).encode(), shaped(3, 200).encode()
    parts = lambda d: {d[x:y] for x, y in zip([0, *cut_points(d)], cut_points(d))}
    assert len(parts(a) & parts(b + a)) > len(parts(a)) // 2
