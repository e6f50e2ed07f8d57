from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents, edited, empty, shaped

from lumenframe.llm import near_dedup, shared
from lumenframe.llm.near_dedup import labelled, linked, near_duplicates, near_pairs, order_sketches


def shingles(t, k=5):
    w = (t or "").lower().split()
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    ids = {w: i for i, w in enumerate({*a, *b})}
    other = np.array([ids[w] for w in b], int)
    at = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (other != ids[x]))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def aligned(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    return edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def brute(texts):
    """Classes by edit similarity, of texts with two shingles in common, without which no sketch agrees."""
    n = len(texts)
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [shingles(t) for t in texts]
    for i in range(n):
        for j in range(i):
            same = (texts[i] or "").lower().split() == (texts[j] or "").lower().split()
            if same or (s[i] & s[j]).total() >= 2 and aligned(texts[i], texts[j]):
                x, y = top(i), top(j)
                root[min(x, y)] = max(x, y)
    return {i: top(i) for i in range(n)}


def corpus():
    out = []
    for base in range(12):
        text = shaped(base, 60 + 40 * base)
        out += [text, text.upper(), *[edited(text, 100 * base + e, e) for e in (1, 2, 3, 4, 6, 8, 12, 20)]]
    passage = shaped(999, 60)
    out += [shaped(500 + i, 20) + " " + passage + " " + shaped(600 + i, 20) for i in range(60)]
    out += [None, "", " ", "one", "One", "one two three", "one  two three", "one two", "a b c d e", "a b c d e f", "w " * 50, "w " * 60]
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    texts = corpus()
    got = {r.doc_id: r for r in near_duplicates(documents(spark, texts)).collect()}
    want = brute(texts)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_a_large_family_of_which_few_pairs_are_near(spark):
    base = shaped(7, 90)
    texts = [edited(base, i, 1 + i % 7) for i in range(250)]
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = near_duplicates(documents(spark, ["a b", "A  b", "c"], [None, None, 3])).collect()
    assert sorted((r.class_id or 0, r.class_size, r.kept) for r in rows) == [(0, 2, False), (0, 2, True), (3, 1, True)]
    assert near_duplicates(empty(spark)).collect() == []


def test_sketches_feel_order():
    x = labelled(np.arange(400, dtype=np.uint32), 5)
    turned = np.concatenate([x[200:], x[:200]])
    same = order_sketches(x, 200, 2) == order_sketches(turned, 200, 2)
    assert (order_sketches(x, 200, 2) == order_sketches(x.copy(), 200, 2)).all() and 0.3 < same.mean() < 0.7


def test_occurrences_are_told_apart():
    x = labelled(np.ones(30, np.uint32), 5)
    assert len(set(x.tolist())) == len(x) == 26


def test_a_repeat_on_one_side_only(spark):
    once = [shaped(40 + i, 500) for i in range(3)]
    twice = [f"{t} {' '.join(t.split()[60:80])}" for t in once]  # one sentence said twice
    assert all(max(shingles(t).values()) == 1 for t in once) and all(max(shingles(t).values()) == 2 for t in twice)
    both = [shaped(70, 100) + " " + "la la la la la la la " + shaped(71, 100)]
    texts = once + twice + both + [both[0].replace("la la la la la la la", "la la la la")]
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts) == {0: 3, 1: 4, 2: 5, 3: 3, 4: 4, 5: 5, 6: 7, 7: 7}


def test_recall_of_the_tables_edit_near_pairs(spark):
    """Brute force over all pairs of different words in the small table: a pair within the bar lies in one class."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    first = {}
    for i, t in rows:
        first.setdefault(tuple((t or "").lower().split()), i)
    words, ids = list(first), list(first.values())
    bags = [Counter(w) for w in words]
    pairs = []
    for i, a in enumerate(words):
        for j in range(i):
            longer = max(len(a), len(words[j]))
            most = int(0.2 * longer + 1e-9)
            if longer - min(len(a), len(words[j])) <= most and (bags[i] & bags[j]).total() >= longer - most and edit_distance(a, words[j]) <= most:
                pairs.append((ids[i], ids[j]))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    joined = [got[a].class_id == got[b].class_id for a, b in pairs]
    assert len(pairs) >= 50 and sum(joined) >= 0.9 * len(pairs)
    assert all(got[a].links and got[b].links for (a, b), j in zip(pairs, joined) if j)


def test_recall_at_the_bar():
    """Every fifth word changed, scattered: as far apart as a link may be."""
    r = np.random.default_rng(5)
    found = []
    for _ in range(300):
        a = r.integers(0, 2**63, 200).astype(np.uint64)
        b = a.copy()
        b[r.choice(200, 38, replace=False)] = r.integers(0, 2**63, 38)
        assert linked(a, b, 0.8) is not None
        found.append((order_sketches(labelled(a, 5), near_dedup.SKETCHES, 2) == order_sketches(labelled(b, 5), near_dedup.SKETCHES, 2)).any())
    assert np.mean(found) >= 0.9


def test_the_test_before_alignment_loses_no_link():
    r = np.random.default_rng(6)
    for n in range(1, 60):
        for _ in range(20):
            a = r.integers(0, 4, n)
            b = [int(x) for x in a]
            for _ in range(near_dedup.budget(n, 0.8)):
                b[r.integers(0, len(b))] = int(r.integers(0, 9))
            b = np.array(b, np.uint64)
            d = edit_distance(list(a), list(b))
            assert linked(a.astype(np.uint64), b, 0.8) == (d if d <= near_dedup.budget(n, 0.8) else None)


def test_links_are_counted_and_listed(spark):
    base = shaped(3, 100)
    texts = [base, edited(base, 1, 5), shaped(4, 100), base.upper()]
    rows = {r.doc_id: r for r in near_duplicates(documents(spark, texts)).collect()}
    d = edit_distance(base.split(), texts[1].split())
    assert [(rows[i].class_id, rows[i].class_size, rows[i].links, rows[i].nearest) for i in range(4)] == [(3, 3, 1, d), (3, 3, 1, d), (2, 1, 0, None), (3, 3, 1, d)]
    assert [tuple(r) for r in near_pairs(documents(spark, texts)).collect()] == [(1, 3, d)]


def test_very_long_texts(spark):
    base = shaped(8, 60_000)
    words = base.split()
    words[::9] = ["z"] * len(words[::9])
    texts = [base, " ".join(words), shaped(9, 60_000)]
    got = near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 1, 1: 1, 2: 2}


def test_rows_under_one_id_are_decided_by_text(spark):
    base = shaped(11, 80)
    texts = [base, edited(base, 1, 2), shaped(12, 80), base, None]
    docs = documents(spark, texts, [5, 5, 5, None, None])
    left = shared.survivors(docs, near_duplicates(docs), "doc_id").collect()
    assert len(left) == 3 and sorted(r.doc_id or 0 for r in left) == [0, 5, 5]
    assert {r.text for r in left} - {base, texts[1]} == {texts[2], None}


def test_texts_with_only_a_passage_in_common_are_not_sent_to_blocks(spark, monkeypatch):
    """300 texts share a passage and so their buckets; the one pair near each other and its class are found."""
    passage = shaped(21, 60)
    texts = [f"{shaped(1000 + i, 60)} {passage} {shaped(2000 + i, 30)}" for i in range(300)]
    texts += [edited(texts[5], 1, 4), "aa bb cc", "aa bb dd"]
    rows = {}

    def counted(df, name, write=near_dedup.materialise):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: 300 if i == 5 else i for i in range(303)}
    assert rows["buckets"][0] > 1000 and rows["spread"][0] == 0


def test_strangers_meet_the_main_component_of_many_buckets_once(spark, monkeypatch):
    """A family of copies and texts half like it: classes as by brute force, however small the blocks are."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    base = shaped(22, 80)
    texts = [edited(base, i, 1 + i % 3) for i in range(40)]
    texts += [" ".join([*base.split()[:k], *shaped(300 + k, 80 - k).split()]) for k in range(52, 70)]
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_the_rarest_runs_lose_no_link():
    r = np.random.default_rng(7)
    for n in range(1, 120):
        need = near_dedup.least_shared(n, 0.8)
        for longer in range(n, 160):
            if longer - n <= near_dedup.budget(longer, 0.8):
                assert need <= near_dedup.least_common(longer, 0.8)
        a = r.integers(0, 9, n).astype(np.uint64)
        b = a.copy()
        b[r.choice(n, near_dedup.budget(n, 0.8), replace=False)] = 99
        first = [set(np.sort(labelled(x, near_dedup.GRAM))[: max(0, len(labelled(x, near_dedup.GRAM)) - need + 1)].tolist()) for x in (a, b)]
        assert need < 1 or first[0] & first[1]
