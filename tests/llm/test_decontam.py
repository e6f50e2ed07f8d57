import random

import pytest
from helpers import documents, edited, empty, shaped

from lumenframe.llm.decontam import Pieces, clean, contaminated


def words(t):
    return [w for w in ((t or "").lower().translate(str.maketrans("", "", ".,;:!?\"'`()[]{}<>"))).split() if w]


def least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(texts, items, similarity=0.8):
    out = set()
    for d, t in enumerate(texts):
        for i, b in items:
            p = words(b)
            if p and (n := least(p, words(t))) <= int((1 - similarity) * len(p) + 1e-9):
                out.add((d, i, n))
    return out


def cases():
    items = [(i, shaped(1000 + i, n)) for i, n in enumerate((3, 4, 5, 9, 15, 30, 59))] + [(7, ""), (8, None), (9, "...")]
    texts = [shaped(1, 80), None, "", "  "]
    r = random.Random(2)
    for i, b in items[:7]:
        for e in (0, 1, 2, 3, 6, 9, 13):
            texts.append(f"{shaped(50 * i + e, 40)}, {edited(b, e + i, e).upper()}. {shaped(r.randrange(9999), 30)}")
        texts += [b, b + " " + b, b[: len(b) // 2]]
    return texts, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_matches_equal_brute_force(spark, block_bytes):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(documents(spark, texts), bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == brute(texts, items)
    for r in rows:
        assert least(words(items[r.item_id][1]), words(texts[r.doc_id])[r.start : r.end]) == r.distance
    kept = {r.doc_id for r in clean(documents(spark, texts), bench, block_bytes=block_bytes).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in rows}


def test_common_words_are_no_match():
    stop = "the of and to a in that is was he for it with as his on be at by i".split()
    r = random.Random(1)
    items = [(i, " ".join(r.choice(stop) for _ in range(25))) for i in range(20)]
    text = " ".join(r.choice(stop) for _ in range(3000))
    p = Pieces(items, 0.8)
    assert {(m[0], m[1]) for m in p.matches(text)} == {(i, d) for _, i, d in brute([text], items)}


def test_empty_tables_and_columns_stay(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, ["a b c d e f"])
    assert contaminated(docs, none).collect() == [] and contaminated(empty(spark), none).collect() == []
    assert clean(docs, none).collect() == docs.collect() and clean(empty(spark), none).columns == docs.columns
