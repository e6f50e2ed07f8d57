"""Small tables with every awkward case: nulls, empty and blank texts, repeats, ties, columns with clashing names."""

CLASHING = "doc_id long, text string, id long, uid long, class long, kept boolean, html string"


def documents(spark, texts, ids=None):
    """A table whose other columns have the names that operators use inside."""
    rows = [(i, t, 7, 7, 7, False, "<p>") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, CLASHING)


def empty(spark):
    return spark.createDataFrame([], CLASHING)


def shaped(seed, words=120):
    """A text of made-up words that no other seed shares."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(words))


def edited(text, seed, edits):
    import random

    r = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        at = r.randrange(max(1, len(words)))
        kind = r.randrange(3) if len(words) > 1 else 2
        if kind == 0:
            words[at] = f"x{r.randrange(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"y{r.randrange(10**6)}")
    return " ".join(words)
