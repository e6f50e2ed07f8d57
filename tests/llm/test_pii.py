import hashlib
import math
import random
import re
import time

import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from lumenframe.llm.pii import BASE, FEATURES, KINDS, MORE, PATTERNS, iban_valid, model, personal_spans, value
from lumenframe.llm.pii_model import candidates, sample

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def texts():
    r = random.Random(4)
    out = ["".join(r.choice("ab1.@-+ 9%_(:é🎉") for _ in range(r.randrange(60))) for _ in range(1500)]
    out += ["".join(r.choice("0123456789 -+().") for _ in range(r.randrange(60))) for _ in range(1500)]
    out += [None, "", " ", "a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "4111 1111-1111 1111", "+1 (583) 555-1341", "1" * 5000, "9 " * 20000, "a" * 30000 + "@b.c", "a@" * 3000 + "b.c"]
    return out


def test_base_equals_the_plain_patterns(spark):
    every = texts()
    rows = {r.doc_id: r for r in personal_spans(documents(spark, every)).collect()}
    for i, t in enumerate(every):
        want = brute(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        counts = [want.count(f"{k}:") for k in PLAIN]
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == counts
        assert set(filter(None, want.split(","))) <= set(rows[i].spans.split(","))


CASES = [
        ("mail john [at] foo [dot] com", "spelled_email:5:28"), ("my SSN 123-45-6789 here", "ssn:7:18"), ("call (555) 123-4567 now", "local_phone:5:19"),
        ("IBAN DE89370400440532013000 x", "iban:5:27"), ("order 000-45-6789", None), ("IBAN DE00370400440532013000 x", None), ("version 555.123.4567 build", None),
        ("he looked (at) them then", None), ("she was born 3.4.1971 in", "date:13:21"), ("published 3.4.2021 in", None), ("Tel. 0304 123 4567 ok", "national_phone:5:18"), ("device 3c:22:fb:01:9e:7a on", "mac:7:24"),
        ("follow @some_body now", "handle:7:17"), ("code @Override here", None), ("home at 52.52001, 13.40495 ok", "coordinates:8:26"), ("donate 0x52ab8400c985278d6e0f70fa069e57d2e4169eef ok", "wallet:7:49"),
        ("lives at 12 Baker Street in", "street:9:24"), ("passport C01234567 ok", "id_number:9:18"), ("see ftp://bob:pw123@host.org now", "login_url:4:28"),
]


def test_trees_decide(spark):
    rows = {r.doc_id: r for r in personal_spans(documents(spark, [t for t, _ in CASES])).collect()}
    for i, (text, more) in enumerate(CASES):
        assert (",".join(f"{KINDS[f.k]}:{f.s}:{f.e}" for f in rows[i].found if KINDS[f.k] in MORE) or None) == more, text


def test_trees_decide_on_base_spans_too(spark):
    texts = ["login from 81.20.3.17 today", "version 1.2.0.4 of it", "mail bob@site.org now", "file icon@2x.png here"]
    rows = {r.doc_id: r for r in personal_spans(documents(spark, texts)).collect()}
    assert [[f.redact for f in rows[i].found if KINDS[f.k] in BASE] for i in range(4)] == [[True], [False], [True], [False]]
    assert [rows[i].n_redact for i in range(4)] == [1, 0, 1, 0] and all(rows[i].spans for i in range(4))


def test_scores_are_those_of_the_trees(spark):
    texts = [s["text"] for s in sample(len(KINDS) * 4, 21)]
    rows = spark.createDataFrame([(t, k, 0) for t in texts for k in KINDS], "text string, kind string, y int")
    by_row = {}
    for r in candidates(rows).collect():
        z = sum(value(t, r.x) for t in model()[0])
        by_row.setdefault(r.kind, set()).add((round(1 / (1 + math.exp(-z)), 9), z >= model()[1][r.kind]))
    found = [f for r in personal_spans(documents(spark, texts)).collect() for f in r.found]
    assert len(found) > len(texts) / 3
    assert all((round(f.score, 9), f.redact) in by_row[KINDS[f.k]] for f in found)


def test_trees_act_on_the_tables_texts(spark):
    """Planted between the words of real documents: personal data is found, look-alikes aren't."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 100").orderBy("doc_id").limit(60).collect()]
    rows = [s for s in sample(900, 77, docs) if s["kind"] in MORE]
    base = {r.doc_id: r.n_more for r in personal_spans(documents(spark, docs)).collect()}
    assert not any(base.values())
    found = {r.doc_id: r.n_more for r in personal_spans(documents(spark, [f"{docs[i % 60]} {s['text']} {docs[i % 60]}" for i, s in enumerate(rows)])).collect()}
    good = [found[i] > 0 for i, s in enumerate(rows) if s["y"]]
    bad = [found[i] > 0 for i, s in enumerate(rows) if not s["y"]]
    assert sum(good) > 0.8 * len(good) and sum(bad) < 0.1 * len(bad)


def test_finds_don_t_overlap_and_carry_their_text(spark):
    text = "🎉 call +1 (555) 123-4567 or phone (555) 123-4567, SSN 123-45-6789"
    found = personal_spans(documents(spark, [text])).first().found
    assert [KINDS[f.k] for f in found] == ["phone", "local_phone", "ssn"]
    assert all(f.m == text[f.s : f.e] for f in found) and all(a.e <= b.s for a, b in zip(found, found[1:]))


def test_generators_find_every_made_up_case(spark):
    rows = [s for s in sample(1200, 99) if s["y"]]
    df = spark.createDataFrame([(s["text"], s["kind"]) for s in rows], "text string, kind string")
    counts = df.groupBy("kind").agg(*[F.sum((F.col("kind") == k).cast("int") * F.col("text").rlike(PATTERNS[k]).cast("int")).alias(k) for k in KINDS], F.count("*").alias("n")).collect()
    assert {r.kind for r in counts} == set(KINDS)
    assert all(r[r.kind] == r.n for r in counts), [(r.kind, r[r.kind], r.n) for r in counts]


def test_held_out_accuracy(spark):
    rows = sample(1500, 12345)
    every = {r.doc_id: r for r in personal_spans(documents(spark, [s["text"] for s in rows])).collect()}
    found = {i: any(f.redact and KINDS[f.k] == s["kind"] for f in every[i].found) for i, s in enumerate(rows)}
    right = sum(found[i] == bool(s["y"]) for i, s in enumerate(rows)) / len(rows)
    wrong = [i for i, s in enumerate(rows) if found[i] and not s["y"]]
    assert right > 0.85 and len(wrong) < 0.08 * len(rows)
    assert set(model()[1]) == set(KINDS) and len(model()[0][0]) == 4 and max(t[0] for t in model()[0] if isinstance(t, list)) < len(FEATURES)


def test_many_matches_take_near_linear_time(spark):
    def seconds(n):
        text = " ".join(f"{i % 10}.{i % 7}.1.{i % 250} or" for i in range(n))
        began = time.perf_counter()
        row = personal_spans(documents(spark, [text])).select("n_ip", "spans").first()
        assert row.n_ip == n and row.spans.split(",")[-1].startswith(f"ip:{text.rindex(' ', 0, -3) + 1}:")
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 8 * max(seconds(8_000), 1)


def test_repeated_rows_and_null_ids(spark):
    rows = personal_spans(documents(spark, ["a@b.cd", "a@b.cd", None], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in rows) == [(0, 0), (1, 1), (1, 1)]


def test_iban(spark):
    check = lambda s: spark.range(1).select(iban_valid(F.lit(s))).first()[0]
    assert check("DE89 3704 0044 0532 0130 00") and check("GB82WEST12345698765432") and not check("GB83WEST12345698765432")


def test_no_python_on_executors(spark):
    plan = personal_spans(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert personal_spans(empty(spark)).collect() == []
