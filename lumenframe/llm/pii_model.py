"""Fit the trees of pii.py and write them to pii_model.json: ``python -m lumenframe.llm.pii_model DOCUMENTS.parquet``.

Candidates are of a known kind and of known truth; what stands around them is taken from real documents, of which
at most CONTEXTS rows are read. Features are computed by the expressions that documents go through. Trees are fitted
to every other candidate, thresholds are calibrated on the rest.
"""

from __future__ import annotations

import json
import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import BASE, FEATURES, KINDS, feature_columns, spans, value

SAMPLE, CONTEXTS, TREES, RATE, PRECISION = 9000, 2000, 40, 0.4, 0.97

#: What tends to stand before personal data of each kind, and before other things of the same form.
BEFORE = {
    "email": ["mail", "contact", "write to", "", ""], "ip": ["host", "login from", "client address", "", ""], "card": ["card", "visa", "paid with", "", ""], "phone": ["call", "phone", "tel.", "", ""],
    "iban": ["IBAN", "bank account", "transfer to", ""], "ssn": ["SSN", "social security number", "tax id"], "spelled_email": ["mail", "contact", "write to", ""], "local_phone": ["call", "phone", "tel.", "mobile", "fax"],
    "ipv6": ["host address", "login from", "server"], "national_phone": ["Tel.", "phone", "call", "mobile", "Fax"], "date": ["born", "born on", "date of birth", "DOB"], "mac": ["device", "client", "host", ""],
    "handle": ["follow", "twitter", "message", "instagram", ""], "coordinates": ["home at", "position", "lives at", ""], "wallet": ["donate", "wallet", "send btc to", ""], "street": ["lives at", "home address", "moved to", "house at", ""],
    "id_number": ["passport", "driving licence", "identity card"], "login_url": ["", "login", "server"],
}
OTHER = ["version", "ISBN", "order", "invoice", "part", "item", "ref", "build", "model", "serial", "section", "commit", "published", "updated", "class", "", ""]


def made_up(r: random.Random, kind: str, good: bool) -> tuple[str, str]:
    """What stands before a candidate, and the candidate: personal data, or another thing of that form."""

    def d(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word(lo: int = 3, hi: int = 8) -> str:
        return "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(lo, hi)))

    def h(k: int) -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card(right: bool) -> str:
        body = r.choice("3456") + d(r.choice([14, 14, 13]))
        total = sum((v := int(c) * (2 - i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(body)))
        whole = body + str((-total) % 10)
        return r.choice(["", " ", "-"]).join(whole[i : i + 4] for i in range(0, len(whole), 4)) if right else whole

    def iban() -> str:
        body, country = d(18), r.choice(["DE", "FR", "ES", "IT", "NL"])
        number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
        return f"{country}{98 - number % 97:02d}{body}"

    def wrong_iban() -> str:
        own = iban()
        return r.choice([f"{own[:2]}{(int(own[2:4]) + r.randint(1, 90)) % 97:02d}{own[4:]}", "".join(r.choice("ABCDEFGHKL") for _ in range(2)) + d(2) + h(16).upper()])

    year, old = r.randint(1930, 2015), r.randint(1400, 1900)
    byte = lambda: r.randint(0, 255)
    title = lambda: word(4, 9).capitalize()
    makes = {
        "email": (lambda: f"{word()}{r.choice(['', '.' + word(), d(2)])}@{word()}.{r.choice(['com', 'org', 'net', 'example.com', 'de'])}", lambda: r.choice([f"{word()}@{r.randint(1, 4)}x.{r.choice(['png', 'jpg'])}", f"{word()}@{word()}.{r.choice(['js', 'css', 'py', 'local'])}"])),
        "ip": (lambda: f"{r.randint(1, 223)}.{byte()}.{byte()}.{r.randint(1, 254)}", lambda: f"{r.randint(0, 12)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}"),
        "card": (lambda: card(True), lambda: card(False)),
        "phone": (lambda: f"+{r.choice(['1', '49 ', '44 ', '33 '])}{r.choice([' (', '', ' '])}{r.randint(2, 9)}{d(2)}{r.choice([') ', ' ', '-'])}{d(3)}-{d(4)}".replace("+1)", "+1 "), lambda: r.choice([f"+{d(1)} 000 {d(3)} 000", f"+{d(3)} {d(3)} {d(3)} {d(3)}", f"+0{d(9)}"])),
        "iban": (iban, wrong_iban),
        "ssn": (lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", lambda: r.choice([f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}"])),
        "spelled_email": (lambda: f"{word()}{r.choice([' (at) ', '[at]', ' [at] '])}{word()}{r.choice(['.com', ' (dot) org', ' [dot] net'])}", lambda: f"{word()} (at) {word()}.{r.choice(['the', 'then', 'and'])}"),
        "local_phone": (lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}"]).format(d(3), d(3), d(4)), lambda: f"{d(3)}{r.choice('.- ')}{d(3)}{r.choice('.- ')}{d(4)}"),
        "ipv6": (lambda: ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8)), lambda: ":".join(f"{r.randrange(0, 3):x}" for _ in range(8))),
        "national_phone": (lambda: f"0{r.randint(1, 9)}{d(2)}{r.choice([' ', '/', '-'])}{d(3)} {d(4)}", lambda: f"0{r.randint(1, 9)}{d(r.randint(3, 4))}{r.choice(['', '-'])}{d(4)}{d(3)}"),
        "date": (lambda: r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.{year}", f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{year}"]), lambda: r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2025)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{max(old, 1900)}", f"20{r.randint(10, 25)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"])),
        "mac": (lambda: r.choice(":-").join(h(2) for _ in range(6)), lambda: ":".join([r.choice(["00", "ff", "FF"])] * 6)),
        "handle": (lambda: f"@{word(4, 12)}{r.choice(['', d(2), '_' + word()])}", lambda: f"@{r.choice(['Override', 'param', 'return', 'import', 'media', 'property', 'Test', 'deprecated', 'staticmethod'])}"),
        "coordinates": (lambda: f"{r.uniform(-89, 89):.5f}, {r.uniform(-179, 179):.5f}", lambda: f"{r.uniform(91, 99):.4f}, {r.uniform(200, 999):.4f}"),
        "wallet": (lambda: r.choice([f"0x{h(40)}", "1" + "".join(r.choice("ABCDEFGHJKLMNPQRSTabcdefghjkmnpqrstuv23456789") for _ in range(33))]), lambda: r.choice([r.choice("13") + d(r.randint(25, 40)).replace("0", "7"), "0x" + "0" * 40, r.choice("13") + "a" * 30])),
        "street": (lambda: f"{r.randint(1, 999)} {title()} {r.choice(['Street', 'Ave', 'Road', 'Lane', 'Drive'])}", lambda: f"{r.randint(1, 99)} {r.choice(['The', 'One', 'Some', 'This'])} {r.choice(['Way', 'Drive', 'Court'])}"),
        "id_number": (lambda: f"{r.choice('CFGHJKLXY')}{r.choice(['', 'B'])}{d(8)}", lambda: f"{r.choice(['A', 'B', 'SN', 'X'])}{d(r.randint(6, 9))}"),
        "login_url": (lambda: f"{r.choice(['ftp', 'https', 'postgres'])}://{word()}:{word()}{d(3)}@{word()}.{r.choice(['com', 'org'])}", lambda: f"{r.choice(['ftp', 'https'])}://{r.choice(['user', 'name', 'x'])}:{r.choice(['password', 'pass', '***'])}@host"),
    }
    value = makes[kind][0 if good else 1]()
    strict = kind in ("iban", "email", "spelled_email", "mac", "wallet", "handle", "street", "coordinates")
    return (r.choice(BEFORE[kind]) if good or strict and r.random() < 0.4 else r.choice(OTHER)), value


def sample(n: int, seed: int, contexts: list[str] = ()) -> list[dict]:
    """Texts with one candidate of a known kind each, and whether it is personal data; context is a stretch of a real text."""
    r = random.Random(seed)

    def stretch() -> str:
        words = r.choice(contexts).split() if contexts else [r.choice(["und", "the", "de", "la", "of", "ein", "more", "for", "que", "al"]) for _ in range(9)]
        at = r.randrange(max(1, len(words) - 6))
        return " ".join(words[at : at + r.randint(2, 6)])

    out = []
    for i in range(n):
        kind, good = KINDS[i % len(KINDS)], r.random() < 0.5
        before, value = made_up(r, kind, good)
        out.append({"text": f"{stretch()} {before} {value} {stretch()}", "kind": kind, "y": int(good)})
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """(y, kind, h, x) of rows (text, kind, y): the features of each candidate of the row's kind."""
    found = F.flatten(F.array(*[spans(F.col("text"), k) for k in KINDS]))
    each = rows.withColumn("c", F.explode(found)).where(F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.k") + 1) == F.col("kind"))
    features = feature_columns(F.col("c"))
    return each.select("y", "kind", F.xxhash64("text", "c.s").alias("h"), F.array(*[features[f] for f in FEATURES]).alias("x"))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
    """The feature and bound that gain most."""
    best, out = 1e-6, None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1])[:: max(1, len(values) // 24)] / 2:
            left = x[:, f] < bound
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - base
            if gain > best:
                best, out = gain, (f, float(bound))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> list:
    """Trees of depth three for the log loss, as nested (feature, bound, below, above) or leaf values."""

    def grow(rows: np.ndarray, depth: int):
        found = _split(x[rows], g[rows], h[rows]) if depth and len(rows) > 20 else None
        if found is None:
            return rate * _leaf(g[rows], h[rows])
        below = x[rows, found[0]] < found[1]
        return (*found, grow(rows[below], depth - 1), grow(rows[~below], depth - 1))

    out, s = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, p * (1 - p)
        out.append(grow(np.arange(len(y)), 3))
        s += np.array([value(out[-1], row) for row in x])
    return out


def real_candidates(docs: DataFrame) -> DataFrame:
    """What the generators propose in real documents: (text around it, kind, y), base spans true, the others not.

    The documents that the package was fitted to hold personal data of the base kinds only.
    """
    text = F.col("text")
    found = docs.select(text, F.explode(F.flatten(F.array(*[spans(text, k) for k in KINDS]))).alias("c"))
    at = F.greatest(F.lit(1), F.col("c.s") - 60)
    around = F.substring(text, at, F.col("c.e") - F.col("c.s") + 120)
    return found.select(around.alias("text"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.k") + 1).alias("kind"), (F.col("c.k") < len(BASE)).cast("int").alias("y"))


def fit(spark: SparkSession, docs: DataFrame) -> dict:
    texts = docs.where("length(text) > 200").orderBy(F.xxhash64("text")).select("text").limit(CONTEXTS)
    contexts = [r.text for r in texts.collect()]
    rows = spark.createDataFrame([(s["text"], s["kind"], s["y"]) for s in sample(SAMPLE, 11, contexts)], "text string, kind string, y int")
    got = candidates(rows.unionByName(real_candidates(texts))).collect()
    got.sort(key=lambda r: (r.h, r.kind, r.y))
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    first = np.arange(len(y)) % 2 == 0
    trees = boost(x[first], y[first])
    score = np.array([sum(value(t, row) for t in trees) for row in x])
    bounds = {}
    for k in KINDS:
        own = ~first & (np.array([r.kind for r in got]) == k)
        order = np.argsort(-score[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        enough = np.flatnonzero(right >= PRECISION)
        bounds[k] = round(max(0.0, float(score[own][order][enough[-1]])), 6) if len(enough) else 1e9

    def short(t):
        return [t[0], t[1], short(t[2]), short(t[3])] if isinstance(t, tuple) else round(t, 6)

    return {"features": list(FEATURES), "trees": [short(t) for t in trees], "bounds": bounds}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    fitted = fit(session, session.read.parquet(sys.argv[1]))
    Path(__file__).with_name("pii_model.json").write_text(json.dumps(fitted, separators=(",", ":")) + "\n")
    print(fitted["bounds"])
