"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans of many kinds that may overlap, the base kinds (email, ip, card, phone) among
them. Boosted trees score every candidate by its form and its context. A candidate is redacted if its score reaches
the calibrated threshold of its kind; of the further kinds, only such candidates are finds, and only where no better
find overlaps them nor any base span but one that lies inside them (as an email does in a login address). Base spans are always finds, as their patterns and checks fix them; the trees
say of each whether it would be redacted.

The trees come with the package (``pii_model.json``); ``pii_model.py`` fits them to a bounded sample and writes the
file. They are applied as one column expression over an array of features, which each candidate has computed once.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "spelled_email", "local_phone", "ipv6", "national_phone", "date", "mac", "handle", "coordinates", "wallet", "street", "id_number", "login_url")
KINDS = (*BASE, *MORE)

#: Fixed values. The base patterns, written so that a run of characters is entered at its start only and never
#: given back: \G or a look-behind says where a match may start. What they find is what the plain patterns find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24}){1,3}",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "national_phone": r"(?<![0-9A-Za-z+.,:/-])0[1-9][0-9]{1,4}[\x20/-]?[0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3}+(?![0-9A-Za-z-])",
    "date": r"(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9/-])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z][A-Za-z0-9_]{2,29}+(?![@.-]*[A-Za-z0-9])",
    "coordinates": r"(?<![0-9.-])-?[0-9]{1,2}\.[0-9]{4,8},\x20?-?[0-9]{1,3}\.[0-9]{4,8}(?![0-9])",
    "wallet": r"(?<![A-Za-z0-9])(?:0x[0-9a-fA-F]{40}|(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59})(?![A-Za-z0-9])",
    "street": r"(?<![A-Za-z0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{2,20}\x20){1,2}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct)(?![A-Za-z])",
    "id_number": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])",
    "login_url": r"(?<![A-Za-z])[a-z]{2,10}://[^\s/:@]{1,64}:[^\s/@]{1,64}@[A-Za-z0-9.-]{1,253}",
}
#: What a text must contain for a match of a kind, found faster than the pattern.
HINTS = {
    "email": "@", "phone": "+", "handle": "@", "login_url": "://", "spelled_email": "at", "ipv6": ":",
}
CONTEXT = 32
CUES = {
    "cue_phone": r"(?i)(?:tel|phone|call|mobile|fax|whatsapp)",
    "cue_mail": r"(?i)(?:mail|contact|write to|reach)",
    "cue_id": r"(?i)(?:ssn|social|security|tax|passport|licence|license|identity)",
    "cue_bank": r"(?i)(?:iban|bank|account|transfer|payee|card|visa|paid)",
    "cue_host": r"(?i)(?:address|host|server|login|device|client)",
    "cue_birth": r"(?i)(?:born|birth|dob|aged)",
    "cue_social": r"(?i)(?:follow|twitter|instagram|handle|profile|message)",
    "cue_place": r"(?i)(?:lives|home|address|located|moved|house|position)",
    "cue_wallet": r"(?i)(?:wallet|btc|bitcoin|eth|donate|send)",
    "cue_number": r"(?i)(?:version|isbn|order|invoice|part|item|ref|build|chapter|section|model|serial|commit|class|published|updated|release)",
}
FEATURES = (*(f"is_{k}" for k in KINDS), "digits", "letters", "size", "groups", "distinct", "check", "glued", "followed", *CUES)

#: Spans that are looked through together: a list of n is searched in steps of n / BLOCK.
BLOCK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The check that a match of a kind must pass."""
    if kind == "ip":
        small = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
        return m.rlike(small)
    if kind == "card":
        n = F.length(digits_of(m))
        return F.when(n.between(12, 19), luhn(digits_of(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<s:int,k:int,e:int,m:string,lead:string,after:string>>"


def bound(value: Column, fn) -> Column:
    """fn(value) with value computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def blocks(items: Column, fold) -> Column:
    """fold(slice, index of the slice) of each stretch of BLOCK items, as an array; null for no items. items must be bound or a column."""
    n = F.ceil(F.size(items) / BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda b: bound(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), lambda xs: fold(xs, b)))
    return F.when(n > 0, each)


def starts(lengths: Column) -> Column:
    """For each of an array of lengths, the sum of those before it; in n * BLOCK steps, not in n * n."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def within(xs: Column, before: Column) -> Column:
        return bound(before, lambda at: F.transform(xs, lambda _, i: at + total(F.slice(xs, F.lit(1), i))))

    def of(every: Column) -> Column:
        return bound(blocks(every, lambda xs, _: total(xs)), lambda sums: F.flatten(blocks(every, lambda xs, b: within(xs, total(F.slice(sums, F.lit(1), b))))))

    return bound(lengths, of)


def spans(text: Column, kind: str) -> Column:
    """The matches of a kind as structs (s start, k kind number, e end, m text, lead, after), in code points.

    The stretches between matches and the matches themselves come in turn, so their lengths add up to positions.
    lead is what stands before a match, up to CONTEXT characters and back to the start of the match before it; after
    is the character behind it. Both are taken from these stretches, so that no text is gone through once a match.
    """
    pattern, number = PATTERNS[kind], KINDS.index(kind)

    def placed(m: Column) -> Column:
        def at(gaps: Column) -> Column:
            before = starts(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x)))
            near = F.transform(m, lambda x, i: F.struct(x.alias("m"), F.get(gaps, i).alias("gap"), F.coalesce(F.get(m, i - 1), F.lit("")).alias("last"), F.concat(F.get(gaps, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))).alias("next")))

            def one(b: Column, o: Column) -> Column:
                s = b + F.length(o["gap"])
                lead = F.right(F.concat(o["last"], o["gap"]), F.lit(CONTEXT))
                return F.struct(s.alias("s"), F.lit(number).alias("k"), (s + F.length(o["m"])).alias("e"), o["m"].alias("m"), lead.alias("lead"), F.substring(o["next"], 1, 1).alias("after"))

            return F.zip_with(before, near, one)

        return bound(F.split(text, pattern, -1), at)

    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]")
    return F.when(hint & text.rlike(pattern), F.filter(found, lambda x: valid(kind, x["m"]))).otherwise(F.array().cast(_SPAN))


def feature_columns(span: Column) -> dict[str, Column]:
    """The features of a candidate: its form, and what stands around it."""
    m, lead = span["m"], span["lead"]
    digits = digits_of(m)
    out = {f"is_{k}": (span["k"] == i).cast("double") for i, k in enumerate(KINDS)}
    out["digits"] = F.length(digits).cast("double")
    out["letters"] = F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double")
    out["size"] = F.length(m).cast("double")
    out["groups"] = F.size(F.split(m, "[^A-Za-z0-9]+")).cast("double")
    out["distinct"] = F.size(F.array_distinct(F.split(F.lower(F.regexp_replace(m, "[^A-Za-z0-9]", "")), ""))).cast("double")
    checks = {
        "iban": iban_valid(m), "ssn": ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), "ip": ~m.rlike(r"^0|\.0[0-9]|^(?:22[4-9]|2[3-9][0-9])"),
        "email": ~m.rlike(r"(?i)@[0-9]+x\.|\.(?:png|jpe?g|gif|svg|js|css|py|local)$"), "phone": ~m.rlike(r"^\+(?:0|1[\x20(.-]*[01])|(?:000|999)"), "coordinates": m.rlike(r"^-?[0-8]?[0-9]\."),
        "date": m.rlike(r"(?:19[2-9]|200|201)"), "mac": ~m.rlike("(?i)^(?:00[:-]00|ff[:-]ff)"), "wallet": m.rlike("[0-9].*[a-zA-Z]|[a-zA-Z].*[0-9]"), "street": ~m.rlike(r"\x20(?:The|This|That|One|Some)\x20"),
    }
    check = reduce(lambda acc, kv: acc.when(span["k"] == KINDS.index(kv[0]), kv[1]), checks.items(), F.when(F.lit(False), F.lit(True)))
    out["check"] = check.otherwise(F.lit(True)).cast("double")
    out["glued"] = lead.rlike(r"[A-Za-z0-9_/#=]\z").cast("double")
    out["followed"] = span["after"].rlike("[A-Za-z0-9_/=]").cast("double")
    for name, cue in CUES.items():
        out[name] = lead.rlike(cue).cast("double")
    return out


def iban_valid(m: Column) -> Column:
    """The remainder check of an IBAN: letters as numbers, four first characters last, 1 modulo 97."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


# --- the trees ----------------------------------------------------------------------------------------------


def value(tree, row) -> float:
    """What a tree (feature, bound, below, above) or leaf gives for a row of features."""
    while isinstance(tree, (list, tuple)):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def tree_sql(tree, features: str) -> str:
    if not isinstance(tree, (list, tuple)):
        return f"{float(tree)!r}D"
    f, bar, below, above = tree
    return f"if({features}[{f}] < {float(bar)!r}D, {tree_sql(below, features)}, {tree_sql(above, features)})"


@lru_cache
def model() -> tuple[list, dict[str, float]]:
    """The trees, and for each kind the least score at which a candidate is redacted."""
    stored = json.loads(Path(__file__).with_name("pii_model.json").read_text())
    if tuple(stored["features"]) != FEATURES:
        raise ValueError("pii_model.json is of other features: run python -m lumenframe.llm.pii_model")
    return stored["trees"], stored["bounds"]


# --- the operator -------------------------------------------------------------------------------------------


def _joined(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(items, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def scored(rows: DataFrame, column: str) -> DataFrame:
    """rows with the candidates in column scored (a probability) and whether they are redacted; each has its features computed once."""
    trees, bounds = model()
    least = F.create_map(*[x for k, b in bounds.items() for x in (F.lit(KINDS.index(k)), F.lit(b))])

    def features(c: Column) -> Column:
        every = feature_columns(c)
        return F.struct(c.alias("c"), F.array(*[every[f] for f in FEATURES]).alias("x"))

    def decided(o: Column) -> Column:
        c = o["c"]
        return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["m"].alias("m"), (1 / (1 + F.exp(-o["z"]))).alias("score"), (o["z"] >= F.element_at(least, c["k"])).alias("redact"))

    rows = rows.withColumn(column, F.transform(column, features))
    rows = rows.withColumn(column, F.expr(f"transform({column}, o -> struct(o.c as c, {' + '.join(tree_sql(t, 'o.x') for t in trees)} as z))"))
    return rows.withColumn(column, F.transform(column, decided))


def in_blocks(items: Column) -> Column:
    """Sorted spans as blocks with the least start and the greatest end of each, null for none."""
    return blocks(items, lambda xs, _: F.struct(F.array_min(F.transform(xs, lambda x: x["s"])).alias("lo"), F.array_max(F.transform(xs, lambda x: x["e"])).alias("hi"), xs.alias("xs")))


def overlaps(parts: Column, c: Column, beats=None) -> Column:
    """Whether a span of the blocks overlaps c and, where beats is given, beats it."""

    def hit(o: Column) -> Column:
        both = (o["s"] < c["e"]) & (c["s"] < o["e"])
        return both if beats is None else both & beats(o, c)

    return F.coalesce(F.exists(parts, lambda b: (b["lo"] < c["e"]) & (c["s"] < b["hi"]) & F.exists(b["xs"], hit)), F.lit(False))


def better(o: Column, c: Column) -> Column:
    return (o["score"] > c["score"]) | (o["score"] == c["score"]) & ((o["s"] < c["s"]) | (o["s"] == c["s"]) & (o["k"] < c["k"]))


def not_inside(o: Column, c: Column) -> Column:
    return (o["s"] < c["s"]) | (o["e"] > c["e"]) | (o["s"] == c["s"]) & (o["e"] == c["e"])


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of every row: (id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_redact, found).

    spans joins kind:start:end of all finds by start, in code points; found has them as structs with their text,
    their score and whether they are redacted. base_sha256 is of the base kinds alone. n_more counts finds of the
    further kinds, n_redact the finds that are redacted. Null counts as empty; texts without finds have a row with
    zeros; repeated rows each have theirs; ids of any type, null included, are passed on; other columns are not
    read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    rows = rows.select("__id", "__text", *[spans(text, k).alias(f"__{k}") for k in KINDS])
    base, rest = (F.array_sort(F.concat(*[f"__{k}" for k in kinds])) for kinds in (BASE, MORE))
    rows = rows.select("__id", "__text", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], base.alias("__base"), rest.alias("__rest"))
    around = bound(in_blocks(F.col("__base")), lambda parts: F.filter("__rest", lambda c: ~overlaps(parts, c, not_inside)))
    rows = rows.withColumn("__able", F.when(F.size("__rest") > 0, around).otherwise(F.col("__rest"))).withColumn("__fixed", F.col("__base"))
    rows = scored(scored(rows, "__fixed"), "__able").withColumn("__able", F.filter("__able", lambda c: c["redact"]))
    alone = bound(in_blocks(F.col("__able")), lambda parts: F.filter("__able", lambda c: ~overlaps(parts, c, better)))
    rows = rows.withColumn("__more", F.when(F.size("__able") > 1, alone).otherwise(F.col("__able")))
    rows = rows.withColumn("__all", F.array_sort(F.concat("__fixed", "__more")))
    return rows.select(
        F.col("__id").alias(id_col),
        *[f"n_{k}" for k in BASE],
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("__all")).alias("spans"),
        F.size("__more").cast("long").alias("n_more"),
        F.size(F.filter("__all", lambda c: c["redact"])).cast("long").alias("n_redact"),
        F.col("__all").alias("found"),
    )
