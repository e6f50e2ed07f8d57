"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment.

A sketch takes the few least of a document's occurrence-labelled shingles under one hash order and keeps them in
the order of the text, so two documents agree on it only if they share these shingles in the same order. Sharing
one sketch makes two documents candidates. A link is a candidate pair whose words align with at most
``1 - similarity`` edits for each word of the longer one; nothing else decides. Classes are the connected components of the links.

Before a pair is aligned it must pass two tests that no link can fail: the lengths differ by no more than the edits
allowed, and the texts share enough pairs of neighbouring words (an edit touches at most two of them).

Candidates aren't all emitted: (1) texts with equal words are one representative; (2) every member of a sketch's
bucket is compared with the bucket's leader, which closes groups of copies in linear work; (3) in buckets that still
hold several components, only texts are kept that have one of their rarest pairs of neighbouring words in common with
another component: a link shares so many pairs that one of these is among them; (4) the members of a bucket outside
its main component, the one with most of its rows, are compared with a few inside; (5) the main component and the
others are cut into blocks of bounded size, and each pair of blocks that holds others is compared in one task, which
keeps the pairs to itself and returns only links. A component that is the main one of many buckets meets all their
others at once where that sends fewer rows. No bucket is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .alignment import banded_distance, trimmed
from .shared import arrow_map, forget, join_checked, materialise, mix, normal_words, text_digest, windows, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 64  # a pair with a fifth of its words changed, scattered evenly, shares none of them one time in eight; with a seventh, once in hundreds
ORDERED = 2
GRAM = 2  # words of a run by which pairs are tested before they are aligned
BLOCK_DOCS, BLOCK_WORDS = 256, 1_000_000
#: A group of copies has the same few leaders in all its buckets: one for each of so many classes of keys.
LEADERS, TURN = 4, 0x2545F4914F6CDD1D >> 2
#: Members of a bucket's main component with which the others of a bucket are compared before blocks are.
DELEGATES = 4


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a repeated run has the number of its earlier occurrences mixed in.

    The first occurrence keeps its plain hash, so that a text with repeats shares it with one without.
    """
    x = windows(words, k)
    order = np.argsort(x, kind="stable")
    y = x[order]
    repeat = y[1:] == y[:-1]
    if repeat.any():
        at = np.arange(len(y))
        first = np.maximum.accumulate(np.where(np.concatenate(([False], repeat)), 0, at))
        seen = np.empty(len(y), np.uint64)
        seen[order] = (at - first).astype(np.uint64)
        x = np.where(seen == 0, x, mix(x + seen * np.uint64(0x9E3779B97F4A7C15)))
    return x


def order_sketches(x: np.ndarray, sketches: int, ordered: int) -> np.ndarray:
    """A key per sketch: the ``ordered`` least labelled shingles of its hash order, combined in text order."""
    if len(x) == 0:
        return np.zeros(0, np.int64)
    seeds = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64))
    take = min(ordered, len(x))
    keys = np.empty(sketches, np.uint64)
    step = max(1, 100_000 // len(x))  # hashes at once, few enough to stay in the processor's cache
    for s in range(0, sketches, step):
        n = min(step, sketches - s)
        h = (x[None, :] ^ seeds[s : s + n, None]) * (seeds[sketches + s : sketches + s + n, None] | np.uint64(1))
        rows, at = np.arange(n), np.empty((n, take), np.int64)
        for t in range(take):
            at[:, t] = h.argmin(axis=1)
            h[rows, at[:, t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        key = np.arange(s + 1, s + n + 1, dtype=np.uint64)
        for t in range(take):
            key = mix(key * np.uint64(0xBF58476D1CE4E5B9) + x[at[:, t]])
        keys[s : s + n] = key
    return keys.view(np.int64)


def budget(n: int, similarity: float) -> int:
    """The edits that a link may have whose longer text has n words."""
    return int((1 - similarity) * n + 1e-9)


def edits(a: np.ndarray, b: np.ndarray, similarity: float) -> int | None:
    """The words to change, add or drop to turn a into b; None where there are more than the similarity allows.

    The band begins narrow and grows, so that alike texts cost little whatever their length.
    """
    most = budget(max(len(a), len(b)), similarity)
    a, b = trimmed(a, b)
    band = 16
    while True:
        band = min(band, most)
        found = banded_distance(a, b, band)
        if found <= band:
            return found
        if band == most:
            return None
        band *= 4


def least_common(n: int, similarity: float) -> int:
    """How many labelled runs of GRAM words a link at least shares whose longer text has n words."""
    return n - GRAM + 1 - GRAM * budget(n, similarity)


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> int | None:
    """The edits between the words a and b where they link, else None."""
    n = max(len(a), len(b))
    if n - min(len(a), len(b)) > budget(n, similarity):
        return None
    if len(np.intersect1d(labelled(a, GRAM), labelled(b, GRAM), assume_unique=True)) < least_common(n, similarity):
        return None
    return edits(a, b, similarity)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, k: int, sketches: int, ordered: int) -> DataFrame:
    """(uid, id, digest, seq, n, words, keys) of each row.

    digest is of the text as it is and seq of its words, n the number of words, words the words with a space between them.
    """
    schema = pa.schema(
        [("uid", pa.int64()), ("id", pa.int64()), ("digest", pa.binary()), ("seq", pa.binary()), ("n", pa.int32()), ("words", pa.binary()), ("keys", pa.list_(pa.int64()))]
    )

    def sketch(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema}
        for text in batch.column("text"):
            norm = normal_words(text.as_py())
            words = word_hashes(norm)
            out["seq"].append(hashlib.blake2b(norm, digest_size=16).digest())
            out["n"].append(len(words))
            out["words"].append(norm)
            out["keys"].append(order_sketches(labelled(words, k), sketches, ordered))
        return out | {c: batch.column(c) for c in ("uid", "id", "digest")}

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
    return rows.mapInArrow(arrow_map(sketch, schema), "uid long, id long, digest binary, seq binary, n int, words binary, keys array<long>")


def _verify_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) that are links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])

    def verify(batch: pa.RecordBatch) -> dict:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        found = []
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            d = linked(word_hashes(x.as_py()), word_hashes(y.as_py()), similarity)
            if d is not None:
                found.append((a[i], b[i], d))
        return {f.name: [r[j] for r in found] for j, f in enumerate(schema)}

    x, y = (texts.select(F.col("uid").alias(i), F.col("words").alias(w)) for i, w in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(arrow_map(verify, schema), "a long, b long, distance int")


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])


def _block_links(rows: list[tuple], similarity: float) -> list[tuple]:
    """Links (a, b, distance, component of a, component of b) between components from one pair of blocks.

    rows: (uid, comp, side, open keys, words, (whole, key, lo, hi)). Rows of two blocks are compared across sides,
    those of one block with each other. A pair is the work of the least bucket that both are in; where whole, key is
    a component whose buckets are compared at once, and a pair need only share some bucket.
    """
    comps = [r[1] for r in rows]
    side = np.array([r[2] for r in rows])
    whole, key, lo, hi = rows[0][5]
    words = [word_hashes(r[4]) for r in rows]
    lengths = np.array([len(w) for w in words])
    grams = [labelled(w, GRAM) for w in words]
    sizes = np.array([len(x) for x in grams])
    names, codes = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for first in range(0, len(names), 4096):
        s, e = np.searchsorted(codes, [first, first + 4096])
        dense = np.zeros((len(rows), min(4096, len(names) - first)), np.float32)
        dense[owner[s:e], codes[s:e] - first] = 1
        common += dense @ dense.T
    longer = np.maximum(lengths[:, None], lengths[None, :])
    allowed = np.floor((1 - similarity) * longer + 1e-9)
    near = (common >= longer - GRAM + 1 - GRAM * allowed) & (np.abs(lengths[:, None] - lengths[None, :]) <= allowed)
    comp = np.unique(comps, return_inverse=True)[1]
    near &= comp[:, None] != comp[None, :]
    if lo != hi:
        near &= side[:, None] != side[None, :]
    root = {c: c for c in comps}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        x, y = top(comps[i]), top(comps[j])
        if x != y and (common_keys := set(rows[i][3]) & set(rows[j][3])) and (whole or min(common_keys) == key):
            d = edits(words[i], words[j], similarity)
            if d is not None:
                root[x] = y
                out.append((rows[i][0], rows[j][0], d, comps[i], comps[j]))
    return out


def least_shared(n: int, similarity: float) -> int:
    """How many labelled runs of GRAM words a text of n words at least shares with any text as long or longer that it links to."""
    longer = np.arange(n, int(n / similarity) + 2)
    return int((longer - GRAM + 1 - GRAM * np.floor((1 - similarity) * longer + 1e-9)).min())


def _alike(held: DataFrame, similarity: float) -> DataFrame:
    """The components (comp) of held (uid, comp, words) of which a text shares one of its rarest runs with another: no other can link.

    With the runs of GRAM words in one order for all texts, two texts that link share one that isn't among the last
    ``least_shared - 1`` of either. Last come the runs that most texts hold, so texts that have a passage or frequent
    word pairs in common and little else part here, in work that grows with the number of words.
    """

    def runs(batch: pa.RecordBatch) -> dict:
        words = [word_hashes(w.as_py()) for w in batch.column("words")]
        found, leave = [labelled(w, GRAM) for w in words], [least_shared(len(w), similarity) - 1 for w in words]
        sizes = [len(x) for x in found]
        return {c: np.repeat(batch.column(c).to_numpy(), sizes) for c in ("uid", "comp")} | {"run": np.concatenate(found).view(np.int64), "leave": np.repeat(leave, sizes)}

    schema = pa.schema([("uid", pa.int64()), ("comp", pa.int64()), ("run", pa.int64()), ("leave", pa.int32())])
    every = materialise(held.select("uid", "comp", "words").mapInArrow(arrow_map(runs, schema), "uid long, comp long, run long, leave int"), "runs")
    seen = every.groupBy("run").agg(F.count("*").alias("seen"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("run", "seen")
    last = Window.partitionBy("uid").orderBy(F.desc("seen"), F.desc("run"))
    seen = materialise(seen, "seen")
    told = every.join(seen, "run").withColumn("at", F.row_number().over(last)).where("at > leave").select("comp", "run").distinct()
    told = materialise(told, "told")
    common = materialise(told.groupBy("run").count().where("count > 1").select("run"), "common")
    any_text = every.where("leave < 0").select("comp")  # so short that a link need not share a run
    out = materialise(join_checked(told, common, "run", "left_semi", 16).select("comp").unionByName(any_text).distinct(), "alike")
    forget(every, seen, told, common)
    return out


def near_links(reps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of reps (uid, n, words, keys) that link: (node, comp), and the links (a, b, distance) that join them.

    The links span the components: two texts that a chain of found links joins already aren't compared again.
    """
    buckets = reps.select("uid", "n", F.explode("keys").alias("key"))
    turn = F.pmod("key", F.lit(LEADERS)) * F.lit(TURN)  # another order of the rows for each of a few classes of keys, which gives the row back
    stats = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min(F.col("uid").bitwiseXOR(turn)).alias("least")).where("members > 1")
    stats = materialise(stats.select("key", "members", F.col("least").bitwiseXOR(turn).alias("lead")), "stats")
    shared = materialise(buckets.join(stats, "key"), "buckets")

    texts = reps.select("uid", "n", "words")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of rows."""
        once = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        x, y = (texts.select(F.col("uid").alias(i), F.col("n").alias(n)) for i, n in (("a", "m"), ("b", "n")))
        able = once.join(x, "a").join(y, "b").where(F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9).select("a", "b")
        able = materialise(able, "able")
        ends = materialise(able.select(F.col("a").alias("uid")).unionByName(able.select(F.col("b").alias("uid"))).distinct(), "ends")
        out = materialise(_verify_pairs(able, join_checked(texts, ends, "uid", "left_semi", 16), similarity), "links")
        forget(once, able, ends)
        return out

    edges = verified(shared.where(F.col("uid") != F.col("lead")).select(F.col("uid").alias("a"), F.col("lead").alias("b")))
    comps = components(edges.select("a", "b"))
    name = comps.select(F.col("node").alias("uid"), "comp")
    members = join_checked(shared.where("members > 2"), name, "uid", "left", 24).select("key", "uid", "n", (F.col("uid") == F.col("lead")).alias("leads"), F.coalesce("comp", "uid").alias("comp"))
    members = materialise(members, "members")

    def mixed(members: DataFrame) -> DataFrame:
        """The rows of the buckets that hold several components, and main: the component with most of a bucket's rows, if any."""
        members = members.select("key", "uid", "n", "leads", "comp")
        held = members.groupBy("key", "comp").agg(F.count("*").alias("rows"))
        held = held.groupBy("key").agg(F.count("*").alias("comps"), F.sum("rows").alias("all"), F.max(F.struct("rows", "comp")).alias("most")).where("comps > 1")
        held = materialise(held.select("key", F.when(F.col("most.rows") * 2 > F.col("all"), F.col("most.comp")).alias("main")), "mixed")
        inner = F.coalesce(F.col("comp") == F.col("main"), F.lit(False)).alias("inner")
        out = materialise(join_checked(members, held, "key", "inner", 24).select("key", "uid", "n", "leads", "comp", "main", inner), "both")
        forget(held)
        return out

    both = mixed(members)
    keys = materialise(both.groupBy("uid", "comp").agg(F.collect_list("key").alias("open")), "keys")  # at most a key per sketch
    held = materialise(join_checked(texts, keys, "uid", "inner", 24 + 8 * F.size("open")), "held")
    alike = _alike(held, similarity)
    every, both = both, mixed(join_checked(both, alike, "comp", "left_semi", 16))
    forget(members, keys, alike, every)
    orders = [F.lit((j + 1) * TURN >> 3) for j in range(DELEGATES)]
    delegates = both.where(F.col("inner") & ~F.col("leads")).groupBy("key").agg(*[F.min(F.col("uid").bitwiseXOR(t)).bitwiseXOR(t).alias(f"d{j}") for j, t in enumerate(orders)])
    delegates = materialise(delegates.select("key", F.explode(F.array_distinct(F.array(*[f"d{j}" for j in range(DELEGATES)]))).alias("b")), "delegates")
    late = verified(both.where(~F.col("inner")).select("key", F.col("uid").alias("a")).join(delegates, "key").select("a", "b"))
    forget(delegates)
    if late.take(1):
        x, y = (name.select(F.col("uid").alias(i), F.col("comp").alias(c)) for i, c in (("a", "x"), ("b", "y")))
        ends = late.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        over = components(ends)
        name = _joined_up(name, over).select(F.col("node").alias("uid"), "comp")
        again = over.select(F.col("node").alias("comp"), F.col("comp").alias("final"))
        apart, both = both, mixed(join_checked(both, again, "comp", "left", 16).withColumn("comp", F.coalesce("final", "comp")))
        forget(apart, over)

    def parts(of: Column) -> Column:
        docs, words = F.count(F.when(of, True)), F.sum(F.when(of, F.col("n").cast("long")).otherwise(0))
        return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(words / BLOCK_WORDS)).cast("int")

    sized = (F.count(F.when(F.col("inner"), True)).alias("ours"), F.count(F.when(~F.col("inner"), True)).alias("theirs"), parts(F.col("inner")).alias("mains"), parts(~F.col("inner")).alias("others"))
    dealt = both.where(~F.col("leads"))
    spread = materialise(dealt.groupBy("key", "main").agg(*sized), "spread")
    cost = F.col("ours") * F.col("others") + F.col("theirs") * F.col("mains")  # rows sent to compare a main component with others
    apart = spread.groupBy("main").agg(F.sum(cost).alias("apart"))
    sides = dealt.where("main is not null").select("main", "uid", "n", "comp", "inner").distinct()
    whole = materialise(sides.groupBy("main").agg(*sized).join(apart, "main").where(cost < F.col("apart")).select("main", "mains", "others"), "whole")
    still = join_checked(dealt, spread.select("key", "mains", "others"), "key", "inner", 24)
    block = F.pmod(F.xxhash64("uid", "key"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))).cast("int").alias("block")

    def meet(rows: DataFrame, whole: bool, blocks: Column) -> DataFrame:
        rows = rows.select("key", "uid", "comp", "inner", "mains", "others", block)
        return rows.select(F.lit(whole).alias("whole"), "key", "uid", "comp", F.explode(blocks).alias("t")).select("whole", "key", "t.lo", "t.hi", "t.side", "uid", "comp")

    across = F.expr(
        "if(inner, transform(sequence(0, others - 1), j -> struct(block as lo, -1 - j as hi, 0 as side)), transform(sequence(0, mains - 1), i -> struct(i as lo, -1 - block as hi, 1 as side)))"
    )
    among = F.expr("transform(sequence(0, others - 1), j -> struct(least(block, j) as lo, greatest(block, j) as hi, if(block > j, 1, 0) as side))")
    some = join_checked(still.where("mains > 0 and others > 0"), whole, "main", "left_anti", 16)
    every = join_checked(sides, whole, "main", "inner", 24).where("mains > 0 and others > 0").withColumn("key", F.col("main"))
    dealt = meet(still.where(~F.col("inner")), False, among).unionByName(meet(some, False, across)).unionByName(meet(every, True, across))
    group = ("whole", "key", "lo", "hi")
    together = dealt.join(held.select("uid", "open", "words"), "uid").repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        rows, at = [], None
        out = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in group]
            rest = [batch.column(c).to_pylist() for c in ("uid", "comp", "side", "open", "words")]
            for i, now in enumerate(zip(*cols, strict=True)):
                if now != at:
                    if len(rows) > 1:
                        out += _block_links(rows, similarity)
                    rows, at = [], now
                rows.append((*(c[i] for c in rest), now))
            yield _link_batch(out)
            out = []
        if len(rows) > 1:
            yield _link_batch(_block_links(rows, similarity))

    more = materialise(together.mapInArrow(compare, "a long, b long, distance int, x long, y long"), "more")
    out = _joined_up(name, components(more.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    links = materialise(edges.unionByName(late).unionByName(more.select("a", "b", "distance")).distinct(), "found")
    forget(stats, shared, edges, late, comps, both, held, spread, whole, more)
    return out, links


def _joined_up(name: DataFrame, over: DataFrame) -> DataFrame:
    """(node, comp) of the rows of name (uid, comp) after components (node, comp) over the old components joined some."""
    again = over.select(F.col("node").alias("comp"), F.col("comp").alias("final"))
    known = name.unionByName(over.select(F.col("node").alias("uid"), F.col("node").alias("comp")).join(name.select("uid"), "uid", "left_anti"))
    return materialise(known.join(again, "comp", "left").select(F.col("uid").alias("node"), F.coalesce("final", "comp").alias("comp")), "classes")


def _link_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], f.type) for i, f in enumerate(LINK)], schema=LINK)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """Near-duplicate class of every row of docs: (id_col, class_id, class_size, kept, links, nearest, text_digest).

    class_id is the largest id of the class and kept marks its row; of repeated rows with that id, one is kept.
    links is the number of other texts to which a verified link joins this row's text, nearest the fewest word edits
    of such a link (null without one). Links span the class; a pair whose texts other links join already may be left
    out, so links counts those that were needed, and rows of equal words share it. text_digest is the MD5 of the text.

    Words are lower-cased and split at white space; texts of equal words are one class whatever their length, so
    null, empty and blank texts are one class of their own. A text of fewer than k words has one shingle, all its
    words, and so links only to equal texts. Ids are cast to long. A null id counts as the smallest. Other columns
    are not read; an empty table gives an empty result.
    """
    member, links = _members(docs, id_col, text_col, k, similarity, sketches, ordered)
    classes = member.groupBy("class").agg(F.max(F.struct("id", "uid")).alias("best"), F.count("*").alias("size")).where("size > 1")
    classes = materialise(classes.select("class", F.col("best.id").alias("top_id"), F.col("best.uid").alias("top_uid"), "size"), "sizes")
    ends = links.select(F.col("a").alias("rep"), "distance").unionByName(links.select(F.col("b").alias("rep"), "distance"))
    degree = materialise(ends.groupBy("rep").agg(F.count("*").alias("links"), F.min("distance").alias("nearest")), "degrees")
    out = join_checked(join_checked(member, classes, "class", "left", 40), degree, "rep", "left", 32)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("top_uid", "uid") == F.col("uid")).alias("kept"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        "nearest",
        F.lower(F.hex("digest")).alias("text_digest"),
    )


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """The verified links between different texts that span the classes: (a_id, b_id, distance).

    Each end is the largest id among the rows of that text, a_id the lesser; distance is in words. Cases as in near_duplicates.
    """
    member, links = _members(docs, id_col, text_col, k, similarity, sketches, ordered)
    ids = member.where("uid = rep").select("uid", "id")
    named = links.join(ids.select(F.col("uid").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("uid").alias("b"), F.col("id").alias("q")), "b")
    return named.select(F.least("p", "q").alias("a_id"), F.greatest("p", "q").alias("b_id"), "distance")


def _members(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float, sketches: int, ordered: int) -> tuple[DataFrame, DataFrame]:
    """(uid, id, digest, rep, class) of every row, rep the uid of the row that stands for its words; and the links."""
    table = materialise(sketch_documents(docs, id_col, text_col, k, sketches, ordered), "sketches")
    groups = table.groupBy("seq").agg(F.max(F.struct("id", "uid")).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialise(groups.select("seq", F.col("best.uid").alias("rep")), "equal")
    plain = table.select("uid", "id", "digest", "seq")
    owner = join_checked(plain, groups, "seq", "left", 32).select("uid", "id", "digest", F.coalesce("rep", "uid").alias("rep"))
    owner = materialise(owner, "owners")
    copies = materialise(owner.where("uid <> rep").select("uid"), "copies")
    reps = join_checked(table.select("uid", "n", "words", "keys"), copies, "uid", "left_anti", 16)

    comps, links = near_links(reps, similarity)
    to = comps.select(F.col("node").alias("rep"), "comp")
    member = join_checked(owner, to, "rep", "left", 24).select("uid", "id", "digest", "rep", F.coalesce("comp", "rep").alias("class"))
    member = materialise(member, "members")
    forget(table, groups, owner, copies, comps)
    return member, links
