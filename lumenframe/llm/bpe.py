"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The state of a trie node is the last token of the encoding of the bytes on its path. A token ends an encoding if
it is a suffix of the path and may follow the last token of the path before it, so a node's state needs only the
states above it, and a prefix that many words share is encoded once. A word's tokens are read off by following the
last tokens back to the root.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import process_cache

#: Fixed value: how the byte-level pre-tokeniser splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of what a worker remembers: encoded stretches of text (the lately used ones once more), and checked pairs.
MARKS = ".,;:!?"  # few enough that runs of them are few
KEEP_WORDS, KEEP_PAIRS = 120_000, 500_000
TRIE_CHARS = 2_000_000  # texts of about this many characters share a trie


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """The ids of stretches of text, with those of before in ``older``.

    Asked for one that is in neither, it gives an empty list, which is filled in when the words that ``new`` names
    are learned.
    """

    def __init__(self, older: dict[str, tuple[int, ...]]):
        self.older = dict(older)
        self.new: dict[str, list[int]] = {}

    def __missing__(self, w: str):
        ids = self.older.get(w)
        if ids is None:
            ids = self.new[w] = []
        self[w] = ids
        return ids

    def lookup(self, w: str) -> tuple[int, ...] | None:
        ids = self.get(w)
        return ids if ids.__class__ is tuple else self.older.get(w)


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.id = {t: i for i, t in self.token.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: its rank and the two tokens it is made of
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = (r, whole)
            self.parts.setdefault(whole, (r, vocab[left], vocab[right]))
        self.size = {i: len(t) for i, t in self.token.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.added.items()}
        self.text = {i: str(i) for i in self.token}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(SPLIT)
        self.runs_of_space = re.compile(r"\s\s|\A\s|\s\Z")
        self.many = max(self.token) + 1
        # States of the walk: the suffixes of paths that start a token, numbered, 0 the empty one.
        self.starts: dict[bytes, int] = {b"": 0}
        for t in self.id:
            for n in range(1, len(t) + 1):
                self.starts.setdefault(t[:n], len(self.starts))
        self.suffix = list(self.starts)
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...], int]] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Known({})
        self.tails: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Drop what was learned from texts, so that an idle worker is small."""
        self.known, self.tails, self.pairs, self.steps = Known({}), {}, {}, {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merging the pair of least rank again and again."""
        ids = [self.id[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best, at = min(((self.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best == 1 << 60:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes; a sequence is valid if all its pairs are.

        The merges that made them are undone at the seam, the latest first. They are not the encoding if the tokens
        that then meet at the seam merge earlier than the merge undone: of equal ranks the left one goes first.
        """
        key, l, r, bound = left * self.many + right, left, right, 1 << 60
        out = True
        while True:
            met = self.rank.get((l, r))
            if met is not None and met[0] < bound:
                out = False
                break
            made_l, made_r = self.parts.get(l), self.parts.get(r)
            if made_l is None and made_r is None:
                break
            if made_r is None or made_l is not None and made_l[0] > made_r[0]:
                bound, l = made_l[0], made_l[2]
            else:
                bound, r = made_r[0] + 1, made_r[1]
        if len(self.pairs) > KEEP_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def follow(self, state: int, b: int) -> tuple[int, tuple[tuple[int, int], ...], int]:
        """After byte b: the longest suffix of the path that starts a token, the longer tokens (size, id) that end it,
        longest first, and the token of the byte alone, which is left if none of them may follow what is before it."""
        path = self.suffix[state] + bytes((b,))
        while path not in self.starts:
            path = path[1:]
        ends = ((len(path) - i, self.id.get(path[i:])) for i in range(len(path) - 1))
        return self.starts[path], tuple((n, t) for n, t in ends if t is not None and self.single(t)), self.id[bytes((b,))]

    def single(self, t: int) -> bool:
        """Whether the token's own bytes are encoded as it."""
        made = self.parts.get(t)
        return made is None or self.may_follow_before(made)

    def may_follow_before(self, made: tuple[int, int, int]) -> bool:
        """Whether the two parts of a token come about before the merge that joins them."""
        return self.merged(self.token[made[1]] + self.token[made[2]]) == [self.rank[made[1], made[2]][1]]

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The tokens of each distinct word, by one depth-first walk over their trie.

        The trie is the sorted list of the words: each word's path leaves that of the word before it where their
        common prefix ends, so the walk backs up to there and goes down the rest of the word.
        """
        out: dict[bytes, tuple[int, ...]] = {}
        steps, pairs, many, size_of = self.steps, self.pairs, self.many, self.size
        last, states = [-1], [0]  # for each depth: the last token of the path so far, and its suffix state
        before, along = b"", 0
        for word in sorted(words):
            depth = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                depth += 1
            if depth < along:
                del last[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            before, along = word, len(word)
            for b in word[depth:]:
                key = state << 8 | b
                if key in steps:
                    state, ends, t = steps[key]
                else:
                    state, ends, t = steps[key] = self.follow(state, b)
                for size, longer in ends:
                    left = last[-size]
                    if left < 0:
                        t = longer
                        break
                    pair = left * many + longer
                    if pairs[pair] if pair in pairs else self.may_follow(left, longer):
                        t = longer
                        break
                last.append(t)
                states.append(state)
            if size_of[t] == along:
                out[word] = (t,)
                continue
            ids, depth = [], along
            while depth:
                t = last[depth]
                ids.append(t)
                depth -= size_of[t]
            ids.reverse()
            out[word] = tuple(ids)
        return out

    def learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of stretches of text that follow a space and hold none.

        Letters with marks behind them are two words, and the letters may be known already.
        """
        tails, lookup, data, marked, mixed = self.tails, self.known.lookup, {}, [], []
        for w in new:
            if w.isalpha():
                data[w] = b" " + w.encode()
                continue
            head = w.rstrip(MARKS)
            if head.isalpha():
                marked.append((w, head, w[len(head) :]))
            else:
                mixed.append(w)
        held = {}
        for _, head, _ in marked:
            if head not in data:
                ids = lookup(head)
                if ids is None:
                    data[head] = b" " + head.encode()
                else:
                    held[head] = ids
        words = self.split.findall(" " + " ".join(mixed)) if mixed else []
        parts = {w: w.encode("utf-8", "replace") for w in words}
        done = self.encode_words([*data.values(), *parts.values()])
        out = {w: done[d] for w, d in data.items()}
        for w, head, tail in marked:
            if tail not in tails:
                tails[tail] = self.encode_plain(tail)
            out[w] = (held[head] if head in held else out[head]) + tails[tail]
        lists: list[tuple[int, ...]] = []
        for w in words:
            if w[0] == " ":
                lists.append(done[parts[w]])
            else:
                lists[-1] += done[parts[w]]
        out.update(zip(mixed, lists, strict=True))
        return out

    def tokens_of(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        data = {w: w.encode("utf-8", "replace") for w in words}
        done = self.encode_words(list(data.values()))
        return {w: done[d] for w, d in data.items()}

    def encode_plain(self, text: str) -> tuple[int, ...]:
        words = self.split.findall(text)
        done = self.tokens_of(set(words))
        return tuple([t for w in words for t in done[w]])

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """Ordinary stretches of text, and added tokens with their id."""
        if self.specials is None or not self.specials.search(text):
            return [(text, None)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.added[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def uneven(self, text: str) -> bool:
        """Whether white space stands beside white space or at an end of text."""
        plain = text.replace("\n", " ")
        if plain.isprintable():  # the blank is the only white space in it
            return "  " in plain or plain[0] == " " or plain[-1] == " "
        return self.runs_of_space.search(text) is not None

    def encode_some(self, texts: list[str]) -> list[list[int]]:
        """The token ids of each text, with one trie for all their words that aren't known yet.

        No word spans a single space between other characters, so a text is cut there and each stretch looked up;
        a text with runs of white space goes to the splitter whole.
        """
        known, cut = self.known, []
        get = known.__getitem__
        for text in texts:
            own = []
            for piece, special in self.pieces(text):
                if special is not None:
                    own.append((special,))
                elif not piece or self.uneven(piece):
                    own.append(self.encode_plain(piece))
                else:
                    parts = piece.split(" ")
                    own.append(self.encode_plain(parts.pop(0)))
                    own += map(get, parts)
            cut.append(own)
        new, known.new = known.new, {}
        learned = self.learn(list(new))
        for w, ids in new.items():
            ids += learned[w]
        out = [list(chain.from_iterable(own)) for own in cut]
        known.update({w: learned[w] for w in new})
        if len(known) > KEEP_WORDS:
            self.known = Known(known)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_some([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def stretches(texts: pa.Array, chars: int):
    """Runs of texts (null is empty) that end when they reach so many characters."""
    some, size = [], 0
    for text in texts:
        text = text.as_py() or ""
        some.append(text)
        size += len(text)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


_KINDS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Encode and decode every text: (id_col, ids, decoded, n_tokens, ids_sha256, decoded_sha256), or some of these.

    vocabulary is the path of a byte-level BPE file of the tokenizers library, read on the driver. Strings of added
    tokens in a text become those tokens. Null is empty; an empty text has no tokens. Other columns are not read;
    repeated rows are encoded each; ids are cast to long and may be null. outputs names the columns wanted beside id_col.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    name = hashlib.sha256(source.value.encode()).hexdigest()
    arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    schema = pa.schema([("id", pa.int64()), *((o, arrow.get(o, pa.string())) for o in outputs)])
    make = {
        "ids": lambda codec, ids: ids,
        "decoded": lambda codec, ids: codec.decode(ids),
        "n_tokens": lambda codec, ids: len(ids),
        "ids_sha256": lambda codec, ids: hashlib.sha256(",".join(map(codec.text.__getitem__, ids)).encode()).hexdigest(),
        "decoded_sha256": lambda codec, ids: hashlib.sha256(codec.decode(ids).encode("utf-8", "replace")).hexdigest(),
    }

    def run(batches):
        codec = process_cache(("bpe", name), lambda: Codec(source.value))
        gc.disable()  # nothing here has cycles, and the many small tuples are what a collection would look through
        try:
            for batch in batches:
                at = 0
                for some in stretches(batch.column("text"), TRIE_CHARS):
                    out = {f.name: [] for f in schema} | {"id": batch.column("id").slice(at, len(some))}
                    at += len(some)
                    for ids in codec.encode_some(some):
                        for o in outputs:
                            out[o].append(make[o](codec, ids))
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        finally:  # also where no more rows are asked for
            codec.forget()
            gc.enable()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{o} {_KINDS[o]}" for o in outputs)).withColumnRenamed("id", id_col)
