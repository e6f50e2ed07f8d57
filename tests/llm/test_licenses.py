import pytest
from helpers import documents, edited, empty, shaped

from lumenframe.llm.licenses import COVERAGE, TEMPLATES, Index, _plain, align, license_spans, templates_of

EVERY = templates_of()
ALL = [(n, t) for n, t in EVERY if 2 < len(_plain(t)[0]) < 200]
WHOLE = Index(EVERY)


@pytest.mark.parametrize("name,text", ALL)
def test_each_template_is_found_whole_where_it_stands(name, text):
    before, after = shaped(1, 30) + "\n", "\n" + shaped(2, 30)
    found = WHOLE.scan(before + text + after)
    assert found[0][0] == name and found[0][1] == 1.0
    assert (found[0][3], found[0][4]) == (len(before), len(before) + len(text)) and len(found) == 1


def test_changed_wording_is_found_and_scored():
    text = TEMPLATES["MIT"][1]
    found = WHOLE.scan("é🎉 " + edited(text, 4, 6) + " end")
    assert [f[0] for f in found] == ["MIT"] and 0.8 < found[0][1] < 1
    assert WHOLE.scan(edited(text, 4, 60)) == []


def test_clean_texts_and_lone_words():
    assert WHOLE.scan("All rights of man. The license of the MIT version is reserved.") == []
    assert WHOLE.scan(shaped(3, 400)) == []


def test_two_in_one_text_in_order():
    a, b = TEMPLATES["CC-BY-NC-4.0"][0], TEMPLATES["GPL-3.0"][0]
    assert [f[0] for f in WHOLE.scan(f"{a} {shaped(1, 50)} {b} {a}")] == ["CC-BY-NC-4.0", "GPL-3.0", "CC-BY-NC-4.0"]


def test_alignment_is_a_longest_common_subsequence_inside_the_band():
    a = list(range(20))
    b = [99, *a[:7], 98, 97, *a[9:20], 96]
    assert [i for i, _ in align(a, b, 1, 1, 5)] == [*range(7), *range(9, 20)]


def test_operator(spark):
    line = "Licensed under CC BY-NC 4.0."
    rows = license_spans(documents(spark, [None, "", line, f"x {line}", "  "])).collect()
    assert [(r.doc_id, r.license, r.start, r.end) for r in rows] == [(2, "CC-BY-NC-4.0", 0, 28), (3, "CC-BY-NC-4.0", 2, 30)]
    assert license_spans(empty(spark)).collect() == []


def plainly(template, words):
    """The share of the template that a longest common subsequence with words has."""
    row = [0] * (len(words) + 1)
    for x in template:
        new = [0]
        for j, y in enumerate(words):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1] / len(template)


def changed(words, at, kind, new):
    return [*words[:at], *[[new], [], [new, words[at]]][kind], *words[at + 1 :]]


@pytest.mark.parametrize("name,text", ALL)
def test_one_edit_at_each_word_is_found_as_by_plain_alignment(name, text):
    index, words, around = Index([(name, text)]), text.split(), (shaped(1, 30), shaped(2, 30))
    for at in range(len(words)):
        for kind in range(3):
            new = changed(words, at, kind, "zzz")
            share = plainly(_plain(text)[0], _plain(" ".join(new))[0])
            found = index.scan(" ".join([around[0], *new, around[1]]))
            assert [f[1] for f in found] == ([share] if share >= COVERAGE else []), (at, kind)


@pytest.mark.parametrize("name,text", ALL)
def test_as_many_changed_words_as_coverage_allows(name, text):
    index, words = Index([(name, text)]), _plain(text)[0]
    words, most = [w.decode() for w in words], int(0.2 * len(words) + 1e-9)
    for first in range(len(words)):
        new = list(words)
        step = max(1, -(-len(words) // (most + 1)))
        for e in range(most):
            new[(first + e * step) % len(words)] = f"z{e}"
        share = plainly([w.encode() for w in words], [w.encode() for w in new])
        assert share >= COVERAGE and [f[1] for f in index.scan(" ".join(["q", *new, "q"]))] == [share], first


@pytest.mark.parametrize(
    "text,want",
    [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-Sampling 4.0 International License.", []),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("# SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: Nonsense-9", []),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 7.", []), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ["BSD"]),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ["MIT"]),
    ],
)
def test_the_right_licence(text, want):
    assert [f[0] for f in WHOLE.scan(f"{shaped(5, 20)} {text} {shaped(6, 20)}")] == want


def test_whole_texts():
    for name, text in EVERY:
        if len(text) > 5000:
            assert [(f[0], f[1]) for f in WHOLE.scan(text)] == [(name, 1.0)], name
            changed = edited(text, 1, len(text.split()) // 20)
            assert [f[0] for f in WHOLE.scan(changed)] == [name], name


def test_finds_equal_alignment_of_each_template_everywhere():
    """Brute force: each template by plain subsequence in every window of its length, in texts with planted and changed ones."""
    import random

    r = random.Random(8)
    few = [t for t in ALL if len(_plain(t[1])[0]) < 20 and not t[1].startswith("SPDX")]
    for k in range(40):
        name, text = r.choice(few)
        words = text.split()
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(len(words))] = f"z{r.randrange(99)}"
        whole = " ".join([shaped(k, 12), *words, shaped(100 + k, 12)])
        plain, own = _plain(whole)[0], _plain(text)[0]
        best = max(plainly(own, plain[i : i + len(own)]) for i in range(len(plain) - len(own) + 1))
        alone = Index([(name, text)]).scan(whole)
        assert [f[1] for f in alone] == ([best] if best >= COVERAGE else []), (name, words)
        if words == text.split():  # else a telling word may be gone
            assert [f[0] for f in WHOLE.scan(whole)] == [name]


def test_null_ids_ties_repeats_and_very_long_texts(spark):
    line = "Licensed under CC BY-NC 4.0."
    long = shaped(1, 30) + " " + "word " * 300_000 + line
    rows = license_spans(documents(spark, [line, line, long, f"{line} {line}"], [1, 1, None, 2])).collect()
    assert sorted((r.doc_id or 0, r.license) for r in rows) == [(0, "CC-BY-NC-4.0"), (1, "CC-BY-NC-4.0"), (1, "CC-BY-NC-4.0"), (2, "CC-BY-NC-4.0"), (2, "CC-BY-NC-4.0")]
    tied = license_spans(documents(spark, ["one two three four five"]), templates={"B": ["one two three four five"], "A": ["one two three four five"]}).collect()
    assert [r.license for r in tied] == ["A"]
