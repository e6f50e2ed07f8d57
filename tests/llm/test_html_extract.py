import random

import numpy as np
import pytest

from lumenframe.llm.html_extract import extract, host_of, main_text, matching, merged, page_wrapper, parse, slot_of
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, text string, host string, wrapper string, salt int"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "t", "h", "w", 1) for i, u, h in rows], SCHEMA)
    return {r.page_id: r for r in main_text(df).collect()}


def page(title, blocks, extra="", nav="Home"):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>{nav}</a></li></ul></nav><div class='ad banner'>Buy</div><article><h1>{title}</h1>{body}</article>{extra}<footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a</p><p>b</p>", "a\nb"), ("<p>a<p>b", "a\nb"), ("<p><b>A<br><p>B", "A\nB"),
        ("<p>a &amp; b &eacute; &#8364; &nbsp; c &lt;x&gt;</p>", "a & b é € c <x>"), ("<p>a\n  <i>b</i>\tc</p>", "a b c"), ("<p>a<!-- no -->b</p>", "ab"),
        ("<div>a<p>b</p>c</div>", "a\nb\nc"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<nav>x</nav><p>a</p><form><p>q</p></form><aside>s</aside><footer>f</footer>", "a"), ("<div class=cookie-notice>x</div><p>a</p>", "a"), ("<p hidden>x</p><p style='display: none'>y</p><p>a</p>", "a"),
        ("<header>h</header><article><header><h1>T</h1></header><p>a</p></article><p>out</p>", "T\na"), ("<article><p>a</p><section id='comments'><p>c</p></section></article>", "a"),
        ("<article><p>a</p></article><article class='comment'><p>c</p></article>", "a"), ("<div class='page with-sidebar'><article><p>a</p></article><div class=sidebar>s</div></div>", "a"),
        ("<p>a < b and c > d</p>", "a < b and c > d"), ("<p title='x>y'>a</p>", "a"), ("<p>a</p", "a"), ("<script>x", ""), ("<p>a <a href=x>link</a> b</p>", "a link b"), ("<textarea>x</textarea><select><option>y</select><p>a", "a"),
        ("<article><p>a <span class='ad'>buy</span> b</p></article>", "a b"), ("<![CDATA[x]]><p>a</p>", "a"), ("<P CLASS=Y>A</P>", "A"), ("</div></p><p>a</p></body></body>", "a"),
    ],
)
def test_single_pages(html, text):
    assert extract(html, None) == text


def test_pages_of_one_template(spark):
    r = random.Random(1)
    rows = [(i, f"http://{'hot' if i % 3 else 'rare'}.example:80/p/{i}", page(f"Title {i}", [f"block {i} {j} &amp; more" for j in range(r.randrange(1, 9))], "<div class='comments'><p>nice</p></div>", f"menu {i}")) for i in range(120)]
    got = run(spark, rows)
    for i, _, h in rows:
        want = "\n".join([f"Title {i}", *[x.replace("&amp;", "&") for x in __import__("re").findall(r"<p>(block[^<]*)</p>", h)]])
        assert got[i].text == want and got[i].n_chars == len(want)


def test_constant_words_are_template_and_varying_ones_content(spark):
    rows = [(i, "http://x/", f"<div><div>Site of things</div><div><h2>About {i}</h2><p>Text {i}</p></div><p>Sign our guest book</p></div>") for i in range(6)]
    assert {r.text for r in run(spark, rows).values()} == {f"About {i}\nText {i}" for i in range(6)}


def test_copies_of_one_page_and_small_hosts_keep_their_words(spark):
    copies = [(i, "http://x/", page("T", ["same", "words"])) for i in range(9)]
    few = [(100 + i, "http://y/", f"<div><p>same</p><p>{i}</p></div>") for i in range(2)]
    got = run(spark, copies + few)
    assert {got[i].text for i in range(9)} == {"T\nsame\nwords"} and got[100].text == "same\n0"


def test_a_block_that_many_pages_share_stays(spark):
    rows = [(i, "http://x/", page(f"T{i}", [f"a{i}", "shared passage", f"b{i}"])) for i in range(12)]
    assert all(r.text == f"T{i}\na{i}\nshared passage\nb{i}" for i, r in run(spark, rows).items())


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "<p>a"), (1, None, "<p>a")], "page_id long, url string, html string")
    assert sorted(r.text for r in main_text(df).collect()) == ["", "a", "a"]
    assert run(spark, []) == {}


def test_long_and_deep_pages():
    assert len(extract("<p>" + "x " * 500_000, None)) == 999_999
    assert extract("<div>" * 30_000 + "a" + "<span class=ad>" * 999, None) == "a"
    assert extract("<div>" * 300 + "a" + "</div>" * 300, None) == "a"
    for bad in ("<a ", "<", "<!", "<script ", "<p x='", "&#", "</", '<a x="<'):
        extract(bad * 30_000, None)
    long, short = (parse("<body>" + "<h2>t</h2><p>a</p>" * n + "</body>") for n in (8000, 5000))
    assert trees(merged(slot_of([long], []), slot_of([short], []))) == trees(slot_of([long], []))
    assert extract("<p>a</p>" * 20_000, None).count("a") == 20_000


def trees(w):
    return 1 + sum(map(trees, w[6]))


def brute(a, b):
    """Simple tree matching by trying every order-keeping choice; equal words count as a node more."""
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute(xs[0], ys[0]) + best(xs[1:], ys[1:]) if xs[0][0] == ys[0][0] else 0)

    return 1 + (a[4] == b[4] and bool(a[4])) + best(a[6], b[6])


def test_matching_equals_brute_force():
    r = random.Random(5)

    def make(depth):
        inner = "".join(make(depth - 1) for _ in range(r.randrange(1, 4))) if depth else r.choice(["x", "y"])
        tag = r.choice(["div", "section", "h2"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(150):
        a, b = (slot_of([parse(make(3))], []) for _ in range(2))
        assert matching(a, b, {}) == brute(a, b)
        assert trees(merged(a, b)) <= trees(a) + trees(b)


def test_host(spark):
    urls = {"http://A.b/c": "a.b", "https://u@x:8080/p?q": "x", "x.y/z": "x.y", None: "", "": "", "http://h#f": "h"}
    df = spark.createDataFrame([(u, h) for u, h in urls.items()], "u string, h string")
    assert all(r.got == r.h for r in df.select("h", host_of(F.col("u")).alias("got")).collect())


def of_one_host(pages):
    whole = page_wrapper(pages[0])
    for p in pages[1:]:
        whole = merged(whole, page_wrapper(p))
    return [extract(p, whole) for p in pages]


@pytest.mark.parametrize("copies", [2, 3, 9])
def test_copies_under_differing_menus_keep_their_words(copies):
    pages = [page("T", ["same", "words"], f"<footer>f{i}</footer>", f"menu {i}") for i in range(copies)]
    assert of_one_host(pages) == ["T\nsame\nwords"] * copies
    others = [page(f"T{i}", [f"a{i}"]) for i in range(9)]
    quoted = [page("T", ["same"]).replace("</article>", "<blockquote>q</blockquote></article>")] * copies
    assert of_one_host(quoted + others) == ["T\nsame\nq"] * copies + [f"T{i}\na{i}" for i in range(9)]


def test_a_line_of_different_articles_is_still_template():
    pages = [page(f"T{i}", [f"a{i}"]).replace("</article>", "<h6>Read on</h6></article>") for i in range(4)]
    assert of_one_host(pages * 2) == [f"T{i}\na{i}" for i in range(4)] * 2
    assert of_one_host(pages[:2])[0] == "T0\na0"
    assert of_one_host(pages[:1] * 9)[0] == "T0\na0\nRead on"


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', "one two\nthree"),
        ("<p>a<SVG viewBox='0 > 0' />b</p><p>c</p>", "ab\nc"), ("<p>a<svg/>b<svg><path d=x/><text>no</text></svg>c</p>", "abc"),
        ("<p>a</p><svg-icon name=x></svg-icon><title-bar>t</title-bar><template-card><p>b</p></template-card>", "a\nt\nb"),
        ("<p>a</p><script src=x />no</script><style>no</style ><p>b</p>", "a\nb"), ("<p>a</p><svg\n><text>no</text></svg\n><p>b", "a\nb"),
    ],
)
def test_elements_that_hold_raw_text_end_where_they_end(html, text):
    assert extract(html, None) == text


def test_unclosed_svgs_take_linear_time():
    for bad in ("<svg ", "<svg x='", '<svg "/', "<svg/", "<svg-a "):
        extract(bad * 30_000, None)


def made_up_host(r, names):
    """Pages of one random template without names of use, and the text that each was filled with."""
    tag = lambda: r.choice(["div", "section", "div"]) if names else "div"
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    box = lambda text: (lambda t, u: f"<{t}><{u}>{text}</{u}></{t}>")(tag(), r.choice(["p", "div"]) if names else "div")
    before, after = ([box(line(r.randrange(2, 6))) for _ in range(r.randrange(3))] for _ in range(2))
    menu = r.random() < 0.7
    outer, inner = tag(), tag()
    pages = []
    for _ in range(r.randrange(2, 12)):
        blocks = [line(r.randrange(20, 60)) for _ in range(r.randrange(2, 7))]
        title = line(4)
        links = "".join(f"<li><a href=/>{line(1)}</a></li>" for _ in range(r.randrange(2, 6))) if menu else ""
        heading = f"<h1>{title}</h1>" if names else f"<div>{title}</div>"
        body = heading + "".join(f"<p>{b}</p>" if names else f"<div>{b}</div>" for b in blocks)
        page = f"<html><head><title>{title}</title></head><body><{outer}><ul>{links}</ul>{''.join(before)}<{inner}>{body}</{inner}>{''.join(after)}</{outer}></body></html>"
        pages.append((page, "\n".join([title, *blocks])))
    return pages


@pytest.mark.parametrize("names", [True, False])
def test_made_up_hosts_give_what_they_were_filled_with(names):
    r = random.Random(7)
    for _ in range(60):
        pages = made_up_host(r, names)
        assert of_one_host([p for p, _ in pages]) == [t for _, t in pages]


def test_without_names_the_wrapper_finds_the_same_text():
    """The small table's pages with every element a div, all attributes gone and wrappers induced anew."""
    import html as entities

    import duckdb

    rows = duckdb.sql("select url, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()

    def emit(n):
        if n.tag == "#text":
            return entities.escape(n.text) if n.plain else f"<a>{entities.escape(n.text)}</a>"
        return "<div>" + "".join(map(emit, n.children)) + "</div>"

    hosts = {}
    for url, page in rows:
        root = parse(page)
        plain = f"<title>{entities.escape(root.text)}</title>" + "".join(map(emit, root.children))
        hosts.setdefault(url.split("/")[2], []).append((page, plain))
    same = changed = 0
    for pages in hosts.values():
        named, nameless = of_one_host([p for p, _ in pages]), of_one_host([p for _, p in pages])
        same += sum(a == b for a, b in zip(named, nameless))
        changed += sum(extract(p, None) != t for (_, p), t in zip(pages, nameless))
    assert same >= 0.95 * len(rows)


def test_constant_neighbours_of_one_kind_are_told_apart():
    pages = [f"<div>links</div><div><h1>T {i}</h1><p>{'words ' * i}{i}</p></div><div><p>Copyright 2020</p></div>" for i in range(10)]
    assert of_one_host(pages) == [f"T {i}\n{'words ' * i}{i}" for i in range(10)]
    rows = [f"<div><h2>News</h2><div><p>about {i} {i * i}</p><p>end {i}</p></div><div><p>Write to us</p></div></div>" for i in range(5)]
    assert of_one_host(rows) == [f"about {i} {i * i}\nend {i}" for i in range(5)]
    assert [extract(p, None) for p in rows] != of_one_host(rows)


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article><div class="article-header"><h1>Title</h1></div><p>a</p></article>', "Title\na"), ('<article><p>a</p><section class="related-work"><p>b</p></section></article>', "a\nb"),
        ('<article><p class="share-price">a</p><p>b</p></article>', "a\nb"), ('<article><p class="notice-of-meeting">a</p><p>b</p></article>', "a\nb"),
        ('<article><p>a <span class="share-price">4</span> b</p><div class="x share">no</div><div class="header"><h2>h</h2></div></article>', "a 4 b\nh"),
        ('<main><p>a</p><div id="comments"><p>c</p></div></main>', "a"), ('<div><p class="share-price">a</p><p>b</p></div>', "a\nb"),
    ],
)
def test_parts_of_names_drop_nothing_inside_an_article(html, text):
    assert extract(html, None) == text


def test_names_that_vary_dont_make_a_wrapper_grow():
    def size(n):
        whole = None
        for i in range(n):
            w = page_wrapper(f"<div class='post-{i}x'><div class='a{i}b'><h1>T{i}</h1><p id=p{i}q>words {i}</p></div></div>")
            whole = w if whole is None else merged(whole, w)
        return trees(whole)

    assert size(10) == size(200)


def test_wrappers_too_large_to_send(spark):
    rows = [(i, f"http://h{i % 3}/", page(f"T{i}", [f"a{i}", f"b{i}"]).replace("article>", "div>"), "t", "h", "w", 1) for i in range(40)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    few, many = (sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in main_text(df, broadcast_bytes=b).collect()) for b in (1 << 20, -1))
    assert few == many and len(few) == 41 and few[1][2] == "T0\na0\nb0"


def test_a_page_wrapper_makes_each_slot_once(monkeypatch):
    """The slots by which the article is found are the wrapper's, and hold its sketch."""
    from lumenframe.llm import html_extract as h

    made, real = [], h.slot_of
    monkeypatch.setattr(h, "slot_of", lambda group, article: made.append([id(n) for n in group]) or real(group, article))
    text = " ".join(f"word{i}" for i in range(9_000))
    wrapper = h.page_wrapper(f"<html><body><div><ul><li>a</li><li>b</li></ul></div><div><p>{text}</p><p>Another one.</p></div></body></html>")
    assert len(made) == len({tuple(g) for g in made})

    def held(slot):
        yield slot[3]
        for s in slot[6]:
            yield from held(s)

    x = h.windows(h.word_hashes(h.normal_words(f"{text}\nAnother one.")), 5)
    sketch = [int(h.mix(x ^ s).min() >> np.uint64(32)) for s in h.mix(np.arange(1, h.SKETCH + 1, dtype=np.uint64))]
    assert h.page_sketch(f"{text}\nAnother one.") == sketch and list(held(wrapper)) and all(a == [sketch] for a in held(wrapper))
