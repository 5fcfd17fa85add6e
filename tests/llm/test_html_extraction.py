import pytest

from tessaprobe.llm import html_extraction as hx

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{x:"</p>"}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy {n}</div><div class="cookie-notice">Cookies!</div>{main}<aside>Side</aside><form><p>Form<input name=q></form>
<div id="comments"><p>First! {n}</p></div><footer>&copy; {n}</footer></body></html>"""
MAIN = "<article><h1>Title&nbsp;{n}</h1><p>One <b>bold</b>\n  text &amp; more{n}<p>Two<br>lines <a href='x'>link</a> {n}</p><div class=\"share-buttons\">Share</div>" \
    "<ul><li>i{n}<li>ii</ul><section class='comments'><p>reply</p></section></article>"  # fmt: skip


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows, extra=()):
        return spark.createDataFrame([r + tuple(1 for _ in extra) for r in rows], "page_id bigint, url string, html string" + "".join(f", {c} int" for c in extra))

    return make


def test_article_with_every_kind_of_noise(pages):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i, main=MAIN.format(n=i))) for i in range(14)]
    got = {r.page_id: r for r in hx.extracted(pages(rows, ("text", "host"))).collect()}
    for i in range(14):
        want = f"Title {i}\nOne bold text & more{i}\nTwo lines link {i}\ni{i}\nii"
        assert got[i].text == want and got[i].n_chars == len(want)


def test_page_without_article_uses_the_densest_element(pages):
    main = "<div class='top'><p>x</p></div><div class='story'><h2>Head {n}</h2>" + "<p>A longer paragraph of text number {n} here.</p>" * 4 + "</div>"
    rows = [(i, "http://one.org/", PAGE.format(n=i, main=main.format(n=i))) for i in range(12)]
    got = {r.page_id: r.text for r in hx.extracted(pages(rows)).collect()}
    assert got[3] == "\n".join(["Head 3"] + ["A longer paragraph of text number 3 here."] * 4)


def test_template_text_is_dropped(pages):
    main = "<article><h2>Read our story</h2><p>Own text {n}</p></article>"
    rows = [(i, "http://t.org/", PAGE.format(n=i, main=main.format(n=i))) for i in range(12)]
    rows += [(50 + i, "http://same.org/", PAGE.format(n=1, main=main.format(n=1))) for i in range(12)]
    got = {r.page_id: r.text for r in hx.extracted(pages(rows)).collect()}
    assert got[4] == "Own text 4"
    assert got[50] == "Read our story\nOwn text 1", "equal pages don't show what is template"


def test_siblings_of_template_text_and_text_of_some_pages_stay(pages):
    main = "<article><h1>Title {n}</h1><p>By our staff</p><ul><li>i{n}</ul><p>Body {n}</p><p>More {n}</p>{extra}</article>"
    rows = [(i, f"http://s.org/{i}", main.format(n=i, extra="<h2>Ingredients</h2>" if i % 2 else "")) for i in range(24)]
    copy = "<article><h1>Once</h1><p>By our staff</p><ul><li>x</ul><p>Body</p><p>More</p><blockquote>The only quote</blockquote></article>"
    rows += [(100 + i, "http://s.org/copy", copy) for i in range(12)]
    got = {r.page_id: r.text for r in hx.extracted(pages(rows)).collect()}
    for i in range(24):
        assert got[i] == "\n".join([f"Title {i}", f"i{i}", f"Body {i}", f"More {i}"] + ["Ingredients"] * (i % 2))
    assert got[104] == "Once\nx\nBody\nMore\nThe only quote"


def test_copies_of_few_pages_show_no_template(pages):
    rows = [(i, "http://c.org/", f"<article><h2>Own head</h2><p>Text {i % 3}</p></article>") for i in range(30)]
    assert {r.page_id: r.text for r in hx.extracted(pages(rows)).collect()}[4] == "Own head\nText 1"


ODD = [None, "", "plain text", "<p>a", "<p", "<article><p>a<p>b", "<script>never closed <p>x", "<!-- open <p>x", "<article>a &#x41; &bogus; &lt;b&gt; </article>", "<b><i><a>" * 500, "<div>" * 3000 + "x",
       "<p>&nbsp;\u3000 </p>", "<article></article><p>after", "</p></div>x", "<a href=\"" * 200]
WANT = {0: "", 1: "", 5: "a\nb", 8: "a A &bogus; <b>"}


def test_odd_pages(pages):
    rows = [(i, f"http://odd{i}.org", h) for i, h in enumerate(ODD)] + [(99, None, "<article>x</article>"), (99, None, "<article>x</article>"), (None, "no host", "<article>y</article>")]
    got = hx.extracted(pages(rows)).collect()
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    by_id = {g.page_id: g.text for g in got}
    assert {i: by_id[i] for i in WANT} == WANT and by_id[99] == "x" and by_id[None] == "y"
    assert hx.extracted(pages([])).collect() == []


def wrapper(*texts):
    e = hx.Extract()
    whole = None
    for t in texts:
        new = hx.expression(hx.parsed(t), e)
        whole = new if whole is None else hx.merged(whole, new, e)
    return hx.shown(whole)


def test_wrappers_are_union_free_expressions():
    assert wrapper("<ul><li>a<li>b</ul>", "<ul><li>c</ul>") == "<#><ul>(<li>#slot</li>)+</ul></#>"
    assert wrapper("<h1>t</h1><p>a</p>", "<p>b</p>") == "<#>(<h1>#text</h1>)?<p>#slot</p></#>"
    assert wrapper("<h2>a</h2><p>x</p><h2>b</h2><p>y</p>") == "<#>((<h2>#slot</h2><p>#slot</p>))+</#>"
    assert wrapper("<p>same</p>", "<p>same</p>") == "<#><p>#text</p></#>"


GONE = (
    "<nav><a href='/'>menu</a></nav>", "<div class='ad'>buy</div>", "<div id='ad_slot_3'>buy</div>", "<aside>side</aside>", "<form><p>sign up</p></form>", "<script>var t='</p>';</script>",
    "<style>p{}</style>", "<section class='related-posts'><p>other</p></section>", "<ul class=\"share buttons\"><li>share</li></ul>", "<div class='comments'><p>first!</p></div>", "<!-- <p>not</p> -->",
)
NAMES = ("related-work", "sponsorInterview", "share-of-wood", "comment-on-law", "body", "lead x9")


def random_page(rng, words=("one", "two", "caf&eacute;", "a &lt; b", "<b>bold</b>", "<a href='x'>link</a>")):
    """(html, text): a random tree of blocks in an article, parts that don't belong to it strewn in."""
    blocks = []

    def text():
        own = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        plain = " ".join(own)
        for a, b in (("&eacute;", "é"), ("&lt;", "<"), ("<b>", ""), ("</b>", ""), ("<a href='x'>", ""), ("</a>", "")):
            plain = plain.replace(a, b)
        blocks.append(plain)
        return rng.choice((" ", "\n", "\t ")).join(own)

    def tree(depth):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(6)
            if kind == 0 and depth:
                n = rng.choice((1, 1, 2, 150))
                out += f"<div class='{rng.choice(NAMES)}'>" * n + tree(depth - 1) + "</div>" * n
            elif kind == 1:
                out += "<ul>" + "".join(f"<li>{text()}" for _ in range(rng.randrange(1, 7))) + "</ul>"
            elif kind == 2:
                out += rng.choice(GONE)
            elif kind == 3:
                out += f"<blockquote>{text()}</blockquote>"
            else:
                out += f"<p>{text()}" + rng.choice(("", "</p>"))
        return out

    body = f"<article><h1>{text()}</h1>{tree(4)}<p>{text()}</p></article>"
    around = "<header><h1>site</h1></header>" + rng.choice(GONE)
    return f"<html><head><title>t</title></head><body>{around}{'<div>' * 5}{body}{'</div>' * 5}{rng.choice(GONE)}<footer>foot</footer></body></html>", "\n".join(blocks)


def test_random_trees_equal_what_was_put_in(spark):
    import random

    rng = random.Random(4)
    pages = [(i, f"http://h{i % 40}.org/{i}", *random_page(rng)) for i in range(200)]
    got = {r.page_id: r.text for r in hx.extracted(spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string").repartition(3)).collect()}
    assert all(got[i] == text for i, _, _, text in pages), next((got[i], text) for i, _, _, text in pages if got[i] != text)


def test_depth_and_width_have_no_end(spark):
    deep = "<div>" * 2000 + "<p>one</p><nav>menu</nav><div class='ad'>buy</div><p>two</p>" + "</div>" * 2000
    pages = [
        (1, "http://d.org/", f"<body><nav>m</nav><article>{deep}</article></body>"), (2, "http://e.org/", f"<body>{'<div>' * 2000}<article><p>one</p><nav>m</nav><p>two</p></article></body>"),
        (3, "http://w.org/", "<body><article>" + "".join(f"<p class='c{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}'>t{i}</p>" for i in range(3000)) + "</article></body>"),
        (4, None, "<p>word " * 50_000),
    ]
    got = {r.page_id: r.text for r in hx.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "one\ntwo" and got[3] == "\n".join(f"t{i}" for i in range(3000)) and got[4] == "\n".join(["word"] * 50_000)


def test_wrappers_of_changing_classes_stay_small():
    extract, whole = hx.Extract(), None
    for k in range(80):
        page = "<article>" + "".join(f"<p class='c{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + k * j % 26)}'>t{k} {j}</p>" for j in range(60)) + "</article>"
        new = hx.expression(hx.parsed(page), extract)
        whole = new if whole is None else hx.merged(whole, new, extract)
    assert len(hx.json.dumps(whole)) < 50_000
