import html
import json
import re

from quillon.llm import wrappers


def plain(page):
    """The made pages' article: between its tags, split at block tags, references decoded."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|article)>", m[1])]
    return "\n".join(x for x in parts if x)


def test_equals_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def one(page, number):
    toks = wrappers.tokens(page)
    shaped = wrappers.stream(toks)
    items = wrappers.collapsed([x for x, _, _ in shaped], wrappers.literals(toks, shaped))
    return wrappers.entries([x for x, _, _ in items], [t for _, _, t in items], [number])


def wrapper_of(pages):
    w = one(pages[0], 0)
    for k, p in enumerate(pages[1:], 1):
        w = wrappers.merged(w, one(p, k))
    return w


def test_mismatches_become_optional_repeated_and_slots():
    a = one("<ul><li>1</li></ul><article><p>x</p><p>y</p></article><i>end</i>", 1)
    b = one("<ul><li>1</li><li>2</li><li>3</li></ul><div>ad</div><article><p>x</p></article><i>end</i>", 2)
    w = wrappers.merged(a, b)
    assert wrappers.pattern(a) == "<ul><li>=</li></ul><article>(<p>#</p>)+</article>="
    assert wrappers.pattern(w) == "<ul>(<li>#</li>)+</ul>(<div>)?(=)?(</div>)?<article>(<p>#</p>)+</article>="
    assert wrappers.pattern(wrappers.merged(w, a)) == wrappers.pattern(w) == wrappers.pattern(wrappers.merged(w, b))
    nested = one("<table>" + ("<tr>" + "<td>1</td>" * 3 + "</tr>") * 4 + "</table>", 1)
    assert wrappers.pattern(nested) == "<table>(<tr>(<td>=</td>)+</tr>)+</table>"
    long = "".join(f"<h{k}>t</h{k}><p>t</p>" for k in (1, 2, 3, 4, 5, 6)) + "<hr><pre>t</pre>"
    assert wrappers.pattern(one(long * 3, 1)).startswith("(<h1>=</h1><p>=</p><h2>") and wrappers.pattern(one(long * 3, 1)).endswith(")+")


def test_template_text_is_told_from_slots():
    """Fixed text of a host goes wherever it stands and however it is named; text in slots stays. Without the wrapper both stay."""
    pages = [
        f"<div class='no-sidebar'><p>Menu: start, search</p><div><h1>Head {w}</h1><p>Story of {w}, told at length.</p><p>More of {w}.</p></div><p>Follow us!</p></div>"
        for w in ("ants", "bees", "cows", "dogs", "eels")
    ]
    w = json.dumps(wrapper_of(pages))
    for name, page in zip(("ants", "bees", "cows", "dogs", "eels"), pages, strict=True):
        want = f"Head {name}\nStory of {name}, told at length.\nMore of {name}."
        assert wrappers.main_text(page, w) == want
        assert wrappers.main_text(page, None) == f"Menu: start, search\n{want}\nFollow us!"
    inside = [f"<article><h1>{w}</h1><p>Read by thousands every day.</p><div>{w} live.</div></article>" for w in ("Ants", "Bees", "Cows")]
    w = json.dumps(wrapper_of(inside))
    assert [wrappers.main_text(p, w) for p in inside] == [f"{x}\nRead by thousands every day.\n{x} live." for x in ("Ants", "Bees", "Cows")]
    untagged = [p.replace("article>", "div>") for p in inside]
    w = json.dumps(wrapper_of(untagged))
    assert [wrappers.main_text(p, w) for p in untagged] == [f"{x}\n{x} live." for x in ("Ants", "Bees", "Cows")]


def test_article_text_stays_however_many_pages_share_it(spark):
    def page(k):
        return f"<nav>menu</nav><article><h1>Title {k}</h1><h2>Ingredients</h2><p>Take {k} eggs.</p><blockquote>Eat well</blockquote></article><footer>end</footer>"

    for n in (1, 2, 3, 7):
        rows = [(k, f"http://h{n}.org/{k}", page(k)) for k in range(n)]
        got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {k: f"Title {k}\nIngredients\nTake {k} eggs.\nEat well" for k in range(n)}
    weather = [f"<article><h1>Weather</h1><p>{x} today</p><blockquote>As ever</blockquote></article>" for x in ("Rain", "Sun", "Snow")]
    w = json.dumps(wrapper_of(weather))
    assert [wrappers.main_text(p, w) for p in weather] == [f"Weather\n{x} today\nAs ever" for x in ("Rain", "Sun", "Snow")]


def test_copies_of_one_page_are_no_template():
    page = "<nav>n</nav><article><h1>One</h1><p>two</p></article>"
    assert wrappers.main_text(page, json.dumps(wrapper_of([page] * 6))) == "One\ntwo"
    same = [f"<nav>n{k}</nav><article><h1>One</h1><p>two</p></article>" for k in range(6)]
    assert wrappers.main_text(same[2], json.dumps(wrapper_of(same))) == "One\ntwo"


def fixed_by_brute_force(pages):
    """Texts (decoded, folded) that every page has once, between the same tags."""
    def texts(p):
        parts = re.split(r"(<[^>]*>)", p)
        return [(parts[k - 1] if k else "", " ".join(html.unescape(x).split())) for k, x in enumerate(parts) if not x.startswith("<") and x.strip()]

    every = [texts(p) for p in pages]
    return {t for tag, t in every[0] if all(own.count((tag, t)) == 1 for own in every)}


def test_small_hosts_equal_brute_force(spark):
    """Hosts of four to nine pages with fixed and varying blocks in a fixed order, against counting texts over all pages."""
    import random

    random.seed(8)
    rows, want = [], {}
    for h in range(12):
        kinds = [random.choice(["fixed", "varying"]) for _ in range(random.randint(3, 6))] + ["varying"]
        pages = []
        for k in range(random.randint(4, 9)):
            blocks = [f"<div{n}>" + (f"host {h} says {n} &amp; more" if kind == "fixed" else f"page {k} of {h} tells {n}") + f"</div{n}>" for n, kind in enumerate(kinds)]
            pages.append("<body>" + "".join(b.replace("<div", "<h" if n < 3 else "<p", 1).replace(f"</div{n}>", f"</{'h' if n < 3 else 'p'}{n}>") for n, b in enumerate(blocks)) + "</body>")
        fixed = fixed_by_brute_force(pages)
        for p in pages:
            at = len(rows)
            rows.append((at, f"http://h{h}.org/{at}", p))
            found = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", p)]
            want[at] = "\n".join(x for x in found if x and x not in fixed)
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want and any(len(w.split("\n")) < 3 for w in want.values())


def test_inline_tags_and_scripts_do_not_end_text():
    assert wrappers.main_text("<article><p>See <a class='related'>this page</a> for the rest.</p></article>", None) == "See this page for the rest."
    assert wrappers.main_text("<article>Start <a class='share'>s</a> middle<br>last line</article>", None) == "Start s middle\nlast line"
    assert wrappers.main_text("<article><p>one <script>var a = '<p>';</script>two</p><p><span class='ad'>Buy</span></p></article>", None) == "one two"
    assert wrappers.main_text("<body class='with-banner sidebar'><div id='no-comments'><p>text</p></div></body>", None) == "text"


def test_infers_over_levels(spark):
    made = [(k, "http://h.org/", "<nav>n</nav>" + "<article>" + "".join(f"<{t}>x</{t}>" for b, t in enumerate(("h1", "p", "pre", "ul", "h2", "dl")) if k >> b & 1).replace("x", f"x{k}") + "</article>") for k in range(64)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("host", wrappers.host(__import__("pyspark").sql.functions.col("url")))
    got = wrappers.infer(pages, at_once=5).collect()
    assert len(got) == 1
    w = json.loads(got[0].wrapper)
    assert [e[1] for e in w if e[0] in ("nav", "article", "/article")] == [False] * 3
    for k, _, page in made:
        assert wrappers.main_text(page, got[0].wrapper) == "\n".join([f"x{k}"] * bin(k).count("1"))


def test_removes_what_is_not_the_article():
    page = """<html><head><title>T</title></head><body><header>H</header><div class="menu"><a href=x>Home</a></div><div id="sidebar">S</div>
    <article><h1>A &amp; B</h1><p>one<b>two</b> <a href='y'>three</a>   four<br>five</p><aside>no</aside><div class='ad'>buy</div><form><label>mail</label><input></form>
    <script>var x = "<p>no</p>";</script><ul><li>i</li><li>j</li></ul><div class="cookie-notice">c</div><section class="comments"><p>reader</p></section></article><footer>F</footer>"""
    assert wrappers.main_text(page, None) == "A & B\nonetwo three four\nfive\ni\nj"
    no_article = "<div class=nav><a>x</a></div><div><p>Body &eacute;</p><p><a href=1>only</a> <a href=2>links</a></p></div><footer>f</footer>"
    assert wrappers.main_text(no_article, None) == "Body é"


def test_edges(spark):
    rows = [(1, None, None), (2, None, ""), (3, "bad", "plain text"), (None, "http://a.b/", "<article>x</article>"), (4, "http://a.b/", "<article>" + "<p>y</p>" * 40000), (4, "http://a.b/", "<article>x</article>"), (5, "http://A.b/", "<p <p class='><b>&lt;" + "<" * 500)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, wrapper string")
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    at = {(r.page_id, r.url): r for r in got}
    assert at[1, None].text == "" and at[2, None].n_chars == 0 and at[3, "bad"].text == "plain text" and at[None, "http://a.b/"].text == "x"
    assert sorted(r.n_chars for r in got if r.page_id == 4) == [1, 79999]
    assert wrappers.extract(pages.limit(0)).count() == 0
